"""`readStream.format("audio_chunks")`: growing files as streams of chunks, for `streaming.decoders.decode_stream`.

    spark.dataSource.register(ChunkSource)
    chunks = spark.readStream.format("audio_chunks").load("s3://recordings/")
    events = decode_stream(chunks, "Wav", idle=60)

Rows are (stream_id, seq, bytes, is_last): stream_id is the file's path below the folder, chunk seq holds the bytes from seq
times chunkBytes (1 MiB) on. A chunk goes out when it is full. A file is over when a file of its name with the suffix `ended` (".end") lies beside it,
or as soon as it is seen with closed=true, for files that are put there whole; its last chunk, which may be empty,
is the rest. An offset says of each file how many chunks went out and whether it is over, so a batch that is run again reads the same bytes
and a restart goes on where the checkpoint stands. Files must only grow. Small files are read several to a task, up to
partitionBytes (64 MiB), where each counts for 256 KiB more than its bytes; a long one is read by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, seq long, bytes binary, is_last boolean"


OPEN_BYTES = 1 << 18  # what opening a file counts for when files are dealt to tasks
ROWS, BATCH = 4096, 4 << 20  # rows of a batch at most, and the bytes that close one


@dataclass
class Chunks(InputPartition):
    """For each of some files below root (stream_id, low, high, over): chunks [low, high), the last of them the file's rest if it is over."""

    root: str
    files: list[tuple[str, int, int, bool]]


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options):
        self.where = options["path"]
        self.size = int(options.get("chunkBytes", str(1 << 20)))
        self.ended = options.get("ended", ".end")
        self.closed = options.get("closed", "false") == "true"
        self.most = int(options.get("partitionBytes", str(64 << 20)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """stream_id: [chunks, over] of each file that has any."""
        fs, root = pafs.FileSystem.from_uri(self.where)
        files = {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File}
        out = {}
        for path, size in files.items():
            if path.endswith(self.ended):
                continue
            over = self.closed or path + self.ended in files
            n = size // self.size + over  # the rest of a file that is over is a chunk, even an empty one
            if n:
                out[path.removeprefix(root).lstrip("/")] = [n, over]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Small files several to a task, long ones in several tasks."""
        _, root = pafs.FileSystem.from_uri(self.where)
        step = max(1, self.most // self.size)
        out, some, held = [], [], 0
        for name, (n, over) in sorted(end.items()):
            done = start.get(name, [0, False])[0]
            cuts = [*range(done, n, step), n]
            for a, b in zip(cuts, cuts[1:]):
                cost = (b - a) * self.size + OPEN_BYTES
                if some and held + cost > self.most:
                    out.append(Chunks(root.rstrip("/"), some))
                    some, held = [], 0
                some.append((name, a, b, over and b == n))
                held += cost
        return [*out, Chunks(root.rstrip("/"), some)] if some else out

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.where)
        rows, held = [], 0
        for name, low, high, over in partition.files:
            with fs.open_input_file(f"{partition.root}/{name}") as file:
                for k in range(low, high):
                    data = file.read_at(self.size, k * self.size)
                    rows.append((name, k, data, over and k + 1 == high))
                    held += len(data)
                    if held >= BATCH or len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, bytes, bool]]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["stream_id", "seq", "bytes", "is_last"])


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChunkReader(self.options)
