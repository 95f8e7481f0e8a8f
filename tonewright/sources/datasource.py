"""`spark.read.format("audio")`: a Python data source over files of all registered formats.

    spark.dataSource.register(AudioSource)
    spark.read.format("audio").option("mode", "header").load("s3://corpus/")

Options: path (a folder, read with its subfolders, or a file), mode ("decode", or "header" for
properties without samples, which reads only the start of WAV, AIFF and FLAC files), partitionBytes,
and pushdown: "true", which needs spark.sql.python.filterPushdown.enabled, pushes an equality on
`format` into the reader, so files of other formats are skipped after their first bytes. Files that can't be decoded have
an error in their row. The binary reader of `registry` is the choice where paths only Spark can open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from tonewright.sources import aiff, flac, registry, wav
from tonewright.sources.errors import AudioError
from tonewright.sources.info import ERROR_TYPE, INFO_TYPE, FormatInfo, info

SCHEMA = f"path string, length long, format string, info {INFO_TYPE}, pcm array<float>, error {ERROR_TYPE}"
HEAD = 1 << 18


def format_of(head: bytes) -> str | None:
    """As headers.detect_format, over bytes."""
    for magic, name in ((b"RIFF", "Wav"), (b"fLaC", "Flac"), (b"OggS", "Ogg")):
        if head[:4] == magic:
            return name
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        return "Aiff"
    if len(head) < 4:
        return None
    if head[:3] == b"ID3":
        return "Mp3"
    if head[0] == 0xFF and head[1] & 0xE0 == 0xE0:
        return "Aac" if head[1] & 0xF6 == 0xF0 else "Mp3"
    return None


def described(kind: str, head: bytes) -> FormatInfo | None:
    """Properties from the start of a file, with the declared length; None where the whole file is needed."""
    if kind == "Flac":
        try:
            s = flac.metadata(head).info
        except AudioError as e:
            if e.code == "EndOfStream":
                return None
            raise
        return info("Flac", s.rate, s.channels, s.bits, s.total)
    if kind in ("Wav", "Aiff"):
        f = (wav if kind == "Wav" else aiff).layout(head)
        if f is not None:
            f.check()
            return info(kind, f.rate, f.channels, f.bits, f.declared // (f.width * f.channels))
    return None


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class AudioReader(DataSourceReader):
    def __init__(self, options):
        self.where = options["path"]
        self.header = options.get("mode", "decode") == "header"
        self.most = int(options.get("partitionBytes", str(64 << 20)))
        self.only: str | None = None

    def partitions(self) -> list[InputPartition]:
        """Files in order of path, together up to partitionBytes."""
        fs, root = pafs.FileSystem.from_uri(self.where)
        found = fs.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out, size = [Files([])], 0
        for f in sorted((f for f in files if f.type == pafs.FileType.File), key=lambda f: f.path):
            if size and size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((f.path, f.size))
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.where)
        for path, size in partition.paths:
            with fs.open_input_file(path) as file:
                head = file.read(HEAD)
                kind = format_of(head)
                if self.only is not None and kind != self.only:
                    continue
                row, pcm, error = None, None, None
                try:
                    if kind is None:
                        raise AudioError("UnsupportedFormat" if len(head) >= 4 else "InvalidHeader")
                    row = described(kind, head) if self.header else None
                    if row is None:
                        row, samples = registry.DECODERS[kind](head + file.read())
                        pcm = None if self.header else np.asarray(samples, np.float32)
                except AudioError as e:
                    error = {"code": e.code, "detail": e.detail}
            told = None if row is None else dict(zip(registry.INFO_ARROW.names, row.row(), strict=True))
            columns = [pa.array([path]), pa.array([size], pa.int64()), pa.array([kind], pa.string()), pa.array([told], registry.INFO_ARROW), registry.lists([pcm], pa.float32()), pa.array([error], registry.ERROR_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "format", "info", "pcm", "error"])


class PushingReader(AudioReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("format",):
                self.only = f.value
            else:
                yield f


class AudioSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else AudioReader)(self.options)
