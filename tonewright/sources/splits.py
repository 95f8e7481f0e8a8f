"""`spark.read.format("audio_frames")`: audio files in parts, so that no file is one cell or one task.

    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("audio_frames").option("pushdown", "true").load("s3://corpus/long/")
    rows.filter("stop > 441000 AND start < 882000")       # opens only the bytes that hold those frames

A row holds the frames [start, stop) of a file, interleaved. Files up to partitionBytes (64 MiB) are read whole, several to a task; a
longer WAV or AIFF file is cut by arithmetic, a longer FLAC file by bytes: a task looks for the first frame that begins in its range, which is
one whose CRC-16 closes at a header that carries the next number, and reads on behind its range until its last frame closes. Filters `stop > a` and
`start < b` are pushed: WAV and AIFF are read from the offset, FLAC from where the seek table, and then a bisection by frame
numbers, says that the frames lie. Other formats are decoded whole, as one row. A file or part that can't be decoded is a row with an error.

Options: path, partitionBytes, blockFrames (frames a row of WAV and AIFF, 65,536), pushdown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tonewright.sources import aiff, flac, registry, wav
from tonewright.sources.datasource import HEAD, format_of
from tonewright.sources.errors import AudioError, bad_data
from tonewright.sources.info import ERROR_TYPE

SCHEMA = f"path string, format string, sample_rate int, channels int, start long, stop long, pcm array<float>, error {ERROR_TYPE}"
ALL = 1 << 62
Read = Callable[[int, int], bytes]  # offset and length; fewer bytes at the end of the file


@dataclass
class Part(InputPartition):
    """Files to read whole, or a range of one: frames of WAV and AIFF, bytes of FLAC."""

    files: list[tuple[str, int]]
    low: int = 0
    high: int | None = None


def worst_frame(s: flac.StreamInfo) -> int:
    """Bytes that no FLAC frame of a sane encoder exceeds: twice its samples as they are."""
    return 2 * (s.max_block * s.channels * (s.bits + 1) // 8) + 512


def frames_from(data: bytes, s: flac.StreamInfo, limit: int, ended: bool) -> tuple[list[flac.Frame], bool]:
    """The frames that begin before limit in bytes that start anywhere in a stream, and whether all closes up to the first frame behind limit.

    That frame is checked too, as who starts there can't tell a broken one from bytes that look like a header. ended: the bytes reach
    to the end of the file.
    """
    heads = [h for m in flac.SYNC.finditer(data) if (h := flac.frame_header(data, m.start(), s)) is not None]
    out: list[flac.Frame] = []
    worst, k = worst_frame(s), 0
    while k < len(heads) and (out or heads[k].at < limit):
        now, after, behind = heads[k], None, heads[k].at >= limit
        for j in range(k + 1, len(heads)):
            size = heads[j].at - now.at
            if size > worst:
                break
            if size >= now.body + 2 and heads[j].start == now.start + now.block and flac._closed(data, now.at, heads[j].at):
                after = j
                break
        if after is None and ended and (end := flac._end(data, now, s)) is not None and len(data) - now.at <= worst:
            now.size = end - now.at
            return out if behind else [*out, now], True
        if after is None and out:
            return out, False
        if behind:
            return out, True
        if after is None:
            k += 1  # no frame: the bytes only look like a header
            continue
        now.size = heads[after].at - now.at
        out.append(now)
        k = after
    return out, True


def _probe(read: Read, at: int, size: int, s: flac.StreamInfo) -> flac.Frame | None:
    """The first frame at or behind an offset, with its place in the file."""
    data = read(at, 2 * worst_frame(s) + flac.HEAD)
    found, _ = frames_from(data, s, worst_frame(s), at + len(data) >= size)
    if found:
        found[0].at += at
    return found[0] if found else None


def bytes_of_range(read: Read, size: int, meta: flac.Metadata, start: int, stop: int) -> tuple[int, int]:
    """Offsets between which all frames begin that hold samples of [start, stop)."""
    s = meta.info
    points = [(meta.audio_at + p[1], p[0]) for p in meta.seek_points if p[2]]

    def last_before(sample: int) -> tuple[int, int]:
        """The offset of a frame that begins at or before a sample, and one behind which all begin after it; both near."""
        low = max((at for at, first in points if first <= sample), default=meta.audio_at)
        high = min((at for at, first in points if first > sample), default=size)
        while high - low > 4 * worst_frame(s):
            middle = (low + high) // 2
            found = _probe(read, middle, size, s)
            if found is None or found.at >= high or found.start > sample:
                high = middle
            else:
                low = found.at
        return low, high

    low = last_before(start)[0] if start > 0 else meta.audio_at
    return low, last_before(stop - 1)[1] if stop < ALL and (not s.total or stop < s.total) else size


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.where = options["path"]
        self.most = int(options.get("partitionBytes", str(64 << 20)))
        self.block = int(options.get("blockFrames", str(1 << 16)))
        self.start, self.stop = 0, ALL

    def partitions(self) -> list[InputPartition]:
        """Only files longer than partitionBytes are opened here, for their headers."""
        fs, root = pafs.FileSystem.from_uri(self.where)
        found = fs.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out: list[Part] = []
        few, held = [], 0
        for f in sorted((f for f in files if f.type == pafs.FileType.File), key=lambda f: f.path):
            if f.size > self.most and (cut := self._cut(fs, f.path, f.size)) is not None:
                out += [Part([(f.path, f.size)], a, b) for a, b in cut]
                continue
            if few and held + f.size > self.most:
                out.append(Part(few))
                few, held = [], 0
            few.append((f.path, f.size))
            held += f.size
        return [*out, Part(few)] if few or not out else out

    def _cut(self, fs, path: str, size: int) -> list[tuple[int, int]] | None:
        """Ranges of a long file; None if it has to be read whole."""
        with fs.open_input_file(path) as file:
            read = reading(file)
            try:
                kind, found = self._header(read, size)
            except AudioError:
                return None  # the task says what is wrong
            if kind == "Flac":
                low, high, step = *bytes_of_range(read, size, found, self.start, self.stop), self.most
            elif kind in ("Wav", "Aiff"):
                frame = found.width * found.channels
                low, high, step = self.start, min(self.stop, min(found.declared, size - found.start) // frame), max(1, self.most // frame)
            else:
                return None
        return [(a, min(a + step, high)) for a in range(low, high, step)]

    @staticmethod
    def _header(read: Read, size: int) -> tuple[str, wav.Layout | aiff.Layout | flac.Metadata | None]:
        """The format and its layout, from as many bytes at the start as it takes."""
        n = 1 << 12
        while True:
            head = read(0, n)
            kind = format_of(head)
            if kind is None:
                raise AudioError("UnsupportedFormat" if len(head) >= 4 else "InvalidHeader")
            found = None
            if kind == "Flac":
                try:
                    found = flac.metadata(head)
                except AudioError as e:
                    if e.code != "EndOfStream" or n >= size:
                        raise
            elif kind in ("Wav", "Aiff"):
                found = (wav if kind == "Wav" else aiff).layout(head)
            else:
                return kind, None
            if found is not None:
                return kind, found if kind == "Flac" else found.check()
            if n >= size:
                raise AudioError("InvalidHeader", "the file ends before its samples")
            n = min(size, n * 64)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.where)
        for path, size in partition.files:
            with fs.open_input_file(path) as file:
                kind, rate, channels = None, None, None
                try:
                    for kind, rate, channels, start, pcm in self._rows(reading(file), size, partition):
                        stop = start + len(pcm) // channels
                        if stop > self.start and start < self.stop:
                            yield told(path, kind, rate, channels, start, stop, pcm, None)
                except AudioError as e:
                    yield told(path, kind, rate, channels, None, None, None, {"code": e.code, "detail": e.detail})

    def _rows(self, read: Read, size: int, part: Part) -> Iterator[tuple]:
        kind, found = self._header(read, size)
        if kind in ("Wav", "Aiff"):
            frame = found.width * found.channels
            low, high = part.low, part.high
            if high is None:
                low, high = self.start, min(self.stop, min(found.declared, size - found.start) // frame)
            for at in range(low, high, self.block):
                n = min(self.block, high - at)
                yield kind, found.rate, found.channels, at, np.asarray(found.samples(read(found.start + at * frame, n * frame)), np.float32)
        elif kind == "Flac":
            low, high = (part.low, part.high) if part.high is not None else bytes_of_range(read, size, found, self.start, self.stop)
            yield from self._flac(read, size, found.info, low, high, found.audio_at)
        else:
            row, pcm = registry.DECODERS[kind](read(0, size))
            yield kind, row.sample_rate, max(row.channels, 1), 0, np.asarray(pcm, np.float32)

    def _flac(self, read: Read, size: int, s: flac.StreamInfo, low: int, high: int, first: int) -> Iterator[tuple]:
        data = read(low, high - low + 2 * worst_frame(s) + flac.HEAD)
        frames, closed = frames_from(data, s, high - low, low + len(data) >= size)
        if low == first and data and (not frames or frames[0].at):
            raise bad_data("no frame behind the metadata closes")
        wanted = [f for f in frames if f.start + f.block > self.start and f.start < self.stop]
        few, held = [], 0
        for k, f in enumerate(wanted):
            few.append(f)
            held += f.block * s.channels
            if held >= 1 << 20 or k + 1 == len(wanted):
                values = flac.decode_frames([(data[x.at : x.at + x.size], x) for x in few], closed=True)
                for x, v in zip(few, values, strict=True):
                    yield "Flac", s.rate, s.channels, x.start, flac.scaled(v, s.bits).ravel()
                few, held = [], 0
        if not closed:
            raise bad_data("CRC-16 mismatch or cut frame")


def reading(file) -> Read:
    return lambda at, n: file.read_at(n, at)


def told(path, kind, rate, channels, start, stop, pcm, error) -> pa.RecordBatch:
    columns = [pa.array([path]), pa.array([kind], pa.string()), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([start], pa.int64()), pa.array([stop], pa.int64()), registry.lists([pcm], pa.float32()), pa.array([error], registry.ERROR_ARROW)]
    return pa.RecordBatch.from_arrays(columns, ["path", "format", "sample_rate", "channels", "start", "stop", "pcm", "error"])


class PushingFrameReader(FrameReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on stop from below and on start from above are kept; rows with an error have neither, so they go as the filter wants."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("stop",):
                self.start = max(self.start, f.value - isinstance(f, GreaterThanOrEqual))
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("start",):
                self.stop = min(self.stop, f.value + isinstance(f, LessThanOrEqual))
            yield f  # Spark filters the rows as well


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingFrameReader if self.options.get("pushdown") == "true" else FrameReader)(self.options)


def between(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows cut to the frames [start, stop)."""
    low, high = F.greatest("start", F.lit(start)), F.least("stop", F.lit(stop))

    def cut(pcm: str) -> Column:
        return F.slice(pcm, ((low - F.col("start")) * F.col("channels") + 1).cast("int"), ((high - low) * F.col("channels")).cast("int"))

    wanted = rows.filter((F.col("stop") > start) & (F.col("start") < stop))
    return wanted.withColumn("pcm", cut("pcm")).withColumns({"start": low, "stop": high})
