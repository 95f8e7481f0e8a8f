"""Audio files as DataFrames: detection, decoding by registered codecs, encoding, writing.

    files = read_files(spark, "/corpus/*.flac")       # path, length, content
    clips = decode(files)                             # path, format, info, pcm, error
    sink  = write_files(encode(clips, "Wav"), "/out")

`decode` is one Arrow pass over whole files; `flac_frames` and `decode_flac_frames` spread the frames
of long files over tasks. A file that can't be decoded gives an error column ("PERMISSIVE", the
default) or stops the job ("FAILFAST"). Files over spark.sql.sources.binaryFile.maxLength are an
error of Spark's reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions.headers import detect_format
from tonewright.sources import aac, aiff, alac, flac, mpeg, ogg, opus, wav
from tonewright.sources.errors import AudioError, bad_header
from tonewright.sources.info import ERROR_TYPE, INFO_TYPE, Decoded

DECODERS: dict[str, Callable[[bytes], Decoded]] = {
    "Wav": wav.decode,
    "Flac": flac.decode,
    "Ogg": ogg.decode,
    "Aiff": aiff.decode,
    "Mp3": mpeg.decode,
    "Opus": opus.decode,
    "Aac": aac.decode,
    "Alac": alac.decode,
}
#: Codecs whose files are decoded together, a batch at a time; each gives samples or an AudioError for each file.
TOGETHER: dict[str, Callable[[list[bytes]], list[Decoded | AudioError]]] = {"Alac": alac.decode_all}
#: Formats that detection names.
OPENED = ("Wav", "Flac", "Ogg", "Aiff", "Mp3", "Aac")
ENCODERS: dict[str, Callable[..., bytes]] = {
    "Wav": wav.encode,
    "Aiff": aiff.encode,
    "Flac": flac.encode,
    "Opus": opus.encode,
    "Aac": aac.encode,
}
INFO_ARROW = pa.struct([("format", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bit_depth", pa.int32()), ("duration_secs", pa.float64()), ("total_samples", pa.int64())])
ERROR_ARROW = pa.struct([("code", pa.string()), ("detail", pa.string())])


def register(name: str, decoder: Callable[[bytes], Decoded]) -> None:
    """Adds a codec for decode(codec=name)."""
    DECODERS[name] = decoder
    TOGETHER.pop(name, None)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def detected(files: DataFrame) -> DataFrame:
    """Adds format; reads content but runs no Python."""
    return files.withColumn("format", detect_format(F.col("content")))


MOST_VALUES = (1 << 31) - 1  # of a list column's 32-bit offsets


def lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """Arrays as one list column without a Python object for each value."""
    sizes = [0 if a is None else len(a) for a in arrays]
    if sum(sizes) > MOST_VALUES:
        raise AudioError("DecodeError", f"{sum(sizes)} samples in a batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0)])
    mask = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind), mask=mask)


def parts_of(batches: Iterator[pa.RecordBatch], most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about so many bytes of content, at least one row, so that few files are decoded at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)


def decode(files: DataFrame, codec: str | None = None, mode: str = "PERMISSIVE", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, format, info, pcm and error of files (content); codec overrides detection."""
    decoders, together = dict(DECODERS), dict(TOGETHER)
    named = detected(files) if codec is None else files.withColumn("format", F.lit(codec))
    rows = named.select(*keep, "format", "content")
    strict = mode == "FAILFAST"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            infos, pcm, errors = [], [], []
            names, files = batch.column("format").to_pylist(), [x or b"" for x in batch.column("content").to_pylist()]
            ready = {k: iter(f([x for n, x in zip(names, files, strict=True) if n == k])) for k, f in together.items() if k in names}
            for name, data in zip(names, files, strict=True):
                try:
                    if name not in decoders:
                        raise AudioError("UnsupportedFormat") if len(data) >= 4 else bad_header("too short for format detection")
                    got = next(ready[name]) if name in ready else decoders[name](data)
                    if isinstance(got, AudioError):
                        raise got
                    found, samples = got
                    infos.append(dict(zip(INFO_ARROW.names, found.row(), strict=True)))
                    pcm.append(samples)
                    errors.append(None)
                except AudioError as e:
                    if strict:
                        raise
                    infos.append(None)
                    pcm.append(None)
                    errors.append({"code": e.code, "detail": e.detail})
            kept = [batch.column(c) for c in (*keep, "format")]
            columns = [*kept, pa.array(infos, INFO_ARROW), lists(pcm, pa.float32()), pa.array(errors, ERROR_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "format", "info", "pcm", "error"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keep, "format"))
    return rows.mapInArrow(run, f"{schema}, info {INFO_TYPE}, pcm array<float>, error {ERROR_TYPE}")


def open_files(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return decode(read_files(spark, path), mode=mode)


def encode(clips: DataFrame, target: str, option: str | int | None = None, mode: str = "FAILFAST", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, content and error of clips (info, pcm); option is the sample format, bit depth or bit rate."""
    encoder, strict = ENCODERS[target], mode == "FAILFAST"
    rows = clips.select(*keep, F.col("info.sample_rate").alias("_rate"), F.col("info.channels").alias("_channels"), "pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for rate, channels, pcm in zip(batch.column("_rate").to_pylist(), batch.column("_channels").to_pylist(), batch.column("pcm"), strict=True):
                try:
                    samples = np.zeros(0, np.float32) if pcm.values is None else pcm.values.to_numpy(zero_copy_only=False)
                    content.append(encoder(samples, rate, channels, *([] if option is None else [option])))
                    errors.append(None)
                except AudioError as e:
                    if strict:
                        raise
                    content.append(None)
                    errors.append({"code": e.code, "detail": e.detail})
            columns = [*[batch.column(c) for c in keep], pa.array(content, pa.binary()), pa.array(errors, ERROR_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "content", "error"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", content binary, error {ERROR_TYPE}")


def write_files(files: DataFrame, where: str, name: str = "path", suffix: str = "") -> DataFrame:
    """Writes content under where/name and returns path and bytes of what it wrote. Runs when the result is read.

    Files are written under a name of the attempt and moved into place, so repeated tasks leave whole files. A name that would leave the folder is an
    error; of rows of one name the last written stays (the sink of `writer` keeps them apart).
    """
    rows = files.select(F.col(name).cast("string").alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for title, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not title or "/" in title or "\\" in title or title in (".", ".."):
                    raise AudioError("EncodeError", f"no name for a file: {title!r}")
                path, part = f"{root}/{title}{suffix}", f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(raw or b"")
                store.move(part, path)
                paths.append(path)
                sizes.append(len(raw or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

    return rows.mapInArrow(run, "path string, length long")


# Long FLAC files: an index row for each frame, then each frame for itself.

FRAME_ARROW = [("frame_no", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("start", pa.int64()), ("block", pa.int32()), ("channel_code", pa.int32()), ("bits", pa.int32()), ("body", pa.int32()), ("raw", pa.binary()), ("head", pa.binary())]
FRAME_TYPE = "frame_no long, at long, size long, start long, block int, channel_code int, bits int, body int, raw binary, head binary"


def flac_frames(files: DataFrame, keep: tuple[str, ...] = ("path",), with_bytes: bool = True, start: int = 0, end: int | None = None) -> DataFrame:
    """A row for each frame of FLAC files: its number in the stream, where it stands, which samples it holds, its bytes and the STREAMINFO.

    With start or end only frames that hold samples of [start, end): the search begins at a seek point and ends at end.
    """
    rows = files.select(*keep, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("content")):
                data = raw.as_py()
                meta = flac.metadata(data)
                block = next(b for b in meta.blocks if b[0] == 0)
                head = data[block[1] : block[1] + 34]
                found = [f for f in flac.index(data, meta, flac.seek(meta, start), end=end) if f.start + f.block > start]
                out = [(f.number, f.at, f.size, f.start, f.block, f.channel_code, f.bits, f.body, data[f.at : f.at + f.size] if with_bytes else None, head) for f in found]
                own = [pa.array([batch.column(c)[i].as_py()] * len(out), batch.column(c).type) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([x[j] for x in out], t) for j, (_, t) in enumerate(FRAME_ARROW)]], [*keep, *[n for n, _ in FRAME_ARROW]])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {FRAME_TYPE}")


def decode_flac_frames(frames: DataFrame, start: int = 0, end: int | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, frame_no, start and pcm (interleaved) of the frames that overlap [start, end), trimmed to it.

    The filter is on index rows, so frames outside are not decoded.
    """
    wanted = frames.filter(F.col("start") + F.col("block") > start)
    wanted = wanted if end is None else wanted.filter(F.col("start") < end)
    rows = wanted.select(*keep, *[n for n, _ in FRAME_ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm, firsts, found = [], [], batch.select([n for n, _ in FRAME_ARROW]).to_pylist()
            own = [flac.Frame(r["frame_no"], 0, r["size"], r["start"], r["block"], r["channel_code"], r["bits"], r["body"]) for r in found]
            values = flac.decode_frames([(r["raw"], f) for r, f in zip(found, own, strict=True)])
            for row, frame, x in zip(found, own, values, strict=True):
                low = max(0, start - frame.start)
                high = frame.block if end is None else min(frame.block, end - frame.start)
                pcm.append(flac.scaled(x[low:high], flac.streaminfo(row["head"]).bits).ravel())
                firsts.append(frame.start + low)
            columns = [*[batch.column(c) for c in (*keep, "frame_no")], pa.array(firsts, pa.int64()), lists(pcm, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "frame_no", "start", "pcm"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", frame_no long, start long, pcm array<float>")
