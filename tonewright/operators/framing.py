"""FLAC encoding by block: the frames of a clip are cut, packed and placed by many tasks, also of clips that stand in many rows.

    parts  = blocks(pieces)                  # one shuffle, by clip and block
    frames = packed(parts)                   # a frame a row, packed where its block is
    whole  = files(frames, digests(parts))   # the bytes that the whole-file encoder gives

pieces have keep, info (sample_rate, channels), first (index of the piece's first frame) and pcm (interleaved). Pieces of a
clip follow one another without gap or overlap in any order of rows; all but the last hold whole frames. A clip without samples (empty or
null) gives a head alone. Samples after the last whole frame count in the digest and in no frame. Wrong parameters are an AudioError.
Other columns than keep are dropped; keep may hold nulls, which are a clip like others. An empty table gives none.

Files over Spark's cell limit go out by `write`, which holds one frame at a time. Only the digest of a clip, which is a fold over all its
samples, and its file are made in order, by one task a clip.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.numeric import joined, text, to_be
from tonewright.operators import predict
from tonewright.sources import flac
from tonewright.sources.errors import AudioError

SPAN = 4096  # frames whose sizes are summed together


def blocks(pieces: DataFrame, keep: tuple[str, ...] = ("clip",), size: int = predict.BLOCK) -> DataFrame:
    """keep, info, block and pcm: the frames [block * size, (block + 1) * size) of a clip, fewer at its end."""
    pcm = F.coalesce(F.col("pcm"), F.array().cast("array<float>"))
    channels = F.greatest(F.col("info.channels"), F.lit(1)).cast("long")
    whole, begin, n = channels * size, F.col("first") * channels, F.size("pcm")
    rows = pieces.select(*keep, "info", "first", pcm.alias("pcm"))
    ends = F.sequence(F.floor(begin / whole), F.floor((begin + F.greatest(n, F.lit(1)) - 1) / whole))
    each = rows.withColumn("block", F.explode(ends))
    low = F.greatest(F.col("block") * whole - begin, F.lit(0))
    high = F.least((F.col("block") + 1) * whole - begin, n)
    cut = each.select(*keep, "info", "block", (begin + low).alias("at"), F.slice("pcm", (low + 1).cast("int"), (high - low).cast("int")).alias("pcm"))
    joined_up = cut.groupBy(*keep, "info", "block").agg(F.sort_array(F.collect_list(F.struct("at", "pcm"))).alias("all"))
    return joined_up.select(*keep, "info", "block", F.flatten("all.pcm").alias("pcm"))


def choices(parts: DataFrame, bits: int = 16) -> DataFrame:
    """clip, block, chosen: predictor order and Rice parameter of each coded channel (null: verbatim), by `predict.best_order` over rows."""
    both = F.col("info.channels") == 2
    rows = parts.select("clip", "block", "info", F.transform("pcm", lambda s: predict.quantise(s, bits)).alias("v"))
    n = F.floor(F.size("v") / F.col("info.channels")).cast("int")
    mid, side = predict.midside(F.get("v", F.col("i") * 2), F.get("v", F.col("i") * 2 + 1))
    plain = F.slice("v", F.col("i") * F.col("info.channels") + 1, F.col("info.channels"))
    frames = rows.filter(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    coded = frames.select("clip", "block", "i", F.posexplode(F.when(both, F.array(mid, side)).otherwise(plain)).alias("ch", "v"), both.alias("both"))
    depth = bits + F.when(F.col("both") & (F.col("ch") == 1), 1).otherwise(0)
    wide = coded.withColumn("ch", F.struct("ch", depth.alias("depth")))
    best = predict.best_order(wide, F.col("ch.depth"))
    picked = F.when(F.col("subframe") == "fixed", F.struct(F.col("ord").cast("int").alias("ord"), F.col("k").cast("int").alias("k")))
    listed = F.sort_array(F.collect_list(F.struct(F.col("ch.ch").alias("ch"), picked.alias("p"))))
    return best.groupBy("clip", "block").agg(listed.alias("all")).select("clip", "block", F.col("all.p").alias("chosen"))


def _given(p: dict | None) -> Callable:
    def chosen(values: np.ndarray, bits: int):
        return None if p is None else (p["ord"], p["k"], flac.zigzag(np.diff(values, n=p["ord"])), 0)

    return chosen


def packed(parts: DataFrame, bits: int = 16, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep, info, block, n (samples a channel), size (bytes) and raw: a frame a block, where the block is. n is 0 and raw empty without a whole one.

    A column `chosen`, as `choices` gives it, sets the predictors; else each task picks them.
    """
    ready = "chosen" in parts.columns
    rows = parts.select(*keep, "info", "block", "pcm", *(["chosen"] if ready else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            picks = batch.column("chosen").to_pylist() if ready else [None] * batch.num_rows
            for info, number, pcm, pick in zip(batch.column("info").to_pylist(), batch.column("block").to_pylist(), batch.column("pcm"), picks, strict=True):
                rate, channels = info["sample_rate"], info["channels"]
                flac.check_params(rate, channels, bits)
                values = flac.quantise(pcm.values.to_numpy(zero_copy_only=False), bits)
                n = len(values) // channels
                how = None if pick is None else [_given(p) for p in pick]
                counts.append(n)
                out.append(flac.pack_frame(values[: n * channels].reshape(n, channels), rate, bits, number, how) if n else b"")
            own = [batch.column(c) for c in (*keep, "info", "block")]
            sizes = pa.array([len(x) for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int32()), sizes, pa.array(out, pa.binary())], [*keep, "info", "block", "n", "size", "raw"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (*keep, "info", "block")) + ", n int, size int, raw binary")


def positions(frames: DataFrame, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep, block, n, size and at, the frame's offset in its file: running sums within spans of frames, then over the spans of a clip."""
    rows = frames.filter("n > 0").select(*keep, "block", "n", "size", F.floor(F.col("block") / SPAN).alias("_span"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keep, "_span").agg(F.sum("size").alias("_sum"))
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in keep], F.col("_span").alias("_s"), F.coalesce(F.sum("_sum").over(before.partitionBy(*keep).orderBy("_span")), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("size").over(before.partitionBy(*keep, "_span").orderBy("block")), F.lit(0))
    same = F.col("_span") == F.col("_s")
    for c in keep:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.withColumn("_in", inner).join(spans, same).select(*keep, "block", "n", "size", (F.lit(len(flac.stream_head(1, 1, 16, 0, [], bytes(16)))) + F.col("_base") + F.col("_in")).alias("at"))


def _in_order(rows: DataFrame, keep: tuple[str, ...], value: str, fold: Callable[[tuple, Iterator], tuple], made: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """keep and what fold makes of a clip's values in the order of blocks, read one after another. A task holds what fold holds."""
    ordered = rows.select(*keep, "block", value).repartition(*keep).sortWithinPartitions(*keep, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def stream() -> Iterator[tuple[tuple, object]]:
            for batch in batches:
                kinds[:] = [batch.column(c).type for c in keep]
                yield from zip(zip(*[batch.column(c).to_pylist() for c in keep], strict=True), batch.column(value), strict=True)

        for key, group in groupby(stream(), itemgetter(0)):
            own = fold(key, (v for _, v in group))
            yield pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, kinds, strict=True)], *[pa.array([x], t) for x, (_, _, t) in zip(own, made, strict=True)]], [*keep, *[n for n, _, _ in made]])

    types = dict(rows.dtypes)
    return ordered.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{n} {t}" for n, t, _ in made]]))


def digests(parts: DataFrame, bits: int = 16, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep and md5 of each clip's samples, block after block."""

    def fold(key: tuple, values: Iterator) -> tuple:
        state, width = hashlib.md5(), (bits + 7) // 8
        for pcm in values:
            v = flac.quantise(pcm.values.to_numpy(zero_copy_only=False), bits)
            state.update(v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        return (state.digest(),)

    return _in_order(parts, keep, "pcm", fold, [("md5", "binary", pa.binary())])


def heads(frames: DataFrame, md5: DataFrame, bits: int = 16, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep and head: magic and STREAMINFO, from narrow columns of the frames."""
    some = F.when(F.col("n") > 0, F.col("size"))
    sums = frames.groupBy(*keep, "info").agg(F.sum("n").cast("long").alias("n"), *[F.coalesce(f(some), F.lit(0)).alias(f.__name__) for f in (F.min, F.max)])
    same = F.lit(True)
    for c in keep:
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}"))
    rows = sums.alias("s").join(md5.alias("m"), same)
    block = to_be(F.greatest(F.lit(1), F.least(F.lit(predict.BLOCK), F.col("n"))), 2)
    parts = F.shiftleft(F.col("info.sample_rate").cast("long"), 44), F.shiftleft((F.col("info.channels") - 1).cast("long"), 41), F.lit((bits - 1) << 36), F.col("n")
    word = parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])
    raw = joined(text("fLaC\x80\0\0\x22"), block, block, to_be(F.col("min"), 3), to_be(F.col("max"), 3), to_be(word, 8), F.col("md5"))
    return rows.select(*[F.col(f"s.{c}").alias(c) for c in keep], raw.alias("head"))


def _with_heads(frames: DataFrame, head: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return head.select(*keep, F.lit(-1).cast("long").alias("block"), F.col("head").alias("raw")).unionByName(frames.select(*keep, "block", "raw"))


def files(frames: DataFrame, md5: DataFrame, bits: int = 16, keep: tuple[str, ...] = ("clip",)) -> DataFrame:
    """keep and content: whole files, each a cell (2 GB at most). frames is read twice; a table if packing should run once."""

    def fold(key: tuple, values: Iterator) -> tuple:
        return (b"".join(v.as_py() for v in values),)

    return _in_order(_with_heads(frames, heads(frames, md5, bits, keep), keep), keep, "raw", fold, [("content", "binary", pa.binary())])


def write(frames: DataFrame, head: DataFrame, where: str, keep: tuple[str, ...] = ("clip",), suffix: str = ".flac") -> DataFrame:
    """keep, path and length of files of any length, written frame by frame under where as the result is read. The name is the first of keep.

    A file is written under a name of its attempt and moved into place when whole, so a repeated task leaves one file. Names must be unique
    and stay in the folder: a null, empty or "." one, or one with a slash, is an AudioError.
    """

    def fold(key: tuple, values: Iterator) -> tuple:
        import uuid

        from pyarrow import fs as pafs

        title = "" if key[0] is None else str(key[0])
        if not title or "/" in title or "\\" in title or title in (".", ".."):
            raise AudioError("EncodeError", f"no name for a file: {title!r}")
        store, root = pafs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        path, attempt, length = f"{root}/{title}{suffix}", f"{root}/_{uuid.uuid4().hex}", 0
        with store.open_output_stream(attempt, compression=None) as out:
            for v in values:
                raw = v.as_py()
                out.write(raw)
                length += len(raw)
        store.move(attempt, path)
        return path, length

    return _in_order(_with_heads(frames, head, keep), keep, "raw", fold, [("path", "string", pa.string()), ("length", "long", pa.int64())])
