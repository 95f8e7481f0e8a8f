"""Queries that write and read containers: clips of the tables become files of each format and come back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions import pcm
from tonewright.functions.headers import wav_header_write
from tonewright.functions.numeric import part, to_be
from tonewright.operators import framing, packets, predict
from tonewright.plans.catalog import SAMPLES, clips, query, samples, scratch, table
from tonewright.sources import aac, alac, flac, opus, registry, splits, transform, udtf
from tonewright.sources import chunks as chunk_files
from tonewright.sources.bits import BitSink, Bits
from tonewright.streaming.decoders import decode_stream


def with_info(rows: DataFrame, rate: int = 48000, channels: int = 1) -> DataFrame:
    """clip, info, pcm as encode() takes them."""
    return rows.select("clip", F.struct(F.lit(rate).alias("sample_rate"), F.lit(channels).alias("channels")).alias("info"), "pcm")


def encoded(spark, sf_dir, kind: str, option=None, rate: int = 48000, channels: int = 1, gain: float = 1.0) -> DataFrame:
    return registry.encode(with_info(clips(spark, sf_dir, gain), rate, channels), kind, option, keep=("clip",))


def decoded(files: DataFrame, codec: str | None = None) -> DataFrame:
    return registry.decode(files, codec, mode="FAILFAST", keep=("clip",))


def rows_of(found: DataFrame) -> DataFrame:
    return found.select("clip", F.posexplode("pcm").alias("i", "s")).select("clip", "i", F.col("s").cast("double").alias("y"))


UNIT = "greatest(-1::FLOAT, least(1::FLOAT, s))"
BACK = "SELECT clip, i, {}::DOUBLE AS y FROM samples"
I16 = f"(trunc({UNIT} * 32767::FLOAT)::FLOAT / 32768::FLOAT)"
I24 = f"(trunc({UNIT} * 8388607::FLOAT)::FLOAT / 8388608::FLOAT)"
I32 = f"(trunc({UNIT}::DOUBLE * 2147483647::DOUBLE)::FLOAT / 2147483648::FLOAT)"
U8 = f"((trunc(greatest(0::FLOAT, least(255::FLOAT, {UNIT} * 128::FLOAT + 128::FLOAT))) - 128::FLOAT) / 128::FLOAT)"
S8 = f"(trunc({UNIT} * 127::FLOAT) / 128::FLOAT)"
FL16 = f"(trunc({UNIT}::DOUBLE * 32767::DOUBLE) / 32768)::FLOAT"

for _fmt, _sql in (("I8", U8), ("I16", I16), ("I24", I24), ("I32", I32), ("F32", "s")):

    @query("wav_decode" if _fmt == "I16" else f"wav_decode_{_fmt.lower()}", f"WITH {SAMPLES} {BACK.format(_sql)}")
    def wav_decode(spark, sf_dir, fmt=_fmt):
        return rows_of(decoded(encoded(spark, sf_dir, "Wav", fmt)))


for _bits, _sql in ((8, S8), (16, I16), (24, I24), (32, I32)):

    @query("aiff_decode" if _bits == 16 else f"aiff_decode_{_bits}", f"WITH {SAMPLES} {BACK.format(_sql)}")
    def aiff_decode(spark, sf_dir, bits=_bits):
        return rows_of(decoded(encoded(spark, sf_dir, "Aiff", bits)))


SWAP = "string_agg(printf('%02x%02x', u % 256, u // 256), '' ORDER BY i)"
RAW = f"{SAMPLES}, v AS (SELECT clip, i, (trunc({UNIT} * 32767::FLOAT)::BIGINT + 65536) % 65536 AS u FROM samples)"


@query("wav_encode", f"WITH {RAW} SELECT clip, '52494646a400000057415645666d7420100000000100010080bb000000770100020010006461746180000000' || {SWAP} AS raw FROM v GROUP BY clip")
def wav_encode(spark, sf_dir):
    return encoded(spark, sf_dir, "Wav", "I16").select("clip", F.lower(F.hex("content")).alias("raw"))


@query("wav_encode_native", f"WITH {RAW} SELECT clip, '52494646a400000057415645666d7420100000000100010080bb000000770100020010006461746180000000' || {SWAP} AS raw FROM v GROUP BY clip")
def wav_encode_native(spark, sf_dir):
    """The same bytes from projections alone."""
    raw = pcm.raw_bytes(F.col("pcm"), "I16")
    head = wav_header_write(F.octet_length(raw), F.lit(48000), F.lit(1), F.lit(16))
    return clips(spark, sf_dir).select("clip", F.lower(F.hex(F.concat(head, raw))).alias("raw"))


@query("aiff_encode", f"WITH {RAW} SELECT clip, '464f524d000000ae41494646434f4d4d000000120001000000400010400ebb8000000000000053534e44000000880000000000000000' || string_agg(printf('%02x%02x', u // 256, u % 256), '' ORDER BY i) AS raw FROM v GROUP BY clip")
def aiff_encode(spark, sf_dir):
    return encoded(spark, sf_dir, "Aiff", 16).select("clip", F.lower(F.hex("content")).alias("raw"))


@query("flac_decode", f"WITH {SAMPLES} {BACK.format(FL16)}")
def flac_decode(spark, sf_dir):
    return rows_of(decoded(encoded(spark, sf_dir, "Flac", 16)))


@query("flac_decode_stereo", f"WITH {SAMPLES} {BACK.format(FL16)}")
def flac_decode_stereo(spark, sf_dir):
    """Mid and side on the way."""
    return rows_of(decoded(encoded(spark, sf_dir, "Flac", 16, channels=2)))


@query("flac_decode_range", f"WITH {SAMPLES} SELECT clip, (i - 20)::INT AS i, {FL16}::DOUBLE AS y FROM samples WHERE i >= 20 AND i < 40")
def flac_decode_range(spark, sf_dir):
    frames = registry.flac_frames(encoded(spark, sf_dir, "Flac", 16), ("clip",), start=20, end=40)
    return rows_of(registry.decode_flac_frames(frames, 20, 40, ("clip",)))


#: Bits of the cheapest subframe of each clip as one block: 18 for its head and the residual's, warm-up, Rice codes; or verbatim.
ENCODED = f"""WITH {SAMPLES}, q AS (SELECT clip, i, {{quant}} AS v FROM samples),
d AS (SELECT clip, i, v, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2, v - 3 * lag(v) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w AS d3,
  v - 4 * lag(v) OVER w + 6 * lag(v, 2) OVER w - 4 * lag(v, 3) OVER w + lag(v, 4) OVER w AS d4 FROM q WINDOW w AS (PARTITION BY clip ORDER BY i)),
e AS (SELECT clip, unnest([0, 1, 2, 3, 4]) AS ord, unnest([v, d1, d2, d3, d4]) AS d FROM d),
z AS (SELECT clip, ord, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM e WHERE d IS NOT NULL),
t AS (SELECT clip, ord, count(*) AS n, sum(z)::BIGINT // count(*) AS mean FROM z GROUP BY ALL),
k AS (SELECT clip, ord, n, CASE WHEN mean = 0 THEN 0 ELSE least(14, length(bin(mean)) - 1) END AS k FROM t),
c AS (SELECT clip, ord, 18 + 16 * ord + any_value(n) * (1 + any_value(k)) + sum(z // (1 << k::BIGINT))::BIGINT AS bits FROM z JOIN k USING (clip, ord) GROUP BY clip, ord),
m AS (SELECT clip, md5(from_hex(string_agg(printf('%02x%02x', (v + 65536) % 65536 % 256, (v + 65536) % 65536 // 256), '' ORDER BY i))) AS md5, 8 + 16 * count(*) AS verbatim FROM q GROUP BY clip)
SELECT clip, (42 + 7 + 2 + (CASE WHEN verbatim <= min(bits) - 4 THEN verbatim ELSE min(bits) END + 7) // 8)::INT AS size, md5 FROM m JOIN c USING (clip) GROUP BY clip, md5, verbatim"""
QUANT = "trunc(greatest(-1::FLOAT, least(1::FLOAT, s))::DOUBLE * 32767::DOUBLE)::BIGINT"


@query("flac_encode", ENCODED.format(quant=QUANT))
def flac_encode(spark, sf_dir):
    """Bytes of each file, which follow from its cheapest predictor, and the digest of its samples that it carries."""
    files = encoded(spark, sf_dir, "Flac", 16)
    return files.select("clip", F.octet_length("content").alias("size"), F.lower(F.hex(part(F.col("content"), 26, 16))).alias("md5"))


LONG = f"WITH {SAMPLES} SELECT clip // 100 AS clip, ((clip % 100) * 64 + i) // 4096 AS frame_no, ((clip % 100) * 64 + i)::INT AS i, {FL16}::DOUBLE AS y FROM samples"


def long_clips(spark, sf_dir) -> DataFrame:
    """clip, pcm: a hundred clips each, end to end."""
    rows = clips(spark, sf_dir).groupBy(F.floor(F.col("clip") / 100).alias("clip"))
    return rows.agg(F.sort_array(F.collect_list(F.struct(F.col("clip").alias("at"), "pcm"))).alias("all")).select("clip", F.flatten("all.pcm").alias("pcm"))


@query("flac_blocks", LONG)
def flac_blocks(spark, sf_dir):
    """Clips of more than a block, frame by frame."""
    info = F.struct(F.lit(44100).alias("sample_rate"), F.lit(1).alias("channels"))
    files = registry.encode(long_clips(spark, sf_dir).withColumn("info", info), "Flac", 16, keep=("clip",))
    parts = registry.decode_flac_frames(registry.flac_frames(files, ("clip",)), keep=("clip",))
    rows = parts.select("clip", "frame_no", "start", F.posexplode("pcm").alias("k", "s"))
    return rows.select("clip", "frame_no", (F.col("start") + F.col("k")).cast("int").alias("i"), F.col("s").cast("double").alias("y"))


SIZE_CODE = "CASE n WHEN 192 THEN 1 WHEN 576 THEN 2 WHEN 1152 THEN 3 WHEN 2304 THEN 4 WHEN 4608 THEN 5 WHEN 256 THEN 8 WHEN 512 THEN 9 WHEN 1024 THEN 10 WHEN 2048 THEN 11 WHEN 4096 THEN 12 ELSE CASE WHEN n <= 256 THEN 6 ELSE 7 END END"
#: Head, size and place of each frame of the long clips at 48 kHz, and the digest of each clip; under 128 frames a clip.
FRAMES = f"""WITH {SAMPLES}, q AS (SELECT clip // 100 AS clip, ((clip % 100) * 64 + i) // 4096 AS frame_no, (clip % 100) * 64 + i AS i, {QUANT} AS v FROM samples),
d AS (SELECT clip, frame_no, v, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2, v - 3 * lag(v) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w AS d3,
  v - 4 * lag(v) OVER w + 6 * lag(v, 2) OVER w - 4 * lag(v, 3) OVER w + lag(v, 4) OVER w AS d4 FROM q WINDOW w AS (PARTITION BY clip, frame_no ORDER BY i)),
e AS (SELECT clip, frame_no, unnest([0, 1, 2, 3, 4]) AS ord, unnest([v, d1, d2, d3, d4]) AS d FROM d),
z AS (SELECT clip, frame_no, ord, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM e WHERE d IS NOT NULL),
t AS (SELECT clip, frame_no, ord, count(*) AS n, sum(z)::BIGINT // count(*) AS mean FROM z GROUP BY ALL),
k AS (SELECT clip, frame_no, ord, n, CASE WHEN mean = 0 THEN 0 ELSE least(14, length(bin(mean)) - 1) END AS k FROM t),
c AS (SELECT clip, frame_no, ord, 18 + 16 * ord + any_value(n) * (1 + any_value(k)) + sum(z // (1 << k::BIGINT))::BIGINT AS bits FROM z JOIN k USING (clip, frame_no, ord) GROUP BY clip, frame_no, ord),
m AS (SELECT clip, frame_no, min(i) AS start, count(*) AS n FROM q GROUP BY ALL),
b AS (SELECT clip, frame_no, start, n, CASE WHEN 8 + 16 * n <= min(bits) - 4 THEN 8 + 16 * n ELSE min(bits) END AS bits, {SIZE_CODE} AS code FROM m JOIN c USING (clip, frame_no) GROUP BY clip, frame_no, start, n),
h AS (SELECT clip, frame_no, start, n, bits, 'fff8' || printf('%x', code) || 'a08' || printf('%02x', frame_no) || CASE code WHEN 6 THEN printf('%02x', n - 1) WHEN 7 THEN printf('%04x', n - 1) ELSE '' END AS head FROM b),
s AS (SELECT clip, frame_no, start, n, head, length(head) // 2 + 3 + (bits + 7) // 8 AS size FROM h),
f AS (SELECT clip, frame_no, start::BIGINT AS start, n::INT AS block, head, size::INT AS size, (42 + coalesce(sum(size) OVER (PARTITION BY clip ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM s),
g AS (SELECT clip, md5(from_hex(string_agg(printf('%02x%02x', (v + 65536) % 65536 % 256, (v + 65536) % 65536 // 256), '' ORDER BY i))) AS md5 FROM q GROUP BY clip)"""


def pieces(spark, sf_dir) -> DataFrame:
    """The long clips as pieces: a row each clip of theirs."""
    place = F.struct(F.lit(48000).alias("sample_rate"), F.lit(1).alias("channels"))
    rows = clips(spark, sf_dir)
    return rows.select(F.floor(F.col("clip") / 100).alias("clip"), place.alias("info"), (F.col("clip") % 100 * 64).alias("first"), "pcm")


@query("flac_encode_blocks", f"{FRAMES} SELECT clip, (max(f.place + f.size))::INT AS size, md5 FROM f JOIN g USING (clip) GROUP BY clip, md5")
def flac_encode_blocks(spark, sf_dir):
    """Files put together from frames that many tasks packed, none of which holds a clip."""
    parts = framing.blocks(pieces(spark, sf_dir))
    made = framing.files(framing.packed(parts), framing.digests(parts))
    return made.select("clip", F.octet_length("content").alias("size"), F.lower(F.hex(part(F.col("content"), 26, 16))).alias("md5"))


@query("flac_frame_at", f"{FRAMES} SELECT clip, frame_no, place AS \"at\", size FROM f")
def flac_frame_at(spark, sf_dir):
    """Where each frame will stand in its file, before there is one."""
    frames = framing.packed(framing.blocks(pieces(spark, sf_dir)))
    return framing.positions(frames).select("clip", F.col("block").alias("frame_no"), "at", "size")


@query("flac_metadata", "SELECT vec_id AS clip, 0 AS block_no, 0 AS kind, 8 AS at, 34 AS size FROM embeddings")
def flac_metadata(spark, sf_dir):
    udtf.register_all(spark)
    encoded(spark, sf_dir, "Flac", 16).createOrReplaceTempView("_flac_files")
    return spark.sql("SELECT f.clip, b.block_no, b.kind, b.at, b.size FROM _flac_files f, LATERAL flac_blocks(f.content) b")


@query("flac_frame_sync", f"{FRAMES} SELECT clip, frame_no::INT AS frame_no, place::INT AS \"at\", start, block, 0 AS channel_code, 16 AS bits FROM f")
def flac_frame_sync(spark, sf_dir):
    """Frames of clips of more than a block, found in the whole files."""
    udtf.register_all(spark)
    files = registry.encode(with_info(long_clips(spark, sf_dir)), "Flac", 16, keep=("clip",))
    files.createOrReplaceTempView("_flac_files")
    return spark.sql("SELECT f.clip, x.frame_no, x.at, x.start, x.block, x.channel_code, x.bits FROM _flac_files f, LATERAL flac_frames(f.content) x")


def _subframes(rows: DataFrame, f, together: bool) -> DataFrame:
    """clip, i, v: each clip's quantised samples through f (integers to integers), or the clips of a batch together."""

    def run(batches):
        for batch in batches:
            given = [flac.quantise(p.values.to_numpy(zero_copy_only=False), 16) for p in batch.column(1)]
            out = f(given) if together else [f(x) for x in given]
            yield pa.RecordBatch.from_arrays([batch.column(0), registry.lists(out, pa.int64())], ["clip", "v"])

    return rows.select("clip", "pcm").mapInArrow(run, "clip long, v array<bigint>").select("clip", F.posexplode("v").alias("i", "v"))


def _stage(name: str, f, sql: str, together: bool = False):
    @query(name, f"WITH {SAMPLES} {sql}")
    def run(spark, sf_dir):
        return _subframes(clips(spark, sf_dir), f, together)


def _lpc(clips_: list[np.ndarray]) -> list[np.ndarray]:
    """Residuals of a two-tap predictor, restored."""
    taps, shift = np.array([7, -3]), 2
    total = [taps[0] * v[1:-1] + taps[1] * v[:-2] >> shift for v in clips_]
    return flac.restored([flac.Predicted(v[:2], taps, shift, v[2:] - t, 0) for v, t in zip(clips_, total, strict=True)])


def _rice(values: np.ndarray) -> np.ndarray:
    sink = BitSink()
    sink.uint(9, 10)  # method 0, partition order 0, parameter 9
    sink.rice(flac.zigzag(values), 9)
    return flac._residual(Bits(sink.bytes()), len(values), 0)


def _subframe(values: np.ndarray) -> np.ndarray:
    sink = BitSink()
    flac._pack_subframe(sink, values, 16)
    return flac._subframe(Bits(sink.bytes()), len(values), 16)


def _constant(values: np.ndarray) -> np.ndarray:
    sink = BitSink()
    sink.uint(0, 8)
    sink.array(values[:1], 16)
    return flac._subframe(Bits(sink.bytes()), len(values), 16)


def _verbatim(values: np.ndarray) -> np.ndarray:
    sink = BitSink()
    sink.uint(2, 8)
    sink.array(values, 16)
    return flac._subframe(Bits(sink.bytes()), len(values), 16)


def _bits(values: np.ndarray) -> np.ndarray:
    """Coded numbers, unary numbers and fields."""
    sink = BitSink()
    for v in values.tolist():
        sink.coded(v + 40000)
        sink.rice(np.array([abs(v) % 9]), 0)
        sink.uint(v & 0x1FFFF, 17)
    bits = Bits(sink.bytes())
    return np.array([bits.coded() - 40000 + 0 * (bits.unary() + bits.uint(17)) for _ in values])


SAME = f"SELECT clip, i, {QUANT} AS v FROM samples"
_stage("flac_lpc_restore", _lpc, SAME, together=True)
_stage("flac_residual_decode", _rice, SAME)
_stage("flac_subframe", _subframe, SAME)
_stage("flac_verbatim", _verbatim, SAME)
_stage("flac_constant", _constant, f"SELECT clip, i, first_value({QUANT}) OVER (PARTITION BY clip ORDER BY i) AS v FROM samples")
_stage("bit_reader", _bits, SAME)


def _range_coder(values: np.ndarray) -> np.ndarray:
    coder, symbols = opus.RangeEncoder(), (values % 128).tolist()
    for x in symbols:
        coder.encode(x, x + 1, 128)
    decoder = opus.RangeDecoder(coder.finish())
    return np.array([decoder.decode([1] * 128) for _ in symbols])


def _shape(values: np.ndarray) -> np.ndarray:
    """Signs of a packet's bins, read back."""
    packet = opus.pack_frame(np.zeros(0, int), values, 160)
    decoder = opus.RangeDecoder(packet[1:])
    return np.array([decoder.decode([1, 1]) for _ in values])


COOKIE = alac.Config(64, 16, 40, 10, 14, 1, 255, 0, 0, 44100)
TAPS = [160, -190, 170, -130]


def _alac_scalar(values: np.ndarray) -> np.ndarray:
    sink, z = BitSink(), flac.zigzag(values).tolist()
    for x in z:
        alac.write_scalar(sink, x, 9, 20)
    bits = Bits(sink.bytes() + bytes(2))
    return np.array([alac._scalar(bits, (1 << 9) - 1, 9, 20) for _ in z])


def _alac_rice(values: np.ndarray) -> np.ndarray:
    sink = BitSink()
    alac.write_rice_block(sink, values.tolist(), 16, 10, 40, 14)
    return alac.rice_block(Bits(sink.bytes() + bytes(4)), len(values), 16, 10, 40, 14)


def _alac_unfilter(clips_: list[np.ndarray]) -> list[np.ndarray]:
    return alac.restored([alac.Filtered(alac.filtered(v, TAPS, 9, 16), TAPS, 9, 16) for v in clips_])


def _alac_samples(frames: list[bytes]) -> list[np.ndarray]:
    return [np.round(x.astype(float) * 32768).astype(np.int64) for x in alac.decode_frames([(COOKIE, f) for f in frames])]


def _alac_element(clips_: list[np.ndarray]) -> list[np.ndarray]:
    frames = []
    for values in clips_:
        sink = BitSink()
        alac.write_element(sink, [values], COOKIE, TAPS, 9)
        sink.uint(alac.END, 3)
        frames.append(sink.bytes())
    return _alac_samples(frames)


_stage("range_encoder", _range_coder, f"SELECT clip, i, ({QUANT} % 128 + 128) % 128 AS v FROM samples")
_stage("celt_shape", _shape, f"SELECT clip, i, (CASE WHEN {QUANT} >= 0 THEN 1 ELSE 0 END)::BIGINT AS v FROM samples")
_stage("alac_rice", _alac_scalar, f"SELECT clip, i, CASE WHEN {QUANT} >= 0 THEN 2 * {QUANT} ELSE -2 * {QUANT} - 1 END AS v FROM samples")
_stage("alac_rice_block", _alac_rice, SAME)
_stage("alac_unfilter", _alac_unfilter, SAME, together=True)
_stage("alac_element", _alac_element, SAME, together=True)


def _packed(rows: DataFrame, f) -> DataFrame:
    """clip, raw: each clip through f to bytes, as lower-case hex."""

    def run(batches):
        for batch in batches:
            out = [f(p.values.to_numpy(zero_copy_only=False)).hex() for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["clip", "raw"])

    return rows.select("clip", "pcm").mapInArrow(run, "clip long, raw string")


def _twelve_bits(samples_: np.ndarray) -> bytes:
    sink = BitSink()
    sink.array(flac.quantise(samples_, 16) & 0xFFF, 12)
    return sink.bytes()


@query("bit_writer", f"WITH {SAMPLES} SELECT clip, string_agg(printf('%03x', ({QUANT} % 4096 + 4096) % 4096), '' ORDER BY i) AS raw FROM samples GROUP BY clip")
def bit_writer(spark, sf_dir):
    return _packed(clips(spark, sf_dir), _twelve_bits)


def _celt_frame(samples_: np.ndarray) -> bytes:
    bins = transform.mdct_ref(opus.frames_of(samples_, 1) * transform.sine_window(opus.FRAME))
    return opus.pack_frame(opus.energy_symbols(opus.band_energies(bins))[0], bins[0], 160)


@query("celt_frame", "SELECT vec_id AS clip, 'f0' AS toc, 320 AS hex_digits FROM embeddings")
def celt_frame(spark, sf_dir):
    return _packed(clips(spark, sf_dir), _celt_frame).select("clip", F.substring("raw", 1, 2).alias("toc"), F.length("raw").alias("hex_digits"))


def _aac_frame(samples_: np.ndarray) -> bytes:
    bins = aac.spectrum(samples_, 1)
    scales = aac.band_scales(bins)
    return aac.pack_frame(scales[0], aac.quantise(bins, scales)[0], 20)


@query("aac_frame_pack", "SELECT vec_id AS clip, '0018' AS head, true AS whole FROM embeddings")
def aac_frame_pack(spark, sf_dir):
    """The element's head, window and 49 bands, and at least the bytes asked for."""
    raw = _packed(clips(spark, sf_dir), _aac_frame)
    return raw.select("clip", F.substring("raw", 1, 4).alias("head"), (F.length("raw") >= 40).alias("whole"))


@query("flac_frame_pack", f"{FRAMES} SELECT clip, frame_no, place AS \"at\", size, start, block, head FROM f")
def flac_frame_pack(spark, sf_dir):
    """Frames packed with the predictors that the relational stages chose, as a reader finds them in the files: only where both their CRCs close."""
    parts = framing.blocks(pieces(spark, sf_dir))
    frames = framing.packed(parts.join(framing.choices(parts), ["clip", "block"]))
    found = registry.flac_frames(framing.files(frames, framing.digests(parts)), ("clip",))
    head = F.lower(F.hex(part(F.col("raw"), 0, F.col("body") - 1)))
    return found.select("clip", "frame_no", "at", "size", "start", "block", head.alias("head"))


# Ogg, Opus, AAC, MPEG, ALAC


@query("opus_encode", "SELECT vec_id AS clip, 3::BIGINT AS pages, 160::BIGINT AS packet_bytes, 64::BIGINT AS total_samples FROM embeddings")
def opus_encode(spark, sf_dir):
    """Pages of each file, the audio packet's bytes at 64 kbit/s, and its length in frames."""
    udtf.register_all(spark)
    encoded(spark, sf_dir, "Opus", 64000).createOrReplaceTempView("_opus_files")
    pages = spark.sql("SELECT f.clip, p.* FROM _opus_files f, LATERAL ogg_pages(f.content) p")
    last = F.max_by(F.struct("granule", F.octet_length("body").alias("n")), "page_no").alias("last")
    return pages.groupBy("clip").agg(F.count("*").alias("pages"), last).select("clip", "pages", F.col("last.n").cast("long").alias("packet_bytes"), (F.col("last.granule") - 312).alias("total_samples"))


INFO = "SELECT vec_id AS clip, '{f}' AS format, {r} AS sample_rate, {c} AS channels, {b} AS bit_depth, {n}::BIGINT AS total_samples FROM embeddings"


def _info(name, kind, option, rate, channels, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        found = decoded(encoded(spark, sf_dir, kind, option, rate, channels))
        return found.select("clip", "info.format", "info.sample_rate", "info.channels", "info.bit_depth", "info.total_samples")


_info("opus_decode", "Opus", 64000, 48000, 2, INFO.format(f="Opus", r=48000, c=2, b=16, n=32))
_info("ogg_decode", "Opus", 32000, 48000, 1, INFO.format(f="Opus", r=48000, c=1, b=16, n=64))
_info("aac_decode", "Aac", 128000, 44100, 2, INFO.format(f="Aac", r=44100, c=2, b=16, n=1024))


@query("aac_encode", "SELECT vec_id AS clip, 1::BIGINT AS frames, true AS long_enough FROM embeddings")
def aac_encode(spark, sf_dir):
    udtf.register_all(spark)
    encoded(spark, sf_dir, "Aac", 128000, 44100, 2).createOrReplaceTempView("_aac_files")
    rows = spark.sql("SELECT f.clip, x.* FROM _aac_files f, LATERAL adts_frames(f.content) x")
    return rows.groupBy("clip").agg(F.count("*").alias("frames"), (F.min("frame_length") >= 378).alias("long_enough"))


PAGE = "WITH p AS (SELECT conv_id AS stream, turn, octet_length(encode(coalesce(text, ''))) AS size FROM conversations)"


def ogg_files(spark, sf_dir) -> DataFrame:
    """stream, content: a conversation's turns as packets of one stream, each on a page (or more) of its own."""
    from tonewright.sources import ogg

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).cast("binary").alias("packet"))
    grouped = turns.groupBy(F.col("conv_id").alias("stream")).agg(F.sort_array(F.collect_list(F.struct("turn", "packet"))).alias("turns"))

    def run(batches):
        for batch in batches:
            out = [ogg.mux([t["packet"] for t in turns], [1000 * k for k in range(len(turns))], 7) for turns in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["stream", "content"])

    return grouped.mapInArrow(run, "stream long, content binary")


def _pages(spark, sf_dir) -> DataFrame:
    udtf.register_all(spark)
    ogg_files(spark, sf_dir).createOrReplaceTempView("_ogg_files")
    return spark.sql("SELECT f.stream, p.* FROM _ogg_files f, LATERAL ogg_pages(f.content) p")


@query("ogg_pages", f"{PAGE} SELECT stream, count(*) AS pages, (sum(size) + sum(size // 255 + 1) + 27 * count(*))::BIGINT AS bytes FROM p GROUP BY stream")
def ogg_pages(spark, sf_dir):
    size = 27 + F.size("lacing") + F.octet_length("body")
    return _pages(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("pages"), F.sum(size).alias("bytes"))


@query("ogg_page_parse", f"{PAGE} SELECT stream, (row_number() OVER w - 1)::INT AS page_no, (CASE WHEN row_number() OVER w = 1 THEN 2 ELSE 0 END + CASE WHEN count(*) OVER (PARTITION BY stream) = row_number() OVER w THEN 4 ELSE 0 END)::INT AS flags, (1000 * (row_number() OVER w - 1))::BIGINT AS granule, size::INT AS size FROM p WINDOW w AS (PARTITION BY stream ORDER BY turn)")
def ogg_page_parse(spark, sf_dir):
    return _pages(spark, sf_dir).select("stream", "page_no", "flags", "granule", F.octet_length("body").alias("size"))


@query("ogg_extract_packets", "SELECT conv_id AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS packet_no, coalesce(text, '') AS packet FROM conversations")
def ogg_extract_packets(spark, sf_dir):
    found = packets.page_packets(_pages(spark, sf_dir), ("stream",))
    return found.select("stream", "packet_no", F.decode("packet", "UTF-8").alias("packet"))


@query("ogg_build_page", f"{PAGE} SELECT stream, count(*) AS pages, true AS closes FROM p GROUP BY stream")
def ogg_build_page(spark, sf_dir):
    """The CRC of each page built, over its bytes with the field as zeros, by the fold."""
    rows = _pages(spark, sf_dir)
    blank = F.concat(part(F.col("head"), 0, 22), F.lit(bytearray(4)), F.substring("head", 27, 1 << 30), F.col("body"))
    told = F.lower(F.hex(part(F.col("head"), 22, 4)))
    own = predict.crc(blank, 32, 0x04C11DB7)
    back = F.concat(*[F.lower(F.lpad(F.hex(F.shiftright(own, s).bitwiseAND(F.lit(255).cast("long"))), 2, "0")) for s in (0, 8, 16, 24)])
    return rows.groupBy("stream").agg(F.count("*").alias("pages"), F.min(told == back).alias("closes"))


def mpeg_files(spark, sf_dir) -> DataFrame:
    """path, content: junk, then frames of 128 kbit/s at 44.1 kHz; with a tag in front of every second file."""
    frame = F.concat(F.lit(bytearray(b"\xff\xfb\x90\x00")), F.unhex(F.repeat(F.lit("00"), 413)))
    n = (F.col("c_custkey") % 5 + 1).cast("int")
    tag = F.lit(bytearray(b"ID3\3\0\0\0\0\0\4abcd"))
    body = F.unhex(F.repeat(F.hex(frame), n))
    content = F.when(F.col("c_custkey") % 2 == 0, F.concat(tag, body)).otherwise(F.concat(F.lit(bytearray(b"xx")), body))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), content.alias("content"))


@query("mpeg_scan_frames", "SELECT c_custkey AS clip, f::INT AS frame_no, (CASE WHEN c_custkey % 2 = 0 THEN 14 ELSE 2 END + 417 * f)::INT AS at FROM (SELECT c_custkey, unnest(range(c_custkey % 5 + 1)) AS f FROM customer)")
def mpeg_scan_frames(spark, sf_dir):
    udtf.register_all(spark)
    mpeg_files(spark, sf_dir).createOrReplaceTempView("_mpeg_files")
    return spark.sql("SELECT f.clip, x.frame_no, x.at FROM _mpeg_files f, LATERAL mpeg_frames(f.content) x")


@query("mp3_decode", "SELECT c_custkey AS clip, 'Mp3' AS format, 44100 AS sample_rate, 2 AS channels, (1152 * (c_custkey % 5 + 1))::BIGINT AS total_samples, round(1152 * (c_custkey % 5 + 1) / 44100::DOUBLE, 9) AS duration_secs FROM customer")
def mp3_decode(spark, sf_dir):
    found = decoded(mpeg_files(spark, sf_dir), "Mp3")
    return found.select("clip", "info.format", "info.sample_rate", "info.channels", "info.total_samples", F.round("info.duration_secs", 9).alias("duration_secs"))


@query("adts_frames", "SELECT c_custkey AS clip, f::INT AS frame_no, 2 AS channels, (c_custkey % 100 + 8)::INT AS frame_length FROM (SELECT c_custkey, unnest(range(c_custkey % 5 + 1)) AS f FROM customer)")
def adts_frames(spark, sf_dir):
    from tonewright.functions.headers import adts_header_write

    udtf.register_all(spark)
    n = (F.col("c_custkey") % 100 + 1).cast("int")
    frame = F.concat(adts_header_write(F.lit(44100), F.lit(2), n), F.unhex(F.repeat(F.lit("00"), n)))
    content = F.unhex(F.repeat(F.hex(frame), (F.col("c_custkey") % 5 + 1).cast("int")))
    # A cut frame at the end is left out.
    content = F.concat(content, adts_header_write(F.lit(44100), F.lit(2), n))
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), content.alias("content")).createOrReplaceTempView("_adts_files")
    return spark.sql("SELECT f.clip, x.frame_no, x.channels, x.frame_length FROM _adts_files f, LATERAL adts_frames(f.content) x")


def alac_files(spark, sf_dir) -> DataFrame:
    """clip, content: the cookie and a raw frame of each clip, 16 bits, made of projections."""
    cookie = F.concat(to_be(F.lit(64), 4), F.lit(bytearray([0, 16, 40, 10, 14, 1])), to_be(F.lit(255), 2), F.lit(bytearray(8)), to_be(F.lit(44100), 4))
    # Tag 0 and instance 0 (7 bits), 12 unused bits, whole frame, no shift, raw: 23 bits, then samples, then the end tag.
    bits = F.concat(F.lit("0" * 22 + "1"), F.array_join(F.transform("pcm", lambda s: F.lpad(F.bin(F.pmod(predict.quantise(s, 16), F.lit(65536))), 16, "0")), ""), F.lit("111" + "0" * 6))
    octets = F.transform(F.sequence(F.lit(0), F.floor(F.length(bits) / 8).cast("int") - 1), lambda k: F.lpad(F.conv(F.substring(bits, k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return clips(spark, sf_dir).select("clip", F.concat(cookie, F.unhex(F.array_join(octets, ""))).alias("content"))


@query("alac_decode", f"WITH {SAMPLES} SELECT clip, i, ({QUANT} / 32768)::FLOAT::DOUBLE AS y FROM samples")
def alac_decode(spark, sf_dir):
    return rows_of(decoded(alac_files(spark, sf_dir), "Alac"))


@query("alac_decode_frame", f"WITH {SAMPLES} SELECT clip, i, {QUANT} AS v FROM samples")
def alac_decode_frame(spark, sf_dir):
    """A frame with its cookie parsed elsewhere."""

    def run(batches):
        for batch in batches:
            out = _alac_samples([raw[24:] for raw in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), registry.lists(out, pa.int64())], ["clip", "v"])

    return alac_files(spark, sf_dir).mapInArrow(run, "clip long, v array<bigint>").select("clip", F.posexplode("v").alias("i", "v"))


@query("alac_unmix", f"WITH {SAMPLES}, v AS (SELECT clip, i, {QUANT} AS v FROM samples) SELECT l.clip, l.i, l.v AS l, r.v AS r FROM v l JOIN v r ON r.clip = l.clip AND r.i = l.i + 1 WHERE l.i % 2 = 0")
def alac_unmix(spark, sf_dir):
    """Pairs mixed with weight 3 of 4 bits and undone, as projections."""
    rows = samples(spark, sf_dir).withColumn("v", predict.quantise(F.col("s"), 16))
    pair = rows.groupBy("clip", (F.col("i") - F.col("i") % 2).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("b"))
    u, v = unmixed_inputs(F.col("a"), F.col("b"), 3, 2)
    pair = pair.select("clip", "i", u.alias("u"), v.alias("v"))
    left = F.col("u") + F.col("v") - F.shiftright(F.col("v") * 3, 2)
    return pair.select("clip", "i", left.alias("l"), (left - F.col("v")).alias("r"))


def unmixed_inputs(left: Column, right: Column, weight: int, bits: int) -> tuple[Column, Column]:
    v = left - right
    return left - v + F.shiftright(v * weight, bits), v


# Files


def written(spark, sf_dir, kind: str, option=None) -> str:
    """Folder with a file for each clip."""
    where = scratch(spark, kind.lower())
    files = encoded(spark, sf_dir, kind, option).withColumn("clip", F.col("clip").cast("string"))
    registry.write_files(files, where, "clip", f".{kind.lower()}").agg(F.count("*")).collect()
    return where


def _clip() -> Column:
    return F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("clip")


@query("decode_file", f"WITH {SAMPLES} {BACK.format(I16)}")
def decode_file(spark, sf_dir):
    """Files written by the sink and read by Spark's binary reader."""
    found = registry.open_files(spark, written(spark, sf_dir, "Wav", "I16"), "FAILFAST")
    return rows_of(found.select(_clip(), "pcm"))


@query("decode_reader", f"WITH {SAMPLES} {BACK.format(FL16)}")
def decode_reader(spark, sf_dir):
    found = registry.decode(registry.read_files(spark, written(spark, sf_dir, "Flac", 16), "*.flac"), mode="FAILFAST")
    return rows_of(found.select(_clip(), "pcm"))


@query(
    "open",
    """SELECT vec_id AS clip, kind, CASE WHEN kind = 'Junk' THEN NULL WHEN kind = 'Opus' THEN 'Ogg' ELSE kind END AS format, CASE kind WHEN 'Junk' THEN 'UnsupportedFormat' END AS code,
    CASE WHEN kind IN ('Junk') THEN NULL WHEN kind IN ('Opus', 'Aac') THEN 0 ELSE 64 END AS n FROM embeddings, (VALUES ('Wav'), ('Aiff'), ('Flac'), ('Opus'), ('Aac'), ('Junk')) k(kind)""",
)
def open_any(spark, sf_dir):
    """One pass over files of all kinds; what isn't audio becomes an error, not a failure."""
    kinds = {"Wav": "I16", "Aiff": 16, "Flac": 16, "Opus": 64000, "Aac": 128000}
    files = [encoded(spark, sf_dir, k, o).select("clip", F.lit(k).alias("kind"), "content") for k, o in kinds.items()]
    files.append(clips(spark, sf_dir).select("clip", F.lit("Junk").alias("kind"), F.lit(bytearray(b"plain text")).alias("content")))
    both = files[0]
    for f in files[1:]:
        both = both.unionByName(f)
    found = registry.decode(both, keep=("clip", "kind"))
    return found.select("clip", "kind", "format", F.col("error.code").alias("code"), F.when(F.col("pcm").isNotNull(), F.size("pcm")).alias("n"))


@query("decode_file_split", LONG.replace("((clip % 100) * 64 + i) // 4096 AS frame_no, ", ""))
def decode_file_split(spark, sf_dir):
    """FLAC files of more than a block, each read by several tasks."""
    return _frame_rows(_parts_of_long(spark, sf_dir, partitionBytes=4000))


@query("flac_range_pushdown", f"WITH long AS ({LONG}) SELECT clip, i, y FROM long WHERE i >= 4200 AND i < 5000")
def flac_range_pushdown(spark, sf_dir):
    """The range is in the reader's hands (for the session, filters on Python sources are pushed): it opens the bytes that hold it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _frame_rows(splits.between(_parts_of_long(spark, sf_dir, pushdown="true"), 4200, 5000))


def _parts_of_long(spark, sf_dir, **options) -> DataFrame:
    where = scratch(spark, "long")
    info = F.struct(F.lit(44100).alias("sample_rate"), F.lit(1).alias("channels"))
    files = registry.encode(long_clips(spark, sf_dir).withColumn("info", info), "Flac", 16, keep=("clip",)).withColumn("clip", F.col("clip").cast("string"))
    registry.write_files(files, where, "clip", ".flac").agg(F.count("*")).collect()
    spark.dataSource.register(splits.FrameSource)
    return spark.read.format("audio_frames").options(**{k: str(v) for k, v in options.items()}).load(where)


def _frame_rows(rows: DataFrame) -> DataFrame:
    found = rows.select(_clip(), "start", F.posexplode("pcm").alias("k", "s"))
    return found.select("clip", (F.col("start") + F.col("k")).cast("int").alias("i"), F.col("s").cast("double").alias("y"))


@query("codec_trait", "SELECT vec_id AS clip, codec, 64 AS frames FROM embeddings, (VALUES ('Aiff'), ('Flac'), ('Wav')) k(codec)")
def codec_trait(spark, sf_dir):
    """Codecs by name, without a look at the bytes."""
    found = None
    for kind, option in (("Aiff", 16), ("Flac", 16), ("Wav", "I16")):
        rows = decoded(encoded(spark, sf_dir, kind, option), kind).select("clip", F.lit(kind).alias("codec"), F.size("pcm").alias("frames"))
        found = rows if found is None else found.unionByName(rows)
    return found


# Streams


def chunked(files: DataFrame, size: int) -> DataFrame:
    """stream_id, seq, bytes, is_last: files in chunks of a size."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    rows = files.select(F.col("clip").cast("string").alias("stream_id"), "content", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select("stream_id", F.col("seq").cast("long").alias("seq"), F.substring("content", F.col("seq") * size + 1, F.lit(size)).alias("bytes"), (F.col("seq") == F.col("n") - 1).alias("is_last"))


def events_to_rows(events: DataFrame) -> DataFrame:
    """clip, i, y of a stream's sample events in order."""
    parts = events.filter("kind = 'samples'").select("stream_id", "event_no", F.size("pcm").alias("n"), "pcm")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stream_id").orderBy("event_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("before", before).select("stream_id", "before", F.posexplode("pcm").alias("k", "s"))
    return rows.select(F.col("stream_id").cast("long").alias("clip"), (F.col("before") + F.col("k")).cast("int").alias("i"), F.col("s").cast("double").alias("y"))


def streamed(chunks: DataFrame, kind: str, size: int = 0) -> DataFrame:
    """The events that a running query made of the chunks; size in frames, 0 for the usual one."""
    return run_through(put(chunks), kind, size)


def put(chunks: DataFrame) -> DataFrame:
    """The chunks, written out, as a stream."""
    where = scratch(chunks.sparkSession, "chunks")
    chunks.write.parquet(f"{where}/in")
    return chunks.sparkSession.readStream.schema(chunks.schema).parquet(f"{where}/in")


def run_through(stream: DataFrame, kind: str, size: int = 0) -> DataFrame:
    spark, where = stream.sparkSession, scratch(stream.sparkSession, "events")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = decode_stream(stream, kind, size).writeStream.format("parquet").option("checkpointLocation", f"{where}/state")
        run.trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{where}/out")


@query("decode_reader_stream", f"WITH {SAMPLES} {BACK.format(FL16)}")
def decode_reader_stream(spark, sf_dir):
    """Files read as streams of chunks and decoded by a running query."""
    where = written(spark, sf_dir, "Flac", 16)
    spark.dataSource.register(chunk_files.ChunkSource)
    stream = spark.readStream.format("audio_chunks").option("closed", "true").option("chunkBytes", "64").load(where)
    events = run_through(stream, "Flac").withColumn("stream_id", F.regexp_extract("stream_id", r"(\d+)\.\w+$", 1))
    return events_to_rows(events)


@query("stream_wav", f"WITH {SAMPLES} {BACK.format(I16)}")
def stream_wav(spark, sf_dir):
    """Chunks of 50 bytes, events of 10 frames."""
    return events_to_rows(streamed(chunked(encoded(spark, sf_dir, "Wav", "I16"), 50), "Wav", 10))


@query("stream_flac", f"WITH {SAMPLES} {BACK.format(FL16)}")
def stream_flac(spark, sf_dir):
    return events_to_rows(streamed(chunked(encoded(spark, sf_dir, "Flac", 16), 13), "Flac", 10))


@query("stream_aiff", f"WITH {SAMPLES} {BACK.format(I16)}")
def stream_aiff(spark, sf_dir):
    return events_to_rows(streamed(chunked(encoded(spark, sf_dir, "Aiff", 16), 50), "Aiff", 10))


#: Clips of very unlike lengths: (vec_id % 7 + 1) times as many samples.
GROWN = "grown AS (SELECT vec_id AS clip, 64 * (vec_id % 7 + 1) AS n FROM embeddings)"


def grown(spark, sf_dir, kind: str, option) -> DataFrame:
    rows = clips(spark, sf_dir).select("clip", F.flatten(F.array_repeat("pcm", (F.col("clip") % 7 + 1).cast("int"))).alias("pcm"))
    return registry.encode(with_info(rows), kind, option, keep=("clip",))


@query("stream_header_event", f"WITH {GROWN} SELECT clip, 0::BIGINT AS event_no, 'Wav' AS format, 48000 AS sample_rate, 1 AS channels, n::BIGINT AS total_samples FROM grown")
def stream_header_event(spark, sf_dir):
    events = streamed(chunked(grown(spark, sf_dir, "Wav", "I16"), 31), "Wav", 10).filter("kind = 'header'")
    return events.select(F.col("stream_id").cast("long").alias("clip"), "event_no", "info.format", "info.sample_rate", "info.channels", "info.total_samples")


@query("stream_new", f"WITH {GROWN} SELECT clip, size::INT AS size, (2 + ceil(n / CASE WHEN size = 0 THEN 4096 ELSE size END::DOUBLE))::BIGINT AS events FROM grown, (VALUES (0), (7), (64), (1000)) s(size)")
def stream_new(spark, sf_dir):
    """Chunk sizes in frames; 0 stands for 4096."""
    stream = put(chunked(grown(spark, sf_dir, "Aiff", 16), 200))
    found = None
    for size in (0, 7, 64, 1000):
        events = run_through(stream, "Aiff", size).groupBy(F.col("stream_id").cast("long").alias("clip")).agg(F.count("*").alias("events"))
        events = events.select("clip", F.lit(size).alias("size"), "events")
        found = events if found is None else found.unionByName(events)
    return found


@query("stream_format_info", f"WITH {GROWN} SELECT clip, 'Flac' AS format, 48000 AS sample_rate, 1 AS channels, 16 AS bit_depth, n::BIGINT AS total_samples FROM grown")
def stream_format_info(spark, sf_dir):
    events = streamed(chunked(grown(spark, sf_dir, "Flac", 16), 100), "Flac").filter("kind = 'header'")
    return events.select(F.col("stream_id").cast("long").alias("clip"), "info.format", "info.sample_rate", "info.channels", "info.bit_depth", "info.total_samples")


@query("stream_flush", f"WITH {GROWN} SELECT clip, (2 + ceil(n / 10.0))::BIGINT AS events, CASE WHEN n % 10 = 0 THEN 10 ELSE n % 10 END::INT AS last_frames, 'end' AS last_kind FROM grown")
def stream_flush(spark, sf_dir):
    """A header, chunks of ten frames, the partial one, the end."""
    events = streamed(chunked(grown(spark, sf_dir, "Wav", "I16"), 100), "Wav", 10)
    last = F.max_by(F.size("pcm"), F.when(F.col("kind") == "samples", F.col("event_no")))
    return events.groupBy(F.col("stream_id").cast("long").alias("clip")).agg(F.count("*").alias("events"), last.alias("last_frames"), F.max_by("kind", "event_no").alias("last_kind"))
