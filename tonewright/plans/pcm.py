"""Queries over sample conversions, resampling and dither."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewright.functions import pcm
from tonewright.functions.numeric import sign_extend
from tonewright.operators import dither, resample
from tonewright.plans.catalog import INTS, LOUD, SAMPLES, UNIT, byte_at, clips, ints, listed, query, samples, table


def _from_float(name, convert, sql):
    @query(name, f"WITH {LOUD} SELECT clip, i, {sql} AS y FROM samples")
    def run(spark, sf_dir):
        return samples(spark, sf_dir, 4.0).select("clip", "i", convert(F.col("s")).alias("y"))


_from_float("pcm_f32_to_i16", pcm.f32_to_i16, f"trunc({UNIT} * 32767::FLOAT)::SMALLINT")
_from_float("pcm_f32_to_i24", pcm.f32_to_i24, f"trunc({UNIT} * 8388607::FLOAT)::INT")
_from_float("pcm_f32_to_i32", pcm.f32_to_i32, f"trunc({UNIT}::DOUBLE * 2147483647::DOUBLE)::INT")
_from_float("pcm_f32_to_u8", pcm.f32_to_u8, f"trunc(greatest(0::FLOAT, least(255::FLOAT, {UNIT} * 128::FLOAT + 128::FLOAT)))::INT")
_from_float("pcm_f32_to_f64", pcm.f32_to_f64, "s::DOUBLE")


def _from_int(name, convert, sql):
    @query(name, f"WITH {INTS} SELECT k, n, ({sql})::DOUBLE AS y FROM ints")
    def run(spark, sf_dir):
        return ints(spark, sf_dir).select("k", "n", convert().cast("double").alias("y"))


_from_int("pcm_i16_to_f32", lambda: pcm.i16_to_f32(F.col("a").cast("smallint")), "a::FLOAT / 32768::FLOAT")
_from_int("pcm_i32_to_f32", lambda: pcm.i32_to_f32(F.col("b").cast("int")), "b::FLOAT / 2147483648::FLOAT")
_from_int(
    "pcm_i24_to_f32",
    lambda: pcm.i24_to_f32(F.pmod("b", F.lit(16777216))),
    "((CASE WHEN (b % 16777216 + 16777216) % 16777216 >= 8388608 THEN (b % 16777216 + 16777216) % 16777216 - 16777216 ELSE (b % 16777216 + 16777216) % 16777216 END)::FLOAT / 8388608::FLOAT)",
)
_from_int("pcm_u8_to_f32", lambda: pcm.u8_to_f32(F.pmod("a", F.lit(256))), "(((a % 256 + 256) % 256)::FLOAT - 128::FLOAT) / 128::FLOAT")
_from_int("pcm_f64_to_f32", lambda: pcm.f64_to_f32(F.col("b").cast("double") / 3.0), "(b::DOUBLE / 3::DOUBLE)::FLOAT")


@query(
    "pcm_i24_packed_to_f32",
    f"""WITH b AS (SELECT item_id AS clip, encode(text) AS t, unnest(range(octet_length(encode(text)) // 3))::INT AS i FROM benchmark),
    v AS (SELECT clip, i, {byte_at("t", "3 * i")} + {byte_at("t", "3 * i + 1")} * 256 + {byte_at("t", "3 * i + 2")} * 65536 AS u FROM b)
    SELECT clip, i, ((CASE WHEN u >= 8388608 THEN u - 16777216 ELSE u END)::FLOAT / 8388608::FLOAT)::DOUBLE AS y FROM v""",
)
def pcm_i24_packed_to_f32(spark, sf_dir):
    """Bytes of texts as packed samples."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip"), pcm.i24_packed_to_f32(F.col("text").cast("binary")).alias("pcm"))
    return listed(rows)


@query(
    "pcm_f32_to_i24_packed",
    f"""WITH {LOUD}, v AS (SELECT clip, i, (trunc({UNIT} * 8388607::FLOAT)::BIGINT + 16777216) % 16777216 AS u FROM samples)
    SELECT clip, string_agg(printf('%02x%02x%02x', u % 256, u // 256 % 256, u // 65536), '' ORDER BY i) AS packed FROM v GROUP BY clip""",
)
def pcm_f32_to_i24_packed(spark, sf_dir):
    return clips(spark, sf_dir, 4.0).select("clip", F.lower(F.hex(pcm.f32_to_i24_packed(F.col("pcm")))).alias("packed"))


@query("pcm_interleave", f"WITH {SAMPLES} SELECT clip, (i % 32 * 2 + i // 32)::INT AS i, s::DOUBLE AS y FROM samples")
def pcm_interleave(spark, sf_dir):
    """Halves of a clip as planes."""
    planes = F.array(F.slice("pcm", 1, 32), F.slice("pcm", 33, 32))
    return listed(clips(spark, sf_dir).select("clip", planes.alias("planes")).select("clip", pcm.interleave(F.col("planes")).alias("pcm")))


@query("pcm_deinterleave", f"WITH {SAMPLES} SELECT clip, (i % 3)::INT AS ch, (i // 3)::INT AS i, s::DOUBLE AS y FROM samples WHERE i < 63")
def pcm_deinterleave(spark, sf_dir):
    """Three channels: the last sample is a partial frame."""
    planes = clips(spark, sf_dir).select("clip", F.posexplode(pcm.deinterleave(F.col("pcm"), F.lit(3))).alias("ch", "plane"))
    return planes.select("clip", "ch", F.posexplode("plane").alias("i", "y")).withColumn("y", F.col("y").cast("double"))


FORMATS_SQL = "(VALUES (0, 'I8', 1, 8), (1, 'I16', 2, 16), (2, 'I24', 3, 24), (3, 'I32', 4, 32), (4, 'F32', 4, 32), (5, 'F64', 8, 64)) f(no, fmt, bytes, bits)"


def _formats(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in pcm.FORMATS])
    return table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 6).cast("int")).alias("fmt"))


@query("pcm_bytes_per_sample", f"SELECT p_partkey, fmt, bytes FROM part JOIN {FORMATS_SQL} ON no = p_partkey % 6")
def pcm_bytes_per_sample(spark, sf_dir):
    return _formats(spark, sf_dir).select("p_partkey", "fmt", pcm.bytes_per_sample(F.col("fmt")).alias("bytes"))


@query("pcm_bit_depth", f"SELECT p_partkey, fmt, bits FROM part JOIN {FORMATS_SQL} ON no = p_partkey % 6")
def pcm_bit_depth(spark, sf_dir):
    return _formats(spark, sf_dir).select("p_partkey", "fmt", pcm.bit_depth(F.col("fmt")).alias("bits"))


@query("sign_extend", f"WITH {INTS} SELECT k, n, CASE WHEN (a + 32768) % 4096 >= 2048 THEN (a + 32768) % 4096 - 4096 ELSE (a + 32768) % 4096 END AS y FROM ints")
def sign_extend_12(spark, sf_dir):
    return ints(spark, sf_dir).select("k", "n", sign_extend(F.col("a"), 12).alias("y"))


def sinc_sql(x: str, h: str) -> str:
    window = " ".join(f"{sign} {c} * cos({m} * pi() * (({x}) / {h} + 1))" for sign, c, m in (("-", 0.48829, "1"), ("+", 0.14128, "2"), ("-", 0.01168, "3")))
    return f"CASE WHEN abs({x}) < 1e-10 THEN 1.0::DOUBLE WHEN abs({x}) > {h} THEN 0.0::DOUBLE ELSE sin(pi() * ({x})) / (pi() * ({x})) * (0.35875 {window}) END"


def resample_sql(src: int, dst: int, quality: str, frames: int, channels: int, out: str) -> str:
    scale, h = resample.reach(src, dst, quality)
    return f"""WITH {SAMPLES}, planes AS (SELECT clip, i % {channels} AS ch, i // {channels} AS f, s FROM samples),
    taps AS (SELECT o, t, o * {src} // {dst} + t AS f, {sinc_sql(f"((t - (o * {src} % {dst}) / {dst}::DOUBLE) * {scale!r}::DOUBLE)", f"{h}::DOUBLE")} AS w
      FROM (SELECT unnest(range({-(-frames * dst // src)})) AS o), (SELECT unnest(range({-h}, {h + 1})) AS t)),
    sums AS (SELECT clip, ch, o, sum(s::DOUBLE * w) AS total, sum(w) AS weight FROM planes JOIN taps USING (f) GROUP BY ALL)
    {out}"""


ARRAYS_OUT = "SELECT clip, (o * {n} + ch)::INT AS i, (CASE WHEN abs(weight) > 1e-10 THEN total / weight ELSE 0 END)::FLOAT::DOUBLE AS y FROM sums"
ROWS_OUT = "SELECT clip, ch::INT AS ch, o::BIGINT AS frame, round(CASE WHEN abs(weight) > 1e-10 THEN total / weight ELSE 0 END, 6) AS y FROM sums"


@query("resample", resample_sql(44100, 48000, "Good", 64, 1, ARRAYS_OUT.format(n=1)))
def resample_up(spark, sf_dir):
    return listed(resample.resample(clips(spark, sf_dir), 44100, 48000, "Good"))


@query("resample_stereo_down", resample_sql(48000, 32000, "Best", 32, 2, ARRAYS_OUT.format(n=2)))
def resample_stereo_down(spark, sf_dir):
    return listed(resample.resample(clips(spark, sf_dir), 48000, 32000, "Best", channels=2))


@query("resample_draft", resample_sql(48000, 44100, "Draft", 64, 1, ARRAYS_OUT.format(n=1)))
def resample_draft(spark, sf_dir):
    return listed(resample.resample(clips(spark, sf_dir), 48000, 44100, "Draft"))


LONG_OUT = "SELECT clip, o::INT AS i, (CASE WHEN abs(weight) > 1e-10 THEN total / weight ELSE 0 END)::FLOAT::DOUBLE AS y FROM sums JOIN (SELECT clip, max(f) + 1 AS n FROM planes GROUP BY clip) USING (clip) WHERE o * 44100 < n * 48000"
LONG_SQL = resample_sql(44100, 48000, "Good", 6400, 1, LONG_OUT).replace("SELECT clip, i % 1 AS ch, i // 1 AS f, s", "SELECT clip // 100 AS clip, 0 AS ch, clip % 100 * 64 + i AS f, s")


@query("resample_pieces", LONG_SQL)
def resample_pieces(spark, sf_dir):
    """A hundred clips end to end, a row each, in blocks of 1,000 frames that lend one another their edges."""
    rows = clips(spark, sf_dir).select(F.floor(F.col("clip") / 100).alias("clip"), (F.col("clip") % 100 * 64).alias("first"), "pcm")
    found = resample.resample_pieces(rows, 44100, 48000, "Good", size=1000)
    each = found.select("clip", "first", F.posexplode("pcm").alias("k", "s"))
    return each.select("clip", (F.col("first") + F.col("k")).cast("int").alias("i"), F.col("s").cast("double").alias("y"))


@query("resample_mono", resample_sql(44100, 48000, "Good", 64, 1, ROWS_OUT))
def resample_mono(spark, sf_dir):
    rows = samples(spark, sf_dir).select("clip", F.lit(0).alias("ch"), F.col("i").alias("frame"), "s")
    return resample.resample_rows(rows, 44100, 48000, "Good").select("clip", "ch", "frame", F.round("s", 6).alias("y"))


@query("windowed_sinc", f"SELECT o_orderkey, round({sinc_sql('((o_orderkey % 2001 - 1000) / 100::DOUBLE)', '8::DOUBLE')}, 9) AS w FROM orders")
def windowed_sinc(spark, sf_dir):
    x = (F.col("o_orderkey") % 2001 - 1000) / 100.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(resample.windowed_sinc(x, 8), 9).alias("w"))


@query(
    "resample_quality",
    """WITH o AS (SELECT o_orderkey, (['Draft', 'Good', 'Best'])[(o_orderkey % 3 + 1)::INT] AS quality, (8000 + 100 * (o_orderkey % 1841))::INT AS src, (8000 + 100 * (o_custkey % 1841))::INT AS dst FROM orders)
    SELECT *, ceil((CASE quality WHEN 'Draft' THEN 2 WHEN 'Good' THEN 8 ELSE 32 END) / least(1.0::DOUBLE, dst::DOUBLE / src))::INT AS taps FROM o""",
)
def resample_quality(spark, sf_dir):
    """Taps to a side for rates and qualities of orders."""
    quality = F.get(F.array(*map(F.lit, resample.HALF_WIDTH)), (F.col("o_orderkey") % 3).cast("int"))
    rate = lambda c: (8000 + 100 * (F.col(c) % 1841)).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", quality.alias("quality"), rate("o_orderkey").alias("src"), rate("o_custkey").alias("dst"))
    return rows.withColumn("taps", resample.taps_of(F.col("src"), F.col("dst"), F.col("quality")))


@query("weighted_sum", f"WITH {SAMPLES}, w AS (SELECT clip, s, {sinc_sql('((i - 32) / 4::DOUBLE)', '8::DOUBLE')} AS w FROM samples) SELECT clip, round(sum(s::DOUBLE * w), 6) AS total, round(sum(w), 6) AS weight FROM w GROUP BY clip")
def weighted_sum(spark, sf_dir):
    rows = samples(spark, sf_dir).select("clip", "s", resample.windowed_sinc((F.col("i") - 32) / 4.0, 8).alias("w"))
    return resample.weighted_sum(rows, ["clip"]).select("clip", F.round("total", 6).alias("total"), F.round("weight", 6).alias("weight"))


STATES = """RECURSIVE x1 AS (SELECT 0 AS n, 305419896::BIGINT AS x UNION ALL
      SELECT n + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT n, xor(b, b >> 17) AS c FROM (SELECT n, xor(x, (x << 13) & 4294967295) AS b FROM x1 WHERE n < 128)))"""
NOISE = """noise AS (SELECT a.n // 2 AS i, ((a.x::FLOAT / 4294967295::FLOAT * 2::FLOAT - 1::FLOAT) + (b.x::FLOAT / 4294967295::FLOAT * 2::FLOAT - 1::FLOAT)) * 0.5::FLOAT AS d
      FROM x1 a JOIN x1 b ON b.n = a.n + 1 WHERE a.n % 2 = 1)"""


@query("xorshift32", f"WITH {STATES.replace('n < 128', 'n < 2000')} SELECT l_orderkey AS k, l_linenumber AS line, n::INT AS n, x FROM lineitem JOIN x1 ON n = l_partkey % 2000 + 1")
def xorshift32(spark, sf_dir):
    """The state after as many steps as a row says."""
    n = (F.col("l_partkey") % 2000 + 1).cast("int").alias("n")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), n).withColumn("x", dither.state_after(F.col("n")))


@query("dither_tpdf_parts", f"WITH {STATES.replace('WITH ', '')}, {NOISE}, {SAMPLES} SELECT clip, i, (s + d * (1.0::FLOAT / 32768::FLOAT))::DOUBLE AS y FROM samples JOIN noise USING (i)")
def dither_tpdf_parts(spark, sf_dir):
    """Clips in parts of 20 samples, each with the noise of its own place."""
    parts = clips(spark, sf_dir).select("clip", "pcm", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(20))).alias("first"))
    noisy = dither.tpdf_dither(parts.withColumn("pcm", F.slice("pcm", F.col("first") + 1, 20)), 16, keep=("clip", "first"), at=F.col("first"))
    rows = noisy.select("clip", "first", F.posexplode("pcm").alias("k", "s"))
    return rows.select("clip", (F.col("first") + F.col("k")).cast("int").alias("i"), F.col("s").cast("double").alias("y"))


@query("dither_tpdf", f"WITH {STATES.replace('WITH ', '')}, {NOISE}, {SAMPLES} SELECT clip, i, (s + d * (1.0::FLOAT / 32768::FLOAT))::DOUBLE AS y FROM samples JOIN noise USING (i)")
def dither_tpdf(spark, sf_dir):
    return listed(dither.tpdf_dither(clips(spark, sf_dir), 16))


@query(
    "dither_noise_shaped",
    f"""WITH {STATES}, {NOISE}, {SAMPLES}, given AS (SELECT clip, i, s, d * (1::FLOAT / 128::FLOAT) AS d FROM samples JOIN noise USING (i)),
    fed AS (SELECT clip, i, s AS want, (round((s + d) / (1::FLOAT / 128::FLOAT)) * (1::FLOAT / 128::FLOAT))::FLOAT AS y FROM given WHERE i = 0
      UNION ALL SELECT g.clip, g.i, g.s - (f.y - f.want), (round((g.s - (f.y - f.want) + g.d) / (1::FLOAT / 128::FLOAT)) * (1::FLOAT / 128::FLOAT))::FLOAT
      FROM fed f JOIN given g ON g.clip = f.clip AND g.i = f.i + 1)
    SELECT clip, i, y::DOUBLE AS y FROM fed""",
)
def dither_noise_shaped(spark, sf_dir):
    return listed(dither.noise_shaped_dither(clips(spark, sf_dir), 8))
