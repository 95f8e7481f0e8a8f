"""Queries over FLAC's integer stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewright.functions import headers
from tonewright.functions.numeric import joined, part, text, to_be
from tonewright.operators import predict
from tonewright.plans.catalog import INTS, SAMPLES, byte_at, clips, ints, query, samples, table
from tonewright.sources.bits import crc_table

BITS = 16
QUANT = "trunc(greatest(-1::FLOAT, least(1::FLOAT, s))::DOUBLE * 32767::DOUBLE)::BIGINT"
ZIG = "CASE WHEN {d} >= 0 THEN 2 * ({d}) ELSE -2 * ({d}) - 1 END"


def blocks(spark, sf_dir, size: int = 32):
    """Rows of 32-sample blocks of clips."""
    rows = samples(spark, sf_dir).select("clip", F.lit(0).alias("ch"), F.col("i").alias("frame"), "s")
    return predict.blocked(rows, BITS, size)


V = f"{SAMPLES}, v AS (SELECT clip, (i // 32)::BIGINT AS block, (i % 32)::INT AS i, {QUANT} AS v FROM samples)"
LAGS = """l AS (SELECT clip, block, i, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c, lag(v, 4) OVER w AS d
  FROM v WINDOW w AS (PARTITION BY clip, block ORDER BY i))"""
DIFFS = "r AS (SELECT clip, block, i, v, v AS d0, v - a AS d1, v - 2 * a + b AS d2, v - 3 * a + 3 * b - c AS d3, v - 4 * a + 6 * b - 4 * c + d AS d4 FROM l)"
LONG = "e AS (" + " UNION ALL ".join(f"SELECT clip, block, {k} AS ord, d{k} AS d FROM r" for k in range(5)) + ")"
COSTS = f"""p AS (SELECT clip, block, ord, count(*) AS n, count(d) AS n_res, coalesce(sum({ZIG.format(d="d")}), 0)::BIGINT AS total FROM e GROUP BY ALL),
  k AS (SELECT *, CASE WHEN total // n_res > 0 THEN least(14, floor(log2(total // n_res))::INT) ELSE 0 END AS k FROM p),
  c AS (SELECT k.clip, k.block, k.ord, k.n, k.n_res, k.total, k.k, sum((({ZIG.format(d="e.d")}) >> k.k) + 1 + k.k)::BIGINT AS rice FROM k JOIN e ON e.clip = k.clip AND e.block = k.block AND e.ord = k.ord AND e.d IS NOT NULL GROUP BY ALL)"""
ALL = f"WITH {V}, {LAGS}, {DIFFS}, {LONG}, {COSTS}"
BEST = f"{ALL}, best AS (SELECT *, 14 + 16 * ord + rice AS cost, row_number() OVER (PARTITION BY clip, block ORDER BY 14 + 16 * ord + rice, ord) AS rn FROM c)"


@query("zigzag_encode", f"WITH {INTS} SELECT k, n, {ZIG.format(d='b')} AS z FROM ints")
def zigzag_encode(spark, sf_dir):
    return ints(spark, sf_dir).select("k", "n", predict.zigzag(F.col("b")).alias("z"))


@query("zigzag_decode", f"WITH {INTS} SELECT k, n, b AS v FROM ints")
def zigzag_decode(spark, sf_dir):
    return ints(spark, sf_dir).select("k", "n", predict.unzigzag(predict.zigzag(F.col("b"))).alias("v"))


@query("flac_block_split", f"WITH {V} SELECT clip, block, count(*) AS n, sum(v)::BIGINT AS total FROM v GROUP BY ALL")
def flac_block_split(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("clip", "block").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("flac_fixed_residual", f"WITH {V}, {LAGS}, {DIFFS} SELECT clip, block, i, d0, d1, d2, d3, d4 FROM r")
def flac_fixed_residual(spark, sf_dir):
    return predict.residuals(blocks(spark, sf_dir)).drop("ch", "v")


@query("flac_fixed_restore", f"WITH {V} SELECT clip, block, i, v FROM v")
def flac_fixed_restore(spark, sf_dir):
    """Third differences with warm-up values, restored."""
    coded = predict.residuals(blocks(spark, sf_dir)).withColumn("r", F.when(F.col("i") < 3, F.col("v")).otherwise(F.col("d3")))
    return predict.fixed_restore(coded, 3).drop("ch")


@query("rice_param", f"{ALL} SELECT clip, block, ord, n_res, total, k FROM k")
def rice_param(spark, sf_dir):
    return predict.order_costs(blocks(spark, sf_dir), BITS).select("clip", "block", "ord", "n_res", "total", "k")


@query("rice_cost", f"{ALL} SELECT clip, block, ord, rice FROM c")
def rice_cost(spark, sf_dir):
    return predict.order_costs(blocks(spark, sf_dir), BITS).select("clip", "block", "ord", "rice")


@query("flac_best_order", f"{BEST} SELECT clip, block, ord, k, cost FROM best WHERE rn = 1")
def flac_best_order(spark, sf_dir):
    return predict.best_order(blocks(spark, sf_dir), BITS).select("clip", "block", "ord", "k", "cost")


@query("flac_subframe_choice", f"{BEST} SELECT clip, block, CASE WHEN 8 + 16 * n <= cost OR n <= 4 THEN 'verbatim' ELSE 'fixed' END AS subframe FROM best WHERE rn = 1")
def flac_subframe_choice(spark, sf_dir):
    return predict.best_order(blocks(spark, sf_dir), BITS).select("clip", "block", "subframe")


PAIR = "l.v AS a, r.v AS b FROM v l JOIN v r ON r.clip = l.clip AND r.block = l.block AND r.i = l.i + 1 WHERE l.i % 2 = 0"


def _pairs(spark, sf_dir):
    """Samples 2i and 2i + 1 as left and right."""
    rows = blocks(spark, sf_dir).groupBy("clip", "block", (F.col("i") - F.col("i") % 2).alias("i"))
    return rows.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("b"))


@query("flac_midside", f"WITH {V} SELECT clip, block, i, (a + b) >> 1 AS mid, a - b AS side FROM (SELECT l.clip, l.block, l.i, {PAIR})")
def flac_midside(spark, sf_dir):
    mid, side = predict.midside(F.col("a"), F.col("b"))
    return _pairs(spark, sf_dir).select("clip", "block", "i", mid.alias("mid"), side.alias("side"))


@query("flac_decorrelate", f"WITH {V} SELECT clip, block, i, code, a AS l, b AS r FROM (SELECT l.clip, l.block, l.i, {PAIR}), (VALUES (1), (8), (9), (10)) c(code)")
def flac_decorrelate(spark, sf_dir):
    """Each coding of a pair, undone."""
    a, b, code = F.col("a"), F.col("b"), F.col("code")
    mid, side = predict.midside(a, b)
    rows = _pairs(spark, sf_dir).withColumn("code", F.explode(F.array(*map(F.lit, (1, 8, 9, 10)))))
    rows = rows.withColumns({"x": F.when(code == 9, side).when(code == 10, mid).otherwise(a), "y": F.when(code.isin(8, 10), side).otherwise(b)})
    left, right = predict.decorrelate(F.col("x"), F.col("y"), code)
    return rows.select("clip", "block", "i", "code", left.alias("l"), right.alias("r"))


SIZE_SQL = "CASE n WHEN 192 THEN 1 WHEN 576 THEN 2 WHEN 1152 THEN 3 WHEN 2304 THEN 4 WHEN 4608 THEN 5 WHEN 256 THEN 8 WHEN 512 THEN 9 WHEN 1024 THEN 10 WHEN 2048 THEN 11 WHEN 4096 THEN 12 WHEN 8192 THEN 13 WHEN 16384 THEN 14 WHEN 32768 THEN 15 ELSE CASE WHEN n <= 256 THEN 6 ELSE 7 END END"
RATE_SQL = "CASE r WHEN 88200 THEN 1 WHEN 176400 THEN 2 WHEN 192000 THEN 3 WHEN 8000 THEN 4 WHEN 16000 THEN 5 WHEN 22050 THEN 6 WHEN 24000 THEN 7 WHEN 32000 THEN 8 WHEN 44100 THEN 9 WHEN 48000 THEN 10 WHEN 96000 THEN 11 ELSE CASE WHEN r % 1000 = 0 AND r <= 255000 THEN 12 WHEN r <= 65535 THEN 13 WHEN r % 10 = 0 AND r <= 655350 THEN 14 ELSE 0 END END"
BPS_SQL = "CASE b WHEN 8 THEN 1 WHEN 12 THEN 2 WHEN 16 THEN 4 WHEN 20 THEN 5 WHEN 24 THEN 6 ELSE 0 END"
CODES_SQL = f"""WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 144 << (o_orderkey % 5 + 1)::INT WHEN o_orderkey % 3 = 1 THEN 1 << (o_orderkey % 9 + 8)::INT ELSE o_orderkey % 5000 + 1 END AS n,
  CASE WHEN o_orderkey % 2 = 0 THEN 8000 * (o_orderkey % 13 + 1) ELSE 11025 * (o_orderkey % 17 + 1) + o_custkey % 3 END AS r, o_orderkey % 32 + 1 AS b FROM orders)
  SELECT k, n, r, b, {SIZE_SQL} AS size_code, {RATE_SQL} AS rate_code, {BPS_SQL} AS bits_code FROM x"""


@query("flac_header_codes", CODES_SQL)
def flac_header_codes(spark, sf_dir):
    o, n, r, b = F.col("o_orderkey"), F.col("n"), F.col("r"), F.col("b")
    rows = table(spark, sf_dir, "orders").select(
        o.alias("k"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN shiftleft(144L, int(o_orderkey % 5 + 1)) WHEN o_orderkey % 3 = 1 THEN shiftleft(1L, int(o_orderkey % 9 + 8)) ELSE o_orderkey % 5000 + 1 END").alias("n"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 8000 * (o_orderkey % 13 + 1) ELSE 11025 * (o_orderkey % 17 + 1) + o_custkey % 3 END").alias("r"),
        (o % 32 + 1).alias("b"),
    )
    return rows.select("k", "n", "r", "b", headers.flac_size_code(n).alias("size_code"), headers.flac_rate_code(r).alias("rate_code"), headers.flac_bits_code(b).alias("bits_code"))


def crc_sql(width: int, poly: int) -> str:
    table_ = "[" + ",".join(map(str, crc_table(width, poly))) + "]::BIGINT[]"
    moved = f"((acc << 8) & {(1 << width) - 1})" if width > 8 else "0"
    step = f"xor({moved}, list_extract({table_}, (xor(acc >> {width - 8}, b) + 1)::INT))"
    bytes_ = f"list_transform(range(octet_length(encode(text))), lambda i: {byte_at('encode(text)', 'i')})"
    return f"SELECT item_id, list_reduce({bytes_}, lambda acc, b: {step}, 0::BIGINT) AS crc FROM benchmark"


for _name, _width, _poly in (("crc8", 8, 0x07), ("crc16", 16, 0x8005), ("ogg_crc32", 32, 0x04C11DB7)):

    @query(_name, crc_sql(_width, _poly))
    def crc(spark, sf_dir, width=_width, poly=_poly):
        """Of the bytes of texts."""
        return table(spark, sf_dir, "benchmark").select("item_id", predict.crc(F.col("text").cast("binary"), width, poly).alias("crc"))


@query("flac_md5", f"WITH {SAMPLES}, v AS (SELECT clip, i, ({QUANT} + 65536) % 65536 AS u FROM samples) SELECT clip, md5(from_hex(string_agg(printf('%02x%02x', u % 256, u // 256), '' ORDER BY i))) AS md5 FROM v GROUP BY clip")
def flac_md5(spark, sf_dir):
    values = F.transform("pcm", lambda s: predict.quantise(s, 16))
    return clips(spark, sf_dir).select("clip", predict.md5_of(values, 16).alias("md5"))


@query(
    "flac_streaminfo",
    """SELECT o_orderkey AS k, 4096 AS min_block, 4096 AS max_block, (o_orderkey % 65536)::INT AS min_frame, (o_custkey * 257 % 16777216)::INT AS max_frame, (o_orderkey * 31 % 655350 + 1)::INT AS sample_rate,
    (o_orderkey % 8 + 1)::INT AS channels, (o_custkey % 32 + 1)::INT AS bit_depth, o_orderkey * 1048583 % 68719476736 AS total_samples FROM orders""",
)
def flac_streaminfo(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rate, total = o * 31 % 655350 + 1, F.pmod(o * 1048583, F.lit(68719476736))
    word = F.shiftleft(rate, 12) + F.shiftleft(o % 8, 9) + F.shiftleft(c % 32, 4) + F.shiftright(total, 32)
    raw = joined(to_be(F.lit(4096), 2), to_be(F.lit(4096), 2), to_be(o % 65536, 3), to_be(c * 257, 3), to_be(word, 4), to_be(total, 4), F.lit(bytearray(16)))
    return table(spark, sf_dir, "orders").select(o.alias("k"), headers.flac_streaminfo(raw).alias("h")).select("k", "h.*")


@query(
    "flac_frame_header",
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 15 + 1 AS size, o_custkey % 15 AS rate, o_orderkey % 11 AS ch, CASE o_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 6 END AS depth FROM orders)
    SELECT k, CASE WHEN size = 1 THEN 192 WHEN size <= 5 THEN 144 << size::INT WHEN size >= 8 THEN 1 << size::INT END::INT AS block_size,
    [NULL, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000, NULL, NULL, NULL][(rate + 1)::INT]::INT AS sample_rate, ch::INT AS channel_code, [NULL, 8, 12, NULL, 16, 20, 24][(depth + 1)::INT]::INT AS bit_depth FROM x""",
)
def flac_frame_header(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    depth = F.get(F.array(*map(F.lit, (1, 2, 4, 5, 6))), (c % 5).cast("int"))
    word = F.lit(0xFFF80000).cast("long") + F.shiftleft(o % 15 + 1, 12) + F.shiftleft(c % 15, 8) + F.shiftleft(o % 11, 4) + F.shiftleft(depth, 1)
    raw = joined(to_be(word, 4), text("x"))
    rows = table(spark, sf_dir, "orders").select(o.alias("k"), headers.flac_frame_header(part(raw, 0, 5)).alias("h"))
    return rows.select("k", "h.block_size", "h.sample_rate", "h.channel_code", "h.bit_depth")
