"""FLAC's integer stages as relational operators over rows (clip, ch, block, i, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.numeric import clamp, f32, trunc

BLOCK = 4096
KEYS = ["clip", "ch", "block"]


def quantise(s: Column, bits: int) -> Column:
    """BIGINT; f64 work at every depth."""
    return trunc(clamp(s.cast("float"), f32(-1), f32(1)).cast("double") * float((1 << (bits - 1)) - 1), "long")


def blocked(samples: DataFrame, bits: int, size: int = BLOCK) -> DataFrame:
    """clip, ch, block, i, v from rows clip, frame, ch, s."""
    return samples.select("clip", "ch", F.floor(F.col("frame") / size).alias("block"), (F.col("frame") % size).alias("i"), quantise(F.col("s"), bits).alias("v"))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(z: Column) -> Column:
    return F.shiftright(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def residuals(rows: DataFrame) -> DataFrame:
    """Adds d0 to d4, the finite differences; null in an order's warm-up. One sort of each block serves all."""
    w = Window.partitionBy(*KEYS).orderBy("i")
    lag = lambda k: F.lag("v", k).over(w)
    rows = rows.withColumns({f"_{k}": lag(k) for k in range(1, 5)})
    v, a, b, c, d = (F.col(x) for x in ("v", "_1", "_2", "_3", "_4"))
    orders = [v, v - a, v - 2 * a + b, v - 3 * a + 3 * b - c, v - 4 * a + 6 * b - 4 * c + d]
    return rows.select(*KEYS, "i", "v", *[x.alias(f"d{k}") for k, x in enumerate(orders)])


def rice_param(total: Column, n: Column) -> Column:
    mean = F.floor(total / F.greatest(n, F.lit(1)))
    return F.when(mean > 0, F.least(F.length(F.bin(mean)) - 1, F.lit(14))).otherwise(0)


def order_costs(rows: DataFrame, bits: Column | int) -> DataFrame:
    """KEYS, ord, n (samples), n_res, total (zigzag), k, cost of each fixed predictor.

    Rice parameters are known after a first aggregate; the cost's shifted sums need it, so all
    shifts are summed at once (map-side) and the right one is picked.
    """
    long = residuals(rows)
    each = long.select(*KEYS, F.posexplode(F.array(*[F.col(f"d{k}") for k in range(5)])).alias("ord", "d"))
    z = zigzag(F.col("d"))
    sums = each.groupBy(*KEYS, "ord").agg(
        F.count("*").alias("n"),
        F.count("d").alias("n_res"),
        F.coalesce(F.sum(z), F.lit(0)).alias("total"),
        F.array(*[F.coalesce(F.sum(F.shiftright(z, k)), F.lit(0)) for k in range(15)]).alias("shifted"),
    )
    sums = sums.filter(F.col("ord") <= F.col("n")).withColumn("k", rice_param(F.col("total"), F.col("n_res")))
    code = F.get("shifted", F.col("k")) + F.col("n_res") * (1 + F.col("k"))
    return sums.withColumn("rice", code).withColumn("cost", 14 + bits * F.col("ord") + code).drop("shifted")


def best_order(rows: DataFrame, bits: Column | int) -> DataFrame:
    """KEYS, n, ord, k, cost of the cheapest predictor (the lower order of equal ones), and subframe: verbatim or fixed."""
    cheapest = F.min(F.struct("cost", "ord", "k", "n")).alias("b")
    found = order_costs(rows, bits).groupBy(*KEYS).agg(cheapest).select(*KEYS, "b.n", "b.ord", "b.k", "b.cost")
    plain = 8 + bits * F.col("n")
    return found.withColumn("subframe", F.when((plain <= F.col("cost")) | (F.col("n") <= 4), "verbatim").otherwise("fixed"))


def fixed_restore(rows: DataFrame, order: int, value: str = "r") -> DataFrame:
    """KEYS, i, v from warm-up values (i < order) and residuals in one column: as many running sums as the order.

    Warm-up values become the first differences of each level before the sums.
    """
    w = Window.partitionBy(*KEYS).orderBy("i")
    cur = rows.select(*KEYS, "i", F.col(value).alias("v"))
    for k in range(1, order):
        # differences of the warm-up beyond level k
        cur = cur.withColumn("v", F.when((F.col("i") >= k) & (F.col("i") < order), F.col("v") - F.lag("v").over(w)).otherwise(F.col("v")))
    for k in range(order, 0, -1):
        total = F.sum(F.when(F.col("i") >= k - 1, F.col("v")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        cur = cur.withColumn("v", F.when(F.col("i") >= k - 1, total).otherwise(F.col("v")))
    return cur


def midside(left: Column, right: Column) -> tuple[Column, Column]:
    return F.shiftright(left + right, 1), left - right


def decorrelate(a: Column, b: Column, code: Column) -> tuple[Column, Column]:
    """left and right by channel code: 8 left/side, 9 right/side, 10 mid/side, others as they are."""
    total = F.shiftleft(a, 1).bitwiseOR(b.bitwiseAND(F.lit(1).cast("long")))
    left = F.when(code == 9, a + b).when(code == 10, F.shiftright(total + b, 1)).otherwise(a)
    right = F.when(code == 8, a - b).when(code == 10, F.shiftright(total - b, 1)).otherwise(b)
    return left, right


def crc(content: Column, width: int, poly: int) -> Column:
    """CRC of BINARY, most significant bit first from zero, as a fold over words of four bytes with lookup arrays; width up to 32.

    A CRC from zero doesn't see zeros in front, so those fill the first word. Words are cut from BINARY, where a place is found at once.
    """
    from tonewright.sources.bits import crc_table

    mask, table = (1 << width) - 1, crc_table(width, poly)
    tables = [table]  # of a byte and so many zeros behind it
    for _ in range(3):
        tables.append([(x << 8 & mask) ^ table[x >> (width - 8)] for x in tables[-1]])
    n = F.octet_length(content)
    filled = F.concat(F.substring(F.lit(bytearray(3)), F.lit(1), F.pmod(-n, F.lit(4))), content)

    def step(acc: Column, word: Column) -> Column:
        x = F.shiftleft(acc, 32 - width).bitwiseXOR(word)
        found = [F.get(F.array(*[F.lit(v).cast("long") for v in t]), F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int")) for k, t in enumerate(tables)]
        return found[0].bitwiseXOR(found[1]).bitwiseXOR(found[2]).bitwiseXOR(found[3])

    def fold(raw: Column) -> Column:
        words = F.transform(F.sequence(F.lit(1), F.octet_length(raw), F.lit(4)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(4))), 16, 10).cast("long"))
        return F.aggregate(words, F.lit(0).cast("long"), step)

    # The bytes are bound to a variable: an expression inside a fold is evaluated anew at each step.
    return F.when(n > 0, F.get(F.transform(F.array(filled), fold), F.lit(0))).otherwise(F.lit(0).cast("long"))


def md5_of(values: Column, bits: int) -> Column:
    """MD5 of an array of integers in little-endian bytes, JVM-side."""
    from tonewright.functions.numeric import to_le

    return F.md5(F.unhex(F.array_join(F.transform(values, lambda v: F.hex(to_le(v, (bits + 7) // 8))), "")))

