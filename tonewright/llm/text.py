"""Words, lines and table access shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores at its end as no column of that name (in any case) needs."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: str) -> Column:
    """Two hashes of 64 bits that name a row by its columns; a null is told from any value, whichever column has it."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"))


def trimmed(text: Column) -> Column:
    """The text without ASCII white space at its ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def n_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def running_sums(numbers: Column, block: int = 512) -> Column:
    """Sums of all entries before each one. Two levels, so a long array doesn't cost its square.

    numbers is an array column (not an expression) of longs.
    """
    zero = F.lit(0).cast("long")
    add = lambda acc, x: acc + x
    n = F.size(numbers)
    whole = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / block) - 1, F.lit(0)).cast("int")),
        lambda b: F.aggregate(F.slice(numbers, F.lit(1), b * block), zero, add),
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / block) - 1, F.lit(0)).cast("int")),
        lambda b: F.slice(numbers, b * block + 1, F.lit(block)),
    )
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(
        F.flatten(
            F.zip_with(
                whole,
                parts,
                lambda start, part: F.transform(part, lambda _, i: start + F.aggregate(F.slice(part, F.lit(1), i), zero, add)),
            )
        )
    )
