"""Ogg lacing as relational operators: packets to segments and pages to packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lacing(n: Column) -> Column:
    """Segment sizes of a packet of n bytes: 255s and one less."""
    return F.concat(F.array_repeat(F.lit(255), F.floor(n / 255).cast("int")), F.array((n % 255).cast("int")))


def segments(packets: DataFrame, size: Column) -> DataFrame:
    """stream, packet, seg, lace of rows (stream, packet)."""
    return packets.select("stream", "packet", F.posexplode(lacing(size)).alias("seg", "lace"))


def packet_ids(rows: DataFrame) -> DataFrame:
    """Adds packet_id to segment rows (stream, pos, lace): packets ended before each segment."""
    before = Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("packet_id", F.coalesce(F.sum(F.when(F.col("lace") < 255, 1).otherwise(0)).over(before), F.lit(0)))


def packets(rows: DataFrame) -> DataFrame:
    """stream, packet_id, n_segments, size of segment rows."""
    return packet_ids(rows).groupBy("stream", "packet_id").agg(F.count("*").alias("n_segments"), F.sum("lace").cast("long").alias("size"))


def page_packets(pages: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, serial, packet_no and packet of page rows as ogg_pages gives them; streams of other serials stay apart.

    A page without the continuation flag ends an open packet. Packets are put together from their
    segments, so a task holds one packet at a time.
    """
    seg = pages.select(*keep, "serial", "page_no", "flags", "body", F.posexplode("lacing").alias("seg", "lace"))
    in_page = Window.partitionBy(*keep, "serial", "page_no").orderBy("seg")
    seg = seg.withColumn("_at", F.sum("lace").over(in_page) - F.col("lace"))
    seg = seg.withColumn("part", F.substring(F.col("body"), (F.col("_at") + 1).cast("int"), F.col("lace").cast("int"))).drop("body")
    order = Window.partitionBy(*keep, "serial").orderBy("page_no", "seg")
    fresh = (F.lag("lace").over(order) < 255) | ((F.col("seg") == 0) & (F.col("flags").bitwiseAND(F.lit(1)) == 0)) | F.lag("lace").over(order).isNull()
    seg = seg.withColumn("_new", fresh.cast("int")).withColumn("packet_no", F.sum("_new").over(order) - 1)
    parts = F.sort_array(F.collect_list(F.struct("page_no", "seg", "part")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["part"])), ""))
    return seg.groupBy(*keep, "serial", "packet_no").agg(joined.alias("packet"))


def mux_flags(rows: DataFrame) -> DataFrame:
    """Adds page_no and flags (2 first, 4 last) to packets of a stream in order."""
    w = Window.partitionBy("stream").orderBy("packet")
    n = F.count("*").over(Window.partitionBy("stream"))
    no = F.row_number().over(w)
    return rows.select("*", (no - 1).alias("page_no"), (F.when(no == 1, 2).otherwise(0) + F.when(no == n, 4).otherwise(0)).alias("flags"))


def last_granule(pages: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    return pages.groupBy(*keep).agg(F.max_by("granule", "page_no").alias("granule"))
