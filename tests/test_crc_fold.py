"""The CRC fold against the CRC over arrays, and its cost on long content."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import predict
from tonewright.sources import ogg, udtf
from tonewright.sources.bits import crc8, crc16, crc32_ogg


@pytest.mark.parametrize(("width", "poly", "plain"), [(8, 0x07, crc8), (16, 0x8005, crc16), (32, 0x04C11DB7, crc32_ogg)])
def test_fold(spark, width, poly, plain):
    rng = np.random.default_rng(width)
    rows = [(n, bytearray(rng.bytes(n))) for n in [*range(12), 255, 4097]] + [(-1, bytearray(9)), (-2, bytearray(b"\xff" * 7)), (-3, None)]
    df = spark.createDataFrame(rows, "n long, x binary").repartition(2)
    got = {r.n: r.crc for r in df.select("n", predict.crc(F.col("x"), width, poly).alias("crc")).collect()}
    assert got == {n: plain(bytes(x)) if x is not None else 0 for n, x in rows}


def test_fold_takes_time_in_proportion(spark):
    """The largest page of 65,307 bytes, sixteen times; a step that makes the bytes anew takes time with the square."""
    df = spark.createDataFrame([(bytearray(np.random.default_rng(k).bytes(65_307)),) for k in range(16)], "x binary").repartition(8)
    began = time.monotonic()
    assert df.filter(predict.crc(F.col("x"), 32, 0x04C11DB7) >= 0).count() == 16
    assert time.monotonic() - began < 10


def test_page_rows_hold_their_own_head(spark):
    udtf.register_all(spark)
    raw = ogg.mux([b"one", b"", b"x" * 70_000], [0, 1, 2], 7)
    spark.createDataFrame([(bytearray(raw),)], "content binary").createOrReplaceTempView("_muxed")
    rows = spark.sql("SELECT p.* FROM _muxed f, LATERAL ogg_pages(f.content) p").orderBy("page_no").collect()
    assert b"".join(bytes(r.head) + bytes(r.body) for r in rows) == raw
