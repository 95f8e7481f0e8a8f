"""Queries over transforms and the lossy encoders' analysis stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewright.operators import spectral
from tonewright.plans.catalog import SAMPLES, clips, listed, query, samples
from tonewright.sources import aac

R6 = lambda c: F.round(c, 6)


FOURIER = f"WITH {SAMPLES} SELECT clip, k::INT AS k, round(sum(s::DOUBLE * cos(2 * pi() * (i * k % 64) / 64)), 6) + 0 AS re, round(-sum(s::DOUBLE * sin(2 * pi() * (i * k % 64) / 64)), 6) + 0 AS im FROM samples, (SELECT unnest(range(64)) AS k) GROUP BY clip, k"


@query("dft", FOURIER)
def dft(spark, sf_dir):
    return spectral.dft_rows(samples(spark, sf_dir), 64).select("clip", "k", (R6("re") + 0).alias("re"), (R6("im") + 0).alias("im"))


@query("fft", FOURIER)
def fft(spark, sf_dir):
    both = spectral.fft(clips(spark, sf_dir)).select("clip", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return both.select("clip", "k", (R6("z.re") + 0).alias("re"), (R6("z.im") + 0).alias("im"))


def mdct_sql(scale: int) -> str:
    return f"round(sum(s::DOUBLE * cos({scale} * pi() / 64 * (i + 0.5::DOUBLE + 16) * (k + 0.5::DOUBLE))), 6)"


MDCT = f"bins AS (SELECT clip, k::INT AS k, sum(s::DOUBLE * cos(pi() / 64 * (i + 0.5::DOUBLE + 16) * (k + 0.5::DOUBLE))) AS x FROM samples, (SELECT unnest(range(32)) AS k) GROUP BY clip, k)"


@query("mdct", f"WITH {SAMPLES}, {MDCT} SELECT clip, k, round(x, 6) + 0 AS x FROM bins")
def mdct(spark, sf_dir):
    return spectral.mdct_rows(samples(spark, sf_dir), 64).select("clip", "k", (R6("x") + 0).alias("x"))


@query("mdct_arrays", f"WITH {SAMPLES}, {MDCT} SELECT clip, k AS i, round(x, 6) + 0 AS y FROM bins")
def mdct_arrays(spark, sf_dir):
    return listed(spectral.mdct(clips(spark, sf_dir)), "bins").withColumn("y", R6("y") + 0)


@query("mdct_standard", f"WITH {SAMPLES} SELECT clip, k::INT AS k, {mdct_sql(2)} + 0 AS x FROM samples, (SELECT unnest(range(32)) AS k) GROUP BY clip, k")
def mdct_standard(spark, sf_dir):
    return spectral.mdct_rows(samples(spark, sf_dir), 64, standard=True).select("clip", "k", (R6("x") + 0).alias("x"))


@query("sine_window", f"WITH {SAMPLES} SELECT clip, i, round(s::DOUBLE * sin(pi() / 64 * (i + 0.5::DOUBLE)), 9) + 0 AS y FROM samples")
def sine_window(spark, sf_dir):
    return spectral.windowed(samples(spark, sf_dir), 64).select("clip", "i", (F.round("s", 9) + 0).alias("y"))


def _stereo(spark, sf_dir):
    return samples(spark, sf_dir).select("clip", F.floor(F.col("i") / 2).alias("frame"), (F.col("i") % 2).alias("ch"), "s")


@query("opus_downmix", f"WITH {SAMPLES} SELECT clip, (i // 2)::BIGINT AS frame, round(sum(s::DOUBLE) / 2, 9) + 0 AS y FROM samples GROUP BY ALL")
def opus_downmix(spark, sf_dir):
    return spectral.downmix(_stereo(spark, sf_dir), 2).select("clip", "frame", (F.round("s", 9) + 0).alias("y"))


@query("opus_frame_split", f"WITH {SAMPLES}, b AS (SELECT clip, (i // 24)::BIGINT AS block, count(*) AS n FROM samples GROUP BY ALL) SELECT clip, block, n, (312 + sum(n) OVER (PARTITION BY clip ORDER BY block))::BIGINT AS granule FROM b")
def opus_frame_split(spark, sf_dir):
    rows = samples(spark, sf_dir).select("clip", F.col("i").alias("frame"), "s")
    return spectral.frame_split(rows, 24)


#: Clips as 64 bins of a spectrum; the last edge is pulled in.
EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 21, 26, 32, 40, 50, 64]
BANDS = f"bands AS (SELECT unnest(range({len(EDGES) - 1}))::INT AS band, unnest({EDGES[:-1]}) AS low, unnest({EDGES[1:]}) AS high)"
ENERGY = f"{SAMPLES}, {BANDS}, e AS (SELECT clip, band, log2(greatest(sum(s::DOUBLE * s::DOUBLE) / any_value(high - low), 1e-10::DOUBLE)) AS energy FROM samples JOIN bands ON i >= low AND i < high GROUP BY clip, band)"
CODE = f"{ENERGY}, q AS (SELECT clip, band, round(energy * 2)::INT AS q FROM e)"


def _bins(spark, sf_dir):
    return samples(spark, sf_dir).select("clip", F.col("i").alias("k"), F.col("s").cast("double").alias("x"))


@query("celt_band_energy", f"WITH {ENERGY} SELECT clip, band, round(energy, 6) AS energy FROM e")
def celt_band_energy(spark, sf_dir):
    return spectral.band_energy(_bins(spark, sf_dir), EDGES).select("clip", "band", R6("energy").alias("energy"))


@query("celt_quant", f"WITH {CODE} SELECT clip, band, q FROM q")
def celt_quant(spark, sf_dir):
    return spectral.band_energy(_bins(spark, sf_dir), EDGES).select("clip", "band", spectral.energy_quant(F.col("energy")).alias("q"))


@query("celt_energy_code", f"WITH {CODE} SELECT clip, band, q, (greatest(-64, least(63, q - coalesce(lag(q) OVER (PARTITION BY clip ORDER BY band), 0))) + 64)::INT AS symbol FROM q")
def celt_energy_code(spark, sf_dir):
    return spectral.energy_code(spectral.band_energy(_bins(spark, sf_dir), EDGES))


@query("celt_normalise", f"WITH {SAMPLES}, {BANDS} SELECT clip, i AS k, round(s::DOUBLE / greatest(sqrt(sum(s::DOUBLE * s::DOUBLE) OVER (PARTITION BY clip, band)), 1e-10::DOUBLE), 6) + 0 AS x FROM samples JOIN bands ON i >= low AND i < high")
def celt_normalise(spark, sf_dir):
    return spectral.normalised(_bins(spark, sf_dir), EDGES).select("clip", "k", (R6("x") + 0).alias("x"))


AAC_EDGES = [*[e for e in aac.BANDS if e < 64], 64]
AAC_Q = f"""{SAMPLES}, bands AS (SELECT unnest(range({len(AAC_EDGES) - 1}))::INT AS band, unnest({AAC_EDGES[:-1]}) AS low, unnest({AAC_EDGES[1:]}) AS high),
  x AS (SELECT clip, i, band, CASE WHEN clip % 3 = 0 AND band % 4 > 1 THEN 0 ELSE s::DOUBLE * 0.0005::DOUBLE END AS x, high - low AS width FROM samples JOIN bands ON i >= low AND i < high),
  r AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY clip, band) / width) AS rms FROM x),
  s AS (SELECT *, CASE WHEN rms > 1e-10 THEN greatest(0, least(200, trunc(100 + 4 * (log2(rms) - log2(10::DOUBLE / 128)))::INT)) ELSE 0 END AS scale FROM r),
  q AS (SELECT clip, i AS k, band, scale, (CASE WHEN x >= 0 THEN 1 ELSE -1 END * least(floor(pow(abs(x), 0.75) / pow(2.0::DOUBLE, 0.25 * (scale - 100)) + 0.5), 8191))::INT AS q FROM s),
  b AS (SELECT clip, band, max(scale) AS scale, max(abs(q)) > 0 AS used FROM q GROUP BY clip, band)"""


def _quantised(spark, sf_dir):
    """Clips as bins, with bands of silence in a third of them."""
    bins = _bins(spark, sf_dir)
    silent = (F.col("clip") % 3 == 0) & (spectral.band_of(F.col("k"), AAC_EDGES) % 4 > 1)
    return spectral.aac_band_quant(bins.withColumn("x", F.when(silent, 0.0).otherwise(F.col("x") * 0.0005)), AAC_EDGES)


@query("aac_band_quant", f"WITH {AAC_Q} SELECT * FROM q")
def aac_band_quant(spark, sf_dir):
    return _quantised(spark, sf_dir)


@query(
    "aac_section",
    f"""WITH {AAC_Q}, m AS (SELECT *, CASE WHEN lag(used) OVER (PARTITION BY clip ORDER BY band) = used THEN 0 ELSE 1 END AS edge FROM b),
    n AS (SELECT *, sum(edge) OVER (PARTITION BY clip ORDER BY band) AS section FROM m)
    SELECT clip, section::BIGINT AS section, any_value(used) AS used, min(band) AS "first", count(*) AS run FROM n GROUP BY clip, section""",
)
def aac_section(spark, sf_dir):
    return spectral.aac_sections(spectral.aac_bands(_quantised(spark, sf_dir)))


@query(
    "aac_scalefactor_delta",
    f"""WITH {AAC_Q}, u AS (SELECT *, first_value(scale) OVER (PARTITION BY clip ORDER BY band) AS f FROM b)
    SELECT clip, band, greatest(0, least(120, scale - coalesce(lag(scale) OVER (PARTITION BY clip ORDER BY band), f) + 60))::INT AS code FROM u WHERE used""",
)
def aac_scalefactor_delta(spark, sf_dir):
    return spectral.aac_scale_deltas(spectral.aac_bands(_quantised(spark, sf_dir)))
