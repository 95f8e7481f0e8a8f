"""Resampling of clips in pieces against whole clips."""

import numpy as np
import pytest

from tonewright.operators import resample
from tonewright.sources.errors import AudioError


def pieces(spark, clips: dict, channels: int, cuts: list[int]):
    rows = []
    for name, x in clips.items():
        at, k = 0, 0
        while at * channels < len(x):
            n = cuts[k % len(cuts)]
            rows.append((name, at, x[at * channels : (at + n) * channels].tolist()))
            at, k = at + n, k + 1
    return spark.createDataFrame(rows[::-1], "clip string, first long, pcm array<float>").repartition(3)


def whole(rows) -> dict:
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.clip, r.first)):
        found.setdefault(r.clip, []).append((r.first, np.array(r.pcm, np.float32)))
    return found


@pytest.mark.parametrize(("src", "dst", "quality"), [(44100, 48000, "Good"), (48000, 44100, "Best"), (96000, 8000, "Good"), (8000, 44100, "Draft"), (44100, 44101, "Good")])
@pytest.mark.parametrize("channels", [1, 2])
def test_equal_to_the_bit(spark, src, dst, quality, channels):
    rng = np.random.default_rng(src + channels)
    clips = {f"c{n}": rng.uniform(-1, 1, n * channels).astype(np.float32) for n in (1, 7, 499, 500, 501, 3210)}
    clips["half"] = rng.uniform(-1, 1, 1001 * channels - (channels - 1)).astype(np.float32)
    got = whole(resample.resample_pieces(pieces(spark, clips, channels, [130, 1, 700]), src, dst, quality, channels, size=500).collect())
    assert set(got) == set(clips)
    for name, x in clips.items():
        at = 0
        for first, part in got[name]:
            assert first == at
            at += len(part) // channels
        assert np.array_equal(np.concatenate([p for _, p in got[name]]), resample.interleaved(x, channels, src, dst, quality))


def test_odd_rows(spark):
    rows = pieces(spark, {"a": np.ones(900, np.float32)}, 1, [300])
    blank = spark.createDataFrame([("n", 0, None), ("e", 0, [])], rows.schema)
    assert {r.clip for r in resample.resample_pieces(rows.unionAll(blank), 8000, 16000, size=250).collect()} == {"a"}
    assert resample.resample_pieces(rows.limit(0), 8000, 16000).count() == 0
    assert resample.resample_pieces(rows, 8000, 8000).count() == 3
    for bad in (rows.filter("first <> 300"), rows.unionAll(rows.filter("first = 300")), rows.filter("first > 0")):
        with pytest.raises(Exception, match="missing"):
            resample.resample_pieces(bad, 8000, 16000, size=250).collect()
    with pytest.raises(AudioError):
        resample.resample_pieces(rows, 0, 16000)


def test_taps_by_row_are_those_of_the_kernel(spark):
    rows = [(q, s, d) for q in (*resample.HALF_WIDTH, "Other") for s, d in ((44100, 48000), (48000, 44100), (96000, 8000), (8000, 8000))]
    made = spark.createDataFrame(rows, "q string, s int, d int")
    for r in made.select("*", resample.taps_of(made.s, made.d, made.q).alias("n")).collect():
        assert r.n == (resample.reach(r.s, r.d, r.q)[1] if r.q in resample.HALF_WIDTH else None)
