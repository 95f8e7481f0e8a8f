"""FLAC by block against the whole-file encoder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import framing
from tonewright.sources import flac

INFO = "struct<sample_rate:int,channels:int>"


def signal(n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.clip(np.cumsum(rng.normal(0, 0.02, n)), -1.2, 1.2).astype(np.float32)


def pieces(spark, clips: dict, rate: int = 44100, channels: int = 1, cut: int = 1500):
    """Clips in pieces of cut frames, the rows in another order."""
    rows = []
    for name, pcm in clips.items():
        step = cut * channels
        at = range(0, max(1, 0 if pcm is None else len(pcm)), step)
        rows += [(name, (rate, channels), i // channels, None if pcm is None else pcm[i : i + step].tolist()) for i in at]
    return spark.createDataFrame(rows[::-1], f"clip string, info {INFO}, first long, pcm array<float>").repartition(4)


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_bytes_equal_the_whole_file_encoder(spark, channels, bits):
    clips = {f"c{n}": signal(n * channels + (n % 2 if channels > 1 else 0), n) for n in (0, 1, 4, 5, 4095, 4096, 4097, 9001)}
    clips |= {"noise": np.random.default_rng(1).uniform(-1, 1, 5000 * channels).astype(np.float32), "still": np.zeros(8192 * channels, np.float32)}
    parts = framing.blocks(pieces(spark, clips, channels=channels))
    frames = framing.packed(parts, bits)
    got = {r.clip: bytes(r.content) for r in framing.files(frames, framing.digests(parts, bits), bits).collect()}
    assert got == {k: flac.encode(v, 44100, channels, bits) for k, v in clips.items()}


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_relational_choice_gives_the_same_frames(spark, channels):
    clips = {f"c{n}": signal(n * channels, n) for n in (1, 4, 5, 600, 4100)}
    clips["noise"] = np.random.default_rng(2).uniform(-1, 1, 300 * channels).astype(np.float32)
    parts = framing.blocks(pieces(spark, clips, channels=channels))
    chosen = framing.packed(parts.join(framing.choices(parts), ["clip", "block"]))
    own = {(r.clip, r.block): bytes(r.raw) for r in framing.packed(parts).collect()}
    assert {(r.clip, r.block): bytes(r.raw) for r in chosen.collect()} == own


def test_positions_find_each_frame(spark, monkeypatch):
    monkeypatch.setattr(framing, "SPAN", 2)
    clips = {"a": signal(30_000), "b": signal(4096, 1), None: signal(9000, 2)}
    frames = framing.packed(framing.blocks(pieces(spark, clips)))
    rows = framing.positions(frames).collect()
    assert len(rows) == 8 + 1 + 3
    for r in rows:
        data = flac.encode(clips[r.clip], 44100, 1, 16)
        found = flac.index(data)[r.block]
        assert (r.at, r.size, r.n) == (found.at, found.size, found.block)


def test_odd_rows(spark):
    clips = {"none": None, "empty": np.zeros(0, np.float32), "nan": np.array([np.nan, 2, -2, 0.5, 0.25, 0.1], np.float32)}
    rows = pieces(spark, clips).withColumns({"block": F.lit(7), "raw": F.lit("clash"), "n": F.lit("x"), "size": F.lit(0)})
    parts = framing.blocks(rows)
    got = {r.clip: bytes(r.content) for r in framing.files(framing.packed(parts), framing.digests(parts)).collect()}
    want = {k: flac.encode(np.zeros(0, np.float32) if v is None else v, 44100, 1, 16) for k, v in clips.items()}
    assert got == want
    none = framing.blocks(rows.limit(0))
    assert framing.files(framing.packed(none), framing.digests(none)).count() == 0
    with pytest.raises(Exception, match="InvalidChannels"):
        framing.packed(framing.blocks(pieces(spark, {"a": signal(10)}, channels=9))).collect()


def test_a_long_clip_is_packed_by_many_tasks_and_written_frame_by_frame(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    clip = signal(400_000)
    parts = framing.blocks(pieces(spark, {"long": clip, "short": clip[:100]}, cut=50_000))
    frames = framing.packed(parts)
    frames.withColumn("task", F.spark_partition_id()).write.parquet(f"{tmp_path}/frames")
    kept = spark.read.parquet(f"{tmp_path}/frames")
    assert kept.filter("clip = 'long'").select("task").distinct().count() > 1
    head = framing.heads(kept, framing.digests(parts))
    out = framing.write(kept, head, f"file://{tmp_path}/out").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in out) == ["long.flac", "short.flac"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["long.flac", "short.flac"]
    data = (tmp_path / "out" / "long.flac").read_bytes()
    assert data == flac.encode(clip, 44100, 1, 16) and {r.length for r in out} == {len(data), len(flac.encode(clip[:100], 44100, 1, 16))}
    with pytest.raises(Exception, match="no name for a file"):
        framing.write(kept.withColumn("clip", F.lit("a/b")), head, f"file://{tmp_path}/out").collect()


def test_rows_of_any_key_type(spark):
    parts = framing.blocks(pieces(spark, {"a": signal(5000), "b": signal(50)}).withColumn("k", F.when(F.col("clip") == "a", 1.5)), ("clip", "k"))
    rows = framing.files(framing.packed(parts, keep=("clip", "k")), framing.digests(parts, keep=("clip", "k")), keep=("clip", "k"))
    got = {(r.clip, r.k): bytes(r.content) for r in rows.collect()}
    assert got == {("a", 1.5): flac.encode(signal(5000), 44100, 1, 16), ("b", None): flac.encode(signal(50), 44100, 1, 16)}
