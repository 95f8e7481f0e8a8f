"""Files in parts: equal to the whole, over many tasks, with the bytes that a range needs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.sources import aiff, flac, splits, wav
from tonewright.sources.errors import AudioError


def noise(n, seed=3):
    """Stretches of loud noise, which is full of bytes like frame headers, of silence and of a ramp."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, n).astype(np.float32)
    x[n // 3 : n // 2] = 0
    x[n // 2 : 2 * n // 3] = np.linspace(-0.5, 0.5, 2 * n // 3 - n // 2)
    return x


MAKE = {
    "wav": lambda x, ch: wav.encode(x, 44100, ch, "I16"),
    "aiff": lambda x, ch: aiff.encode(x, 44100, ch, 24),
    "flac": lambda x, ch: flac.encode(x, 44100, ch, 16),
}
DECODE = {"wav": wav.decode, "aiff": aiff.decode, "flac": flac.decode}


@pytest.fixture
def source(spark):
    spark.dataSource.register(splits.FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read(path, **options):
        return spark.read.format("audio_frames").options(**{k: str(v) for k, v in options.items()}).load(f"file://{path}")

    return read


@pytest.mark.parametrize("kind", sorted(MAKE))
@pytest.mark.parametrize("channels", [1, 2])
def test_parts_are_the_whole(source, tmp_path, kind, channels):
    data = MAKE[kind](noise(150_000), channels)
    (tmp_path / f"x.{kind}").write_bytes(data)
    rows = source(tmp_path, partitionBytes=37_003, blockFrames=1000)
    assert rows.rdd.getNumPartitions() >= 3
    found = rows.orderBy("start").collect()
    assert all(r.error is None for r in found)
    ends = [(r.start, r.stop) for r in found]
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert np.array_equal(np.concatenate([np.array(r.pcm, np.float32) for r in found]), DECODE[kind](data)[1])
    whole = source(tmp_path).orderBy("start").collect()
    assert np.array_equal(np.concatenate([np.array(r.pcm, np.float32) for r in whole]), DECODE[kind](data)[1])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [500, 4096, 20_011])
def test_flac_parts_of_any_size_hold_each_frame_once(seed, size):
    data = flac.encode(noise(60_000, seed), 48000, 1, 16)
    meta = flac.metadata(data)
    want = [(f.number, f.at, f.size) for f in flac.index(data, meta)]
    got = []
    for low in range(meta.audio_at, len(data), size):
        part = data[low : low + size + 2 * splits.worst_frame(meta.info) + flac.HEAD]
        frames, closed = splits.frames_from(part, meta.info, min(size, len(data) - low), low + len(part) >= len(data))
        assert closed
        got += [(f.number, f.at + low, f.size) for f in frames]
    assert got == want


class Counted:
    def __init__(self, data):
        self.data, self.n = data, 0

    def __call__(self, at, n):
        out = self.data[at : at + n]
        self.n += len(out)
        return out


@pytest.mark.parametrize("points", [False, True])
def test_flac_range_reads_few_bytes(points):
    raw = flac.encode(noise(3_000_000), 44100, 1, 16)
    meta = flac.metadata(raw)
    if points:
        frames = flac.index(raw, meta)[::100]
        table = b"".join(f.start.to_bytes(8, "big") + (f.at - meta.audio_at).to_bytes(8, "big") + f.block.to_bytes(2, "big") for f in frames)
        raw = raw[:4] + b"\0" + raw[5 : meta.audio_at] + b"\x83" + len(table).to_bytes(3, "big") + table + raw[meta.audio_at :]
        meta = flac.metadata(raw)
        assert len(meta.seek_points) == len(frames)
    for start, stop in ((0, 10), (1_234_567, 1_240_000), (2_999_990, 3_000_000), (0, splits.ALL), (2_500_000, splits.ALL)):
        read = Counted(raw)
        reader = splits.FrameReader({"path": "x"})
        reader.start, reader.stop = start, stop
        rows = list(reader._rows(read, len(raw), splits.Part([])))
        pcm = np.concatenate([p for *_, p in rows])
        first = rows[0][3]
        want = flac.decode_range(raw, start, min(stop, 3_000_000))[1]
        assert np.array_equal(pcm[start - first : start - first + len(want)], want)
        if stop - start < 10_000:
            assert read.n < 1_000_000 < len(raw) / 4


def test_pushed_range_reaches_the_reader_and_the_bytes(source, tmp_path, monkeypatch):
    x = noise(400_000)
    for kind in MAKE:
        (tmp_path / f"x.{kind}").write_bytes(MAKE[kind](x, 1))
    rows = source(tmp_path, partitionBytes=100_000, blockFrames=1000, pushdown="true").filter("stop > 200000 AND start < 203000")
    assert rows.rdd.getNumPartitions() <= 4 < source(tmp_path, partitionBytes=100_000).rdd.getNumPartitions() / 3
    cut = splits.between(rows, 200_000, 203_000)
    got = {r.format: r.pcm for r in cut.groupBy("format").agg(F.flatten(F.sort_array(F.collect_list(F.struct("start", "pcm")))["pcm"]).alias("pcm")).collect()}
    for kind in MAKE:
        want = DECODE[kind]((tmp_path / f"x.{kind}").read_bytes())[1][200_000:203_000]
        assert np.array_equal(np.array(got[kind.capitalize()], np.float32), want)


def test_faults_are_rows(source, tmp_path):
    good = flac.encode(noise(50_000), 44100, 1, 16)
    cut = bytearray(good)
    cut[len(cut) // 2] ^= 0x55
    for name, data in {"a.flac": good, "b.flac": bytes(cut), "c.txt": b"no audio", "d.wav": b"RIFF", "e": b"", "f.flac": good[:30]}.items():
        (tmp_path / name).write_bytes(data)
    rows = source(tmp_path).collect()
    errors = {os.path.basename(r.path): r.error.code for r in rows if r.error}
    assert set(errors) == {"b.flac", "c.txt", "d.wav", "e", "f.flac"} and errors["c.txt"] == "UnsupportedFormat"
    assert sum(r.stop - r.start for r in rows if r.path.endswith("a.flac")) == 50_000
    assert 0 < sum(r.stop - r.start for r in rows if r.path.endswith("b.flac") and not r.error) < 50_000
    with pytest.raises(AudioError):
        splits.FrameReader._header(lambda at, n: b"RIFF", 4)


def test_a_broken_frame_is_told_wherever_a_part_begins(source, tmp_path):
    good = flac.encode(noise(60_000), 44100, 1, 16)
    meta = flac.metadata(good)
    frame = flac.index(good, meta)[5]
    broken = bytearray(good)
    broken[frame.at + frame.size // 2] ^= 0x55
    (tmp_path / "x.flac").write_bytes(bytes(broken))
    for size in range(frame.at - meta.audio_at - 3, frame.at - meta.audio_at + 4):
        rows = source(tmp_path, partitionBytes=size).collect()
        assert [r.error.code for r in rows if r.error] and sum(r.stop - r.start for r in rows if not r.error) < 60_000
