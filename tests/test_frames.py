"""Operators over DataFrames: errors as a column, native sources and sinks, streams, plans."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.functions import headers, pcm
from tonewright.functions.numeric import sign_extend
from tonewright.operators import packets, predict, resample, samples, tags
from tonewright.sources import aiff, flac, ogg, registry, udtf, wav
from tonewright.sources import tags as tag_bytes
from tonewright.sources.errors import AudioError
from tonewright.streaming.decoders import OUT, Machine, Stream, decode_chunks, decode_stream


def ramp(n=4800):
    return (np.arange(n) / n * 1.8 - 0.9).astype(np.float32)


def files(spark, content: dict[str, bytes]):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def test_errors_are_a_column_or_stop_the_job(spark):
    df = files(spark, {"good": wav.encode(ramp(), 8000, 1), "bad": b"RIFF" + bytes(50), "junk": b"text", "empty": b""})
    got = {r.path: r for r in registry.decode(df).collect()}
    assert got["good"].error is None and got["good"].info.total_samples == 4800 and len(got["good"].pcm) == 4800
    assert got["bad"].error.code == "InvalidHeader" and got["bad"].pcm is None
    assert got["junk"].error.code == "UnsupportedFormat" and got["empty"].error.code == "InvalidHeader"
    with pytest.raises(Exception, match="UnsupportedFormat|InvalidHeader"):
        registry.decode(df, mode="FAILFAST").collect()


def test_audio_source(spark, tmp_path):
    from tonewright.sources import opus
    from tonewright.sources.datasource import AudioSource

    (tmp_path / "sub").mkdir()
    content = {"a.wav": wav.encode(ramp(), 8000, 1), "sub/b.flac": flac.encode(ramp(), 44100, 2, 16), "c.aiff": aiff.encode(ramp(), 8000, 1), "d.opus": opus.encode(ramp(960), 48000, 1), "e.txt": b"text", "f.wav": b"RIFF" + bytes(60)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    spark.dataSource.register(AudioSource)
    read = spark.read.format("audio").option("partitionBytes", "5000")
    got = {r.path.rsplit("/", 1)[1]: r for r in read.load(f"file://{tmp_path}").collect()}
    assert len(got) == 6 and [got[k].format for k in ("a.wav", "b.flac", "c.aiff", "d.opus", "e.txt")] == ["Wav", "Flac", "Aiff", "Ogg", None]
    assert np.array_equal(np.array(got["b.flac"].pcm, np.float32), flac.decode(content["sub/b.flac"])[1])
    assert got["f.wav"].error.code == "InvalidHeader" and got["e.txt"].error.code == "UnsupportedFormat" and got["d.opus"].pcm == []
    heads = {r.path.rsplit("/", 1)[1]: r for r in read.option("mode", "header").load(f"file://{tmp_path}").collect()}
    assert all(r.pcm is None for r in heads.values()) and all(heads[k].info == got[k].info for k in heads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [r.format for r in read.option("pushdown", "true").load(f"file://{tmp_path}").filter("format = 'Flac' AND length > 0").collect()] == ["Flac"]


def test_registered_codec(spark):
    registry.register("Raw", lambda data: (wav.info("RawPcm", 8000, 1, 16, len(data) // 2), np.frombuffer(data, "<i2").astype(np.float32) / 32768))
    try:
        row = registry.decode(files(spark, {"x": b"\0\x40\0\xc0"}), codec="Raw").first()
        assert row.pcm == [0.5, -0.5] and row.info.format == "RawPcm"
    finally:
        del registry.DECODERS["Raw"]


def test_frames_are_pruned_before_decoding(spark):
    data = flac.encode(ramp(50_000), 44100, 1, 16)
    frames = registry.flac_frames(files(spark, {"a": data}))
    assert frames.count() == 13
    part = registry.decode_flac_frames(frames, 10_000, 11_000).orderBy("start").collect()
    got = np.concatenate([r.pcm for r in part])
    assert np.array_equal(got.astype(np.float32), flac.decode(data)[1][10_000:11_000]) and len(part) == 1


def test_table_functions_take_malformed_files(spark):
    udtf.register_all(spark)
    files(spark, {"a": b"", "b": b"OggS", "c": ogg.mux([b"x"], [1], 1) + b"OggSx"}).createOrReplaceTempView("_odd")
    for name in udtf.FUNCTIONS:
        rows = spark.sql(f"SELECT o.path, x.* FROM _odd o, LATERAL {name}(o.content) x").collect()
        assert len(rows) == (name == "ogg_pages")


def test_packets_over_pages_and_serials(spark):
    udtf.register_all(spark)
    one, two = ogg.mux([b"head", bytes(70_000), b"end"], [0, 1, 2], 1), ogg.mux([b"other"], [0], 2)
    pages = ogg.pages(one)
    cut = pages[0].at
    mixed = one[: pages[1].at] + two + one[pages[1].at :]
    assert cut == 0
    files(spark, {"a": mixed}).createOrReplaceTempView("_mixed")
    found = packets.page_packets(spark.sql("SELECT m.path, p.* FROM _mixed m, LATERAL ogg_pages(m.content) p"))
    got = {(r.serial, r.packet_no): bytes(r.packet) for r in found.collect()}
    assert got == {(1, 0): b"head", (1, 1): bytes(70_000), (1, 2): b"end", (2, 0): b"other"}


def test_pcm_edges(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (-2.0,), (0.5,)], "s float")
    rows = df.select(*[f(F.col("s")).cast("long").alias(f.__name__) for f in (pcm.f32_to_i16, pcm.f32_to_i24, pcm.f32_to_i32, pcm.f32_to_u8)]).collect()
    assert [r.f32_to_i16 for r in rows] == [0, 32767, -32767, 16383]
    assert [r.f32_to_i32 for r in rows] == [0, 2147483647, -2147483647, 1073741823]
    assert [r.f32_to_u8 for r in rows] == [0, 255, 0, 192]
    ints = spark.createDataFrame([(0,), (1 << 23,), (0xFFFFFF,)], "s long").select(pcm.i24_to_f32(F.col("s")).alias("x"), sign_extend(F.col("s"), 4).alias("y")).collect()
    assert [r.x for r in ints] == [0.0, -1.0, -1 / 8388608] and [r.y for r in ints] == [0, 0, -1]


def test_planes(spark):
    planes = spark.createDataFrame([([[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]],), ([[1.0, 2.0], [3.0]],), ([],)], "p array<array<float>>")
    assert [r[0] for r in planes.select(pcm.interleave(F.col("p"))).collect()] == [[1, 2, 3, 4, 5, 6], [1, 3, 2], []]
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],)], "s array<float>")
    assert [r[0] for r in flat.select(pcm.deinterleave(F.col("s"), F.lit(2))).collect()] == [[[1, 3], [2, 4]], [[], []]]
    assert flat.select(pcm.deinterleave(F.col("s"), F.lit(0))).first()[0] == []


def test_clips_to_rows_and_back(spark):
    clips = spark.createDataFrame([(1, [0.5, 0.25, -0.5, 1.0]), (2, [0.0, 0.125])], "clip long, pcm array<float>")
    rows = samples.exploded(clips, channels=2)
    assert sorted((r.clip, r.frame, r.ch) for r in rows.collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 0, 1)]
    assert sorted(map(tuple, samples.collected(rows).collect())) == sorted((r.clip, r.pcm) for r in clips.collect())


def test_headers_reject(spark):
    df = spark.createDataFrame([(bytearray(b),) for b in (b"", b"\xff\xfb\x90\x00", b"OpusHead" + bytes(11), b"\xff\xf1\x50\x80\x0c\x80\x00", b"RIFF")], "c binary")
    row = df.select(headers.detect_format(F.col("c")).alias("f"), headers.mpeg_frame_header(F.col("c")).alias("m"), headers.opus_head(F.col("c")).alias("o"), headers.adts_header(F.col("c")).alias("a")).collect()
    assert [r.f for r in row] == [None, "Mp3", None, "Aac", "Wav"]
    assert [r.m is None for r in row] == [True, False, True, True, True] and all(r.o is None for r in row)
    assert row[3].a.sample_rate == 44100 and row[3].a.channels == 2 and row[3].a.frame_length == 100


def test_id3_tags_by_columns(spark):
    udtf.register_all(spark)
    fields = {"title": "Ä title", "artist": "B", "album": "C", "track_number": "1/9", "year": "1999", "genre": "g", "comment": "well, hello é"}
    files(spark, {str(v): tag_bytes.id3_tag(fields, v) for v in (2, 3, 4)}).createOrReplaceTempView("_tagged")
    rows = tags.from_id3(spark.sql("SELECT t.path, f.* FROM _tagged t, LATERAL id3_frames(t.content) f")).collect()
    assert len(rows) == 3 and all({k: r[k] for k in fields} == fields for r in rows)
    bodies = [b"\0engnote\0caf\xe9\0", b"\3eng\0x", b"\0engno end", b"\1eng\xfe\xff\0a\0\0\xfe\xff\0b", b"\2eng\0a\0\0\0b", b"\0eng\0", b"\0e", b""]
    got = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bodies)], "k int, b binary").select("k", headers.id3_comment(F.col("b")).alias("t")).collect()
    odd = [b"\3caf\xff", b"\1\xff\xfea\0x", b"\2\xd8\0", b"\2\xd8\x3d\xde\0", b"\1\xff\xfe\x3d\xd8\0\xde", b"\1\xff\xfe\0\xde", b"\1", b"\7a"]
    texts = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(odd)], "k int, b binary").select("k", headers.id3_text(F.col("b")).alias("t")).collect()
    assert [r.t for r in sorted(texts)] == ["caf\ufffd", "a", None, "😀", "😀", None, None, None]
    assert [r.t for r in sorted(got)] == ["café", "x", None, "b", "b", None, None, None]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_fixed_restore(spark, order):
    rng = np.random.default_rng(order)
    rows = [(c, 0, 0, i, int(v)) for c in range(3) for i, v in enumerate(rng.integers(-100, 100, 20))]
    df = predict.residuals(spark.createDataFrame(rows, "clip long, ch int, block long, i int, v long"))
    coded = df.withColumn("r", F.when(F.col("i") < order, F.col("v")).otherwise(F.col(f"d{order}")))
    assert sorted(map(tuple, predict.fixed_restore(coded, order).select("clip", "ch", "block", "i", "v").collect())) == sorted(rows)


def test_no_shuffle_where_none_is_needed(spark):
    clips = spark.createDataFrame([(1, [0.1, 0.2])], "clip long, pcm array<float>")
    for df in (resample.resample(clips, 44100, 48000), clips.select(pcm.each(pcm.f32_to_i16, F.col("pcm")))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in clips.select(pcm.each(pcm.f32_to_i16, F.col("pcm")))._jdf.queryExecution().executedPlan().toString()


ENCODED = {"Wav": (wav.encode(ramp(), 44100, 1, "I16"), wav.decode), "Aiff": (aiff.encode(ramp(), 44100, 1, 16), aiff.decode), "Flac": (flac.encode(ramp(), 44100, 1, 16), flac.decode)}


@pytest.mark.parametrize("kind", sorted(ENCODED))
@pytest.mark.parametrize("size", [1, 13, 100, 1000, 100_000])
def test_stream_is_the_whole(kind, size):
    data, decode = ENCODED[kind]
    if size == 1 and kind == "Flac":
        data = flac.encode(ramp(300), 44100, 1, 16)
    machine, out = Machine(kind, 1000), []
    for i in range(0, len(data), size):
        out += machine.feed(data[i : i + size])
    out += machine.flush()
    assert [e[0] for e in out][:1] == ["header"] and out[-1][0] == "end" and out[-1][3] is None
    parts = [e[2] for e in out if e[0] == "samples"]
    assert all(len(p) == 1000 for p in parts[:-1])
    assert np.array_equal(np.concatenate(parts), decode(data)[1])
    assert machine.flush() == [] and machine.feed(b"x") == []


def test_stream_order_repeats_and_faults():
    data = ENCODED["Wav"][0]
    chunks = [(k, data[i : i + 500], i + 500 >= len(data)) for k, i in enumerate(range(0, len(data), 500))]
    stream = Stream(Machine("Wav"))
    out = [*stream.take(chunks[::-1][:10]), *stream.take(chunks[:5]), *stream.take(chunks)]
    assert np.array_equal(np.concatenate([e[3] for e in out if e[1] == "samples"]), wav.decode(data)[1])
    assert [e[0] for e in out] == list(range(len(out)))
    bad = Machine("Wav")
    assert bad.feed(b"RIFFxxxxJUNKjunk")[-1][3]["code"] == "InvalidHeader"
    cut = Machine("Flac")
    cut.feed(ENCODED["Flac"][0][:-5])
    assert cut.flush()[-1][3]["code"] == "DecodeError"
    assert Machine("Wav", 0).chunk == 4096


def test_stream_bounded_memory():
    data = flac.encode(ramp(40_000), 44100, 1, 16)
    machine, most = Machine("Flac"), 0
    for i in range(0, len(data), 512):
        machine.feed(data[i : i + 512])
        most = max(most, len(machine.saved()["pending"]) + len(machine.saved()["ready"]))
    assert most < len(data) / 2 + 40_000


@pytest.mark.parametrize("kind", sorted(ENCODED))
def test_state_between_feeds_is_a_typed_row(kind):
    data, decode = ENCODED[kind]
    machine, out = Machine(kind, 100), []
    for i in range(0, len(data), 37):
        out += machine.feed(data[i : i + 37])
        row = machine.saved()
        assert len(row["pending"]) + len(row["ready"]) < 20_000
        machine = Machine.loaded(kind, 100, row)
    out += machine.flush()
    assert np.array_equal(np.concatenate([e[2] for e in out if e[0] == "samples"]), decode(data)[1]) and out[-1][3] is None


LARGE = {
    "Wav": lambda n: wav.encode(np.tile(ramp(), n), 44100, 1, "I16"),
    "Aiff": lambda n: aiff.encode(np.tile(ramp(), n), 44100, 1, 16),
    "Flac": lambda n: flac.encode(np.tile(ramp(), n), 44100, 1, 16),
}


@pytest.mark.parametrize("kind", sorted(LARGE))
def test_one_large_feed_takes_memory_and_time_in_proportion(kind):
    took = []
    for n in (250, 1000):
        data = LARGE[kind](n)
        machine, count = Machine(kind), 0
        tracemalloc.start()
        began = time.process_time()
        for event in machine.run(data, True):
            count += len(event[2]) if event[0] == "samples" else 0
        took.append((time.process_time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
        assert count == 4800 * n
    assert took[1][0] < 8 * took[0][0] + 0.5
    assert took[1][1] < 48e6 + 2.2 * len(data)


def chunks_of(name, data, size):
    n = -(-len(data) // size)
    return [(name, k, bytearray(data[k * size : (k + 1) * size]), k == n - 1) for k in range(n)]


CHUNKS = "stream_id string, seq long, bytes binary, is_last boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_stream_goes_on_after_a_restart_and_leaves_no_state(rocks, tmp_path):
    """Chunks out of order over three runs of one checkpoint, with repeats; a broken stream beside them."""
    data = ENCODED["Wav"][0]
    rows = chunks_of("a", data, 700) + chunks_of("b", data, 3000)
    bad = [("bad", k, bytearray(b"no audio at all"), k == 3) for k in range(4)]
    random.Random(4).shuffle(rows)
    n = len(rows)
    thirds = [rows[: n // 3] + bad[:2], rows[n // 4 : 2 * n // 3] + bad[2:3], rows[2 * n // 3 :] + bad[3:]]
    for some in thirds:
        rocks.createDataFrame(some, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
        run = decode_stream(stream, "Wav", 500).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        run.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    events = rocks.read.parquet(str(tmp_path / "out")).orderBy("stream_id", "event_no").collect()
    for name in "ab":
        own = [e for e in events if e.stream_id == name]
        got = np.concatenate([np.array(e.pcm, np.float32) for e in own if e.kind == "samples"])
        assert np.array_equal(got, wav.decode(data)[1])
        assert [e.event_no for e in own] == list(range(len(own))) and [own[0].kind, own[-1].kind] == ["header", "end"]
    assert [(e.kind, e.error.code) for e in events if e.stream_id == "bad"] == [("end", "InvalidHeader")]
    assert state_rows(rocks, tmp_path, "stream") == {} and state_rows(rocks, tmp_path, "early") == {}


def test_growing_files_are_streams_exactly_once_over_restarts(rocks, tmp_path):
    """Files grow between the runs of one checkpoint; one ends with a marker at the edge of a chunk, one has nothing but a marker."""
    from tonewright.sources.chunks import ChunkReader, ChunkSource

    rocks.dataSource.register(ChunkSource)
    data, folder = ENCODED["Wav"][0], tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    even = wav.encode(ramp(478), 44100, 1, "I16")  # 1,000 bytes
    assert len(even) == 1000

    def run():
        stream = rocks.readStream.format("audio_chunks").option("chunkBytes", "500").option("partitionBytes", "1000").load(f"file://{folder}")
        made = decode_stream(stream, "Wav", 300).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        made.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    (folder / "a.wav").write_bytes(data[:4100])
    (folder / "deep" / "b.wav").write_bytes(even)
    run()
    with open(folder / "a.wav", "ab") as f:
        f.write(data[4100:])
    (folder / "deep" / "b.wav.end").touch()
    (folder / "empty.wav").touch()
    (folder / "empty.wav.end").touch()
    run()
    (folder / "a.wav.end").touch()
    run()
    run()
    events = rocks.read.parquet(str(tmp_path / "out")).orderBy("stream_id", "event_no").collect()
    for name, whole in (("a.wav", data), ("deep/b.wav", even)):
        own = [e for e in events if e.stream_id == name]
        assert np.array_equal(np.concatenate([np.array(e.pcm, np.float32) for e in own if e.kind == "samples"]), wav.decode(whole)[1])
        assert [e.event_no for e in own] == list(range(len(own))) and own[-1].kind == "end" and own[-1].error is None
    assert [(e.kind, e.error.code) for e in events if e.stream_id == "empty.wav"] == [("end", "InvalidHeader")]
    assert state_rows(rocks, tmp_path, "stream") == {}
    reader = ChunkReader({"path": f"file://{folder}", "chunkBytes": "500"})
    assert reader.latestOffset()["deep/b.wav"] == [3, True] and reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def state_rows(spark, where, name):
    found = spark.read.format("statestore").option("path", str(where / "state")).option("stateVarName", name).load()
    return {r.key[0]: r for r in found.collect()}


def test_stream_that_never_ends_is_flushed_by_its_timer(rocks, tmp_path):
    data = ENCODED["Wav"][0]
    rows = chunks_of("cut", data, 1000)[:4] + [r for r in chunks_of("gap", data, 1000) if r[1] != 2]
    rocks.createDataFrame(rows, CHUNKS).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
    run = decode_stream(stream, "Wav", 500, idle=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    try:
        ends = until = {}
        until = time.monotonic() + 60
        while len(ends) < 2 and time.monotonic() < until:
            time.sleep(1)
            if any((tmp_path / "out").glob("*.parquet")):
                ends = {e.stream_id: e.error for e in rocks.read.schema(OUT).parquet(str(tmp_path / "out")).filter("kind = 'end'").collect()}
        time.sleep(3)
    finally:
        run.stop()
    assert ends["cut"].code == "EndOfStream" and "missing" not in ends["cut"].detail
    assert "chunk 2 is missing" in ends["gap"].detail
    frames = {r.stream_id: r.n for r in rocks.read.parquet(str(tmp_path / "out")).filter("kind = 'samples'").groupBy("stream_id").agg(F.sum(F.size("pcm")).alias("n")).collect()}
    assert frames == {"cut": (4000 - 44) // 2, "gap": (2000 - 44) // 2}
    assert state_rows(rocks, tmp_path, "stream") == {} and state_rows(rocks, tmp_path, "early") == {}


def test_chunks_of_a_batch(spark):
    data = ENCODED["Aiff"][0]
    rows = [("a", k, bytearray(data[i : i + 997]), i + 997 >= len(data)) for k, i in enumerate(range(0, len(data), 997))]
    events = decode_chunks(spark.createDataFrame(rows, "stream_id string, seq long, bytes binary, is_last boolean"), "Aiff").orderBy("event_no").collect()
    assert [e.kind for e in events] == ["header", "samples", "samples", "end"] and events[0].info.total_samples == 4800


def test_unknown_format_error_is_named():
    assert str(AudioError("InvalidSampleRate", "0")) == "InvalidSampleRate: 0"
