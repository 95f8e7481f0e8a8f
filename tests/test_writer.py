"""The file sink: each clip once, or nothing."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonewright.sources import flac, wav, writer
from tonewright.sources.errors import AudioError


@pytest.fixture
def clips(spark):
    spark.dataSource.register(writer.FileSink)
    pcm = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: ((i * 37 + F.col("id")) % 200 / 100 - 1).cast("float"))
    return spark.range(40).repartition(5).select(F.concat(F.lit("deep/clip"), F.col("id")).alias("name"), F.lit(8000).alias("sample_rate"), F.lit(1).alias("channels"), pcm.alias("pcm"))


def save(df, where, mode="append", **options):
    df.write.format("audio_files").options(**options).mode(mode).save(f"file://{where}")


def files_in(where):
    return sorted(os.path.relpath(os.path.join(d, f), where) for d, _, names in os.walk(where) for f in names if not f.startswith((writer.COMMITTED, ".")))


@pytest.mark.parametrize(("codec", "option", "decode"), [("Wav", "I24", wav.decode), ("Flac", "16", flac.decode)])
def test_committed_files_hold_the_clips(spark, clips, tmp_path, codec, option, decode):
    save(clips, tmp_path / "x", codec=codec, option=option)
    found = {os.path.basename(r.path).split(".")[0]: r for r in writer.written(spark, f"file://{tmp_path / 'x'}").collect()}
    assert len(found) == 40 == len(files_in(tmp_path / "x"))
    for r in clips.collect():
        own = found[os.path.basename(r.name)]
        raw = open(own.path.removeprefix("file:"), "rb").read()
        assert len(raw) == own.bytes and np.abs(decode(raw)[1] - np.array(r.pcm, np.float32)).max() < 1e-4


def test_appended_and_overwritten(spark, clips, tmp_path):
    count = lambda: writer.written(spark, f"file://{tmp_path / 'x'}").count()
    assert count() == 0
    save(clips, tmp_path / "x", codec="Wav")
    save(clips, tmp_path / "x", codec="Wav")
    assert count() == 80 == len(files_in(tmp_path / "x"))
    save(clips.limit(3), tmp_path / "x", "overwrite", codec="Wav")
    assert count() == 3 == len(files_in(tmp_path / "x"))


def test_a_failing_task_leaves_no_file(spark, clips, tmp_path):
    save(clips, tmp_path / "x", codec="Wav")
    bad = clips.withColumn("channels", F.when(F.col("name") == "deep/clip17", 0).otherwise(1))
    with pytest.raises(Exception, match="InvalidChannels"):
        save(bad, tmp_path / "x", codec="Wav")
    assert writer.written(spark, f"file://{tmp_path / 'x'}").count() == 40 == len(files_in(tmp_path / "x"))
    for name in ("../up", "/abs", "a//b", None):
        with pytest.raises(AudioError):
            writer.safe(name)
    with pytest.raises(Exception, match="two clips of one name"):
        save(clips.limit(2).coalesce(1).withColumn("name", F.lit("same")), tmp_path / "y", codec="Wav")


def test_attempts_that_do_not_count_leave_no_double(spark, tmp_path, monkeypatch):
    """As after a speculative or repeated task, and after an executor that was lost in the middle of one."""
    import pyspark

    sink = writer.FileWriter({"path": f"file://{tmp_path}", "codec": "Wav"})
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_pylist([{"name": f"c{k}", "sample_rate": 8000, "channels": 1, "pcm": [0.5, -0.5]} for k in range(3)])
    first, second = sink.write(iter([batch])), sink.write(iter([batch]))
    (tmp_path / f"{sink.job}-00004-lost").mkdir()
    (tmp_path / f"{sink.job}-00004-lost" / "half.wav").write_bytes(b"RIFF")
    assert first.folder != second.folder and len(files_in(tmp_path)) == 7
    sink.commit([second, None])
    assert files_in(tmp_path) == [f"{second.folder}/c{k}.wav" for k in range(3)]
    assert writer.written(spark, f"file://{tmp_path}").count() == 3
    other = writer.FileWriter({"path": f"file://{tmp_path}", "codec": "Wav"})
    other.abort([other.write(iter([batch])), None])
    assert len(files_in(tmp_path)) == 3
