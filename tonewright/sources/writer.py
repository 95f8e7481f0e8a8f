"""`df.write.format("audio_files")`: clips encoded and written as files, with commit and abort.

    spark.dataSource.register(FileSink)
    clips.select("name", "sample_rate", "channels", "pcm").write.format("audio_files").option("codec", "Flac").mode("append").save("s3://out/")

Each attempt of a task writes into a folder of its own, <path>/<job>-<partition>-<attempt>/<name>.<suffix>; what it wrote goes to the
driver with its commit message. An attempt that fails deletes its folder; the commit deletes those of attempts that didn't count (a
task that ran twice, an executor that was lost) and then writes the manifest <path>/committed-<job>.json, which lists the files of
the job, one entry a task: a folder without an entry isn't part of the result. An abort deletes all folders of the job. So a job leaves each
clip once or nothing. `written(spark, path)` lists the files of all jobs that were committed.

Columns: name (no absolute path, no `..`; unique within a task), sample_rate, channels, pcm. Options: path, codec (Wav, Aiff, Flac, Opus, Aac),
option (sample format, bit depth or bit rate). mode("overwrite") deletes what earlier jobs wrote when the new one is committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tonewright.sources import registry
from tonewright.sources.errors import AudioError

SCHEMA = "name string, sample_rate int, channels int, pcm array<float>"
COMMITTED = "committed-"
MANIFEST = "folder string, files array<struct<name: string, bytes: long>>"


@dataclass
class Wrote(WriterCommitMessage):
    folder: str
    files: list[tuple[str, int]] = field(default_factory=list)


def safe(name: str | None) -> str:
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or "\\" in name:
        raise AudioError("EncodeError", f"no name for a file: {name!r}")
    return name


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.where, self.codec, self.overwrite = options["path"], options["codec"], overwrite
        option = options.get("option")
        self.option = [] if option is None else [int(option) if option.lstrip("-").isdigit() else option]
        self.encoder = registry.ENCODERS[self.codec]
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(self.where)
        done = Wrote(f"{self.job}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}")
        folder = f"{root.rstrip('/')}/{done.folder}"
        try:
            seen: set[str] = set()
            for batch in iterator:
                for name, rate, channels, pcm in zip(*(batch.column(k).to_pylist() for k in ("name", "sample_rate", "channels")), batch.column("pcm"), strict=True):
                    path = f"{safe(name)}.{self.codec.lower()}"
                    if path in seen:
                        raise AudioError("EncodeError", f"two clips of one name: {name!r}")
                    seen.add(path)
                    samples = np.zeros(0, np.float32) if pcm.values is None else pcm.values.to_numpy(zero_copy_only=False)
                    raw = self.encoder(samples, rate, channels, *self.option)
                    store.create_dir(f"{folder}/{path}".rpartition("/")[0], recursive=True)
                    with store.open_output_stream(f"{folder}/{path}", compression=None) as out:
                        out.write(raw)
                    done.files.append((path, len(raw)))
        except BaseException:
            _drop(store, folder)
            raise
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.where)
        root = root.rstrip("/")
        counted = [m for m in messages if isinstance(m, Wrote) and m.files]
        names = {m.folder for m in counted}
        earlier = []
        for f in _below(store, root):
            if f.base_name.startswith(f"{self.job}-") and f.base_name not in names:
                _drop(store, f.path)
            elif not f.base_name.startswith(f"{self.job}-"):
                earlier.append(f)
        store.create_dir(root, recursive=True)
        rows = [{"folder": m.folder, "files": [{"name": n, "bytes": b} for n, b in m.files]} for m in counted]
        with store.open_output_stream(f"{root}/{COMMITTED}{self.job}.json", compression=None) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        if self.overwrite:
            manifests = [f for f in earlier if _is_manifest(f)]
            jobs = {f.base_name.removeprefix(COMMITTED).removesuffix(".json") for f in manifests}
            for f in manifests:  # first: from then on nothing of theirs counts
                store.delete_file(f.path)
            for f in earlier:
                if f.base_name.partition("-")[0] in jobs:
                    _drop(store, f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.where)
        for f in _below(store, root.rstrip("/")):
            if f.base_name.startswith(f"{self.job}-"):
                _drop(store, f.path)


def _below(store, root: str) -> list:
    return store.get_file_info(pafs.FileSelector(root, allow_not_found=True))


def _is_manifest(f) -> bool:
    return f.base_name.startswith(COMMITTED) and f.base_name.endswith(".json")


def _drop(store, folder: str) -> None:
    if store.get_file_info(folder).type == pafs.FileType.Directory:
        store.delete_dir(folder)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def written(spark: SparkSession, where: str) -> DataFrame:
    """path and bytes of the files of all committed jobs under where."""
    store, root = pafs.FileSystem.from_uri(where)
    manifests = [f for f in _below(store, root.rstrip("/")) if _is_manifest(f)]
    base = where.rstrip("/")
    if not manifests:
        return spark.createDataFrame([], "path string, bytes long")
    found = spark.read.schema(MANIFEST).json([f"{base}/{f.base_name}" for f in manifests])
    rows = found.select("folder", F.explode("files").alias("f"))
    return rows.select(F.concat_ws("/", F.lit(base), "folder", "f.name").alias("path"), F.col("f.bytes").alias("bytes"))
