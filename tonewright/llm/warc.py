"""WARC records in seekable Zstandard bundles, and back.

A bundle is a row of independent Zstandard frames of whole records, closed by a skippable frame
with the seek table of the public seekable format (sizes of each frame, then the number of frames
and a magic number). The index maps a record to its bundle, frame and offset within the
decompressed frame, so one record is read by decompressing one frame.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a
response and the others are revisits that name it; smaller payloads are always responses. If rows
repeat that largest page_id with the same payload, all of these are responses. A null page_id is
below any other. A null html or url is empty. A long payload is a frame of its own, held once in
memory. An empty table gives no bundle and an empty index. Other columns are ignored.

A payload that very many pages share is counted by partial aggregates; the pages that revisit it
meet its one row in a join that adaptive execution splits.

Bundles are written to the shared folder through Arrow's file systems, under names that no other
attempt of the task uses; the index lists those of the attempts that succeeded, so a lost executor
or a repeated task leaves at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.storage import fresh, settled

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
MOST_TASKS = 20_000
INDEX = "page_id long, bundle string, frame long, frame_at long, frame_bytes long, within long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(page_id, url, html: bytes, kind: str, refers_to, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(html)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Groups records into frames; close() appends the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.pending, self.size, self.at = [], 0, 0
        self.places: list[list] = []  # key, frame, frame_at, frame_bytes, within, length

    def add(self, key, record: bytes) -> None:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._end_frame()
        self.places.append([key, len(self.table), self.at, 0, self.size, len(record)])
        self.pending.append(record)
        self.size += len(record)

    def _end_frame(self) -> None:
        if self.pending:
            frame = self.zstd.compress(b"".join(self.pending))
            self.out.write(frame)
            for p in reversed(self.places):
                if p[1] != len(self.table):
                    break
                p[3] = len(frame)
            self.table.append((len(frame), self.size))
            self.at += len(frame)
            self.pending, self.size = [], 0

    def close(self) -> list[list]:
        self._end_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        return self.places


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, bytes) of each frame, from the end of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    raw, at, out = file.read(n * width), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *rest = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        n = int(head["content-length"])
        yield head, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _described(head: dict[str, str], block: bytes) -> tuple:
    """The row of a record; a response's payload is measured and held against its digest."""
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    n = int(head["x-payload-length"])
    if head["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (n, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    number = lambda k: int(head[k]) if head.get(k) else None
    return number("x-page-id"), n, digest, head["warc-type"], number("x-refers-to-page")


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id and refers_to of the pages that are revisits."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    seen = settled(
        pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= least),
        "digests",
    )
    first = seen.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return (
        seen.join(first, ["digest", "n"])
        .filter("NOT page_id <=> refers_to")
        .select(F.col("page_id").alias("revisit_id"), "digest", "refers_to")
        .distinct()
    )


def write_bundles(pages: DataFrame, where: str, least: int = 1000, date: str = "2020-01-01T00:00:00Z", bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the bundles and returns their index (settled), one row a record."""
    revisits = settled(roles(pages, least), "revisits")
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = (
        pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"), digest.alias("digest"))
        .join(
            revisits.withColumnRenamed("digest", "revisit_digest"),
            F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")),
            "left",
        )
        .select("page_id", "url", "html", "revisit_digest", "refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        writer, path, size = None, "", 0

        def index():
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5)
            names = [x.split()[0] for x in INDEX.split(", ")]
            places = [(p[0], f"{where}/{path}", *p[1:]) for p in writer.close()]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in places], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for page_id, url, html, revisit, to in zip(*[batch.column(k) for k in range(5)], strict=True):
                if writer is None:
                    path, size = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{path}", compression=None), frame_bytes)
                kind = "revisit" if revisit.is_valid else "response"
                record = _record(page_id.as_py(), url.as_py(), html.as_py(), kind, to.as_py(), date)
                writer.add(page_id.as_py(), record)
                size += len(record)
                if size >= bundle_bytes:
                    yield index()
                    writer = None
        if writer is not None:
            yield index()

    return settled(rows.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """The records of every bundle in the index, read frame by frame through the seek tables."""
    frames = settled(index.groupBy("bundle").agg(F.count("*").alias("n")), "bundles")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for bundle, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(bundle)
                seen = 0
                with fs.open_input_file(path) as file:
                    for at, packed, plain in seek_table(file):
                        file.seek(at)
                        raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                        rows = [_described(*x) for x in parse(raw)]
                        seen += len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                if seen != n:
                    raise ValueError(f"{bundle} has {seen} records; the index has {n}")

    tasks = min(max(frames.count(), 1), MOST_TASKS)  # dealt in turn, and an explicit number isn't coalesced
    return frames.repartition(tasks).mapInArrow(read, RECORD)


def read_record(place) -> tuple[dict[str, str], bytes]:
    """Header and block of one record, from its row of the index: one seek, one frame."""
    import zstandard

    fs, path = pafs.FileSystem.from_uri(place["bundle"])
    with fs.open_input_file(path) as file:
        file.seek(place["frame_at"])
        raw = zstandard.ZstdDecompressor().stream_reader(file.read(place["frame_bytes"])).read()
    return next(parse(raw[place["within"] : place["within"] + place["length"]]))


def archive(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages as bundles in the shared folder and returns the records read back."""
    index = write_bundles(pages, fresh(spark, "warc"), least)
    return read_bundles(index)
