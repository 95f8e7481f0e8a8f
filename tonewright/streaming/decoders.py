"""Incremental decoding of chunked files with Structured Streaming.

Input rows are (stream_id, seq, bytes, is_last); output rows (stream_id, event_no, kind, info, pcm,
error) with kind header, samples, end. Chunks of a stream are put in order by seq; a gap holds back what
follows it. `is_last` marks the flush: the last partial chunk, then end.

    events = decode_stream(chunks, "Wav", idle=60).writeStream...
    decode_chunks(chunks, "Flac")          # the same machine over a batch, for tests and backfill

A stream's state is one typed row (bytes short of a chunk or a frame, the layout as text, counters) and the chunks
that came early, of which only those in turn are read. Both are cleared with the end event. Streams are dealt to a fixed number of
buckets, the keys of the state, so that calls and frames of Python are by bucket, not by stream: a stream that begins and ends in one batch costs no access to state
beside one count a bucket. A stream that
fails keeps its counters alone until its last chunk, so that what still comes is dropped. With `idle`, a timer ends streams for which no chunk
came in so many seconds: what is there is flushed, and the end event carries an error. A chunk that comes again after its
stream's end begins a stream of that id anew. Events are made as they are taken, so a feed costs its own bytes and one
piece of samples, in time linear in them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tonewright.sources import aiff, flac, wav
from tonewright.sources.errors import AudioError
from tonewright.sources.info import ERROR_TYPE, INFO_TYPE, info

CHUNK_FRAMES = 4096
PIECE = 1 << 20  # bytes searched, and samples decoded, at once
BUCKETS = 1024  # state keys; a checkpoint holds for one number only
PORTION = 64 << 20  # bytes of chunks, with 256 for each, that a call takes in hand at once
OUT = f"stream_id string, event_no long, kind string, info {INFO_TYPE}, pcm array<float>, error {ERROR_TYPE}"
STATE = "next long, events long, early long, timer long, failed boolean, layout string, left long, pending binary, ready binary, look long, crc long, crc_at long, now_at long"
EARLY = "bytes binary, is_last boolean"


def _audio_at(data: bytes | bytearray) -> int | None:
    """Where the frames of a FLAC stream begin; None if its metadata isn't all there."""
    at = 4
    while at + 4 <= len(data):
        last, at = data[at] >> 7, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        if last:
            return at if at <= len(data) else None
    return None


@dataclass
class Machine:
    """run(bytes, last) gives (kind, info, samples, error) tuples. WAV and AIFF by layout, FLAC by closed frames."""

    kind: str
    chunk: int = CHUNK_FRAMES
    pending: bytearray = field(default_factory=bytearray)  # bytes of the header, or samples short of a chunk
    found: wav.Layout | aiff.Layout | flac.StreamInfo | None = None
    left: int = 0  # bytes of samples still to come
    done: bool = False
    ready: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # decoded FLAC samples short of a chunk
    scan: flac.Scanner | None = None
    raw: bytes = b""  # STREAMINFO

    def __post_init__(self):
        self.chunk = self.chunk or CHUNK_FRAMES

    def run(self, data: bytes, last: bool = False) -> Iterator[tuple]:
        if self.done:
            return
        try:
            yield from self._flac(data, last) if self.kind == "Flac" else self._pcm(data, last)
        except AudioError as e:
            self.done = True
            yield "end", None, None, {"code": e.code, "detail": e.detail}
            return
        if last:
            self.done = True
            yield "end", None, None, None

    def feed(self, data: bytes) -> list[tuple]:
        return list(self.run(data))

    def flush(self) -> list[tuple]:
        return list(self.run(b"", True))

    def _all(self, data: bytes) -> bytes | bytearray:
        """The stream so far, while its header isn't there."""
        if self.pending or len(data) < PIECE:
            self.pending += data
            return self.pending
        return data

    def _pcm(self, data: bytes, last: bool) -> Iterator[tuple]:
        view = memoryview(data)
        if self.found is None:
            whole = self._all(data)
            found = (wav if self.kind == "Wav" else aiff).layout(whole)
            if found is None:
                if last:
                    raise AudioError("InvalidHeader", "the stream ends before its samples")
                self.pending = whole if isinstance(whole, bytearray) else bytearray(whole)
                return
            self.found = found.check()
            self.left, self.pending, view = found.declared, bytearray(), memoryview(whole)[found.start :]
            yield "header", info(self.kind, found.rate, found.channels, found.bits, found.declared // (found.width * found.channels)), None, None
        frame = self.found.width * self.found.channels
        size, at = self.chunk * frame, 0
        view = view[: self.left]
        self.left -= len(view)
        if self.pending:
            at = min(size - len(self.pending), len(view))
            self.pending += view[:at]
            if len(self.pending) == size:
                whole, self.pending = bytes(self.pending), bytearray()
                yield "samples", None, self._samples(whole), None
        while len(view) - at >= size:
            yield "samples", None, self._samples(view[at : at + size]), None
            at += size
        self.pending += view[at:]
        if last and len(self.pending) >= frame:
            yield "samples", None, self._samples(bytes(self.pending[: len(self.pending) // frame * frame])), None

    def _samples(self, raw: bytes | memoryview) -> np.ndarray:
        return np.array(self.found.samples(raw), np.float32)  # a copy: nothing keeps the feed

    def _flac(self, data: bytes, last: bool) -> Iterator[tuple]:
        view = memoryview(data)
        if self.found is None:
            whole = self._all(data)
            at = _audio_at(whole) if whole[:4] == b"fLaC" else None
            if at is None:
                if last or len(whole) >= 4 and whole[:4] != b"fLaC":
                    flac.metadata(bytes(whole))  # says what is wrong
                self.pending = whole if isinstance(whole, bytearray) else bytearray(whole)
                return
            meta = flac.metadata(bytes(whole[:at]))
            start = next(b[1] for b in meta.blocks if b[0] == 0)
            self.raw, self.found, self.scan = bytes(whole[start : start + 34]), meta.info, flac.Scanner(meta.info)
            self.pending, view = bytearray(), memoryview(whole)[at:]
            s = meta.info
            yield "header", info("Flac", s.rate, s.channels, s.bits, s.total), None, None
        # The last frame may still grow, so only frames that another header follows are closed, until the flush.
        for at in range(0, len(view), PIECE):
            yield from self._decoded(self.scan.feed(view[at : at + PIECE]))
        if last:
            yield from self._decoded(self.scan.rest(flac.Metadata(self.found, [], 0, [])))
            if len(self.ready):
                yield "samples", None, self.ready, None

    def _decoded(self, frames: list) -> Iterator[tuple]:
        """Samples of frames, of so many frames at once that they fit a piece."""
        s, some, held = self.found, [], 0
        for k, item in enumerate(frames):
            some.append(item)
            held += item[1].block * s.channels
            if held < PIECE and k + 1 < len(frames):
                continue
            own = [flac.scaled(x, s.bits).ravel() for x in flac.decode_frames(some, closed=True)]
            some, held = [], 0
            whole, size = np.concatenate([self.ready, *own]), self.chunk * s.channels
            cut = len(whole) // size * size
            self.ready = whole[cut:].copy()
            for at in range(0, cut, size):
                yield "samples", None, whole[at : at + size].copy(), None

    def saved(self) -> dict:
        """What the next feed needs, by the names of STATE."""
        layout, scan = None, self.scan
        if self.found is not None:
            layout = self.raw.hex() if self.kind == "Flac" else json.dumps(asdict(self.found))
        return {
            "layout": layout, "left": self.left, "pending": bytes(scan.data if scan else self.pending), "ready": self.ready.tobytes(),
            "look": scan.look if scan else 0, "crc": scan.crc if scan else 0, "crc_at": scan.crc_at if scan else 0, "now_at": scan.now.at if scan and scan.now else -1,
        }

    @classmethod
    def loaded(cls, kind: str, chunk: int, row: dict) -> Machine:
        m = cls(kind, chunk, pending=bytearray(row["pending"]), left=row["left"], ready=np.frombuffer(row["ready"], np.float32))
        if row["layout"] is not None and kind == "Flac":
            m.raw = bytes.fromhex(row["layout"])
            m.found = flac.streaminfo(m.raw)
            m.scan, m.pending = flac.Scanner(m.found), bytearray()
            m.scan.data, m.scan.look, m.scan.crc, m.scan.crc_at = bytearray(row["pending"]), row["look"], row["crc"], row["crc_at"]
            m.scan.now = flac.frame_header(m.scan.data, row["now_at"], m.found) if row["now_at"] >= 0 else None
        elif row["layout"] is not None:
            m.found = (wav if kind == "Wav" else aiff).Layout(**json.loads(row["layout"]))
        return m


@dataclass
class Stream:
    """Chunks in turn through a machine. early holds those that came before their turn: a dict, or the like over a state."""

    machine: Machine
    next: int = 0
    events: int = 0
    n_early: int = 0
    early: object = field(default_factory=dict)
    over: bool = False  # the last chunk was taken

    def take(self, rows: Iterable[tuple[int, bytes, bool]]) -> Iterator[tuple]:
        """Rows (seq, bytes, is_last) in any order; a seq seen before is ignored."""
        for seq, data, last in sorted(rows, key=lambda r: r[0]):
            self.over |= self.machine.done and last
            if seq < self.next or self.machine.done:
                continue
            if seq > self.next:
                if seq not in self.early:
                    self.early[seq] = data or b"", bool(last)
                    self.n_early += 1
                continue
            yield from self._one(data or b"", last)
            while self.n_early and not self.machine.done and self.next in self.early:
                self.n_early -= 1
                yield from self._one(*self.early.pop(self.next))

    def _one(self, data: bytes, last: bool) -> Iterator[tuple]:
        self.next += 1
        self.over |= bool(last)
        for event in self.machine.run(data):
            yield self._numbered(event)
        if last:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for event in self.machine.run(b"", True):
            yield self._numbered(event)

    def _numbered(self, event: tuple) -> tuple:
        self.events += 1
        return (self.events - 1, *event)


class EarlyChunks:
    """The dict of a stream's early chunks over a map state of the bucket."""

    def __init__(self, state, name: str):
        self.state, self.name = state, name

    def __contains__(self, seq: int) -> bool:
        return self.state.containsKey((self.name, seq))

    def __setitem__(self, seq: int, chunk: tuple[bytes, bool]) -> None:
        self.state.updateValue((self.name, seq), chunk)

    def pop(self, seq: int) -> tuple[bytes, bool]:
        data, last = self.state.getValue((self.name, seq))
        self.state.removeKey((self.name, seq))
        return bytes(data), last

    def clear(self) -> None:
        for name, seq in [k for k in self.state.keys() if k[0] == self.name]:
            self.state.removeKey((name, seq))


def _frame(keys: list[str], events: list[tuple]) -> pd.DataFrame:
    names = ("format", "sample_rate", "channels", "bit_depth", "duration_secs", "total_samples")
    return pd.DataFrame(
        {
            "stream_id": keys,
            "event_no": [e[0] for e in events],
            "kind": [e[1] for e in events],
            "info": [dict(zip(names, e[2].row(), strict=True)) if e[2] else None for e in events],
            "pcm": [e[3] for e in events],
            "error": [e[4] for e in events],
        }
    )


def _frames(events: Iterable[tuple[str, tuple]], most: int = PIECE) -> Iterator[pd.DataFrame]:
    """Events (stream_id, event) in frames of a bounded number of samples."""
    keys, some, held = [], [], 0
    for key, e in events:
        keys.append(key)
        some.append(e)
        held += len(e[3]) if e[3] is not None else 1
        if held >= most:
            yield _frame(keys, some)
            keys, some, held = [], [], 0
    if some:
        yield _frame(keys, some)


def _rows(pdf: pd.DataFrame) -> list[tuple[int, bytes, bool]]:
    return [(int(s), bytes(b) if b is not None else b"", bool(e)) for s, b, e in zip(pdf.seq, pdf.bytes, pdf.is_last, strict=True)]


def _portions(frames: Iterable[pd.DataFrame], most: int = PORTION) -> Iterator[dict[str, list[tuple[int, bytes, bool]]]]:
    """The chunks of each stream, of so many frames at once that they fit a portion."""
    some, held = {}, 0
    for pdf in frames:
        for key, row in zip(pdf.stream_id, _rows(pdf), strict=True):
            some.setdefault(key, []).append(row)
            held += len(row[1]) + 256
        if held >= most:
            yield some
            some, held = {}, 0
    if some:
        yield some


class Decoder(StatefulProcessor):
    """By bucket of streams: how many of them are open, the row of each open one, early chunks, and the streams to look at when a timer expires."""

    def __init__(self, kind: str, chunk: int, idle: float | None = None):
        self.kind, self.chunk, self.idle = kind, chunk, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long")
        self.state = handle.getMapState("stream", "stream_id string", STATE)
        self.early = handle.getMapState("early", "stream_id string, seq long", EARLY)
        self.due = handle.getMapState("due", "at long", "streams array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.n_open = before = self._count()
        timer = -1 if self.idle is None else timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle)
        waiting = set()
        for portion in _portions(rows):
            yield from _frames(self._taken(portion, timer, waiting))
        if waiting and self.idle is not None:
            self.handle.registerTimer(timer)
            known = self.due.getValue((timer,))[0] if self.due.containsKey((timer,)) else []
            self.due.updateValue((timer,), (sorted({*known, *waiting}),))
        self._counted(before)

    def _taken(self, portion: dict[str, list[tuple[int, bytes, bool]]], timer: int, waiting: set[str]) -> Iterator[tuple[str, tuple]]:
        for name, rows in portion.items():
            stream, known = self._loaded(name)
            for event in stream.take(rows):
                yield name, event
            if stream.machine.done and stream.over:
                self._clear(name, stream, known)
                waiting.discard(name)
            else:
                self._save(name, stream, known, timer)
                waiting.add(name)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.due.containsKey((at,)):
            return
        names = self.due.getValue((at,))[0]
        self.due.removeKey((at,))
        self.n_open = before = self._count()
        yield from _frames(self._flushed(names, at))
        self._counted(before)

    def _flushed(self, names: list[str], at: int) -> Iterator[tuple[str, tuple]]:
        for name in names:
            if not self.state.containsKey((name,)) or self._row(name)["timer"] != at:
                continue  # ended, or chunks came since
            stream, _ = self._loaded(name)
            detail = f"no chunk came for {self.idle:g} seconds" + (f"; chunk {stream.next} is missing" if stream.n_early else "")
            for e in stream.flush():
                yield name, ((*e[:4], e[4] or {"code": "EndOfStream", "detail": detail}) if e[1] == "end" else e)
            self._clear(name, stream, True)

    def _count(self) -> int:
        return self.open.get()[0] if self.open.exists() else 0

    def _counted(self, before: int) -> None:
        if self.n_open != before and self.n_open:
            self.open.update((self.n_open,))
        elif before and not self.n_open:
            self.open.clear()

    def _row(self, name: str) -> dict:
        return dict(zip([x.split(" ")[0] for x in STATE.split(", ")], self.state.getValue((name,)), strict=True))

    def _loaded(self, name: str) -> tuple[Stream, bool]:
        """The stream and whether state holds it."""
        early = EarlyChunks(self.early, name)
        if not self.n_open or not self.state.containsKey((name,)):
            return Stream(Machine(self.kind, self.chunk), early=early), False
        row = self._row(name)
        machine = Machine(self.kind, self.chunk, done=True) if row["failed"] else Machine.loaded(self.kind, self.chunk, row)
        return Stream(machine, row["next"], row["events"], row["early"], early), True

    def _save(self, name: str, stream: Stream, known: bool, timer: int) -> None:
        failed = stream.machine.done
        if failed and stream.n_early:
            stream.early.clear()
            stream.n_early = 0
        row = {"next": stream.next, "events": stream.events, "early": stream.n_early, "timer": timer, "failed": failed}
        row |= (Machine(self.kind) if failed else stream.machine).saved()
        self.state.updateValue((name,), tuple(row[x.split(" ")[0]] for x in STATE.split(", ")))
        self.n_open += not known

    def _clear(self, name: str, stream: Stream, known: bool) -> None:
        if stream.n_early:
            stream.early.clear()
        if known:
            self.state.removeKey((name,))
            self.n_open -= 1

    def close(self) -> None:
        pass


def decode_stream(chunks: DataFrame, kind: str, chunk_frames: int = CHUNK_FRAMES, idle: float | None = None) -> DataFrame:
    """Streaming; needs the RocksDB state store.

    idle: seconds after which a stream without new chunks is flushed and ended. Spark then runs batches as long as the query does, so it is for
    triggers by processing time, not for availableNow, which would not end.
    """
    mode = "None" if idle is None else "ProcessingTime"
    dealt = chunks.withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Decoder(kind, chunk_frames, idle), OUT, "Append", mode)


def decode_chunks(chunks: DataFrame, kind: str, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """The same over a batch, for tests and backfill: a stream's chunks meet in one task, and in its memory."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        events = list(Stream(Machine(kind, chunk_frames)).take(_rows(pdf)))
        return _frame([key[0]] * len(events), events)

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # an explicit number: few bytes are much work here
    return chunks.repartition(tasks, "stream_id").groupBy("stream_id").applyInPandas(one, OUT)
