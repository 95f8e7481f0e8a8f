"""What streams cost beside their bytes: tasks of small files, and accesses to state."""

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from tonewright.sources import wav
from tonewright.sources.chunks import ChunkReader
from tonewright.streaming import decoders


def test_small_files_share_tasks_and_long_ones_are_cut(tmp_path):
    sizes = {f"{k:03}.wav": 100 + k for k in range(300)} | {"long.wav": 2000, "none.wav": 0}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(k % 251 for k in range(n)))
    reader = ChunkReader({"path": f"file://{tmp_path}", "chunkBytes": "64", "closed": "true"})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= 3
    found = {}
    for batch in (b for p in parts for b in reader.read(p)):
        for row in batch.to_pylist():
            found.setdefault(row["stream_id"], []).append((row["seq"], row["bytes"], row["is_last"]))
    for name, n in sizes.items():
        rows = sorted(found.pop(name))
        assert b"".join(r[1] for r in rows) == bytes(k % 251 for k in range(n))
        assert [r[0] for r in rows] == list(range(n // 64 + 1)) and [r[2] for r in rows] == [False] * (n // 64) + [True]
    assert found == {}
    reader.most = 640
    assert sum(any(f[0] == "long.wav" for f in p.files) for p in reader.partitions({}, reader.latestOffset())) == 4


class Counted:
    """A value or map state that counts what is asked of it."""

    asked = 0

    def __init__(self):
        self.rows, self.value = {}, None

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "getValue", "containsKey", "updateValue", "removeKey", "keys"):
            Counted.asked += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None
        self.rows.clear()

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))


class Handle(StatefulProcessorHandle):
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, Counted())

    def getMapState(self, name, key, value, ttl=None):
        return self.states.setdefault(name, Counted())


def test_streams_that_end_in_their_batch_cost_no_access_to_state(monkeypatch):
    raw = wav.encode([k / 100 for k in range(90)], 8000, 1, "I16")
    chunks = [(f"s{k}", i, raw[at : at + 50], at + 50 >= len(raw)) for k in range(200) for i, at in enumerate(range(0, len(raw), 50))]
    frame = lambda rows: pd.DataFrame(rows, columns=["stream_id", "seq", "bytes", "is_last"])
    handle, decoder = Handle(), decoders.Decoder("Wav", 40)
    decoder.init(handle)
    Counted.asked = 0
    events = pd.concat(decoder.handleInputRows((1,), iter([frame(chunks[::-1])]), None))
    assert Counted.asked <= 4
    assert events.groupby("stream_id").kind.agg(list).map(tuple).to_dict() == {f"s{k}": ("header", "samples", "samples", "samples", "end") for k in range(200)}
    # in two batches and in small portions, with chunks that come early: the same events, and nothing stays
    monkeypatch.setattr(decoders._portions, "__defaults__", (1000,))
    early = chunks[::3]
    made = [f for rows in (early[::-1], [c for c in chunks if c not in early]) for f in decoder.handleInputRows((1,), (frame(rows[i : i + 7]) for i in range(0, len(rows), 7)), None)]
    again = pd.concat(made).sort_values(["stream_id", "event_no"])
    want = events.sort_values(["stream_id", "event_no"])
    assert again[["stream_id", "event_no", "kind"]].values.tolist() == want[["stream_id", "event_no", "kind"]].values.tolist()
    assert all((a is None and b is None) or list(a) == list(b) for a, b in zip(again.pcm, want.pcm, strict=True))
    assert all(s.value is None and not s.rows for s in handle.states.values())
