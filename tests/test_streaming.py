import json
import os

import pytest

from loomline.plans import ast
from loomline.schema import EVENT
from loomline.streaming import realtime
from loomline.streaming.metrics import Monitor


def event(k, seq, ms):
    return {"timestamp": "t", "source": "s", "stream": None, "message": f"m{seq}", "labels": {"id": k}, "join_keys": None, "ts_ms": ms, "seq": seq}


def run(spark, tmp_path, sides, build):
    """Each side: a list of files, a file a list of events, one file of each side at a time."""
    streams = []
    for n, files in zip("ab", sides, strict=False):
        d = tmp_path / n
        d.mkdir()
        for k, rows in enumerate(files):
            (d / f"{k:03d}.json").write_text("\n".join(map(json.dumps, rows)))
            os.utime(d / f"{k:03d}.json", (1_700_000_000 + 60 * k,) * 2)  # files are taken by age
        streams.append(realtime.paced(spark, str(d), EVENT, 1))
    q = build(*streams).writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.sql(f"select * from {q.name}").collect()]


LEFT = [[event("r1", 1, 1000), event("r2", 2, 1000)], [event("r3", 3, 2000)], [event("zz", 9, 10_000_000)], [event("zz", 10, 10_000_001)]]
RIGHT = [[event("r2", 11, 1500)], [event("r1", 12, 2500), event("r2", 13, 2600)], [event("yy", 19, 10_000_000)], [event("yy", 20, 10_000_001)]]


def test_live_join_emits_once_in_order_of_completion(spark, tmp_path):
    got = run(spark, tmp_path, (LEFT, RIGHT), lambda a, b: realtime.join(a, b, ast.Join("and", ("id",)), live=True))
    assert got == [("r2", "complete", 1, 1, [2, 11]), ("r1", "complete", 1, 1, [1, 12])]


@pytest.mark.parametrize(("kind", "want"), [("or", {("r1", "partial", 1, 0), ("r2", "partial", 1, 0), ("r3", "partial", 1, 0)}), ("unless", {("r1", "complete", 1, 1), ("r2", "complete", 1, 1), ("r3", "partial", 1, 0)})])
def test_live_kinds(spark, tmp_path, kind, want):
    """`or` answers at the first event; `unless` tells matches at once and the unmatched when their time is over."""
    got = run(spark, tmp_path, (LEFT, RIGHT), lambda a, b: realtime.join(a, b, ast.Join(kind, ("id",)), late_ms=5_000, live=True))
    assert {r[:4] for r in got if r[0].startswith("r")} == want and len([r for r in got if r[0].startswith("r")]) == 3


def test_live_state_is_dropped(spark, tmp_path):
    """After an answer no event of the value is kept: one event of each side was, and a thousand more add nothing."""
    left = [[event("r1", 1, 1000)], [event("r1", 100 + i, 1001) for i in range(1000)]]
    q = []

    def build(a, b):
        return realtime.join(a, b, ast.Join("and", ("id",)), live=True)

    class Seen(Monitor):
        def onQueryProgress(self, e):
            q.extend(s.numRowsTotal for s in e.progress.stateOperators)

    m = Seen(lambda *_: None)
    spark.streams.addListener(m)
    assert run(spark, tmp_path, (left, [[event("r1", 2, 1000)], []]), build) == [("r1", "complete", 1, 1, [1, 2])]
    spark.streams.removeListener(m)
    assert not q or max(q) < 10


def test_lateness_by_arrival(spark, tmp_path):
    """With the clock of arrival an event is late if its value came first over late_ms ago."""
    from types import SimpleNamespace

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v
        update = lambda self, v: setattr(self, "v", v)
        clear = lambda self: setattr(self, "v", None)

    class Items(list):
        get = lambda self: iter(self)
        appendList = lambda self, x: self.extend(x)  # noqa: E731,N815

    timers = []
    handle = SimpleNamespace(getListState=lambda *_: Items(), getValueState=lambda *_: Value(), registerTimer=timers.append)
    at = lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)
    row = lambda side, seq: SimpleNamespace(stream_idx=side, seq=seq, ts_ms=1, message="")
    for second, want in ((100, 0), (40, 1)):
        j = realtime._Join("and", True, 50, "processing")
        j.init(handle)
        assert list(j.handleInputRows(("k",), iter([row(0, 1)]), at(10))) == []
        assert len(list(j.handleInputRows(("k",), iter([row(1, 2)]), at(10 + second)))) == want
    assert timers == [60, 60]


def test_sessions(spark, tmp_path):
    rows = [[event("a", 1, 1000), event("a", 2, 3000), event("a", 3, 20_000), event("b", 4, 2000)], [event("z", 9, 10_000_000)], [event("z", 10, 10_000_001)]]
    got = run(spark, tmp_path, (rows,), lambda a: realtime.session_counts(a, "5 seconds", "id", late_ms=1))
    assert sorted((r[1], r[2]) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("kind", ["and", "or", "unless"])
def test_settled_join(spark, tmp_path, kind):
    got = run(spark, tmp_path, (LEFT, RIGHT), lambda a, b: realtime.join(a, b, ast.Join(kind, ("id",)), late_ms=5_000))
    want = {"and": {"r1", "r2"}, "or": {"r1", "r2", "r3"}, "unless": {"r3"}}[kind]
    assert {r[0] for r in got if r[0].startswith("r")} == want
    assert all(r[1:4] == ("complete", 1, 2) for r in got if r[0] == "r2")


def test_dedup_and_windows(spark, tmp_path):
    same = [[event("a", 1, 1000) | {"message": "x"}, event("a", 2, 1500) | {"message": "x"}, event("a", 3, 1500) | {"message": "y"}]]
    assert sorted(r[3] for r in run(spark, tmp_path, (same,), lambda a: realtime.dedup(a))) == ["x", "y"]
    (tmp_path / "w").mkdir()
    got = run(spark, tmp_path / "w", (LEFT,), lambda a: realtime.window_counts(a, "10 seconds", late_ms=1))
    assert sorted(r[2] for r in got) == [3]


def test_monitor():
    class Progress:
        numInputRows, processedRowsPerSecond, batchDuration, stateOperators = 200, 5.0, 500, []

    class Event:
        progress = Progress

    seen = []
    Monitor(lambda e, d: seen.append(e)).onQueryProgress(Event)
    assert seen == ["metrics", "highLatency", "lowThroughput"]
