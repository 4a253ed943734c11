"""Joins against a plain reading of their rules, on random events with ties, empty labels, missing keys and duplicates."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import correlate
from loomline.operators.keys import key
from loomline.operators.predicates import parse_filter
from loomline.plans import ast
from loomline.schema import EVENT, events


def make(seed, n=60, source="s"):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        labels = {k: rnd.choice(["a", "b", "c", "", "d"]) for k in ("x", "y") if rnd.random() < 0.7} | {"status": rnd.choice(["200", "404"])}
        keys = {"x": rnd.choice(["a", "b", ""])} if rnd.random() < 0.3 else None
        ms = None if rnd.random() < 0.05 else 1000 * rnd.randrange(40)
        out.append(("t" if ms is None else f"2024-01-01T00:00:{ms // 1000:02d}.000Z", source, f"st{i % 3}", f"m{i}", labels, keys, ms, i + 1000 * seed))
    return out


def value(e, names):
    for n in names:
        for m in (e[4], e[5] or {}):
            if m.get(n):
                return m[n]
    return None


def groups(streams, names):
    out = {}
    for i, s in enumerate(streams):
        for e in s:
            if v := value(e, names):
                out.setdefault(v, [[] for _ in streams])[i].append(e)
    return out


def near(g, ms):
    ok = lambda e, o: e[6] is not None and o[6] is not None and abs(e[6] - o[6]) <= ms
    return [[e for e in g[0] if any(ok(e, o) for o in g[1])], [e for e in g[1] if any(ok(e, o) for o in g[0])]]


def two(left, right, join, keep=lambda e: True):
    out = []
    names = [n for m in join.mappings for n in m] + list(join.keys)
    for v, g in groups([left, right], names).items():
        if join.within and join.kind == "and" and all(g):
            g = near(g, int(join.within[:-1]) * 1000)
        decided = {"and": g[0] and g[1], "or": g[0], "unless": g[0] and not g[1]}[join.kind]
        ev = [e for s in g for e in s if keep(e)]
        if decided and ev:
            out.append((v, "complete" if g[0] and g[1] else "partial", sorted(e[7] for e in ev)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["and", "or", "unless"])
@pytest.mark.parametrize("within", [None, "3s"])
def test_two_way(spark, kind, within):
    left, right = make(1), make(2)
    a, b = (spark.createDataFrame(x, EVENT) for x in (left, right))
    for join in (ast.Join(kind, ("x",), within=within), ast.Join(kind, ("x", "y"), within=within), ast.Join(kind, ("q",), (("q", "y"),), within=within)):
        for text, keep in ((None, lambda e: True), ('{status="404"}', lambda e: e[4]["status"] == "404"), ('{x!~"a|b"}', lambda e: not e[4].get("x") or e[4]["x"] not in "ab")):
            out = correlate.two_way(a, b, join, parse_filter(text) if text else None)
            got = sorted((r.join_value, r.metadata.completeness, sorted(int(e.message[1:]) for e in r.events)) for r in out.collect())
            want = [(v, c, sorted(s % 1000 for s in seqs)) for v, c, seqs in two(left, right, join, keep)]
            assert got == want


def test_order_and_ids(spark):
    a, b = (spark.createDataFrame(make(i, source=f"s{i}"), EVENT) for i in (1, 2))
    rows = correlate.two_way(a, b, ast.Join("or", ("x",)), ids="counter").collect()
    assert sorted(r.correlation_id for r in rows) == sorted(f"corr_{i + 1}" for i in range(len(rows)))
    for r in rows:
        times = [e.timestamp if e.timestamp != "t" else "" for e in r.events]
        assert times == sorted(times) and r.join_key == "x" and r.time_window.end == r.events[-1].timestamp
        assert r.metadata.matched_streams == list(dict.fromkeys(e.source for e in r.events))


@pytest.mark.parametrize("kind", ["and", "or", "unless"])
@pytest.mark.parametrize("within", [None, "9s"])
def test_multi_way(spark, kind, within):
    streams = [make(i, 25) for i in (3, 4, 5)]
    join = ast.Join(kind, ("y",), within=within)
    got = correlate.multi_way([spark.createDataFrame(s, EVENT) for s in streams], ["l", "g", "l"], join, parse_filter('{status="404",x!="a"}'), "summary").collect()
    want = []
    for v, g in groups(streams, ["y"]).items():
        there = [bool(s) for s in g]
        ev = [e for s in g for e in s]
        if within:
            timed = [e for e in ev if e[6] is not None]
            ev = [e for e in timed if e[6] - min(x[6] for x in timed) <= 9000]
        decided = {"and": all(there), "or": True, "unless": sum(there) == 1}[kind]
        if decided and any(e[4]["status"] == "404" for e in ev) and any(e[4].get("x") != "a" for e in ev):
            want.append((v, "complete" if all(there) else "partial", ",".join(n for n, t in zip("lgl", there, strict=True) if t), len(ev), sum(e[7] for e in ev)))
    assert sorted((r.join_value, r.completeness, r.matched_streams, r.n_events, r.seq_sum) for r in got) == sorted(want)


@pytest.mark.parametrize("side", ["left", "right"])
def test_grouped(spark, side):
    left, right = make(6, 20), make(7, 30)
    out = correlate.two_way(*(spark.createDataFrame(x, EVENT) for x in (left, right)), ast.Join("and", ("x",), side=side)).collect()
    g = groups([left, right], ["x"])
    want = sorted((v, 1 + len(s[1 if side == "left" else 0])) for v, s in g.items() if all(s) for _ in s[0 if side == "left" else 1])
    assert sorted((r.join_value, len(r.events)) for r in out) == want


def test_composite_key_without_names(spark):
    rows = [("t", "s", None, "m", {"a": "1", "b": "2", "e": ""}, {"b": "3"}, 1, 1), ("t", "s", None, "m", {"z": "1"}, None, 1, 2), ("t", "s", None, "m", {}, None, 1, 3)]
    df = spark.createDataFrame(rows, EVENT)
    assert [r[0] for r in df.select(key(ast.Join("and", (), ignoring=("z",)))).collect()] == ["a:1,b:3", None, None]


def test_empty_streams(spark):
    none = spark.createDataFrame([], EVENT)
    some = spark.createDataFrame(make(1), EVENT)
    for output in correlate.OUTPUTS:
        assert correlate.two_way(none, some, ast.Join("and", ("x",)), output=output).count() == 0
        assert correlate.multi_way([none] * 3, list("abc"), ast.Join("or", ("x",)), output=output).count() == 0
    assert events(spark.createDataFrame([("2024-01-01T00:00:00Z", 1)], "timestamp string, extra int")).first().ts_ms == 1_704_067_200_000


def test_long_matches_nested(spark):
    a, b = (spark.createDataFrame(make(i), EVENT) for i in (1, 2))
    join = ast.Join("and", ("x",), within="3s")
    nested = correlate.two_way(a, b, join).select("join_value", F.size("events").alias("n"))
    long = correlate.two_way(a, b, join, output="long").groupBy("join_value").agg(F.count("*").cast("int").alias("n"))
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, long.collect()))
