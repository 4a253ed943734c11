import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomline.engine import Engine, Options, normalise
from loomline.errors import CorrelationError
from loomline.operators import store
from loomline.schema import EVENT
from loomline.sources import decoders
from loomline.sources.base import EventSource

from . import oracle

SF = "/root/testdata/sf0.001"


def test_registered_queries_against_sql(spark):
    con, core = oracle.connect(SF), {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
    sql = entry.oracle_sql()
    assert len(core) >= 90 and set(core) == set(sql) - {n for n in sql if n.startswith("op")}
    for name, query in core.items():
        if name in sql:
            names, got, want_names, want = oracle.both(spark, con, query, sql[name], SF)
            assert (name, names, got) == (name, want_names, want)
    assert entry.entry(spark).count() > 0


def test_pushdown(spark):
    from loomline.queries import engine

    df = engine(spark, SF).correlate('events({event_type="error"})[1d] and on(user_id) events({event_type="purchase"})[1d]')
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(event_type,error)" in plan and "GreaterThan(ts," in plan
    assert plan.split("Physical Plan")[1].count("Exchange hashpartitioning") == 1


def row(k, t, source="s", **labels):
    return (f"2024-01-01T00:00:{t:02d}.000Z", source, None, "m", {"request_id": k, **labels}, None, None, t)


def test_engine(spark):
    seen = []
    e = Engine(Options())
    e.on("adapterAdded", seen.append)
    e.on("correlationFound", seen.append)
    e.add_source("A", EventSource(spark.createDataFrame([row("r1", 1, level="error"), row("r2", 2)], EVENT).withColumn("ts_ms", F.lit(1))))
    e.add_source("b", EventSource(spark.createDataFrame([row("r1", 3)], EVENT).withColumn("ts_ms", F.lit(1))))
    told = []
    e.on("performanceMetrics", told.append)
    e.on("memoryWarning", told.append)
    e.options.max_memory_mb = 0
    assert e.emit("a({})[5m] and on(request_id) b({})[5m]") == 1 and len(seen) == 3
    assert told[0]["correlations"] == 1 and told[1]["used_mb"] > 0
    assert e.validate("a({})[5m] and on(k) b({})[5m]") and not e.validate("a({})[5m]")
    assert e.available() == {"A": ["level", "request_id"], "b": ["request_id"]}
    for code, do in (("ADAPTER_EXISTS", lambda: e.add_source("A", None)), ("ADAPTER_NOT_FOUND", lambda: e.correlate("zz({})[5m] and on(k) b({})[5m]"))):
        with pytest.raises(CorrelationError) as err:
            do()
        assert err.value.code == code
    assert normalise('a  b\n"c  d"') == 'a b "c  d"'


def test_query_rules():
    assert decoders.step_seconds(86_400_000) == 864 and decoders.step_seconds(60_000) == 15
    assert decoders.rewrite_graylog('service="api"  and level=\'x\' or y') == "service:api AND level:x OR y"
    for q, want in (("*", ""), ("* a:1", "a:1"), ("a: AND b:1", "a:* AND b:1"), ('a:"" AND b:1', "a AND b:1"), ("a:1 :b", "a:1"), ("AND", "")):
        assert decoders.sanitize_graylog(q) == want
    assert decoders.split_metric('up{a="b"}') == ("up", '{a="b"}') and decoders.graylog_range_ms("bad") == 300_000
    with pytest.raises(CorrelationError):
        decoders.prometheus_range_ms("5x")
    assert decoders.valid_loki('{a="b"}') and not decoders.valid_loki("{}") and decoders.valid_prometheus("up{}") and not decoders.valid_prometheus("rate(up)")
    assert decoders.stream_id([{"title": "Main", "id": "7"}], "main") == "7" and decoders.stream_id([], "x") is None


def test_store(spark):
    s = store.EventStore(spark.createDataFrame([row("r1", t) for t in range(5)], EVENT).withColumn("ts_ms", F.col("seq")))
    assert s.time_range(1, 3).count() == 3 and s.prune(3).df.count() == 2 and s.lookup("request_id", "r1").count() == 5
    assert s.count_lookup("request_id", "r1") and not s.count_lookup("request_id", "zz") and s.hit_rate() == 0.5
    kept = store.dedup(s.df.withColumn("timestamp", F.lit("t")), window_ms=2)
    assert sorted(r.seq for r in kept.collect()) == [0, 2, 4]
    assert store.is_expired(11, 5, 5) and not store.is_expired(10, 5, 5)


def test_downsample_reads_its_events_once(spark):
    """An order of arrival that every evaluation numbers anew, as after a shuffle, loses no series."""
    seq = F.udf(lambda: int.from_bytes(os.urandom(5), "big"), "long").asNondeterministic()
    df = spark.range(4000).select(
        F.lit("t").alias("timestamp"), F.lit("promql").alias("source"), F.lit("m").alias("stream"), F.col("id").cast("string").alias("message"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("labels"),
        F.create_map(F.lit("user"), (F.col("id") % 50).cast("string")).alias("join_keys"), F.when(F.col("id") < 3900, F.col("id") * 15).alias("ts_ms"), seq().alias("seq"),
    )
    got = decoders.downsample(df, 15)
    assert got.schema.names == EVENT.names
    users = {(i % 50, i * 15 // 15000): i for i in range(3900)}  # the last of each user and step
    out = [(int(r.message), r.ts_ms, r.labels["n"]) for r in got.collect()]
    assert sorted(x for x in out if x[1] is not None) == sorted((i, i * 15, str(i)) for i in users.values())
    assert {x[0] % 50 for x in out if x[1] is None} == set(range(50)) and len(out) == len(users) + 50
