"""Registered queries over the driver's tables, each with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Options
from .errors import CorrelationError
from .functions import text, times
from .operators import correlate, store
from .plans import ast, tooling
from .plans.parser import parse
from .schema import EVENT
from .sources import decoders
from .sources.base import EventSource, TableSource
from .streaming import realtime
from .streaming.folders import shared_folder
from .streaming.metrics import Monitor

#: The end of all ranges over the driver's tables, which end in January 2024.
AS_OF = 1_706_745_600_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_source(spark: SparkSession, sf_dir: str, more: bool = False) -> TableSource:
    """more: labels with dots and dashes in their names, and one of few events."""
    df = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    uid = F.col("user_id").cast("string")
    labels = {"event_type": F.col("event_type"), "user_id": uid, "k": k, "bucket": (F.col("user_id") % 7).cast("string"), "uid": uid, "big": F.when(F.col("value") > 100, "yes")}
    if more:
        labels |= {"event-type": F.col("event_type"), "user.id": uid, "signup7": F.when((F.col("event_type") == "signup") & (k == "7"), "yes")}
    said = F.concat(F.lit("request_id=req-"), uid, F.lit(" level="), F.col("event_type"))
    return TableSource(df, "events", labels, F.col("ts"), said, F.col("event_type"), F.col("event_id"))


def order_source(spark: SparkSession, sf_dir: str) -> TableSource:
    df = load(spark, sf_dir, "orders")
    labels = {"custkey": F.col("o_custkey").cast("string"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    return TableSource(df, "orders", labels, F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey"))


def customer_source(spark: SparkSession, sf_dir: str) -> TableSource:
    df = load(spark, sf_dir, "customer")
    labels = {"c_id": F.col("c_custkey").cast("string"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string")}
    return TableSource(df, "customers", labels, F.lit("2024-01-01").cast("timestamp_ntz"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"))


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    e = Engine(Options(output="summary", as_of_ms=AS_OF, **options))
    e.add_source("events", event_source(spark, sf_dir))
    e.add_source("orders", order_source(spark, sf_dir))
    e.add_source("customers", customer_source(spark, sf_dir))
    return e


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = " ".join(sql.split()) if "--" not in sql else sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Joins. EV: the events as every query sees them.

_EV = """ev AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, CAST(user_id AS VARCHAR) AS uid, event_type,
  json_extract_string(props, '$.k') AS k, user_id % 7 AS bucket, value FROM events)"""
_SUMS = "CAST(count(*) AS BIGINT) AS n_events, min(ms) AS first_ms, max(ms) AS last_ms, CAST(sum(seq) AS BIGINT) AS seq_sum"
_SIDES = "CAST(count(*) FILTER (side = 0) AS BIGINT) AS n_left, CAST(count(*) FILTER (side = 1) AS BIGINT) AS n_right"
_BOTH = "count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0"
_COMPLETE = f"CASE WHEN {_BOTH} THEN 'complete' ELSE 'partial' END AS completeness"

_LEFT, _RIGHT = "event_type = 'error'", "event_type = 'purchase'"


def _two(kind: str, keep: str = "TRUE", left: str = _LEFT, right: str = _RIGHT, key: str = "uid", near: str = "") -> str:
    decided = {"and": _BOTH, "or": "count(*) FILTER (side = 0) > 0", "unless": "count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) = 0"}[kind]
    return f"""WITH {_EV}, t AS (SELECT *, {key} AS join_value, 0 AS side FROM ev WHERE {left} UNION ALL SELECT *, {key}, 1 FROM ev WHERE {right}) {near}
      SELECT join_value, {_COMPLETE}, {_SIDES}, CAST(count(*) FILTER ({keep}) AS BIGINT) AS n_events, min(ms) FILTER ({keep}) AS first_ms, max(ms) FILTER ({keep}) AS last_ms,
      CAST(sum(seq) FILTER ({keep}) AS BIGINT) AS seq_sum FROM {"n" if near else "t"} WHERE join_value IS NOT NULL GROUP BY join_value HAVING {decided} AND count(*) FILTER ({keep}) > 0"""


_L, _R = 'events({event_type="error"})[31d]', 'events({event_type="purchase"})[31d]'


def _say(name: str, query: str, sql: str, **options) -> None:
    register(name, sql)(lambda spark, d: engine(spark, d, **options).correlate(query))


_say("join_and", f"{_L} and on(user_id) {_R}", _two("and"))
_say("join_or", f"{_L} or on(user_id) {_R}", _two("or"))
_say("join_unless", f'{_L} unless on(user_id) events({{event_type="signup",big="yes"}})[31d]', _two("unless", right="event_type = 'signup' AND value > 100"))
_NEAR = ", n AS (SELECT * FROM t WHERE EXISTS (SELECT 1 FROM t o WHERE o.join_value = t.join_value AND o.side <> t.side AND abs(o.ms - t.ms) <= 43200000))"
_say("join_within", f"{_L} and on(user_id) within(12h) {_R}", _two("and", near=_NEAR))
_say("join_within_or_ignored", f"{_L} or on(user_id) within(12h) {_R}", _two("or"))
_say("filter_event", f'{_L} and on(user_id) {_R} {{event_type="purchase"}}', _two("and", "event_type = 'purchase'"))
_say("filter_regex", f'{_L} or on(user_id) {_R} {{event_type=~"rr|urch",k!="2"}}', _two("or", "regexp_matches(event_type, 'rr|urch') AND k <> '2'"))
_say("filter_missing_label", f'{_L} and on(user_id) {_R} {{big!="yes"}}', _two("and", "NOT coalesce(value > 100, FALSE)"))
_say("filter_absent_label", f'{_L} and on(user_id) {_R} {{nothing="x"}}', _two("and", "FALSE"))
_say("filter_bad_pattern", f'{_L} and on(user_id) {_R} {{event_type!~"[invalid"}}', _two("and"))
_say("key_coalesce", f"{_L} and on(missing, bucket) {_R}", _two("and", key="CAST(bucket AS VARCHAR)"))
_say("key_composite", f"{_L} and on(user_id, bucket) {_R}", _two("and", key="uid || ',' || bucket"), on_mode="composite")
_say("key_mapping", f"{_L} and on(absent=user_id) {_R}", _two("and"))


def _grouped(one: int, keep: str = "TRUE") -> str:
    return f"""WITH {_EV}, t AS (SELECT *, uid AS join_value, 0 AS side FROM ev WHERE {_LEFT} UNION ALL SELECT *, uid, 1 FROM ev WHERE {_RIGHT})
      SELECT a.join_value, a.seq AS one_seq, CAST(count(*) AS BIGINT) AS n_many, CAST(count(*) + 1 AS BIGINT) AS n_events, least(a.ms, min(b.ms)) AS first_ms, greatest(a.ms, max(b.ms)) AS last_ms,
      CAST(sum(b.seq) + a.seq AS BIGINT) AS seq_sum FROM t a JOIN t b ON a.join_value = b.join_value AND b.side <> a.side WHERE a.side = {one} GROUP BY a.join_value, a.seq, a.ms"""


_say("join_group_left", f"{_L} and on(user_id) within(1s) group_left(k) {_R}", _grouped(0))
_say("join_group_right", f"{_L} and on(user_id) group_right() {_R}", _grouped(1))
_say("label_mapping", 'orders({status="F"})[99999d] and on(custkey=c_id) customers({segment=~"AUTO.*|BUILDING"})[99999d]', """
  WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS join_value, 0 AS side, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ms FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, c_custkey, 1704067200000 FROM customer WHERE regexp_full_match(c_mktsegment, 'AUTO.*|BUILDING'))
  SELECT join_value, """ + f"{_COMPLETE}, {_SIDES}, {_SUMS} FROM t GROUP BY join_value HAVING {_BOTH}")  # fmt: skip

_T = ("event_type = 'error'", "event_type = 'purchase'", "event_type = 'click'")
_MULTI = 'events({event_type="error"})[31d] %s on(user_id) %s events({event_type="purchase"})[31d] and on(k) events({event_type="click"})[31d] %s'


def _many(kind: str, within: int | None = None, passed: str = "TRUE", more: str = "") -> str:
    n = [f"max(n{i})" for i in range(3)]
    decided = {"and": " AND ".join(f"{x} > 0" for x in n), "or": "TRUE", "unless": " + ".join(f"CAST({x} > 0 AS INT)" for x in n) + " = 1"}[kind]
    names = ", ".join(f"CASE WHEN {x} > 0 THEN 'events' END" for x in n)
    u = " UNION ALL ".join(f"SELECT *, uid AS join_value, {i} AS side FROM ev WHERE {w} {more}" for i, w in enumerate(_T))
    counts = ", ".join(f"count(*) FILTER (side = {i}) OVER (PARTITION BY join_value) AS n{i}" for i in range(3))
    cut = f"WHERE ms - lo <= {within}" if within is not None else ""
    return f"""WITH {_EV}, t AS ({u}), w AS (SELECT *, {counts}, min(ms) OVER (PARTITION BY join_value) AS lo FROM t)
      SELECT join_value, CASE WHEN {" AND ".join(f"{x} > 0" for x in n)} THEN 'complete' ELSE 'partial' END AS completeness, concat_ws(',', {names}) AS matched_streams, {_SUMS}
      FROM w {cut} GROUP BY join_value HAVING ({decided}) AND {passed}"""


_say("multi_and", _MULTI % ("and", "", ""), _many("and"))
_say("multi_or", _MULTI % ("or", "", ""), _many("or"))
_say("multi_unless", (_MULTI % ("unless", "", "")).replace('"})', '",big="yes"})'), _many("unless", more="AND value > 100"))
_say("multi_within", _MULTI % ("or", "within(2d)", ""), _many("or", 172_800_000))
_say("filter_one_event", _MULTI % ("or", "within(1h)", '{event_type="click",k=~"^1"}'), _many("or", 3_600_000, passed="bool_or(event_type = 'click' AND k LIKE '1%')"), one_event=True)
_say("filter_lenient", f"{_L} and on(user_id) {_R} {{event_type='purchase',k!=\"2\",bucket=some}}", _two("and", "k <> '2'"), strict=True)
_say("key_on_and_ignoring", f"{_L} and on(user_id) ignoring(k, bucket) {_R}", _two("and"))
_say("filter_correlation", _MULTI % ("or", "", '{event_type="click",k!~"2"}'), _many("or", passed="bool_or(event_type = 'click') AND bool_or(NOT regexp_matches(k, '2'))"))


def _typed(spark: SparkSession, d: str, query: str) -> DataFrame:
    sel = parse(f"e({query})[31d] and on(x) e({{}})[1s]").streams[0].selector
    out = event_source(spark, d, more=True).scan(sel, 31 * 86_400_000, AS_OF)
    return out.select("seq", "ts_ms", F.col("stream").alias("event_type"))


def _selector(name: str, query: str, where: str) -> None:
    register(name, f"WITH {_EV} SELECT seq, ms AS ts_ms, event_type FROM ev WHERE {where}")(lambda spark, d: _typed(spark, d, query))


_selector("selector_regex", '{event_type=~"c.*|error",k!="5",user_id!~"1.*"}', "regexp_full_match(event_type, 'c.*|error') AND coalesce(k, '') <> '5' AND NOT regexp_full_match(uid, '1.*')")
_selector("selector_missing", '{big="",k!~"7|8"}', "NOT coalesce(value > 100, FALSE) AND NOT regexp_full_match(coalesce(k, ''), '7|8')")
_selector("selector_boolean", "(event_type:error OR event_type:click AND k:1) AND NOT user_id:3", "(event_type = 'error' OR event_type = 'click' AND k = '1') AND NOT uid = '3'")
_selector("selector_wildcard", "event_type:*ur* OR user_id:1*5", "event_type LIKE '%ur%' OR uid LIKE '1%5'")
_selector("selector_range", "user_id:[3 TO 40] AND k:[* TO 5]", "CAST(uid AS DOUBLE) BETWEEN 3 AND 40 AND TRY_CAST(k AS DOUBLE) <= 5")
_selector("selector_comparison", "user_id:>=10 AND user_id:<12.5 OR k:>90", "CAST(uid AS DOUBLE) >= 10 AND CAST(uid AS DOUBLE) < 12.5 OR TRY_CAST(k AS DOUBLE) > 90")
_selector("selector_names", "event-type:error OR user.id:3 AND event-type:*ick", "event_type = 'error' OR uid = '3' AND event_type LIKE '%ick'")
_selector("selector_exists", '_exists_:big AND _missing_:nothing AND event_type:"view"', "value > 100 AND event_type = 'view'")

register("time_range_scan", "SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE epoch_us(ts) // 1000 > 1705276800000 - 93600000 AND epoch_us(ts) // 1000 <= 1705276800000")(
    lambda spark, d: event_source(spark, d).scan(ast.Labels(), 93_600_000, 1_705_276_800_000).select("seq", "ts_ms")
)
register("source_limit", f"WITH {_EV} SELECT seq, ms AS ts_ms FROM ev ORDER BY ms, seq LIMIT 1000")(lambda spark, d: _limited(spark, d))


def _limited(spark: SparkSession, d: str) -> DataFrame:
    s = event_source(spark, d)
    s.limit = 1000
    return s.scan(ast.Labels()).select("seq", "ts_ms")


@register("ignoring_composite", f"""WITH {_EV}, p AS (SELECT *, 'event_type:' || event_type || ',k:' || k || ',uid:' || uid AS a FROM ev), t AS (
    SELECT *, 'bucket:' || bucket || CASE WHEN value > 100 THEN ',big:yes' ELSE '' END || CASE WHEN k IS NULL OR k = '' THEN '' ELSE ',k:' || k END AS join_value, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS side FROM ev WHERE event_type IN ('error', 'view'))
    SELECT join_value, {_COMPLETE}, {_SIDES}, {_SUMS} FROM (SELECT *, join_value AS jv FROM t) GROUP BY join_value HAVING {_BOTH}""")  # fmt: skip
def _ignoring(spark: SparkSession, d: str) -> DataFrame:
    out = engine(spark, d).correlate('events({event_type="error"})[31d] and ignoring(event_type, user_id, uid) events({event_type="view"})[31d]')
    # Pairs come sorted as texts; the SQL puts them in the same order by hand.
    return out.withColumn("join_value", F.regexp_replace("join_value", "^big:yes,bucket:([0-9]+)", "bucket:$1,big:yes"))


@register("nested_correlations", f"""WITH {_EV}, t AS (SELECT *, uid AS join_value, 0 AS side FROM ev WHERE {_LEFT} UNION ALL SELECT *, uid, 1 FROM ev WHERE {_RIGHT})
    SELECT join_value, 'user_id' AS join_key, 'complete' AS completeness, CAST(count(*) AS BIGINT) AS n_events, strftime(make_timestamp(min(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS start_at, strftime(make_timestamp(max(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS end_at,
    string_agg(event_type, ',' ORDER BY ms, side, seq) AS aliases, 'events' AS matched FROM t GROUP BY join_value HAVING {_BOTH}""")  # fmt: skip
def _nested(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.options.output = "nested"
    out = e.correlate(f"{_L} and on(user_id) {_R}")
    return out.select("join_value", "join_key", F.col("metadata.completeness").alias("completeness"), F.size("events").cast("long").alias("n_events"), F.col("time_window.start").alias("start_at"), F.col("time_window.end").alias("end_at"), F.array_join(F.transform("events", lambda x: x["alias"]), ",").alias("aliases"), F.array_join("metadata.matched_streams", ",").alias("matched"))


@register("long_correlations", f"""WITH {_EV}, t AS (SELECT *, uid AS join_value, 0 AS side FROM ev WHERE {_LEFT} UNION ALL SELECT *, uid, 1 FROM ev WHERE {_RIGHT})
    SELECT join_value, side AS stream_idx, seq, ms AS ts_ms FROM t WHERE join_value IN (SELECT join_value FROM t GROUP BY join_value HAVING {_BOTH})""")  # fmt: skip
def _long(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.options.output = "long"
    return e.correlate(f"{_L} and on(user_id) {_R}").select("join_value", "stream_idx", "seq", "ts_ms")


@register("parallel_correlations", f"""WITH {_EV}, t AS (SELECT *, uid AS join_value, 0 AS side FROM ev WHERE event_type = 'error' UNION ALL SELECT *, uid, 1 FROM ev WHERE event_type = 'view')
    SELECT join_value, {_SIDES}, arg_min(ms, seq) FILTER (side = 0) AS start_ms, arg_max(ms, seq) FILTER (side = 1) AS end_ms FROM t GROUP BY join_value HAVING {_BOTH}""")  # fmt: skip
def _parallel(spark: SparkSession, d: str) -> DataFrame:
    s = event_source(spark, d)
    of = lambda x: s.scan(ast.Labels((ast.Matcher("event_type", "=", x),)))
    out = correlate.parallel(of("error"), of("view"), ast.Join("and", ("user_id",)))
    return out.select("join_value", "n_left", "n_right", times.millis(F.col("start")).alias("start_ms"), times.millis(F.col("end")).alias("end_ms"))


# Scalar functions.


@register("extract_join_keys", r"""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x Request_ID=req-' || user_id WHEN 1 THEN 'trace-id: "t' || user_id || '" SPANID=s1' WHEN 2 THEN 'session id=none correlation_id: c-' || event_type ELSE 'nothing' END AS s FROM events)
    SELECT event_id, nullif(regexp_extract(s, '(?i)request[_-]?id[=:\s]+["'']?([a-zA-Z0-9-]+)', 1), '') AS request_id, nullif(regexp_extract(s, '(?i)trace[_-]?id[=:\s]+["'']?([a-zA-Z0-9-]+)', 1), '') AS trace_id,
    nullif(regexp_extract(s, '(?i)correlation[_-]?id[=:\s]+["'']?([a-zA-Z0-9-]+)', 1), '') AS correlation_id, nullif(regexp_extract(s, '(?i)span[_-]?id[=:\s]+["'']?([a-zA-Z0-9-]+)', 1), '') AS span_id FROM m""")  # fmt: skip
def _join_keys(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    s = F.when(k == 0, F.concat(F.lit("x Request_ID=req-"), u)).when(k == 1, F.concat(F.lit('trace-id: "t'), u, F.lit('" SPANID=s1'))).when(k == 2, F.concat(F.lit("session id=none correlation_id: c-"), F.col("event_type"))).otherwise("nothing")
    m = load(spark, d, "events").select("event_id", text.extract_join_keys(s).alias("m"))
    return m.select("event_id", *(F.element_at("m", F.lit(n)).alias(n) for n in ("request_id", "trace_id", "correlation_id", "span_id")))


@register("extract_labels", "SELECT event_id, event_type AS level, CAST(user_id AS VARCHAR) AS \"user\", 'b c' AS q, NULL::VARCHAR AS empty, '2' AS twice FROM events")
def _labels(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("level="), F.col("event_type"), F.lit(" user='"), F.col("user_id").cast("string"), F.lit("' q=\"b c\" empty=\"\" twice=1 text twice=2"))
    m = load(spark, d, "events").select("event_id", text.extract_labels(line).alias("m"))
    return m.select("event_id", *(F.element_at("m", F.lit(n)).alias(n) for n in ("level", "user", "q", "empty", "twice")))


@register("format_duration", """WITH x AS (SELECT event_id, (event_id * 7919 * event_id) % 200000000 AS ms FROM events)
    SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ms // 1000 || 's' WHEN ms < 3600000 THEN ms // 60000 || 'm' ELSE ms // 3600000 || 'h' END AS shown, CAST(ms // 1000 * 1000 AS BIGINT) AS parsed FROM x""")  # fmt: skip
def _format(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select("event_id", ((F.col("event_id") * 7919 * F.col("event_id")) % 200_000_000).alias("ms"))
    whole = F.concat(F.floor(F.col("ms") / 1000).cast("string"), F.lit("s"))
    return x.select("event_id", times.format_duration_col(F.col("ms")).alias("shown"), times.parse_duration_col(whole).alias("parsed"))


@register("iso_timestamps", "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, TRUE AS valid, FALSE AS invalid FROM events")
def _iso(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("iso", times.iso(times.millis_of_timestamp(F.col("ts"))))
    return e.select("event_id", "iso", times.is_valid_timestamp(F.col("iso")).alias("valid"), times.is_valid_timestamp(F.concat(F.lit("not "), F.col("iso"))).alias("invalid"))


@register("error_pattern_counts", """WITH m AS (SELECT CASE event_id % 6 WHEN 0 THEN 'Connection TIMEOUT' WHEN 1 THEN 'refused' WHEN 2 THEN 'HTTP 401 on ' || user_id WHEN 3 THEN 'Internal error' WHEN 4 THEN 'authentication' ELSE 'odd' END AS s FROM events WHERE event_type = 'error')
    SELECT CASE WHEN lower(s) LIKE '%timeout%' THEN 'timeouts' WHEN lower(s) LIKE '%connection%' OR lower(s) LIKE '%refused%' THEN 'connection_errors' WHEN lower(s) LIKE '%401%' OR lower(s) LIKE '%403%' OR lower(s) LIKE '%auth%' THEN 'auth_errors'
    WHEN lower(s) LIKE '%500%' OR lower(s) LIKE '%internal%' THEN 'server_errors' ELSE 'other' END AS error_class, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1""")  # fmt: skip
def _errors(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    s = F.when(k == 0, "Connection TIMEOUT").when(k == 1, "refused").when(k == 2, F.concat(F.lit("HTTP 401 on "), u)).when(k == 3, "Internal error").when(k == 4, "authentication").otherwise("odd")
    return store.error_patterns(load(spark, d, "events").where("event_type = 'error'").select(s.alias("message")))


@register("cascade_latency", f"""WITH {_EV}, t AS (SELECT uid AS join_value, min(ms) FILTER (event_type = 'error') AS a, min(ms) FILTER (event_type = 'purchase') AS b FROM ev GROUP BY uid)
    SELECT join_value, b - a AS delta_ms, abs(b - a) < 3600000 AS critical FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")  # fmt: skip
def _cascade(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.options.output = "long"
    return store.cascades(e.correlate('events({event_type="error"})[31d] and on(user_id) events({event_type="purchase"})[31d]'), critical_ms=3_600_000)


# Store, deduplication, windows.


def _all(spark: SparkSession, d: str) -> DataFrame:
    return event_source(spark, d).scan(ast.Labels())


register("store_lookup", "SELECT event_id AS seq FROM events WHERE user_id = 3")(lambda spark, d: store.EventStore(_all(spark, d)).lookup("user_id", "3").select("seq"))
register("store_time_range", "SELECT event_id AS seq FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704500000000 AND 1705500000000")(lambda spark, d: store.EventStore(_all(spark, d)).time_range(1_704_500_000_000, 1_705_500_000_000).select("seq"))
register("store_prune", "SELECT event_id AS seq FROM events WHERE epoch_us(ts) // 1000 >= 1705500000000")(lambda spark, d: store.EventStore(_all(spark, d)).prune(1_705_500_000_000).df.select("seq"))
register("store_self_correlate", """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS value, event_id FROM events), r AS (SELECT json_extract_string(props, '$.k') AS value, event_id FROM events)
    SELECT value, CAST(n_left AS BIGINT) AS n_left, CAST(a AS BIGINT) AS left_seq, CAST(n_right AS BIGINT) AS n_right, CAST(b AS BIGINT) AS right_seq FROM (SELECT value, count(*) AS n_left, sum(event_id) AS a FROM l GROUP BY 1) JOIN (SELECT value, count(*) AS n_right, sum(event_id) AS b FROM r GROUP BY 1) USING (value)""")(
    lambda spark, d: store.EventStore(_all(spark, d)).correlations("user_id", "k")
)


@register("dedup_events", "SELECT min(event_id) AS seq FROM events GROUP BY user_id, event_type")
def _dedup(spark: SparkSession, d: str) -> DataFrame:
    e = _all(spark, d)
    return store.dedup(e.withColumn("timestamp", F.lit("t"))).select("seq")


@register("merge_streams", "SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def _merge(spark: SparkSession, d: str) -> DataFrame:
    s = event_source(spark, d)
    return store.merge({x: s.scan(ast.Labels((ast.Matcher("event_type", "=", x),))) for x in ("error", "view")}).groupBy("name").agg(F.count("*").alias("n"))


@register("late_events_drop", "SELECT event_id AS seq FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1705000000000 - 60000000 AND 1705400000000")
def _late(spark: SparkSession, d: str) -> DataFrame:
    return store.window_buffer(_all(spark, d), 1_705_000_000_000, 1_705_400_000_000, 60_000_000, 1 << 40, F.col("seq")).select("seq")


@register("window_capacity", "SELECT event_id AS seq FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1705000000000 - 30000 AND 1706000000000) WHERE n <= 5")
def _capacity(spark: SparkSession, d: str) -> DataFrame:
    return store.window_buffer(_all(spark, d), 1_705_000_000_000, 1_706_000_000_000, 30_000, 5, F.element_at("labels", F.lit("user_id"))).select("seq")


@register("dedup_anchored", """WITH RECURSIVE e AS (SELECT user_id AS u, event_type AS t, epoch_us(ts) // 1000 AS ms, event_id AS seq FROM events),
    k(u, t, ms) AS (SELECT u, t, min(ms) FROM e GROUP BY u, t UNION ALL SELECT k.u, k.t, min(e.ms) FROM k JOIN e ON e.u = k.u AND e.t = k.t AND e.ms >= k.ms + 86400000 GROUP BY k.u, k.t)
    SELECT min(seq) AS seq FROM e JOIN k USING (u, t, ms) GROUP BY u, t, ms""")  # fmt: skip
def _anchored(spark: SparkSession, d: str) -> DataFrame:
    return store.dedup(_all(spark, d).withColumn("timestamp", F.lit("t")), window_ms=86_400_000).select("seq")


@register("store_hit_rate", "SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS hits, CAST(count(*) FILTER (n = 0) AS BIGINT) AS misses FROM (SELECT u, (SELECT count(*) FROM events WHERE user_id = u) AS n FROM (VALUES (3), (7), (-1)) AS t(u))")
def _hits(spark: SparkSession, d: str) -> DataFrame:
    st = store.EventStore(_all(spark, d))
    for u in ("3", "7", "-1"):
        st.count_lookup("user_id", u)
    return spark.sql(f"SELECT CAST({st.hits} AS BIGINT) AS hits, CAST({st.misses} AS BIGINT) AS misses")


@register("process_windows", "SELECT epoch_us(ts) // 1000 // 86400000 AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _windows(spark: SparkSession, d: str) -> DataFrame:
    out = store.process_windows(_all(spark, d), 86_400_000, lambda f: f)
    return out.groupBy(F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.count("*").alias("n"))


@register("stream_metrics", f"""WITH {_EV} SELECT CAST(count(*) AS BIGINT) AS events_processed, round((SELECT avg(1706745600000 - ms) FROM (SELECT ms FROM ev ORDER BY seq DESC LIMIT 1000)), 3) AS average_latency_ms,
    round(count(*) / ((max(ms) - min(ms)) / 1000), 6) AS events_per_second FROM ev""")  # fmt: skip
def _metrics(spark: SparkSession, d: str) -> DataFrame:
    m = store.stream_metrics(_all(spark, d), AS_OF)
    return m.select("events_processed", F.round("average_latency_ms", 3).alias("average_latency_ms"), F.round("events_per_second", 6).alias("events_per_second"))


# Decoders: payloads of every server's shape, made from the rows of events.


def _us() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _said() -> Column:
    return F.concat(F.lit("request_id=req-"), F.col("user_id").cast("string"), F.lit(' said "'), F.col("event_type"), F.lit('"'))


_SAID_SQL = "'request_id=req-' || user_id || ' said \"' || event_type || '\"'"
_ISO_SQL = "strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


def _loki_payloads(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """A body for each user, a stream for each type; times in nanoseconds."""
    values = F.collect_list(F.array((_us() * 1000 + 7).cast("string"), _said()))
    name = F.when(F.col("event_type") == "view", "service").when(F.col("event_type") == "click", "other").otherwise("job")
    streams = load(spark, d, "events").where(where).groupBy("user_id", "event_type").agg(values.alias("values")).withColumn("stream", F.create_map(name, F.col("event_type")))
    result = F.collect_list(F.struct("stream", "values")).alias("result")
    return streams.groupBy("user_id").agg(result).select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct("result").alias("data"))).alias("body"))


@register("decode_loki_json", f"""SELECT {_ISO_SQL} AS "timestamp", CASE event_type WHEN 'click' THEN 'unknown' ELSE event_type END AS stream, {_SAID_SQL} AS message, 'req-' || user_id AS request_id, epoch_us(ts) // 1000 AS ts_ms FROM events""")
def _loki(spark: SparkSession, d: str) -> DataFrame:
    return decoders.loki(_loki_payloads(spark, d)).select("timestamp", "stream", "message", F.element_at("join_keys", F.lit("request_id")).alias("request_id"), "ts_ms")


@register("decode_order", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS places FROM events")
def _order(spark: SparkSession, d: str) -> DataFrame:
    """Order of arrival is unique over all payloads."""
    return decoders.loki(_loki_payloads(spark, d)).agg(F.count("*").alias("n"), F.countDistinct("seq").alias("places"))


@register("dedup_payloads", f"SELECT {_SAID_SQL} AS message, epoch_us(ts) // 1000 AS ts_ms FROM events")
def _twice(spark: SparkSession, d: str) -> DataFrame:
    """Every payload comes twice, and so does each event."""
    bodies = _loki_payloads(spark, d)
    return store.dedup(decoders.loki(bodies.unionByName(bodies)), ("timestamp", "message", "source", "labels")).select("message", "ts_ms")


def _prom_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A matrix for each user with a series for each type; vectors of one sample for views, scalars for signups."""
    sample = F.concat(F.lit("["), (F.floor(_us() / 1000) / 1000).cast("decimal(20,3)").cast("string"), F.lit(',"'), F.col("event_id").cast("string"), F.lit('"]'))
    metric = F.concat(F.lit('{"__name__":"'), F.col("event_type"), F.lit('","user":"'), F.col("user_id").cast("string"), F.lit('"}'))
    e = load(spark, d, "events").select("event_type", "user_id", sample.alias("s"), metric.alias("m"))
    say = lambda kind, result: F.concat(F.lit('{"data":{"resultType":"' + kind + '","result":'), result, F.lit("}}")).alias("body")
    series = e.where("event_type not in ('view', 'signup')").groupBy("user_id", "m").agg(F.array_join(F.collect_list("s"), ",").alias("v"))
    matrix = series.groupBy("user_id").agg(F.array_join(F.collect_list(F.concat(F.lit('{"metric":'), F.col("m"), F.lit(',"values":['), F.col("v"), F.lit("]}"))), ",").alias("r"))
    vector = e.where("event_type = 'view'").select(say("vector", F.concat(F.lit('[{"metric":'), F.col("m"), F.lit(',"value":'), F.col("s"), F.lit("}]"))))
    return matrix.select(say("matrix", F.concat(F.lit("["), F.col("r"), F.lit("]")))).unionByName(vector).unionByName(e.where("event_type = 'signup'").select(say("scalar", F.col("s"))))


@register("decode_prom_matrix", f"""SELECT {_ISO_SQL} AS "timestamp", CASE event_type WHEN 'signup' THEN 'metric' ELSE event_type END || '=' || event_id AS message, CASE event_type WHEN 'signup' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS "user",
    CAST(event_id AS VARCHAR) AS value, CASE event_type WHEN 'signup' THEN NULL ELSE event_type END AS name FROM events""")  # fmt: skip
def _prom(spark: SparkSession, d: str) -> DataFrame:
    of = lambda m, k: F.element_at(m, F.lit(k))
    return decoders.prometheus(_prom_payloads(spark, d)).select("timestamp", "message", of("join_keys", "user").alias("user"), of("labels", "__value__").alias("value"), of("labels", "__name__").alias("name"))


@register("selector_metric", "SELECT 'purchase=' || event_id AS message FROM events WHERE event_type = 'purchase' AND CAST(user_id AS VARCHAR) LIKE '1%'")
def _metric(spark: SparkSession, d: str) -> DataFrame:
    sel = parse('p(purchase{user=~"1.*"})[31d] and on(x) p(up)[1s]').streams[0].selector
    return EventSource(decoders.prometheus(_prom_payloads(spark, d))).scan(sel).select("message")


@register("prom_downsample", """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type NOT IN ('view', 'signup'))
    SELECT event_type AS name, CAST(user_id AS VARCHAR) AS "user", ms // (26784 * 1000) AS step, max(ms) AS ts_ms FROM e GROUP BY 1, 2, 3""")  # fmt: skip
def _down(spark: SparkSession, d: str) -> DataFrame:
    """The last sample of a series in each step of a month's range, which is a hundredth of it."""
    step = decoders.step_seconds(31 * 86_400_000)
    e = decoders.prometheus(_prom_payloads(spark, d).where("get_json_object(body, '$.data.resultType') = 'matrix'"))
    of = lambda k: F.element_at("labels", F.lit(k))
    return decoders.downsample(e, step).select(of("__name__").alias("name"), of("user").alias("user"), F.floor(F.col("ts_ms") / (step * 1000)).alias("step"), "ts_ms")


def _graylog_payloads(spark: SparkSession, d: str, where: str = "true", own_id: bool = True) -> DataFrame:
    """A body for each user. Fields of every type; a text in brackets is a text. own_id: a field with an id beside the one in the message."""
    fields = F.struct(
        F.col("event_id").alias("level"), (F.col("event_id") % 2 == 0).alias("ok"), F.concat(F.lit("["), F.col("event_type"), F.lit("]")).alias("tag"), F.lit("{x}").alias("braces"),
        F.struct("event_id").alias("deep"), F.array("event_type").alias("list"), F.col("event_type").alias("order_id"), F.lit("t").alias("xtracex"), *([F.lit("old").alias("request_id")] if own_id else []),
    )
    stamp = times.iso(F.floor(_us() / 1000))
    message = F.struct(F.col("event_id").cast("string").alias("_id"), _said().alias("message"), stamp.alias("timestamp"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("source"), fields.alias("fields"))
    return load(spark, d, "events").where(where).select("user_id", F.struct(message.alias("message")).alias("m")).groupBy("user_id").agg(F.collect_list("m").alias("messages")).select(F.to_json(F.struct("messages")).alias("body"))


@register("decode_graylog_json", f"""SELECT {_ISO_SQL} AS "timestamp", CASE event_type WHEN 'view' THEN 'unknown' ELSE event_type END AS stream, CAST(event_id AS VARCHAR) AS level, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS ok,
    '[' || event_type || ']' AS tag, '{{x}}' AS braces, NULL::VARCHAR AS deep, NULL::VARCHAR AS list, event_type AS order_id, 'req-' || user_id AS request_id, 't' AS trace, 7 AS n_labels FROM events""")  # fmt: skip
def _graylog(spark: SparkSession, d: str) -> DataFrame:
    e = decoders.graylog_json(_graylog_payloads(spark, d), now=F.lit("now"))
    label, key = (lambda k, m=m: F.element_at(m, F.lit(k)) for m in ("labels", "join_keys"))
    return e.select("timestamp", "stream", *(label(k).alias(k) for k in ("level", "ok", "tag", "braces", "deep", "list")), key("order_id").alias("order_id"), key("request_id").alias("request_id"), key("xtracex").alias("trace"), F.size("labels").alias("n_labels"))


@register("decode_graylog_csv", f"""SELECT {_ISO_SQL} AS "timestamp", CASE event_type WHEN 'view' THEN 'unknown' ELSE event_type END AS stream, 'a, ' || {_SAID_SQL} AS message, CAST(event_id AS VARCHAR) AS level, 't' || user_id AS trace_id, 'req-' || user_id AS request_id FROM events""")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('"a, '), F.replace(_said(), F.lit('"'), F.lit('""')), F.lit('"'))
    source = F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("")
    lines = load(spark, d, "events").select(F.concat_ws(",", times.iso(F.floor(_us() / 1000)), source, quoted, F.col("event_id").cast("string"), F.col("event_id").cast("string"), F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("value"))
    head = spark.sql("SELECT explode(array('Timestamp,source,Message,_id,level,trace_id', 'broken,row')) AS value")
    e = decoders.graylog_csv(spark, head.unionByName(lines), F.lit("now"))
    of = lambda m, k: F.element_at(m, F.lit(k))
    return e.select("timestamp", "stream", "message", of("labels", "level").alias("level"), of("join_keys", "trace_id").alias("trace_id"), of("join_keys", "request_id").alias("request_id"))


@register("decoded_streams_join", f"""WITH {_EV}, t AS (SELECT *, 'req-' || uid AS join_value, 0 AS side FROM ev WHERE {_LEFT} UNION ALL SELECT *, 'req-' || uid, 1 FROM ev WHERE {_RIGHT})
    SELECT join_value, {_COMPLETE}, {_SIDES}, CAST(count(*) AS BIGINT) AS n_events, min(ms) AS first_ms, max(ms) AS last_ms FROM t GROUP BY join_value HAVING {_BOTH}""")  # fmt: skip
def _decoded(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(Options(as_of_ms=AS_OF))
    e.add_source("loki", EventSource(decoders.loki(_loki_payloads(spark, d, _LEFT))))
    e.add_source("Graylog", EventSource(decoders.graylog_json(_graylog_payloads(spark, d, _RIGHT, False), now=F.lit("now"))))
    return e.correlate("LOKI({})[31d] and on(request_id) graylog(order_id:purchase)[31d]").select("join_value", "completeness", "n_left", "n_right", "n_events", "first_ms", "last_ms")


# Streams: files of events, read as streams to their end.


def _fed(spark: SparkSession, d: str, **sides: ast.Matcher) -> tuple[str, dict[str, DataFrame]]:
    """A shared folder, and in it a stream of files with the events that fit each matcher."""
    root, out = shared_folder(spark, "stream"), {}
    for name, m in sides.items():
        df = event_source(spark, d, more=True).scan(ast.Labels((m,) if m else ()))
        df.write.json(f"{root}/{name}")
        realtime.finish(spark, f"{root}/{name}")
        out[name] = realtime.paced(spark, f"{root}/{name}", EVENT, 1 << 30)
    return root, out


def _drained(spark: SparkSession, root: str, stream: DataFrame) -> DataFrame:
    """All that a stream gives up to the end of its files."""
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _live(spark: SparkSession, d: str, kind: str, live: bool, query: str, right: ast.Matcher | None = None) -> DataFrame:
    root, s = _fed(spark, d, left=ast.Matcher("event_type", "=", "error"), right=right or ast.Matcher("event_type", "=", "purchase"))
    how = parse(f"a({{}})[1s] {kind} {query} b({{}})[1s]").join
    out = _drained(spark, root, realtime.join(s["left"], s["right"], how, 1_000, live))
    return out.select("join_value", "completeness", "n_left", "n_right", F.aggregate("seqs", F.lit(0).cast("long"), lambda a, x: a + x).alias("seq_sum"))


def _settled(kind: str) -> str:
    """What the batch join says, without times; `unless` holds the left events alone."""
    return f"SELECT join_value, completeness, n_left, n_right, seq_sum FROM ({_two(kind, right=_RIGHT if kind != 'unless' else 'event_type = ' + repr('signup') + ' AND k = ' + repr('7'))})"


_ONE = ast.Matcher("signup7", "=", "yes")
for _kind in ("and", "or", "unless"):
    register(f"stream_join_{_kind}", _settled(_kind))(lambda spark, d, k=_kind: _live(spark, d, k, False, "on(user_id) within(1s)", _ONE if k == "unless" else None))


def _seen(right: str) -> str:
    return f"""WITH {_EV}, t AS (SELECT seq, uid, 0 AS side FROM ev WHERE {_LEFT} UNION ALL SELECT seq, uid, 1 FROM ev WHERE {right}),
    k AS (SELECT uid, min(seq) FILTER (side = 0) AS l, min(seq) FILTER (side = 1) AS r FROM t GROUP BY uid) """


_SNAP = "SELECT uid AS join_value, %s AS completeness, CAST(count(*) FILTER (side = 0) AS BIGINT) AS n_left, CAST(count(*) FILTER (side = 1) AS BIGINT) AS n_right, CAST(sum(seq) AS BIGINT) AS seq_sum FROM t JOIN k USING (uid) WHERE %s GROUP BY uid"
register("stream_live_and", _seen(_RIGHT) + _SNAP % ("'complete'", "seq <= greatest(l, r) AND l IS NOT NULL AND r IS NOT NULL"))(lambda spark, d: _live(spark, d, "and", True, "on(user_id)"))
register("stream_live_or", _seen(_RIGHT) + _SNAP % ("'partial'", "seq = least(coalesce(l, r), coalesce(r, l))"))(lambda spark, d: _live(spark, d, "or", True, "on(user_id)"))
register("stream_live_unless", _seen("event_type = 'signup' AND k = '7'") + _SNAP % ("'complete'", "seq <= greatest(l, r) AND l IS NOT NULL AND r IS NOT NULL") + " UNION ALL " + _SNAP % ("'partial'", "r IS NULL"))(
    lambda spark, d: _live(spark, d, "unless", True, "on(user_id)", _ONE)
)


@register("stream_dedup", "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    root, s = _fed(spark, d, all=None)
    same = s["all"].where("labels is not null").withColumn("timestamp", F.lit("t"))
    out = _drained(spark, root, realtime.dedup(same, window_ms=40 * 86_400_000))
    return out.groupBy(F.element_at("labels", F.lit("user_id")).alias("user_id"), F.element_at("labels", F.lit("event_type")).alias("event_type")).agg(F.count("*").alias("n"))


@register("stream_windows", "SELECT epoch_us(ts) // 86400000000 * 86400000 AS start_ms, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    root, s = _fed(spark, d, all=None)
    out = _drained(spark, root, realtime.window_counts(s["all"], "1 day", late_ms=1_000)).where("source = 'events'")
    return out.select(F.unix_millis("window.start").alias("start_ms"), "n")


@register("stream_sliding_windows", "SELECT (epoch_us(ts) // 43200000000 - x) * 43200000 AS start_ms, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES (0), (1)) AS t(x) GROUP BY 1")
def _stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    root, s = _fed(spark, d, all=None)
    out = _drained(spark, root, realtime.window_counts(s["all"], "1 day", "12 hours", 1_000)).where("source = 'events'")
    return out.select(F.unix_millis("window.start").alias("start_ms"), "n")


@register("stream_sessions", """WITH e AS (SELECT event_type AS value, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us // 1000 - lag(us // 1000) OVER (PARTITION BY value ORDER BY us) <= 1200000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY value ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT value, min(us) // 1000 AS start_ms, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY value, no""")  # fmt: skip
def _stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each type of event end after 20 minutes without one."""
    root, s = _fed(spark, d, all=None)
    out = _drained(spark, root, realtime.session_counts(s["all"], "1200001 milliseconds", "event_type", 1_000))
    return out.select("value", F.unix_millis("window.start").alias("start_ms"), "n")


@register("stream_monitor", "SELECT CAST(count(*) AS BIGINT) AS events_processed FROM events")
def _stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a query's progress tells, without the two that end the stream."""
    root, s = _fed(spark, d, all=None)
    q = s["all"].writeStream.format("noop").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    seen: list[dict] = []
    m = Monitor(lambda event, what: seen.append(what) if event == "metrics" else None)
    for p in q.recentProgress:
        m.onQueryProgress(SimpleNamespace(progress=p))
    return spark.sql(f"SELECT CAST({(seen[-1]['events_processed'] if seen else 2) - 2} AS BIGINT) AS events_processed")


# The language and the servers' query rules, over texts made from rows.


def _told(name: str, sql: str, text: Callable[[], Column], fn: Callable, schema: str) -> None:
    """Registers fn (a text -> a tuple) over a text made from each row of events."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        names = [c.rsplit(" ", 1)[0] for c in schema.split(", ")]

        def run(frames):
            for f in frames:
                yield pd.DataFrame([(i, *fn(t)) for i, t in zip(f.event_id, f.t, strict=True)], columns=["event_id", *names])

        return load(spark, d, "events").select("event_id", text().alias("t")).mapInPandas(run, f"event_id long, {schema}")

    register(name, sql)(query)


def _say_error(t: str) -> tuple:
    try:
        parse(t)
    except CorrelationError as e:
        return e.code, e.details["line"], e.details["column"]
    return None, None, None


def _user() -> Column:
    return F.col("user_id").cast("string")


def _pair() -> Column:
    return F.concat(F.lit('a({event_type="'), F.col("event_type"), F.lit('"})[5m] and on(user_id=uid, k) within('), _user(), F.lit('s) b(user:'), _user(), F.lit(" AND NOT kind:"), F.col("event_type"), F.lit(")[1h]"))
_told("language_errors", "SELECT event_id, 'QUERY_PARSE_ERROR' AS code, CAST(2 + event_id % 3 AS BIGINT) AS line, CAST(13 AS BIGINT) AS \"column\" FROM events", lambda: F.concat(F.lit("a({})[5m]\n"), F.repeat(F.lit("\n"), (F.col("event_id") % 3).cast("int")), F.lit("  and on(k) 7")), _say_error, "code string, line long, column long")
_told(
    "language_tree", "SELECT event_id, 'and' AS kind, 'user_id,k' AS keys, 'user_id=uid' AS mapped, user_id || 's' AS within, event_type AS value, 'user:' || user_id || ' AND NOT kind:' || event_type AS selector FROM events",
    _pair, lambda t: (lambda q: (q.join.kind, ",".join(q.join.keys), ",".join("=".join(m) for m in q.join.mappings), q.join.within, q.streams[0].selector.matchers[0].value, q.streams[1].selector.text()))(parse(t)), "kind string, keys string, mapped string, within string, value string, selector string",
)
_told("language_validate", "SELECT event_id, event_id % 3 = 0 AS valid, CASE WHEN event_id % 3 = 0 THEN CAST(2 AS BIGINT) END AS streams, CASE WHEN event_id % 3 = 0 THEN TRUE END AS temporal FROM events", lambda: F.when(F.col("event_id") % 3 == 0, _pair()).when(F.col("event_id") % 3 == 1, F.lit("a({})[5m]")).otherwise(F.concat(_pair(), F.lit(" xor"))), lambda t: (lambda v: (v["valid"], v.get("details", {}).get("streams"), v.get("details", {}).get("temporal")))(tooling.validate(t)), "valid boolean, streams long, temporal boolean")
_told("language_format", """SELECT event_id, 'a({event_type="' || event_type || '"})[5m]' || chr(10) || repeat(' ', 2) || 'and on(user_id=uid, k) within(' || user_id || 's)' || chr(10) || repeat(' ', 2) || 'b(user:' || user_id || ' AND NOT kind:' || event_type || ')[1h]' AS shown FROM events""", lambda: _pair(), lambda t: (tooling.format_query(t),), "shown string")
_told("language_suggest", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[5m],[1m],[30s],[1h],[24h]' WHEN 1 THEN 'and on(,or on(,unless on(' WHEN 2 THEN 'request_id,trace_id,session_id,correlation_id,span_id' ELSE '"info","warn","error","debug"' END AS offers FROM events""", lambda: F.concat(F.lit("a({user="), F.concat(F.lit('"'), _user(), F.lit('"')), F.element_at(F.array(F.lit("}) "), F.lit("})[5m] "), F.lit("})[5m] or on("), F.lit(",level=")), (F.col("event_id") % 4 + 1).cast("int"))), lambda t: (",".join(tooling.suggest(t, len(t))),), "offers string")
_told("language_builder", """SELECT event_id, 'a({k="' || user_id || '"})[5m] or on(' || event_type || ') within(30s) b({})[1h]' AS built FROM events""", lambda: F.concat_ws(",", _user(), F.col("event_type")), lambda t: (tooling.QueryBuilder().add_stream("a", f'{{k="{t.split(",")[0]}"}}', "5m").join("or", [t.split(",")[1]]).with_temporal("30s").and_stream("b", "{}", "1h").build(),), "built string")
_told("rule_graylog_rewrite", "SELECT event_id, 'type:' || event_type || ' AND user:' || user_id || ' OR x' AS asked FROM events", lambda: F.concat(F.lit('type="'), F.col("event_type"), F.lit('"  and user=\''), _user(), F.lit("'  or x")), lambda t: (decoders.rewrite_graylog(t),), "asked string")
_told("rule_graylog_sanitise", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a:' || user_id WHEN 1 THEN '' WHEN 2 THEN event_type || ':* AND b:1' ELSE 'a' END AS asked FROM events", lambda: F.element_at(F.array(F.concat(F.lit("* a:"), _user()), F.lit("*"), F.concat(F.col("event_type"), F.lit(": AND b:1")), F.concat(F.lit("a :"), _user())), (F.col("event_id") % 4 + 1).cast("int")), lambda t: (decoders.sanitize_graylog(t),), "asked string")
_told("rule_metric_split", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS metric, '{u="' || user_id || '"}' AS selector FROM events""", lambda: F.concat(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""), F.lit('{u="'), _user(), F.lit('"}')), lambda t: decoders.split_metric(t), "metric string, selector string")
_told("rule_ranges", "SELECT event_id, CAST(user_id * 60000 AS BIGINT) AS graylog_ms, CAST(user_id * 60000 AS BIGINT) AS prom_ms, CAST(greatest(15, user_id * 60 // 100) AS BIGINT) AS step FROM events", lambda: F.concat(_user(), F.lit("m")), lambda t: (decoders.graylog_range_ms(t), decoders.prometheus_range_ms(t), decoders.step_seconds(decoders.graylog_range_ms(t))), "graylog_ms long, prom_ms long, step long")
_told("rule_validity", "SELECT event_id, event_id % 2 = 0 AS loki, TRUE AS graylog, event_id % 2 = 0 AS prom FROM events", lambda: F.concat(F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_type"), F.lit('{u="'), _user(), F.lit('"}'))).otherwise(F.concat(F.lit("rate("), F.col("event_type"), F.lit(")")))), lambda t: (decoders.valid_loki(t), decoders.valid_graylog(t), decoders.valid_prometheus(t)), "loki boolean, graylog boolean, prom boolean")
_told("rule_stream_id", "SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN event_type || '1' END AS id FROM events", lambda: F.upper(F.col("event_type")), lambda t: (decoders.stream_id([{"title": "Error", "id": "error1"}, {"name": "click", "id": "click1"}], t),), "id string")


@register("correlation_ids", "SELECT event_id, TRUE AS well_formed FROM events")
def _ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", text.correlation_id().rlike(r"\Acorr_[0-9]{13}_[0-9a-f]{9}\z").alias("well_formed"))


@register("source_registry", """SELECT 'events' AS source, event_type AS stream FROM events GROUP BY 2 UNION ALL SELECT 'orders', o_orderstatus FROM orders GROUP BY 2 UNION ALL SELECT 'customers', c_mktsegment FROM customer GROUP BY 2""")
def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Streams that the registered sources have, each found under its name in another case."""
    e = engine(spark, d)
    rows = [(name, s) for name in e.available() for s in e.registry.find(name.upper()).available()]
    return spark.createDataFrame(rows, "source string, stream string")
