"""Decoders of the payloads of Loki, Graylog and Prometheus, and their query rules. Transport is elsewhere."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorrelationError
from ..functions.text import ID_NAMES, extract_join_keys
from ..functions.times import iso, iso_of_nanos, millis
from ..schema import COLUMNS

_EMPTY = "map<string,string>"


def _or(*columns: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _arrived(df: DataFrame, ms: Column, *what: Column) -> Column:
    """Order of arrival: by task, payload, then place in the payload. It is unique over all payloads, so it comes last,
    after the payloads are taken apart. A stream, which can't number its rows, has the time and a hash of `what`."""
    if df.isStreaming:
        return F.shiftleft(ms, 20) + F.pmod(F.xxhash64(*what), F.lit(1 << 20))
    return F.monotonically_increasing_id()


def loki(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Events of query_range bodies (JSON texts): one for each value of each stream."""
    schema = "status string, data struct<resultType string, result array<struct<stream map<string,string>, values array<array<string>>>>>"
    p = payloads.select(F.from_json(column, schema).alias("p")).select(F.posexplode("p.data.result").alias("i", "r"))
    p = p.select("i", F.col("r.stream").alias("labels"), F.posexplode("r.values").alias("j", "v"))
    message, at = F.coalesce(F.col("v")[1], F.lit("")), F.col("v")[0]
    ms = F.floor(at.cast("decimal(38,0)") / 1_000_000).cast("long")
    return p.select(
        iso_of_nanos(at).alias("timestamp"), F.lit("loki").alias("source"), F.coalesce(_or(F.element_at("labels", F.lit("job")), F.element_at("labels", F.lit("service"))), F.lit("unknown")).alias("stream"),
        message.alias("message"), "labels", extract_join_keys(message).alias("join_keys"), ms.alias("ts_ms"), _arrived(p, ms, at, message, F.to_json("labels")).alias("seq"),
    ).select(*COLUMNS)


def _graylog(rows: DataFrame, now: Column) -> DataFrame:
    """From message, timestamp, source and fields (map of texts)."""
    ids = F.map_filter("fields", lambda k, v: k.endswith("_id") | k.contains("correlation") | k.contains("trace"))
    told = extract_join_keys(F.col("message"), ID_NAMES[:4])
    keys = F.map_concat(F.map_filter(ids, lambda k, _: ~F.map_contains_key(told, k)), told)
    stamp = F.coalesce(_or(F.col("timestamp")), now)
    return rows.select(stamp.alias("timestamp"), F.lit("graylog").alias("source"), F.coalesce(_or(F.col("source")), F.lit("unknown")).alias("stream"), F.coalesce("message", F.lit("")).alias("message"), F.col("fields").alias("labels"), keys.alias("join_keys"), millis(stamp).alias("ts_ms"), _arrived(rows, millis(stamp), F.col("message"), F.to_json("fields")).alias("seq")).select(*COLUMNS)


def graylog_json(payloads: DataFrame, column: str = "body", now: Column | None = None) -> DataFrame:
    """Events of relative-search bodies: scalar fields become labels, objects and arrays are left out."""
    now = now if now is not None else iso(F.unix_millis(F.current_timestamp()))
    message = "struct<_id string, message string, timestamp string, source string, fields map<string,variant>>"
    p = payloads.select(F.from_json(column, f"messages array<struct<message {message}, index string>>").alias("p")).select(F.explode("p.messages").alias("m"))
    # A variant knows a text such as "[info]" from a list.
    scalar = F.map_filter(F.coalesce("m.message.fields", F.create_map().cast("map<string,variant>")), lambda _, v: v.isNotNull() & ~F.is_variant_null(v) & ~F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)"))
    fields = F.transform_values(scalar, lambda _, v: v.cast("string"))
    return _graylog(p.select(F.col("m.message.message").alias("message"), F.col("m.message.timestamp").alias("timestamp"), F.col("m.message.source").alias("source"), fields.alias("fields")), now)


def graylog_csv(spark: SparkSession, lines: DataFrame | str, now: Column | None = None) -> DataFrame:
    """Events of a CSV answer: a path, or a frame with one line a row (column value), the header first.

    The header is lower-cased, rows of another length go, further columns become labels. Quotes are doubled within
    quoted fields; lines equal to the header, as of several answers in one frame, are headers.
    """
    now = now if now is not None else iso(F.unix_millis(F.current_timestamp()))
    opts = {"quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": ""}
    if isinstance(lines, str):
        df = spark.read.options(**opts, header=True, mode="DROPMALFORMED", enforceSchema=False, multiLine=True).csv(lines)
    else:
        head = lines.first()
        names = next(csv.reader([head[0]]), []) if head else []
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        parsed = F.from_csv(F.col(lines.columns[0]), f"{schema}, `\x00` string", {**opts, "columnNameOfCorruptRecord": "\x00"}) if names else None
        rows = lines.where(F.col(lines.columns[0]) != head[0]) if head else lines
        df = rows.select(parsed.alias("p")).select("p.*").where("`\x00` is null").drop("\x00") if names else rows.select(F.lit("").alias("message")).limit(0)
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    for c in ("message", "timestamp", "source"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    more = [c for c in df.columns if c not in ("_id", "message", "timestamp", "source")]
    fields = F.map_filter(F.create_map(*(x for c in more for x in (F.lit(c), F.col(f"`{c}`")))), lambda _, v: v.isNotNull()) if more else F.create_map().cast(_EMPTY)
    return _graylog(df.select("message", "timestamp", "source", fields.alias("fields")), now)


def prometheus(payloads: DataFrame, column: str = "body", limit: int | None = None) -> DataFrame:
    """Events of query_range bodies: a sample of a matrix or vector each; a scalar or text is one event."""
    series = "array<struct<metric map<string,string>, values array<array<string>>, value array<string>>>"
    kind = F.get_json_object(column, "$.data.resultType")
    both = payloads.where(kind.isin("matrix", "vector")).select(F.from_json(column, f"data struct<result {series}>").alias("p")).select(F.posexplode("p.data.result").alias("i", "r"))
    samples = F.when(F.col("r.values").isNotNull(), F.col("r.values")).otherwise(F.array("r.value"))
    s = both.select("i", F.coalesce("r.metric", F.create_map().cast(_EMPTY)).alias("metric"), F.posexplode(samples).alias("j", "v"))
    one = payloads.where(kind.isin("scalar", "string")).select(F.from_json(column, "data struct<result array<string>>").alias("p")).where("p.data.result is not null")
    one = one.select(F.lit(0).alias("i"), F.create_map().cast(_EMPTY).alias("metric"), F.lit(0).alias("j"), F.col("p.data.result").alias("v"))
    s = s.unionByName(one)
    ms = F.floor(F.col("v")[0].try_cast("decimal(38,6)") * 1000).cast("long")
    name = F.coalesce(_or(F.element_at("metric", F.lit("__name__"))), F.lit("metric"))
    plain = F.map_filter("metric", lambda k, _: k != "__value__")
    out = s.select(
        iso(ms).alias("timestamp"), F.lit("promql").alias("source"), name.alias("stream"), F.concat(name, F.lit("="), F.col("v")[1]).alias("message"),
        F.map_concat(plain, F.create_map(F.lit("__value__"), F.col("v")[1])).alias("labels"), F.col("metric").alias("join_keys"), ms.alias("ts_ms"), _arrived(s, ms, F.to_json("metric"), F.col("v")[0], F.col("v")[1]).alias("seq"),
    ).select(*COLUMNS)
    return out.orderBy("seq").limit(limit) if limit else out


def step_seconds(range_ms: int) -> int:
    """Resolution of a range query: a hundredth of the range, 15 seconds at least."""
    return max(15, range_ms // 1000 // 100)


def downsample(df: DataFrame, step: int) -> DataFrame:
    """The last sample of each series in each step.

    df is read once: joined with itself, events whose order of arrival is numbered anew would not be found again.
    """
    at = F.floor(F.col("ts_ms") / (step * 1000)).alias("step")
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct("ts_ms", "seq"))
    return df.groupBy(F.to_json("join_keys").alias("series"), at).agg(last.alias("x")).select("x.*")


_RANGE = re.compile(r"([0-9]+)([smhd])")


def graylog_range_ms(text: str) -> int:
    m = _RANGE.fullmatch(text)
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] * 1000 if m else 300_000


def prometheus_range_ms(text: str) -> int:
    if not _RANGE.fullmatch(text):
        raise CorrelationError(f"Invalid time range: {text}", "PROMQL_PARSE_ERROR")
    return graylog_range_ms(text)


def split_metric(query: str) -> tuple[str | None, str | None]:
    m = re.fullmatch(r"([^{]+)?(\{[^}]*\})?", query.strip())
    if not m:
        raise CorrelationError(f"Invalid PromQL query: {query}", "PROMQL_PARSE_ERROR")
    return m[1] and m[1].strip(), m[2]


def valid_loki(query: str) -> bool:
    a, b = query.find("{"), query.find("}")
    return 0 < len(query) <= 10_000 and -1 < a < b and bool(query[a + 1 : b].strip())


def valid_graylog(query: str) -> bool:
    return 0 < len(query) <= 10_000 and bool(query.strip())


def valid_prometheus(query: str) -> bool:
    return bool(re.fullmatch(r"[a-zA-Z_:][a-zA-Z0-9_:]*(\{[^}]*\})?|\{[^}]+\}", query))


def rewrite_graylog(query: str) -> str:
    """name="value" as name:value, and/or in capitals, white space as single spaces."""
    q = re.sub(r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)=(?:\"([^\"]*)\"|'([^']*)')", lambda m: f"{m[1]}:{m[2] if m[2] is not None else m[3]}", query)
    return " ".join(w.upper() if w.upper() in ("AND", "OR") else w for w in q.split())


def sanitize_graylog(query: str) -> str:
    """A query for the stricter syntax: no bare wildcard in front, a wildcard where a field lacks its value, no empty values, no values without a field."""
    q = query.strip()
    if q == "*":
        return ""
    if q.startswith("* "):
        q = q[2:].strip()
    q = re.sub(r"(?<=[A-Za-z0-9_]):(?=[ \t\r\n]*(?:AND|OR|$))", ":*", q)
    q = re.sub(r"(?<=[A-Za-z0-9_]):(?:\"\"|'')", "", q)
    q = re.sub(r"(?:(?<=[ \t\r\n])|^):[A-Za-z0-9_]*", "", q)
    q = " ".join(q.split())
    return "" if q in ("AND", "OR") else q


def stream_id(streams: list[dict], name: str) -> str | None:
    """Id of the stream with a title or name, in any case; None filters nothing."""
    for s in streams:
        if name.lower() in ((s.get("title") or "").lower(), (s.get("name") or "").lower()):
            return s.get("id")
    return None
