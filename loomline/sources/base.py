"""What a source is, and the registry of sources."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorrelationError
from ..functions.times import parse_duration
from ..operators.predicates import label_of, selector
from ..plans import ast
from ..schema import events


class LogSource(Protocol):
    """Anything with these methods is a source."""

    def scan(self, selector: ast.Selector, range_ms: int | None = None, as_of_ms: int | None = None) -> DataFrame: ...

    def validate(self, query: str) -> bool: ...

    def available(self) -> list[str]: ...


class Registry:
    """Sources by name; a name is found as it is, then in any case."""

    def __init__(self):
        self.sources: dict[str, LogSource] = {}

    def add(self, name: str, source: LogSource) -> None:
        if name in self.sources:
            raise CorrelationError(f"Adapter {name} already exists", "ADAPTER_EXISTS", {"name": name})
        self.sources[name] = source

    def find(self, name: str) -> LogSource:
        if name in self.sources:
            return self.sources[name]
        for k, s in self.sources.items():
            if k.lower() == name.lower():
                return s
        raise CorrelationError(f"No adapter for source: {name}", "ADAPTER_NOT_FOUND", {"source": name, "availableAdapters": sorted(self.sources)})


def range_ms(text: str | None) -> int | None:
    """Milliseconds of a stream's range, whose units are s, m, h and d."""
    if text is None:
        return None
    try:
        return parse_duration(text)
    except ValueError as e:
        raise CorrelationError(str(e), "QUERY_PARSE_ERROR") from None


class TableSource:
    """Events from a table or frame whose columns stand for labels.

    labels: label -> column of df. A selector's labels become these columns, and a range a comparison with ts, so both
    reach the scan. time: a timestamp column of df; message, stream, seq and join_keys: columns of df. df may be a stream.
    """

    def __init__(self, df: DataFrame, name: str, labels: dict[str, Column], time: Column, message: Column | None = None, stream: Column | None = None, seq: Column | None = None, join_keys: Column | None = None, limit: int | None = None):
        self.df, self.name, self.labels, self.time, self.limit = df, name, labels, time, limit
        self.message, self.stream, self.seq, self.join_keys = message, stream, seq, join_keys

    def _of(self, label: str) -> Column:
        return self.labels[label].cast("string") if label in self.labels else F.lit(None).cast("string")

    def scan(self, sel: ast.Selector, range_ms: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        from ..functions.times import iso, millis_of_timestamp

        df = self.df.where(selector(sel, self._of))
        if range_ms is not None:
            if as_of_ms is None:
                as_of_ms = self.as_of()
            if as_of_ms is not None:
                df = df.where((self.time > F.timestamp_millis(F.lit(as_of_ms - range_ms)).cast(self._time_type())) & (self.time <= F.timestamp_millis(F.lit(as_of_ms)).cast(self._time_type()) + F.expr("INTERVAL '0.000999' SECOND")))
        ms = millis_of_timestamp(self.time)
        packed = F.map_filter(F.create_map(*(x for k, c in self.labels.items() for x in (F.lit(k), c.cast("string")))), lambda _, v: v.isNotNull()) if self.labels else F.create_map().cast("map<string,string>")
        null = F.lit(None)
        out = df.select(
            iso(ms).alias("timestamp"), F.lit(self.name).alias("source"), (self.stream if self.stream is not None else null.cast("string")).alias("stream"), (self.message if self.message is not None else F.lit("")).alias("message"),
            packed.alias("labels"), (self.join_keys if self.join_keys is not None else null.cast("map<string,string>")).alias("join_keys"), ms.alias("ts_ms"), (self.seq.cast("long") if self.seq is not None else F.monotonically_increasing_id()).alias("seq"),
        )
        return out.orderBy("ts_ms", "seq").limit(self.limit) if self.limit else out

    def _time_type(self) -> str:
        return self.df.select(self.time).schema[0].dataType.simpleString()

    def as_of(self) -> int | None:
        """The last time of a table; None for a stream, whose ranges don't apply."""
        if self.df.isStreaming:
            return None
        return self.df.agg(F.max(F.floor(F.unix_micros(self.time.cast("timestamp")) / 1000))).first()[0]

    def validate(self, query: str) -> bool:
        return bool(query.strip())

    def available(self) -> list[str]:
        if self.stream is None:
            return sorted(self.labels)
        return sorted(r[0] for r in self.df.select(self.stream).distinct().collect() if r[0] is not None)


class EventSource:
    """Events of the common schema, such as a decoder's; selectors look in their labels (and the message under that name)."""

    def __init__(self, df: DataFrame, limit: int | None = None):
        self.df, self.limit = events(df), limit

    def scan(self, sel: ast.Selector, range_ms: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        of = lambda k: F.coalesce(label_of(k), F.col(k)) if k in ("message", "source", "stream") else label_of(k)
        df = self.df.where(selector(sel, of))
        if range_ms is not None and not df.isStreaming:
            if as_of_ms is None:
                as_of_ms = self.df.agg(F.max("ts_ms")).first()[0]
            if as_of_ms is not None:
                df = df.where((F.col("ts_ms") > as_of_ms - range_ms) & (F.col("ts_ms") <= as_of_ms))
        return df.orderBy("ts_ms", "seq").limit(self.limit) if self.limit else df

    def validate(self, query: str) -> bool:
        return bool(query.strip())

    def available(self) -> list[str]:
        return sorted(r[0] for r in self.df.select(F.explode(F.map_keys("labels"))).distinct().collect())
