"""An event store over a table, deduplication, merging and analyses of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import COLUMNS, events
from .predicates import label_of


class EventStore:
    """Events that are looked up by labels and times. Lookups are filters, so a table's columns and statistics prune them."""

    def __init__(self, df: DataFrame):
        self.df = events(df)
        self.hits = self.misses = 0

    def add(self, df: DataFrame) -> EventStore:
        out = EventStore(self.df.unionByName(events(df)))
        out.hits, out.misses = self.hits, self.misses
        return out

    def lookup(self, key: str, value: str) -> DataFrame:
        """Events whose label or join key has the value."""
        return self.df.where((label_of(key) == value) | (F.element_at("join_keys", F.lit(key)) == value))

    def time_range(self, start_ms: int, end_ms: int) -> DataFrame:
        """Events from start to end, both included."""
        return self.df.where(F.col("ts_ms").between(start_ms, end_ms))

    def prune(self, cutoff_ms: int) -> EventStore:
        """Without the events before the cutoff; those at it stay."""
        return EventStore(self.df.where((F.col("ts_ms") >= cutoff_ms) | F.col("ts_ms").isNull()))

    def correlations(self, left_key: str, right_key: str) -> DataFrame:
        """Values under both names: value, n_left, n_right, left_seq and right_seq sums; one grouping, no pairs."""
        both = [F.struct(F.lit(i).alias("i"), label_of(k).alias("value")) for i, k in enumerate((left_key, right_key))]
        rows = self.df.select("seq", F.explode(F.array(*both)).alias("x")).where("x.value is not null and x.value <> ''")
        side = lambda i: F.col("x.i") == i
        out = rows.groupBy(F.col("x.value").alias("value")).agg(*(f.alias(n) for i, n in enumerate(("left", "right")) for f, n in ((F.count_if(side(i)), f"n_{n}"), (F.sum(F.when(side(i), F.col("seq"))), f"{n}_seq"))))
        return out.where("n_left > 0 and n_right > 0")

    def count_lookup(self, key: str, value: str) -> bool:
        """Whether a lookup finds anything, counted for hit_rate."""
        found = not self.lookup(key, value).isEmpty()
        self.hits, self.misses = self.hits + found, self.misses + (not found)
        return found

    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else float("nan")


_FIELDS = ("timestamp", "message", "source", "labels")


def _dedup_key(fields: tuple[str, ...]) -> list[Column]:
    one = lambda f: F.array_sort(F.map_entries("labels")) if f == "labels" else F.col(f)
    return [one(f) for f in fields if f in _FIELDS] or [F.lit(1)]


def dedup(df: DataFrame, fields: tuple[str, ...] = ("timestamp", "message", "source"), window_ms: int | None = None) -> DataFrame:
    """One event, the first to arrive, of those with equal fields.

    window_ms: an event within so long of the last one kept goes, without extending the window. Equal events are a
    chain in order of time; each task reads its chains sorted, one batch at a time, and remembers the last event kept.
    Events without a time stay, and so do all in a field list of which no field is known, but one.
    """
    keyed = events(df).withColumn("_k", text.content_hash(*_dedup_key(fields)))
    if window_ms is None:
        first = F.min_by(F.struct(*COLUMNS), F.struct("seq", "ts_ms", "stream", "source", "message"))
        return keyed.groupBy("_k").agg(first.alias("_e")).select("_e.*")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (k, t) in enumerate(zip(b.column("_k").to_pylist(), b.column("ts_ms").to_pylist(), strict=True)):
                if k != key:
                    key, last = k, None
                if t is None or last is None or t - last >= window_ms:
                    keep[i], last = True, last if t is None else t
            yield b.filter(pa.array(keep))

    chains = keyed.repartition("_k").sortWithinPartitions("_k", "ts_ms", "seq")
    return chains.mapInArrow(anchored, chains.schema).drop("_k")


def merge(streams: dict[str, DataFrame]) -> DataFrame:
    """All events of all streams with the stream's name; none is lost."""
    out = None
    for name, df in streams.items():
        t = events(df).withColumn("name", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def process_windows(df: DataFrame, ms: int, fn) -> DataFrame:
    """fn (a pandas frame of events -> one of events) over every tumbling window of ms, side by side."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events(df).schema.fields)
    return events(df).groupBy(F.floor(F.col("ts_ms") / ms).alias("w")).applyInPandas(lambda f: fn(f[COLUMNS]), names)


def window_buffer(df: DataFrame, start_ms: int, end_ms: int, late_ms: int, most: int, key: Column) -> DataFrame:
    """Events from start - late to end, the first `most` of each key by arrival."""
    from pyspark.sql import Window as W

    rows = events(df).where(F.col("ts_ms").between(start_ms - late_ms, end_ms)).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("seq")))
    return rows.where(F.col("_n") <= most).drop("_n")


def is_expired(now_ms: int, end_ms: int, late_ms: int) -> bool:
    return now_ms > end_ms + late_ms


def error_patterns(df: DataFrame) -> DataFrame:
    """Counts of error classes."""
    return df.groupBy(text.error_class(F.col("message")).alias("error_class")).agg(F.count("*").alias("n"))


def cascades(long: DataFrame, first: int = 0, then: int = 1, critical_ms: int = 100) -> DataFrame:
    """From correlations in long shape: time from a value's first event of one stream to the first of another, and whether it is critical."""
    at = lambda i: F.min(F.when(F.col("stream_idx") == i, F.col("ts_ms")))
    out = long.groupBy("join_value").agg((at(then) - at(first)).alias("delta_ms")).where("delta_ms is not null")
    return out.withColumn("critical", F.abs("delta_ms") < critical_ms)


def stream_metrics(df: DataFrame, now_ms: int, recent: int = 1000) -> DataFrame:
    """events_processed, average_latency_ms of the last `recent` events and events per second of the stream's span."""
    last = events(df).orderBy(F.desc("seq")).limit(recent).agg(F.avg(F.lit(now_ms) - F.col("ts_ms")).alias("average_latency_ms"))
    span = events(df).agg(F.count("*").alias("events_processed"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("span_s"))
    return span.crossJoin(F.broadcast(last)).select("events_processed", "average_latency_ms", F.when(F.col("span_s") > 0, F.col("events_processed") / F.col("span_s")).alias("events_per_second"))
