"""Correlations of live streams: state by join value, one snapshot for each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import keys
from ..plans import ast
from ..schema import EVENT, events

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ITEM = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("message", T.StringType())])
OUT = T.StructType(
    [
        T.StructField("join_value", T.StringType()),
        T.StructField("completeness", T.StringType()),
        T.StructField("n_left", T.LongType()),
        T.StructField("n_right", T.LongType()),
        T.StructField("seqs", T.ArrayType(T.LongType())),
    ]
)


#: A moment after all events, and the join value of what lies past it. Two events there push the watermark past every value's time.
END_MS, _END = 253_000_000_000_000, "\0end"


class _Join(StatefulProcessor):
    """kind: and, or, unless. live: a value's snapshot is emitted at the first moment that decides it, and once. Else
    a value is answered from all that came when its time is over: late_ms after its first event, by the watermark or,
    with clock "processing", by the time of arrival. Then what is still open is answered by its kind of join.

    State: how many events each side has (so an open value costs one small read an event), the events that an answer
    would hold, gone once it is given, and when the value's time began. A live value that was answered keeps that
    alone until its time is over.
    """

    def __init__(self, kind: str, live: bool, late_ms: int, clock: str):
        self.kind, self.live, self.late_ms, self.clock = kind, live, late_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = [handle.getListState(n, _ITEM) for n in ("left", "right")]
        number = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
        self.counts = handle.getValueState("counts", number("left", "right"))
        self.began = handle.getValueState("began", number("at", "answered"))

    def _snapshot(self, key: tuple) -> Row:
        left, right = ([tuple(x) for x in s.get()] for s in self.sides)
        both = sorted([(x[0], 0, x[1]) for x in left] + [(x[0], 1, x[1]) for x in right], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        return Row(join_value=key[0], completeness="complete" if left and right else "partial", n_left=len(left), n_right=len(right), seqs=[x[2] for x in both])

    def _forget(self, *states) -> None:
        for s in (*self.sides, self.counts, *states):
            s.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] == _END:
            return
        began, answered = self.began.get() if self.began.exists() else (None, 0)
        n = list(self.counts.get()) if self.counts.exists() else [0, 0]
        new: list[list[tuple]] = [[], []]
        for r in sorted(rows, key=lambda r: r.seq):
            now = timerValues.getCurrentProcessingTimeInMs() if self.clock == "processing" else r.ts_ms or 0
            if began is None:
                began = now
                self.handle.registerTimer(began + self.late_ms)
                self.began.update((began, 0))
            if answered or self.clock == "processing" and now - began > self.late_ms:
                continue
            new[r.stream_idx].append((r.ts_ms, r.seq, r.message))
            n[r.stream_idx] += 1
            if self.live and (n[0] and n[1] or self.kind == "or"):
                for s, items in zip(self.sides, new, strict=True):
                    s.appendList(items) if items else None
                yield self._snapshot(key)
                self._forget()
                answered = 1
                self.began.update((began, 1))
        if not answered:
            for s, items in zip(self.sides, new, strict=True):
                s.appendList(items) if items else None
            self.counts.update(tuple(n))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        n = self.counts.get() if self.counts.exists() else (0, 0)
        if {"and": n[0] and n[1], "or": n[0], "unless": n[0] and not n[1]}[self.kind]:
            yield self._snapshot(key)
        self._forget(self.began)

    def close(self) -> None:
        return


def join(left: DataFrame, right: DataFrame, how: ast.Join, late_ms: int = 30_000, live: bool = False, clock: str = "event") -> DataFrame:
    """A stream of correlations of two streams of events (EVENT), with append output: OUT.

    live: `and` and `unless` emit a complete snapshot when both sides first hold a value, `or` a snapshot at the first
    event of either side; later events change nothing. When a value's time is over, what is open is answered by the
    kind of join, so `unless` names what the right lacked. Without live that is the only answer.

    clock "event": a value's time ends when the watermark passes its first event by late_ms, and events behind the
    watermark are late. "processing": it ends late_ms after its first event arrived, and what arrives later is late.
    An event after that begins the value anew. finish() ends all times at the end of a stream of files.
    """
    spark = left.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    both = events(left).withColumn("stream_idx", F.lit(0)).unionByName(events(right).withColumn("stream_idx", F.lit(1)))
    if clock == "event":
        both = both.where("ts_ms is not null").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", f"{late_ms} milliseconds")
    cols = ["join_value", "stream_idx", "ts_ms", "seq", "message", *(["at"] if clock == "event" else [])]
    # What ends a stream must reach the watermark, so it has a value of its own.
    value = F.when(F.col("ts_ms") >= END_MS, F.lit(_END)).otherwise(keys.key(how))
    rows = both.withColumn("join_value", value).where("join_value is not null").select(*cols)
    return rows.groupBy("join_value").transformWithState(_Join(how.kind, live, late_ms, clock), OUT, "append", "EventTime" if clock == "event" else "ProcessingTime")


def finish(spark: SparkSession, path: str) -> None:
    """Adds to a folder of JSON events what ends all event times at the next trigger; it joins with nothing."""
    for k in range(2):
        last = spark.createDataFrame([(None, "end", None, "", None, None, END_MS + k, END_MS + k)], EVENT)
        last.coalesce(1).write.mode("append").json(path)


def dedup(stream: DataFrame, fields: tuple[str, ...] = ("timestamp", "message", "source"), window_ms: int = 5_000) -> DataFrame:
    """One event of those with equal fields within the watermark; state older than it goes."""
    at = events(stream).withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", f"{window_ms} milliseconds")
    at = at.withColumn("_labels", F.to_json("labels")) if "labels" in fields else at
    return at.dropDuplicatesWithinWatermark([f if f != "labels" else "_labels" for f in fields]).drop("_at", "_labels")


def window_counts(stream: DataFrame, window: str, slide: str | None = None, late_ms: int = 30_000) -> DataFrame:
    """Events of each source in tumbling or sliding windows, emitted when the watermark passes them."""
    at = events(stream).withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", f"{late_ms} milliseconds")
    return at.groupBy(F.window("_at", window, slide) if slide else F.window("_at", window), "source").agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, gap: str, label: str, late_ms: int = 30_000) -> DataFrame:
    """Events of each value of a label in sessions that end after a gap without events, emitted when the watermark passes them: value, window, n."""
    at = events(stream).withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", f"{late_ms} milliseconds")
    at = at.withColumn("value", F.when(F.col("ts_ms") >= END_MS, F.lit(_END)).otherwise(F.element_at("labels", F.lit(label)))).where("value is not null")
    out = at.groupBy(F.session_window("_at", gap).alias("window"), "value").agg(F.count("*").alias("n"))
    return out.where(F.col("window.start") < F.timestamp_millis(F.lit(END_MS)))


def paced(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 10, fmt: str = "json") -> DataFrame:
    """A file stream that takes so many files at once: Spark's own form of backpressure."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
