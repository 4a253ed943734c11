"""Correlations: events of two or more streams that share a join value.

All streams are tagged, united and grouped by the value: one shuffle for any number of streams. No row pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import parse_duration
from ..plans import ast
from . import keys, predicates

#: Shapes of a result: nested (one record with all its events), summary (numbers alone), long (one row for each event).
OUTPUTS = ("nested", "summary", "long")
_ORDER = ("ts_ms", "stream_idx", "seq")


def _tagged(streams: list[DataFrame], join: ast.Join, on_mode: str) -> DataFrame:
    out = None
    for i, s in enumerate(streams):
        t = s.withColumn("stream_idx", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out.withColumn("join_value", keys.key(join, on_mode)).where("join_value is not null")


def within_two(ev: DataFrame, ms: int) -> DataFrame:
    """Events that have one of the other side at most ms away. Without a time there is no neighbour.

    Times are cut in buckets of the band's width: an event of the other side in the same bucket is near, one two
    buckets off isn't, and in the buckets beside the nearest is the last or the first. So a table of first and last
    times by value and bucket decides, and a value with many events is spread over its buckets.
    """
    width = max(ms, 1)
    timed = ev.where("ts_ms is not null").withColumn("_b", F.floor(F.col("ts_ms") / width))
    side = lambda f, i: f(F.when(F.col("stream_idx") == i, F.col("ts_ms")))
    ends = timed.groupBy("join_value", "_b").agg(*(side(f, i).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in (0, 1)))
    seen = ends.select("join_value", F.explode(F.array(*(F.struct((F.col("_b") + d).alias("_b"), F.lit(d).alias("d")) for d in (-1, 0, 1)))).alias("x"), "lo0", "lo1", "hi0", "hi1")
    at = lambda c, d: F.max(F.when(F.col("x.d") == d, F.col(c)))
    seen = seen.groupBy("join_value", F.col("x._b").alias("_b")).agg(*(x.alias(f"_{n}{i}") for i in (0, 1) for n, x in (("here", at(f"lo{i}", 0)), ("past", at(f"hi{i}", 1)), ("next", at(f"lo{i}", -1)))))
    near = F.lit(False)
    for mine, other in ((0, 1), (1, 0)):
        ok = F.col(f"_here{other}").isNotNull() | F.coalesce(F.col("ts_ms") - F.col(f"_past{other}") <= ms, F.lit(False)) | F.coalesce(F.col(f"_next{other}") - F.col("ts_ms") <= ms, F.lit(False))
        near = near | ((F.col("stream_idx") == mine) & ok)
    return timed.join(seen, ["join_value", "_b"]).where(near).select(*ev.columns)


def _event() -> Column:
    return F.struct("ts_ms", "stream_idx", "seq", F.col("stream").alias("alias"), "source", "timestamp", "message", "labels")


def _sorted(events: Column) -> Column:
    """By time, then stream, then arrival; what has no time comes first. Structs that hold maps need a comparator."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for c in reversed(_ORDER):
            x, y = F.coalesce(a[c].cast("long"), F.lit(-(1 << 62))), F.coalesce(b[c].cast("long"), F.lit(-(1 << 62)))
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.array_sort(events, compare)


def _record(df: DataFrame, join: ast.Join, complete: Column, matched: Column, total: int, ids: str, order: list[Column]) -> DataFrame:
    """The nested record from join_value, evs (sorted) and what order needs."""
    if ids == "counter":  # one partition by nature: the counter is global
        name = F.concat(F.lit("corr_"), F.row_number().over(W.orderBy(*order)).cast("string"))
    else:
        name = F.concat(F.lit("corr_"), F.substring(F.sha2(F.concat_ws("|", "join_value", F.col("evs")[0]["timestamp"], F.col("evs")[0]["seq"].cast("string"), F.size("evs").cast("string")), 256), 1, 16))
    first, last = F.col("evs")[0]["timestamp"], F.element_at("evs", -1)["timestamp"]
    return df.select(
        name.alias("correlation_id"), first.alias("timestamp"), F.struct(first.alias("start"), last.alias("end")).alias("time_window"),
        F.lit(join.keys[0] if join.keys else None).cast("string").alias("join_key"), "join_value",
        F.transform("evs", lambda e: F.struct(e["alias"].alias("alias"), e["source"].alias("source"), e["timestamp"].alias("timestamp"), e["message"].alias("message"), e["labels"].alias("labels"))).alias("events"),
        F.struct(F.when(complete, "complete").otherwise("partial").alias("completeness"), matched.alias("matched_streams"), F.lit(total).alias("total_streams")).alias("metadata"),
    )


def _numbers(n: int, keep: Column) -> list[Column]:
    return [
        *(F.count_if(F.col("stream_idx") == i).alias(f"n_{i}") for i in range(n)),
        F.count_if(keep).alias("n_events"), F.min(F.when(keep, F.col("ts_ms"))).alias("first_ms"), F.max(F.when(keep, F.col("ts_ms"))).alias("last_ms"),
        F.sum(F.when(keep, F.col("seq"))).alias("seq_sum"), F.min(F.when(F.col("stream_idx") == 0, F.col("seq"))).alias("first_seq"),
    ]


def two_way(left: DataFrame, right: DataFrame, join: ast.Join, matchers: tuple[ast.Matcher, ...] | None = None, output: str = "nested", on_mode: str = "coalesce", ids: str = "hash", within_everywhere: bool = False) -> DataFrame:
    """Correlations of two streams of events.

    and: values of both sides. or: all values of the left. unless: values of the left that the right lacks. within
    keeps events with one of the other side near them (for `and` without grouping; elsewhere with within_everywhere).
    A filter takes events out after the match is decided; a correlation without events goes.
    """
    if join.side and join.kind == "and":
        return _grouped(left, right, join, matchers, output, on_mode, ids, within_everywhere)
    ev = _tagged([left, right], join, on_mode)
    if join.within and (join.kind == "and" or within_everywhere):
        near = within_two(ev, parse_duration(join.within))
        ev = near if join.kind == "and" else ev.where("stream_idx = 0").unionByName(near.where("stream_idx = 1")) if join.kind == "or" else ev.join(near.select("join_value").distinct(), "join_value", "left_anti").where("stream_idx = 0")
    keep = predicates.event_filter(matchers)
    if join.kind == "unless":  # the right decides, and none of its events is kept
        keep = keep & (F.col("stream_idx") == 0)
    decided = {"and": "n_0 > 0 and n_1 > 0", "or": "n_0 > 0", "unless": "n_0 > 0 and n_1 = 0"}[join.kind]
    numbers = _numbers(2, keep)
    complete = (F.col("n_0") > 0) & (F.col("n_1") > 0)
    if output == "summary":
        out = ev.groupBy("join_value").agg(*numbers).where(decided).where("n_events > 0")
        return out.select("join_value", F.when(complete, "complete").otherwise("partial").alias("completeness"), F.col("n_0").alias("n_left"), F.col("n_1").alias("n_right"), "n_events", "first_ms", "last_ms", "seq_sum")
    if output == "long":
        good = ev.groupBy("join_value").agg(*numbers[:2]).where(decided)
        return ev.where(keep).join(good.select("join_value", F.when(complete, "complete").otherwise("partial").alias("completeness")), "join_value").drop("join_keys")
    got = ev.groupBy("join_value").agg(*numbers, F.collect_list(F.when(keep, _event())).alias("evs")).where(decided).where(F.size("evs") > 0).withColumn("evs", _sorted(F.col("evs")))
    matched = F.array_distinct(F.transform("evs", lambda e: e["source"]))
    return _record(got, join, complete, matched, 2, ids, [F.col("first_seq"), F.col("join_value")])


def _grouped(left: DataFrame, right: DataFrame, join: ast.Join, matchers: tuple[ast.Matcher, ...] | None, output: str, on_mode: str, ids: str, within_everywhere: bool) -> DataFrame:
    """One correlation for each event of one side, with all events of the other that share its value."""
    ev = _tagged([left, right], join, on_mode)
    if within_everywhere and join.within:
        ev = within_two(ev, parse_duration(join.within))
    one = 0 if join.side == "left" else 1
    keep = predicates.event_filter(matchers)
    each = ev.where(F.col("stream_idx") == one).select("join_value", F.col("seq").alias("one_seq"), F.col("ts_ms").alias("one_ms"), keep.alias("one_keep"), _event().alias("one_event"))
    many = ev.where(F.col("stream_idx") != one).groupBy("join_value")
    if output == "summary":
        sums = many.agg(F.count("*").alias("n_many"), F.count_if(keep).alias("n"), F.min(F.when(keep, F.col("ts_ms"))).alias("lo"), F.max(F.when(keep, F.col("ts_ms"))).alias("hi"), F.sum(F.when(keep, F.col("seq"))).alias("seqs"))
        t = F.when(F.col("one_keep"), F.col("one_ms"))
        out = each.drop("one_event").join(sums, "join_value")
        return out.select("join_value", "one_seq", "n_many", (F.col("n") + F.col("one_keep").cast("long")).alias("n_events"), F.least(t, "lo").alias("first_ms"), F.greatest(t, "hi").alias("last_ms"), (F.coalesce("seqs", F.lit(0)) + F.when(F.col("one_keep"), F.col("one_seq")).otherwise(0)).alias("seq_sum")).where("n_events > 0")
    if output == "long":
        return each.select("join_value", "one_seq").join(ev.where(keep).where((F.col("stream_idx") != one)).drop("join_keys"), "join_value").unionByName(ev.where(keep).where(F.col("stream_idx") == one).withColumn("one_seq", F.col("seq")).drop("join_keys").join(many.agg(F.lit(1).alias("_x")).select("join_value"), "join_value", "left_semi"))
    got = each.join(many.agg(F.collect_list(F.when(keep, _event())).alias("others")), "join_value")
    own = F.when(F.col("one_keep"), F.array("one_event")).otherwise(F.slice(F.array("one_event"), 1, 0))
    got = got.withColumn("evs", _sorted(F.concat(own, "others"))).where(F.size("evs") > 0)
    return _record(got, join, F.lit(True), F.array_distinct(F.transform("evs", lambda e: e["source"])), 2, ids, [F.col("one_seq"), F.col("join_value")])


def multi_way(streams: list[DataFrame], names: list[str], join: ast.Join, matchers: tuple[ast.Matcher, ...] | None = None, output: str = "nested", on_mode: str = "coalesce", ids: str = "hash", strict: bool = False, one_event: bool = False) -> DataFrame:
    """Correlations of three streams or more, by the first join's settings.

    and: values of all streams. or: all values. unless: values of one stream alone. within keeps events at most so long
    after a value's first event, for every kind; which streams matched is told before that. A filter keeps whole
    correlations in which, for each matcher, some event satisfies it (strict: only = and =~ count), or with one_event
    those in which one event satisfies all.
    """
    n = len(streams)
    ev = _tagged(streams, join, on_mode)
    there = [F.count_if(F.col("stream_idx") == i).alias(f"n_{i}") for i in range(n)]
    if join.within:
        stats = ev.groupBy("join_value").agg(*(c.alias(f"_n{i}") for i, c in enumerate(there)), F.min("ts_ms").alias("_first"))
        ev = ev.join(stats, "join_value").where(F.col("ts_ms") - F.col("_first") <= parse_duration(join.within))
        there = [F.max(f"_n{i}").alias(f"n_{i}") for i in range(n)]
    present = sum((F.col(f"n_{i}") > 0).cast("int") for i in range(n))
    decided = {"and": present == n, "or": present >= 1, "unless": present == 1}[join.kind]
    wanted = [m for m in matchers or () if not strict or m.op in ("=", "=~")]
    tests = [predicates.matcher(m, predicates.label_of, False) for m in wanted]
    tests = [F.bool_or(t).alias(f"_f{i}") for i, t in enumerate([predicates.all_of(tests)] if one_event and tests else tests)]
    numbers = [*there, F.count("*").alias("n_events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.sum("seq").alias("seq_sum"), F.min(F.struct("stream_idx", "seq")).alias("_order"), *tests]
    passed = predicates.all_of([F.col(f"_f{i}") for i in range(len(tests))])
    matched = F.filter(F.array(*(F.when(F.col(f"n_{i}") > 0, F.lit(x)) for i, x in enumerate(names))), lambda x: x.isNotNull())
    complete = present == n
    if output == "long":
        good = ev.groupBy("join_value").agg(*numbers).where(decided).where(passed)
        return ev.drop("join_keys", "_first", *(f"_n{i}" for i in range(n))).join(good.select("join_value", F.when(complete, "complete").otherwise("partial").alias("completeness")), "join_value")
    if output == "summary":
        got = ev.groupBy("join_value").agg(*numbers).where(decided).where(passed)
        return got.select("join_value", F.when(complete, "complete").otherwise("partial").alias("completeness"), F.array_join(matched, ",").alias("matched_streams"), "n_events", "first_ms", "last_ms", "seq_sum")
    got = ev.groupBy("join_value").agg(*numbers, F.collect_list(_event()).alias("evs")).where(decided).where(passed).withColumn("evs", _sorted(F.col("evs")))
    return _record(got, join, complete, matched, n, ids, [F.col("_order"), F.col("join_value")])


def parallel(left: DataFrame, right: DataFrame, join: ast.Join, on_mode: str = "coalesce") -> DataFrame:
    """Inner correlations in order of arrival, without filter, times or sorting: start is the first left event, end the last right one."""
    ev = _tagged([left, right], join, on_mode)
    pick = lambda f, i: f(F.when(F.col("stream_idx") == i, F.struct("seq", "timestamp")))
    got = ev.groupBy("join_value").agg(*_numbers(2, F.lit(True)), pick(F.min, 0).alias("a"), pick(F.max, 1).alias("b")).where("n_0 > 0 and n_1 > 0")
    return got.select("join_value", F.col("n_0").alias("n_left"), F.col("n_1").alias("n_right"), F.col("a.timestamp").alias("start"), F.col("b.timestamp").alias("end"), F.array(F.lit("left"), F.lit("right")).alias("matched_streams"))
