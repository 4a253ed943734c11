"""The engine: sources by name, queries to lazy frames."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import CorrelationError
from .operators import correlate, predicates
from .plans import ast
from .plans.parser import parse
from .sources.base import LogSource, Registry, range_ms
from .streaming.metrics import Monitor

log = logging.getLogger(__name__)


@dataclass
class Options:
    """default_range: for streams read without one. late_ms: lateness of streams. output: summary (numbers alone), long
    (a row for each event) or nested (one record with all its events, so a hot value fills one row). on_mode: coalesce or composite keys. ids: hash or counter. within_everywhere: time bounds for every kind of join.
    strict: a filter's matchers that are no name with a value in double quotes are passed over, and of a correlation's
    filter all but = and =~. one_event: a correlation's filter asks for one event that satisfies all matchers.
    max_memory_mb: heap of the driver from which memoryWarning is told. as_of_ms: the end of all ranges; None: each table's last time.
    max_events and time_window are taken for compatibility and change no result."""

    default_range: str = "5m"
    late_ms: int = 30_000
    output: str = "summary"
    on_mode: str = "coalesce"
    ids: str = "hash"
    within_everywhere: bool = False
    strict: bool = False
    one_event: bool = False
    max_memory_mb: float = 100.0
    as_of_ms: int | None = None
    max_events: int | None = None
    time_window: str | None = None


@dataclass
class Engine:
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        self.registry = Registry()
        self.listeners: dict[str, list[Callable]] = {}
        if self.options.max_events is not None or self.options.time_window is not None:
            log.info("max_events and time_window have no effect on results")

    def on(self, event: str, fn: Callable) -> None:
        """fn is called at adapterAdded (a name), correlationFound (a row, by emit), performanceMetrics and memoryWarning (numbers, by emit and watch)."""
        self.listeners.setdefault(event, []).append(fn)

    def _tell(self, event: str, what: object) -> None:
        for fn in self.listeners.get(event, []):
            fn(what)

    def add_source(self, name: str, source: LogSource) -> None:
        self.registry.add(name, source)
        self._tell("adapterAdded", name)

    def parse(self, query: str) -> ast.Query:
        q = parse(query.strip())
        if not q.join.keys and q.join.ignoring is None:
            raise CorrelationError("Join keys are required", "QUERY_PARSE_ERROR")
        for w in q.warnings:
            log.warning(w)
        return q

    def validate(self, query: str) -> bool:
        try:
            self.parse(query)
        except CorrelationError:
            return False
        return True

    def correlate(self, query: str) -> DataFrame:
        """A lazy frame of the query's correlations; nothing runs but what a range without as_of_ms needs to know."""
        q, o = self.parse(query), self.options
        sources = [self.registry.find(s.source) for s in q.streams]
        streams = [f.scan(s.selector, range_ms(s.time_range or o.default_range), o.as_of_ms) for f, s in zip(sources, q.streams, strict=True)]
        matchers = predicates.lenient(q.filter) if o.strict else q.filter
        if len(streams) == 2:
            return correlate.two_way(*streams, q.join, matchers, o.output, o.on_mode, o.ids, o.within_everywhere)
        return correlate.multi_way(streams, [s.source for s in q.streams], q.join, matchers, o.output, o.on_mode, o.ids, o.strict, o.one_event)

    def emit(self, query: str) -> int:
        """Calls the correlationFound listeners with each row, as rows arrive at the driver one partition at a time; then tells how it went."""
        n, start, out = 0, time.time(), self.correlate(query)
        for row in out.toLocalIterator():
            self._tell("correlationFound", row)
            n += 1
        took = time.time() - start
        self._tell("performanceMetrics", {"correlations": n, "seconds": took, "correlations_per_second": n / took})
        self._check_memory(out.sparkSession)
        return n

    def _check_memory(self, spark: SparkSession) -> None:
        heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        used = (heap.totalMemory() - heap.freeMemory()) / 1e6
        if used > self.options.max_memory_mb:
            self._tell("memoryWarning", {"used_mb": used, "limit_mb": self.options.max_memory_mb})

    def watch(self, spark: SparkSession) -> Monitor:
        """Tells the progress of the session's streaming queries as performanceMetrics and memoryWarning; spark.streams.removeListener(it) ends that."""
        names = {"metrics": "performanceMetrics", "highMemoryUsage": "memoryWarning"}
        m = Monitor(lambda event, what: self._tell(names.get(event, event), what), self.options.max_memory_mb)
        spark.streams.addListener(m)
        return m

    def available(self) -> dict[str, list[str]]:
        """Streams of every source; one that fails has none."""
        out = {}
        for name, s in self.registry.sources.items():
            try:
                out[name] = s.available()
            except Exception as e:  # noqa: BLE001 - listing never fails as a whole
                log.warning("%s: %s", name, e)
                out[name] = []
        return out


def normalise(query: str) -> str:
    """White space outside quotes as single spaces."""
    return "".join(p if k % 2 else re.sub(r"\s+", " ", p) for k, p in enumerate(re.split(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", query.strip())))
