"""Metrics of running queries, and warnings about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

#: Latency in ms, rows a second after so many rows, state memory in MB from which a warning is given. Fixed values.
HIGH_LATENCY_MS, LOW_ROWS, AFTER_ROWS, HIGH_STATE_MB = 100, 10, 100, 100


class Monitor(StreamingQueryListener):
    """Tells each progress to `listen(event, details)`: metrics, then highLatency, lowThroughput or highMemoryUsage where they hold."""

    def __init__(self, listen: Callable[[str, dict], None], high_state_mb: float = HIGH_STATE_MB):
        self.listen, self.rows, self.high_state_mb = listen, 0, high_state_mb

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.listen("started", {"id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        m = {"events_processed": self.rows, "events_per_second": p.processedRowsPerSecond or 0.0, "latency_ms": p.batchDuration, "state_mb": sum(s.memoryUsedBytes for s in p.stateOperators) / 1e6}
        self.listen("metrics", m)
        for name, bad in (("highLatency", m["latency_ms"] > HIGH_LATENCY_MS), ("lowThroughput", self.rows > AFTER_ROWS and m["events_per_second"] < LOW_ROWS), ("highMemoryUsage", m["state_mb"] > self.high_state_mb)):
            if bad:
                self.listen(name, m)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.listen("terminated", {"id": str(event.id)})
