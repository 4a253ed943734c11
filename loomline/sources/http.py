"""Log servers over HTTP: Loki, Graylog (both searches) and Prometheus as batch and streaming sources.

A time range is cut into slices, one task each, so a lost executor costs a slice's request and nothing else. Offsets of
streams are times, and ranges are half-open: a repeated batch asks for the same slice again. An answer that a server
cut at its limit is asked for again in halves until it is whole.
"""

from __future__ import annotations

import base64
import csv
import io
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import CorrelationError
from ..functions.times import iso_text
from ..plans import ast
from . import decoders, sockets

#: Rows a request asks for, seconds it may take, tries after a failure, waits between them in seconds. Fixed values.
LIMIT, TIMEOUT_S, RETRIES, FIRST_WAIT_S, LONGEST_WAIT_S = 1000, 30, 3, 1.0, 30.0
KINDS = ("loki", "graylog", "graylog_views", "prometheus")
#: Fields that a views search asks for. Fixed values.
VIEW_FIELDS = (
    "timestamp", "source", "message", "_id", "level", "severity", "tier", "application", "http_status_class", "status", "http_status", "trace_id", "request_id", "correlation_id", "session_id",
    "span_id", "host", "service", "component", "module", "user", "client_ip", "method", "path", "url", "response_time", "duration", "size",
)
_ERRORS = {"loki": "LOKI_QUERY_ERROR", "graylog": "GRAYLOG_SEARCH_ERROR", "graylog_views": "GRAYLOG_SEARCH_ERROR", "prometheus": "PROMQL_QUERY_ERROR"}
_LISTING_ERRORS = {**_ERRORS, "loki": "LOKI_LABELS_ERROR", "graylog": "GRAYLOG_STREAMS_ERROR", "graylog_views": "GRAYLOG_STREAMS_ERROR"}


class Client:
    """Requests to one server. options (all texts): url, kind, and any of token, user, password, headers (a JSON object),
    proxy (http://, or socks4:// or socks5://), timeout (seconds), retries, first_wait (seconds), limit, stream (a Graylog stream's name), step (seconds)."""

    def __init__(self, options: dict[str, str]):
        # Spark hands options over with names in lower case.
        o = self.options = {k.lower(): v for k, v in options.items()}
        self.kind, self.url = o.get("kind", "loki"), o["url"].rstrip("/")
        if self.kind not in KINDS:
            raise CorrelationError(f"Unknown kind of server: {self.kind}", "ADAPTER_NOT_FOUND", {"availableAdapters": list(KINDS)})
        self.limit, self.timeout = int(o.get("limit", LIMIT)), float(o.get("timeout", TIMEOUT_S))
        self.retries, self.wait = int(o.get("retries", RETRIES)), float(o.get("first_wait", FIRST_WAIT_S))
        self.headers = {"Accept": "application/json", **json.loads(o.get("headers", "{}"))}
        if self.kind.startswith("graylog"):
            self.headers.setdefault("X-Requested-By", "loomline")
            if not o.get("token") and not (o.get("user") and o.get("password")):
                raise CorrelationError("Graylog needs a token, or a user and a password", "AUTH_REQUIRED")
        if o.get("token"):
            # Graylog takes a token in a user's place.
            self.headers["Authorization"] = self._basic(o["token"], "token") if self.kind.startswith("graylog") else f"Bearer {o['token']}"
        elif o.get("user"):
            self.headers["Authorization"] = self._basic(o["user"], o.get("password", ""))
        proxy = o.get("proxy", "")
        if proxy.startswith("socks"):
            self.opener = urllib.request.build_opener(*sockets.handlers(proxy))
        else:
            self.opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy} if proxy else {}))

    @staticmethod
    def _basic(user: str, password: str) -> str:
        return "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()

    def ask(self, path: str, params: dict | None = None, body: dict | None = None, accept: str | None = None, code: str | None = None) -> str:
        """The answer's text. Failures of the server and of the network are tried again, what a client did wrong isn't."""
        url = self.url + path + ("?" + urllib.parse.urlencode(params) if params else "")
        head = {**self.headers, **({"Accept": accept} if accept else {}), **({"Content-Type": "application/json"} if body is not None else {})}
        data = None if body is None else json.dumps(body).encode()
        for n in range(self.retries + 1):
            try:
                with self.opener.open(urllib.request.Request(url, data, head), timeout=self.timeout) as r:
                    return r.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                told, final = f"HTTP {e.code}: {e.reason}", e.code < 500 and e.code != 429
            except OSError as e:
                told, final = str(e), False
            if final or n == self.retries:
                raise CorrelationError(f"{self.kind}: {told}", code or _ERRORS[self.kind], {"url": self.url + path})
            time.sleep(min(LONGEST_WAIT_S, self.wait * 2**n) + random.uniform(0, self.wait))
        raise AssertionError

    def names(self) -> list[str]:
        """Label names (Loki), titles of streams (Graylog), names of metrics (Prometheus)."""
        code = _LISTING_ERRORS[self.kind]
        if self.kind.startswith("graylog"):
            return [s.get("title") or s.get("name") or "" for s in self._streams()]
        path = "/loki/api/v1/labels" if self.kind == "loki" else "/api/v1/label/__name__/values"
        return json.loads(self.ask(path, code=code)).get("data") or []

    def _streams(self) -> list[dict]:
        return json.loads(self.ask("/api/streams", code=_LISTING_ERRORS[self.kind])).get("streams") or []

    def stream_id(self) -> str | None:
        """Id of the stream that the options name; a name that no stream has filters nothing."""
        name = self.options.get("stream")
        return decoders.stream_id(self._streams(), name) if name else None

    def bodies(self, query: str, start: int, end: int) -> Iterator[str]:
        """Answers that hold what lies in [start, end): nanoseconds for Loki, milliseconds for the others."""
        if self.kind == "prometheus":
            step = int(self.options["step"]) * 1000
            # Samples lie at multiples of the step, whatever the slice; the server takes both ends.
            first, last = -(-start // step) * step, (end - 1) // step * step
            if first <= last:
                yield self.ask("/api/v1/query_range", {"query": query, "start": first / 1000, "end": last / 1000, "step": step // 1000})
            return
        yield from self._whole(query, start, end, self.limit, self.stream_id() if self.kind.startswith("graylog") else None)

    def _whole(self, query: str, start: int, end: int, limit: int, stream: str | None) -> Iterator[str]:
        if start >= end:
            return
        body, n = getattr(self, "_" + self.kind)(query, start, end, limit, stream)
        if n < limit:
            yield body
        elif end - start > 1:
            mid = (start + end) // 2
            yield from self._whole(query, start, mid, limit, stream)
            yield from self._whole(query, mid, end, limit, stream)
        else:  # one moment that holds more than a request's rows: more are asked for, until all come or the server refuses
            yield from self._whole(query, start, end, limit * 2, stream)

    def _loki(self, query: str, start: int, end: int, limit: int, _: str | None) -> tuple[str, int]:
        body = self.ask("/loki/api/v1/query_range", {"query": query, "start": start, "end": end, "limit": limit, "direction": "forward"})
        return body, sum(len(s.get("values") or []) for s in (json.loads(body).get("data") or {}).get("result") or [])

    def _graylog(self, query: str, start: int, end: int, limit: int, stream: str | None) -> tuple[str, int]:
        params = {"query": decoders.rewrite_graylog(query) or "*", "from": iso_text(start), "to": iso_text(end - 1), "limit": limit, "sort": "timestamp:asc"}
        body = self.ask("/api/search/universal/absolute", {**params, **({"filter": f"streams:{stream}"} if stream else {})})
        return body, len(json.loads(body).get("messages") or [])

    def _graylog_views(self, query: str, start: int, end: int, limit: int, stream: str | None) -> tuple[str, int]:
        """The CSV answer, given back in the shape of the other search."""
        ask = {
            "query_string": {"type": "elasticsearch", "query_string": decoders.sanitize_graylog(query)},
            "timerange": {"type": "absolute", "from": iso_text(start), "to": iso_text(end - 1)},
            "fields_in_order": list(VIEW_FIELDS), "limit": limit, "streams": [stream] if stream and len(stream) == 24 and all(c in "0123456789abcdefABCDEF" for c in stream) else [],
        }
        rows = list(csv.reader(io.StringIO(self.ask("/api/views/search/messages", body=ask, accept="text/csv"))))
        names, out = [c.strip().lower() for c in rows[0]] if rows else [], []
        for i, r in enumerate(r for r in rows[1:] if len(r) == len(names)):
            m = dict(zip(names, r, strict=True))
            own = {k: m.pop(k, "") for k in ("message", "timestamp", "source")}
            out.append({"message": {"_id": m.pop("_id", "") or f"msg_{i}", **own, "fields": {k: v for k, v in m.items() if v}}})
        return json.dumps({"messages": out}), max(0, len(rows) - 1)


class _Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _slices(start: int, end: int, n: int) -> list[_Slice]:
    cuts = [start + (end - start) * k // n for k in range(n + 1)]
    return [_Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [_Slice(start, start)]


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        # Loki's clock counts nanoseconds.
        self.unit = 1_000_000 if self.options.get("kind", "loki") == "loki" else 1
        Client(self.options)

    def cut(self, start_ms: int, end_ms: int) -> list[_Slice]:
        return _slices(start_ms * self.unit, end_ms * self.unit, max(1, int(self.options.get("slices", 1))))

    def read(self, part: _Slice) -> Iterator[tuple[str]]:
        for body in Client(self.options).bodies(self.options.get("query", ""), part.start, part.end):
            yield (body,)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[_Slice]:
        return self.cut(int(self.options["start_ms"]), int(self.options["end_ms"]))


class _Stream(_Reader, DataSourceStreamReader):
    """delay_ms: how long a moment may still gain events; a batch ends so long before now."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ms": int(self.options["start_ms"])}

    def latestOffset(self) -> dict:  # noqa: N802
        now = int(time.time() * 1000) - int(self.options.get("delay_ms", 0))
        return {"ms": max(int(self.options["start_ms"]), min(now, int(self.options.get("end_ms", now))))}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        return self.cut(start["ms"], end["ms"])


class LogServer(DataSource):
    """Format `log_server`: a column body with the server's answers. Options: those of Client, query, start_ms and
    end_ms (milliseconds, the end excluded; a stream needs none), slices, delay_ms."""

    @classmethod
    def name(cls) -> str:
        return "log_server"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


class ServerSource:
    """A source that asks a server. The selector's text goes to the server, which filters; ranges end at as_of_ms or now."""

    def __init__(self, spark: SparkSession, kind: str, url: str, slices: int = 8, **options: str):
        self.spark, self.kind, self.slices = spark, kind, slices
        self.options = {**{k: str(v) for k, v in options.items()}, "kind": kind, "url": url}
        Client(self.options)  # tells at once what is missing
        spark.dataSource.register(LogServer)

    def _decoded(self, bodies: DataFrame) -> DataFrame:
        decode = {"loki": decoders.loki, "prometheus": decoders.prometheus}.get(self.kind, decoders.graylog_json)
        return decode(bodies)

    def _with(self, query: str, **more: object) -> dict[str, str]:
        if not self.validate(query):
            raise CorrelationError(f"Invalid query: {query}", "PROMQL_PARSE_ERROR" if self.kind == "prometheus" else _ERRORS[self.kind])
        return {**self.options, "query": query, "slices": str(self.slices), **{k: str(v) for k, v in more.items()}}

    def scan(self, sel: ast.Selector, range_ms: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        """Events in (as_of - range, as_of]; without a range, of five minutes. seq follows slices, which follow time."""
        end = int(time.time() * 1000) if as_of_ms is None else as_of_ms
        length = 300_000 if range_ms is None else range_ms
        step = self.options.get("step") or decoders.step_seconds(length)
        o = self._with(sel.text(), start_ms=end - length + 1, end_ms=end + 1, step=step)
        return self._decoded(self.spark.read.format("log_server").options(**o).load()).withColumn("seq", F.monotonically_increasing_id())

    def stream(self, query: str, start_ms: int | None = None, end_ms: int | None = None, delay_ms: int = 0) -> DataFrame:
        """Events from start_ms (now, if not given) on; the trigger's interval is how often the server is asked."""
        more = {} if end_ms is None else {"end_ms": end_ms}
        o = self._with(query, start_ms=int(time.time() * 1000) if start_ms is None else start_ms, delay_ms=delay_ms, step=self.options.get("step") or decoders.step_seconds(0), **more)
        return self._decoded(self.spark.readStream.format("log_server").options(**o).load())

    def tail(self, query: str) -> sockets.Tail:
        """What a Loki server sends as it comes in; land() it in a folder and read that with sockets.landed()."""
        c = Client(self.options)
        return sockets.Tail(c.url, query, {k: v for k, v in c.headers.items() if k != "Accept"}, c.retries, c.wait, self.options.get("proxy"))

    def validate(self, query: str) -> bool:
        return {"loki": decoders.valid_loki, "prometheus": decoders.valid_prometheus}.get(self.kind, decoders.valid_graylog)(query)

    def available(self) -> list[str]:
        return Client(self.options).names()
