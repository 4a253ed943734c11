"""Sources over HTTP, against servers in this process that hold events in memory."""

import json
import threading
import urllib.parse
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomline.engine import Engine, Options
from loomline.errors import CorrelationError
from loomline.sources.http import Client, ServerSource

T0 = 1_700_000_000_000
#: 40 moments, one of which holds 9 events; tests ask for 4 at a time.
TIMES = sorted([T0 + 250 * k for k in range(40)] + [T0 + 2500] * 8)


class Handler(BaseHTTPRequestHandler):
    seen: list = []
    failures = 0

    def log_message(self, *_):
        return

    def send(self, body: str, code: int = 200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def answer(self, body: dict | None = None):
        url = urllib.parse.urlparse(self.path)
        q = dict(urllib.parse.parse_qsl(url.query))
        Handler.seen.append((url.path, q, dict(self.headers), body))
        if Handler.failures:
            Handler.failures -= 1
            return self.send("busy", 503)
        ms = lambda t: round(datetime.fromisoformat(t).timestamp() * 1000)
        if url.path == "/loki/api/v1/query_range":
            got = [t for t in TIMES if int(q["start"]) <= t * 1_000_000 < int(q["end"])][: int(q["limit"])]
            values = [[str(t * 1_000_000), f"m{t} request_id=r{t % 3}"] for t in got]
            return self.send(json.dumps({"status": "success", "data": {"resultType": "streams", "result": [{"stream": {"job": "web"}, "values": values}]}}))
        if url.path == "/api/search/universal/absolute":
            got = [t for t in TIMES if ms(q["from"]) <= t <= ms(q["to"])][: int(q["limit"])]
            at = lambda t: datetime.fromtimestamp(t / 1000).astimezone().isoformat(timespec="milliseconds")
            return self.send(json.dumps({"messages": [{"message": {"_id": str(t), "message": f"m{t}", "timestamp": at(t), "source": "h", "fields": {"request_id": f"r{t % 3}"}}} for t in got]}))
        if url.path == "/api/views/search/messages":
            r = body["timerange"]
            got = [t for t in TIMES if ms(r["from"]) <= t <= ms(r["to"])][: body["limit"]]
            lines = ['"timestamp","source","message","_id","Level"'] + [f'"2023-11-14T22:13:20.000Z","h","said ""hi"",\nm{t}","",{"" if t % 2 else "ERROR"}' for t in got]
            return self.send("\n".join(lines))
        if url.path == "/api/v1/query_range":
            a, b, s = float(q["start"]), float(q["end"]), float(q["step"])
            values = [[a + k * s, str(k)] for k in range(int((b - a) / s) + 1)]
            return self.send(json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"__name__": "up"}, "values": values}]}}))
        if url.path == "/api/streams":
            return self.send(json.dumps({"streams": [{"id": "0123456789abcdef01234567", "title": "Web"}]}))
        if url.path == "/loki/api/v1/labels":
            return self.send(json.dumps({"status": "success", "data": ["job"]}))
        return self.send("nothing here", 404)

    def do_GET(self):  # noqa: N802
        self.answer()

    def do_POST(self):  # noqa: N802
        self.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))


@pytest.fixture()
def url():
    Handler.seen, Handler.failures = [], 0
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_whole_ranges_by_slices(spark, url):
    e = Engine(Options(output="summary", as_of_ms=TIMES[-1]))
    e.add_source("loki", ServerSource(spark, "loki", url, slices=5, limit=4, token="abc"))
    e.add_source("graylog", ServerSource(spark, "graylog", url, slices=3, limit=4, user="u", password="p", stream="web"))
    got = e.correlate('loki({job="web"})[1m] and on(request_id) graylog(level:error AND x:1)[1m]').collect()
    assert {(r.join_value, r.n_left, r.n_right) for r in got} == {(f"r{k}", n, n) for k in range(3) if (n := sum(t % 3 == k for t in TIMES))}
    asked = {p: (q, h) for p, q, h, _ in Handler.seen}
    assert asked["/loki/api/v1/query_range"][1]["Authorization"] == "Bearer abc"
    q, h = asked["/api/search/universal/absolute"]
    assert (q["query"], q["filter"], h["Authorization"]) == ("level:error AND x:1", "streams:0123456789abcdef01234567", "Basic dTpw")
    assert e.available() == {"loki": ["job"], "graylog": ["Web"]}
    rows = e.registry.find("loki").scan(e.parse('loki({job="web"})[1m] and on(a) loki({job="web"})[5s]').streams[0].selector, 5_000, TIMES[-1])
    # Half-open below: an event exactly a range ago is out.
    assert sorted(r.ts_ms for r in rows.collect()) == [t for t in TIMES if t > TIMES[-1] - 5_000]
    assert rows.select("seq").distinct().count() == rows.count()


def test_views_and_prometheus(spark, url):
    s = ServerSource(spark, "graylog_views", url, slices=2, limit=16, token="t")
    got = s._decoded(spark.read.format("log_server").options(**s._with("level: AND x:1", start_ms=T0, end_ms=TIMES[-1] + 1)).load()).collect()
    assert sorted(r.message for r in got) == sorted(f'said "hi",\nm{t}' for t in TIMES)
    assert sum(r.labels == {"level": "ERROR"} for r in got) == sum(t % 2 == 0 for t in TIMES)
    body = next(b for *_, b in Handler.seen if b)
    assert body["query_string"]["query_string"] == "level:* AND x:1" and body["streams"] == []
    p = ServerSource(spark, "prometheus", url, slices=4)
    e = Engine(Options(as_of_ms=T0))
    got = p.scan(e.parse("promql(up)[1h] and on(a) promql(up)[1h]").streams[0].selector, 3_600_000, T0).collect()
    assert sorted(r.ts_ms for r in got) == [t for t in range(T0 - 3_600_000 + 1, T0 + 1) if t % 36_000 == 0]


def test_stream_takes_each_event_once(spark, url, tmp_path):
    s = ServerSource(spark, "loki", url, slices=3, limit=4)
    df = s.stream('{job="web"}', start_ms=T0, end_ms=TIMES[-1] + 1)
    for _ in range(2):  # the second run starts at the checkpoint and finds nothing new
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(once=True).start()
        assert q.awaitTermination(60)
    assert sorted(r.ts_ms for r in spark.read.parquet(str(tmp_path / "out")).collect()) == TIMES


def test_failures(url):
    c = Client({"url": url, "kind": "loki", "first_wait": "0.01"})
    Handler.failures = 3
    assert c.names() == ["job"]
    Handler.failures = 4
    with pytest.raises(CorrelationError) as e:
        c.names()
    assert e.value.code == "LOKI_LABELS_ERROR"
    Handler.failures, n = 0, len(Handler.seen)
    with pytest.raises(CorrelationError) as e:  # what the client did wrong isn't asked again
        c.ask("/wrong")
    assert e.value.code == "LOKI_QUERY_ERROR" and len(Handler.seen) == n + 1
    with pytest.raises(CorrelationError) as e:
        Client({"url": url, "kind": "graylog"})
    assert e.value.code == "AUTH_REQUIRED"
