"""Tails and SOCKS proxies, against servers in this process."""

import base64
import hashlib
import json
import socket
import struct
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomline.errors import CorrelationError
from loomline.sources.http import Client, ServerSource
from loomline.sources.sockets import Tail, landed


def serve(handle):
    """A server that hands each connection, numbered, to a function."""
    s = socket.create_server(("127.0.0.1", 0))

    def run():
        n = 0
        while True:
            try:
                c, _ = s.accept()
            except OSError:
                return
            threading.Thread(target=handle, args=(c, n), daemon=True).start()
            n += 1

    threading.Thread(target=run, daemon=True).start()
    return s


def frame(text, kind=1, last=True):
    data = text.encode()
    size = bytes([len(data)]) if len(data) < 126 else b"\x7e" + struct.pack(">H", len(data)) if len(data) < 65536 else b"\x7f" + struct.pack(">Q", len(data))
    return bytes([0x80 * last | kind]) + size + data


def shake(c):
    head = b""
    while not head.endswith(b"\r\n\r\n"):
        head += c.recv(1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)
    accept = base64.b64encode(hashlib.sha1((fields["Sec-WebSocket-Key"] + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()
    c.sendall(f"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
    return head.decode().split("\r\n")[0], fields


def said(t, line="x"):
    return json.dumps({"streams": [{"stream": {"job": "web"}, "values": [[str(t * 1_000_000), line]]}]})


def test_tail_over_connections(spark, tmp_path):
    seen = []

    def handle(c, n):
        seen.append(shake(c))
        if n == 0:  # a message, one in parts with a ping between them, then the end
            c.sendall(frame(said(1000, "request_id=r1")) + frame(said(2000)[:9], 1, False) + frame("hi", 9) + frame(said(2000)[9:], 0))
            time.sleep(0.3)
            seen.append(c.recv(100)[0] & 0x0F)
            c.close()
        else:
            c.sendall(frame(said(3000, "y" * 70_000)))
            time.sleep(5)

    s = serve(handle)
    source = ServerSource(spark, "loki", f"http://127.0.0.1:{s.getsockname()[1]}", token="abc", first_wait="0.01")
    folder = str(tmp_path / "landed")
    assert source.tail('{job="web"}').land(spark, folder, most=3, rows=1) == 3
    assert seen[0][0].startswith("GET /loki/api/v1/tail?query=%7Bjob") and seen[0][1]["Authorization"] == "Bearer abc" and 10 in seen
    q = landed(spark, folder).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select ts_ms, message, stream, join_keys from tailed order by ts_ms").collect()
    assert [r.ts_ms for r in rows] == [1000, 2000, 3000] and rows[0].join_keys == {"request_id": "r1"} and len(rows[2].message) == 70_000 and rows[0].stream == "web"
    s.close()


def test_tail_gives_up():
    s = serve(lambda c, n: (c.sendall(b"HTTP/1.1 503 Busy\r\n\r\n"), c.close()))
    with pytest.raises(CorrelationError) as e:
        next(Tail(f"http://127.0.0.1:{s.getsockname()[1]}", "{}", retries=2, first_wait=0.01).messages())
    assert e.value.code == "WEBSOCKET_MAX_RETRIES" and e.value.details["retries"] == 2
    s.close()


class Hello(BaseHTTPRequestHandler):
    def log_message(self, *_):
        return

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'{"data": ["job"]}')


def proxy(c, log, port):
    """A SOCKS server that knows one name."""
    kind = c.recv(1)[0]
    if kind == 4:
        rest = c.recv(500)
        log.append((4, rest[7:].split(b"\0")[:2]))
        c.sendall(b"\0\x5a" + b"\0" * 6)
    else:
        ways = c.recv(c.recv(1)[0])
        c.sendall(b"\x05" + ways[:1])
        if ways == b"\x02":
            log.append(c.recv(200))
            c.sendall(b"\x01\x00")
        head = c.recv(4)
        name = c.recv(c.recv(1)[0]) if head[3] == 3 else c.recv(4)
        c.recv(2)
        log.append((5, name))
        c.sendall(b"\x05\x00\x00\x01" + b"\0" * 6)
    out = socket.create_connection(("127.0.0.1", port))

    def pump(a, b):
        while data := a.recv(4096):
            b.sendall(data)
        b.shutdown(socket.SHUT_WR)

    threading.Thread(target=pump, args=(out, c), daemon=True).start()
    pump(c, out)


@pytest.mark.parametrize(("scheme", "want"), [("socks5", [(5, b"logs.invalid")]), ("socks5://u:p", [b"\x01\x01u\x01p", (5, b"logs.invalid")]), ("socks4a", [(4, [b"", b"logs.invalid"])])])
def test_socks(scheme, want):
    web = ThreadingHTTPServer(("127.0.0.1", 0), Hello)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    log = []
    s = serve(lambda c, n: proxy(c, log, web.server_address[1]))
    at = f"127.0.0.1:{s.getsockname()[1]}"
    url = f"{scheme}@{at}" if "//" in scheme else f"{scheme}://{at}"
    assert Client({"kind": "loki", "url": "http://logs.invalid:80", "proxy": url, "retries": "0", "timeout": "5"}).names() == ["job"]
    assert log == want
    s.close()
    web.shutdown()
