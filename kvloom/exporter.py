"""Metrics over HTTP: GET /metrics answers with the lines that a function gives at that time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread


def serve(lines: Callable[[], Iterable[str]], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A running server, on a free port if port is 0; shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = self.path.split("?")[0] == "/metrics"
            body = "".join(f"{x}\n" for x in lines()).encode() if found else b"not found\n"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
