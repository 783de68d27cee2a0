"""OP-S13, OP-R5, OP-K10: the engine over HTTP: /search, /health and /metrics."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tamarack.plans.engine import Engine


def answer(engine: Engine, target: str) -> tuple[int, dict]:
    """Status and body of a request: 422 for a parameter out of bounds, 404 for an unknown path, 503 for a search without documents."""
    url = urlsplit(target)
    arg = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    if url.path == "/health":
        return 200, engine.health()
    if url.path == "/metrics":
        return 200, engine.metrics()
    if url.path != "/search":
        return 404, {"detail": "not found"}
    try:
        k, ef = int(arg.get("k", 10)), int(arg.get("ef", 50))
        if not engine.index.num_segments():
            return 503, {"detail": "no documents"}
        return 200, engine.respond(arg.get("q", ""), k, arg.get("mode", "hybrid"), ef)
    except ValueError as e:
        return 422, {"detail": str(e)}


def server(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is not started yet; ``serve_forever`` starts it. Requests run side by side as Spark jobs."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = answer(engine, self.path)
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
