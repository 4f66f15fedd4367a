"""A small HTTP server over an Engine: JSON under /api, a page of links elsewhere."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from cartulary.api import Engine
from cartulary.scratch import scratch

PAGE = "<!doctype html><title>Cartulary</title><h1>Cartulary</h1><ul>" + "".join(f"<li><a href='/api/{x}'>{x}</a></li>" for x in ("graph", "stats", "architecture", "conventions", "health")) + "</ul>"


def routes(engine: Engine) -> dict:
    rows = lambda df: json.loads(engine.as_json(df))
    return {
        "/api/graph": lambda: json.loads(engine.graph_json()), "/api/stats": lambda: engine.stats() | {"graph": engine.graph_stats()},
        "/api/architecture": lambda: {"modules": rows(engine.modules()), "concepts": rows(engine.concepts().orderBy("pos")), "report": engine.architecture_report()},
        "/api/conventions": lambda: {"conventions": rows(engine.conventions().orderBy("pos")), "summary": engine.convention_summary()},
        "/api/health": lambda: {"status": "ok", "indexed": engine.store.is_indexed},
    }


def serve(engine: Engine, port: int = 4620, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready; call serve_forever() on it."""
    known = routes(engine)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str, kind: str) -> None:
            data = body.encode()
            self.send_response(code)
            for k, v in (("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(k, v)
            self.end_headers()

        def do_GET(self) -> None:
            answer = known.get(self.path.split("?")[0])
            if answer is None:
                return self._send(200, PAGE, "text/html")
            try:
                with scratch():  # tables written for the answer go with it
                    text = json.dumps(answer(), default=str)
                return self._send(200, text, "application/json")
            except Exception as e:  # noqa: BLE001
                return self._send(500, json.dumps({"error": str(e)[:500]}), "application/json")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
