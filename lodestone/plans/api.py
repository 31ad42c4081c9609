"""The service's requests as functions from dictionaries to dictionaries."""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from lodestone.plans.indexer import Indexer
from lodestone.plans.search import SearchService
from lodestone.plans.settings import SearchOptions
from lodestone.streaming.queue import Queue


#: Bounds of the numbers that a request may hold.
MOST = 1 << 31


def body_of(request: Any) -> dict:
    """The request's body, else its json, else {}."""
    for name in ("body", "json"):
        value = request.get(name) if isinstance(request, dict) else getattr(request, name, None)
        if isinstance(value, dict):
            return value
    return {}


def options_of(body: dict) -> tuple[str, SearchOptions]:
    """Fields of the wrong type count as absent."""
    text = lambda k: body[k] if isinstance(body.get(k), str) else None
    limit = body.get("limit")
    number = isinstance(limit, (int, float)) and not isinstance(limit, bool) and math.isfinite(limit)
    tags, fm = body.get("tags"), body.get("frontmatter")
    return text("query") or "", SearchOptions(
        limit=max(-MOST, min(int(limit), MOST)) if number else None, source=text("dataviewSource"), path_query=text("dataviewQuery"), where=text("where"),
        tags=tuple(t for t in tags if isinstance(t, str)) if isinstance(tags, list) else (), frontmatter=fm if isinstance(fm, dict) else {},
    )


def failed(error: Exception) -> dict:
    return {"ok": False, "error": str(error), "status": 500}


class Api:
    """Replies are what a request asks for, or ok (false), error and status."""

    def __init__(self, service: Callable[[], SearchService], indexer: Indexer, queue: Queue, notes: Callable[[], DataFrame]):
        self.service, self.indexer, self.queue, self.notes = service, indexer, queue, notes

    def status(self) -> dict:
        return {"index": self.indexer.status(), "queue": self.queue.status()}

    def search(self, request: Any) -> dict:
        try:
            query, options = options_of(body_of(request))
            if not query.strip():
                return {"results": []}
            # At most MOST_HITS rows.
            rows = [r.asDict(recursive=True) for r in self.service().search(query, options).collect()]
            return {"results": [{"frontmatter": json.loads(r.pop("frontmatter_json") or "{}"), **r} for r in rows]}
        except Exception as e:  # noqa: BLE001 - reported to the client
            return failed(e)

    def reindex(self, request: Any = None) -> dict:
        try:
            self.queue.add_all(self.indexer, self.notes())
            return self.status()
        except Exception as e:  # noqa: BLE001
            return failed(e)

    def handle(self, method: str, path: str, request: Any = None) -> tuple[int, dict]:
        """The status and body of the reply to a request for status/, search/ or reindex/."""
        routes = {("GET", "status"): lambda: self.status(), ("POST", "search"): lambda: self.search(request), ("POST", "reindex"): lambda: self.reindex(request)}
        route = routes.get((method.upper(), path.split("?")[0].strip("/").rpartition("/")[2]))
        if route is None:
            return 404, {"ok": False, "error": f"no route for {method} {path}", "status": 404}
        out = route()
        return (out["status"] if out.get("ok") is False else 200), out


def serve(api: Api, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Answers requests over HTTP from a thread of its own; ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, out = api.handle(self.command, self.path, {"body": json.loads(raw) if raw.strip() else {}})
            except ValueError as e:
                status, out = 400, {"ok": False, "error": str(e), "status": 400}
            text = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = _answer

        def log_message(self, *args: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
