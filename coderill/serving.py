"""Read-only views of the store as JSON objects (health, events, summary, clusters), and a server of them."""

from __future__ import annotations

import json
import mimetypes
import os
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import functions as F

from coderill.operators import clusters, ingest, statistics
from coderill.sources import views
from coderill.sources.store import Store

RECENT_BLOCKS = 300


def _bounded(text: str | None, low: int, high: int, default: int | None) -> int:
    if text is None and default is not None:
        return default
    if text is None or not text.isascii() or not text.isdigit() or not low <= int(text) <= high:
        raise ValueError(f"not a number from {low} to {high}: {text!r}")
    return int(text)


def health(store: Store, now: datetime | None = None) -> dict:
    now = now or datetime.now(UTC)
    last = store.read("progress").filter("block IS NOT NULL").orderBy(F.desc("block")).first()
    at = (last["updated_at"] or None) if last else None
    since = int((now - datetime.fromisoformat(at)).total_seconds()) if at else None
    return {"progress": last["block"] if last else None, "progress_at": at, "seconds_since_progress": since, "now": now.strftime("%Y-%m-%dT%H:%M:%SZ")}


def events(store: Store, after: int = 0, limit: int = 100) -> dict:
    rows = [r.asDict() for r in ingest.events_after(store.read("events"), after, limit).collect()]
    return {"events": rows, "last_id": rows[0]["id"] if rows else after}


def _origins(rows) -> dict:
    found = {r["origin"]: r["n"] for r in rows.collect()}
    return {o: found.get(o, 0) for o in statistics.ORIGINS}


def summary(store: Store) -> dict:
    progress = store.progress()
    since = 1 << 62 if progress is None else progress - RECENT_BLOCKS + 1
    counts = views.counts(store).first()
    return {
        "addresses": counts["addresses"], "codes": counts["codes"], "seeds": store.seeds().count(),
        "implementations_resolved": views.resolved(store),
        "origins": _origins(views.origin_counts(store)),
        "alerts_by_seed": [{"label": r["label"], "seed_address": r["seed_address"], "count": r["n"]} for r in ingest.seed_counts(store.read("events")).collect()],
        "recent": {"blocks": RECENT_BLOCKS, "by_origin": _origins(views.origin_counts(store, since))},
    }


CACHE_SECONDS = 60


class ClusterCache:
    """Clusters of a level, built once in a minute and kept as rows, as many as can be asked for."""

    def __init__(self, seconds: float = CACHE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self._held: dict[tuple[str, str], tuple[float, list]] = {}
        self._lock = threading.Lock()

    def of(self, store: Store, level: str) -> list:
        key = store.folder, level
        with self._lock:
            at, rows = self._held.get(key, (float("-inf"), []))
            if self.clock() - at >= self.seconds:
                chosen = clusters.top(views.sizes(store), MOST_CLUSTERS, level)
                found = views.members(store, chosen).collect()
                at, rows = self.clock(), sorted(found, key=lambda r: (-r["n_members"], r["key"]))
                self._held[key] = at, rows
            return rows


MOST_CLUSTERS = 100
_cache = ClusterCache()


def cluster_list(store: Store, level: str, n: int = 20, cache: ClusterCache | None = None) -> dict:
    rows = (cache or _cache).of(store, level)[:n]
    return {"level": level, "n": n, "clusters": [{"level": r["level"], "key": r["key"], "members": r["members"]} for r in rows]}


def _query(text: str) -> dict[str, str]:
    """Keys and values as they stand: neither a plus nor an escape is decoded."""
    pairs = (part.partition("=") for part in text.split("&") if part)
    return {key: value for key, _, value in pairs}


def respond(store: Store, target: str, cache: ClusterCache | None = None) -> tuple[int, dict]:
    """Status and body for the target of a GET request; any error is a status and one line."""
    path, _, text = target.partition("?")
    query = _query(text)
    try:
        match unquote(path):
            case "/api/health":
                return 200, health(store)
            case "/api/events":
                return 200, events(store, _bounded(query.get("after"), 0, 1 << 62, 0), _bounded(query.get("limit"), 1, 500, 100))
            case "/api/summary":
                return 200, summary(store)
            case "/api/clusters":
                level = query.get("level")
                if level not in clusters.LEVELS:
                    raise ValueError(f"no such level: {level!r}")
                return 200, cluster_list(store, level, _bounded(query.get("n"), 1, MOST_CLUSTERS, 20), cache)
    except ValueError as error:
        return 400, {"error": str(error)}
    except Exception as error:  # a server answers whatever went wrong
        return 500, {"error": next(iter(str(error).splitlines()), "") or type(error).__name__}
    return 404, {"error": "not found"}


_EMPTY_PAGE = b"<!DOCTYPE html><html><head><title>coderill</title></head><body>No files are served.</body></html>"


def static(folder: str | None, path: str) -> tuple[int, str, bytes] | None:
    """The index, or a file below ``assets``; nothing that lies outside, by dots or links."""
    if folder is None or not os.path.isdir(folder):
        return (200, "text/html; charset=utf-8", _EMPTY_PAGE) if path == "/" else None
    root = os.path.realpath(folder)
    base = root if path == "/" else os.path.join(root, "assets")
    found = os.path.join(root, "index.html") if path == "/" else os.path.realpath(os.path.join(root, path.lstrip("/")))
    inside = path == "/" or path.startswith("/assets/") and found.startswith(base + os.sep)
    if not inside or not os.path.isfile(found):
        return None
    with open(found, "rb") as f:
        return 200, "text/html; charset=utf-8" if path == "/" else mimetypes.guess_type(found)[0] or "application/octet-stream", f.read()


def server(store: Store, host: str = "127.0.0.1", port: int = 8080, folder: str | None = None) -> ThreadingHTTPServer:
    """A bound server of the views and of static files, not started; reads only."""
    cache = ClusterCache()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def json(self, status: int, data: dict) -> None:
            self.answer(status, "application/json; charset=utf-8", json.dumps(data, sort_keys=True).encode())

        def do_GET(self) -> None:
            path = unquote(self.path.partition("?")[0])
            if not path.startswith("/api/") and (found := static(folder, path)):
                self.answer(*found)
            else:
                self.json(*respond(store, self.path, cache))

        def refuse(self) -> None:
            self.json(405, {"error": "method not allowed"})

        do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = refuse

        def log_message(self, *_) -> None:
            """Nothing is logged for each request."""

    out = ThreadingHTTPServer((host, port), Handler)
    out.daemon_threads = True
    return out
