"""The query service's answers as plain dicts, and a small server around them."""

from __future__ import annotations

import json
import time
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import functions as F

from tideql.functions.numbers import time_of, value_text
from tideql.plans import compiler, discovery
from tideql.plans.language import NAME, BadQuery

MOST_POINTS = 11_000
#: Series, names, values or sets that one answer holds at most; beyond it the answer is an error.
MOST_ROWS = 50_000


def _bounded(rows) -> list:
    """Rows for one answer; so many go to the driver at most."""
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise BadQuery(f"exceeded maximum of {MOST_ROWS} series or labels in an answer")
    return got


def _good(data) -> tuple[int, dict]:
    return 200, {"status": "success", "data": data}


def _bad(message: str) -> tuple[int, dict]:
    return 422, {"status": "error", "errorType": "bad_data", "error": message}


def _answered(f):
    def run(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except BadQuery as e:
            return _bad(str(e))

    return run


@_answered
def query(store, params: dict, now: int | None = None) -> tuple[int, dict]:
    """An instant query. The time is the parameter `start`, else now."""
    at = time_of(params.get("start"), int(time.time()) if now is None else now)
    got = compiler.instant(store, params.get("query", ""), at)
    if isinstance(got, float):
        return _good({"resultType": "scalar", "result": [at, value_text(got)]})
    return _good({"resultType": "vector", "result": [{"metric": r["labels"], "value": [at, value_text(r["v"])]} for r in _bounded(got)]})


@_answered
def query_range(store, params: dict, now: int | None = None) -> tuple[int, dict]:
    """A range query; default: the hour before now, a point a minute."""
    end = time_of(params.get("end"), int(time.time()) if now is None else now)
    start = time_of(params.get("start"), end - 3600)
    step = max(1, time_of(params.get("step"), 60))
    rows = None if start > end or (end - start) // step > MOST_POINTS else compiler.over_range(store, params.get("query", ""), start, end, step)
    if rows is None:
        compiler.parse(params.get("query", ""))
        return _bad("start is after end" if start > end else f"exceeded maximum resolution of {MOST_POINTS} points per timeseries")
    points = rows.groupBy("lkey").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("t", "v"))).alias("points"))
    return _good({"resultType": "matrix", "result": [{"metric": r["labels"], "values": [[p["t"], value_text(p["v"])] for p in r["points"]]} for r in _bounded(points.orderBy("lkey"))]})


def _window(pairs: list[tuple[str, str]]):
    given = dict(pairs)
    times = [None if k not in given or (a := time_of(given[k], -1)) != time_of(given[k], -2) else a for k in ("start", "end")]
    return [v for k, v in pairs if k == "match[]"], *times


@_answered
def labels(store, pairs) -> tuple[int, dict]:
    return _good([r[0] for r in _bounded(discovery.names(store, *_window(pairs)))])


@_answered
def label_values(store, name: str, pairs) -> tuple[int, dict]:
    return _good([r[0] for r in _bounded(discovery.values(store, name, *_window(pairs)))])


@_answered
def series(store, pairs) -> tuple[int, dict]:
    return _good([{NAME: r["metric"], **r["labels"]} for r in _bounded(discovery.sets(store, *_window(pairs)))])


def metadata() -> tuple[int, dict]:
    return _good({})


def stats(store) -> tuple[int, dict]:
    r = discovery.stats(store).first()
    return 200, {"series": r["series"], "samples": r["samples"]}


def answer(store, method: str, url: str, body: str = "") -> tuple[int, dict | str]:
    """Routes a request: GET reads the query string only, POST the form in the body only."""
    parts = urlsplit(url)
    pairs = parse_qsl(body if method == "POST" else parts.query, keep_blank_values=True)
    path, form = parts.path, method in ("GET", "POST")
    if path == "/api/v1/query" and form:
        return query(store, dict(pairs))
    if path == "/api/v1/query_range" and form:
        return query_range(store, dict(pairs))
    if path == "/api/v1/labels" and form:
        return labels(store, pairs)
    if path == "/api/v1/series" and form:
        return series(store, pairs)
    if path.startswith("/api/v1/label/") and path.endswith("/values") and form:
        return label_values(store, unquote(path[len("/api/v1/label/") : -len("/values")]), pairs)
    if method == "GET" and path in ("/api/v1/metadata", "/health", "/-/stats"):
        return {"/api/v1/metadata": metadata, "/health": lambda: (200, "ok"), "/-/stats": lambda: stats(store)}[path]()
    return 404, {"status": "error", "errorType": "not_found", "error": path}


def server(store, port: int = 9090):
    """An HTTP server that answers from a store; the caller runs it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, data = answer(store, method, self.path, body)
            raw = (data if isinstance(data, str) else json.dumps(data)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(data, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self._reply("GET")

        def do_POST(self):
            self._reply("POST")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("", port), Handler)
