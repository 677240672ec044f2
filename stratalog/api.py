"""The queries as JSON, for the command line, over HTTP and for agents.

Fixed values: the names of the queries' arguments and of the fields of their results, their defaults
and bounds.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame, functions as F

from .functions import masking
from .functions.text import duration, instant
from .plans.queries import INVESTIGATE_TOP, QUERY_LIMIT, RAW_LIMIT, REPLAY_LIMIT, LogStore, clamp
from .plans.store import Store

MAX_TEMPLATES = 1000


class BadRequest(ValueError):
    """A request that names no query or holds a malformed value."""


class NotFound(ValueError):
    """A template that isn't there."""


def window(args: Mapping, default: str | None = None) -> tuple[int | None, int | None]:
    """``from``/``to``, or the ``last`` so long, as epoch milliseconds."""
    try:
        end = instant(args["to"]) if args.get("to") else None
        if args.get("from"):
            return instant(args["from"]), end if end is not None else int(time.time() * 1000)
        last = args.get("last") or default
        if last:
            end = int(time.time() * 1000) if end is None else end
            return end - int(duration(last).total_seconds() * 1000), end
        return None, end
    except ValueError as e:
        raise BadRequest(str(e)) from e


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


def _named(df: DataFrame, **names: str | Column) -> list[dict]:
    """Rows with the fields of the result, from columns."""
    return rows(df.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in names.items())))


def _templates(df: DataFrame) -> list[dict]:
    return _named(df, id="template_id", pattern="pattern", hits="occurrences", createdAt=F.unix_millis("created_at"), updatedAt=F.unix_millis("updated_at"))


def _spikes(df: DataFrame) -> list[dict]:
    return _named(df, templateId="template_id", pattern="pattern", windowCount="window_count", baselineCount="baseline_count", ratio=F.round("ratio", 2))


def _flag(value: object) -> bool:
    return str(value or "").strip().lower() not in ("", "false", "0")


def _filters(value: object) -> dict[str, str]:
    """Slot filters: an object as it is, or ``slot=value`` pairs, a list of them or one text."""
    if isinstance(value, Mapping):
        return {str(k): str(v) for k, v in value.items()}
    pairs = [value] if isinstance(value, str) and value else list(value or ())
    if any("=" not in p for p in pairs):
        raise BadRequest("a filter is slot=value")
    return dict(p.split("=", 1) for p in pairs)


def answer(store: Store, name: str, args: Mapping) -> object:
    """The result of a query by its name; numbers may come as texts."""
    q = LogStore.of(store)
    try:
        return _answer(store, q, name, args)
    except (KeyError, TypeError) as e:
        raise BadRequest(f"missing or malformed: {e}") from e
    except ValueError as e:
        if isinstance(e, (BadRequest, NotFound)):
            raise
        raise BadRequest(str(e)) from e


def _answer(store: Store, q: LogStore, name: str, args: Mapping) -> object:
    number = lambda key, default=None: int(args[key]) if args.get(key) not in (None, "") else default
    if name == "templates":
        limit = clamp(number("limit"), 20, MAX_TEMPLATES)
        search = str(args.get("search") or "")
        best = q.search_templates(search, limit) if search.strip() else q.top_templates(limit, window(args)[0] if args.get("last") else None)
        order = [F.desc("occurrences"), "template_id"]
        return _templates(q.templates.join(best.select("template_id"), "template_id", "left_semi").orderBy(*order))
    if name in ("inspect", "timeseries"):
        one = number("id")
        found = _templates(q.templates.where(F.col("template_id") == one))
        if not found:
            raise NotFound(f"no template {one}")
        if name == "timeseries":
            bucket = int(duration(args.get("bucket") or "1m").total_seconds() * 1000)
            start, end = window(args, "1h")
            return {"templateId": one, "bucketMs": bucket, "series": _named(q.timeseries(one, 0 if start is None else start, end, bucket), ts="bucket_ms", count="n")}
        return found[0] | _details(q, one, number("topN", 5), number("recent", 10), *window(args))
    if name == "anomalies":
        return _templates(q.anomalies(window(args, "1h")[0]))
    if name == "template-counts":
        start, end = window(args, "1h")
        if _flag(args.get("baseline")):
            return _spikes(q.template_counts_with_baseline(start, end))
        return _named(q.template_counts(start, end), templateId="template_id", pattern="pattern", count="n")
    if name == "new-templates":
        return _named(q.new_templates(*window(args, "1h")), templateId="template_id", pattern="pattern", firstSeenMs="first_seen_ms", windowCount="window_count")
    if name == "query":
        return [r["line"] for r in rows(q.query_lines(args["pattern"], _filters(args.get("filters")), *window(args), clamp(number("limit"), 500, QUERY_LIMIT)))]
    if name == "query-structured":
        return _structured(q, args["pattern"], _filters(args.get("filters")), *window(args), clamp(number("limit"), 500, QUERY_LIMIT), args.get("slots"))
    if name == "replay":
        return [r["line"] for r in rows(q.replay(*window(args), clamp(number("limit"), 5000, REPLAY_LIMIT)))]
    if name == "raw-logs":
        return _named(q.raw_logs(*window(args, "1h"), args.get("search"), clamp(number("limit"), 500, RAW_LIMIT)), id="log_id", content="content", ts="log_timestamp", source="source")
    if name == "suggestions":
        return _named(q.suggestions(args["pattern"], clamp(number("limit"), 5, 50)), id="template_id", pattern="pattern", hits="occurrences")
    if name == "investigate":
        start, end = window(args | {"last": args.get("window") or args.get("last")}, "5m")
        found = q.investigate(start, end, clamp(number("topN"), 10, INVESTIGATE_TOP), clamp(number("rawSample"), 5, INVESTIGATE_TOP), time_basis="event")
        summary = _named(found["summary"], windowFromMs="window_from_ms", windowToMs="window_to_ms", baselineFromMs="baseline_from_ms", baselineToMs="baseline_to_ms", totalWindowEntries="total_window_entries", errorRate="error_rate")[0]
        fresh = _named(found["new_templates"], templateId="template_id", pattern="pattern", firstSeenMs="first_seen_ms", windowCount="window_count")
        return summary | {"spikes": _spikes(found["spikes"]), "newTemplates": fresh, "rawLogSample": [r["content"] for r in rows(found["raw_sample"])]}
    if name == "stats":
        return _named(q.stats(), templateCount="template_count", logEntryCount="log_entry_count", rawLogCount="raw_log_count")[0] | {"bytes": store.size_bytes()}
    raise BadRequest(f"no such query: {name}")


def _details(q: LogStore, template_id: int, top: int, recent: int, start: int | None, end: int | None) -> dict:
    slots = []
    for r in q.inspect_slots(template_id, top if top > 0 else 3, start, end).select("*", masking.slot_base_name(F.col("name")).alias("type"), F.transform("top_values", lambda v: F.struct(masking.strip_key_prefix(v["value"], F.col("name")).alias("value"), v["n"].alias("count"))).alias("top")).collect():
        slot = {"index": r["slot"], "name": r["name"], "type": r["type"], "distinct": r["distinct_values"], "topValues": [v.asDict() for v in r["top"]]}
        if r["num_count"] is not None:
            slot["numeric"] = {k: r[f"num_{k}"] for k in ("count", "min", "max", "avg", "p50", "p95")} | ({"unit": r["num_unit"]} if r["num_unit"] else {})
        slots.append(slot)
    found = _named(q.recent_entries(template_id, recent), ts="log_timestamp", line="line") if recent > 0 else []
    return {"slotStats": slots, "recentLogs": found}


def _structured(q: LogStore, pattern: str, filters: dict[str, str], start: int | None, end: int | None, limit: int, select) -> dict:
    """−1 stands for a pattern that no template has; one without matches has its id, pattern and slots."""
    own = q.matching_templates(pattern).orderBy("template_id").first()
    if own is None:
        return {"templateId": -1, "template": "", "slots": [], "matchedCount": 0, "scanCapped": False, "returned": 0, "occurrences": []}
    select = [x for x in select.split(",") if x] if isinstance(select, str) else select
    names = [s for s in own["slots"] if not select or s in select]
    found = rows(q.query_structured(pattern, filters, start, end, limit, select or None).select("values"))
    total = q.query_count(pattern, filters, start, end).first()[0]
    return {"templateId": own["template_id"], "template": own["pattern"], "slots": names, "matchedCount": total, "scanCapped": False, "returned": len(found), "occurrences": [r["values"] for r in found]}


def serve(store: Store, port: int = 8080) -> ThreadingHTTPServer:
    """A server of ``/api/<query>``: arguments in the address, or as a JSON object in the body."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, args: dict) -> None:
            name = urlparse(self.path).path.removeprefix("/api/").strip("/")
            parts = name.split("/")
            if parts[0] == "templates" and len(parts) > 1:
                args["id"], name = parts[1], "timeseries" if parts[2:] == ["timeseries"] else "inspect"
            try:
                code, body = 200, answer(store, name, args)
            except BadRequest as e:
                code, body = 400, {"error": str(e)}
            except NotFound as e:
                code, body = 404, {"error": str(e)}
            self._send(code, body)

        def _send(self, code: int, body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self._open()
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _open(self) -> None:
            for what, which in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "*")):
                self.send_header(f"Access-Control-Allow-{what}", which)

        def _address(self) -> dict:
            found = parse_qs(urlparse(self.path).query)
            return {k: v if k == "filters" else v[-1] for k, v in found.items()}

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.send_response(204)
            self._open()
            self.end_headers()

        def do_GET(self) -> None:  # noqa: N802
            self._reply(self._address())

        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("the body is no object")
            except ValueError as e:
                self._send(400, {"error": str(e)})
                return
            self._reply(self._address() | {k: v for k, v in body.items() if v is not None})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
