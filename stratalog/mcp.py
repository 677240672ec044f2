"""The queries as tools of an agent: JSON-RPC over standard input and output, one message a line.

Fixed values: the names of the tools and of their arguments, and their default limits.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from . import api

VERSION = "2024-11-05"
TEXT, NUMBER = {"type": "string"}, {"type": "integer"}
SPAN = {
    "from": TEXT | {"description": "Begin of the window, ISO 8601 or yyyy-MM-dd HH:mm:ss in UTC."},
    "to": TEXT | {"description": "End of the window; now if left out."},
    "last": TEXT | {"description": "Length of a window that ends now, such as 5m, 1h or 7d."},
}


def _limit(most: int, default: int) -> dict:
    return {"limit": NUMBER | {"minimum": 1, "maximum": most, "description": f"At most so many, {default} by default."}}


ID = {"templateId": NUMBER | {"description": "The template's id."}}
#: By tool: what it is for, its arguments, those that it needs, and how many items it gives at most.
TOOLS: dict[str, tuple[str, dict, list[str], int]] = {
    "template_counts": ("How often each template occurs in a window, beside the window before with baseline: what grew shows first.", SPAN | {"baseline": {"type": "boolean", "description": "Count the window of the same length just before, too."}}, [], 50),
    "new_templates": ("Templates whose very first line lies in the window, earliest first: often the trigger.", SPAN, [], 50),
    "list_templates": ("The most frequent templates, or those that hold a text.", {"search": TEXT, "last": SPAN["last"]} | _limit(200, 20), [], 50),
    "inspect_template": ("How the values of a template's slots are distributed, with examples if asked for.", ID | SPAN | {"topN": NUMBER | {"minimum": 1, "maximum": 50}, "recent": NUMBER | {"minimum": 0, "maximum": 100}}, ["templateId"], 0),
    "template_timeseries": ("How often a template occurs over time: when something began.", ID | SPAN | {"bucket": TEXT | {"description": "Width of a step, such as 1m, 5m or 1h."}}, ["templateId"], 0),
    "raw_sample": ("Lines that no template holds.", SPAN | {"search": TEXT} | _limit(500, 20), [], 500),
    "query_logs": ("The lines of one template, as values of its slots or in full.", {"pattern": TEXT, "filters": {"type": "object", "additionalProperties": TEXT}, **SPAN, "slots": {"type": "array", "items": TEXT}, "format": {"type": "string", "enum": ["structured", "lines"]}} | _limit(5000, 200), ["pattern"], 200),
    "replay": ("All lines of a window as they were, in order. Take a narrow window.", SPAN | _limit(5000, 200), [], 200),
    "get_stats": ("How many templates, entries and raw lines there are.", {}, [], 0),
}
PROMPT = "investigate_incident"
PROMPT_ARGUMENTS = {"window": "Length of a window that ends now, such as 15m.", "from": "Begin of the window.", "to": "End of the window."}


def truncated(items: object, most: int, hint: str) -> object:
    """A list as it is, or, if it is longer than ``most``, its first items with word of the rest."""
    if most and isinstance(items, list) and len(items) > most:
        return {"truncated": True, "returned": most, "totalAvailable": len(items), "hint": hint, "items": items[:most]}
    return items


def call(ask: Callable[[str, dict], object], name: str, args: dict) -> object:
    """The result of a tool; ``ask`` answers a query by its name."""
    _, properties, needed, most = TOOLS[name]
    if missing := [k for k in needed if args.get(k) in (None, "")]:
        raise api.BadRequest(f"{name} needs {', '.join(missing)}")
    if unknown := set(args) - set(properties):
        raise api.BadRequest(f"{name} takes no {', '.join(sorted(unknown))}")
    for k, v in args.items():
        low, high = properties[k].get("minimum"), properties[k].get("maximum")
        if low is not None and v is not None and not low <= int(v) <= high:
            raise api.BadRequest(f"{k} is between {low} and {high}")
    args = dict(args)
    if "templateId" in args:
        args["id"] = args.pop("templateId")
    narrower = "Narrow the window or the filters."
    if name == "query_logs":
        limit = int(args.get("limit") or most)
        lines = args.pop("format", None) == "lines"
        found = ask("query" if lines else "query-structured", args | {"limit": limit})
        if lines:
            return truncated(found, limit, narrower)
        if found["matchedCount"] > found["returned"]:
            found = found | {"truncated": True, "hint": f"{found['matchedCount']} match, {found['returned']} are shown. {narrower}"}
        return found
    if name == "inspect_template":
        return ask("inspect", {"topN": 10, "recent": 0} | args)
    if name == "replay":
        limit = int(args.get("limit") or most)
        return truncated(ask("replay", args | {"limit": limit + 1}), limit, narrower)
    query = {"template_counts": "template-counts", "new_templates": "new-templates", "list_templates": "templates", "template_timeseries": "timeseries", "raw_sample": "raw-logs", "get_stats": "stats"}[name]
    if name in ("list_templates", "raw_sample"):
        args.setdefault("limit", 20)
        most = max(most, int(args["limit"]))
    return truncated(ask(query, args), most, narrower)


def prompt(args: dict) -> str:
    scope = f"from {args.get('from') or 'the beginning'} to {args.get('to') or 'now'}" if args.get("from") or args.get("to") else f"of the last {args.get('window') or '15m'}"
    return (
        f"Find out what went wrong in the window {scope}.\n"
        "Begin with template_counts and its baseline: what is frequent now and was rare or absent before? "
        "Then new_templates: what was seen for the first time, and earliest? A cause is seldom what is loudest. "
        "With template_timeseries find the minute in which a suspect began, with inspect_template and query_logs the values that it has to do with, "
        "with raw_sample the lines that no template holds. Use replay for a narrow window only, and only if the lines themselves are needed.\n"
        "Say then what the cause is, how it led to what users saw, and which lines show it."
    )


def handle(ask: Callable[[str, dict], object], message: dict) -> dict | None:
    """The response to a message, or None to a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply = lambda result: {"jsonrpc": "2.0", "id": message["id"], "result": result}
    fault = lambda code, text: {"jsonrpc": "2.0", "id": message["id"], "error": {"code": code, "message": text}}
    if method == "initialize":
        return reply({"protocolVersion": params.get("protocolVersion") or VERSION, "capabilities": {"tools": {}, "prompts": {}}, "serverInfo": {"name": "stratalog", "version": "1"}})
    if method == "ping":
        return reply({})
    if method == "tools/list":
        return reply({"tools": [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": p, "required": needed, "additionalProperties": False}, "annotations": {"readOnlyHint": True}} for n, (what, p, needed, _) in TOOLS.items()]})
    if method == "tools/call":
        if params.get("name") not in TOOLS:
            return fault(-32602, f"no such tool: {params.get('name')}")
        try:
            found, bad = json.dumps(call(ask, params["name"], params.get("arguments") or {}), ensure_ascii=False), False
        except (api.BadRequest, api.NotFound, ValueError) as e:
            found, bad = str(e), True
        return reply({"content": [{"type": "text", "text": found}], "isError": bad})
    if method == "prompts/list":
        return reply({"prompts": [{"name": PROMPT, "description": "Find the cause of an incident with few calls.", "arguments": [{"name": k, "description": v, "required": False} for k, v in PROMPT_ARGUMENTS.items()]}]})
    if method == "prompts/get":
        if params.get("name") != PROMPT:
            return fault(-32602, f"no such prompt: {params.get('name')}")
        return reply({"messages": [{"role": "user", "content": {"type": "text", "text": prompt(params.get("arguments") or {})}}]})
    return fault(-32601, f"no such method: {method}")


def run(ask: Callable[[str, dict], object], source: TextIO = sys.stdin, target: TextIO = sys.stdout) -> None:
    """Answer messages until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            out = handle(ask, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        if out is not None:
            target.write(json.dumps(out, ensure_ascii=False) + "\n")
            target.flush()
