"""``python -m stratalog --store DIR COMMAND ...``: ingest, query and maintain a store."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from . import mcp
from .api import BadRequest, NotFound, answer, serve
from .functions.text import duration
from .generate import KINDS, write
from .operators.grouping import groups
from .plans.store import Store
from .sources.lines import kafka, spooled_lines, text_files
from .streaming.ingest import StreamIngest

QUERIES = ("templates", "inspect", "timeseries", "anomalies", "template-counts", "new-templates", "query", "query-structured", "replay", "raw-logs", "suggestions", "investigate", "stats")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog")
    p.add_argument("--store", required=True)
    p.add_argument("--text", action="store_true", help="tables and lines instead of JSON")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="ingest a file, or - for standard input")
    run.add_argument("--input", required=True)
    run.add_argument("--batch-size", type=int)
    consume = sub.add_parser("consume", help="ingest a topic")
    consume.add_argument("--topic", required=True)
    consume.add_argument("--bootstrap-servers", "--servers", dest="servers", default="localhost:9092")
    consume.add_argument("--checkpoint", help="beside the store by default")
    consume.add_argument("--group-id", default="stratalog")
    consume.add_argument("--source", default="kafka", help="what the records' source is called")
    consume.add_argument("--batch-size", type=int, default=1000, help="records that begin a batch")
    consume.add_argument("--flush-interval", default="5s", help="time that begins a batch")
    consume.add_argument("--compact-interval", default="5m")
    consume.add_argument("--max-records", type=int, default=-1, help="stop after so many; -1 never")
    consume.add_argument("--from-beginning", action="store_true")
    consume.add_argument("--once", action="store_true", help="stop after what is there now")
    consume.add_argument("--dead-letters")
    for name in ("compact", "relearn", "clear", "mcp"):
        sub.add_parser(name)
    generate = sub.add_parser("generate", help="write log lines of a kind")
    generate.add_argument("--kind", choices=KINDS, required=True)
    generate.add_argument("--lines", type=int, default=100_000)
    generate.add_argument("--seed", type=int, default=42)
    generate.add_argument("--output", required=True)
    sub.add_parser("serve").add_argument("--port", type=int, default=8080)
    for name in QUERIES:
        q = sub.add_parser(name)
        for arg in ("pattern", "id", "from", "to", "last", "limit", "search", "bucket", "baseline", "slots", "topN", "recent", "rawSample", "window"):
            q.add_argument(f"--{arg}")
        q.add_argument("--filter", action="append", default=[], help="slot=value")
    return p


def ago(ms: int, now_ms: int | None = None) -> str:
    """How long ago, as people read it."""
    s = ((int(time.time() * 1000) if now_ms is None else now_ms) - ms) // 1000
    for least, what in ((31536000, "years"), (2592000, "months"), (86400, "days"), (3600, "hrs"), (60, "min"), (1, "sec")):
        if s >= least:
            return f"{s // least} {what} ago"
    return "just now" if s < 0 else f"{s} sec ago"


def table(found: list[dict]) -> str:
    """Rows in aligned columns; times as how long ago."""
    show = lambda k, v: ago(v) if k.endswith("At") and isinstance(v, int) else "" if v is None else str(v)
    cells = [list(found[0])] + [[show(k, v) for k, v in r.items()] for r in found] if found else []
    widths = [max(len(c[i]) for c in cells) for i in range(len(cells[0]))] if cells else []
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells)


def rendered(found: object) -> str:
    """A result as text: lines as they are, rows as a table, an object by its parts."""
    if isinstance(found, list):
        return table(found) if found and isinstance(found[0], dict) else "\n".join(" | ".join(map(str, x)) if isinstance(x, list) else str(x) for x in found)
    if isinstance(found, dict):
        flat = "\n".join(f"{k}: {ago(v) if k.endswith('At') else v}" for k, v in found.items() if not isinstance(v, (list, dict)) or not v)
        parts = [f"{k}:\n{rendered(v)}" for k, v in found.items() if isinstance(v, (list, dict)) and v]
        return "\n".join([flat, *parts])
    return str(found)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "run":
        lines = spooled_lines(spark, sys.stdin.buffer) if args.input == "-" else text_files(spark, args.input)
        batch = store.ingest(groups(lines), batch=args.batch_size)
        unresolved = batch.unresolved
        if unresolved:
            print(f"{unresolved} events have no time of their own and took that of the event before", file=sys.stderr)
        print(json.dumps({"templates": store.templates().count(), "unresolvedTimes": unresolved}))
    elif args.command == "consume":
        most = args.max_records if args.max_records >= 0 else None
        runner = StreamIngest(store, args.dead_letters, duration(args.compact_interval).total_seconds(), args.topic, args.source, most)
        flush = f"{int(duration(args.flush_interval).total_seconds())} seconds"
        stream = kafka(spark, args.servers, args.topic, args.from_beginning, args.group_id, args.batch_size, flush)
        checkpoint = args.checkpoint or f"{args.store.rstrip('/')}-checkpoint-{args.topic}"
        if args.once:
            runner.drain(stream, checkpoint)
        else:
            try:
                runner.start(stream, checkpoint, "1 second").awaitTermination()
            finally:
                runner.maintain()
    elif args.command == "compact":
        before = store.size_bytes()
        print(json.dumps({"compacted": store.compact(), "bytesBefore": before, "bytes": store.size_bytes()}))
    elif args.command == "relearn":
        print(json.dumps(store.relearn()))
    elif args.command == "clear":
        store.clear()
    elif args.command == "generate":
        write(spark, args.kind, args.lines, args.output, seed=args.seed)
    elif args.command == "serve":
        serve(store, args.port).serve_forever()
    elif args.command == "mcp":
        mcp.run(lambda name, given: answer(store, name, given))
    else:
        given = {k: v for k, v in vars(args).items() if isinstance(v, str)} | {"filters": args.filter}
        try:
            found = answer(store, args.command, given)
        except (BadRequest, NotFound) as e:
            print(e, file=sys.stderr)
            return 2
        print(rendered(found) if args.text else json.dumps(found, indent=1, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
