"""Commands: ingest, status, plan, compact, stats and protocol."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .protocol import Server
from .schema import load_config
from .session import Session
from .sources.store import Store


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="sessionloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--db", default=os.environ.get("SESSIONLOOM_DB", ".sessionloom"))
    common.add_argument("--config")
    one = argparse.ArgumentParser(add_help=False, parents=[common])
    one.add_argument("--session", default="default")
    one.add_argument("--model")
    one.add_argument("--context-window", type=int)
    one.add_argument("--reserved-output", type=int)
    ingest = sub.add_parser("ingest", parents=[one])
    ingest.add_argument("--file", help="JSON lines; standard input if it is not given")
    for name in ("status", "plan", "compact", "stats"):
        p = sub.add_parser(name, parents=[one])
        p.add_argument("--json", action="store_true")
        p.add_argument("--predicted-extra", type=int, default=0)
    sub.add_parser("protocol", parents=[common])
    args = top.parse_args(argv)

    spark = SparkSession.builder.appName("sessionloom").getOrCreate()
    store, config = Store(spark, args.db), load_config(args.config)
    if args.command == "protocol":
        Server(store, config).serve(sys.stdin, sys.stdout)
        return 0
    model = store.load_model(args.session, config)
    given = {"name": args.model, "context_window": args.context_window, "reserved_output_tokens": args.reserved_output}
    session = Session(store, args.session, config, replace(model, **{k: v for k, v in given.items() if v is not None}))
    show = lambda x: print(json.dumps(x, default=str, indent=2))
    if args.command == "ingest":
        n = session.ingest_file(args.file) if args.file else session.ingest_lines(sys.stdin)
        print(f"ingested {n} items into session {args.session!r}")
    elif args.command == "status":
        row = session.status(args.predicted_extra).first()
        found = row.asDict(True) if row else {"session_id": args.session, "item_count": 0}
        show(found) if args.json else print("\n".join(f"{k}: {v}" for k, v in found.items() if k not in ("composition", "candidates")))
    elif args.command == "plan":
        actions, header = session.plan(args.predicted_extra)
        show((header.first() or {}) and header.first().asDict() | {"actions": [r.asDict(True) for r in actions.orderBy("idx").collect()]})
    elif args.command == "compact":
        rows = session.compact(args.predicted_extra).collect()
        run = session.store.runs(args.session).collect()[-1]
        show([r.asDict() for r in rows]) if args.json else print(f"{run.before_tokens} -> {run.after_tokens} tokens, {run.before_tokens - run.after_tokens} reclaimed, {len(rows)} items")
    else:
        found = session.stats()
        show(found) if args.json else print("\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
