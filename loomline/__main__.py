"""Command line over a table store."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from loomline.operators import register, reports
from loomline.plans import benchmark, cycle, extract, model
from loomline.sources import transcripts
from loomline.sources.store import TableStore
from loomline.streaming import ingest

#: Options of each command, as (name, keyword arguments of the parser).
COMMANDS = {
    "ingest": [("inbox", {}), ("--checkpoint", {"required": True})],
    "ingest-state": [("state", {}), ("--limit", {"type": int, "default": 20})],
    "extract": [("--full-corpus", {"action": "store_true"}), ("--stale-minutes", {"type": int, "default": 30})],
    "mine": [("state", {}), ("--adapter", {"default": "rules"}), ("--version", {"default": "v1"}), ("--limit", {"type": int, "default": 20}), ("--max-calls", {"type": int}), ("--max-usd", {"type": float}), ("--trace", {}), ("--report", {})],
    "report": [("--pilot", {"action": "store_true"}), ("--top", {"type": int, "default": 20})],
    "rekey": [], "purge": [], "status": [], "retry-failed": [], "approve": [("--by", {"required": True}), ("--notes", {"default": ""})],
    "benchmark": [("data", {}), ("--adapter", {"default": "rules"}), ("--runs", {"type": int, "default": 3}), ("--threshold", {"type": float})],
}


def _state(spark: SparkSession, folder: str):
    return transcripts.state_store(spark.read.parquet(f"{folder}/sessions.parquet"), spark.read.parquet(f"{folder}/messages.parquet"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        sub = commands.add_parser(name)
        for option, how in options:
            sub.add_argument(option, **how)
    o = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store, now = TableStore(spark, o.store), datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, indent=1, default=str))
    match o.command:
        case "ingest":
            ingest.start(store, o.inbox, o.checkpoint).awaitTermination()
        case "ingest-state":
            say({"sessions": ingest.take_state(store, *_state(spark, o.state), limit=o.limit)})
        case "extract":
            try:
                say(extract.run(store, full_corpus=o.full_corpus, stale_minutes=o.stale_minutes))
            except extract.NotApproved as e:
                print(e, file=sys.stderr)
                return 2
        case "mine":
            say(str(cycle.mine(store, *_state(spark, o.state), model.make_chat(o.adapter), version=o.version, now=now, limit=o.limit, budget=model.Budget(o.max_calls, o.max_usd), trace=o.trace, report=o.report)))
        case "report":
            say(reports.pilot_markdown(store.read("records", extract.RECORDS)) if o.pilot else cycle.findings_report(store, o.top))
        case "rekey":
            say(cycle.rekey(store))
        case "purge":
            say(cycle.purge(store))
        case "approve":
            extract.approve(store, o.by, o.notes, now)
        case "retry-failed":
            extract.retry_failed(store)
        case "status":
            say(extract.status(store))
            register.progress(store.read("ledger", cycle.LEDGER)).show(truncate=False)
        case "benchmark":
            got = benchmark.run_candidate(transcripts.benchmark(spark, o.data), model.make_chat(o.adapter), runs=o.runs, threshold=o.threshold)
            say(reports.scorecard_markdown(got))
            return 0 if got.get("recall_pass", True) else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
