"""python -m folioscope.cli LEDGER COMMAND ...: the maintenance commands. Results are JSON on stdout; an error is
JSON on stderr and exit code 2."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from datetime import date

from pyspark.sql import functions as F

from folioscope.operators import harvest
from folioscope.operators.runs import LANES, SCHEMAS, Ledger, LedgerError
from folioscope.session import build_session, ensure_workers, materialize
from folioscope.sources import html, readers


def _catalogue(spark, path: str):
    rows = readers.papers(spark, path)
    return rows.select(F.col("arxivId").alias("id"), F.col("arxivVersion").alias("version"))


def _frame(spark, path: str, name: str):
    return spark.read.schema(SCHEMAS[name]).json(path, multiLine=True)


def _edges(x: Ledger, out: str) -> dict:
    """Mapped edges as a table; the answer names it and its size."""
    x.citations()["edges"].select("src", "dst").write.parquet(out)
    return {"edges": x.spark.read.schema("src string, dst string").parquet(out).count(), "table": out}


def _harvest(x: Ledger, path: str) -> dict:
    """What a harvest by this configuration would ask for: checked sources, and the plan's window and due authors."""
    checked = harvest.config(json.loads(x.files.read(path))).checked()
    day = checked.coverage_through or date.today()
    return {"config": {k: v for k, v in asdict(checked).items() if k != "errors"}, "plan": x.plan(day.isoformat(), checked.overlap_days, checked.author_limit)}


def _references(x: Ledger, run: str, path: str, supersede: bool) -> dict:
    """Bibliographies of a table of pages (id, version, html); the first page that isn't whole is an error."""
    pages = x.spark.read.schema("id string, version int, html string").json(path)
    ensure_workers(x.spark)
    keyed = pages.select(F.to_json(F.struct("id", "version")).alias("key"), "html")
    parsed = html.parse_pages(keyed, "key", "html", html.bibliography, "references array<string>, error string", with_key=True)
    got = materialize(parsed, "references").select(F.from_json("key", "id string, version int").alias("k"), "references", "error")
    rows = readers.strict(got.select("k.id", "k.version", F.col("references").alias("refs"), "error"), "references")
    return x.record_references(run, rows, supersede)["tables"]


SEEN = "id string, version int, digest string, updated string"

#: command: (arguments, what it does with the ledger and the arguments)
COMMANDS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "initialize": (("catalogue",), lambda x, a: x.initialize(_catalogue(x.spark, a.catalogue))),
    "plan": (("today",), lambda x, a: x.plan(a.today)),
    "start-run": (("run", "start", "end", "--lanes"), lambda x, a: x.start_run(a.run, a.start, a.end, tuple(a.lanes.split(",")) if a.lanes else LANES)),
    "set-lane": (("run", "lane", "status"), lambda x, a: x.set_lane(a.run, a.lane, a.status)),
    "record-listing": (("run", "source", "key", "ids", "seen", "--payload"), lambda x, a: x.record_listing(a.run, a.source, a.key, [r["id"] for r in readers.id_list(x.spark, a.ids).collect()], a.payload, a.seen)),
    "observe-paper": (("run", "rows"), lambda x, a: x.observe(a.run, x.spark.read.schema(SEEN).json(a.rows, multiLine=True))),
    "screen": (("run", "paper", "version", "decision", "--authors"), lambda x, a: x.screen(a.run, a.paper, int(a.version), a.decision, a.authors.split(";") if a.authors else [])),
    "record-references": (("run", "rows", "--supersede"), lambda x, a: x.record_references(a.run, _frame(x.spark, a.rows, "snapshots").select("id", "version", "refs"), bool(a.supersede))),
    "set-search-cursor": (("run", "key", "value"), lambda x, a: x.set_cursor(a.run, "searches", a.key, json.loads(a.value))),
    "set-author-cursor": (("run", "key", "value"), lambda x, a: x.set_cursor(a.run, "authors", a.key, json.loads(a.value))),
    "get-cursor": (("lane", "key"), lambda x, a: x.get_cursor(a.lane, a.key)),
    "review-bundle": (("--limit",), lambda x, a: x.review_bundle(int(a.limit or 500))),
    "mapped-citations": (("out",), lambda x, a: _edges(x, a.out)),
    "harvest": (("config",), lambda x, a: _harvest(x, a.config)),
    "references": (("run", "pages", "--supersede"), lambda x, a: _references(x, a.run, a.pages, bool(a.supersede))),
    "complete-run": (("run", "start", "end", "--changes"), lambda x, a: x.complete_run(a.run, a.start, a.end, int(a.changes or 0))),
    "abort-run": (("run",), lambda x, a: x.abort_run(a.run)),
    "status": ((), lambda x, a: x.status()),
    "rebuild": (("catalogue",), lambda x, a: x.rebuild(_catalogue(x.spark, a.catalogue))),
    "reset": (("catalogue",), lambda x, a: x.rebuild(_catalogue(x.spark, a.catalogue).where("1 = 0"))),
}


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    parser.add_argument("ledger")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in COMMANDS.items():
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
    args = parser.parse_args(argv)
    try:
        out = COMMANDS[args.command][1](Ledger(spark or build_session(), args.ledger), args)
    except (LedgerError, ValueError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    print(json.dumps(out, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
