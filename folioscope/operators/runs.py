"""The maintenance ledger: a run state machine over append-only tables, committed by a pointer flip.

Bulk state is Parquet, one folder a table version; a small manifest (runs, lanes, cursors, which folder
holds which table) is a JSON file that is replaced whole. A command computes the new tables as pure
functions of the old, writes them, and only then replaces the manifest, so a failed command changes
nothing. One writer at a time; all days and times are arguments.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.dates import plan_window
from folioscope.operators import graph, state
from folioscope.sources import sinks

SCHEMAS = {
    "catalogue": "id string, version int",
    "batches": "batch_id string, source string, batch_key string, content_sha string, ids_sha string, discover boolean",
    "batch_ids": "batch_id string, ordinal int, id string",
    "discoveries": "id string, run_id string, first_seen string",
    "versions": "id string, version int, digest string, status string, reviewed string, updated string",
    "screenings": "id string, version int, decision string, digest string, seq long",
    "log": "id string, version int, digest string",
    "snapshots": "id string, version int, refs array<string>, refs_sha string, seq long",
    "authors": "author string, served string",
}
LANES = ("listings", "searches", "citation_discovery", "authors", "references")
DONE = ("completed", "no_change")


class LedgerError(ValueError):
    pass


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path, self.files = f"{self.root}/manifest.json", sinks.Shared(spark, root)

    # storage

    def manifest(self) -> dict:
        if not self.files.exists(self.path):
            raise LedgerError("the ledger isn't initialised")
        return json.loads(self.files.read(self.path))

    def table(self, name: str, m: dict | None = None) -> DataFrame:
        at = (m or self.manifest())["tables"].get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], SCHEMAS[name])

    def _commit(self, m: dict, **tables: DataFrame) -> dict:
        for name, df in tables.items():
            at = f"tables/{name}-{uuid.uuid4().hex}"
            df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.parquet(f"{self.root}/{at}")
            m["tables"][name] = at
        self.files.write(self.path, json.dumps(m, indent=2, sort_keys=True) + "\n")
        return m

    # runs

    def initialize(self, catalogue: DataFrame, log: DataFrame | None = None, scan_date: str | None = None) -> dict:
        """Imports the catalogue; covered versions become relevant, papers that left it are dropped from it."""
        m = self.manifest() if self.files.exists(self.path) else {"tables": {}, "runs": {}, "cursors": {}, "coverage": None, "scan_date": scan_date, "seq": 0}
        covered = catalogue.select("id", F.col("version").alias("published"))
        old = self.table("versions", m)
        hit = F.coalesce(F.col("version") <= F.col("published"), F.lit(False))
        versions = old.join(covered, "id", "left").select(
            "id", "version", "digest", F.when(hit, "relevant").otherwise(F.col("status")).alias("status"),
            F.when(hit, F.col("digest")).otherwise(F.col("reviewed")).alias("reviewed"), "updated",
        )
        more = {} if log is None else {"log": log}
        return self._commit(m, catalogue=catalogue, versions=versions, **more)

    def plan(self, today: str, overlap: int = 2, authors: int = 8) -> dict:
        """Coverage window, authors due (never served, then longest ago), committed cursors."""
        m = self.manifest()
        last = (m["coverage"] or {}).get("end") or m["scan_date"]
        start, end = plan_window(date.fromisoformat(today), date.fromisoformat(last) if last else None, overlap)
        due = self.table("authors", m).orderBy(F.asc_nulls_first("served"), "author").limit(authors)
        return {"start": start.isoformat(), "end": end.isoformat(), "authors": [r["author"] for r in due.collect()], "cursors": m["cursors"]}

    def start_run(self, run_id: str, start: str, end: str, lanes: tuple[str, ...] = LANES) -> dict:
        m = self.manifest()
        if any(r["status"] == "running" for r in m["runs"].values()):
            raise LedgerError("another run is running")
        if run_id in m["runs"] or date.fromisoformat(start) > date.fromisoformat(end):
            raise LedgerError("the run is known, or its interval is empty")
        m["runs"][run_id] = {"status": "running", "start": start, "end": end, "required": [*lanes], "lanes": {}, "staged": {}, "order": len(m["runs"])}
        return self._commit(m)

    def _running(self, m: dict, run_id: str) -> dict:
        run = m["runs"].get(run_id)
        if not run or run["status"] != "running":
            raise LedgerError(f"{run_id} isn't running")
        return run

    def set_lane(self, run_id: str, lane: str, status: str) -> dict:
        m = self.manifest()
        if status not in ("completed", "no_change", "deferred", "failed"):
            raise LedgerError(f"no lane status {status}")
        self._running(m, run_id)["lanes"][lane] = status
        return self._commit(m)

    def set_cursor(self, run_id: str, lane: str, key: str, value: object) -> dict:
        """Staged with the run; committed with it."""
        m = self.manifest()
        self._running(m, run_id)["staged"][f"{lane}/{key}"] = value
        return self._commit(m)

    def get_cursor(self, lane: str, key: str) -> object:
        return self.manifest()["cursors"].get(f"{lane}/{key}")

    def abort_run(self, run_id: str) -> dict:
        m = self.manifest()
        self._running(m, run_id)["status"] = "failed"
        return self._commit(m)

    # records

    def record_listing(self, run_id: str, source: str, batch_key: str, ids: list[str], payload: str | None, seen: str, discover: bool = True) -> str:
        """new or replayed; the same content with other ids is an error."""
        m = self.manifest()
        self._running(m, run_id)
        ids = sorted({*ids})
        ids_sha = sinks.digest(ids)
        content = sinks.digest(payload) if payload is not None else ids_sha
        new = self.spark.createDataFrame([(uuid.uuid4().hex, source, batch_key, content, ids_sha, discover)], SCHEMAS["batches"])
        stored = self.table("batches", m)
        told = state.record_batches(stored, new).first()["state"]
        if told == "conflict":
            raise LedgerError("the same content was read as other ids before")
        changed = {}
        if told == "new":
            changed["batches"] = stored.union(new)
            rows = new.select("batch_id").crossJoin(self.spark.createDataFrame([*enumerate(ids)], "ordinal int, id string"))
            changed["batch_ids"] = self.table("batch_ids", m).unionByName(rows)
        if discover:
            found = self.spark.createDataFrame([(i, run_id, seen) for i in ids], SCHEMAS["discoveries"])
            changed["discoveries"] = state.insert_ignore(self.table("discoveries", m), found, ["id"])
        self._commit(m, **changed)
        return told

    def observe(self, run_id: str, seen: DataFrame) -> dict:
        """``seen(id, version, digest, updated)``: new and changed versions wait for review."""
        m = self.manifest()
        self._running(m, run_id)
        old, catalogue = self.table("versions", m), self.table("catalogue", m).select("id", F.col("version").alias("published"))
        now = state.observe(old.drop("updated"), seen.drop("updated"), catalogue)
        stamps = old.select("id", "version", F.col("updated").alias("was")).join(seen.select("id", "version", "updated"), ["id", "version"], "full_outer")
        now = now.join(stamps, ["id", "version"]).withColumn("updated", F.coalesce("updated", "was"))
        found = seen.select("id", F.lit(run_id).alias("run_id"), F.col("updated").alias("first_seen")).distinct()
        return self._commit(m, versions=now, discoveries=state.insert_ignore(self.table("discoveries", m), found, ["id"]))

    def screen(self, run_id: str, paper: str, version: int, decision: str, authors: list[str] = ()) -> dict:
        m = self.manifest()
        self._running(m, run_id)
        if decision not in ("relevant", "excluded", "ambiguous"):
            raise LedgerError(f"no decision {decision}")
        versions = self.table("versions", m)
        here = (F.col("id") == paper) & (F.col("version") == version)
        row = versions.where(here).first()
        if row is None:
            raise LedgerError(f"{paper} v{version} was never observed")
        m["seq"] += 1
        event = self.spark.createDataFrame([(paper, version, decision, row["digest"], m["seq"])], SCHEMAS["screenings"])
        now = versions.withColumns({"status": F.when(here, decision).otherwise(F.col("status")), "reviewed": F.when(here, F.col("digest")).otherwise(F.col("reviewed"))})
        changed = {"versions": now, "screenings": self.table("screenings", m).union(event)}
        if decision == "relevant" and authors:
            rows = self.spark.createDataFrame([(a, None) for a in authors], SCHEMAS["authors"])
            changed["authors"] = state.insert_ignore(self.table("authors", m), rows, ["author"])
        return self._commit(m, **changed)

    def record_references(self, run_id: str, rows: list[tuple[str, int, list[str]]] | DataFrame, supersede: bool = False) -> dict:
        """All snapshots or none, from rows or a table (id, version, refs); another list for a known version needs
        ``supersede``."""
        m = self.manifest()
        self._running(m, run_id)
        given = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, "id string, version int, refs array<string>")
        sorted_refs = F.array_sort(F.array_distinct("refs"))
        # the digest of the list as compact JSON
        new = given.select("id", "version", sorted_refs.alias("refs")).withColumn("refs_sha", F.sha2(F.to_json("refs"), 256))
        known = self.heads(m).select("id", "version", F.col("refs_sha").alias("was"))
        clash = new.join(known, ["id", "version"]).where("refs_sha <> was").select("id", "version").limit(1).collect()
        if clash and not supersede:
            raise LedgerError(f"{clash[0]['id']} v{clash[0]['version']} has other references")
        m["seq"] += 1
        return self._commit(m, snapshots=self.table("snapshots", m).unionByName(new.withColumn("seq", F.lit(m["seq"]).cast("long"))))

    def heads(self, m: dict | None = None) -> DataFrame:
        last = self.table("snapshots", m).groupBy("id", "version").agg(F.max_by(F.struct("refs", "refs_sha"), "seq").alias("h"))
        return last.select("id", "version", "h.refs", "h.refs_sha")

    # views

    def review_bundle(self, limit: int = 500) -> dict:
        """Rows that need review with their reasons, then discoveries without a version, up to ``limit``."""
        m = self.manifest()
        catalogue = self.table("catalogue", m).select("id", F.col("version").alias("published"), F.lit(True).alias("here"))
        log = self.table("log", m).select("id", "version", "digest", F.lit(True).alias("logged"))
        v = self.table("versions", m).join(catalogue, "id", "left").join(log, ["id", "version", "digest"], "left")
        v = v.withColumn("earlier", state.previous(F.when(F.col("reviewed").isNotNull(), F.col("version")), "id", "version").isNotNull())
        c, here = F.col, F.coalesce("here", F.lit(False))
        behind = ~here | c("published").isNull() | (c("published") < c("version"))
        want = (
            (c("status") == "pending") | c("reviewed").isNull() | (c("reviewed") != c("digest"))
            | ((c("status") == "relevant") & behind) | ((c("status") == "ambiguous") & c("logged").isNull())
        )
        reason = state.review_reason(c("status"), here, c("published"), c("version"), c("reviewed"), c("digest"), c("earlier"))
        first = v.where(want).select("id", "version", reason.alias("reason"), F.coalesce("updated", F.lit("")).alias("ord"))
        bare = self.table("discoveries", m).join(v.select("id"), "id", "left_anti").join(catalogue.select("id"), "id", "left_anti")
        bare = bare.select("id", F.lit(None).cast("int").alias("version"), F.lit("metadata_required").alias("reason"), F.col("first_seen").alias("ord"))
        got = state.budget(first, bare, limit).orderBy("stage", "ord", "id").collect()
        rows = [{"id": r["id"], "version": r["version"], "reason": r["reason"]} for r in got]
        total = got[0]["total"] if got else 0
        return {"candidates": rows, "candidateCount": total, "truncated": total > limit}

    def citations(self) -> dict[str, DataFrame]:
        m = self.manifest()
        heads = self.heads(m)
        status = graph.snapshot_status(self.table("catalogue", m), self.table("versions", m).select("id", "version"), heads.select("id", "version"))
        refs = heads.select("id", "version", F.explode("refs").alias("ref"))
        return {"status": status, "edges": graph.mapped_citations(status, refs)}

    def complete_run(self, run_id: str, start: str, end: str, changes: int = 0) -> dict:
        """Gates in order; the first that fails raises, else cursors are promoted and the run is done."""
        m = self.manifest()
        run = self._running(m, run_id)
        if date.fromisoformat(start) > date.fromisoformat(end) or changes < 0:
            raise LedgerError("interval or number of changes is invalid")
        if (start, end) != (run["start"], run["end"]):
            raise LedgerError("the interval isn't the run's")
        if any(run["lanes"].get(x) not in DONE for x in run["required"]) or any(s not in DONE for s in run["lanes"].values()):
            raise LedgerError("a lane isn't complete")
        bundle = self.review_bundle()
        reasons = {c["reason"] for c in bundle["candidates"]}
        if reasons - {"accepted_unpublished", "accepted_revision_unpublished", "ambiguous_unpublished"}:
            raise LedgerError("papers wait for review")
        accepted = self.table("versions", m).where("status = 'relevant'").join(self.heads(m), ["id", "version"], "left_anti")
        accepted = accepted.join(self.table("catalogue", m).select("id", "version"), ["id", "version"], "left_anti")
        if not accepted.isEmpty():
            raise LedgerError("accepted papers lack references")
        if "references" in run["required"] and not self.citations()["status"].where("status <> 'exact'").isEmpty():
            raise LedgerError("catalogue papers lack references")
        if changes == 0 and reasons:
            raise LedgerError("decided papers aren't published")
        m["cursors"] |= run["staged"]
        run["status"] = "completed"
        m["coverage"] = {"start": start, "end": end}
        served = {k.split("/", 1)[1]: end for k in run["staged"] if k.startswith("authors/")}
        more = {}
        if served:
            rows = self.spark.createDataFrame([*served.items()], SCHEMAS["authors"])
            more["authors"] = state.upsert(self.table("authors", m), rows, ["author"])
        return self._commit(m, **more)

    def status(self) -> dict:
        m = self.manifest()
        newest = max(m["runs"].items(), key=lambda r: r[1]["order"], default=(None, None))[0]
        return {"counts": {n: self.table(n, m).count() for n in SCHEMAS}, "newestRun": newest, "runs": {k: r["status"] for k, r in m["runs"].items()}, "coverage": m["coverage"]}

    def rebuild(self, catalogue: DataFrame, log: DataFrame | None = None) -> str:
        """A fresh ledger in place of the old one, which stays beside it; returns the archive's path."""
        name = uuid.uuid4().hex[:8]
        archive, fresh = f"{self.root}.{name}", f"{self.root}.{name}-new"
        Ledger(self.spark, fresh).initialize(catalogue, log)  # beside the old one, where the catalogue may lie
        self.files.move(self.root, archive)
        self.files.move(fresh, self.root)
        return archive
