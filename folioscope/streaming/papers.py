"""Papers as keyed state of a stream: listings, observations of versions and decisions come in any order.

Each paper holds an open log of actions and a settled state. Actions are applied in the order of their numbers, so slices
of a stream may come in any order: a paper's state is its settled part with the open log played on it. When rows of a paper
have been played, its actions that are ``lateness`` older than the watermark settle, which bounds the log; that of a paper without
new rows stays as it is. An action that comes later still isn't lost: it is applied where it arrives, after what is settled. An action read twice counts once while it is open; where sources repeat
settled ones, put ``replay.keep_first`` before.

Rules of an action on a version: the first observation makes it relevant if the catalogue covers it, else pending; a changed
digest makes it pending and keeps the digest last reviewed; a decision takes its status and reviews the present digest, and
one on a version not yet observed is void. Listings are coverage evidence; the first one with discovery promotes a paper.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.session import find_package

ACTION = "seq long, at long, kind string, version long, digest string, decision string, published long, batch long, discover boolean"
STATE = "version long, digest string, status string, reviewed string, decisions long, discovered boolean, first_batch long, promoted long"
FIELDS = [f.split()[0] for f in ACTION.split(", ")]
OUT = [f.split()[0] for f in STATE.split(", ")]
ROW = f"id long, {STATE}"
#: Key of the row with what belongs to a paper, not a version; versions begin at 1.
PAPER = 0


def play(versions: dict[int, dict], actions: list[dict]) -> dict[int, dict]:
    """The state after ``actions``, which are applied in the order of their numbers."""
    for a in sorted(actions, key=lambda a: a["seq"]):
        v, kind = a["version"], a["kind"]
        if kind == "listed":
            p = versions.setdefault(PAPER, dict.fromkeys(OUT) | {"version": PAPER, "decisions": 0, "discovered": False})
            p["discovered"] = p["discovered"] or a["discover"]
            p["first_batch"] = a["batch"] if p["first_batch"] is None else min(p["first_batch"], a["batch"])
            if a["discover"]:
                p["promoted"] = a["batch"] if p["promoted"] is None else min(p["promoted"], a["batch"])
        elif kind == "observed" and v not in versions:
            covered = a["published"] is not None and v <= a["published"]
            first = {"version": v, "digest": a["digest"], "status": "relevant" if covered else "pending", "reviewed": a["digest"] if covered else None, "decisions": 0}
            versions[v] = dict.fromkeys(OUT) | first
        elif kind == "observed" and versions[v]["digest"] != a["digest"]:
            versions[v] |= {"digest": a["digest"], "status": "pending"}
        elif kind == "decided" and v in versions:
            versions[v] |= {"status": a["decision"], "reviewed": versions[v]["digest"], "decisions": versions[v]["decisions"] + 1}
    return versions


def settled_and_open(settled: dict[int, dict], log: list[dict], end: int) -> tuple[dict[int, dict], list[dict]]:
    """Both after the actions up to the time ``end`` are settled, in order: none with a smaller number may stay open."""
    last = max((a["seq"] for a in log if a["at"] <= end), default=None)
    if last is None:
        return settled, log
    return play(settled, [a for a in log if a["seq"] <= last]), [a for a in log if a["seq"] > last]


def keeper(lateness_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of a paper: its rows are played on its state, then what is late enough settles. State, actions and changed rows are
    texts, so a paper costs one read and one write of its state in a micro-batch, however many versions and actions it has."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, log = json.loads(state.get[0]) if state.exists else ([], [])
        copy = lambda: {v["version"]: dict(v) for v in settled}
        log = {a["seq"]: a for a in log}
        before = play(copy(), [*log.values()])
        for frame in frames:
            for a in map(json.loads, frame["action"]):
                log.setdefault(a["seq"], a)  # one that was read before has its number in the log
        after = play(copy(), [*log.values()])
        kept, still = settled_and_open(copy(), [*log.values()], state.getCurrentWatermarkMs() - lateness_ms)
        state.update((json.dumps([[*kept.values()], still]),))
        changed = [json.dumps(v) for k, v in after.items() if before.get(k) != v]
        if changed:
            yield pd.DataFrame({"id": key[0], "state": changed})

    return step


def paper_states(actions: DataFrame, out: str, lateness: str = "2 days") -> None:
    """Runs a stream of ``actions(id, ts, seq, kind, version, digest, decision, published, batch, discover)`` into the table ``out`` of
    changed rows, a folder a micro-batch; one that is run again replaces its folder.

    The watermark is that of ``ts``. There is no timeout, so Spark drops no late row.
    """
    spark = actions.sparkSession
    find_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    action = F.struct(*[F.unix_millis("ts").alias(f) if f == "at" else F.col(f) for f in FIELDS])
    named = actions.withWatermark("ts", "0 seconds").select("id", "ts", F.to_json(action, {"ignoreNullFields": "false"}).alias("action"))
    states = named.groupBy("id").applyInPandasWithState(keeper(ms), "id long, state string", "state string", "update", GroupStateTimeout.NoTimeout)

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("id", F.from_json("state", STATE).alias("s")).select("id", "s.*")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = states.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each paper and version in ``out``; version 0 is the paper's own."""
    rows = spark.read.schema(f"{ROW}, batch long").parquet(out)
    cols = ["digest", "status", "reviewed", "decisions", "discovered", "first_batch", "promoted"]
    return rows.groupBy("id", "version").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("id", "version", "r.*")
