"""Keyed state of papers and late first sightings, over several micro-batches in any order."""

import json
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from folioscope.session import fresh_path
from folioscope.streaming import papers, replay

SCHEMA = "id long, ts timestamp, seq long, kind string, version long, digest string, decision string, published long, batch long, discover boolean"


def actions(spark, n=240, seed=3):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = []
    for seq in range(n):
        kind = rng.choice(["listed", "observed", "observed", "decided"])
        paper = rng.randint(1, 9)
        rows.append((paper, start + timedelta(hours=seq), seq, kind, rng.randint(1, 3), rng.choice("ab"), rng.choice(["relevant", "excluded"]), paper % 4 or None, seq // 10, rng.random() < 0.4))
    return spark.createDataFrame(rows, SCHEMA), rows


def by_force(rows):
    out = {}
    for paper in {r[0] for r in rows}:
        log = [dict(zip(["id", "ts", *[f for f in papers.FIELDS if f != "at"]], r)) for r in rows if r[0] == paper]
        for v in papers.play({}, log).values():
            out[paper, v["version"]] = tuple(v[f] for f in papers.OUT[1:])
    return out


def states(spark, df, by, n, lateness):
    root = fresh_path(spark, "papers")
    papers.paper_states(replay.slices(df, by, n, f"{root}/in"), f"{root}/out", lateness)
    got = papers.latest(spark, f"{root}/out")
    batches = {r["batch"] for r in spark.read.schema("id long, batch long").parquet(f"{root}/out").select("batch").distinct().collect()}
    assert len(batches) >= min(n, 3)
    return {(r["id"], r["version"]): tuple(r[c] for c in papers.OUT[1:]) for r in got.collect()}


def test_rules_of_play():
    base = {"at": 0, "published": 1, "batch": 4, "discover": False, "decision": "excluded"}
    act = lambda seq, kind, v, digest="a": base | {"seq": seq, "kind": kind, "version": v, "digest": digest}
    got = papers.play({}, [act(3, "observed", 1, "b"), act(1, "observed", 1), act(2, "decided", 1), act(0, "decided", 2), act(5, "observed", 2)])
    assert (got[1]["status"], got[1]["reviewed"], got[1]["digest"], got[1]["decisions"]) == ("pending", "a", "b", 1)
    assert (got[2]["status"], got[2]["reviewed"], got[2]["decisions"]) == ("pending", None, 0)  # above the catalogue; the decision was void
    paper = papers.play({}, [act(1, "listed", 1), act(2, "listed", 1) | {"discover": True, "batch": 9}])[papers.PAPER]
    assert (paper["discovered"], paper["first_batch"], paper["promoted"]) == (True, 4, 9)


def test_slices_in_any_order_end_alike(spark):
    df, rows = actions(spark)
    want = by_force(rows)
    for order in (F.col("seq"), -F.col("seq") * 7 + 3):
        assert states(spark, df, order, 5, "400 days") == want


def test_settled_actions_are_kept_and_late_ones_count(spark):
    df, rows = actions(spark)
    assert states(spark, df, F.floor(F.col("seq") / 48), 5, "1 hour") == by_force(rows)
    late = [(50, datetime(2020, 1, 1, tzinfo=timezone.utc), 10_000, "observed", 1, "z", None, None, None, None)]
    both = df.unionByName(spark.createDataFrame(late, SCHEMA))
    got = states(spark, both, F.when(F.col("seq") == 10_000, 4).otherwise(F.floor(F.col("seq") / 60)), 5, "1 hour")
    assert got[50, 1][:2] == ("z", "pending") and {k: v for k, v in got.items() if k[0] != 50} == by_force(rows)


def test_a_step_reads_and_writes_its_state_once():
    """Whatever a paper holds, one read and one write of its state a micro-batch; what is late enough settles with all before it."""

    class State:
        value, exists, reads, writes = None, False, 0, 0

        @property
        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.value, self.exists, self.writes = value, True, self.writes + 1

        def getCurrentWatermarkMs(self):
            return 1_000

    act = {"kind": "observed", "version": 1, "decision": None, "published": None, "batch": 0, "discover": None}
    rows = [act | {"seq": k, "at": at, "digest": d} for k, at, d in ((1, 950, "a"), (2, 800, "b"), (3, 990, "a"))]
    state, step = State(), papers.keeper(100)
    for part in (rows[2:], rows[:2], rows):
        got = [json.loads(x) for f in step((7,), iter([pd.DataFrame({"action": [json.dumps(a) for a in part]})]), state) for x in f["state"]]
        settled, still = json.loads(state.value[0])
    assert (state.reads, state.writes) == (2, 3)
    assert [v["digest"] for v in settled] == ["b"] and [a["seq"] for a in still] == [3]
    assert got == []  # the same rows once more end as before


def test_late_first_sightings_are_kept(spark):
    day = lambda n: datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(days=n)
    rows = [(0, day(0), 1), (0, day(100), 2), (1, day(101), 3), (2, day(30), 4), (2, day(0), 1), (3, day(30), 4), (3, day(30), 4), (3, day(100), 2)]
    df = spark.createDataFrame(rows, "slice long, ts timestamp, user_id long").withColumn("event_type", F.lit("a"))
    root = fresh_path(spark, "late")
    got = replay.dedup_table(replay.slices(df, F.col("slice"), 4, f"{root}/in"), f"{root}/out")
    assert sorted(r["k"][:4] for r in got.collect()) == ["a|1|", "a|2|", "a|3|", "a|4|"]
    by_batch = spark.read.schema("k string, batch long, day string").parquet(f"{root}/out").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in by_batch} == {0: 2, 1: 1, 2: 1}  # the last batch is all replays


def test_a_batch_run_again_replaces_its_rows(spark):
    df = spark.createDataFrame([(k, "d") for k in ("x", "y")], "k string, day string")
    root = fresh_path(spark, "again")
    for _ in range(2):  # new offsets: batch 0 twice
        out = f"{root}/out"
        replay.keep_first(replay.slices(df, F.lit(0), 1, fresh_path(spark, "again-in")), "k", "day", out)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}-offsets")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    assert replay.kept_table(spark, out, "k string").count() == 2
