import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import frontier, graph, harvest, layout, search, state, validate


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_citation_edges(spark):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    cites = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "outside")], "src string, dst string")
    assert rows(graph.mapped_edges(cites, papers), "src", "dst") == [("a", "b")]
    assert rows(graph.incoming_counts(graph.mapped_edges(cites, papers, False), papers), "id", "n") == [("a", 1), ("b", 2), ("c", 0)]
    order = spark.createDataFrame([("a", 2), ("c", 1)], "id string, pos int")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")
    assert graph.cited_by(edges, order).first()["ids"] == ["c", "a"]


def test_stale_gives_no_edges(spark):
    papers = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", 1)], "id string, version int")
    observed = spark.createDataFrame([("a", 2)], "id string, version int")
    heads = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1)], "id string, version int")
    status = graph.snapshot_status(papers, observed, heads)
    assert rows(status, "id", "status") == [("a", "stale"), ("b", "exact"), ("c", "unknown"), ("d", "missing")]
    refs = spark.createDataFrame([("a", 1, "b"), ("b", 1, "a"), ("b", 1, "b"), ("b", 2, "d")], "id string, version int, ref string")
    assert rows(graph.mapped_citations(status, refs), "src", "dst") == [("b", "a")]


def test_filter(spark):
    papers = spark.createDataFrame(
        [("first", "higgsino solar axion", "x", "o", "2024-01-01"), ("second", "solar", "x", "o", "2024-01-02"), ("last", "the higgsino solar", "x", "o", "2024-01-31"), ("bad", "higgsino solar", "x", "o", "nope")],
        "id string, text string, island string, contribution string, day string",
    ).withColumn("published", F.try_to_date("day", "yyyy-MM-dd"))
    from datetime import date

    got = search.filter_catalog(papers, "higgsino solar", "x", "o", (date(2024, 1, 1), date(2024, 1, 31)))
    assert rows(got, "id") == [("first",), ("last",)]
    assert search.filter_catalog(papers).count() == 4


def test_empty_bounds_raise(spark):
    with pytest.raises(Exception, match="no dates"):
        search.date_bounds(spark.createDataFrame([], "d date"), "d").collect()


def test_replay(spark):
    old = spark.createDataFrame([("s", "k", "c1", "i1")], "source string, batch_key string, content_sha string, ids_sha string")
    new = spark.createDataFrame([("s", "k", "c1", "i1"), ("s", "k", "c2", "i2"), ("s", "k", "c1", "i9")], old.schema)
    assert rows(state.record_batches(old, new), "content_sha", "ids_sha", "state") == [("c1", "i1", "replayed"), ("c1", "i9", "conflict"), ("c2", "i2", "new")]


def test_observe(spark):
    old = spark.createDataFrame(
        [("a", 1, "d", "relevant", "d"), ("b", 1, "d", "excluded", "d"), ("z", 1, "d", "pending", None)], "id string, version int, digest string, status string, reviewed string"
    )
    seen = spark.createDataFrame([("a", 1, "e"), ("b", 1, "d"), ("c", 1, "n"), ("d", 2, "n")], "id string, version int, digest string")
    catalogue = spark.createDataFrame([("a", 1), ("c", 1), ("d", 1)], "id string, published int")
    got = state.observe(old, seen, catalogue)
    assert {r["id"]: (r["status"], r["reviewed"]) for r in got.collect()} == {
        "a": ("pending", "d"), "b": ("excluded", "d"), "c": ("relevant", "n"), "d": ("pending", None), "z": ("pending", None),
    }


def test_frontier(spark):
    seen = spark.createDataFrame([("s", i, x) for i, x in enumerate("abacde")] + [("t", 0, "q")], "source string, pos int, id string")
    mark = spark.createDataFrame([("s", "d"), ("s", "c")], "source string, id string")
    assert rows(frontier.delta(seen, mark), "source", "id", "hit") == [("s", "a", True), ("s", "b", True), ("t", "q", False)]
    assert rows(frontier.following(seen, 2), "source", "place", "id") == [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "q")]


def test_pages_complete(spark):
    pages = spark.createDataFrame([("s", 1, 3, ["a", "b"]), ("s", 2, 3, ["c"]), ("t", 1, 2, ["a"]), ("t", 2, 3, ["a"])], "source string, page int, total int, ids array<string>")
    assert rows(frontier.pages_complete(pages), "source", "stable", "no_repeat", "exhausted") == [("s", True, True, True), ("t", False, False, False)]


def test_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 2)], "g string, r int")
    assert rows(validate.not_contiguous(df, "g", "r"), "g") == [("b",), ("c",)]
    with pytest.raises(ValueError, match="dup: a"):
        validate.enforce(validate.duplicates(df.unionByName(df), "dup", ["g", "r"]))
    validate.enforce(validate.duplicates(df, "dup", ["g", "r"]))


def test_budget(spark):
    a = spark.createDataFrame([(3, 1), (1, 2)], "id int, ord int")
    b = spark.createDataFrame([(7, 0), (8, 0)], "id int, ord int")
    got = [tuple(r) for r in state.budget(a, b, 3).select("stage", "id", "total", "truncated").collect()]
    assert got == [(1, 3, 4, True), (1, 1, 4, True), (2, 7, 4, True)]


def test_enclosing_circle():
    rng = random.Random(4)
    for n in (1, 2, 3, 40):
        pts = np.array([[rng.random(), rng.random()] for _ in range(n)])
        x, y, r = layout.enclosing_circle(pts[:, 0], pts[:, 1])
        d = np.hypot(pts[:, 0] - x, pts[:, 1] - y)
        assert d.max() <= r + 1e-9
        if n > 1:
            on = [math.atan2(p[1] - y, p[0] - x) for p, q in zip(pts, d) if q > r - 1e-7]
            gaps = sorted(on)
            assert max((b - a) % (2 * math.pi) for a, b in zip(gaps, gaps[1:] + gaps[:1])) <= math.pi + 1e-5  # no half plane is free
    xs = np.random.default_rng(1).normal(size=(5000, 2))
    x, y, r = layout.enclosing_circle(xs[:, 0], xs[:, 1])
    assert np.hypot(xs[:, 0] - x, xs[:, 1] - y).max() <= r + 1e-8


def test_pack():
    rng = np.random.default_rng(2)
    x, y, worst = layout.relax(rng.normal(size=200), rng.normal(size=200), np.full(200, 3.0), 1.0)
    i, j = np.triu_indices(200, 1)
    assert worst <= 1e-3 and (np.hypot(x[i] - x[j], y[i] - y[j]) >= 7 - 1e-3).all()


def test_spiral_place():
    first = layout.spiral_place("x", [(50, 50)], [])
    assert math.hypot(first[0] - 50, first[1] - 50) <= 2.5 + 0.01
    taken = []
    for k in range(60):
        place = layout.spiral_place(f"p{k % 7}", [(50, 50)], taken)
        assert all(math.dist(place, t) >= 4.59 for t in taken) and 4 <= min(place) and max(place) <= 96
        taken.append(place)
    mixed = layout.spiral_place("x", [(50, 50), (80, 20), (60, 40)], [])
    assert (mixed[0] - first[0], mixed[1] - first[1]) == pytest.approx((0.22 * 20, -0.22 * 20), abs=0.02)
    with pytest.raises(ValueError, match="no free place for x"):
        layout.spiral_place("x", [(50, 50)], [(a, b) for a in range(0, 101, 4) for b in range(0, 101, 4)])


def test_enclosing_circle_of_circles():
    """No smaller circle by a search about the centre, and each case against all circles that rest on one, two or three."""
    rng = np.random.default_rng(7)
    for k in range(120):
        n = int(rng.integers(1, 9))
        x, y, r = rng.normal(0, 5, n), rng.normal(0, 5, n), rng.uniform(0, 3, n) * (k % 3 > 0)
        cx, cy, whole = layout.enclosing_circle(x, y, r)
        reach = lambda a, b: (np.hypot(x - a, y - b) + r).max()  # noqa: B023, E731
        assert reach(cx, cy) <= whole + 1e-9
        turns = rng.uniform(0, 2 * math.pi, 60)
        assert all(reach(cx + s * math.cos(t), cy + s * math.sin(t)) >= whole - 1e-9 for t in turns for s in (1e-7, 1e-4, 0.1, 1))
    big = np.random.default_rng(8)
    x, y, r = big.normal(0, 1e4, 5000), big.normal(0, 1e4, 5000), big.uniform(0, 40, 5000)
    cx, cy, whole = layout.enclosing_circle(x, y, r)
    assert abs((np.hypot(x - cx, y - cy) + r).max() - whole) <= 1e-8
    assert layout.enclosing_circle(x[order := big.permutation(5000)], y[order], r[order]) == pytest.approx((cx, cy, whole), abs=1e-8)
    assert layout.enclosing_circle(np.array([1.0, 1.0]), np.array([2.0, 2.0])) == (1.0, 2.0, 0.0)


def test_exit_vectors():
    from folioscope.operators import islands

    rng = np.random.default_rng(3)
    dx, dy, clear = rng.uniform(-9, 9, 400), rng.uniform(-6, 6, 400), rng.uniform(0.5, 3, 400)
    ex, ey = islands.exit_vectors(dx, dy, 4.0, 1.5, clear)
    away = lambda a, b: np.hypot(a - np.clip(a, -4, 4), b - np.clip(b, -1.5, 1.5))
    assert (away(dx + ex, dy + ey) >= clear - 1e-9).all()
    assert (np.hypot(ex, ey)[away(dx, dy) >= clear] == 0).all()


def test_relax_island():
    """600 circles and a label: no overlap above the tolerance; a later circle hardly moves earlier ones."""
    from folioscope.operators import islands

    k = np.arange(600)
    t, a = 9.0 * np.sqrt(k), k * layout.GOLDEN
    r = np.random.default_rng(1).uniform(5, 9, 600)
    x, y, lx, ly, worst = islands.relax_island(t * np.cos(a), t * np.sin(a), r, t * np.cos(a), t * np.sin(a), 120, 34)
    i, j = np.triu_indices(600, 1)
    assert worst <= 1e-3 and (np.hypot(x[i] - x[j], y[i] - y[j]) - r[i] - r[j] >= layout.PAPER_GAP - 1e-3).all()
    gap = np.hypot(x - lx - np.clip(x - lx, -60, 60), y - ly - np.clip(y - ly, -17, 17))
    assert (gap >= r + layout.LABEL_GAP - 1e-3).all()


def test_arrange(spark):
    from folioscope.operators import islands

    rng = np.random.default_rng(5)
    members = [(m, g, 100 * g + i, 100 * g + i, float(rng.normal()), float(rng.normal()), 8.0 if m == "uniform" else 6.0 + i % 9) for m in ("uniform", "sized") for g in range(5) for i in range(20 + 10 * g)]
    where = [(m, g, float(rng.uniform(0, 1160)), float(rng.uniform(0, 780)), 120.0, 34.0, g == 0) for m in ("uniform", "sized") for g in range(5)]
    df = spark.createDataFrame(members, "map string, group int, id long, rank long, x double, y double, radius double")
    rings = spark.createDataFrame(where, "map string, group int, x double, y double, label_width double, label_height double, firm boolean")
    assert islands.geometry_violations(df, rings).count() == 0
    points, circles = islands.arrange(df, rings)
    circles, points = circles.toPandas(), points.toPandas()
    assert (points["kind"] == "paper").sum() == len(members) and (points["kind"] == "label").sum() == len(circles) == 10
    for name, c in circles.groupby("map"):
        x, y, r = (c[k].to_numpy() for k in ("x", "y", "radius"))
        i, j = np.triu_indices(len(c), 1)
        assert (np.hypot(x[i] - x[j], y[i] - y[j]) - r[i] - r[j] >= layout.OUTER_GAP - 1e-3).all()
        assert (x - r >= 14 - 1e-6).all() and (x + r <= c["width"].iloc[0] - 14 + 1e-6).all() and (y + r <= c["height"].iloc[0] - 14 + 1e-6).all()
        assert c["width"].iloc[0] % 8 == 0
    both = points.merge(circles, on=["map", "group"], suffixes=("", "_c"))
    assert (np.hypot(both["x"] - both["x_c"], both["y"] - both["y_c"]) + both["radius"] <= both["content"] + 1e-6).all()
    assert [tuple(r) for r in islands.in_geometry_order(spark.createDataFrame([(1, 2, 3), (1, 1, 9), (0, 5, 1), (1, 1, 2)], "x int, y int, radius int")).collect()] == [(0, 5, 1), (1, 1, 2), (1, 1, 9), (1, 2, 3)]
    bad = spark.createDataFrame([("u", 0, 1, 1, float("nan"), 0.0, 1.0), ("u", 0, 1, -1, 0.0, 0.0, 1.0), ("u", 9, 3, 1, 0.0, 0.0, -1.0)], df.schema)
    found = {r["rule"] for r in islands.geometry_violations(bad, rings).collect()}
    assert found == {"member geometry", "member id", "member rank", "unknown island"}


def test_pack_large_group(spark):
    """A group is packed by near pairs, to the tolerance of all pairs."""
    rng = np.random.default_rng(3)
    xs = rng.uniform(0, 900, (3200, 2))
    xs[1] = xs[0]
    rows = [(1, i, i, float(x), float(y), 3.0) for i, (x, y) in enumerate(xs)]
    df = spark.createDataFrame(rows, "group int, id long, rank long, x double, y double, radius double")
    got = layout.pack(df, 1.0).toPandas()
    assert sorted(got["id"]) == [*range(3200)] and got["overlap"].max() <= 1e-3
    x, y = got["x"].to_numpy(), got["y"].to_numpy()
    i, j = np.triu_indices(3200, 1)
    assert (np.hypot(x[i] - x[j], y[i] - y[j]) >= 7 - 1e-3).all()
    near = {p for a, b in layout.close_pairs(xs[:, 0], xs[:, 1], 7.0, 1000) for p in zip(a.tolist(), b.tolist())}
    d = np.hypot(xs[i, 0] - xs[j, 0], xs[i, 1] - xs[j, 1])
    assert {*zip(i[d < 7].tolist(), j[d < 7].tolist())} <= near


def test_close_pairs_by_table_and_by_search():
    """A far member, for whom no table of cells is made, changes neither pairs nor their order nor the blocks."""
    xs = np.random.default_rng(5).uniform(0, 300, (900, 2))
    far = np.concatenate([xs, [[1e9, 1e9]]])
    for block in (7, 1000, 200_000):
        table, search = ([[*zip(i.tolist(), j.tolist())] for i, j in layout.close_pairs(p[:, 0], p[:, 1], 9.0, block)] for p in (xs, far))
        assert table == search and max(map(len, table)) <= block
    i, j = np.triu_indices(900, 1)
    near = np.hypot(*(xs[i] - xs[j]).T) < 9
    assert {*zip(i[near].tolist(), j[near].tolist())} <= {p for b in table for p in b} and len(table) <= 5


def test_enclosing_circles_exact(spark):
    """Support points between two of the 256 directions are not lost."""
    turn = 2 * math.pi / 256
    pts = [(math.cos(a), math.sin(a)) for a in (turn / 2, 2.1 + turn / 2, 4.2 + turn / 2)]
    pts += [((1 - 2e-5) * math.cos(k * turn), (1 - 2e-5) * math.sin(k * turn)) for k in range(256)]
    df = spark.createDataFrame([(7, *p) for p in pts] + [(8, 0.0, 0.0)], "group int, x double, y double")
    got = {r["group"]: r for r in layout.enclosing_circles(df).collect()}
    c = got[7]
    assert c["n"] == len(pts) and max(math.hypot(x - c["x"], y - c["y"]) for x, y in pts) <= c["radius"] * (1 + 2e-9)
    assert abs(c["radius"] - 1) < 1e-8 and (got[8]["n"], got[8]["radius"]) == (1, 0.0)


def test_streams(spark, tmp_path):
    from folioscope.streaming import replay

    from .conftest import SF

    events = replay.announcements(spark, f"{SF}/events.parquet")
    replay.run_to_table(replay.daily_counts(events), str(tmp_path / "daily"))
    assert spark.read.parquet(str(tmp_path / "daily")).count() > 0
    q = replay.first_seen(events).writeStream.format("memory").queryName("first").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("first"))
    assert spark.sql("select user_id, first from first").exceptAll(batch).count() == 0


def test_watermark_forgets_old_keys(spark, tmp_path):
    """A replay within the allowance is dropped; one that comes after its key was forgotten is taken as new."""
    from folioscope.streaming import replay

    def batch(k, *rows):
        df = spark.createDataFrame([(i, t, u, "a", 1.0, "") for i, (t, u) in enumerate(rows)], "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        replay.run_to_table(replay.dedup(replay.announcements(spark, str(tmp_path / "in")), "2 days").select("k"), str(tmp_path / "out"))
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert batch(0, ("2024-01-01 01:00:00", 1), ("2024-01-01 05:00:00", 1), ("2024-01-01 02:00:00", 2)) == 2
    assert batch(1, ("2024-01-01 09:00:00", 1), ("2024-01-02 01:00:00", 3)) == 3
    assert batch(2, ("2024-02-01 01:00:00", 1)) == 4
    assert batch(3, ("2024-02-01 02:00:00", 1), ("2024-02-02 02:00:00", 9)) == 5


def test_drop_tables(spark):
    from folioscope import session

    since = session.tables_made()
    one, two = (session.materialize(spark.range(3), f"t{i}") for i in range(2))
    session.drop_tables(spark, since, keep_last=1)
    assert two.count() == 3 and session.tables_made() == since + 1
    session.drop_tables(spark, since)
    with pytest.raises(Exception, match="not exist|FILE|PATH"):
        spark.read.schema("id long").parquet(two.inputFiles()[0]).count()


def test_numbered(spark):
    """Blocks of any size, ties, null keys and orders."""
    rows = [("a", 5, 1), ("a", 1, 2), ("a", 1, 1), (None, 9000, 1), (None, 3, 1), ("a", None, 1), ("b", -1, 1)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    for block in (1, 3, 4096):
        got = {(r["k"], r["at"], r["id"]): r["place"] for r in state.numbered(df, ["k"], "at", ("id",), block).collect()}
        assert got == {("a", None, 1): 1, ("a", 1, 1): 2, ("a", 1, 2): 3, ("a", 5, 1): 4, (None, 3, 1): 1, (None, 9000, 1): 2, ("b", -1, 1): 1}
    assert sorted(r["place"] for r in state.numbered(df, [], "at").collect()) == [*range(1, 8)]
    assert state.numbered(df.limit(0), ["k"], "at").count() == 0


def test_snapshot_states(spark):
    rows = [(1, 1, 1, "x", False), (1, 1, 2, "x", False), (1, 1, 3, "y", False), (1, 1, 4, "y", True), (1, 1, 5, "x", None), (2, 1, 6, "x", True)]
    got = state.snapshot_states(spark.createDataFrame(rows, "id long, version long, seq long, sha string, supersede boolean"))
    assert [(r["state"], r["head"]) for r in got.orderBy("seq").collect()] == [
        ("new", False), ("replayed", False), ("conflict", False), ("superseding", True), ("conflict", False), ("new", True)
    ]


def test_completion_gates_in_order(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    v = "id long, version long, digest string, reviewed string, status string"
    none = (d([], "id long, published long"), d([], "id long, version long"), d([], "id long"), d([], "id long, version long, digest string"))

    def first(versions, catalogue=none[0], references=none[1], found=none[2], log=none[3], done=True, changes=0):
        return validate.completion(d(versions, v), catalogue, references, found, log, F.lit(done), changes).first()["first_failure"]

    good, asked = (1, 2, "d", "d", "relevant"), d([(1, 2)], "id long, version long")
    assert first([]) is None and first([], done=False) == "lanes"
    assert first([(1, 1, "d", None, "excluded")]) == "review" and first([], found=d([(9,)], "id long")) == "review"
    assert first([good]) == "references" and first([good], references=asked) == "unpublished" and first([good], references=asked, changes=1) is None
    assert first([good], d([(1, 2)], "id long, published long"), asked) is None
    assert first([], d([(3, None)], "id long, published long")) == "mapped references"
    unsure = (1, 2, "d", "d", "ambiguous")
    assert first([unsure]) == "ambiguous" and first([unsure], log=d([(1, 2, "d")], "id long, version long, digest string")) is None


def test_bound_plan(spark):
    evidence = spark.createDataFrame([("a", "2024-01-01", "2024-01-09"), ("b", None, None)], "source string, earliest string, latest string")
    with pytest.raises(ValueError, match="bound"):
        harvest.coverage_problems(evidence, ("2024-01-01", "2024-01-09"), ("2024-01-02", "2024-01-09"))
    got = harvest.coverage_problems(evidence, ("2024-01-01", "2024-01-10"), newest="2024-01-09")
    assert [tuple(r) for r in got.collect()] == [("b", "starts late")]


def test_workers_find_the_package(tmp_path):
    """A driver that starts elsewhere, without the repository on its workers' path."""
    import subprocess
    import sys

    from folioscope.session import REPO_ROOT

    code = (
        f"import sys; sys.path.insert(0, {REPO_ROOT!r}); from folioscope import registry; from folioscope.session import build_session;"
        "print('rows', registry.queries()['author_key'](build_session(1), '/root/testdata/sf0.001').count(), registry.queries()['search_text'](build_session(1), '/root/testdata/sf0.001').collect()[0]['chars'])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows" in ran.stdout, ran.stderr[-2000:]


def test_pack_small_groups(spark):
    """One member, members at one place, and groups that don't touch."""
    rows = [(1, 0, 0, 5.0, 5.0, 3.0)] + [(2, i, i, 1.0, 1.0, 3.0) for i in range(12)] + [(3, i, i, 100.0 * i, 0.0, 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "group int, id long, rank long, x double, y double, radius double")
    got = layout.pack(df, 1.0).toPandas()
    assert len(got) == 18 and got["overlap"].max() <= 1e-3
    for _, g in got.groupby("group"):
        i, j = np.triu_indices(len(g), 1)
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        assert (np.hypot(x[i] - x[j], y[i] - y[j]) >= 7 - 1e-3).all()
    still = got[got["group"] == 3].sort_values("id")
    assert still["x"].tolist() == [0.0, 100.0, 200.0, 300.0, 400.0]


def test_targets_sort_few_times(spark):
    """What is missing is told by a grouping of ids and a join, so that a task doesn't hold a sort for each input; a head
    without a version still is one."""
    papers = spark.createDataFrame([(1, 2), (2, 2), (3, None), (4, 1)], "id long, version long")
    observed = spark.createDataFrame([(1, 3), (1, 1), (3, None)], "id long, version long")
    heads = spark.createDataFrame([(1, 2), (2, None), (2, 1), (4, 1), (3, 5)], "id long, version long")
    status = graph.snapshot_status(papers, observed, heads.where("id <> 2 or version is null"))
    want = [(1, 3, "stale", 2), (2, 2, "stale", None), (3, None, "unknown", 5), (4, 1, "exact", 1)]
    assert sorted(tuple(r) for r in status.collect()) == want
    more = spark.createDataFrame([(1, 3), (9, 4), (9, 5), (4, None)], "id long, version long")
    targets = graph.reference_targets(status, more, spark.createDataFrame([(9, None), (8, None)], "id long, version long"))
    assert [tuple(r) for r in targets.collect()] == [(1, 3), (2, 2), (4, None), (8, None), (9, 4), (9, 5)]
    plan = targets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 2, plan
