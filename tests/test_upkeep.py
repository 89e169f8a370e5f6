"""Bucketed tables, signed deltas, digest trees, trigram postings and facet bitmaps against whole rebuilds."""

import hashlib
import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.operators import deltas, digest_tree, facets, postings, search, state, validate
from folioscope.operators.postings import Postings
from folioscope.session import fresh_path
from folioscope.sources import sinks
from folioscope.sources.buckets import BucketTable
from folioscope.sources.response_cache import ResponseCache


def table_of(spark, buckets=16):
    return BucketTable(spark, fresh_path(spark, "buckets"), ["id"], "id long, v string", buckets)


def content(t):
    rows = t.read().collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["v"] for r in rows}


def test_a_small_batch_leaves_other_buckets_alone(spark):
    t = table_of(spark)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    assert t.upsert(rows(range(4000), "a")) == [*range(16)]
    before = {p: sorted(f for f in t.read().inputFiles() if p in f) for p in t.paths()}
    met = t.upsert(rows([7, 8, 9, 4001], "b"))
    assert 1 <= len(met) <= 4
    after = {p: sorted(f for f in t.read().inputFiles() if p in f) for p in t.paths()}
    assert sum(before.get(p) == f for p, f in after.items()) == 16 - len(met)
    want = dict.fromkeys(range(4000), "a") | dict.fromkeys([7, 8, 9, 4001], "b")
    assert content(t) == want
    assert t.insert_ignore(rows([1, 2, 3], "c")) == []  # nothing new: nothing written
    assert len(t.insert_ignore(rows([1, 5000], "c").union(rows([5000], "d")))) == 1
    assert content(t) == want | {5000: "c"}
    lost = t.keep_only(rows([i for i in range(6000) if i not in (11, 4001)], ""))
    assert 1 <= len(lost) <= 2 and content(t) == {k: v for k, v in (want | {5000: "c"}).items() if k not in (11, 4001)}
    assert t.promote(rows([1], "z"), passed=False) == [] and t.promote(rows([1], "z"), passed=True) and content(t)[1] == "z"
    files = t.read().inputFiles()
    assert t.vacuum() > 0 and t.vacuum() == 0 and t.read().inputFiles() == files


def test_empty_tables_and_unfinished_writes(spark):
    t = table_of(spark, 4)
    assert content(t) == {} and t.upsert(t.read()) == []
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    t.read().write.parquet(f"{t.root}/v=2")  # a job that died before its manifest
    assert content(t) == {1: "a", 2: "b"}
    t.upsert(spark.createDataFrame([(2, "c")], "id long, v string"))
    assert content(t) == {1: "a", 2: "c"}
    t.keep_only(spark.createDataFrame([], "id long"))
    assert content(t) == {} and t.paths() == []
    t.upsert(spark.createDataFrame([(None, "n")], "id long, v string"))
    assert content(t) == {None: "n"}


def test_signed_deltas_equal_a_rebuild(spark):
    rng = random.Random(2)
    old = {s: {rng.randint(0, 30) for _ in range(6)} for s in range(40)}
    new = old | {s: {rng.randint(0, 34) for _ in range(4)} for s in (3, 17)} | {40: {1, 99}, 5: set()}
    edges = lambda refs: spark.createDataFrame([(str(s), str(d)) for s, ds in refs.items() for d in ds], "src string, dst string")
    order = spark.createDataFrame([(str(s), -s) for s in range(41)], "src string, pos long")
    held = BucketTable(spark, fresh_path(spark, "index"), ["id"], deltas.INDEX, 64)
    held.upsert(deltas.index_of(edges(old), order))
    changed = [s for s in new if new[s] != old.get(s)]
    part = lambda refs: edges({s: refs[s] for s in changed if s in refs})
    named = {str(d) for s in changed for d in old.get(s, set()) ^ new[s]}
    targets = deltas.signed_edges(part(old), part(new))
    assert {r["dst"] for r in targets.collect()} == named
    met = deltas.update_index(held, part(old), part(new), order)
    assert len(met) <= len(named) < 64
    got = {r["id"]: ([e["src"] for e in r["cited_by"]], r["n"]) for r in held.read().collect()}
    want = {r["id"]: ([e["src"] for e in r["cited_by"]], r["n"]) for r in deltas.index_of(edges(new), order).collect()}
    assert {k: v for k, v in got.items() if v[1]} == want
    deltas.update_index(held, part(old), part(new), order)  # again: nothing changes
    assert {r["id"]: r["n"] for r in held.read().collect() if r["n"]} == {k: v[1] for k, v in want.items()}


def test_digest_tree_goes_down_only_where_tables_differ(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("x")).alias("citedBy"), F.lit(1).cast("long").alias("incomingCitationCount"), F.lit(None).cast("string").alias("searchText"))
    cols = rows.columns
    tree = digest_tree.tree(rows, "id", cols)
    assert tree.where("level = 0").first()["n"] == 3000
    assert digest_tree.differing_leaves(tree, digest_tree.tree(rows.orderBy(F.rand(1)), "id", cols)) == ([], 1)
    bad = rows.withColumn("searchText", F.when(F.col("id") == "77", "").otherwise(F.col("searchText"))).where("id <> '8'").union(rows.where("id = '9'"))
    leaves, compared = digest_tree.differing_leaves(tree, digest_tree.tree(bad, "id", cols))
    assert 1 <= len(leaves) <= 3 and compared <= 1 + 3 * 3 * digest_tree.FANOUT
    assert digest_tree.only_leaves(rows, "id", leaves).count() < 20
    told = lambda df: sorted((r["rule"], r["key"], r["detail"]) for r in df.collect())
    want = told(sinks.index_problems(bad, rows))
    assert want == [("missing", "8", ""), ("repeated", "9", "2"), ("text", "77", "")]
    assert told(sinks.index_problems_in_blocks(bad, rows)) == want == told(sinks.index_problems_in_blocks(bad, rows, digest_tree.tree(bad, "id", cols)))
    assert told(sinks.index_problems_in_blocks(rows, rows)) == []


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(8)
    texts = {i: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))) for i in range(300)}
    texts |= {1000: "ab", 1001: "a", 1002: "", 1003: None, 70_000: "zebra crossing", 140_000: "a zebra"}
    df = spark.createDataFrame([*texts.items()], "id long, t string")
    return Postings(spark, fresh_path(spark, "postings")).build(df), texts


def test_postings_find_what_a_scan_finds(spark, searched):
    held, texts = searched
    for words in ("zebra", "abéa", "ab ba", "a", "é", "ab", "b ", "zebra crossing", "crossings", "qqq", "z", "bra", "", "x" * 50):
        got = [r["id"] for r in held.search(words).collect()]
        assert sorted(got) == sorted(i for i, t in texts.items() if t is not None and words in t), words


def test_postings_test_few_texts(spark, searched):
    held, texts = searched
    for words, most in (("zebra", 2), ("zebra c", 1), ("qqq", 0), ("aébéabé", 100)):
        assert held.candidates(words).count() <= most
    assert {r["block"] for r in held.candidates("zebra").collect()} == {1, 2}
    assert held.read("counts").count() == held.read("postings").select("gram").distinct().count()


def test_postings_are_made_by_pieces(spark, monkeypatch):
    """Lists of grams over many texts, as trigrams taken one by one give them; also where an alphabet is too large for one number."""
    rng = random.Random(9)
    texts = {i: "".join(rng.choices("ab é\U0001f600\0", k=rng.randint(0, 40))) for i in range(-50, 400)} | {902: "x", 903: ""}
    held = Postings(spark, fresh_path(spark, "postings"), 64).build(spark.createDataFrame([*texts.items()], "id long, t string"))
    made = {(r["gram"], r["block"]): r["ids"] for r in held.read("postings").collect()}
    want = {}
    for i, t in texts.items():
        for k in range(len(t)):
            want.setdefault(((t + "\0\0")[k : k + 3], i // 64), set()).add(i)
    columns = ([*texts], [i // 64 for i in texts], [*texts.values()])
    calls, once = [], postings.postings_of
    monkeypatch.setattr(postings, "LARGEST", 1 << 14)
    monkeypatch.setattr(postings, "postings_of", lambda *a: calls.append(len(a[0])) or once(*a))
    got = {}
    for batch in postings.postings_of(*columns):
        for r in batch.to_pylist():
            assert r["ids"] == sorted({*r["ids"]})
            got.setdefault((r["gram"], r["block"]), set()).update(r["ids"])
    assert got == want and len(calls) > 1
    assert made == {k: sorted(v) for k, v in want.items()}


def test_short_searches_read_no_text(spark, searched):
    held, texts = searched
    for words in ("a", "é", "ab", "bra"):
        assert not any("/texts/" in f for f in held.search(words).inputFiles())


def test_bitmaps_count_every_selection(spark):
    rng = random.Random(6)
    rows = [(i * 20_011, rng.choice("xyz"), rng.choice("pq"), rng.choice(["k", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    inside = {r[0] for r in rows if r[0] % 3}
    for within, kept in ((None, rows), (df.where("id % 3 <> 0"), [r for r in rows if r[0] in inside])):
        got = facets.all_counts(df, "id", ["a", "b", "c"], within).collect()
        values = {"a": "xyz", "b": "pq", "c": "k"}
        want = {}
        for at, f in enumerate("abc"):
            others = [x for x in "abc" if x != f]
            for v in values[f]:
                for chosen in itertools.product(*[[*values[o], "all"] for o in others]):
                    picked = dict(zip(others, chosen))
                    hit = lambda r: r[1 + at] == v and all(c == "all" or r[1 + "abc".index(o)] == c for o, c in picked.items())  # noqa: B023, E731
                    want[f, v, *(picked.get(x) for x in "abc")] = sum(map(hit, kept))
        assert {(r["facet"], r["value"], r["a"], r["b"], r["c"]): r["n"] for r in got} == want
    assert facets.all_counts(df.where("id < 0"), "id", ["a", "b"]).count() == 0


def test_automaton_finds_what_joins_find(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick"), (3, ""), (4, None), (5, "é quick é brown"), (6, "own fox\nquick brown")], "doc_id long, t string")
    aliases = spark.createDataFrame([("a", "quick brown"), ("b", "quick"), ("c", "quick"), ("d", ""), ("e", None), ("f", "é"), ("g", "nothing"), ("h", "own fox")], "item_id string, a string")
    want = sorted(map(tuple, search.containing(docs, aliases).collect()))
    assert sorted(map(tuple, search.matching(docs, aliases).collect())) == want and len(want) > 12
    assert sorted(map(tuple, search.matching(docs, aliases, most_chars=10).collect())) == want
    assert search.matching(docs, aliases.where("a is null")).count() == 0 == search.matching(docs.where("doc_id < 0"), aliases).count()


def test_places_since_a_flag_cross_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, f boolean")
    for block in (1, 30, 1000):
        want, seen = {}, {}
        for k, at, f in rows:
            n, last = seen.get(k, (0, None))
            want[at] = (n + 1, last)
            seen[k] = (n + 1, n + 1 if f else last)
        got = state.numbered_since(df, "k", "at", F.col("f"), block).collect()
        assert {r["at"]: (r["place"], r["last"]) for r in got} == want


def test_rules_in_one_pass(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id long, x long")
    got = validate.rules(df, "id", ("low", F.col("x") < 0, F.col("x")), ("odd", F.col("x") % 2 != 0, F.lit("odd")))
    assert sorted(map(tuple, got.collect())) == [("low", "3", "-1"), ("odd", "1", "odd"), ("odd", "3", "odd")]


def test_catalogue_parts_join_to_the_small_form(spark, tmp_path):
    rows = [(f"26{i:02d}.00001", [f"x{j}" for j in range(i % 4)], f'text "é" \\ {i}') for i in range(40)]
    df = spark.createDataFrame(rows, "id string, cited_by array<string>, text string")
    for name, some in (("all", df), ("none", df.where("1 = 0")), ("one", df.where("id = '2600.00001'"))):
        path = str(tmp_path / name)
        manifest = sinks.catalogue_parts(some, path, 5)
        joined = b"".join((tmp_path / name / p["name"]).read_bytes() for p in manifest["parts"])
        kept = {r["id"]: {"citedBy": r["cited_by"], "incomingCitationCount": len(r["cited_by"]), "searchText": r["text"]} for r in some.orderBy("id").collect()}
        body = {"schemaVersion": 2, "catalogDigest": manifest["catalogDigest"], "paperCount": len(kept), "edgeCount": sum(len(p["citedBy"]) for p in kept.values()), "papers": kept}
        assert joined.decode() == json.dumps(body, indent=2, ensure_ascii=False) + "\n"
        assert all(hashlib.sha256((tmp_path / name / p["name"]).read_bytes()).hexdigest() == p["sha256"] for p in manifest["parts"])
        assert sinks.catalogue_is(some.repartition(3), manifest) and (name == "all") == (len(manifest["parts"]) > 4)
    assert not sinks.catalogue_is(df.withColumn("text", F.concat("text", F.lit("!"))), sinks.catalogue_parts(df, str(tmp_path / "again")))


def test_response_cache_rounds(spark):
    held = ResponseCache(spark, fresh_path(spark, "responses"), 8, fresh_seconds=60, most_bytes=20)
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    kind = "url string, status int, at timestamp, etag string, last_modified string, mime string, body string"
    url = lambda n: f"https://arxiv.org/{n}"
    rows = [
        (url("a"), 200, at(0), "e1", None, "text/html", "A"), (url("a"), 200, at(5), "e2", None, "text/html", "AA"), (url("b"), 200, at(0), None, None, "application/pdf", "B"),
        (url("c"), 200, at(0), None, None, "text/html", "C" * 21), (url("d"), 304, at(0), None, None, None, None), ("https://x.example/", 200, at(0), None, None, "text/html", "X"), (url("e"), 200, at(0), None, "lm", "text/html", "E"),
        (url("f"), 500, at(0), None, None, None, None), (url("g"), 200, at(0), None, None, "text/html", None),
    ]
    answers = spark.createDataFrame(rows, kind)
    assert {r["url"][-1] if "arxiv" in r["url"] else "x": r["outcome"] for r in held.judge(answers).collect()} == {
        "a": "stored", "b": "rejected", "c": "rejected", "d": "nothing to confirm", "x": "rejected", "e": "stored", "f": "status 500", "g": "no body",
    }
    held.absorb(answers)
    asked = spark.createDataFrame([(url(n),) for n in "aabe"] + [("https://x.example/",)], "url string")
    plan = lambda s: {r["url"][-1]: (r["action"], r["etag"], r["last_modified"], r["body"]) for r in held.plan(asked, F.lit(f"2026-01-01 00:0{s}").cast("timestamp")).collect()}
    assert plan("0:30") == {"a": ("use", None, None, "AA"), "b": ("fetch", None, None, None), "e": ("use", None, None, "E"), "/": ("reject", None, None, None)}
    assert plan("5:00")["a"] == ("revalidate", "e2", None, None) and plan("5:00")["e"] == ("revalidate", None, "lm", None)
    met = held.absorb(spark.createDataFrame([(url("a"), 304, datetime(2026, 1, 1, 0, 5), None, None, None, None)], kind))
    assert len(met) == 1 and plan("5:10")["a"] == ("use", None, None, "AA")
    held.sweep([url("a")])
    assert {r["url"] for r in held.table.read().collect()} == {url("a")}
