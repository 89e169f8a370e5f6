"""Groups of texts that share a template and stay near the similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import near_dups

from .test_llm import classes_by_force


def template_texts(n: int, own: int, seed: int, words: int = 400) -> list[tuple[int, str]]:
    """Texts of one template, each with ``own`` words of its own at random places."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = [f"t{k}" for k in range(words)]
        for k in rng.sample(range(words), own):
            text[k] = f"x{i}.{k}"
        rows.append((i, " ".join(text)))
    return rows


def sketched(spark, rows):
    """(node, comp, size, tokens, odd, wide, keys), every text a class of its own and all in one bucket."""
    out = []
    for i, text in rows:
        found = near_dups.tokens(near_dups.shingles(text)[1])
        sketches = (near_dups.odd_sketch(found, bits).tolist() for bits in (near_dups.CARRIED, None))
        out.append((i, i, len(found), found.view(np.int64).tolist(), *sketches, [1]))
    schema = "node long, comp long, size long, tokens array<long>, odd array<long>, wide array<long>, keys array<long>"
    return spark.createDataFrame(out, schema).repartition(8)


def near(rows, least=0.8):
    parts = {i: {*near_dups.tokens(near_dups.shingles(t)[1]).tolist()} for i, t in rows}
    return {(a, b) for a in parts for b in parts if a < b and len(parts[a] & parts[b]) >= least * len(parts[a] | parts[b])}


def test_sketches_differ_in_no_more_bits_than_tokens(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for _ in range(300):
        m = int(rng.integers(0, 1500))
        small = rng.integers(0, 2**63, m).astype(np.uint64)
        shared = small[: int(m * rng.choice([1, 0.95, 0.8]))]
        large = np.concatenate([shared, rng.integers(0, 2**63, m - len(shared) + int(m * 0.2 * rng.random())).astype(np.uint64)])
        want.append(len(np.setxor1d(small, large)))
        rows.append([near_dups.odd_sketch(x, b).tolist() for b in (near_dups.CARRIED, None) for x in (small, large)])
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, a array<long>, b array<long>, c array<long>, d array<long>")
    got = df.select("k", near_dups.unlike_carried("a", "b").alias("x"), near_dups.unlike("c", "d").alias("y")).collect()
    assert len(got) == 300
    for r in got:
        assert r["x"] <= want[r["k"]] and r["y"] <= want[r["k"]] and (r["x"] - want[r["k"]]) % 2 == 0
        assert r["y"] >= 0.7 * want[r["k"]] - 20  # the sketch by size stays telling


def test_sketches_of_far_sizes_say_nothing(spark):
    df = spark.createDataFrame([([1], [0] * 8)], "a array<long>, b array<long>")
    assert df.select(near_dups.unlike("a", "b")).first()[0] == 0


@pytest.mark.parametrize("own", [6, 7, 9, 11])  # pairs at about 0.76, 0.72, 0.65, 0.60
def test_pairs_below_the_similarity_are_not_kept(spark, own):
    counts = []
    for n in (150, 300):
        rows = template_texts(n, own, seed=own)
        df = sketched(spark, rows)
        met = near_dups.prefix_pairs(df.select("node", "comp", "size", "tokens", "odd"), 0.8)
        pairs = {(r["a"], r["b"]) for r in near_dups.close_pairs(met, df, 0.8).collect()}
        want = near(rows)
        assert want <= pairs
        counts.append(len(pairs - want))
    assert counts[1] <= 0.05 * 300 * 299 / 2 and (own < 9 or counts[1] == 0)


def test_hot_tokens_are_dealt_over_keys(spark, monkeypatch):
    """The same pairs where every token has many keys."""
    rows = template_texts(80, 6, seed=3)
    df = sketched(spark, rows).select("node", "comp", "size", "tokens", "odd")
    want = {tuple(r) for r in near_dups.prefix_pairs(df, 0.8).collect()}
    monkeypatch.setattr(near_dups, "HOT", 7)
    got = [tuple(r) for r in near_dups.prefix_pairs(df, 0.8).collect()]
    assert want == {*got} and len(got) == len({*got}) and near(rows) <= want


def test_classes_of_a_template_group(spark):
    """Pairs on both sides of the similarity, by brute force."""
    rows = template_texts(60, 6, seed=1) + [(100 + i, t) for i, t in template_texts(60, 4, seed=2)]
    rows += [(200 + i, t) for i, t in template_texts(60, 9, seed=5)] + [(300, None), (301, "")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_by_force(rows)
    assert 20 < len({r["class_id"] for r in got}) < 100


def test_long_and_empty_texts_have_sketches(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, " ".join(f"w{i}" for i in range(30_000)))]
    got = near_dups.bags(spark.createDataFrame(rows, "doc_id long, text string")).select(F.size("tokens").alias("n"), F.size("odd").alias("o"), F.size("wide").alias("w")).collect()
    assert sorted(map(tuple, got)) == [(0, 16, 1), (0, 16, 1), (1, 16, 1), (29_996, 16, 4096)]
