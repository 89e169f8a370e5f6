"""Spelling variants, centroid clustering and sharding against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import centroids, queries, sharding, spelling
from folioscope.session import fresh_path, table

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, id long, shard string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None if i and i % 3 else "en", None, None, "w", 1, 5, "s") for i, t in texts], DOCS)


# 11


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_force(texts):
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    mates = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in mates.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(mates[w]), n[form[w]] if form[w] else None) for w in n}


def variants_of(df):
    rows = spelling.variants(df).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_equals_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 7))) for _ in range(60)]

    def said():
        w = list(rng.choice(base[: rng.choice((5, 20, 60))]))
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [rng.choice("abcdé")], [w[at], rng.choice("abcdé")]))
        return "".join(w).upper() if rng.random() < 0.05 else "".join(w)

    texts = [(i, " ".join(said() for _ in range(60))) for i in range(80)]
    texts += [(3, "aabca abcaa caaab aabca abcaa caaab ÀÉÎÕÜ×÷ÿ àéîõü×÷ÿ"), (None, "kitten sitten sitting " * 9), (5, None), (6, ""), (7, "x" * 70 + "\ny")] * 3
    texts.append((900, "chaina " * 3 + "chainab " * 8 + "chainabc " * 20 + "chainabcd " * 41))
    want = variants_by_force(texts)
    assert sum(v[0] is not None for v in want.values()) > 20 and want["chaina"][:2] == ("chainab", "chainabcd")
    assert variants_of(docs_of(spark, texts)) == want


def test_spelling_of_anagrams_runs_and_long_words(spark):
    # a large group of anagrams, all exchanges at one place, runs of one letter
    words = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 300)]
    words += [f"same{chr(c)}word" for c in range(ord("a"), ord("z") + 1)] + ["a" * k for k in range(5, 12)]
    texts = [(i, " ".join(words)) for i in range(4)]
    assert variants_of(docs_of(spark, texts)) == variants_by_force(texts)
    long = "lo" * 200_000
    texts = [(i, f"{long} {long}x {'ol' * 200_000}") for i in range(3)]
    got = variants_of(docs_of(spark, texts))
    assert {w: v[3] for w, v in got.items()} == {long: 1, long + "x": 1, "ol" * 200_000: 0}
    assert variants_of(docs_of(spark, [])) == {} == variants_of(docs_of(spark, [(1, None)]))


def test_anagram_keys(spark):
    number, residual, place, order, first = spelling.anagram_rows(["listen", "silent", "llama"])
    whole = place == -1
    assert residual[whole][0] == residual[whole][1] != residual[whole][2] and len({*order[whole].tolist()}) == 3
    cut = (number == 2) & ~whole
    assert order[cut][0] == order[cut][1] and first[cut].tolist() == [True, False, True, True, True]


# 12


def clusters_by_force(rows, k=40, rounds=5):
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            groups[j].append(v)
        for j, vs in groups.items():
            centres[j] = tuple(sum(x) // len(vs) for x in zip(*vs))
    found = assign()
    inertia = collections.Counter()
    for d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def clusters_of(df, **options):
    rows, named = centroids.cluster(df, **options)
    joined = rows.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(map(tuple, joined.collect()), key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, digest string, n long")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = np.float32(rng.normal(size=(12, 64)))
    rows = [(i, np.float32(base[i % 12] + rng.normal(size=64) * 0.3).tolist()) for i in range(120)]
    rows += [(1000 + i, base[0].tolist()) for i in range(60)] + [(5, base[3].tolist()), (5, base[3].tolist()), (None, base[4].tolist()), (None, base[5].tolist())]
    nan, inf = float("nan"), float("inf")
    bad = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [nan] + [0.0] * 63), (2005, [inf] + [0.0] * 63), (2006, [None] + [0.0] * 63)]
    return rows + bad + [(3000, [1000.0] * 64), (3001, [-1e5] * 64)]


def test_clusters_equal_brute_force(spark, vectors):
    assert clusters_of(vectors_of(spark, vectors)) == clusters_by_force(vectors)


def test_clusters_of_few_rows_and_of_many_copies(spark, vectors):
    few = vectors[:7]
    assert clusters_of(vectors_of(spark, few)) == clusters_by_force(few)
    copies = [(i, [0.5] * 64) for i in range(200)] + [(300, [0.25] * 64)]
    assert clusters_of(vectors_of(spark, copies)) == clusters_by_force(copies)
    assert clusters_of(vectors_of(spark, copies), k=3, rounds=0) == clusters_by_force(copies, 3, 0)
    assert clusters_of(vectors_of(spark, [])) == [] == clusters_of(vectors_of(spark, [(1, None)]))
    huge = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    assert {i: d for i, _, d, *_ in clusters_of(vectors_of(spark, huge), k=2, rounds=1)}.keys() == {1, 2, 3}


# 13


def test_hilbert_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        n = 1 << bits
        points = spark.createDataFrame([*itertools.product(range(n), repeat=dims)], ", ".join(f"c{i} int" for i in range(dims)))
        rows = points.withColumn("h", sharding.hilbert([F.col(f"c{i}") for i in range(dims)], bits)).collect()
        at = {r["h"]: r[:dims] for r in rows}
        assert sorted(at) == [*range(n**dims)]
        assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1])) == 1 for k in range(n**dims - 1))


def placed_of(df, **options):
    rows = df.select(*df.columns, F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return sharding.shard(rows, ["lang", "source", "size"], ["doc_id", "text"], **options)


def law_holds(rows, shards, total):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == total == len(rows) and max(sizes) - min(sizes) <= 1 and {*slots} <= {*range(shards)}
    assert all(sorted(v) == [*range(len(v))] for v in slots.values())


def test_shards_have_equal_counts_and_gapless_slots(spark):
    texts = [(i % 40, "same text" if i % 3 else "t" * (i % 50)) for i in range(200)] + [(None, None), (None, ""), (1, "x" * 1_000_000)] * 5
    df = docs_of(spark, texts)
    for shards in (1, 7, 16):
        got = placed_of(df, shards=shards)
        assert got.columns == [*[c for c in df.columns if c != "shard"], "size", "curve", "shard", "slot"]
        law_holds(got.select("shard", "slot").collect(), shards, len(texts))
    law_holds(placed_of(docs_of(spark, texts[:5])).collect(), 16, 5)
    assert placed_of(docs_of(spark, [])).count() == 0


def test_shards_are_boxes_that_readers_skip(spark):
    df = table(spark, SF, "documents").unionByName(table(spark, "/root/testdata/sf0.01", "documents"))
    path = fresh_path(spark, "shards")
    placed = placed_of(df)
    sharding.write_shards(placed, path, ["lang", "source", "size"])
    written = spark.read.parquet(path)
    assert written.count() == df.count() and written.select("text").exceptAll(df.select("text")).isEmpty()
    ranges = spark.read.parquet(f"{path}/_ranges").collect()
    lang, met = sorted({r["low_lang"] for r in ranges})[0], []
    for within in ({"lang": (lang, lang)}, {"size": (0, 60)}, {"size": (2000, 2600), "lang": (lang, lang)}):
        got = sharding.read_shards(spark, path, within)
        want = df.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
        for c, (low, high) in within.items():
            want = want.where(F.col(c).between(low, high))
        assert got.count() == want.count() > 0
        used = [r for r in ranges if all(r[f"low_{c}"] <= high and r[f"high_{c}"] >= low for c, (low, high) in within.items())]
        met.append(len(used))
    assert max(met) < 16 and sum(met) <= 30  # in id order every shard holds every language and size


def test_a_hot_value_takes_one_cell(spark):
    df = spark.createDataFrame([("b" if i % 3 else f"a{i}",) for i in range(300)] + [(None,)], "v string")
    bounds = sharding.cell_bounds(df, "v", 8)
    assert bounds[0][0] is None and [c for _, c in bounds] == sorted({c for _, c in bounds})
    cells = dict(df.distinct().select("v", sharding.cell_of(F.col("v"), bounds)).collect())
    assert cells[None] == 0 and cells["b"] == 2 and {*cells.values()} == {0, 1, 2}
    assert sharding.cell_of(F.lit("x"), []) is not None


def test_new_queries_return_their_contract(spark):
    want = {
        "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
        "op12_centroid_clustering": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        "op13_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    }
    kinds = {"size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "cluster": "int", "distance": "bigint", "n": "bigint", "n_near": "bigint", "form_n": "bigint", "inertia": "bigint"}
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns == cols and all(kinds.get(c, k) == k for c, k in df.dtypes)
