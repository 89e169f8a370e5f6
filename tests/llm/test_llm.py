"""Every operator against its library or a brute-force version, and its edge cases."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import (
    bpe,
    chat_format,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    near_dups,
    quality_classifier,
    quality_rules,
    queries,
    token_counts,
)
from folioscope.session import fresh_path, materialize, table

from ..conftest import SF

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"

TEXTS = [
    None, "", " ", "\n\n", "a", "the  the\tthe", "Ünïcode — ﬁ ΑΣ İ 日本語", "\\### x </turn>", "<|endoftext|> <s>", "x" * 5000,
    "one two three four five six. " * 40, "one two three four five six. " * 40, "\x00 \x1c \x85   end ", "MIT License and Apache license, GNU General Public License",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, 0.5, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[10], rows[1]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


# 1


def test_token_counts(spark, odd, none, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = fresh_path(spark, "cache")
    for df in (docs, odd):
        got = token_counts.count_tokens(df, PIECES, cache).collect()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        assert len(got) == df.count()
        assert all((r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), len(sp.encode(texts[r["doc_id"]]))) for r in got)
    before = spark.read.parquet(cache).count()
    token_counts.count_tokens(docs, PIECES, cache).count()
    assert spark.read.parquet(cache).count() == before  # all hits
    assert before == docs.select(F.coalesce("text", F.lit(""))).union(odd.select(F.coalesce("text", F.lit("")))).distinct().count()
    assert token_counts.count_tokens(none, PIECES, fresh_path(spark, "cache")).count() == 0


def test_models_that_change_texts_are_encoded_whole(monkeypatch):
    counter = token_counts.PieceCounter(PIECES)
    assert counter.separable

    class Folding:
        normalize = staticmethod(lambda t: t.replace("ﬁ", "fi"))

    counter.model = Folding()
    assert not counter._keeps_texts()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é▁\n\t  日x<s>"), max_size=30), max_size=4))
def test_piece_counter(texts):
    counter = token_counts._counter(PIECES)
    assert counter.counts(texts) == [len(counter.model.encode(t)) for t in texts]


# 2


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, odd, none, docs):
    t = library()
    for df in (docs, odd):
        texts = collections.defaultdict(set)
        for r in df.collect():
            texts[r["doc_id"]].add(r["text"] or "")
        rows = bpe.encode_decode(df, WORDS).collect()
        assert len(rows) == df.count()
        for r in rows:
            (said,) = texts[r["doc_id"]]
            ids = t.encode(said, add_special_tokens=False).ids
            assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
            assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none, WORDS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcXYZ019'é ßΣςİ\n\t\x1c\x85–▁<|>日🙂½", "<|endoftext|>", "'s ", "the "]), max_size=40).map("".join))
def test_bpe_texts(text):
    e = bpe.encoder(WORDS)
    assert e.encode(text).tolist() == library_once().encode(text, add_special_tokens=False).ids


_LIB = []


def library_once():
    if not _LIB:
        _LIB.append(library())
    return _LIB[0]


def test_transducer_streams():
    """Long words come out in settled pieces, equal to merging the whole; the window stays bounded."""
    e, rng = bpe.encoder(WORDS), random.Random(3)
    for _ in range(20):
        word = "".join(rng.choice(["ation", "the", "ing", "e", "t", "a", "日"]) for _ in range(900))
        machine, out, widest = bpe.Transducer(e.table, e.sizes, block=16), [], 0
        raw = word.encode()
        for b in [*(e.inner[x] for x in raw[:-1]), e.last[raw[-1]]]:
            out += machine.push([b])
            widest = max(widest, len(machine.window))
        out += machine.flush()
        assert out == library_once().encode(word, add_special_tokens=False).ids
        assert widest <= machine.full


def test_lookahead_of_random_merge_lists():
    """Tokens that come out early are those of the whole word, for every continuation tried; the window is a symbol at a time."""
    rng = random.Random(12)
    early = 0
    for _ in range(150):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(rng.randint(1, 9)):
            a, b = rng.choice([*vocab]), rng.choice([*vocab])
            if (a, b) not in merges and len(a + b) < 9:
                merges.append((a, b))
                vocab.setdefault(a + b, len(vocab))
        t = bpe.MergeTable(vocab, merges, "")
        sizes = {i: len(s) for s, i in vocab.items()}
        for _ in range(20):
            word = [vocab[rng.choice("abc")] for _ in range(rng.randint(1, 30))]
            machine, out = bpe.Transducer(t, sizes, block=1), []
            for x in word:
                out += machine.push([x])
            early += len(out)
            assert out + machine.flush() == t.merge(word[:])
    assert early > 1000


@pytest.mark.parametrize("block", [48, 4096])
def test_bpe_long_words(monkeypatch, block):
    """Words longer than a block, with special tokens, contractions, composing characters and class changes at its ends."""
    monkeypatch.setattr(bpe, "BLOCK", block)
    e, rng = bpe.encoder(WORDS), random.Random(block)
    pools = [
        ["a", "b", "ing", "the", "e"], ["!", "'", "s", "--"], ["é", "e", "\u0301", "\u0327", "q", "ᄀ", "ᅡ", "ᆨ", "가", "İ", "Σ"],
        ["<|endoftext|>", "<|endof", "text|>", "<|startoftext|>", "x", "<", "|"], ["7", "½", "x", "日", "🙂", "'re", "'ll", " "],
    ]
    for k in range(60):
        text = "".join(rng.choices(pools[k % 5], k=rng.randint(block, 5 * block)))
        assert e.encode(text).tolist() == library_once().encode(text, add_special_tokens=False).ids
    text = "".join(rng.choices(["word ", "é", "\n"], k=9 * block)) + "z" * 3 * block
    assert e.encode(text).tolist() == library_once().encode(text, add_special_tokens=False).ids


def test_bpe_character_classes():
    """Code points of every block, those that only one side's tables know among them."""
    e = bpe.encoder(WORDS)
    for at in [*range(0x80, 0x3400, 7), *range(0xA000, 0xD800, 41), *range(0xE000, 0x20000, 13), *range(0x105C0, 0x10600), *range(0x20000, 0x110000, 4001)]:
        text = f"x{chr(at)}y1{chr(at)}e\u0301"
        assert e.encode(text).tolist() == library_once().encode(text, add_special_tokens=False).ids, hex(at)


def test_bpe_memory_is_bounded():
    """Words, then one long word, through encoder and decoder, block by block: four times the text takes no more memory."""
    import tracemalloc

    e = bpe.Encoder(WORDS, max_entries=2000)
    back = bpe.Decoder(e.names, e.suffix)
    rng = random.Random(6)
    words = "".join(rng.choices(["plain words ", "naïve ", "x's ", "日本 ", "\n", "abcdefghij" * 20], k=4000))
    for piece, times in ((words, 4), ("thequickbrownfox" * 64, 100)):
        peaks = []
        for n in (times, 4 * times):
            tracemalloc.start()
            for settled in e.stream(piece for _ in range(n)):
                back.feed(memoryview(settled).cast("i"))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 1.2 * peaks[0] < 12_000_000


def test_decoder_round_trip(docs):
    """The byte machine gives back the pre-tokens of whole documents, whatever the size of its blocks."""
    e = bpe.encoder(WORDS)
    for r in docs.where("text is not null").limit(80).collect():
        ids = e.encode(r["text"]).tolist()
        d = bpe.Decoder(e.names, e.suffix, style="text")
        told = "".join(d.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + d.finish()
        plain = e._plain(r["text"])
        want = [m for part in e.blank.split(plain) for m in e.pattern.findall(part)]
        if "<|" not in r["text"]:
            assert told == "".join(w + " " for w in want)


def test_decoder_machine():
    e = bpe.encoder(WORDS)
    text = "naïve café 日本 🙂 the end"
    ids = e.encode(text).tolist()
    d = bpe.Decoder(e.names, e.suffix, style="text")
    assert ("".join(d.feed([i]) for i in ids) + d.finish()).split() == text.split()


# 3


def rules(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_rules(spark, odd, none, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        got = quality_rules.judge(df).collect()
        assert len(got) == df.count()
        for r in got:
            assert tuple(r[n] for n in names) == rules(texts[r["doc_id"]]), r["doc_id"]
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(none).count() == 0


def test_distances(spark, docs):
    """Both distances against a plain computation."""
    feats = quality_rules.features(docs).cache()
    refs = quality_rules.references(feats)

    def jsd(p, q):
        half = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
        return np.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    for ref in refs:
        c, w = quality_rules.distances(ref)
        for r in feats.where("n_words > 0").select("*", c.alias("c"), w.alias("w")).limit(60).collect():
            p = np.array(r["classes"]) / sum(r["classes"])
            assert r["c"] == pytest.approx(jsd(p, ref["classes"]), abs=1e-9)
            seen = {x["word"]: x["n"] / r["n_words"] for x in r["common"]}
            a = [seen.get(k, 0.0) for k in ref["words"]]
            b = [*ref["words"].values()]
            assert r["w"] == pytest.approx(jsd([*a, 1 - sum(a)], [*b, 1 - sum(b)]), abs=1e-9)


def test_quality_rules_verdicts(spark, docs):
    labels = table(spark, SF, "labels")
    rows = quality_rules.judge(docs).where("not base_failed").join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad or [0]) < 0.6


# 4


def classes_by_force(rows, least=0.8):
    parts = {i: near_dups.shingles(t) for i, t in rows}
    up = {i: i for i in parts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(parts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            same = parts[a][0] == parts[b][0] or near_dups.overlap(parts[a][1], parts[b][1]) >= least
            if same and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_near_dups(spark, odd, none, docs):
    for df in (docs, odd.dropDuplicates(["doc_id"])):
        want = classes_by_force([(r["doc_id"], r["text"]) for r in df.collect()])
        assert {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()} == want
    assert near_dups.near_duplicates(odd).count() == odd.count()
    assert near_dups.near_duplicates(none).count() == 0


def test_near_dups_group(spark):
    """A chain of edits whose ends are unlike: only links through other members join it."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(120):
        if i % 3 == 2:
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"y{rng.randrange(900)}" for _ in range(150))) for i in range(20)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_by_force(rows)


def test_near_dups_null_id(spark):
    """A row without an id takes no row with one away."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (5, long), (3, long), (4, long + " end"), (None, "only here"), (9, "some other words")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 3, 3, 1), (5, 3, 3, 1), (3, 3, 3, 1), (4, 4, 3, 1), (None, None, None, 0), (9, 9, 9, 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_dups_shared_id(spark):
    """Rows of one doc_id keep their number; each gets the class of its own words."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    rows = [(7, one), (7, two), (7, two), (3, two + " end"), (8, one + " end"), (9, "x"), (7, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(7, 7, 7, 1), (7, 7, 3, 1), (7, 7, 3, 1), (3, 3, 3, 1), (8, 8, 7, 1), (9, 9, 9, 0), (7, 7, 7, 0)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_dups_hot_group(spark):
    """Copies with edits of their own: similarities on both sides of the limit, some linked only to each other; the
    text they stem from isn't there."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = base[:]
        for k in range(rng.choice([1, 2, 2, 3, 3, 5])):
            at = rng.randrange(len(words))
            words[at : at + 1] = [f"x{i}.{k}"] if rng.random() < 0.6 else [f"y{i}.{k}", f"z{i}"]
        rows.append((1000 - i, " ".join(words)))
        if i % 4 == 0:
            rows.append((3000 - i, " ".join([*words, "more"])))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes_by_force(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want and 20 < len({*want.values()}) < 150


def test_near_dups_recall(spark):
    """Every pair of texts of sf0.01, by brute force."""
    rows = table(spark, SF.replace("0.001", "0.01"), "documents").collect()
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(table(spark, SF.replace("0.001", "0.01"), "documents")).collect()}
    parts = {r["doc_id"]: near_dups.tokens(near_dups.shingles(r["text"])[1]) for r in rows}
    holders = collections.defaultdict(list)
    for i, t in parts.items():
        for x in t.tolist():
            holders[x].append(i)
    pairs = found = 0
    for i in parts:
        seen = collections.Counter(j for x in parts[i].tolist() for j in holders[x] if j != i)
        for j, both in seen.items():
            if i < j and both / (len(parts[i]) + len(parts[j]) - both) >= 0.8:
                pairs, found = pairs + 1, found + (got[i] == got[j])
    assert pairs > 40 and found == pairs


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_prefix_pairs_lose_none(spark, least):
    """All pairs of different classes that reach the similarity, of texts of many sizes."""
    rng = random.Random(int(least * 100))
    base = rng.sample(range(10**6), 90)
    rows = []
    for i in range(140):
        t = rng.sample(base, rng.randint(35, 90)) if i % 2 else base[: rng.randint(60, 90)] + rng.sample(range(10**7), rng.randint(0, 25))
        rows.append((i, i // 3, len({*t}), sorted({*t})))
    got = near_dups.prefix_pairs(spark.createDataFrame(rows, "node long, comp long, size long, tokens array<long>"), least).collect()
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and jaccard(a[3], b[3]) >= least}
    assert want and want <= {tuple(r) for r in got} and len(got) == len({*got})


def test_tokens_count_copies():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 12, n).astype(np.uint64) for n in (40, 55))
    x, y = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    assert len({*near_dups.tokens(a).tolist()}) == 40
    assert near_dups.overlap(a, b) == (x & y).total() / (x | y).total()


def test_word_hashes_do_not_depend_on_their_place():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdé", k=rng.choice([1, 3, 9, 40]))) for _ in range(30_000)] + ["x" * 1024, "x" * 1025, "y" * 200_000, "z" * 70_000]
    rng.shuffle(words)
    got = near_dups.word_hashes("\n".join(words).encode())
    by = {w: near_dups.word_hashes(w.encode())[0] for w in {*words}}
    assert [by[w] for w in words] == got.tolist() and len({*by.values()}) == len(by)


def test_bag_min_hash():
    """The share of equal components estimates weighted Jaccard without bias."""
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    for _ in range(6):
        a = np.repeat(keys, rng.integers(0, 9, 60))
        b = np.repeat(keys, rng.integers(0, 9, 60))
        same = np.mean(near_dups.bag_min_hash(a, 4000) == near_dups.bag_min_hash(b, 4000))
        assert same == pytest.approx(near_dups.overlap(a, b), abs=0.04)
    for heavy in (40, 3000):  # intervals that are split many times
        a, b = (np.repeat(keys[:20], rng.integers(0, heavy, 20)) for _ in range(2))
        x, y = near_dups.bag_min_hash(a, 4000), near_dups.bag_min_hash(b, 4000)
        assert np.mean(x == y) == pytest.approx(near_dups.overlap(a, b), abs=0.04)
        assert (near_dups.bag_min_hash(np.concatenate([a, b]), 4000) <= np.minimum(x, y)).all()


# 5


def test_bag_min_hash_is_a_minimum_over_its_shingles():
    """The signature of a union is the componentwise minimum, so times don't depend on the other shingles."""
    rng = np.random.default_rng(5)
    for n in (2, 30, 90, 270):
        one, two = (np.repeat(rng.integers(1, 2**63, n).astype(np.uint64), 1 + k % 3) for k in (1, 2))
        both = near_dups.bag_min_hash(np.concatenate([one, two]), 180)
        apart = np.minimum(near_dups.bag_min_hash(one, 180), near_dups.bag_min_hash(two, 180))
        assert (both == apart).all()


def test_quality_classifier(spark, odd, none, docs):
    labels = table(spark, SF, "labels")
    got = quality_classifier.classify(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    for df in (odd, none):
        rows = quality_classifier.classify(df, labels).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = quality_classifier.classify(docs, labels.where("1 = 0")).select("score").distinct().collect()
    assert [r["score"] for r in blank] == [0.5]


def test_labels_of_held_out_rows_are_not_read(spark, docs):
    labels = table(spark, SF, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    flipped = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.classify(docs, x).select("doc_id", F.round("score", 9).alias("s")) for x in (labels, flipped))
    assert a.exceptAll(b).count() == 0


def test_samples_of_huge_tables(spark):
    """The share of a sample stays right however many rows there are."""
    from folioscope.llm.filters import about

    df = spark.range(200_000)
    for of in (400_000, 4_000_000, 10**15):
        got = df.where(about(of // 400, of, 7, "id")).count()
        assert 350 < got < 650
    assert df.where(about(24_000, 10**11, 7, "id")).count() < 10 and df.where(about(5, 5, 7, "id")).count() == 200_000
    assert about(24_000, 10**13, 7, "id")._jc.toString().split("<")[-1].strip(" )") != str(-(1 << 63))


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, (60, quality_classifier.N_STATS))
    got = quality_classifier.lift(z, features=20_000)[:, :-1]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * quality_classifier.N_STATS))
    assert np.abs(got @ got.T - want).max() < 0.04
    small = quality_classifier.lift(z)[:, :-1]
    assert np.abs(small @ small.T - want).mean() < 1 / np.sqrt(quality_classifier.FEATURES)


def test_classifier_by_force(spark):
    """Standardising, ridge, calibration and scores against one numpy computation over all rows."""
    rng = np.random.default_rng(4)
    n, k = 900, quality_classifier.N_STATS
    x = rng.normal(3, 2, (n, k))
    x[:, 5] = 1.5  # a constant statistic
    y = (x[:, 0] * x[:, 1] + rng.normal(0, 2, n) > 9).astype(float)
    fold = rng.integers(0, 3, n)
    rows = [(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(n)]
    model = quality_classifier.fit(spark.createDataFrame(rows, "doc_id long, stats array<double>, label double, fold int").repartition(5))
    scale = x.std(0)
    scale[5] = 1.0
    z = quality_classifier.lift((x - x.mean(0)) / scale)
    a, m = z[fold == 0], (fold == 0).sum()
    want = np.linalg.lstsq(
        np.vstack([a, np.sqrt(quality_classifier.RIDGE * m / quality_classifier.FEATURES) * np.eye(a.shape[1])]),
        np.concatenate([y[fold == 0], np.zeros(a.shape[1])]), rcond=None,
    )[0]
    assert model.weights == pytest.approx(want, abs=1e-6)
    raw = z @ want
    bins = np.clip(np.rint(raw[fold != 0] * quality_classifier.BINS), -quality_classifier.BINS, 2 * quality_classifier.BINS)
    at = np.unique(bins)
    mean = np.array([y[fold != 0][bins == b].mean() for b in at])
    size = np.array([(bins == b).sum() for b in at])
    upto, total = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(size * mean)])
    means = lambda i, js: (total[js] - total[i]) / (upto[js] - upto[i])  # noqa: E731  of bins i to js - 1
    level = [max(means(i, np.arange(q + 1, len(at) + 1)).min() for i in range(q + 1)) for q in range(len(at))]
    assert model.levels == pytest.approx(np.array(level), abs=1e-9)
    assert model.score(x) == pytest.approx(np.interp(raw, at / quality_classifier.BINS, level), abs=1e-6)


def test_classifier_with_a_shared_id(spark, docs):
    rows = [(7, "one text here"), (7, "Another, longer text is here."), (7, "one text here")]
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, SF, "labels")).collect()
    assert [r["doc_id"] for r in got] == [7, 7, 7]


def test_isotonic():
    got = quality_classifier.isotonic(np.arange(6.0), np.array([0, 1, 0.5, 0.5, 1, 0.9]), np.ones(6))
    assert got == pytest.approx([0, 2 / 3, 2 / 3, 2 / 3, 0.95, 0.95])


# 6


def test_language_id(spark, odd, none, docs):
    fold = language_id.fold(4)
    protos = language_id.fit(docs.where(fold != 2))
    named = docs.where(fold == 2).select("doc_id", "text", F.col("lang").alias("want"))
    held = language_id.predict(named, protos).collect()
    assert np.mean([r["want"] == r["lang_pred"] for r in held]) > 0.95
    rows = language_id.predict(odd.withColumn("lang_pred", F.lit(3)), protos).collect()
    assert len(rows) == odd.count() and {*rows[0].asDict()} == {*odd.columns, "lang_pred"}
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert language_id.predict(none.select("doc_id", "text"), protos).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), {}).collect()} == {"und"}


def test_hypervectors():
    """A text's vector is the sum of its bound trigrams."""
    p = language_id.Profiles(256)
    (got,) = p.encode(["ab b"])
    v = lambda c: np.random.default_rng(ord(c)).integers(0, 2, 256, np.int8) * 2 - 1
    gap = np.ones(256, np.int8)
    a, b = v("a"), v("b")
    whole = sum(np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in ((gap, a, b), (a, b, gap), (gap, b, gap))).astype(float)
    assert got == pytest.approx(whole / np.linalg.norm(whole), abs=1e-5)


# 7


def test_fingerprints(spark, odd, none, docs):
    for df in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()))
        got = collections.defaultdict(list)
        for r in fingerprints.compare_with_edits(df).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(rows)
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            want = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            me = fingerprints.Fingerprint.of(t)
            assert any(
                (r["n_chars"], r["edited"], r["fingerprint"]) == (len(t), want, me.hex())
                and r["near_edited"] == me.likeness(fingerprints.Fingerprint.of(want))
                and r["near_next"] == me.likeness(fingerprints.Fingerprint.of(nxt))
                for r in got[i]
            )
    assert fingerprints.compare_with_edits(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=12), st.lists(st.sampled_from("abcdefgh"), max_size=6), st.randoms())
def test_fingerprint_is_homomorphic(parts, more, rng):
    one = fingerprints.Fingerprint()
    one.add(parts + more)
    mixed = parts + more
    rng.shuffle(mixed)
    two = fingerprints.Fingerprint()
    for p in mixed:
        two.add([p])
    assert one.hex() == two.hex()
    two.remove(more)
    three = fingerprints.Fingerprint()
    three.add(parts)
    assert two.hex() == three.hex() and two.likeness(three) == 1.0


@pytest.mark.parametrize("n", [1600, 6000, 24000, 100_000])
def test_likeness_of_long_texts(n):
    near, want = [], []
    for k in range(20 if n < 50_000 else 6):
        text, other = (" ".join(f"{c}{k} {i:06d} {i % 7}." for i in range(n)) for c in "ab")
        edited = fingerprints.edit(text, other)
        a, b = (collections.Counter(fingerprints.paragraphs(t)) for t in (text, edited))
        want.append((a & b).total() / (a | b).total())
        near.append(fingerprints.Fingerprint.of(text).likeness(fingerprints.Fingerprint.of(edited)))
    assert abs(np.mean(near) - np.mean(want)) < 0.15 and abs(np.mean(want) - 1 / 3) < 0.01


@pytest.mark.parametrize(("n", "common"), [(20, 10), (100, 50), (100, 89), (400, 200)])
def test_likeness_isnt_lowered_by_shared_lanes(n, common):
    near = []
    for k in range(150):
        prints = [fingerprints.Fingerprint() for _ in "ab"]
        for name, p in zip("ab", prints):
            p.add([f"{k} {i}" for i in range(common)] + [f"{name}{k} {i}" for i in range(n - common)])
        near.append(prints[0].likeness(prints[1]))
        assert 0 <= near[-1] <= 1 and near[-1] == prints[1].likeness(prints[0])
    assert abs(np.mean(near) - common / (2 * n - common)) < 0.06


# 8


def test_license_base(spark, odd, none, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for df in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in license_scan.report(license_scan.scan(df)).collect():
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in at] or [None]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(starts), max(starts))
            assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
            assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
    assert license_scan.report(license_scan.scan(none)).count() == 0


def test_matching_statistics():
    machine = license_scan.automaton()
    rng = random.Random(2)
    pool = [w for words in machine.words for w in words] + ["zzz"]
    subs = {tuple(w[i:j]) for w in machine.words for i in range(len(w)) for j in range(i + 1, min(i + 24, len(w)) + 1)}
    for _ in range(40):
        words = [rng.choice(pool) for _ in range(20)]
        t = rng.choice(machine.words)
        k = rng.randrange(len(t))
        words[5:5] = t[k : k + 9]
        for i, length, state in machine.statistics(words, 0):
            want = max((n for n in range(i + 2) if n == 0 or tuple(words[i - n + 1 : i + 1]) in subs), default=0)
            assert length == want
            assert all(machine.words[a][b - length + 1 : b + 1] == words[i - length + 1 : i + 1] for a, b in machine.ends[state])
    whole = max(machine.words, key=len)
    assert [length for _, length, _ in machine.statistics(whole, 0)] == [*range(1, len(whole) + 1)]
    body = "lorem ipsum released under the mit license dolor".split()
    assert machine.spans(body) == [("mit", 2, 6, 1.0)]


def spans_by_force(machine, words):
    """Longest template strings by plain search, chained template by template, without the automaton."""
    n = len(words)
    holds = lambda t, part: [i for i in range(len(t) - len(part) + 1) if t[i : i + len(part)] == part]
    longest = []
    for i in range(n):
        k = longest[-1] + 1 if longest else 1
        while k and not any(holds(t, words[i - k + 1 : i + 1]) for t in machine.words):
            k -= 1
        longest.append(k)
    chains = []
    for t, template in enumerate(machine.words):
        chain = None
        for i, k in enumerate(longest):
            if k < license_scan.LEAST_MATCH or (i + 1 < n and longest[i + 1] > k):
                continue
            for at in holds(template, words[i - k + 1 : i + 1]):
                first, stop = i - k + 1, at + k - 1
                if chain and first - chain[1] <= license_scan.GAP:
                    fresh = min(k, i - chain[1], stop - chain[2])
                    if fresh > 0:
                        chain = (chain[0], i, stop, chain[3] + fresh)
                        continue
                    if i <= chain[1]:
                        continue
                if chain:
                    chains.append((chain[3], t, chain[0], chain[1]))
                chain = (first, i, stop, k)
        if chain:
            chains.append((chain[3], t, chain[0], chain[1]))
    enough = [c for c in chains if c[0] >= license_scan.LEAST_COVER * len(machine.words[c[1]])]
    taken, out = set(), []
    for covered, t, first, last in sorted(enough, key=lambda c: (-c[0], len(machine.words[c[1]]), c[1:])):
        own = {*range(first, last + 1)}
        if 2 * len(own & taken) <= len(own):
            taken |= own
            out.append((machine.labels[t], first, last, min(1.0, covered / len(machine.words[t]))))
    return sorted(out)


def test_spans_by_force():
    """Licences with words left out, put in or changed, beside and inside one another."""
    machine, rng = license_scan.automaton(), random.Random(11)
    seen = set()
    for k in range(40):
        words = []
        for _ in range(3):
            words += rng.choices(["lorem", "the", "software", "of", "ipsum", "license"], k=rng.randint(0, 12))
            t = rng.choice([w for w in machine.words if len(w) < 130])[:]
            for _ in range(rng.choice([0, 1, 4, 12])):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 3)] = rng.choices(["dolor", "and", "x"], k=rng.randint(0, 2))
                t = t or ["x"]
            words += t
        got = machine.spans(words)
        assert got == spans_by_force(machine, words)
        seen |= {s[0] for s in got}
    assert len(seen) > 8


@pytest.mark.parametrize("label, text", license_scan.TEXTS)
def test_whole_licenses_are_found(label, text):
    """Each text alone has its label and no other; so it has with another holder, a changed word and lines of code around it."""
    machine = license_scan.automaton()
    words = license_scan.words_of(text)
    assert {s[0] for s in machine.spans(words)} == {label}
    if len(words) > 40:
        changed = [*"int main void return 0".split(), *words[:20], "acme", "corporation", *words[21:], *"include stdio h".split()]
        (span,) = [s for s in machine.spans(changed) if s[0] == label][:1]
        assert {s[0] for s in machine.spans(changed)} == {label} and span[3] > 0.85 and span[1] >= 3


def test_phrases_of_any_last_word():
    words = "a b a b c b a b".split()
    assert license_scan.places(words, (("a b", "x"), ("b c", "y"), ("c", "z"), ("q a", "w"))) == [("x", 0), ("x", 2), ("y", 3), ("z", 4), ("x", 6)]


# 9


def test_pfair():
    rng = random.Random(1)
    for _ in range(30):
        n = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 12))}
        plan = mixing.pfair(n)
        total = sum(n.values())
        assert [slot for _, _, slot, _, _ in plan] == [*range(total)]
        done = collections.Counter()
        for s, k, slot, release, due in plan:
            assert release <= slot < due and done[s] == k
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * n[x] / total) < 1 for x in n)


def test_mixing(spark, odd, none, docs):
    for df in (docs, odd):
        rows = mixing.mix(df.select("doc_id", "source"), block_rows=4, period=60, rows_per_bucket=16).collect()
        assert len(rows) == df.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["source"] or ""].append((r["__mix_block"], r["__mix_place"]))
            assert r["__mix_release"] <= r["__mix_slot"] < r["__mix_deadline"]
        for places in by.values():
            assert sorted(places) == [(i // 4, i % 4) for i in range(len(places))]
        slots = collections.defaultdict(set)
        for r in rows:
            slots[r["__mix_slot"]].add(r["source"] or "")
        assert all(len(s) == 1 for s in slots.values())
    assert mixing.mix(none).count() == 0
    clash = docs.select("doc_id", "source", F.lit(1).alias("__mix_slot"), F.lit("x").alias("__mix_h"))
    assert mixing.mix(clash).select("__mix_slot").distinct().count() > 1
    order = mixing.mixed_order(docs)
    assert order.columns == docs.columns and order.exceptAll(docs).count() == 0 and order.count() == docs.count()


def test_mixing_keeps_to_the_exact_weights(spark):
    sizes = {"hot": 2_000_000, **{f"s{i}": 100_000 for i in range(40)}}
    targets = {s: n**0.5 for s, n in sizes.items()}
    blocks = {s: -(-n // 32) for s, n in sizes.items()}
    total, done = sum(targets.values()), collections.Counter()
    live = {*sizes}
    for s, k, slot, release, due in mixing.schedule_all(targets, blocks):
        assert done[s] == k and release <= slot < due
        done[s] += 1
        if done[s] == blocks[s]:
            live.discard(s)
        if slot % 97 == 0:
            assert all(abs(done[x] - (slot + 1) * targets[x] / total) < 1 + 1e-6 for x in live)
    assert done == blocks and not live
    # many periods through Spark, a weight far below one slot of a period, one of 0 and more sources than a period has slots
    df = spark.range(6000).selectExpr("id as doc_id", "case when id < 5000 then 'a' when id < 5900 then 'b' else 'c' || id end as source")
    weights = {"a": 0.731, "b": 0.2687, **{f"c{i}": 1e-6 for i in range(5900, 5990)}}
    rows = mixing.mix(df, weights=weights, block_rows=2, period=40, rows_per_bucket=64).collect()
    assert len(rows) == 6000
    slots = {r["__mix_slot"]: r["source"] for r in rows}
    share, seen = {s: w / sum(weights.values()) for s, w in weights.items()}, collections.Counter()
    for at, slot in enumerate(sorted(slots)):
        seen[slots[slot]] += 1
        if seen["b"] < 450 and seen["a"] < 2500:
            assert slot == at and all(abs(seen[s] - (at + 1) * share[s]) < 1 + 1e-6 for s in weights)
    last = max(r["__mix_slot"] for r in rows if r["source"] in weights)
    assert all(r["__mix_slot"] > last for r in rows if r["source"] not in weights)


# 10


CONVS = [
    (1, 0, "system", "be \\ brief"), (1, 1, "user", "hi </turn>\n### x: y"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 4, "assistant", "\\e\\\\h"),
    (1, 5, "user", "bye"), (2, 0, "user", "q"), (3, 0, None, None), (3, 0, None, None), (4, None, "assistant", ""), (5, 0, "as: ### </turn>", "t" * 9000),
]


def test_chat_format(spark):
    df = spark.createDataFrame(CONVS, "conv_id long, turn long, role string, text string")
    examples = chat_format.expand(df)
    back = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    for conv in {c[0] for c in CONVS}:
        turns = [(r or "", t or "") for c, _, r, t in CONVS if c == conv]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == turns
        assert back[conv]["loss"] == "".join(t for r, t in turns if r == "assistant")
    n = collections.Counter(r["conv_id"] for r in examples.collect())
    assert n == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1}
    assert chat_format.read_back(chat_format.expand(df.where("1 = 0"))).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "<", "/turn>", "</turn>", "### ", ": ", "e", "h", "c", "\n", "é"]), max_size=12).map("".join), min_size=1, max_size=6))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = df.select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in e.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for _, c in chat_format.LETTERS)


def test_chat_query(spark, duck):
    got = queries.op10_chat_format(spark, SF)
    want = duck.execute(queries.OP10_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


# pipeline


@pytest.fixture(scope="module")
def stages(spark, odd):
    """(stage, its input, its output) for documents and the odd rows, shared and null ids among them, written between stages."""
    import corpus_pipeline as P

    more = [(None, "a text without an id, long enough to be told", None, "s", 1), (3, "the same id, other words, as can be seen here", None, None, 1)]
    rows = spark.createDataFrame([*more, more[0]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = materialize(table(spark, SF, "documents").unionByName(odd.select(*P.COLUMNS).withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(rows), "odd")
    out = {}
    for name, stage in P.STAGES:
        made = materialize(stage(spark, docs, SF), f"test-{name}")
        assert name == P.STAGES[-1][0] or made.columns == [*P.COLUMNS]
        out[name] = (docs.collect(), made.collect())
        docs = made
    return out


def bag(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_pipeline_language_stage(stages):
    import corpus_pipeline as P
    from zlib import crc32

    before, after = stages["language_id"]
    p = language_id.Profiles()
    units = p.encode([r["text"] for r in before])
    sums = collections.defaultdict(lambda: np.zeros(language_id.DIMS))
    for r, u in zip(before, units):
        if r["lang"] is not None and r["text"] is not None and r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]] += u
    best = np.max(units @ np.stack([v / np.linalg.norm(v) for v in sums.values()]).T, axis=1)
    least = np.array([0.02 if len(r["text"] or "") < P.SHORT else 0.125 for r in before])
    sure = np.abs(best - least) > 1e-3
    want = bag(r for r, s in zip(before, best >= least) if s)
    assert all(bag(after)[k] == want[k] for k in bag(r for r, s in zip(before, sure) if s))


def test_pipeline_quality_stage(spark, stages):
    """The same verdicts as the operator's other way, which joins them by id."""
    before, after = stages["quality_classifier"]
    numbered = [(i, r["text"]) for i, r in enumerate(before)]
    ids = spark.createDataFrame([(r["doc_id"], i) for i, r in enumerate(before) if r["doc_id"] is not None], "doc_id long, n long")
    labels = table(spark, SF, "labels").where(quality_classifier.fold_of(3) != 1)
    stats = quality_classifier.with_statistics(spark.createDataFrame(numbered, "doc_id long, text string"))
    marked = stats.withColumnRenamed("doc_id", "n").join(ids, "n").select("doc_id", "stats")
    model = quality_classifier.train(marked, labels)
    keep = {r["doc_id"] for r in quality_classifier.score(stats, model).where("score >= 0.5").collect()}
    assert bag(after) == bag(before[i] for i in keep) and 0 < len(after) < len(before)


def test_pipeline_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    names = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in before})
    classes = classes_by_force([(i, t) for i, (_, _, t) in enumerate(names)])
    of = {n: classes[i] for i, n in enumerate(names)}
    kept = [of[r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""] for r in after]
    assert sorted(kept) == sorted({*classes.values()}) and len(after) < len(before)


def test_pipeline_mixing_stage(stages):
    before, after = stages["mixing"]
    assert bag(before) == bag(after)


def test_pipeline_last_stage(stages):
    before, after = stages["bpe"]
    assert sorted(r["place"] for r in after) == [*range(len(before))]
    want = collections.Counter((r["doc_id"], tuple(library_once().encode(r["text"] or "", add_special_tokens=False).ids)) for r in before)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in after) == want


def test_pipeline_without_rows(spark):
    import corpus_pipeline as P

    docs = materialize(table(spark, SF, "documents").where("1 = 0"), "none")
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0


def test_pipeline_keeps_texts_of_a_shared_id(spark):
    import corpus_pipeline as P

    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "vw")
    rows = [(7, one, "en", "a", 1), (7, two, "en", "a", 2), (7, two, "en", "a", 2), (None, two + " end", None, None, None), (8, "alone", "en", "b", 1)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "shared")
    kept = P.drop_near_duplicates(spark, docs, SF).collect()
    assert len(kept) == 3 and {r["text"] for r in kept} >= {one, "alone"}


def test_pipeline_runs(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0


def test_pipeline_rejects_unlearned_scripts(spark):
    import corpus_pipeline as P

    rng = random.Random(3)
    docs = table(spark, SF, "documents")
    word = lambda low, high: "".join(chr(rng.randint(low, high)) for _ in range(rng.randint(3, 9)))
    rows = [(-1 - k, " ".join(word(*((0x3B1, 0x3C9), (0x10D0, 0x10F0))[k % 2]) for _ in range(10 + k)), None, "x", 1) for k in range(100)]
    both = docs.select(*P.COLUMNS).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = P.identify_language(spark, both, SF)
    assert kept.where("doc_id < 0").count() == 0
    clean = docs.where(F.col("text").rlike(r"\p{L}{3}"))
    assert kept.where("doc_id >= 0").count() >= 0.99 * clean.count()


def test_pipeline_keeps_the_mixed_order(spark):
    import corpus_pipeline as P

    sizes = {"a": 2400, "b": 800, "c": 200, "d": 150}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(i, f"{s} word " * (1 + i * 7 % 90), "en", s, 1) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = materialize(P.mix_sources(spark, docs, SF), "test-mixed")
    assert len(mixed.inputFiles()) > 1
    got = sorted((r["place"], r["doc_id"]) for r in P.encode(spark, mixed, SF).collect())
    assert [p for p, _ in got] == [*range(len(rows))]
    share = {s: n**0.5 / sum(m**0.5 for m in sizes.values()) for s, n in sizes.items()}
    seen = collections.Counter()
    for at, (_, i) in enumerate(got, 1):
        seen[names[i]] += 1
        if any(seen[s] == n for s, n in sizes.items()):
            break  # a source that has ended leaves its slots empty
        assert all(abs(seen[s] - at * share[s]) < 2 * 32 for s in sizes)
    assert at > 500


def test_queries_return_their_contract(spark):
    want = {
        "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op2_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    }
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert {*cols} <= {*df.columns} and df.count() == table(spark, SF, "documents").count()
