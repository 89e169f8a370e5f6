"""Megabyte texts, shared and missing ids, repeated rows and clashing columns, for every operator on texts."""

import collections
import re

import public_tokenizers
import pytest

from folioscope.llm import bpe, chat_format, fingerprints, language_id, license_scan, mixing, near_dups, quality_classifier, quality_rules, token_counts
from folioscope.session import fresh_path, table

from ..conftest import SF

LONG = " ".join(f"w{i % 977} the license" if i % 50 else f"line {i}\n" for i in range(70_000))
SOLID = "xé" * 500_000
ROWS = [(1, LONG), (1, "other words"), (None, LONG + " end"), (None, None), (None, ""), (2, SOLID), (2, SOLID), (3, "the " * 60)]
CLASHING = "label string, score string, shard string, key string, token string, n long, n_words string, digest string, node long, lang_pred int, labels string, __mix_slot long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, "l", "s", "h", "k", "t", 1, "n", "d", 2, 3, "x", 4) for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def told(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in ROWS)
    assert told(token_counts.count_tokens(odd, path, fresh_path(spark, "cache")), "doc_id", "n_bytes", "n_tokens") == want


def test_round_trip(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    got = bpe.encode_decode(odd, path).collect()
    want = {t: lib.encode(t, add_special_tokens=False).ids for t in {t or "" for _, t in ROWS}}
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((i, tuple(want[t or ""])) for i, t in ROWS)


def test_quality_rules(odd):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert told(quality_rules.judge(odd), "doc_id", "n_words") == collections.Counter((i, words(t)) for i, t in ROWS)


def test_near_duplicates(odd):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and sum(r["class_id"] == 2 for r in got) == 2
    assert sum(r["class_id"] == 1 for r in got) == 2  # both texts of that id; a row without one names no class


def test_classifiers(spark, odd):
    scored = quality_classifier.classify(odd, table(spark, SF, "labels"))
    assert told(scored, "doc_id") == collections.Counter((i,) for i, _ in ROWS) and scored.where("score between 0 and 1").count() == len(ROWS)
    protos = language_id.fit(table(spark, SF, "documents"))
    got = language_id.predict(odd, protos)
    assert told(got, "doc_id") == told(scored, "doc_id") and got.where("lang_pred = 'und'").count() == 2


def test_fingerprints(odd):
    got = fingerprints.compare_with_edits(odd).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((i, len(t or "")) for i, t in ROWS)
    same = [r for r in got if r["doc_id"] == 2]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and max(r["near_next"] for r in same) == 1.0


def test_license_scan(odd):
    found = license_scan.report(license_scan.scan(odd))
    words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or ""))
    assert told(found, "doc_id", "n_words") == collections.Counter((i, words(t)) for i, t in ROWS)


def test_mixing(odd):
    got = mixing.mix(odd)
    places = told(got, "__mix_slot", "__mix_place")
    assert len(places) == len(ROWS) and told(got, "doc_id") == collections.Counter((i,) for i, _ in ROWS)


def test_chat_format(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", SOLID), (1, 1, "assistant", SOLID), (None, 0, None, None), (None, 1, "assistant", "### x</turn>\\")]
    df = spark.createDataFrame([(*r, "a", 5, "b", 6, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string, example long, t string, loss_start long, ts string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.expand(df)).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [LONG, SOLID, SOLID] and got[1]["loss"] == SOLID * 2
    assert got[None]["loss"] == "### x</turn>\\"
