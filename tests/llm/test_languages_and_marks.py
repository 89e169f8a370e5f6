"""Languages with few labelled rows, very many languages, and combining marks of any age."""

import random
import unicodedata

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import bpe, language_id
from folioscope.session import table

from ..conftest import SF

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_languages_with_few_labels_are_learned(spark):
    docs = table(spark, SF, "documents").where("length(text) > 400 and lang is not null")
    by_lang = {}
    for r in docs.select("lang", "text").collect():
        by_lang.setdefault(r["lang"], []).append(r["text"])
    (a, one), (b, two), (c, three) = sorted(by_lang.items(), key=lambda x: -len(x[1]))[:3]
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([(t, a) for t in (one * 2)[:28]] + [(t, b) for t in (two * 2)[:20]] + [(t, c) for t in three[:2]])]
    rows = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    rest = spark.range(1000, 100_950).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("lang"))
    protos = language_id.fit(rows.unionByName(rest))
    assert [n for names, _ in protos.blocks() for n in names] == sorted({a, b, c})
    got = language_id.predict(docs, protos).where(F.col("lang").isin(a, b, c)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    few = language_id.sample(rows.unionByName(rows.select((F.col("doc_id") + 500).alias("doc_id"), "text", "lang")), 3)
    assert {r["lang"]: r["count"] for r in few.groupBy("lang").count().collect()}[c] == 4  # a rare language stays whole


def test_thousands_of_languages(spark):
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x3400, 0x3400 + 6000)]
    names = [f"l{k:05d}" for k in range(5000)]
    rows = [(k, "".join(rng.choice(letters[k : k + 40]) if rng.random() < 0.8 else " " for _ in range(60)), n) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    protos = language_id.fit(df, dims=256)
    sizes = [m.shape for _, m in protos.blocks()]
    assert sizes == [(1024, 256)] * 4 + [(904, 256)]
    some = df.where("doc_id % 50 = 0")
    got = language_id.predict(some, protos, dims=256).collect()
    assert len(got) == 100 and all(r["lang"] == r["lang_pred"] and abs(r["score"] - 1) < 1e-5 for r in got)
    whole = {n: v for names, m in protos.blocks() for n, v in zip(names, m)}
    by_dict = language_id.predict(some, whole, dims=256).collect()
    told = lambda rows: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in rows)
    assert told(by_dict) == told(got)
    assert np.isclose(np.linalg.norm(whole[names[7]]), 1, atol=1e-5)


def test_marks_of_all_classes_in_any_order():
    lib = Tokenizer.from_file(WORDS)
    lib.no_truncation()
    lib.no_padding()
    mine = bpe.Encoder(WORDS)
    marks = [c for i in range(0x110000) if unicodedata.combining(c := chr(i))]
    partners = ["̴", "̣", "́", "ְ"]  # classes 1, 220, 230 and a fixed one
    texts = [f"q{m}{p} {p}{m}᷎e{m}" for m in marks for p in partners]
    texts += [("a" + m + "̣") * 30_000 for m in marks[:: len(marks) // 3]]  # longer than a block
    for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(t).tolist() == want.ids
