"""Token counts through a digest cache.

A text's identity is the SHA-256 of its normalised content (null becomes the empty text; the
piece model's own normaliser is the identity, so nothing else may be folded without changing
counts). Counts live in a table keyed by (tokenizer version, content digest). One run joins the
documents' digests to that table, encodes each distinct text it lacks once, appends those
counts, and joins all documents to the table again.

Defined results: null and empty texts count 0 tokens and 0 bytes; repeated rows each get a row;
rows that share an id
each count their own text; a text of any length is encoded whole; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import ensure_workers, materialize

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("tokenizer", T.BinaryType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
SPACE = "▁"
CHUNK = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Counts pieces of texts word by word, remembering short words.

    No piece of the model holds a space mark after another character, so no merge crosses the
    place where a space follows a non-space and the parts can be encoded apart. A model for which
    that fails, or a text that holds the mark itself, is encoded whole.
    """

    LONGEST_KEY = 48

    def __init__(self, model_path: str, max_entries: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.half = max_entries // 2
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self._keeps_texts()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        a, spaced = self._whole(["a", "a "])
        self.lone_space = spaced - a

    def _keeps_texts(self) -> bool:
        """Whether the model's normaliser changes nothing but spaces into marks: full-width, composed and decomposed letters,
        ligatures, case, controls, runs of spaces and other blanks."""
        said = ["a  b", " a ", "Ａ", "ﬁ", "é", "e\u0301", "İ", "½", "\u200b", "\u00a0x", "a\tb\n", "\x07", "한글", "ｶﾞ", "①", "\ufeff"]
        return all(self.model.normalize(t).replace(SPACE, " ") in (t, " " + t) for t in said)

    def _whole(self, texts: list[str]) -> list[int]:
        return [*map(len, self.model.encode(texts, num_threads=1))]

    @staticmethod
    def _keys(text: str) -> list[str]:
        """The words as the model takes them: it puts one space mark before each itself."""
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        chunks = CHUNK.findall(text)
        return [chunks[0], *(c[1:] for c in chunks[1:])]

    def counts(self, texts: list[str | None]) -> list[int]:
        """One count for each text; the words nobody remembers are encoded in one call."""
        apart = [bool(t) and self.separable and SPACE not in t for t in texts]
        keys = [self._keys(t) if a else [] for t, a in zip(texts, apart)]
        flat = [*chain.from_iterable(keys)]
        found = [*map(self.young.get, flat)]
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            fresh = {k: self.old.get(k) for k in {flat[i] for i in missing}}
            todo = [k for k, n in fresh.items() if n is None and k]
            fresh |= zip(todo, self._whole(todo)) if todo else {}
            if "" in fresh:
                fresh[""] = self.lone_space
            for i in missing:
                found[i] = fresh[flat[i]]
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young |= {k: n for k, n in fresh.items() if len(k) <= self.LONGEST_KEY}
        out, at = [], 0
        for text, a, k in zip(texts, apart, keys):
            out.append(sum(found[at : at + len(k)]) if a else self._whole([text])[0] if text else 0)
            at += len(k)
        return out


@lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def tokenizer_digest(model_path: str) -> bytes:
    """Version digest: library, its version, options and the model file's bytes."""
    import sentencepiece

    with open(model_path, "rb") as f:
        body = f.read()
    return hashlib.sha256(f"sentencepiece {sentencepiece.__version__} no-bos-eos\n".encode() + body).digest()


def content_digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, cache_path: str, version: bytes) -> DataFrame | None:
    """The counts stored for one tokenizer version, or None where there is no table yet. A digest
    that two runs appended is read once."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return rows.where(F.col("tokenizer") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one for each row of ``docs``."""
    spark = docs.sparkSession
    ensure_workers(spark)
    version = tokenizer_digest(model_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(text_col).alias("text"), content_digest(text_col).alias("digest"))
    known = read_cache(spark, cache_path, version)
    misses = keyed if known is None else keyed.join(known.select("digest"), "digest", "left_anti")
    # one text a digest; copies meet in the map-side half of the aggregate
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(model_path)
        for b in batches:
            yield pd.DataFrame(
                {"tokenizer": [version] * len(b), "digest": b["digest"], "n_tokens": counter.counts([*b["text"]])}
            )

    distinct.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # a table of its own, so that the join below can split a digest that many rows share
    counts = materialize(read_cache(spark, cache_path, version), "token-counts")
    ids = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        content_digest(text_col).alias("digest"),
    )
    return ids.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
