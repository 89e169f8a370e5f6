"""Language identification with hyperdimensional letter profiles.

Every letter has a random +1/-1 vector drawn from its code point. A trigram binds three letter
vectors, permuted by their place (rotation by two, one and none), by multiplication. A text is the
sum of its trigram vectors; a language is the sum of its texts' unit vectors; a text belongs to the
language whose prototype has the largest cosine with it.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled
row every text is ``und``; ties go to the first language by name; repeated rows each get a row; a text of any length is
summed whole; an empty table gives an empty result. There may be any number of languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import ensure_workers, materialize

DIMS = 1024
UND = "und"
SCALE = 1 << 20  # unit vectors are summed as integers, so the order of the sum doesn't matter
BLOCK = 1024  # languages that a pass scores against
LEAST_ROWS = 32  # of a language, in a sample
MOST_BROADCAST = 100_000  # languages whose counts are broadcast


class Profiles:
    """Text to hypervector, for blocks of texts at once."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.index = np.fromiter(
            (-(unicodedata.category(chr(c))[0] == "L") for c in range(0x110000)), np.int32, 0x110000
        )
        self.vectors = [np.ones((64, dims), np.int8) for _ in range(3)]
        self.known = 1  # 0 is the gap between words, whose vector is all ones

    def _learn(self, points: np.ndarray) -> None:
        for c in points.tolist():
            if self.known == len(self.vectors[0]):
                self.vectors = [np.concatenate([v, np.ones_like(v)]) for v in self.vectors]
            v = np.random.default_rng(c).integers(0, 2, self.dims, np.int8) * 2 - 1
            for turn, rows in enumerate(self.vectors):
                rows[self.known] = np.roll(v, turn)
            self.index[c] = self.known
            self.known += 1

    def _letters(self, text: str | None) -> np.ndarray:
        """Letter numbers of the lower-cased text; each run of other characters is one 0."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        got = self.index[points]
        if (new := got < 0).any():
            self._learn(np.unique(points[new]))
            got = self.index[points]
        got = np.concatenate([[0], got, [0]])
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != 0) | (got[:-1] != 0)
        return got[keep].astype(np.int64)

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors (zero where a text has no letter), one row for each text."""
        out = np.zeros((len(texts), self.dims), np.float32)
        rows, keys = [], []
        for i, t in enumerate(texts):
            x = self._letters(t)
            if len(x) > 2:
                k = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
                k = k[x[1:-1] != 0]
                rows.append(np.full(len(k), i))
                keys.append(k)
        if not keys:
            return out
        row, key = np.concatenate(rows), np.concatenate(keys)
        base = self.known
        if base <= 160:  # small alphabets: number the trigrams by a table, without sorting
            small = ((key >> 42) * base + ((key >> 21) & 0x1FFFFF)) * base + (key & 0x1FFFFF)
            seen = np.zeros(base**3, bool)
            seen[small] = True
            present = np.flatnonzero(seen)
            number = np.cumsum(seen, dtype=np.int32) - 1
            inverse = number[small]
            a, b, c = present // (base * base), present // base % base, present % base
        else:
            present, inverse = np.unique(key, return_inverse=True)
            a, b, c = present >> 42, (present >> 21) & 0x1FFFFF, present & 0x1FFFFF
        step = 8192
        for lo in range(0, len(present), step):
            hi = min(lo + step, len(present))
            vectors = self.vectors[2][a[lo:hi]] * self.vectors[1][b[lo:hi]] * self.vectors[0][c[lo:hi]]
            here = (inverse >= lo) & (inverse < hi) if len(present) > step else slice(None)
            counts = np.bincount(row[here] * (hi - lo) + (inverse[here] - lo), minlength=len(texts) * (hi - lo))
            out += counts.reshape(len(texts), hi - lo).astype(np.float32) @ vectors.astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


@lru_cache(maxsize=1)
def profiles(dims: int) -> Profiles:
    return Profiles(dims)


@dataclass
class Prototypes:
    """Unit prototypes as a table (lang, unit): 4 bytes a dimension, packed. They reach the driver a block at a time."""

    table: DataFrame

    def blocks(self, size: int = BLOCK) -> Iterator[tuple[list[str], np.ndarray]]:
        """(names, one row for each) in order of the names."""
        rest = self.table
        while rows := rest.orderBy("lang").limit(size).collect():
            yield [r["lang"] for r in rows], np.stack([np.frombuffer(r["unit"], np.float32) for r in rows])
            if len(rows) < size:
                return
            rest = self.table.where(F.col("lang") > F.lit(rows[-1]["lang"]))


def sample(rows: DataFrame, most_rows: int) -> DataFrame:
    """About ``most_rows`` of ``rows(doc_id, lang, text)``, as many of each language (LEAST_ROWS at least), all of a rarer one."""
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("of")), "languages")
    n = counts.count()
    quota = max(LEAST_ROWS, most_rows // max(1, n))
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / float(1 << 53)
    taken = rows.join(F.broadcast(counts) if n <= MOST_BROADCAST else counts, "lang")
    return taken.where(spread < F.lit(quota) / F.col("of")).select("doc_id", "lang", "text")


def fit(labelled: DataFrame, most_rows: int | None = 24_000, dims: int = DIMS) -> Prototypes:
    """Prototypes by language from (doc_id, text, lang) rows with non-null lang.

    ``most_rows`` bounds the sample (see ``sample``; picked by a hash of the id); None takes all.
    """
    ensure_workers(labelled.sparkSession, 250)
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    rows = (rows if most_rows is None else sample(rows, most_rows)).where(F.col("text").isNotNull())
    names = ["lang", "v"]

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            arrays = [pa.array([*total], pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))]
            total.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            langs = b.column(0).to_pylist()
            units = np.rint(profiles(dims).encode(b.column(1).to_pylist()) * SCALE).astype(np.int64)
            for lang in {*langs}:
                total[lang] = total.get(lang, 0) + units[[x == lang for x in langs]].sum(0)
            if len(total) >= BLOCK:
                yield out()
        yield out()

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            n = np.linalg.norm(v, axis=1)
            units = (v[n > 0] / n[n > 0, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(n > 0)), pa.array([u.tobytes() for u in units], pa.binary())], ["lang", "unit"])

    sums = rows.select("lang", "text").mapInArrow(bundle, "lang string, v array<long>")
    parts = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    units = whole.select("lang", F.transform("v", lambda p: p["x"]).alias("v")).mapInArrow(scale, "lang string, unit binary")
    return Prototypes(materialize(units, "prototypes"))


def predict(docs: DataFrame, prototypes: Prototypes | dict[str, np.ndarray], dims: int = DIMS) -> DataFrame:
    """``docs`` with lang_pred and score after its own columns; own columns of those names are replaced.

    A pass scores against up to BLOCK languages; with more of them each further pass takes the best so far along, so there is no
    limit to their number.
    """
    ensure_workers(docs.sparkSession, 250)
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns
    at, width = columns.index("text"), len(columns)
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def against(rows: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                units = profiles(dims).encode(b.column(at).to_pylist())
                some = units.any(1) & bool(names)
                cosines = units @ matrix.T if names else np.zeros((len(units), 1), np.float32)
                best = cosines.argmax(1)
                score = np.clip(cosines[np.arange(len(units)), best], 0, 1).astype(np.float64) * some
                lang = [names[k] if s else UND for k, s in zip(best, some)]
                if b.num_columns > width:  # an earlier block's best stands unless this one's is larger
                    lang = [new if x > y else old for new, old, x, y in zip(lang, b.column(width).to_pylist(), score, b.column(width + 1).to_pylist())]
                    score = np.maximum(score, b.column(width + 1).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(lang, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

        return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")

    if isinstance(prototypes, Prototypes):
        blocks = prototypes.blocks()
    else:
        blocks = [([*prototypes], np.stack([*prototypes.values()]))] if prototypes else []
    found = None
    for names, matrix in blocks:
        found = against(docs if found is None else materialize(found, "languages-so-far"), names, matrix)
    return against(docs, [], np.zeros((0, dims), np.float32)) if found is None else found


def fold(mod: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(mod))
