"""A quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Document statistics (no label, language, source or id) are standardised and mapped to random
Fourier features, which approximate a Gaussian kernel. Ridge weights come from X'X and X'y summed over
partitions; a held-back fold of the training rows maps ridge scores to probabilities by isotonic
regression over equal score bins.

Defined results: null and empty texts have the statistics of the empty text and are scored like any
other; without labels of both kinds every score is the share of label 1 (0.5 without any); repeated rows
each get a row; a text of any length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.filters import about, in_filter, key_filter
from folioscope.session import ensure_workers, materialize

FEATURES, BINS, RIDGE, SEED = 256, 512, 1e-3, 11
N_STATS = 16


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(np.float64)
    n = max(1.0, hist.sum())
    words = text.split()
    lines = text.split("\n")
    share = hist / n
    some = share[share > 0]
    count = lambda chars: float(sum(share[ord(c)] for c in chars))
    n_words = max(1, len(words))
    return [
        np.log1p(len(text)),
        len(text) / n_words,
        len({*words}) / n_words,
        len({*words}) / n_words**0.8,
        float(share[65:91].sum()),
        float(share[97:123].sum()),
        float(share[48:58].sum()),
        float(share[128:].sum()),
        count(" \t\n"),
        count(".,"),
        count("!?"),
        count("|"),
        count("#*$%&<>"),
        len({*lines}) / len(lines),
        np.log1p(len(text) / len(lines)),
        float(-(some * np.log2(some)).sum()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row."""
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray
    levels: np.ndarray
    prior: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        return lift((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def lift(z: np.ndarray, features: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """cos(z W + b) with Gaussian W, a Gaussian kernel's bandwidth of sqrt(number of statistics), and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, features))
    b = rng.uniform(0, 2 * np.pi, features)
    return np.hstack([np.sqrt(2 / features) * np.cos(np.clip(z, -12, 12) @ w + b), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing least squares by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k
    return np.concatenate([np.full(k, v) for v, _, k in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, most_rows: int = 60_000) -> Model:
    """From (doc_id, stats, label, fold) rows: fold 0 fits the ridge, the others calibrate.

    ``most_rows`` bounds the sample; above it, rows are picked by a hash of their id.
    """
    rows = materialize(rows.where(about(most_rows, rows.count(), 5, "doc_id")), "training").coalesce(8)
    at = [F.col("stats")[i] for i in range(N_STATS)]
    moments = rows.agg(F.count("*"), F.avg("label"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at], F.min("label"), F.max("label")).first()
    count, prior, low, high = moments[0], moments[1], moments[-2], moments[-1]
    mean = np.array([x or 0.0 for x in moments[2 : 2 + N_STATS]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in moments[2 + N_STATS : 2 + 2 * N_STATS]])
    model = Model(mean, scale, None, np.zeros(0), np.zeros(0), 0.5 if prior is None else float(prior))
    if not count or low == high:
        return model

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, cross, size = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for b in batches:
            if len(b):
                z = model.lift(np.stack(b["stats"].to_numpy()))
                gram += z.T @ z
                cross += z.T @ b["label"].to_numpy(np.float64)
                size += len(b)
        yield pd.DataFrame({"gram": [gram.tobytes()], "cross": [cross.tobytes()], "n": [size]})

    # eight partitions: eight small matrices reach the driver
    parts = rows.where("fold = 0").mapInPandas(sums, "gram binary, cross binary, n long").collect()
    gram = sum(np.frombuffer(p["gram"]).reshape(FEATURES + 1, FEATURES + 1) for p in parts)
    cross = sum(np.frombuffer(p["cross"]) for p in parts)
    size = max(1, sum(p["n"] for p in parts))
    model.weights = np.linalg.solve(gram + RIDGE * size / FEATURES * np.eye(FEATURES + 1), cross)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = model.raw(np.stack(b["stats"].to_numpy()))
                yield pd.DataFrame({"bin": np.clip(np.rint(raw * BINS), -BINS, 2 * BINS).astype(np.int64), "y": b["label"].astype(float)})

    held = rows.where("fold <> 0").mapInPandas(bins, "bin long, y double")
    table = sorted(held.groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    if not table:
        table = [(0, 0.0, 1), (BINS, 1.0, 1)]
    x = np.array([r[0] / BINS for r in table])
    model.edges, model.levels = x, isotonic(x, np.array([r[1] for r in table]), np.array([r[2] for r in table]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, stats)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = model.score(np.stack(b["stats"].to_numpy())) if len(b) else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": got})

    return stats.select("doc_id", "stats").mapInPandas(run, "doc_id long, score double")


def train(stats: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> Model:
    """From (doc_id, stats) rows; labels with crc32(doc_id) mod ``folds`` equal to ``held_out`` are never read."""
    marks = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))
    return fit(stats.join(marks.where(fold_of(folds) != held_out), "doc_id").withColumn("fold", fold_of(folds)))


def fold_of(folds: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    stats = materialize(with_statistics(docs), "statistics")
    scored = score(stats, train(stats, labels, held_out, folds))
    return scored.select(
        "doc_id", (fold_of(folds) == held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def with_scores(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """``docs`` with the column score (an own one of that name is replaced). The model's rows are found by a filter of their ids, so
    no text is shuffled, and each row is scored where it is read: rows without an id or with a shared one too."""
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "text")
    near = ids.join(F.broadcast(key_filter(labels.select(F.col("doc_id").cast("long")), "doc_id")), in_filter("doc_id"), "left_semi")
    model = train(materialize(with_statistics(near), "statistics"), labels, held_out, folds)
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(np.array([statistics(t.as_py()) for t in b.column(at)]).reshape(-1, N_STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, score double")
