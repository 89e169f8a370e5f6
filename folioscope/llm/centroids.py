"""Centroid clustering in exact integers, on distinct vectors with their multiplicities.

Vectors are quantised to integers and grouped; Lloyd's rounds run over the distinct vectors, each weighted by its number of
copies, with integer sums, so neither the order of a sum nor copies in one task matter. The assignments are then joined back
to all rows by the digest of the quantised vector. A round reads the distinct vectors once and sends k sums a task; only the
k centroids and their sums reach the driver.

Defined results: rows whose vector is null, of another length, or has a null or non-finite component are left out; a component
counts as at most 2^27 in size after quantisation (the distances are longs); a null id is the empty one; rows that share an id
are told apart by their vectors; with fewer than k rows there are as many centroids as rows; a distance tie goes to the
smaller number; a cluster without vectors keeps its centroid; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import ensure_workers, materialize

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
MOST = 1 << 27


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q) of the usable rows: q holds floor(scale * x)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == dims).where(~F.exists("x", bad))
    level = lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v * scale))).cast("int")
    return kept.select("vec_id", F.transform("x", level).alias("q"))


def digest(q: str) -> Column:
    """32 bytes that stand for a vector of integers."""
    return F.unhex(F.sha2(F.array_join(F.col(q).cast("array<string>"), ","), 256))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the first centroid at the least squared distance, and that distance; exact."""
    most = max(1, np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * most * most * x.shape[1] < 1 << 53:  # whole numbers that doubles hold exactly
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, ties by the vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["q"] for r in rows.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()], np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, w = matrix(b.column(0), dims), b.column(1).to_numpy()
            best, _ = nearest(x, centroids)
            np.add.at(total, best, x * w[:, None])
            np.add.at(n, best, w)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = distinct.select("q", "n").mapInArrow(sums, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x"))
    got = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * dims rows at most
    out = centroids.copy()
    for r in got:
        out[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return out


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of each usable row, and (cluster, centroid, centroid_sha256, cluster_rows, cluster_inertia,
    inertia) of each cluster with rows."""
    spark = vectors.sparkSession
    ensure_workers(spark, 4096)
    rows = quantised(vectors, dims, scale)
    groups = rows.groupBy("q").agg(F.count("*").alias("n"))
    distinct = materialize(groups.select(digest("q").alias("digest"), "q", "n"), "distinct-vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)  # no row asks for it
    for _ in range(rounds):
        centroids = moved(distinct, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, d = nearest(matrix(b.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(best, pa.int32()), pa.array(d)], ["digest", "n", "cluster", "distance"])

    assigned = materialize(distinct.mapInArrow(assign, "digest binary, n long, cluster int, distance long"), "assigned-vectors")
    weighed = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n"))
    sums = assigned.groupBy("cluster").agg(F.sum("n").alias("n"), weighed.cast("decimal(38,0)").alias("d")).collect()  # k rows
    whole = sum(int(r["d"]) for r in sums)
    named = [
        (r["cluster"], c := centroids[r["cluster"]].tolist(), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), r["n"], int(r["d"]), whole) for r in sums
    ]
    kind = "cluster int, centroid array<long>, centroid_sha256 string, cluster_rows long, cluster_inertia long, inertia long"
    found = rows.select("vec_id", digest("q").alias("digest")).join(assigned.drop("n"), "digest")
    return found.select("vec_id", "cluster", "distance"), spark.createDataFrame(named, kind)
