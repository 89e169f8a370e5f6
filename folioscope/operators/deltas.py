"""A citation index kept up by signed edges.

Papers that changed give +1 for references they gained and -1 for those they lost. Edges of unchanged papers aren't looked at,
and of the index only the targets that the signed edges name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.buckets import BucketTable

INDEX = "id string, cited_by array<struct<pos:bigint,src:string>>, n bigint"


def signed_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, sign) between two states of the edges(src, dst) of the changed papers; edges count once."""
    both = before.select("src", "dst", F.lit(-1).alias("sign")).distinct().union(after.select("src", "dst", F.lit(1).alias("sign")).distinct())
    return both.groupBy("src", "dst").agg(F.sum("sign").alias("sign")).where("sign <> 0")


def index_of(edges: DataFrame, order: DataFrame) -> DataFrame:
    """The whole index: of each target of ``edges(src, dst)`` who cites it, by ``order(src, pos)``, and how many."""
    met = edges.select("src", "dst").distinct().join(order, "src")
    lists = met.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "src"))).alias("cited_by"))
    return lists.select("id", "cited_by", F.size("cited_by").cast("long").alias("n"))


def apply_signed(index: DataFrame, signed: DataFrame, order: DataFrame) -> DataFrame:
    """The index rows of the targets in ``signed``; a target that nothing cites any more has an empty list. A -1 without its
    edge and a +1 that is there already change nothing."""
    named = signed.join(order, "src")
    entry = F.struct("pos", "src")
    gains = F.collect_list(F.when(F.col("sign") > 0, entry)).alias("gains")
    losses = F.collect_list(F.when(F.col("sign") < 0, F.col("src"))).alias("losses")
    changes = named.groupBy(F.col("dst").alias("id")).agg(gains, losses)
    held = changes.join(index.select("id", "cited_by"), "id", "left")
    none = F.array().cast("array<struct<pos:bigint,src:string>>")
    kept = F.filter(F.coalesce("cited_by", none), lambda e: ~F.array_contains("losses", e["src"]))
    merged = F.array_sort(F.array_union(kept, F.col("gains")))
    return held.select("id", merged.alias("cited_by"), F.size(merged).cast("long").alias("n"))


def update_index(table: BucketTable, before: DataFrame, after: DataFrame, order: DataFrame) -> list[int]:
    """Brings the stored index up to the changed papers' new edges; returns the buckets read and rewritten."""
    signed = signed_edges(before, after)
    targets = signed.select(F.col("dst").alias("id"))
    return table.upsert(apply_signed(table.read(table.touched(targets)), signed, order))
