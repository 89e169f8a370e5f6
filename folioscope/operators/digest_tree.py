"""Two large tables compared by a tree of digests.

A leaf is a block of keys; its digest is the sum of its rows' digests, so it depends on neither order nor place and
copies count. Inner nodes sum their children. Of two trees only children of differing nodes are compared, level by level, and only
rows of differing leaves are joined. The stored side's tree is written with it and has as many rows as nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT, LEVELS = 16, 3


def leaf(key: str | Column, fanout: int = FANOUT, levels: int = LEVELS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(fanout**levels))


def tree(rows: DataFrame, key: str, columns: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(level, node, digest, n): level 0 is the root. Two sums of 64-bit halves of the rows' digests, and a count."""
    sha = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)")
    leaves = rows.groupBy(leaf(key, fanout, levels).alias("node")).agg(F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"), F.count("*").alias("n"))
    up = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "node", "a", "b", "n")
    at = F.floor(F.col("node") / F.pow(F.lit(fanout), F.lit(levels) - F.col("level"))).cast("long")
    sums = up.groupBy("level", at.alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    wrapped = lambda c: (F.col(c) % F.lit(1 << 62).cast("decimal(38,0)")).cast("string")
    return sums.select("level", "node", F.concat_ws("-", wrapped("a"), wrapped("b")).alias("digest"), F.col("n").cast("long").alias("n"))


def differing_leaves(one: DataFrame, two: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[int], int]:
    """The leaves in which two trees differ, and how many nodes were compared on the way."""
    names, compared = [0], 0
    for level in range(levels + 1):
        if not names:
            return [], compared
        nodes = [n * fanout + k for n in names for k in range(fanout)] if level else names
        here = lambda t: t.where((F.col("level") == level) & F.col("node").isin(nodes)).select("node", "digest", "n")  # noqa: B023, E731
        both = here(one).alias("one").join(here(two).alias("two"), "node", "full_outer")
        same = F.col("one.digest").eqNullSafe(F.col("two.digest")) & F.col("one.n").eqNullSafe(F.col("two.n"))
        compared += len(nodes)
        names = sorted(r["node"] for r in both.where(~same).select("node").collect())
    return names, compared


def only_leaves(rows: DataFrame, key: str, leaves: list[int], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    return rows.where(leaf(key, fanout, levels).isin(leaves)) if leaves else rows.limit(0)
