"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a pseudo-random order, form blocks of equal size. With w a source's exact share of
all weights, its k-th block (from 0) is released at floor(k / w) and due by ceil((k + 1) / w);
earliest deadline first over released blocks meets every deadline, so in each prefix of the slots
every source that has not ended has its share to within less than one block, however long the prefix.
Shares are ratios of integers, nothing is rounded. Only blocks that exist are scheduled, one after the
other in one task that holds a row a source and streams the plan to a table; rows meet it by their bucket's
arrays of slots, so no row moves for it.

No row is dropped: a source that ends early leaves its later slots empty. Defined results: a null
source is a source of its own, written ''; sources of weight 0 come after all others have ended, with equal
shares; equal ids (and null ones, which are equal) are ordered arbitrarily in one bucket but each keeps a place; texts don't matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.session import ensure_workers, materialize

PREFIX = "__mix_"


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the ratio of ``weights``, all above 0."""
    ratios = {s: Fraction(w) for s, w in weights.items()}
    if any(r < 0 for r in ratios.values()):
        raise ValueError("a weight is below 0")
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    return {s: int(r * scale) for s, r in ratios.items()}


def schedule(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all ``blocks``, earliest deadline first over released ones."""
    total = sum(weights.values())
    window = lambda s, k: (k * total // weights[s], -(-(k + 1) * total // weights[s]))
    waiting = [(0, s, 0) for s in sorted(weights) if blocks[s]]
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], s, k, release))
        due, s, k, release = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError(f"block {k} of {s} missed its deadline {due}")
        yield s, k, slot, release, due
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))
        slot += 1


def schedule_all(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """``schedule`` of the sources with a weight, then of those without."""
    whole, after = exact(weights), 0
    for part in ({s: w for s, w in whole.items() if w}, {s: 1 for s, w in whole.items() if not w}):
        start = after
        for s, k, slot, release, due in schedule(part, blocks):
            yield s, k, start + slot, start + release, start + due
            after = start + slot + 1


def pfair(slots_of: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The schedule of one period in which each source has that many slots."""
    return [*schedule(slots_of, slots_of)]


def plan(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], batch: int) -> DataFrame:
    """``schedule_all`` as a table, written by one task in batches."""
    ensure_workers(spark)
    names = ["source", "block", "at", "r", "d"]

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = schedule_all(weights, blocks)
        kinds = [pa.string(), *[pa.int64()] * 4]
        while rows := [*itertools.islice(made, batch)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [PREFIX + n for n in names])

    kind = ", ".join(f"{PREFIX}{n} {'string' if n == 'source' else 'long'}" for n in names)
    return materialize(spark.range(0, 1, 1, 1).mapInArrow(run, kind), "mixing-plan")


def target_weights(docs: DataFrame, power: float = 0.5) -> dict[str, float]:
    """Each source's number of rows to ``power``: 1 keeps the sources' shares, 0 makes them equal."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).count().collect()
    return {r["s"]: r["count"] ** power for r in counts}


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int = 32,
    period: int = 1000,
    rows_per_bucket: int = 4096,
) -> DataFrame:
    """``docs`` with __mix_block, __mix_slot, __mix_release, __mix_deadline and __mix_place (row within its block).

    ``weights`` are the sources' target weights, those of ``target_weights`` by default; a source that isn't among them has
    weight 0. ``period`` is the number of blocks that are planned at a time. Columns named __mix_* are replaced. A source's order is that of a hash; ranks come from bucket counts plus a row number within a bucket, so a source with a third
    of all rows is spread over all tasks.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith(PREFIX)])
    source = F.coalesce(F.col("source"), F.lit(""))
    h = F.xxhash64(F.col("doc_id"), F.lit(20011))
    sizes = {r[0]: r[1] for r in docs.groupBy(source.alias("s")).count().collect()}
    rows = sum(sizes.values())
    buckets = max(1, math.ceil(rows / rows_per_bucket))
    targets = {s: float(weights.get(s, 0.0) if weights else n**0.5) for s, n in sizes.items()}
    made = plan(spark, targets, {s: -(-n // block_rows) for s, n in sizes.items()}, period)
    keyed = docs.withColumns({f"{PREFIX}source": source, f"{PREFIX}h": h}).withColumn(
        f"{PREFIX}bucket", F.pmod(F.shiftrightunsigned(f"{PREFIX}h", 20), F.lit(buckets))
    )
    key = [f"{PREFIX}source", f"{PREFIX}bucket"]
    counts = docs.select(source.alias(key[0]), F.pmod(F.shiftrightunsigned(h, 20), F.lit(buckets)).alias(key[1])).groupBy(*key).count()
    before = Window.partitionBy(key[0]).orderBy(key[1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"{PREFIX}start"), "count")
    # the slots of a bucket's blocks, from the block that holds its first row
    first = lambda at: F.expr(f"({at}) div {block_rows}")
    held = starts.withColumn(f"{PREFIX}block", F.explode(F.sequence(first(f"{PREFIX}start"), first(f"{PREFIX}start + count - 1"))))
    slots = F.array_sort(F.collect_list(F.struct(*[f"{PREFIX}{c}" for c in ("block", "at", "r", "d")]))).alias(f"{PREFIX}slots")
    found = held.join(made, [key[0], f"{PREFIX}block"]).groupBy(*key, f"{PREFIX}start").agg(slots)
    inside = Window.partitionBy(*key).orderBy(f"{PREFIX}h", "doc_id")
    ranked = keyed.withColumn(f"{PREFIX}rank", F.row_number().over(inside).cast("long")).join(found, key)
    ranked = ranked.withColumn(f"{PREFIX}rank", F.col(f"{PREFIX}rank") + F.col(f"{PREFIX}start") - 1)
    with_block = ranked.withColumn(f"{PREFIX}block", first(f"{PREFIX}rank"))
    mine = F.get(f"{PREFIX}slots", (F.col(f"{PREFIX}block") - first(f"{PREFIX}start")).cast("int"))
    placed = with_block.withColumn(f"{PREFIX}mine", mine)
    return placed.select(
        *[docs[c] for c in docs.columns],
        F.col(f"{PREFIX}block"),
        F.col(f"{PREFIX}mine.{PREFIX}at").alias(f"{PREFIX}slot"),
        F.col(f"{PREFIX}mine.{PREFIX}r").alias(f"{PREFIX}release"),
        F.col(f"{PREFIX}mine.{PREFIX}d").alias(f"{PREFIX}deadline"),
        F.pmod(F.col(f"{PREFIX}rank"), F.lit(block_rows)).alias(f"{PREFIX}place"),
    )


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its own columns, its partitions and rows in schedule order."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [f"{PREFIX}slot", f"{PREFIX}place"]
    return mix(docs, **options).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*docs.columns)
