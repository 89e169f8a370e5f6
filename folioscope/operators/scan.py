"""Running values in an order, within keys of any size.

Rows are dealt into blocks by ranges of (key, order). Each block is aggregated; since blocks lie in order, only a block's
last key can go on in the next one, so one row a block carries all that later blocks need. Inside a block a window runs over
the rows of one key. No task holds more than a block, wherever a key has most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialize

#: How a kind aggregates rows, how it aggregates aggregates, and how it joins an earlier aggregate to a later one.
KINDS = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
    "last": (lambda c: F.last(c, True), lambda c: F.last(c, True), lambda a, b: F.coalesce(b, a)),
    "first": (lambda c: F.first(c, True), lambda c: F.first(c, True), lambda a, b: F.coalesce(a, b)),
}


def scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    blocks: int | None = None,
    block: Column | None = None,
) -> DataFrame:
    """``rows`` with a column for each of ``values`` (name: (kind, column)): the kind over the rows of its ``keys`` up to this
    one, or before this one where not ``inclusive``.

    Kinds: sum, count (of non-null values), max, min, last and first non-null. ``order`` has to tell the rows of a key apart,
    else ties run in any order. Null keys are a key, null order values come first. An own column of a value's name is replaced.
    A kind without a row so far is null, a count 0. ``blocks`` is the number of shuffle partitions by default. Where the order has
    a whole number that never falls along it, ``block`` may cut it (say, id div 4096): then no row is written on the way, blocks of
    a key are summed in a window over that key's blocks, and a task holds the rows of one block.
    """
    spark = rows.sparkSession
    key = [f"__k{i}" for i in range(max(1, len(keys)))]
    named = rows.withColumns({k: F.col(c) for k, c in zip(key, keys)} if keys else {key[0]: F.lit(0)})
    named = named.withColumns({f"__v{i}": c for i, (_, c) in enumerate(values.values())})
    at = [*key, *order]
    kinds = [KINDS[kind] for kind, _ in values.values()]
    if block is not None:
        placed = named.withColumn("__block", block)
        each = placed.groupBy("__block", *key).agg(*[t.alias(f"__a{i}") for i, t in enumerate(_wholes(values, order))])
        earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        run = F.struct(*[merge(F.col(f"__a{i}")).over(earlier).alias(f"__c{i}") for i, (_, merge, _) in enumerate(kinds)])
        carried = each.select(F.col("__block").alias("__to"), F.struct(*key).alias("low"), run.alias("run"))
        return _joined(placed, carried, rows.columns, key, order, values, inclusive)
    dealt = named.repartitionByRange(blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), *at)
    placed = materialize(dealt.withColumn("__block", F.spark_partition_id()), "scan")

    each = placed.groupBy("__block", *key).agg(*[t.alias(f"__a{i}") for i, t in enumerate(_wholes(values, order))])
    # a row a block: its first key, its last key and what that has gathered in it
    ends = each.groupBy("__block").agg(
        F.min(F.struct(*key)).alias("low"),
        F.max(F.struct(*key)).alias("high"),
        F.max_by(F.struct(*[f"__a{i}" for i in range(len(kinds))]), F.struct(*key)).alias("top"),
    )
    so_far = Window.partitionBy("high").orderBy("__block")
    run = ends.withColumn("run", F.struct(*[merge(F.col(f"top.__a{i}")).over(so_far).alias(f"__c{i}") for i, (_, merge, _) in enumerate(kinds)]))
    before = F.lag(F.struct("high", "run")).over(Window.orderBy("__block"))
    carried = run.select("__block", "low", before.alias("from")).where("from.high <=> low")
    carried = F.broadcast(carried.select(F.col("__block").alias("__to"), "low", "from.run"))  # at most a row a block

    return _joined(placed, carried, rows.columns, key, order, values, inclusive)


def _wholes(values: dict[str, tuple[str, Column]], order: list[str]) -> list[Column]:
    """The aggregates of a group, whose rows have no order of their own."""
    by_order = {"last": F.max_by, "first": F.min_by}

    def whole(i: int, kind: str) -> Column:
        v = F.col(f"__v{i}")
        return by_order[kind](v, F.when(v.isNotNull(), F.struct(*order))) if kind in by_order else KINDS[kind][0](v)

    return [whole(i, kind) for i, (kind, _) in enumerate(values.values())]


def _joined(placed: DataFrame, carried: DataFrame, columns: list[str], key: list[str], order: list[str], values: dict, inclusive: bool) -> DataFrame:
    """What a row's block has of its key up to the row, after what earlier blocks have (``carried``: __to, low, run)."""
    kinds = [KINDS[kind] for kind, _ in values.values()]
    inside = Window.partitionBy("__block", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = placed.withColumns({f"__w{i}": f(F.col(f"__v{i}")).over(inside) for i, (f, _, _) in enumerate(kinds)})
    same = [F.col(k).eqNullSafe(F.col(f"low.{k}")) for k in key]
    joined = own.join(carried, [F.col("__block").eqNullSafe(F.col("__to")), *same], "left")
    got = [add(F.col(f"run.__c{i}"), F.col(f"__w{i}")).alias(name) for i, (name, (_, _, add)) in enumerate(zip(values, kinds))]
    return joined.select(*[c for c in columns if c not in values], *got)
