"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2^bits cells of about equal row counts: a value's cell is the share of rows with smaller
values, so it may be a number or a name, and a value that holds a third of the rows just takes one cell. The cells of a row
are a point of a grid; Hilbert's curve visits neighbouring points one after the other. Rows sorted by their place on the
curve are cut into runs whose row counts differ by one at most (law ``rows``). So a shard covers a small box of every
dimension, and a filter on any of them leaves most shards unread.

Cell bounds (2^bits values a dimension at most) are the only thing that reaches the driver. Places in the order come from a
segmented scan, so neither a hot value nor a hot cell meets in one task; rows that agree in all of the order are told apart by
a number that is written with them.

Defined results: a null dimension value sorts before all others; a null text has no bytes; repeated rows each have a slot;
rows alike in curve, id and text take their slots in any order; equal texts may lie in different shards (only ``key`` and ``bytes`` laws could hold them
together, a group with a third of all rows can't be whole where counts are equal); fewer rows than shards leave the last
places of some shards empty; an empty table gives an empty result; own columns named like a result are replaced.
Texts of any length count by their size only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.scan import scan
from folioscope.session import materialize

SHARDS, BITS = 16, 5
RESULTS = ("curve", "shard", "slot")


def turns(dims: int) -> tuple[list[int], int]:
    """The curve as a machine: at ``state * 2^dims + corner`` the corner's place in the order, shifted left by the bits of a
    state, plus the next state; and that number of bits. A state is the corner where the curve enters a cube and the axis along
    which it leaves it."""
    corners = 1 << dims
    width = (dims * corners - 1).bit_length()
    right = lambda x, by: ((x >> by % dims) | (x << (dims - by % dims))) & (corners - 1)
    gray = [x ^ (x >> 1) for x in range(corners)]
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
    out = []
    for state in range(dims * corners):
        entry, axis = divmod(state, dims)
        for corner in range(corners):
            place = gray.index(right(corner ^ entry, axis + 1))
            enters = gray[(place - 1) // 2 * 2] if place else 0
            leaves = ones(place - 1 + place % 2) if place else 0
            state_after = (entry ^ right(enters, -(axis + 1))) * dims + (axis + leaves + 1) % dims
            out.append(place << width | state_after)
    return out, width


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a point with these coordinates, each below 2^bits."""
    dims = len(cells)
    if not 2 <= dims <= 4 or dims * bits > 56:
        raise ValueError("two to four dimensions of at most 56 bits in all")
    made, width = turns(dims)
    table = F.array(*[F.lit(x).cast("long") for x in made])
    low = F.lit((1 << width) - 1)

    def step(packed: Column, level: Column) -> Column:
        bit = lambda c: F.call_function("shiftright", c, level).bitwiseAND(F.lit(1))
        corner = reduce(lambda a, b: a + b, [bit(c) * (1 << k) for k, c in enumerate(cells)])
        got = F.element_at(table, (packed.bitwiseAND(low) * (1 << dims) + corner + 1).cast("int"))
        return F.shiftleft(F.shiftright(packed, width), dims + width).bitwiseOR(got)

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.shiftright(F.aggregate(levels, F.lit(0).cast("long"), step), width)


def cell_bounds(rows: DataFrame, value: str, cells: int) -> list[tuple[object, int]]:
    """(smallest value, cell) of each cell in use: a value's cell is ``cells`` times the share of rows with smaller values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("__n"))
    total = rows.count()
    run = scan(counts, [], [value], {"__before": ("sum", F.col("__n"))}, inclusive=False)
    cell = F.expr(f"coalesce(__before, 0L) * {cells} div {max(1, total)}")
    low = run.groupBy(cell.alias("__cell")).agg(F.min(F.struct(value)).alias("__low"))  # a struct: null is smallest
    return sorted(((r["__low"][0], r["__cell"]) for r in low.collect()), key=lambda x: x[1])


def cell_of(value: Column, bounds: list[tuple[object, int]]) -> Column:
    """The cell of a value by ``cell_bounds``; one below the smallest bound is in the first cell."""
    first = bounds[0][1] if bounds else 0
    lows = [(v, c) for v, c in bounds if v is not None]
    if not lows:
        return F.lit(first)
    at = F.size(F.filter(F.array(*[F.lit(v) for v, _ in lows]), lambda low: low <= value))
    return F.when(value.isNull() | (at == 0), first).otherwise(F.element_at(F.array(*[F.lit(c) for _, c in lows]), F.greatest(at, F.lit(1))))


def shard(docs: DataFrame, dimensions: list[str], order: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``docs`` with curve (place on the curve), shard and slot (from 0 within the shard).

    ``dimensions`` are two to four own columns, ``order`` those that order rows of one place. The rows are written once
    before they are ordered, so pass the columns that the result needs, not more.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    rows = materialize(docs.select(*kept, F.monotonically_increasing_id().alias("__uid")), "shard-rows")
    cells = [cell_of(F.col(d), cell_bounds(rows.select(d), d, 1 << bits)) for d in dimensions]
    names = [f"__cell{i}" for i in range(len(cells))]
    curved = rows.withColumns(dict(zip(names, cells))).withColumn("curve", hilbert([F.col(c) for c in names], bits))
    ranked = scan(curved, [], ["curve", *order, "__uid"], {"__rank": ("count", F.col("__uid"))}, inclusive=False)
    n = rows.count()
    put = F.expr(f"cast(__rank * {shards} div {max(1, n)} as int)")
    start = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", put).withColumn("slot", F.col("__rank") - start).select(*kept, *RESULTS)


def ranges(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """(shard, rows, low_*, high_*): a row a shard, what a reader needs to leave a shard out."""
    ends = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends, *[F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in dimensions])


def write_shards(sharded: DataFrame, path: str, dimensions: list[str]) -> None:
    """Shards as folders of Parquet files, each file a run of slots, and their ranges beside them."""
    spark = sharded.sparkSession
    rows = materialize(sharded, "sharded")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.select("shard").distinct().count())
    rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    ranges(rows, dimensions).coalesce(1).write.parquet(f"{path}/_ranges")


def read_shards(spark: SparkSession, path: str, within: dict[str, tuple[object, object]]) -> DataFrame:
    """Rows whose columns lie in the given closed ranges; only shards that can hold one are read."""
    meets = [(F.col(f"low_{d}") <= F.lit(high)) & (F.col(f"high_{d}") >= F.lit(low)) for d, (low, high) in within.items()]
    shards = [r["shard"] for r in spark.read.parquet(f"{path}/_ranges").where(reduce(lambda a, b: a & b, meets, F.lit(True))).select("shard").collect()]
    inside = reduce(lambda a, b: a & b, [F.col(d).between(low, high) for d, (low, high) in within.items()], F.lit(True))
    return spark.read.parquet(path).where(F.col("shard").isin(shards) if shards else F.lit(False)).where(inside)
