"""All facet counts at once, by bitmaps.

Of each value of each facet a bitmap holds which rows have it, in buckets of 32,768 row numbers. The count of a value under a
selection of the other facets is the number of rows in the intersection of the chosen values' bitmaps. A facet's own filter is
never in its selection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.search import ALL

WITHIN = "__within"


def bitmaps(rows: DataFrame, id_col: str, facets: list[str]) -> DataFrame:
    """(facet, value, bucket, bits): one pass over ``rows``; ids are distinct whole numbers, a null value is no value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    each = rows.select(F.col(id_col).cast("long").alias("__id"), F.explode(pairs).alias("p")).where("p.value is not null")
    bucket = F.bitmap_bucket_number("__id").alias("bucket")
    return each.groupBy("p.facet", "p.value", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("bits"))


def selections(values: DataFrame, facets: list[str], also: list[tuple[str, str]]) -> DataFrame:
    """(facet, value, <a column for each facet>, chosen): each value of each facet beside each selection of the others, ALL or a
    value; ``chosen`` holds the (facet, value) pairs to intersect, ``also`` among them. As many rows as values times selections."""
    pair = lambda f, v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    everything = values.sparkSession.createDataFrame([(ALL,)], "v string")
    out = []
    for facet in facets:
        own = values.where(F.col("facet") == facet).select("facet", "value")
        for other in facets:
            options = values.where(F.col("facet") == other).select(F.col("value").alias(other)).union(everything)
            own = own.withColumn(other, F.lit(None).cast("string")) if other == facet else own.crossJoin(F.broadcast(options))  # an enumeration
        pairs = [pair(f, F.when(F.col(f) != ALL, F.col(f))) for f in facets if f != facet]
        chosen = F.array(pair(facet, F.col("value")), *pairs, *[pair(f, F.lit(v)) for f, v in also])
        out.append(own.withColumn("chosen", F.filter(chosen, lambda p: p["value"].isNotNull())))
    return reduce(DataFrame.unionByName, out)


def all_counts(rows: DataFrame, id_col: str, facets: list[str], within: DataFrame | None = None) -> DataFrame:
    """(facet, value, <a column for each facet>, n) for every value under every selection of the other facets, 0 where no row
    is left; a facet's own column is null. ``within`` holds the ids that all counts are limited to. Facets are enumerations: their
    values times the selections are the rows of the result."""
    bits = bitmaps(rows, id_col, facets)
    values = bits.select("facet", "value").distinct()
    also = []
    if within is not None:
        also = [(WITHIN, "")]
        bits = bits.unionByName(bitmaps(within.select(id_col, F.lit("").alias(WITHIN)), id_col, [WITHIN]))
    asked = selections(values, facets, also)
    key = [F.coalesce(F.col(c), F.lit("")) for c in ("facet", "value", *facets)]
    asked = asked.withColumn("key", F.to_json(F.array(*key)))
    parts = asked.select("key", F.size("chosen").alias("wanted"), F.explode("chosen").alias("c")).select("key", "wanted", "c.*")
    met = bits.join(parts, ["facet", "value"]).groupBy("key", "wanted", "bucket").agg(F.count("*").alias("have"), F.bitmap_and_agg("bits").alias("both"))
    n = met.where("have = wanted").groupBy("key").agg(F.sum(F.bitmap_count("both")).alias("n"))
    return asked.join(n, "key", "left").select("facet", "value", *facets, F.coalesce("n", F.lit(0)).alias("n"))
