"""Newest-first frontiers over (source, pos, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(seen: DataFrame, frontier: DataFrame) -> DataFrame:
    """(source, pos, id, hit): distinct ids strictly before the first id of the source's frontier; without a hit all.

    Two grouped minima and a join on the source, no window over a source's rows.
    """
    marks = frontier.select("source", "id").distinct().withColumn("mark", F.lit(1))
    flagged = seen.join(marks, ["source", "id"], "left")
    stop = flagged.where("mark = 1").groupBy("source").agg(F.min("pos").alias("stop"))
    first = flagged.groupBy("source", "id").agg(F.min("pos").alias("pos"))
    joined = first.join(stop, "source", "left")
    return joined.where("stop is null or pos < stop").select("source", "pos", "id", F.col("stop").isNotNull().alias("hit"))


def following(seen: DataFrame, size: int = 10) -> DataFrame:
    """(source, place, id): the first ``size`` distinct ids of a source, places from 1."""
    from pyspark.sql import Window

    first = seen.groupBy("source", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("source").orderBy("pos", "id")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= size).select("source", "place", "id")


def pages_complete(pages: DataFrame) -> DataFrame:
    """Per source: is the stated total constant, does no id repeat across pages, and do exhausted pages reach it.

    ``pages(source, page, total, ids)``.
    """
    rows = pages.select("source", "page", "total", F.explode_outer("ids").alias("id"))
    per = rows.groupBy("source").agg(
        (F.min("total") == F.max("total")).alias("stable"),
        F.count("id").alias("n"),
        F.countDistinct("id").alias("distinct_ids"),
        F.max("total").alias("total"),
    )
    return per.select("source", "stable", (F.col("n") == F.col("distinct_ids")).alias("no_repeat"), (F.col("distinct_ids") == F.col("total")).alias("exhausted"))
