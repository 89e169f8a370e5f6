"""Structured Streaming forms of the incremental operators; with an available-now trigger they equal the batch forms.

Replay keys are kept in a table, not in state: whatever comes late meets all that came before (``keep_first``).
The state of papers is in ``papers.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def announcements(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream; the watermark column must be a timestamp with a zone."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(EVENT_SCHEMA)
    # a table of one file is read from its folder by name, a table of many as a folder of its own
    source = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def replay_keys(events: DataFrame) -> DataFrame:
    """(k, day, ts) of announcements: the replay key is source, user and day."""
    day = F.to_date("ts").cast("string")
    return events.select(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), day).alias("k"), day.alias("day"), "ts")


def dedup(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """One row for each replay key; with ``lateness`` the state is that of a watermark, and Spark drops rows behind it. Where a
    first sighting may come later, use ``keep_first``."""
    keyed = replay_keys(events.withWatermark("ts", lateness) if lateness else events)
    return keyed.dropDuplicatesWithinWatermark(["k"]) if lateness else keyed.dropDuplicates(["k"])


def keep_first(stream: DataFrame, key: str, part: str, out: str) -> None:
    """Adds to the table ``out`` the rows of ``stream`` whose ``key`` it doesn't hold yet, however late they come.

    There is no watermark, so no first sighting is lost, and no state: a micro-batch meets the stored keys by an anti-join that
    reads only the partitions (``part``, a function of the key such as its day) it has rows of. A batch writes a
    folder of its own, so one that is run again replaces what it wrote and doesn't take its own rows for replays.
    """
    spark = stream.sparkSession
    kept = [c for c in stream.columns if c != part]
    kind = ", ".join([f"`{c}` {t}" for c, t in stream.dtypes if c != part] + ["batch long", f"`{part}` string"])

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*").select(*kept, F.coalesce(F.col(part).cast("string"), F.lit("")).alias(part))
        if _exists(session, out):
            met = F.broadcast(rows.select(part).distinct())  # the days of a batch
            stored = session.read.schema(kind).parquet(out).where(F.col("batch") != batch_id)
            rows = rows.join(stored.join(met, part, "left_semi").select(key), key, "left_anti")
        rows.write.mode("overwrite").partitionBy(part).parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start()
    _finish(q)


def kept_table(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """What ``keep_first`` has kept."""
    return spark.read.schema(kind).parquet(out)


def first_seen(events: DataFrame) -> DataFrame:
    """(user_id, first): the registry of first sightings, as an updating aggregate."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first"))


def daily_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Announcements by day and source; late rows within the allowance still count."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Runs what is available now into a Parquet table; the checkpoint beside it makes a rerun go on from there."""
    _finish(stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start())


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def slices(rows: DataFrame, by: Column, n: int, root: str) -> DataFrame:
    """``rows`` as a stream of ``n`` micro-batches, slice by slice: each slice is a file. Only its writer is one task."""
    for k in range(n):
        rows.where(F.pmod(by, F.lit(n)) == k).repartition(1).write.parquet(f"{root}/slice={k}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/slice=*")


def dedup_table(stream: DataFrame, out: str) -> DataFrame:
    """(k, seen): distinct replay keys of a stream of announcements, by way of the table ``out``."""
    keep_first(replay_keys(stream).drop("ts"), "k", "day", out)
    return kept_table(stream.sparkSession, out, "k string").select("k", F.lit(True).alias("seen"))
