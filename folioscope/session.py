"""Session settings, table readers and the shared-folder helpers used by every operator."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = str(Path(__file__).resolve().parent.parent)

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "folioscope") -> SparkSession:
    """A local session with the settings the operators assume: UTC and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store Spark can read will do."""
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)


def ensure_workers(spark: SparkSession, rows_per_batch: int = 500) -> None:
    """Let Python workers import this package and keep Arrow batches of long texts small."""
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, on a local master only, a local one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "/tmp/checkpoints/folioscope"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_MADE: list[str] = []  # tables of this process that ``drop_tables`` hasn't removed, oldest first


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and a lost
    executor costs only its own tasks. The table stays until ``drop_tables``, as the result may be read at any time."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    return len(_MADE)


def drop_tables(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Removes the tables that ``materialize`` has written since ``tables_made()`` gave ``since``, but for the newest
    ``keep_last``. Only for results that are written elsewhere or no longer needed."""
    gone = _MADE[since : len(_MADE) - keep_last]
    del _MADE[since : len(_MADE) - keep_last]
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
