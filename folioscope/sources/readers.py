"""Readers for catalogues, logs, manifests, id lists, feeds and pages. Bad rows carry an error; strict wrappers raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.sources import schemas


def json_document(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """A whole JSON document as one row; with ``missing_ok`` no rows where there is no file."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper records with their catalogue position; a document without a papers array is an error."""
    doc = json_document(spark, path, schemas.CATALOGUE)
    checked = F.when(F.col("papers").isNull(), F.raise_error(F.lit("catalogue has no papers array"))).otherwise(F.col("papers"))
    return doc.select(F.posexplode(checked).alias("pos", "p")).select("pos", "p.*")


def islands(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, schemas.CATALOGUE).select(F.inline("islands"))


def candidate_log(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows and an ``error`` column: id, version, digest and status are checked."""
    rows = json_document(spark, path, f"candidates array<struct<{schemas.CANDIDATE}>>").select(F.inline("candidates"))
    error = (
        F.when(~F.coalesce(F.col("arxivId"), F.lit("")).rlike(r"^(?:\d{4}\.\d{4,5}|[a-z][a-z0-9.\-]+/\d{7})$"), "id")
        .when(~(F.coalesce("version", F.lit(0)) > 0), "version")
        .when(~F.coalesce(F.col("metadataSha256"), F.lit("")).rlike(r"^[0-9a-f]{64}$"), "digest")
        .when(~F.coalesce(F.col("status"), F.lit("")).isin("ambiguous", "excluded", "relevant"), "status")
    )
    return rows.withColumn("error", error)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, schemaVersion, runAt, at, scanWindow, validation, body): run manifests in name order. ``at`` is the instant of
    runAt, null unless it states a zone; ``body`` is the whole document, whatever its fields, as ``variant``."""
    rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("body"))
    get = lambda path, kind: F.try_variant_get("body", f"$.{path}", kind)
    zoned = F.col("runAt").rlike(r"(?:Z|[+\-]\d{2}:?\d{2})$")
    return rows.select(
        "file", get("schemaVersion", "int").alias("schemaVersion"), get("runAt", "string").alias("runAt"),
        get("scanWindow", "string").alias("scanWindow"), get("validation", "string").alias("validation"), "body",
    ).withColumn("at", F.when(zoned, F.try_to_timestamp("runAt"))).orderBy("file")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids from a JSON array, {"ids": [...]} or lines of text."""
    whole = spark.read.text(path, wholetext=True)
    array = F.from_json("value", T.ArrayType(T.StringType()))
    keyed = F.from_json("value", T.StructType([T.StructField("ids", T.ArrayType(T.StringType()))]))["ids"]
    first = F.substring(F.trim("value"), 1, 1)
    ids = F.when(first == "[", array).when(first == "{", keyed).otherwise(F.split("value", r"\r?\n"))
    return whole.select(F.explode(ids).alias("id")).select(F.trim("id").alias("id")).where("id <> ''").distinct()


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: (id, title, summary, published, updated)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "summary", "published", "updated")])
    return spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)


def manual_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made bibliography snapshots with an ``error`` column; only ``complete`` = true counts."""
    rows = json_document(spark, path, f"snapshots array<struct<{schemas.SNAPSHOT}>>").select(F.inline("snapshots"))
    error = (
        F.when(~F.coalesce("complete", F.lit(False)), "incomplete")
        .when(~(F.coalesce("version", F.lit(0)) > 0), "version")
        .when(F.col("references").isNull() | (F.size("references") != F.size(F.array_distinct("references"))), "references")
    )
    return rows.withColumn("error", error).orderBy("arxivId", "version")


def strict(rows: DataFrame, what: str) -> DataFrame:
    """Rows without errors, or one exception that names the first of them."""
    bad = rows.where("error is not null").limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")
    return rows.drop("error")
