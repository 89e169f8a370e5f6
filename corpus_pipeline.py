"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``documents``, and extra columns of their input are
dropped. The order of the mixing stage is that of its files and their rows; the last stage reads it back as ``place``.

In all stages an empty table gives an empty result, and a row is judged by its own text: rows that share a doc_id,
or have none, each get a verdict of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import bpe, language_id, mixing, near_dups, quality_classifier
from folioscope.llm.filters import in_filter, key_filter
from folioscope.session import drop_tables, materialize, table, tables_made

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHORT = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too), and those like no learned language: a cosine within
    four standard deviations of chance (0.125 for 1024 dimensions). So few trigrams as those of texts below ``SHORT``
    characters can't tell, there only a cosine below 0.02 counts. Repeated rows all stay or all go; without any labelled
    language all go."""
    named = docs.select(*COLUMNS)
    prototypes = language_id.fit(named.where(language_id.fold(4) != 2))
    scored = language_id.predict(named, prototypes)
    least = F.when(F.length("text") < SHORT, 0.02).otherwise(4 / language_id.DIMS**0.5)
    return scored.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= least)).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score of quality is below 0.5. Null and empty texts are scored as the empty text; repeated
    rows all stay or all go; a document at 0.5 stays, so without labels of both kinds all stay unless more than half of the
    labels are 0."""
    scored = quality_classifier.with_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class. A row's identity is a hash of its doc_id and text, so rows that
    share an id but not their text are different documents; of repeated rows the smallest by all columns
    stays. Null and empty texts are one class.

    Documents that a filter of fixed size shows to be alone go through without a shuffle."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    classes = near_dups.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"))
    by_key = classes.groupBy(F.col("doc_id").alias("key")).agg(F.bool_or(F.col("class_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("n"))
    noted = materialize(by_key.where("n > 1 or not stays").select("key", "stays"), "noted")
    seen = F.broadcast(key_filter(noted, "key"))
    alone = keyed.join(seen, in_filter("key"), "left_anti")
    doubtful = keyed.join(seen, in_filter("key"), "left_semi").join(noted, "key", "left").where("coalesce(stays, true)")
    one = doubtful.groupBy("key", "doc_id", F.sha2("text", 256)).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return alone.select(*COLUMNS).unionByName(one.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources. A null source is a source of its own; nothing is
    dropped, repeated rows each have a place."""
    named = docs.select(*COLUMNS)
    return mixing.mixed_order(named, weights=mixing.target_weights(named)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its place (from 0) in the order of the files that the mixing stage wrote. Null and
    empty texts have no tokens; each of repeated rows is encoded."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    named = docs.select("doc_id", "text", number.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # one row a file; their number is that of the shuffle partitions
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy("part", "file").count().select("file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = named.join(F.broadcast(starts), "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("place"))
    encoded = bpe.encode_decode(placed, public_tokenizers.path("word_bpe_49k.json"), place_col="place")
    return encoded.select("doc_id", "n_tokens", "ids", "place")


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Models, hash sketches and tokenizers are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(spark, since, keep_last=1)  # the tables of the stage, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
