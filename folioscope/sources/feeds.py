"""Atom feeds as nested documents read in the JVM: repeated authors, categories and links that live in attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text

ENTRY = (
    "struct<id: string, title: string, summary: string, published: string, updated: string, author: array<struct<name: string>>, "
    "category: array<struct<_term: string>>, link: array<struct<_href: string, _rel: string, _title: string>>>"
)
FEED = f"entry array<{ENTRY}>"


def is_feed(xml: Column) -> Column:
    """Whether the root element is an Atom feed: after declaration and comments a <feed> of that namespace."""
    return F.coalesce(xml.rlike(r"(?s)^\s*(?:<\?.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?feed\b[^>]*\"http://www\.w3\.org/2005/Atom\""), F.lit(False))


def entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row an entry of each feed in ``feeds``, beside that feed's other columns: id, title, authors, abstract, published,
    updated, categories, url, pdf, place (from 0) and error. A feed that can't be read, isn't one or is empty gives one row with
    its error; an entry without an identifier is an error too."""
    kept = [F.col(c) for c in feeds.columns if c != xml]
    # a prefix of the root's children says nothing more than the namespace does
    plain = F.regexp_replace(xml, r"<(/?)\w+:(feed|entry|id|title|summary|published|updated|author|name|category|link)\b", "<$1$2")
    read = feeds.withColumn("__is", is_feed(F.col(xml))).withColumn("__feed", F.from_xml(plain, FEED, {"mode": "PERMISSIVE"}))
    found = F.coalesce(F.col("__feed.entry"), F.array().cast(f"array<{ENTRY}>"))
    why = F.when(~F.col("__is"), "no feed").when(F.size(found) == 0, "empty feed")
    rows = read.select(*kept, why.alias("__why"), F.posexplode_outer(F.when(F.col("__is"), found)).alias("place", "e"))
    e = lambda name: text.collapse_spaces(F.coalesce(F.col(f"e.{name}"), F.lit("")))
    said = text.normalize_id(e("id"))
    list_of = lambda name, field: F.filter(F.transform(F.coalesce(F.col(f"e.{name}"), F.array()), lambda x: text.collapse_spaces(F.coalesce(x[field], F.lit("")))), lambda v: v != "")
    pdf = F.filter(F.col("e.link"), lambda x: x["_title"] == "pdf")
    error = F.coalesce(F.col("__why"), F.when(said["id"].isNull(), "no identifier"))
    return rows.select(
        *[F.col(c) for c in feeds.columns if c != xml], "place", said["id"].alias("id"), e("title").alias("title"), list_of("author", "name").alias("authors"),
        e("summary").alias("abstract"), F.substring(e("published"), 1, 10).alias("published"), F.substring(e("updated"), 1, 10).alias("updated"),
        list_of("category", "_term").alias("categories"), F.concat(F.lit("https://arxiv.org/abs/"), said["id"]).alias("url"),
        F.get(pdf, F.lit(0))["_href"].alias("pdf"), error.alias("error"),
    )


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``entries`` of the feeds in files; any error in them is raised, so that what is held stays untouched."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml"))
    rows = entries(files)
    bad = rows.where("error is not null").select("file", "error").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}: {r['error']}" for r in bad))
    return rows.drop("error")
