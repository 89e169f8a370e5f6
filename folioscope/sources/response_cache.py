"""Responses kept by address, with what a fetcher needs: what to do about each request, and the answers taken in.

The store is a table in buckets of addresses, so a round of requests reads the buckets it meets and its answers rewrite those.
Nothing here speaks to a network: requests and answers are tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import harvest
from folioscope.sources.buckets import BucketTable

KIND = "url string, fetched_at timestamp, etag string, last_modified string, mime string, body string, sha string"
NAMES = [f.split()[0] for f in KIND.split(", ")]


class ResponseCache:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, **rules):
        """``rules`` are those of ``harvest.cache_action``: fresh_seconds, most_bytes, hosts."""
        self.table = BucketTable(spark, root, ["url"], KIND, buckets)
        self.rules = rules

    def held(self, requests: DataFrame) -> DataFrame:
        """The stored rows of the requested addresses."""
        urls = requests.select("url").distinct()
        return self.table.read(self.table.touched(urls)).join(urls, "url", "left_semi")

    def plan(self, requests: DataFrame, now: Column) -> DataFrame:
        """(url, action, etag, last_modified, body) of each distinct request: reject, use (with the body), revalidate (with the
        validators to send) or fetch."""
        rows = requests.select("url").distinct().join(self.held(requests), "url", "left")
        judged = harvest.cache_action(rows, now, **self.rules)
        ask = F.col("action") == "revalidate"
        return judged.select(
            "url", "action", F.when(ask, F.col("etag")).alias("etag"), F.when(ask, F.col("last_modified")).alias("last_modified"),
            F.when(F.col("action") == "use", F.col("body")).alias("body"),
        )

    def judge(self, answers: DataFrame) -> DataFrame:
        """``answers(url, status, at, etag, last_modified, mime, body)``, the latest of each address, with ``outcome``: stored (a
        200 of an allowed host, type and size), confirmed (a 304 whose stored body is whole), or the reason why nothing changes."""
        newest = answers.groupBy("url").agg(F.max(F.struct("at", "status", "etag", "last_modified", "mime", "body")).alias("r")).select("url", "r.*")
        old = self.held(newest).select("url", F.struct("etag", "last_modified", "mime", "body", "sha").alias("old"))
        fresh = newest.join(old, "url", "left").withColumns({"fetched_at": F.col("at"), "sha": F.sha2("body", 256)})
        judged = harvest.cache_action(fresh, F.col("at"), **self.rules)
        whole = F.coalesce(F.sha2("old.body", 256) == F.col("old.sha"), F.lit(False))
        outcome = (
            F.when((F.col("status") == 304) & whole, "confirmed")
            .when(F.col("status") == 304, "nothing to confirm")
            .when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
            .when(F.col("action") == "reject", "rejected")
            .when(F.col("body").isNull(), "no body")
            .otherwise("stored")
        )
        return judged.withColumn("outcome", outcome)

    def absorb(self, answers: DataFrame) -> list[int]:
        """Takes the answers in; returns the buckets rewritten. A confirmed response keeps its body, takes the answer's time and
        its validators where it names new ones."""
        judged = self.judge(answers).where("outcome in ('stored', 'confirmed')")
        again = F.col("outcome") == "confirmed"
        pick = lambda c: F.when(again, F.coalesce(F.col(c), F.col(f"old.{c}"))).otherwise(F.col(c)).alias(c)
        kept = lambda c: F.when(again, F.col(f"old.{c}")).otherwise(F.col(c)).alias(c)
        return self.table.upsert(judged.select("url", "fetched_at", pick("etag"), pick("last_modified"), kept("mime"), kept("body"), kept("sha")))

    def sweep(self, urls: Iterable[str] | DataFrame) -> list[int]:
        """Only these addresses stay."""
        rows = urls if isinstance(urls, DataFrame) else self.table.spark.createDataFrame([(u,) for u in urls], "url string")
        return self.table.keep_only(rows)
