"""Tables in buckets of keys, of which a change rewrites only those it meets.

A bucket is a hash of the key. A change writes the new content of its buckets under a version of its own and then flips one small
manifest (bucket to version) by a rename, so readers see the old table or the new one, and a job that dies leaves the
old one. Buckets that a change doesn't meet keep their files. Older versions stay until ``vacuum``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import state
from folioscope.sources.sinks import Shared

BUCKET = "__bucket"


class BucketTable:
    """One writer at a time. ``key`` tells rows apart; ``schema`` is that of the rows, as DDL."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.root, self.key, self.schema, self.buckets = spark, root.rstrip("/"), key, schema, buckets
        self.shared = Shared(spark, root)
        self.columns = spark.createDataFrame([], schema).columns

    def manifest(self) -> dict:
        """{"version": newest, "at": {bucket: version}}; one entry a bucket."""
        path = f"{self.root}/manifest.json"
        return json.loads(self.shared.read(path)) if self.shared.exists(path) else {"version": 0, "buckets": self.buckets, "at": {}}

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.manifest()["buckets"])).cast("int"))

    def paths(self, only: list[int] | None = None) -> list[str]:
        at = self.manifest()["at"]
        return [f"{self.root}/v={v}/{BUCKET}={b}" for b, v in sorted(at.items(), key=lambda x: int(x[0])) if v and (only is None or int(b) in only)]

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = self.paths(only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with these keys lie in: as many as there are buckets at most."""
        return sorted(r[0] for r in self.bucketed(rows.select(*self.key)).select(BUCKET).distinct().collect())

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """``rows`` become the content of ``buckets``."""
        if not buckets:
            return
        now = self.manifest()
        version = now["version"] + 1
        path = f"{self.root}/v={version}"
        # a job that died may have left this folder: it is no part of the table
        self.bucketed(rows.select(*self.columns)).repartition(len(buckets), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        filled = {b for b in buckets if self.shared.exists(f"{path}/{BUCKET}={b}")}
        at = now["at"] | {str(b): version if b in filled else None for b in buckets}
        self.shared.write(f"{self.root}/manifest.json", json.dumps({"version": version, "buckets": now["buckets"], "at": at}))

    def _change(self, batch: DataFrame, how) -> list[int]:
        buckets = self.touched(batch)
        self.replace(how(self.read(buckets), batch.select(*self.columns), self.key), buckets)
        return buckets

    def upsert(self, batch: DataFrame) -> list[int]:
        """Rows of ``batch`` (a row a key) replace those of their keys; returns the buckets rewritten."""
        return self._change(batch, state.upsert)

    def insert_ignore(self, batch: DataFrame) -> list[int]:
        """Rows of new keys are added, the first by all columns of each; buckets without a new key aren't rewritten."""
        fresh = batch.join(self.read(self.touched(batch)).select(*self.key), self.key, "left_anti")
        return self._change(fresh, state.insert_ignore)

    def keep_only(self, keys: DataFrame) -> list[int]:
        """Rows of other keys go; buckets that lose none aren't rewritten."""
        buckets = self.touched(self.read().select(*self.key).join(keys.select(*self.key), self.key, "left_anti"))
        self.replace(state.keep_only(self.read(buckets), keys, self.key), buckets)
        return buckets

    def promote(self, staged: DataFrame, passed: bool) -> list[int]:
        """Staged rows replace committed ones if the gates have passed."""
        return self.upsert(staged) if passed else []

    def vacuum(self) -> int:
        """Removes the folders that the manifest no longer names; no reader may still use them."""
        used, gone = {*self.paths()}, 0
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for version in self.shared.fs.listStatus(hadoop.Path(self.root)):
            if version.isDirectory():
                for bucket in self.shared.fs.listStatus(version.getPath()):
                    name = f"{self.root}/{version.getPath().getName()}/{bucket.getPath().getName()}"
                    if name not in used and bucket.isDirectory():
                        gone += self.shared.fs.delete(bucket.getPath(), True)
        return gone
