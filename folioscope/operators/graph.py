"""Citation-graph operators over ``papers(id)`` and ``cites(src, dst)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped_edges(cites: DataFrame, papers: DataFrame, distinct: bool = True) -> DataFrame:
    """Edges between papers of the catalogue; ``distinct`` also drops repeats and self-citations."""
    edges = cites.select("src", "dst").where("src <> dst") if distinct else cites.select("src", "dst")
    ids = papers.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    edges = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return edges.distinct() if distinct else edges  # of what the semi-joins leave


def incoming_counts(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, n) with 0 for papers nobody cites."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return papers.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def cited_by(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(id, ids): who cites each cited paper, in id order or that of ``order(id, pos)``."""
    if order is None:
        keyed = edges.select("dst", F.struct(F.col("src").alias("pos"), "src").alias("x"))
    else:
        keyed = edges.join(order.select(F.col("id").alias("src"), "pos"), "src").select("dst", F.struct("pos", "src").alias("x"))
    lists = keyed.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select("id", F.transform("xs", lambda x: x["src"]).alias("ids"))


def fan_out(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(id, list)`` resolved against ``papers(id, value)`` in list order, misses dropped."""
    rows = wanted.select("id", F.posexplode("list").alias("pos", "ref"))
    hits = rows.join(papers.select(F.col("id").alias("ref"), "value"), "ref")
    got = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("xs"))
    return got.select("id", F.transform("xs", lambda x: x["value"]).alias("values"))


def snapshot_status(papers: DataFrame, observed: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, expected, status) from ``papers(id, version)``, ``observed(id, version)`` and ``heads(id, version)``.

    The version expected is the larger of the observed and the catalogue's. A head at it is exact; only
    others is stale; none is missing; nothing expected is unknown.
    """
    # one aggregate and one join for both, so a task sorts once for them
    none = F.lit(None)
    told = observed.select("id", F.col("version").alias("seen"), none.alias("head"), F.lit(False).alias("is_head"))
    told = told.unionByName(heads.select("id", none.alias("seen"), F.col("version").alias("head"), F.lit(True).alias("is_head")))
    got = told.groupBy("id").agg(F.max("seen").alias("seen"), F.collect_set("head").alias("versions"), F.max("head").alias("newest"), F.max("is_head").alias("held"))
    got = got.withColumn("versions", F.when(F.col("held"), F.col("versions")))
    joined = papers.join(got, "id", "left")
    expected = F.greatest("version", "seen")
    status = (
        F.when(expected.isNull(), "unknown")
        .when(F.col("versions").isNull(), "missing")
        .when(F.array_contains("versions", expected), "exact")
        .otherwise("stale")
    )
    return joined.select("id", expected.alias("expected"), status.alias("status"), "newest")


def mapped_citations(status: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of exact heads only: ``refs(id, version, ref)`` at the expected version, mapped, self dropped."""
    exact = status.where("status = 'exact'").select("id", F.col("expected").alias("version"))
    picked = refs.join(exact, ["id", "version"]).select(F.col("id").alias("src"), F.col("ref").alias("dst"))
    return mapped_edges(picked, status.select("id"))


def reference_targets(status: DataFrame, accepted: DataFrame, explicit: DataFrame) -> DataFrame:
    """What to fetch next: gaps, accepted but unpublished versions and explicit ids; an id without a version
    gives way to the same id with one."""
    gaps = status.where("status in ('missing', 'stale')").select("id", F.col("expected").alias("version"))
    wanted = gaps.unionByName(accepted.select("id", "version")).unionByName(explicit.select("id", "version"))
    # an id's versions are few; one without any gives a row without one
    targets = wanted.groupBy("id").agg(F.collect_set("version").alias("versions")).select("id", F.explode_outer("versions").alias("version"))
    return targets.orderBy("id", F.coalesce("version", F.lit(-1)))


def projection_digests(papers: DataFrame, edges: DataFrame, block: int = 4096) -> DataFrame:
    """(block, n, digest) of the catalogue that a layout depends on: ``papers(id, ...)`` in id order, each with its sorted
    citations. Rows are digested by blocks of ids and the blocks' digests make that of block -1, the whole, so the largest
    task reads one block or one digest a block."""
    cites = edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("dst").cast("string"))), ",").alias("cites"))
    rest = [c for c in papers.columns if c != "id"]
    row = F.concat_ws("|", F.col("id").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest], F.coalesce("cites", F.lit("")))
    rows = papers.join(cites, "id", "left").select(F.floor(F.col("id") / block).alias("block"), F.struct("id", F.sha2(row, 256).alias("sha")).alias("x"))
    joined = lambda xs: F.array_join(F.transform(F.array_sort(F.collect_list(xs)), lambda x: x["sha"]), "")
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.sha2(joined("x"), 256).alias("digest"))
    ordered = F.struct("block", F.col("digest").alias("sha"))
    whole = blocks.agg(F.lit(-1).cast("long").alias("block"), F.sum("n").alias("n"), F.sha2(joined(ordered), 256).alias("digest"))
    return blocks.unionByName(whole)
