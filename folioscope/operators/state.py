"""State of an incremental catalogue as pure functions: old state and a batch give the new state.

Tables are append-only or replaced whole; ``commit`` writes a new version folder and the caller flips a
pointer, so a failed write leaves the old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.scan import scan


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows stay; of new keys the first row by all columns is added."""
    fresh = new.join(old.select(*key), key, "left_anti").groupBy(*key).agg(F.min(F.struct(*new.columns)).alias("__row")).select("__row.*")
    return old.unionByName(fresh)


def keep_only(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key), key, "left_semi")


def heads(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() if not str(o).endswith("DESC") else o for o in order])
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_seen(rows: DataFrame, key: str, when: str, what: str) -> DataFrame:
    """(key, when, what) of the earliest row, ties by ``what``."""
    return rows.groupBy(key).agg(F.min(F.struct(when, what)).alias("x")).select(key, f"x.{when}", f"x.{what}")


def record_batches(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch(source, batch_key, content_sha, ids_sha)`` against the stored ones: replayed where the same content is
    there, conflict where its ids were read otherwise, else new."""
    known = stored.select("source", "batch_key", "content_sha", F.col("ids_sha").alias("old_ids"))
    joined = batch.join(known, ["source", "batch_key", "content_sha"], "left")
    state = F.when(F.col("old_ids").isNull(), "new").when(F.col("old_ids") == F.col("ids_sha"), "replayed").otherwise("conflict")
    return joined.withColumn("state", state).drop("old_ids")


def observe(old: DataFrame, seen: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Versioned upsert with change detection.

    ``old(id, version, digest, status, reviewed)``, ``seen(id, version, digest)``, ``catalogue(id, published)``. A new
    row that the catalogue covers is relevant, any other pending; a changed digest makes it pending and
    keeps the digest last reviewed; the same digest keeps the status.
    """
    prior = old.select("id", "version", F.col("digest").alias("old_digest"), F.col("status").alias("old_status"), "reviewed")
    joined = seen.join(prior, ["id", "version"], "full_outer").join(catalogue, "id", "left")
    covered = F.coalesce(F.col("version") <= F.col("published"), F.lit(False))
    is_new, is_seen = F.col("old_digest").isNull(), F.col("digest").isNotNull()
    changed = is_seen & ~is_new & (F.col("digest") != F.col("old_digest"))
    status = (
        F.when(is_new & covered, "relevant").when(is_new, "pending").when(changed, "pending").otherwise(F.col("old_status"))
    )
    reviewed = F.when(is_new & covered, F.col("digest")).otherwise(F.col("reviewed"))
    return joined.select(
        "id", "version", F.coalesce("digest", "old_digest").alias("digest"), status.alias("status"), reviewed.alias("reviewed")
    )


def review_reason(
    status: Column, in_catalogue: Column, published: Column, version: Column, reviewed: Column, digest: Column, earlier: Column
) -> Column:
    """Why a row needs review; the first that holds."""
    return (
        F.when((status == "relevant") & ~in_catalogue, "accepted_unpublished")
        .when((status == "relevant") & (published.isNull() | (published < version)), "accepted_revision_unpublished")
        .when(status == "ambiguous", "ambiguous_unpublished")
        .when(reviewed.isNotNull() & (reviewed != digest), "metadata_changed")
        .when(earlier | in_catalogue, "new_version")
        .otherwise("new_paper")
    )


def promote(committed: DataFrame, staged: DataFrame, key: list[str], passed: Column) -> DataFrame:
    """Staged cursors replace committed ones where the gates pass."""
    return upsert(committed, staged.where(passed), key)


def previous(value: Column, key: str, order: str) -> Column:
    """Largest value on earlier rows of the key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(value).over(w)


def budget(first: DataFrame, then: DataFrame, limit: int) -> DataFrame:
    """Rows of ``first`` and after them of ``then`` (both with ``ord`` columns) up to ``limit``, with the unlimited
    total. The sort is a top-k, so no task sorts all rows."""
    return staged_budget(first.withColumn("stage", F.lit(1)).unionByName(then.withColumn("stage", F.lit(2))), limit)


def staged_budget(rows: DataFrame, limit: int) -> DataFrame:
    """``budget`` of rows that have a ``stage``; they are read twice."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy("stage", "ord", "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def commit(df: DataFrame, root: str, version: int) -> str:
    """A new folder for a new version; older ones stay."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def numbered(df: DataFrame, key: list[str], order: str, ties: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """``df`` with ``place``, from 1 within ``key`` in the order of the whole number ``order``, then ``ties``.

    Blocks of the order are counted, then places run within a block, so that no task numbers a whole key; a task holds the
    rows that share a block, and their number grows only where many share one value of ``order``. Nulls come first.
    """
    at = [*key, "__block"]
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*at).agg(F.count("*").alias("__n"))
    starts = counts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(at)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(order, *ties)).cast("long")
    same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(at)]
    placed = rows.withColumn("__in", inside).join(starts, same)
    return placed.select(*df.columns, (F.col("__start") + F.col("__in")).alias("place"))


def numbered_since(df: DataFrame, key: str, order: str, flag: Column, block: int = 4096) -> DataFrame:
    """``df`` with ``place`` as in ``numbered``, and ``last``: the place of the last earlier row with ``flag``, if there is one.

    A block's rows are numbered on their own; its count and last flagged place are summed up over blocks of the key.
    """
    at = [key, "__block"]
    inside = Window.partitionBy(*at).orderBy(order)
    rows = df.withColumns({"__block": F.floor(F.col(order) / block), "__flag": flag})
    rows = rows.withColumn("__in", F.row_number().over(inside).cast("long"))
    flagged = F.when(F.col("__flag"), F.col("__in"))
    rows = rows.withColumn("__last", F.max(flagged).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col(key).alias("__k"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n"), F.max(flagged).alias("__top"))
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    blocks = blocks.withColumn("__had", F.max(F.col("__start") + F.col("__top")).over(before)).drop("__n", "__top")
    joined = rows.join(blocks, F.col(key).eqNullSafe(F.col("__k")) & F.col("__block").eqNullSafe(F.col("__b")))
    return joined.select(*df.columns, (F.col("__start") + F.col("__in")).alias("place"), F.coalesce(F.col("__start") + F.col("__last"), F.col("__had")).alias("last"))


def catalogue_places(papers: DataFrame) -> DataFrame:
    """``papers(id, observation, published, ...)`` with ``place`` in catalogue order: observations, then by day and id. Only
    days are summed in one task."""
    day = papers.withColumns({"__late": ~F.coalesce("observation", F.lit(False)), "__day": F.unix_date("published")})
    within = numbered(day, ["__late", "__day"], "id")
    days = day.groupBy(F.col("__late").alias("__l"), F.col("__day").alias("__d")).agg(F.count("*").alias("__m"))
    before = Window.orderBy("__l", "__d").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(days.select("__l", "__d", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__from")))  # two rows a day
    met = within.join(starts, F.col("__late").eqNullSafe(F.col("__l")) & F.col("__day").eqNullSafe(F.col("__d")))
    return met.select(*papers.columns, (F.col("place") + F.col("__from")).alias("place"))


def snapshot_states(snapshots: DataFrame) -> DataFrame:
    """Each of ``snapshots(id, version, seq, sha, supersede)`` with what it does to its (id, version): 'new', 'replayed' (the
    head's content again), 'superseding', or 'conflict' (other content, which takes the head's place only on demand); and
    whether it is the head. Sequence numbers tell the snapshots of a version apart; a version may have any number of them."""
    rows = scan(snapshots.select("id", "version", "seq", "sha", "supersede"), ["id", "version"], ["seq"], {"before": ("count", F.lit(1))}, inclusive=False)
    first = F.col("before") == 0
    taken = F.when(first | F.coalesce("supersede", F.lit(False)), F.col("sha"))
    rows = scan(rows.withColumns({"first": first, "taken": taken}), ["id", "version"], ["seq"], {"had": ("last", F.col("taken"))}, inclusive=False)
    what = F.when(F.col("first"), "new").when(F.col("sha").eqNullSafe(F.col("had")), "replayed").when(F.col("taken").isNotNull(), "superseding").otherwise("conflict")
    newest = rows.groupBy(F.col("id").alias("__i"), F.col("version").alias("__v")).agg(F.max(F.when(F.col("taken").isNotNull(), F.col("seq"))).alias("newest"))
    joined = rows.join(newest, F.col("id").eqNullSafe(F.col("__i")) & F.col("version").eqNullSafe(F.col("__v")))
    return joined.select("id", "version", "seq", "sha", what.alias("state"), (F.col("seq") == F.col("newest")).alias("head"))
