"""Fail-closed rules: every rule gives (rule, key, detail) rows; all are shown before anything raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(df: DataFrame, name: str, bad: Column, key: str, detail: Column) -> DataFrame:
    return df.where(bad).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def rules(df: DataFrame, key: str, *each: tuple[str, Column, Column]) -> DataFrame:
    """``rule`` of several (name, bad, detail) in one pass over ``df``; only rows that break a rule are taken apart."""
    found = [F.when(bad, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, bad, detail in each]
    some = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, bad, _ in each])
    rows = df.where(some).select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("f.rule", "key", "f.detail")


def missing_key(df: DataFrame, name: str, column: str, parent: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    lost = df.join(parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")
    return lost.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"), F.col(column).cast("string").alias("detail"))


def duplicates(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    many = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return many.select(F.lit(name).alias("rule"), F.concat_ws("/", *key).alias("key"), F.col("n").cast("string").alias("detail"))


def not_contiguous(df: DataFrame, group: str, rank: str, first: int = 1) -> DataFrame:
    """Groups whose ranks aren't first..first+n-1, each once."""
    g = df.groupBy(group).agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count("*").alias("n"), F.countDistinct(rank).alias("d"))
    return g.where((F.col("lo") != first) | (F.col("d") != F.col("n")) | (F.col("hi") != F.col("n") + first - 1))


def together(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def enforce(violations: DataFrame, show: int = 20) -> None:
    """Raises with the first rows if there are any."""
    rows = violations.orderBy("rule", "key").limit(show + 1).collect()
    if rows:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} {r['detail']}" for r in rows[:show]))


def capped(df: DataFrame, limit: int, what: str) -> DataFrame:
    """``df``, or an error once it is read if it has more than ``limit`` rows: a safety cap never cuts."""
    total = df.agg(F.count("*").alias("__n"))
    over = F.raise_error(F.concat(F.lit(f"{what}: "), F.col("__n").cast("string"), F.lit(f" rows, at most {limit} allowed")))
    checked = total.select(F.when(F.col("__n") > limit, over.cast("long")).otherwise(F.col("__n")).alias("__n"))
    return df.crossJoin(F.broadcast(checked)).where("__n >= 0").drop("__n")  # one row


def matched(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """``left`` with the columns of ``right``; a row without a match is an error."""
    there = right.withColumn("__there", F.lit(True))
    joined = left.join(there, key, "left")
    lost = F.raise_error(F.concat(F.lit(f"{what}: nothing for "), F.col(key).cast("string")))
    return joined.withColumn("__there", F.when(F.col("__there"), True).otherwise(lost.cast("boolean"))).where("__there").drop("__there")


def count_changes(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(rule, key, detail) of values whose number of rows differs between two tables."""
    n = lambda df, name: df.groupBy(column).agg(F.count("*").alias(name))
    both = n(before, "was").join(n(after, "now"), column, "full_outer").na.fill(0, ["was", "now"])
    return both.where("was <> now").select(
        F.lit("count").alias("rule"), F.col(column).cast("string").alias("key"), F.concat_ws(" to ", F.col("was").cast("string"), F.col("now").cast("string")).alias("detail")
    )


def page_problems(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule, key, detail) of built pages ``(url, title, description, canonical, h1_count, links, types)`` against
    ``expected(url, title, type)``: pages missing or beyond, titles that differ or repeat, no description or one above 160
    characters, a canonical link that isn't the page's own, not one heading, a type that is lacking, links to pages that aren't there."""
    here = pages.select("url")
    lost = expected.select("url").join(here, "url", "left_anti")
    extra = here.join(expected.select("url"), "url", "left_anti")
    both = pages.join(expected.select("url", F.col("title").alias("wanted"), "type"), "url")
    links = pages.select("url", F.explode("links").alias("to")).where(F.startswith("to", F.lit("/")))
    broken = links.join(here.select(F.col("url").alias("to")), "to", "left_anti")
    chars = F.coalesce(F.length("description"), F.lit(0))
    return together(
        rule(lost, "missing page", F.lit(True), "url", F.lit("")),
        rule(extra, "unexpected page", F.lit(True), "url", F.lit("")),
        rule(both, "title", ~F.col("title").eqNullSafe(F.col("wanted")), "url", F.col("title")),
        rule(pages, "description", (chars == 0) | (chars > 160), "url", chars),
        rule(pages, "canonical", ~F.col("canonical").eqNullSafe(F.col("url")), "url", F.col("canonical")),
        rule(pages, "heading", F.col("h1_count") != 1, "url", F.col("h1_count")),
        rule(both, "type", ~F.coalesce(F.array_contains("types", F.col("type")), F.lit(False)), "url", F.col("type")),
        rule(broken, "broken link", F.lit(True), "url", F.col("to")),
        duplicates(pages, "repeated title", ["title"]),
    )


def first_failure(*gates: tuple[str, Column]) -> Column:
    """Name of the first gate that fails, else null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(gates):
        out = F.when(~ok, F.lit(name)).otherwise(out)
    return out


def membership_problems(papers: DataFrame) -> DataFrame:
    """(rule, key) of ``papers(id, contribution, role, primary, islands)``: an observation is one by contribution and by role,
    a paper has one island, none twice, and its primary one first."""
    seen = lambda c: F.coalesce(F.col(c) == "observation", F.lit(False))
    n = F.coalesce(F.size("islands"), F.lit(0))
    rules = {
        "role": seen("contribution") != seen("role"),
        "no island": n < 1,
        "one island": n > 1,
        "repeated island": n != F.size(F.array_distinct("islands")),
        "primary first": ~F.get("islands", F.lit(0)).eqNullSafe(F.col("primary")) & (n > 0),
    }
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return papers.select(F.explode(broken).alias("rule"), F.col("id").cast("string").alias("key"))


def completion(versions: DataFrame, catalogue: DataFrame, references: DataFrame, discoveries: DataFrame, log: DataFrame, lanes_done: Column, changes: int = 0) -> DataFrame:
    """One row: what stands between a run and its end, and the first reason in the gates' order.

    ``versions(id, version, digest, reviewed, status)``, ``catalogue(id, published)``, ``references(id, version)`` heads,
    ``discoveries(id)``, ``log(id, version, digest)``. Each table is read once and joined by id.
    """
    heads = references.select("id", "version").distinct()
    logged = log.select("id", "version", "digest").distinct().withColumn("logged", F.lit(True))
    rows = versions.join(catalogue, "id", "left").join(heads.withColumn("held", F.lit(True)), ["id", "version"], "left").join(logged, ["id", "version", "digest"], "left")
    settled = F.col("reviewed") == F.col("digest")
    waits = (F.col("status") == "relevant") & settled & F.coalesce(F.col("published") < F.col("version"), F.lit(True))
    of_versions = rows.agg(
        F.count_if((F.col("status") == "pending") | ~F.coalesce(settled, F.lit(False))).alias("pending"),
        F.count_if(waits & F.col("held").isNull()).alias("unreferenced"),
        F.count_if(waits).alias("unpublished"),
        F.count_if((F.col("status") == "ambiguous") & settled & F.col("logged").isNull()).alias("unlogged"),
    )
    mapped = catalogue.join(heads.select("id", F.col("version").alias("published"), F.lit(True).alias("held")), ["id", "published"], "left")
    unmapped = mapped.agg(F.count_if(F.col("published").isNull() | F.col("held").isNull()).alias("unmapped"))
    known = catalogue.select("id").union(versions.select("id"))
    unhydrated = discoveries.select("id").join(known, "id", "left_anti").agg(F.count("*").alias("unhydrated"))
    one = of_versions.crossJoin(F.broadcast(unmapped)).crossJoin(F.broadcast(unhydrated))  # one row each
    none = lambda c: F.col(c) == 0
    failed = first_failure(
        ("lanes", lanes_done), ("review", none("pending") & none("unhydrated")), ("references", none("unreferenced")), ("mapped references", none("unmapped")),
        ("unpublished", none("unpublished") | F.lit(changes > 0)), ("ambiguous", none("unlogged") | F.lit(changes > 0)),
    )
    return one.withColumn("first_failure", failed)
