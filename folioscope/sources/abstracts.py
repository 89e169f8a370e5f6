"""Abstract pages as columns: metadata, history and the reason for which a page is refused, all in the JVM.

A page is read by its <meta> elements; title, authors and abstract may also stand in elements of those classes, under a
label. The history is every "[vN] day and time" of the visible text; times become UTC, and days are those of UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import dates, text

def _once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of an opening tag's inside; '' if there is none."""
    return F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*([\"'])(.*?)\1", 2)


def metas(html: Column) -> Column:
    """array<struct<name, content>> of all <meta> elements, names in lower case."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), F.lit(1))

    def one(tag: Column) -> Column:
        named = _once(attribute(tag, "name"), lambda name: F.when(name != "", name).otherwise(attribute(tag, "property")))
        return F.struct(F.lower(named).alias("name"), text.collapse_spaces(text.decode_entities(attribute(tag, "content"))).alias("content"))

    return F.transform(tags, one)


def contents(found: Column, name: str) -> Column:
    return F.transform(F.filter(found, lambda m: m["name"] == name), lambda m: m["content"])


def labelled(html: Column, css_class: str, label: str) -> Column:
    """The text of the first element of a class, without its label; null if there is none."""
    element = rf"(?is)<(\w+)\b[^>]*\bclass\s*=\s*[\"'][^\"'>]*\b{css_class}\b[^\"'>]*[\"'][^>]*>(.*?)</\1>"
    said = F.regexp_replace(text.visible_text(F.regexp_extract(html, element, 2)), rf"(?i)^{label}\s*:\s*", "")
    return _once(said, lambda x: F.when(x != "", x))  # no element gives none


def history(html: Column) -> Column:
    """array<struct<version, submitted_at>> in the order of the page; a time that can't be read is null."""
    entry = r"\[v(\d+)\]\s*((?:[A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (?:[A-Z]{1,4}|[+\-]\d{4}))"

    def read(shown: Column) -> Column:
        versions = F.regexp_extract_all(shown, F.lit(entry), F.lit(1))
        times = F.regexp_extract_all(shown, F.lit(entry), F.lit(2))
        return F.transform(versions, lambda v, i: F.struct(v.cast("long").alias("version"), dates.submission_second(F.get(times, i)).alias("submitted_at")))

    return _once(text.visible_text(html), read)


def abstract_pages(pages: DataFrame, html: str = "html", expected: str | None = None) -> DataFrame:
    """``pages`` without ``html``, with id, version, title, authors, abstract, submitted, updated, history, primary_category, subjects
    and error; where there is an error all others are null. ``expected`` names the column with the id that was asked for."""
    h = F.col(html)
    raw = pages.withColumns({"__metas": metas(h), "__history": history(h)})
    m, told = F.col("__metas"), F.col("__history")
    first = lambda *names: F.coalesce(*[F.get(contents(m, n), F.lit(0)) for n in names])
    link = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<link\b([^>]*)>"), F.lit(1)), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    canonical = F.regexp_extract(attribute(F.get(link, F.lit(0)), "href"), r"(?i)/abs/(.+)$", 1)
    named = contents(m, "citation_author")
    parted = F.filter(F.transform(F.split(labelled(h, "authors", "Authors"), ","), lambda w: F.trim(w)), lambda a: a != "")
    words = F.flatten(F.transform(contents(m, "citation_keywords"), lambda k: F.split(k, ";")))
    subjects = F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w)), lambda s: s != "")))
    rows = raw.withColumns(
        {
            "__id": text.normalize_id(F.coalesce(first("citation_arxiv_id"), F.when(canonical != "", canonical)))["id"],
            "__title": F.coalesce(first("citation_title"), labelled(h, "title", "Title")),
            "__authors": F.when(F.size(named) > 0, named).otherwise(F.coalesce(parted, F.array().cast("array<string>"))),
            "__abstract": F.coalesce(first("citation_abstract", "og:description"), labelled(h, "abstract", "Abstract")),
            "__category": first("citation_primary_category"),
            "__subjects": subjects,
        }
    )
    lacks = F.concat_ws(
        ", ",
        F.when(F.coalesce(F.col("__title"), F.lit("")) == "", "title"), F.when(F.size("__authors") == 0, "authors"),
        F.when(F.coalesce(F.col("__abstract"), F.lit("")) == "", "abstract"),
    )
    n = F.size(told)
    in_turn = (n > 0) & (F.transform(told, lambda e: e["version"]) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))).cast("array<bigint>"))
    wanted = text.normalize_id(F.col(expected))["id"] if expected else F.col("__id")
    error = (
        F.when(F.col("__id").isNull(), "no identity")
        .when(~F.col("__id").eqNullSafe(wanted), F.concat(F.lit("another paper: "), F.col("__id")))
        .when(lacks != "", F.concat(F.lit("lacks "), lacks))
        .when(~F.coalesce(in_turn, F.lit(False)), "history has gaps")
        .when(F.exists(told, lambda e: e["submitted_at"].isNull()), "history without a time")
    )
    day = lambda at: F.substring(F.get(told, at)["submitted_at"], 1, 10).cast("date")
    good = lambda c: F.when(F.col("error").isNull(), c)
    named_error = rows.withColumn("error", error)
    return named_error.select(
        *[c for c in pages.columns if c not in (html, "error")],
        good(F.col("__id")).alias("id"), good(F.get(told, n - 1)["version"]).alias("version"), good(F.col("__title")).alias("title"),
        good(F.col("__authors")).alias("authors"), good(F.col("__abstract")).alias("abstract"), good(day(F.lit(0))).alias("submitted"),
        good(day(n - 1)).alias("updated"), good(told).alias("history"), good(F.col("__category")).alias("primary_category"),
        good(F.col("__subjects")).alias("subjects"), "error",
    )
