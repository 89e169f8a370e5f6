"""Catalogue search, facets and date windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import date

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import dates
from folioscope.session import find_package

ALL = "all"


def text_hit(text: Column, query: str) -> Column:
    """Substring test on normalised text; an empty query passes all, a row without text passes no other."""
    return F.lit(True) if not query else F.coalesce(F.contains(text, F.lit(query)), F.lit(False))


def filter_catalog(
    papers: DataFrame,
    query: str = "",
    island: str = ALL,
    contribution: str = ALL,
    window: tuple[date, date] | None = None,
) -> DataFrame:
    """AND of the facets given; columns text, island, contribution, published."""
    keep = F.lit(True)
    if island != ALL:
        keep = keep & (F.col("island") == island)
    if contribution != ALL:
        keep = keep & (F.col("contribution") == contribution)
    if window:
        keep = keep & dates.in_range(F.col("published"), F.lit(window[0]), F.lit(window[1]))
    if query:
        keep = keep & text_hit(F.col("text"), query)
    return papers.where(keep)


def containing(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, item_id) of ``texts(doc_id, t)`` that contain the text of ``aliases(item_id, a)``, by equi-joins.

    An alias of three words or more holds its inner words whole, and so does any text that contains it: the longest
    one is the key. A shorter alias is met by its first characters, three at most, and only if there is one are texts taken
    apart into characters. Pairs move as ids; a text is fetched once they are known, and tested whole.
    """
    parts = F.split(F.trim("a"), r"[ \n]+")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = aliases.where("a is not null").select("item_id", "a", key.alias("w"), F.least(F.length("a"), F.lit(3)).alias("n"))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("t", r"[ \n]+"))).alias("w"))
    pairs = words.join(keyed.where("w is not null").select("w", "item_id", "a"), "w").select("doc_id", "item_id", "a")
    for n in sorted(r["n"] for r in keyed.where("w is null").select("n").distinct().collect()):  # four values at most
        last = F.length("t") - n + 1
        pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr("t", i, F.lit(n)))  # noqa: B023
        pieces = F.when(F.lit(n == 0), F.array(F.lit(""))).when(last > 0, F.array_distinct(pieces))
        heads = keyed.where((F.col("w").isNull()) & (F.col("n") == n)).select(F.substring("a", 1, n).alias("w"), "item_id", "a")
        grams = texts.select("doc_id", F.explode(pieces).alias("w"))
        pairs = pairs.union(grams.join(heads, "w").select("doc_id", "item_id", "a"))
    return texts.join(pairs.distinct(), "doc_id").where(F.contains("t", "a")).select("doc_id", "item_id").distinct()


def matching(texts: DataFrame, aliases: DataFrame, most_chars: int = 1 << 24) -> DataFrame:
    """The rows of ``containing``, by one automaton over all aliases for each Python worker: a pass over the texts, no row for a word and
    no join. The aliases are broadcast once their size is known to be at most ``most_chars``; more of them are joined by words."""
    spark = texts.sparkSession
    said = aliases.where("a is not null").select("item_id", "a")
    if (said.agg(F.sum(F.length("a") + 32)).first()[0] or 0) > most_chars:
        return containing(texts, aliases)
    by_text: dict[str, list] = {}
    for r in said.collect():
        by_text.setdefault(r["a"], []).append(r["item_id"])
    found_anywhere = by_text.pop("", [])
    find_package(spark)
    named = spark.sparkContext.broadcast((uuid.uuid4().hex, by_text, found_anywhere))
    kinds = {**dict(texts.dtypes), **dict(aliases.dtypes)}
    item = pa.array([x for ids in [*by_text.values(), found_anywhere] for x in ids[:1]][:1]).type if by_text or found_anywhere else pa.null()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, always = named.value
        machine = automaton(key, words)
        for b in batches:
            at, items = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is not None:
                    met = {*always}
                    for _, ids in machine.iter(t) if len(machine) else ():
                        met.update(ids)
                    at += [i] * len(met)
                    items += met
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(items, item)], ["doc_id", "item_id"])

    return texts.select("doc_id", "t").mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}").distinct()


_MACHINES: dict[str, ahocorasick.Automaton] = {}  # the last one of this worker


def automaton(key: str, words: dict[str, list]) -> ahocorasick.Automaton:
    """The automaton of ``words``, made once a worker."""
    if key not in _MACHINES:
        machine = ahocorasick.Automaton()
        for word, ids in words.items():
            machine.add_word(word, ids)
        machine.make_automaton()
        _MACHINES.clear()
        _MACHINES[key] = machine
    return _MACHINES[key]


def facet_counts(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """(value, n) over ``rows``, 0 for a value of the enumeration that has none."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.select("value").join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def day_histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(dates.day_index(F.to_date(column)).cast("long").alias("day")).agg(F.count("*").alias("n"))


def histogram_peak(histogram: DataFrame) -> DataFrame:
    """(peak): the largest count, 1 at least, so that bars can be scaled by it."""
    return histogram.agg(F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(1))).alias("peak"))


def date_bounds(rows: DataFrame, column: str) -> DataFrame:
    """(low, high); no rows is an error."""
    day = F.to_date(column)
    ends = rows.agg(F.min(day).alias("low"), F.max(day).alias("high"))
    return ends.select(F.coalesce("low", F.raise_error(F.lit("no dates")).cast("date")).alias("low"), "high")


def pick(rows: DataFrame, selected: Column, visible: Column, order: str) -> DataFrame:
    """One row: the selected one if visible, else the first visible, else the selected, else the first."""
    rank = F.when(selected & visible, 0).when(visible, 1).when(selected, 2).otherwise(3)
    return rows.orderBy(rank, order).limit(1)
