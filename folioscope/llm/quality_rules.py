"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over a language's common words
are compared with references by Jensen-Shannon distance (the root of the divergence in bits). A
reference is the sum of all documents of a language; a document takes the language it is nearest to.
Guards: texts with fewer than 50 words fail the base rules, and the word distance has no say
below ``least_words`` words or without any reference.

Per-document counts are made in one pass over the texts and written as a small table, from
which references, distances and verdicts follow.

A document in a language without a list of common words is held against the languages that have one and is as a rule
rejected as unlike all of them; add its list to COMMON.

Defined results: null has no words and fails; without a labelled language only the base rules decide;
repeated rows, rows that share an id and rows without one each get a row of their own text; a text of any length is counted whole;
an empty table gives an empty result; own columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize

BLANK = r"[\x20\x09-\x0D]+"

#: Fixed lists of common words by language code.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "with", "as", "be", "by", "this", "are", "or", "an", "at", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
CLASSES = ("lower", "blank", "stop", "symbol", "upper", "digit", "foreign", "other")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, base counts, classes array<long>, common array<struct<word, n>>)."""
    t = F.coalesce("text", F.lit(""))
    cut = lambda c, pattern: F.regexp_replace(c, pattern, "")
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), t.alias("t"))
    df = df.withColumn("words", F.array_remove(F.split("t", BLANK), "")).withColumn(
        "lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    steps = (("x1", "t", "[a-z]+"), ("x2", "x1", BLANK), ("x3", "x2", "[.,]+"), ("x4", "x3", "[#*$%&|<>]+"),
             ("x5", "x4", "[A-Z]+"), ("x6", "x5", "[0-9]+"), ("x7", "x6", r"[^\x00-\x7F]+"))
    for new, old, pattern in steps:
        df = df.withColumn(new, cut(F.col(old), pattern))
    chain = ["t", "x1", "x2", "x3", "x4", "x5", "x6", "x7"]
    gone = [F.length(a) - F.length(b) for a, b in zip(chain, chain[1:])]
    everyday = sorted({w for words in COMMON.values() for w in words})
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<long>"))
    df = df.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        (F.length("t") - gone[1]).cast("long").alias("word_chars"),
        gone[3].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[g.cast("long") for g in gone], F.length("x7").cast("long")).alias("classes"),
        F.sort_array(F.filter(F.transform("words", F.lower), lambda w: w.isin(everyday))).alias("found"),
        windows.alias("h"),
    )
    df = df.withColumn("repeats", F.size("h") > F.size(F.array_distinct("h")))
    # a window's place takes the low bits of its hash, so one sort of plain longs brings equal
    # windows together; the full hashes are compared where the high bits agree
    shift = lambda name, x: F.call_function(name, x, F.col("bits"))
    bits = F.ceil(F.log2(F.size("h") + 1)).cast("int")
    packed = F.when(
        F.col("repeats"),
        F.sort_array(
            F.transform(
                "h", lambda x, i: shift("shiftleft", shift("shiftright", x)).bitwiseOR(i.cast("long"))
            )
        ),
    ).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("bits", bits).withColumn("s", packed)
    place = lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        near = shift("shiftright", x) == shift("shiftright", y)
        return near & (F.get("h", place(x)) == F.get("h", place(y)))

    twice = F.filter(
        "s", lambda x, i: F.coalesce(same(x, F.get("s", i + 1)), F.lit(False)) | ((i > 0) & F.coalesce(same(x, F.get("s", F.greatest(i - 1, F.lit(0)))), F.lit(False)))
    )
    df = df.withColumn("p", F.sort_array(F.transform(twice, place)))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    distinct = F.array_distinct("found")
    df = df.withColumn("n_repeat_words", covered).withColumn("kinds", distinct)
    upto = lambda i: F.coalesce(F.array_position("found", F.get("kinds", i)), F.lit(0))
    common = F.transform(
        "kinds",
        lambda w, i: F.struct(
            w.alias("word"), (F.when(i + 1 < F.size("kinds"), upto(i + 1)).otherwise(F.size("found") + 1) - upto(i)).cast("long").alias("n")
        ),
    )
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", common.alias("common")
    )


def references(table: DataFrame, most: int = 64) -> list[dict]:
    """Character-class and common-word shares of each language, from all its documents; a row a language."""
    known = table.where(F.col("lang").isin([*COMMON]))
    sums = known.groupBy("lang").agg(
        *[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)], F.sum("n_words").alias("words")
    )
    words = known.select("lang", F.inline("common")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in words.collect():  # at most the fixed lists' words for each of their languages
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    out = []
    for r in sorted(sums.limit(most).collect()):
        total, words_ = sum(r[c] or 0 for c in CLASSES), r["words"] or 0
        if total and words_:
            mine = {w: counts.get(r["lang"], {}).get(w, 0) / words_ for w in COMMON[r["lang"]]}
            out.append({"lang": r["lang"], "classes": [r[c] / total for c in CLASSES], "words": mine})
    return out


def _term(p: Column, q: Column) -> Column:
    """One bin's part of the divergence, in bits."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return (half(p, q) + half(q, p)) / 2


def distances(ref: dict) -> tuple[Column, Column]:
    """Jensen-Shannon distances of a feature row to one language: of classes, of common words."""
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = sum((_term(F.col("classes")[i] / total, F.lit(q)) for i, q in enumerate(ref["classes"])), F.lit(0.0))
    shares = F.create_map(*[F.lit(x) for w, q in ref["words"].items() for x in (w, float(q))])
    mine = F.filter("common", lambda c: c["word"].isin([*ref["words"]]))
    seen = F.aggregate(mine, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    in_lists = sum(ref["words"].values())
    over = F.aggregate(
        mine,
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")),
        lambda a, c: F.struct(
            (a["d"] + _term(c["n"] / F.col("n_words"), F.element_at(shares, c["word"]))).alias("d"),
            (a["q"] + F.element_at(shares, c["word"])).alias("q"),
        ),
    )
    # words of the list that the document lacks give half their share each; the last bin has all other words
    rest = _term(1 - seen / F.col("n_words"), F.lit(1 - in_lists))
    by_word = over["d"] + F.greatest(F.lit(in_lists) - over["q"], F.lit(0.0)) / 2 + rest
    return F.sqrt(F.greatest(by_class, F.lit(0.0))), F.sqrt(F.greatest(by_word, F.lit(0.0)))


def judge(
    docs: DataFrame,
    most_class: tuple[float, float] = (0.22, 0.7),
    most_word: tuple[float, float] = (0.17, 1.3),
    least_words: int = 80,
    base_words: int = 50,
) -> DataFrame:
    """Counts, base verdict, nearest language, both distances and ``kept``, one row for each of ``docs``.

    A distance from few words is noise in good part, which shrinks with the root of their number, so a limit (a, b)
    stands for a + b / sqrt(n_words).
    """
    table = materialize(features(docs), "quality-features")
    n, ok = F.col("n_words"), F.lit(True)
    failed = (n < base_words) | (100 * F.col("n_repeat_words") > 50 * n)
    refs = references(table)
    # a small table in few files: the distances are worked out in as many tasks as a shuffle has
    table = table.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near, class_d, word_d = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    if refs:
        options = F.array(*[
            F.struct((c + w).alias("d"), F.lit(r["lang"]).alias("lang"), c.alias("class_d"), w.alias("word_d"))
            for r in refs for c, w in [distances(r)]
        ])
        best = F.when(n > 0, F.array_min(options))
        table = table.withColumn("best", best)
        near, class_d, word_d = F.col("best.lang"), F.col("best.class_d"), F.col("best.word_d")
        limit = lambda ab: ab[0] + ab[1] / F.sqrt(F.greatest(n, F.lit(1)))
        ok = (class_d <= limit(most_class)) & ((n < least_words) | (word_d <= limit(most_word)))
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(ok, F.lit(False))).alias("kept"),
        near.alias("nearest"), class_d.alias("class_distance"), word_d.alias("word_distance"),
    )
