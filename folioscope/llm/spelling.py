"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each letter's number: an integer that doesn't depend on the order of letters. Adding,
removing or exchanging a letter changes it by that letter's power, so two words that differ by one letter agree in a
residual: their key less one of their own letters' powers, or the whole key where the other word has one letter more. Words
meet by residuals, which are integers; only residuals of several words go on. There letter order is verified: words agree in
a running hash of the text around the letter and its place (exchange), or one word is the other without the letter
(addition, removal), and at last by the letters themselves. An order hash with its place is shared by as many words as there are
letters at most, so no group of anagrams is compared pair by pair, whatever its size.

Forms: a word's nearest and most frequent neighbour where that is at least twice as frequent. Forms grow by a factor of two,
so chains of forms are short and are followed by pointer jumping.

Defined results: a null text has no words, a null id counts as the empty text in the deletion rule; each of repeated rows
counts; ties go to the smallest word in code-point order; runs of any length are words, hashed in linear time; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.near_dups import LETTER, STEP, mix64
from folioscope.session import ensure_workers, materialize

LEAST_LENGTH, LEAST_COUNT, EVERY, TIMES = 5, 3, 97, 2
POWER = 5
FLUSH = 200_000
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts. Where ``every`` divides the hash of id and word, that text's occurrences lose one letter.

    A task counts a text's distinct words once, and sends its own sums of at most FLUSH words at a time.
    """
    ensure_workers(docs.sparkSession)
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for run, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = run.lower() if run.isascii() else run.translate(LOWER)
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) > FLUSH:
                    yield out()
                    total.clear()
        yield out()

    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def anagram_rows(words: list[str]) -> tuple[np.ndarray, ...]:
    """(word number, residual, place, order hash, whether it is the first of equal letters) of each letter of all words taken
    out, and with place -1 of each whole word. Linear in the letters."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([*map(len, words)], np.int64)
    starts = np.cumsum(lengths) - lengths
    number = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[number]
    letter = np.where(codes < 128, codes - 96, codes - 192 + 27)
    value = letter**POWER
    key = np.add.reduceat(value, starts) if len(words) else value
    steps = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(lengths.max(initial=0), STEP, np.uint64)]))
    back = np.uint64(pow(STEP, -1, 1 << 64))
    part = LETTER[letter & 255] * steps[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    ends = starts + lengths
    before = sums[:-1] - sums[starts][number]
    after = (sums[ends][number] - sums[1:]) * back  # what follows moves one place to the left
    order = mix64(before + after + (lengths[number] - 1).astype(np.uint64))
    whole = mix64(sums[ends] - sums[starts] + lengths.astype(np.uint64))
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    join = lambda a, b: np.concatenate([a, b])
    return (
        join(number, np.arange(len(words))), join(key[number] - value, key), join(place, np.full(len(words), -1)),
        join(order, whole).view(np.int64), join(first, np.zeros(len(words), bool)),
    )


def anagrams(words: DataFrame) -> DataFrame:
    """(id, residual, place, order_hash, first) of ``words(id, word)``."""
    ensure_workers(words.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            number, *rest = anagram_rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids[number]), *map(pa.array, rest)], ["id", "residual", "place", "order_hash", "first"])

    return words.select("id", "word").mapInArrow(run, "id long, residual long, place long, order_hash long, first boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of ``words(id, word, ...)``: ids of words that differ by exactly one letter, each pair once."""
    rows = materialize(anagrams(words), "anagrams")
    several = rows.groupBy("residual").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("residual")
    met = materialize(rows.join(several, "residual", "left_semi"), "anagrams-met")
    one, two = met.where("place >= 0").alias("one"), met.where("place >= 0").alias("two")
    same = lambda *cs: [F.col(f"one.{c}") == F.col(f"two.{c}") for c in cs]
    exchanged = one.join(two, same("residual", "order_hash", "place")).where("one.id < two.id")
    whole = met.where("place < 0").alias("two")
    longer = met.where("first").alias("one").join(whole, same("residual", "order_hash"))
    ends = [F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.col("one.place").alias("place")]
    pairs = exchanged.select(*ends, F.lit(True).alias("exchange")).union(longer.select(*ends, F.lit(False)))
    # the letters themselves: hashes may agree by chance
    text = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"))
    both = pairs.join(text("a"), "a").join(text("b"), "b")
    cut = lambda w: F.expr(f"concat(substring({w}, 1, int(place)), substring({w}, int(place) + 2))")
    right = F.when(F.col("exchange"), (cut("word_a") == cut("word_b")) & (F.col("word_a") != F.col("word_b"))).otherwise(cut("word_a") == F.col("word_b"))
    return both.where(right).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of ``links(id, form)``: the last form reached. Each round doubles the steps taken."""
    jumped = links.select("id", F.col("form").alias("root"))
    while True:
        further = jumped.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = materialize(jumped.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jumped = stepped.select("id", "root")
        if stepped.where("moved").isEmpty():
            return jumped


def variants(
    docs: DataFrame, least_count: int = LEAST_COUNT, least_length: int = LEAST_LENGTH, every: int = EVERY, times: int = TIMES
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each distinct word of ``docs(doc_id, text)``."""
    counts = word_counts(docs, least_length, every).where(F.col("n") >= least_count)
    words = materialize(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = near_pairs(words)
    both = materialize(pairs.union(pairs.select("b", "a")), "near-words")
    seen = both.join(words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near", F.col("b").alias("near_id"))).alias("best")
    chosen = seen.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    takes = -F.col("best.minus") >= times * F.col("n")
    formed = words.join(chosen, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n"), F.when(takes, F.col("best.near_id")).alias("form_id"),
    )
    formed = materialize(formed, "forms")
    last = roots(formed.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
