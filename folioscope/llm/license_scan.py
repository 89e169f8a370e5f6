"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every token string that occurs in a template: whole licences, notices, deeds and naming sentences. A document's words stream through
it and give matching statistics: the longest template substring that ends at each word. Matches that
cannot grow are chained, template by template, in document and template order into covered spans. A span has its
template's label if the chain covers enough of the template; where spans of several templates lie on one
another, the one that covers most words stands, as deeds and notices share sentences. Plain phrases are found beside that, as places where their words stand one after another.

Defined results: null is the empty text; no words means no span and score 0; repeated rows each get a
row; a text of any length is scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.license_texts import TEXTS
from folioscope.session import ensure_workers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

LEAST_MATCH, LEAST_COVER, GAP = 4, 0.6, 8


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class Automaton:
    """States of the generalised suffix automaton; ``ends`` has (template, end) of each state's strings."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEXTS):
        self.labels = [label for label, _ in templates]
        self.words = [words_of(text) for _, text in templates]
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(self.words):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        self.known = {w for words in self.words for w in words}

    def _state(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: str) -> int:
        """The state of p's longest string followed by w, parted from longer ones if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: str) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def statistics(self, words: list[str], start: int) -> Iterator[tuple[int, int, int]]:
        """(position, match length, state) for each word; positions count from ``start``."""
        state = length = 0
        for i, w in enumerate(words, start):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield i, length, state

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of matches of at least LEAST_MATCH words that the next word doesn't extend.

        A word in no template resets the automaton, so only runs of template words are fed to it.
        """
        flags = bytes(map(self.known.__contains__, words))
        for run in re.finditer(rb"\x01{%d,}" % LEAST_MATCH, flags):
            held = None
            for now in self.statistics(words[run.start() : run.end()], run.start()):
                if held and held[1] >= LEAST_MATCH and now[1] <= held[1]:
                    yield held
                held = now
            if held and held[1] >= LEAST_MATCH:
                yield held

    def spans(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered) of chained matches."""
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: first, last, template end, covered
        done = []  # covered words, template, first, last

        def close(t: int) -> None:
            first, last, _, covered = open_.pop(t)
            if covered >= LEAST_COVER * len(self.words[t]):
                done.append((covered, t, first, last))

        for end, length, state in self.matches(words):
            for t, at in sorted(self.ends[state]):
                begin = end - length + 1
                if t in open_:
                    first, last, before, covered = open_[t]
                    fresh = min(length, end - last, at - before)
                    if begin - last <= GAP and fresh > 0:
                        open_[t] = (first, end, at, covered + fresh)
                        continue
                    if begin - last <= GAP and end - last <= 0:
                        continue
                    close(t)
                open_[t] = (begin, end, at, length)
        for t in [*open_]:
            close(t)
        kept: list[tuple[str, int, int, float]] = []
        spots: list[tuple[int, int]] = []  # what kept spans cover, as disjoint intervals in order
        for covered, t, first, last in sorted(done, key=lambda x: (-x[0], len(self.words[x[1]]), x[1:])):
            lo = bisect_left(spots, (first, first))
            lo -= lo > 0 and spots[lo - 1][1] >= first
            hi = bisect_left(spots, (last + 1, last + 1))
            if 2 * sum(min(last, y) - max(first, x) + 1 for x, y in spots[lo:hi]) <= last - first + 1:
                ends = [(first, last), *spots[lo:hi]]
                spots[lo:hi] = [(min(x for x, _ in ends), max(y for _, y in ends))]
                kept.append((self.labels[t], first, last, min(1.0, covered / len(self.words[t]))))
        return sorted(kept)


def places(words: list[str], phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[tuple[str, int]]:
    """(label, start) wherever a phrase's words stand one after another."""
    out = []
    for phrase, label in phrases:
        parts, i = phrase.split(), -1
        for _ in range(words.count(parts[-1])):
            i = words.index(parts[-1], i + 1)
            if words[max(0, i - len(parts) + 1) : i + 1] == parts:
                out.append((label, i - len(parts) + 1))
    return sorted(out, key=lambda x: x[1])


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


SCHEMA = (
    "doc_id long, n_words long, places array<struct<label: string, start: long>>, "
    "spans array<struct<label: string, first: long, last: long, coverage: double>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, places, spans), one for each row of ``docs``; no shuffle."""
    ensure_workers(docs.sparkSession)
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            sizes, found, chained = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                sizes.append(len(words))
                found.append([{"label": x, "start": i} for x, i in places(words)])
                chained.append([dict(zip(("label", "first", "last", "coverage"), s)) for s in machine.spans(words)])
            arrays = [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(place)), pa.array(chained, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """The scan's base places and labels as columns."""
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    spans = F.transform("spans", lambda s: s["label"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, spans)).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
