"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs: lines, long ones parted after sentence ends. Each
paragraph hashes to a wide vector; a fingerprint is the sum of those vectors modulo powers of two, so
order doesn't matter and a paragraph is added or taken away by one vector addition.

The vector has a dense part (eight 64-bit lanes; it tells multisets apart) and a sparse part (16-bit
lanes in ten levels; a paragraph touches one lane of level 0, and with chance 1/8, 1/64, ... one of
the next levels). Two sums' likeness is read at the first level that isn't crowded: with a share u of its lanes untouched and a
share d on which the sums differ, the union has about -ln u paragraphs a lane and those not in common are about -ln(1 - d), so
that lanes which several paragraphs share don't lower it. The last level takes 1 of 2^27 paragraphs, so two texts of 2^31 bytes
each, the longest there are, touch about 16 of its 32 lanes. As hex the first 128 lanes are
always written, later ones as far as the last that isn't zero.

Defined results: null is the empty text, whose fingerprint is zero; equal texts have equal
fingerprints and likeness 1; rows with equal ids are ordered by text, null ids come first; repeated rows each get a row and are each
other's next documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import ensure_workers, materialize

LEVELS = (64, *[32] * 9)
STARTS = (0, *itertools.accumulate(LEVELS))
ALWAYS = 128  # lanes
PART = re.compile(r"(?<=[.!?]) +|\n+")


def paragraphs(text: str) -> list[str]:
    return [p for p in PART.split(text) if p]


def vectors(parts: list[str]) -> np.ndarray:
    """One 64-byte hash for each paragraph, as eight 64-bit lanes."""
    raw = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=64).digest() for p in parts)
    return np.frombuffer(raw, "<u8").reshape(-1, 8)


class Fingerprint:
    """The running sum; ``add`` and ``remove`` take paragraphs."""

    def __init__(self):
        self.dense = np.zeros(8, np.uint64)
        self.sparse = np.zeros(STARTS[-1], np.uint16)

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        out = cls()
        out.add(paragraphs(text or ""))
        return out

    def _apply(self, parts: list[str], sign: int) -> None:
        if not parts:
            return
        v = vectors(parts)
        lanes = np.zeros(STARTS[-1], np.uint16)
        dense = v.sum(0, dtype=np.uint64)
        worth = (v[:, 1] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
        for level, width in enumerate(LEVELS):
            mask = np.uint64((1 << (3 * level)) - 1)
            here = (v[:, 2] & mask) == 0
            if not here.any():
                break  # nor is any in a further level
            # levels 5 to 9 take the upper halves of the lanes of 0 to 4
            place = STARTS[level] + ((v[here, 3 + level % 5] >> np.uint64(32 * (level // 5))) % np.uint64(width)).astype(np.int64)
            np.add.at(lanes, place, worth[here])
        if sign > 0:
            self.dense = self.dense + dense
            self.sparse = self.sparse + lanes
        else:
            self.dense = self.dense - dense
            self.sparse = self.sparse - lanes

    def add(self, parts: list[str]) -> None:
        self._apply(parts, 1)

    def remove(self, parts: list[str]) -> None:
        self._apply(parts, -1)

    def hex(self) -> str:
        touched = np.flatnonzero(self.sparse[ALWAYS:])
        lanes = self.sparse[: ALWAYS + (int(touched[-1]) + 1 if len(touched) else 0)]
        return self.dense.astype("<u8").tobytes().hex() + lanes.astype("<u2").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        if (self.dense == other.dense).all() and (self.sparse == other.sparse).all():
            return 1.0
        answer = 0.0
        for level, width in enumerate(LEVELS):
            a, b = (x.sparse[STARTS[level] : STARTS[level + 1]] for x in (self, other))
            touched = (a != 0) | (b != 0)
            n = int(touched.sum())
            if level and n < 6:
                break  # too few left to say more than the level before
            differ = int((a != b).sum())
            answer = 1.0 - math.log(1 - differ / width) / math.log(max(width - n, 0.5) / width) if differ < n else 0.0
            if n <= 0.75 * width:
                break
        return answer


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(doc_id: int, text: str, print_: Fingerprint, nxt: str, next_print: Fingerprint) -> tuple:
    edited = edit(text, nxt)
    edited_print = Fingerprint.of(edited)
    return (doc_id, len(text), edited, print_.hex(), edited_print.hex(), print_.likeness(edited_print), print_.likeness(next_print))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def compare_with_edits(docs: DataFrame, digest=None) -> DataFrame:
    """Each text's fingerprint beside that of its edited text (see ``edit``) and the next document's.

    One range shuffle by id; a partition streams through Python with one row held back. Where a
    partition ends, its last row and the next partition's first meet in a second, small step.
    ``digest`` maps the streamed result to what is kept of it (say, a hash in place of the edited text).
    """
    spark = docs.sparkSession
    ensure_workers(spark, 250)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        kinds = [pa.int32(), pa.string(), pa.string()]
        for b in batches:
            done, ends = [], []
            for doc_id, text, part in zip(*(c.to_pylist() for c in b.columns)):
                mine = Fingerprint.of(text)
                if first:
                    ends.append(((doc_id, None, None, None, None, None, None), (part, "first", text)))
                    first = False
                if held:
                    done.append(_row(*held, text, mine))
                held, last_part = (doc_id, text, mine), part
            yield _joined(done, ends, kinds)
        if held:
            yield _joined([], [((held[0], None, None, None, None, None, None), (last_part, "last", held[1]))], kinds)

    def _joined(done, ends, kinds):
        main = _batch(done + [e[0] for e in ends])
        extra = [(None, None, None)] * len(done) + [e[1] for e in ends]
        return pa.RecordBatch.from_arrays(
            [*main.columns, *(pa.array([x[i] for x in extra], k) for i, k in enumerate(kinds))], [*NAMES, "part", "side", "text"]
        )

    keep = digest or (lambda df: df)
    streamed = materialize(keep(ordered.mapInArrow(stream, f"{RESULT}, part int, side string, text string")), "fingerprints")
    inner = streamed.where("side is null").drop("part", "side", "text")
    # partition ends: one row of each kind a partition
    firsts = streamed.where("side = 'first'").select("part", F.col("text").alias("next_text"))
    lasts = streamed.where("side = 'last'").select("doc_id", "part", "text")
    order = firsts.select("part")
    following = order.select(
        "part",
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"),
    )
    pairs = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(
                [_row(i, t, Fingerprint.of(t), n, Fingerprint.of(n)) for i, t, n in zip(*(c.to_pylist() for c in b.columns))]
            )

    outer = keep(pairs.select("doc_id", "text", "next_text").mapInArrow(finish, RESULT))
    return inner.unionByName(outer)
