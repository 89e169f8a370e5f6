"""A filter of fixed size that spares a shuffle most of the rows a semi-join would drop, and samples by a hash.

``key_filter`` is a Bloom filter of one hash as a table of at most WORDS rows (4 MB), whatever the number of keys, so it
can always be broadcast. It lets every wanted row pass, and others more often the more keys it holds; an exact join has to
follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18


def _word(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(WORDS)).cast("int")


def _bit(c: str) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(c), 32), F.lit(64)).cast("int")


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """(filter_word, filter_bits) of the values in ``column``."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(column))
    return keys.select(_word(column).alias("filter_word"), mask.alias("mask")).groupBy("filter_word").agg(F.bit_or("mask").alias("filter_bits"))


def in_filter(column: str) -> Column:
    """The join condition with ``key_filter``."""
    bit = F.call_function("shiftrightunsigned", F.col("filter_bits"), _bit(column)).bitwiseAND(F.lit(1).cast("long"))
    return (_word(column) == F.col("filter_word")) & (bit == 1)


def about(rows: int, of: int, seed: int, *columns: str) -> Column:
    """Whether a row is in a sample of about ``rows`` of ``of`` rows, by a 64-bit hash of its columns."""
    if rows >= of:
        return F.lit(True)
    return F.xxhash64(*columns, F.lit(seed)) < F.lit(-(1 << 63) + (rows << 64) // of)
