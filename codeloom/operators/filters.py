"""Filters of bits: which rows may have one of very many keys, without an exchange of the rows.

A key that was put in is always hit; another one is hit once in some ten thousand. Callers make that exact, by an exact step
for the rows that are hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .checkpoints import cut

#: Rows of keys that are broadcast as they are; keys up to which a filter is made, of 30 MB.
MOST_BROADCAST, MOST_FILTERED = 200_000, 10_000_000
_BITS_A_KEY, _PROBES = 24, 6


def _places(keys: list[Column], size: int) -> list[Column]:
    h = F.xxhash64(*keys)
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 32)
    return [(low + high * k) % size for k in range(_PROBES)]


def _size(n: int) -> int:
    return max(64, n * _BITS_A_KEY)


def made(keys: DataFrame, n: int) -> DataFrame:
    """(_bits array<long>): one row, the filter of the n rows of keys, all columns together."""
    size = _size(n)
    places = keys.select(F.explode(F.array(*_places([F.col(c) for c in keys.columns], size))).alias("at"))
    words = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("b"))
    every = keys.sparkSession.range(size // 64 + 1).withColumnRenamed("id", "word").join(words, "word", "left")
    rows = F.sort_array(F.collect_list(F.struct("word", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return cut(every.agg(F.transform(rows, lambda r: r["b"]).alias("_bits")))


def hit(n: int, *keys: Column) -> Column:
    """Whether the filter of n keys in the column _bits may hold these."""
    bit = lambda at: F.call_function("shiftright", F.get("_bits", F.call_function("shiftright", at, F.lit(6)).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return reduce(lambda a, b: a & b, map(bit, _places(list(keys), _size(n))))
