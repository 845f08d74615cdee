"""Sharding by a keyed permutation of global row numbers, with DataFrame functions only.

Rows get their number in the order of (key, content hash).  A Feistel network over Z_a x Z_b, with
a * b as near above the row count as sides of a like size allow, permutes the numbers; values at or
past the count walk the cycle on until they fall inside, so the result is a permutation of
0..n-1.  Position p lies in shard ``p mod shards`` at slot ``p div shards``: shard counts
differ by one at most, and shard and slot follow from the row number alone (and back, by
``row_number_at``).

Cases: an empty table gives an empty result; a null text counts 0 bytes, and 1 is always added;
null keys come first in the numbering; equal keys are ordered by the text's hash and then
stand in any order among identical rows, whose results are interchangeable.  Extra columns are
left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ROUNDS = 4
TRIED = 8192  #: sides that are tried


def _sides(n: int) -> tuple[int, int]:
    """Two sides, neither over about twice the other, whose product is n or least above it."""
    n = max(n, 1)
    root = math.isqrt(n - 1) + 1
    return min(((a, -(-n // a)) for a in range(max(1, root // 2 + 1, root - TRIED), root + 1)), key=lambda x: (x[0] * x[1], -x[0]))


def _round(half: Column, r: int, key: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(r), F.lit(key)), F.lit(modulus))


def _feistel(v: Column, a: int, b: int, key: int) -> Column:
    """One pass of the network: a bijection of [0, a*b)."""
    left, right = F.floor(v / F.lit(b)).cast("long"), F.pmod(v, F.lit(b))
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + _round(right, r, key, a), F.lit(a))
        else:
            right = F.pmod(right + _round(left, r, key, b), F.lit(b))
    return left * F.lit(b) + right


def _unfeistel(v: Column, a: int, b: int, key: int) -> Column:
    left, right = F.floor(v / F.lit(b)).cast("long"), F.pmod(v, F.lit(b))
    for r in reversed(range(ROUNDS)):
        if r % 2 == 0:
            left = F.pmod(left - _round(right, r, key, a), F.lit(a))
        else:
            right = F.pmod(right - _round(left, r, key, b), F.lit(b))
    return left * F.lit(b) + right


def _walk(v: Column, n: int, key: int, step) -> Column:
    """Cycle walking, to the end: a cycle visits each of the a * b - n values outside once at most, so
    a walk from inside has no more steps than these."""
    a, b = _sides(n)
    outside = a * b - n
    first = step(v, a, b, key)
    if not outside:
        return first
    return F.when(first < n, first).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda p, _: F.when(p < n, p).otherwise(step(p, a, b, key)))
    )


def permuted(number: Column, n: int, key: int = 0) -> Column:
    """The place of a row number in the shuffled order."""
    return _walk(number.cast("long"), n, key, _feistel)


def row_number_at(position: Column, n: int, key: int = 0) -> Column:
    """The inverse of permuted(): which row number stands at a place."""
    return _walk(position.cast("long"), n, key, _unfeistel)


def numbered(df: DataFrame, order: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers from 0 in the given order, without a window over all rows.

    The rows (keep them narrow) are range-partitioned and written once, so that a repeated task
    sees the same numbers; the counts of the written runs, one row for each, give the offsets.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")), "numbered"
    ).withColumn("_run", F.shiftright("_at", 33))
    runs = placed.groupBy("_run").count()
    # one row for each partition of the range sort: thousands at most, whatever the input
    counts = sorted((r["_run"], r["count"]) for r in runs.collect())
    total, starts = 0, [0] * (counts[-1][0] + 1 if counts else 1)
    for run, count in counts:
        starts[run] = total
        total += count
    offset = F.array(*[F.lit(x).cast("long") for x in starts])[F.col("_run").cast("int")]
    rows = placed.withColumn(number, offset + F.col("_at") - F.shiftleft("_run", 33))
    return rows.drop("_at", "_run"), total


def shard_rows(docs: DataFrame, shards: int = 16, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    rows, n = numbered(narrow, ["doc_id", "_tie"])
    rows = rows.withColumn("_p", permuted(F.col("row_number"), n, key))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
