"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Fingerprints are taken once for each document, and each distinct one is compared once.  A tile
holds fingerprints with equal population counts in each of four 16-bit quarters; two
fingerprints within the radius differ by at most the radius in the sum of those four counts, so
only tiles whose counts are that near are met at all.  Tiles over ``TILE`` fingerprints are
parted by hash.  A pair of tiles is one exclusive-or and bit count in numpy; what leaves it is
a spanning forest of the links found, at most one edge for each fingerprint, never all pairs.

Cases: null and empty texts, and texts of white space, have fingerprint zero and link like any
other; fewer than ``size`` words make one shingle; rows with equal doc_id are one document;
rows whose doc_id is null belong to their component, and get null if it has no other.  Extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, fresh, materialise, release, row_key, ship_code
from .components import connected_components, forest

TILE = 2048
QUARTERS = 4


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        digests = [xxh64_digest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digests = [xxh64_digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[size - 1:])]
    total = np.zeros(64, np.int64)
    for k in range(0, len(digests), 4096):
        part = digests[k : k + 4096]
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    out = np.packbits((2 * total > len(digests)).astype(np.uint8)).tobytes()
    return int.from_bytes(out, "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; and more columns of docs."""
    ship_code(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x, size) for x in texts], dtype="int64")
        release()

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"), *more)


def _near(radius: int) -> list[int]:
    """Differences of tile keys to meet: half of those with absolute sum up to the radius."""
    span = range(-radius, radius + 1)
    steps = [d for d in product(span, repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    keys = [sum(x << 8 * (QUARTERS - 1 - k) for k, x in enumerate(d)) for d in steps]
    return sorted(k for k in keys if k >= 0)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of unsigned fingerprints (or inside one, given the same array),
    as they stand if few, else as a spanning forest."""
    same = a is b
    rows, cols = [], []
    for k in range(0, len(a), 256):
        near = np.bitwise_count(a[k : k + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        rows.append(i)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    nodes = a if same else np.concatenate([a, b])
    if not same:
        j = j + len(a)
    if len(i) >= len(nodes):
        i, j = forest(i, j, len(nodes))
    return nodes[i], nodes[j]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges that join all fingerprints of the table within the radius."""
    key = None
    for q in range(QUARTERS):
        part = F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(65535))).cast("long") + F.lit(radius)
        part = F.shiftleft(part, 8 * (QUARTERS - 1 - q))
        key = part if key is None else key + part
    keyed = distinct.select("fp", key.alias("key"))
    parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("parts"))
    tiles = (
        keyed.join(parts, "key")
        .groupBy("key", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialise(tiles, "tiles")
    left = tiles.select("key", "part", F.col("fps").alias("left"), F.explode(F.array(*[F.lit(k).cast("long") for k in _near(radius)])).alias("step"))
    right = tiles.select(F.col("key").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("right"))
    pairs = left.join(right, (F.col("key") + F.col("step") == F.col("other")) & ((F.col("step") > 0) | (F.col("part") <= F.col("other_part"))))
    pairs = pairs.select("left", "right", ((F.col("step") == 0) & (F.col("part") == F.col("other_part"))).alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y, same in zip(pdf["left"], pdf["right"], pdf["same"]):
                a = np.asarray(x, np.int64).view(np.uint64)
                b = a if same else np.asarray(y, np.int64).view(np.uint64)
                i, j = tile_links(a, b, radius)
                if len(i):
                    yield pd.DataFrame({"a": i.view(np.int64), "b": j.view(np.int64)})

    return pairs.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; given more columns of docs, these
    and the component's fingerprint_root."""
    fps = materialise(fingerprints(docs, id_col, text_col, size, more), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct, radius), "a", "b")
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(lowest, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *([*more, F.col("root").alias("fingerprint_root")] if more else []),
    )


def keep_first(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """One row of each component: that with its smallest id, or of a component without ids any one;
    of rows with the same id and text one stays.  All columns as they are."""
    key, kept, n = (fresh(docs, c) for c in ("_row_key", "_kept_key", "_kept_n"))
    docs = docs.withColumn(key, row_key())
    found = near_duplicates(docs, radius, size, more=(key,)).groupBy(F.col(key).alias(kept)).agg(
        F.count("*").alias(n), F.first("doc_id").alias("id"), F.first("component_id").alias("component"), F.first("fingerprint_root").alias("root")
    )
    found = materialise(found, "keys")
    named = found.where("id = component").select(kept, n)
    unnamed = found.where("component IS NULL").groupBy("root").agg(F.min_by(kept, kept).alias(kept), F.min_by(n, kept).alias(n)).select(kept, n)
    chosen = named.unionByName(unnamed)
    match = F.col(key) == F.col(kept)
    out = docs.join(chosen.where(F.col(n) == 1), match, "left_semi")
    repeated = chosen.where(F.col(n) > 1)
    if not repeated.isEmpty():  # equal rows of one id, or without one
        out = out.unionByName(docs.join(repeated, match, "left_semi").dropDuplicates([key]))
    return out.drop(key)
