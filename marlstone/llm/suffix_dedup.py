"""Removal of repeated byte strings by sparse, distributed prefix doubling.

Wanted: every byte covered by a string of ``threshold`` bytes that also starts in a document
with a smaller id.  Prefix doubling ranks positions by ever longer prefixes: the rank of a
position for length 2L is that of the pair (rank at p, rank at p + L).  Here the first rank is
for L = threshold / 2 bytes, named by a 64-bit fingerprint, and three things keep it within
bounds on large inputs:

* Only synchronising positions enter the first rounds: in each window of ``threshold`` bytes the
  leftmost smallest rank.  Equal windows choose the same one, so nothing is lost, and only one
  position in about thirteen takes part.
* Round 1 sorts (rank at a; ranks at a - L and a + L, the prefix grown to 3L) and reranks:
  positions whose first rank is unique drop out; where the whole neighbourhood of 3L bytes also
  stands in a smaller document, all windows at the position are settled at once.
* Round 2 takes the windows at the positions still open, one copy of each neighbourhood, and
  sorts their pairs (rank at p, rank at p + L): that is the rank for the threshold, where
  doubling ends.

Sorting is by range: Spark deals (rank, ...) by the top bits of the rank to buckets, and a bucket
is sorted and reranked in numpy.  A rank with very many names would fill a bucket: such ranks, which a
sample of the chunks tells, are dealt by rank and name, as is all of round 2.  Documents are grouped in chunks; a chunk sends each rank once,
with its smallest document, and gets back two bits for it, so a string in a third of all
documents is one entry for each chunk, never one for each document.  Chunks are a bucketed table
in the shared folder, so they are never shuffled again.

Ranks are compared by 112 bits of fingerprints, so a wrong removal needs a collision of these.

Cases: null and empty texts have no byte; texts under the threshold keep all; several rows with
one id are one document and remove nothing from each other; null ids come after all others;
long texts are whole; extra columns are ignored (or kept, by deduplicated()).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, longs, materialise, release, row_key_from, row_key_of, shared_folder, ship_code

CHUNK = 2 << 20  #: bytes of text in a chunk
BUCKETS = 256  #: of ranks, at least
ENTRIES = 1 << 20  #: of a bucket, about
MANY = ENTRIES // 8  #: entries of a rank that is dealt by its names
EVERY = 16  #: chunks, of which one is asked for such ranks
LAST = (1 << 63) - 1  #: the place of a null id in the order
PAD = 256

_RNG = np.random.default_rng(20240229)
_SYMBOL = _RNG.integers(1, 1 << 63, 257, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranks(symbols: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name for the ``length`` symbols from each position, by doubling."""
    power: dict[int, np.ndarray] = {1: _SYMBOL[symbols]}
    n = 1
    while 2 * n <= length:
        x = power[n]
        power[2 * n] = x[: len(x) - n] * np.uint64(pow(_BASE, n, 1 << 64)) + x[n:]
        n *= 2
    out, have = power[n], n
    while have < length:
        n = 1 << (length - have).bit_length() - 1
        x = power[n]
        m = len(symbols) - have - n + 1
        out = out[:m] * np.uint64(pow(_BASE, n, 1 << 64)) + x[have : have + m]
        have += n
    return _mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[: len(x) - n], x[n:])
        n *= 2
    if n < width:
        x = np.minimum(x[: len(x) - (width - n)], x[width - n :])
    return x


class Piece:
    """Some documents of a chunk: their windows, and the position each window chooses."""

    def __init__(self, texts: list[bytes], threshold: int):
        half = threshold // 2
        self.half, self.threshold = half, threshold
        gap = threshold - half
        pad = np.full(gap, PAD, np.uint16)
        parts, self.begin, at = [pad], [], gap
        for t in texts:
            self.begin.append(at)
            parts += [np.frombuffer(t, np.uint8).astype(np.uint16), pad]
            at += len(t) + gap
        symbols = np.concatenate([*parts, pad])
        begin = np.array(self.begin, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        self.rank = ranks(symbols, half)
        n = np.maximum(size - threshold + 1, 0)
        self.document = np.repeat(np.arange(len(texts)), n)
        first = np.cumsum(n) - n
        self.windows = np.arange(int(n.sum())) - np.repeat(first - begin, n)  # starts, in symbols
        span = threshold - half + 1
        width = max(24, len(self.rank).bit_length())
        mask = np.uint64((1 << width) - 1)
        keyed = _mix(self.rank) & ~mask | np.arange(len(self.rank), dtype=np.uint64)
        low = _sliding_min(keyed, span)
        self.choice = (low[self.windows] & mask).astype(np.int64)
        change = np.flatnonzero(np.diff(self.choice, prepend=-1) != 0)
        self.chosen = self.choice[change]  # each position, in order of the text
        self.chosen_document = self.document[change]
        self.run = np.diff(np.append(change, len(self.choice)))  # windows of each position
        self.first_window = self.windows[change] if len(change) else change

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank, name of the whole neighbourhood) of each chosen position."""
        a = self.rank[self.chosen]
        if not len(a):
            return a, a
        gap = self.threshold - self.half
        around = a
        for step in sorted({-gap, -self.half, self.half, gap}):
            around = _mix(around * np.uint64(3) + self.rank[self.chosen + step])
        return a, around

    def window_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank at the window, rank half-way, document) of the windows at some positions."""
        n = self.run[which]
        at = np.repeat(self.first_window[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        far = _mix(self.rank[at + self.threshold - self.half])
        if 2 * self.half < self.threshold:
            far = _mix(far + self.rank[at + self.half])
        return _mix(self.rank[at]), far, np.repeat(self.chosen_document[which], n)


def _bytes48(x: np.ndarray) -> bytes:
    """The low six bytes of each, by byte planes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from48(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, n).T
    return out.reshape(-1).view("<u8")


class Entries:
    """Distinct (rank, name) pairs of a chunk in order, with their smallest document."""

    def __init__(self, rank: np.ndarray, name: np.ndarray, ids: np.ndarray):
        name = name & np.uint64((1 << 48) - 1)
        order = np.lexsort((ids, name, rank))
        rank, name, ids = rank[order], name[order], ids[order]
        head = np.ones(len(rank), bool)
        head[1:] = (rank[1:] != rank[:-1]) | (name[1:] != name[:-1])
        self.group = np.empty(len(rank), np.int64)
        self.group[order] = np.cumsum(head) - 1  # entry of each position
        self.rank, self.name, self.low = rank[head], name[head], ids[head]

    def deal(self, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
        """(entries in order of their bucket, where each bucket starts)."""
        bucket = deal.bucket(self.rank, self.name)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(deal.count + 1))

    def dealt(self, deal: Deal) -> Iterator[tuple[int, bytes, int]]:
        """(bucket, packed entries, how many)."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        order, cuts = self.deal(deal)
        rank, name, smallest = self.rank[order], self.name[order], self.low[order]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = int(cuts[b]), int(cuts[b + 1])
            base = int(smallest[lo:hi].min())
            low = (smallest[lo:hi] - base).astype("<u8")
            top = (rank[lo:hi] >> np.uint64(48)).astype("<u2")
            planes = np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8).T).tobytes()
            body = pack(top.tobytes() + planes) + b""
            fixed = _bytes48(rank[lo:hi]) + _bytes48(name[lo:hi])
            yield b, np.int64(base).tobytes() + np.uint32(len(body)).tobytes() + body + fixed, hi - lo


class Deal:
    """Which bucket an entry goes to: by the top bits of its rank, so that all names of a rank meet;
    for the hot ranks, which have several names for certain, by rank and name in buckets of their own;
    by rank and name for all, where names needn't meet."""

    def __init__(self, buckets: int, hot: np.ndarray | None = None, spread: int = 0, pairs: bool = False):
        self.plain = buckets
        self.hot = np.zeros(0, np.uint64) if hot is None else np.sort(hot)
        self.spread = spread if len(self.hot) else 0
        self.pairs = pairs
        self.count = buckets + self.spread

    def bucket(self, rank: np.ndarray, name: np.ndarray) -> np.ndarray:
        if self.pairs:
            return _bucket(_mix(rank ^ _mix(name)), self.plain)
        out = _bucket(rank, self.plain)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, rank), len(self.hot) - 1)
            which = np.flatnonzero(self.hot[at] == rank)
            out[which] = self.plain + _bucket(_mix(rank[which] ^ _mix(name[which])), self.spread)
        return out


def _bucket(rank: np.ndarray, buckets: int) -> np.ndarray:
    return ((rank >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    base, size = int(np.frombuffer(data, np.int64, 1)[0]), int(np.frombuffer(data, np.uint32, 1, 8)[0])
    body = zstandard.ZstdDecompressor().decompress(data[12 : 12 + size])
    top = np.frombuffer(body, "<u2", n).astype(np.uint64)
    low = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, 2 * n).reshape(8, n).T).reshape(-1).view("<u8").astype(np.int64) + base
    rest = data[12 + size :]
    return _from48(rest[: 6 * n], n) | top << np.uint64(48), _from48(rest[6 * n :], n), low


def rerank(rank: np.ndarray, name: np.ndarray, low: np.ndarray, shared: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted-and-grouped entries: settled (the same pair stands in a smaller document), and
    open (others share the first rank, as they do for certain if ``shared``, and this entry is the
    first of its pair)."""
    order = np.lexsort((low, name, rank))
    r, m, d = rank[order], name[order], low[order]
    new_rank = np.ones(len(r), bool)
    new_rank[1:] = r[1:] != r[:-1]
    new_pair = new_rank.copy()
    new_pair[1:] |= m[1:] != m[:-1]
    pair = np.cumsum(new_pair) - 1
    lowest = d[new_pair][pair]
    group = np.cumsum(new_rank) - 1
    pairs_in_group = np.bincount(group[new_pair], minlength=int(group[-1]) + 1 if len(group) else 0)
    settled, waiting = np.zeros(len(r), bool), np.zeros(len(r), bool)
    settled[order] = d > lowest
    waiting[order] = (d == lowest) & (shared | (pairs_in_group[group] > 1))
    return settled, waiting


def _answers(entries: DataFrame, two: bool, plain: int) -> DataFrame:
    """(chunk, bucket, bits): for each entry sent, whether it is settled, and whether it is open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(bytes(e), int(n)) for e, n in zip(pdf["entries"], pdf["n"])]
        settled, waiting = rerank(*(np.concatenate(x) for x in zip(*parts)), shared=bool(pdf["bucket"].iloc[0] >= plain))
        rows, at = [], 0
        for chunk, n in zip(pdf["chunk"], pdf["n"]):
            s, w = settled[at : at + n], waiting[at : at + n]
            at += n
            if s.any() or two and w.any():
                rows.append((chunk, pdf["bucket"].iloc[0], np.packbits(s).tobytes(), np.packbits(w).tobytes() if two else b""))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "settled", "waiting"])

    return entries.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, settled binary, waiting binary")


def _chunks(docs: DataFrame) -> tuple[DataFrame, str]:
    """A bucketed table (chunk, ids, nulls, sizes, texts) in the shared folder, and its name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        nulls: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"chunk": [number], "ids": [np.array(ids, np.int64).tobytes()], "nulls": [np.packbits(nulls).tobytes()], "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "texts": [pack(b"".join(texts))]})

        for pdf in frames:
            for name, null, text in zip(pdf["doc_id"], pdf["null"], pdf["text"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > CHUNK:
                    yield close()
                    ids, nulls, texts, size, number = [], [], [], 0, number + 1
                ids.append(int(name))
                nulls.append(bool(null))
                texts.append(raw)
                size += len(raw)
        if texts:
            yield close()
        release()

    spark = docs.sparkSession
    rows = docs.mapInPandas(run, "chunk long, ids binary, nulls binary, sizes binary, texts binary")
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(parts, "chunk").option("path", path).option("compression", "none").saveAsTable(name)
    return spark.table(name), name


def _load(row) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    ids = np.frombuffer(bytes(row.ids), np.int64)
    cuts = np.concatenate([[0], np.cumsum(np.frombuffer(bytes(row.sizes), np.int64))])
    raw = zstandard.ZstdDecompressor().decompress(bytes(row.texts), max_output_size=max(1, int(cuts[-1]))) if cuts[-1] else b""
    return ids, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Chunk:
    """A chunk's pieces and its entries for round 1."""

    def __init__(self, row, threshold: int):
        self.ids, self.texts = _load(row)
        self.nulls = np.unpackbits(np.frombuffer(bytes(row.nulls), np.uint8), count=len(self.ids)).astype(bool)
        self.pieces: list[tuple[int, Piece]] = []
        at = size = 0
        for k, t in enumerate(self.texts):
            size += len(t)
            if size >= 1 << 19 or k + 1 == len(self.texts):
                self.pieces.append((at, Piece(self.texts[at : k + 1], threshold)))
                at, size = k + 1, 0
        keys = [p.keys() for _, p in self.pieces]
        self.who = np.concatenate([p.chosen_document + a for a, p in self.pieces])
        self.owner = self.ids[self.who]
        self.first = Entries(np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys]), self.owner)

    def answered(self, answers, deal: Deal, entries: Entries) -> tuple[np.ndarray, np.ndarray]:
        """(settled, open) of the entries, from the answers' bits."""
        settled, waiting = np.zeros(len(entries.rank), bool), np.zeros(len(entries.rank), bool)
        order, cuts = entries.deal(deal)
        for x in answers if isinstance(answers, (list, np.ndarray)) else ():
            which = order[cuts[x["bucket"]] : cuts[x["bucket"] + 1]]
            for target, bits in ((settled, x["settled"]), (waiting, x["waiting"])):
                if bits:
                    target[which] = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), count=len(which))
        return settled, waiting

    def second(self, settled: np.ndarray, waiting: np.ndarray):
        """What round 1 leaves: for each position whether all its windows go, and the windows of
        open positions as entries with their places."""
        entry = self.first.group
        gone = settled[entry] | (self.owner > self.first.low[entry])
        still = waiting[entry] & ~gone
        rank, name, owner, place = [], [], [], []
        at = 0
        for k, (_, p) in enumerate(self.pieces):
            which = np.flatnonzero(still[at : at + len(p.chosen)])
            r, m, d = p.window_keys(which)
            rank.append(r)
            name.append(m)
            owner.append(self.ids[d + self.pieces[k][0]])
            place.append((which, len(r)))
            at += len(p.chosen)
        return gone, place, Entries(np.concatenate(rank), np.concatenate(name), np.concatenate(owner)), np.concatenate(owner)


def _hot_ranks(chunks: DataFrame, threshold: int, many: int, every: int) -> tuple[np.ndarray, int]:
    """Ranks with about ``many`` entries or more, and how many entries these have together, by one chunk
    in ``every``.  A rank is taken for hot only if a chunk holds several names of it, so whatever the
    sample misses costs balance and nothing else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                rank, names = np.unique(Chunk(row, threshold).first.rank, return_counts=True)
                wide = np.flatnonzero(names > 1)
                yield pd.DataFrame({"rank": rank[wide].view(np.int64), "n": names[wide]})
        release()

    sample = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(every)) == 0).mapInPandas(run, "rank long, n long")
    # at most one rank for each ``many`` entries of the sample
    found = sample.groupBy("rank").agg((F.sum("n") * every).alias("n")).where(F.col("n") >= many).collect()
    return np.array([r["rank"] for r in found], np.int64).view(np.uint64), sum(r["n"] for r in found)


def removals(
    docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False, wanted: Callable[[DataFrame], DataFrame] = lambda cut: cut,
    many: int = MANY, every: int = EVERY,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row, and if keyed its
    row_key; or what is wanted of these.  That is written to the shared folder, and the tables that
    it came from are deleted."""
    spark = docs.sparkSession
    ship_code(spark)
    if threshold < 2:
        raise ValueError("the threshold must be at least 2 bytes")
    known = F.col(id_col).cast("long")
    # no nulls: pandas would make large ids inexact
    chunks, name = _chunks(docs.select(F.coalesce(known, F.lit(LAST)).alias("doc_id"), known.isNull().alias("null"), F.col(text_col).alias("text")))
    total = chunks.agg(F.count("*")).first()[0] * CHUNK
    buckets = max(BUCKETS, total // 13 // ENTRIES)
    hot, weight = _hot_ranks(chunks, threshold, many, every)
    deal, pairs = Deal(buckets, hot, 1 + 2 * weight // ENTRIES), Deal(buckets, pairs=True)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                e = Chunk(row, threshold).first
                yield pd.DataFrame([(row.chunk, *x) for x in e.dealt(deal)], columns=["chunk", "bucket", "entries", "n"])
        release()

    sent = "chunk long, bucket int, entries binary, n int"
    one = materialise(_answers(chunks.mapInPandas(first, sent), True, buckets), "round-1")
    given = lambda answers, name: answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "settled", "waiting")).alias(name))
    opened = chunks.join(given(one, "one"), "chunk", "left")

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                c = Chunk(row, threshold)
                e = c.second(*c.answered(row.one, deal, c.first))[2]
                yield pd.DataFrame([(row.chunk, *x) for x in e.dealt(pairs)], columns=["chunk", "bucket", "entries", "n"])
        release()

    two = materialise(_answers(opened.mapInPandas(second, sent), False, buckets), "round-2")

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                yield _cut(Chunk(row, threshold), row.one, row.two, deal, pairs, keyed)
        release()

    out = opened.join(given(two, "two"), "chunk", "left").mapInPandas(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + ", key string" * keyed)
    out = materialise(wanted(out), "removals")
    for table in (one, two, chunks):
        forget(table)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def _cut(c: Chunk, one, two, deal: Deal, pairs: Deal, keyed: bool) -> pd.DataFrame:
    gone, place, entries, owner = c.second(*c.answered(one, deal, c.first))
    settled = c.answered(two, pairs, entries)[0]
    window_gone = settled[entries.group] | (owner > entries.low[entries.group]) if len(owner) else np.zeros(0, bool)
    rows = []
    at = seen = 0
    for (base, p), (which, n) in zip(c.pieces, place):
        flag = np.repeat(gone[at : at + len(p.chosen)], p.run)
        at += len(p.chosen)
        begin = np.cumsum(p.run) - p.run
        m = p.run[which]
        flag[np.repeat(begin[which] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] |= window_gone[seen : seen + n]
        seen += n
        delta = np.zeros(len(p.rank) + p.threshold + 1, np.int32)
        hit = p.windows[flag]
        delta[hit] += 1
        delta[hit + p.threshold] -= 1
        covered = np.cumsum(delta) > 0
        for k in range(base, base + len(p.begin)):
            text = c.texts[k]
            b = p.begin[k - base]
            own = covered[b : b + len(text)]
            kept = np.frombuffer(text, np.uint8)[~own].tobytes()
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if len(text) else 0
            name = None if c.nulls[k] else int(c.ids[k])
            rows.append((name, len(text), len(text) - len(kept), spans, kept, row_key_of(name, text) if keyed else None))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "key"])
    if not keyed:
        del out["key"]
    out["doc_id"] = longs([r[0] for r in rows])
    return out


def digest(docs: DataFrame, threshold: int = 50) -> DataFrame:
    return removals(docs, threshold, wanted=lambda cut: cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def deduplicated(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """The documents without their repeated bytes; characters that were cut apart are dropped,
    n_chars follows the text, other columns stay.  Ids may repeat or be null: the cut of a row
    follows from its id and text, and each row meets one cut by these two."""
    ship_code(docs.sparkSession)

    @F.pandas_udf("string")
    def text(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    own, key, new = (fresh(docs, c) for c in ("_row_key", "_cut_key", "_cut_text"))
    cut = removals(docs, threshold, keyed=True, wanted=lambda x: x.where("n_removed > 0").select(F.col("key").alias(key), text("kept").alias(new)))
    cut = cut.dropDuplicates([key])
    joined = docs.withColumn(own, row_key_from(F.col("doc_id").cast("long"))).join(cut, F.col(own) == F.col(key), "left")
    hit = F.col(key).isNotNull()
    now = F.when(hit, F.col(new)).otherwise(F.col("text"))
    return joined.select(*[now.alias(c) if c == "text" else F.when(hit, F.length(now)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
