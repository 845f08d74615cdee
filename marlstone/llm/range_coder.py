"""Token ids as compressed, checksummed blocks.

A block codes up to ``BLOCK`` ids by itself: its model starts empty, so any block can be read
alone or lost alone.  A file holds a table of its ids and the lengths of their prefix codes, made
from their counts; the model codes an id as the yes-or-no decisions along its code, so every bit
of it is predicted.  Three predictions are mixed: order 0, a counter for each node of the code's
tree; order 1 and order 2, the id that last followed the previous one, or the previous two, each
with a counter for each degree of past success.  They are added in the logistic domain under
weights that learn from every decision, and the mixed probability drives a binary range coder.
All arithmetic is on integers, so any machine reads what any other wrote.

Two forms give the same bytes.  write_file() and read_file() run blocks in lockstep: each step codes one
decision of up to ``LANES`` blocks by numpy operations.  The tables' files are coded by RangeCoder.java on
the executors' JVMs, block after block, whose model then stays in the processor's cache.

A file is: magic, number of blocks and ids, the table, for each block its count, size and crc32,
a crc32 of all that, then the payloads.  A dataset holds one file in each row, written in ascending
order of the documents' ids, with the table of the documents that it holds.

Cases: null and empty texts are one end id; an empty table writes no file; equal ids stay
separate documents in text-hash order; a null id comes first; extra columns are ignored; ids may be
any below 2**32, others raise ValueError; a damaged head raises ValueError; of a file with damaged
blocks read_blocks() gives all others, and read_file() raises ValueError with their numbers.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvm, tokens
from .common import id_columns, ids_of, longs, materialise, release, ship_code, text_or_empty

BLOCK = 1024
LANES = 8192
FILE_IDS = BLOCK * LANES
MAGIC = b"MLTK2\n"
NODES = 11  #: bits of a tree node's place in a lane's counters
SLOTS = 10  #: bits of a context's place among a lane's guesses
DEEPEST = 28  #: bits of a code, at most
LIMIT = 127  #: sightings after which a counter learns no slower
ONE = 1 << 16
MASK = (1 << 48) - 1


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """ln(p / (1 - p)) in 1/256 of a 12-bit probability, and its inverse in 16 bits."""
    p = (np.arange(4096) + 0.5) / 4096
    back = 65536 / (1 + np.exp(-(np.arange(4096) - 2048) / 256.0))
    return np.rint(np.log(p / (1 - p)) * 256).astype(np.int64), np.clip(np.rint(back), 32, ONE - 32).astype(np.int64)


STRETCH, SQUASH = _logistic()
RATE = (65536 / (np.arange(256) + 1.6)).astype(np.int64)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols of these counts, none over DEEPEST."""
    n = len(counts)
    while True:
        heap = [(int(c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent = np.zeros(2 * n - 1, np.int64)
        for made in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = made
            heapq.heappush(heap, (a + b, made))
        depth = np.zeros(2 * n - 1, np.int64)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[:n].max(initial=0) <= DEEPEST:
            return depth[:n]
        counts = (counts >> 2) + 1


class Code:
    """A canonical prefix code: at each depth the codes that end there come first, so a node is its
    path, written as a number with a leading one."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.length = symbols[order], lengths[order].astype(np.int64)
        deepest = int(self.length.max())
        counts = np.bincount(self.length, minlength=deepest + 2)
        first, before = np.zeros(deepest + 2, np.int64), np.cumsum(counts) - counts
        for d in range(1, deepest + 2):
            first[d] = (first[d - 1] + counts[d - 1]) << 1
        lead = 1 << np.arange(deepest + 2)
        self.stop = first + counts + lead  # paths below this end at their depth
        self.shift = before - first - lead  # from such a path to the symbol's place
        self.path = first[self.length] + np.arange(len(symbols)) - before[self.length] + (1 << self.length)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Code, np.ndarray]:
        """The code made for some ids, and the places of these."""
        if ids.max() < 1 << 20:  # few enough to be counted
            counts = np.bincount(ids)
            symbols, number = np.flatnonzero(counts), ids
            counts = counts[symbols]
        else:
            symbols, number, counts = np.unique(ids, return_inverse=True, return_counts=True)
        if len(symbols) == 1:  # a tree needs two leaves
            symbols, counts = np.append(symbols, symbols[0] ^ 1), np.append(counts, 1)
        lengths = code_lengths(counts)
        code = cls(symbols, lengths)
        order = np.lexsort((symbols, lengths))
        place = np.empty(int(symbols.max()) + 1 if number is ids else len(symbols), np.int32)
        place[symbols[order] if number is ids else order] = np.arange(len(symbols))
        return code, place[number]

    def table(self) -> bytes:
        return zlib.compress(self.symbols.astype("<u4").tobytes() + self.length.astype(np.uint8).tobytes())

    @classmethod
    def read(cls, table: bytes) -> Code:
        raw = zlib.decompress(table)
        n = len(raw) // 5
        lengths = np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64)
        # every path ends at one symbol
        if not n or lengths.min() < 1 or lengths.max() > DEEPEST or (1 << DEEPEST - lengths).sum() != 1 << DEEPEST:
            raise ValueError("the file's head is damaged")
        return cls(np.frombuffer(raw, "<u4", n).astype(np.int64), lengths)


class Coder:
    """Binary range coder of many lanes; reads if given words, else writes."""

    def __init__(self, lanes: int, words: np.ndarray | None = None, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.low, self.high = np.zeros(lanes, np.int64), np.full(lanes, MASK, np.int64)
        self.reading = words is not None
        if self.reading:
            self.words, self.at, self.ends = np.append(words, 0), starts.copy(), ends
            self.value = np.zeros(lanes, np.int64)
            for _ in range(3):
                self.value = self.value << 16 | self._next(np.arange(lanes))
        else:
            self.lane = np.arange(lanes)
            self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def _next(self, who) -> np.ndarray:
        """The next word of some lanes, zero past the end."""
        at, ends = self.at[who], self.ends[who]
        self.at[who] = at + 1
        return np.where(at < ends, self.words[np.minimum(at, ends)], 0)

    def code(self, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Code "yes" with probability p / 65536; gives the bits."""
        mid = self.low + ((self.high - self.low) >> 16) * p
        if self.reading:
            bit = self.value <= mid
        yes = bit.view(np.int8).astype(np.int64)
        self.high += (mid - self.high) * yes
        mid += 1
        self.low += (mid - self.low) * (1 - yes)
        who = np.flatnonzero((self.low ^ self.high) < (1 << 32))
        while len(who):
            low = self.low[who]
            if self.reading:
                self.value[who] = (self.value[who] << 16 & MASK) | self._next(who)
            else:
                self.out.append((self.lane[who], low >> 32))
            low = low << 16 & MASK
            high = (self.high[who] << 16 & MASK) | 0xFFFF
            self.low[who], self.high[who] = low, high
            who = who[(low ^ high) < (1 << 32)]
        return bit

    def keep(self, which: np.ndarray) -> None:
        """Go on with some of the lanes; the others' ends are written."""
        if not self.reading:
            over = np.ones(len(self.low), bool)
            over[which] = False
            for k in (32, 16, 0):
                self.out.append((self.lane[over], self.low[over] >> k & 0xFFFF))
            self.lane = self.lane[which]
        else:
            self.value, self.at, self.ends = self.value[which], self.at[which], self.ends[which]
        self.low, self.high = self.low[which], self.high[which]

    def written(self, lanes: int) -> list[bytes]:
        lane, word = (np.concatenate(x) for x in zip(*self.out))
        cuts = np.cumsum(np.bincount(lane, minlength=lanes))
        flat = word[np.argsort(lane, kind="stable")].astype("<u2")
        return [x.tobytes() for x in np.split(flat, cuts[:-1])]


def _run(code: Code, sizes: np.ndarray, places: np.ndarray | None, coder: Coder) -> np.ndarray:
    """Code the blocks of these sizes; gives the places of their ids, one block after the other."""
    lanes = len(sizes)
    writing = places is not None
    out = places.astype(np.int64) if writing else np.zeros(int(sizes.sum()), np.int64)
    path, length, stop, shift = code.path, code.length, code.stop, code.shift
    # what the lanes have learned: counters (22 bits of probability, 8 of sightings), guesses (place + 1
    # and three bits of success) after one and two ids, trust in them, and weights
    nodes = np.full(lanes << NODES, 1 << 29, np.int32)
    guesses = [np.zeros(lanes << SLOTS, np.int32) for _ in range(2)]
    trust = [np.full(lanes * 8, ONE // 2, np.int64), np.full(lanes * 8, 3 * ONE // 4, np.int64)]
    weights = [np.full(lanes * 16, w, np.int64) for w in (45000, 30000, 30000)]
    lane = np.arange(lanes)
    end = np.cumsum(sizes)
    at = end - sizes
    base = lane << NODES
    node, depth = np.ones(lanes, np.int64), np.zeros(lanes, np.int64)
    last1, last2, slot1, slot2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), lane << SLOTS, lane << SLOTS
    # the guessed ids' paths, their lengths and past success, and which of them still agree (bits)
    way1, way2, size1, size2 = (np.ones(lanes, np.int64) for _ in range(4))
    luck1, luck2, live = (np.zeros(lanes, np.int64) for _ in range(3))
    goal, left = (path[out[at]], length[out[at]]) if writing else (lane, lane)
    while len(lane):
        place = node * 40503
        place >>= 2
        place &= (1 << NODES) - 1
        place += base
        counter = nodes[place].astype(np.int64)
        odds = counter >> 8
        p = odds >> 6
        np.maximum(p, 32, out=p)
        np.minimum(p, ONE - 32, out=p)
        some = np.flatnonzero(live)
        if len(some):
            own, alive, next_ = lane[some], live[some], depth[some] + 1
            on1, on2 = alive & 1, alive >> 1
            bit1, bit2 = way1[some] >> (size1[some] - next_) & 1, way2[some] >> (size2[some] - next_) & 1
            at1, at2 = own * 8 + luck1[some], own * 8 + luck2[some]
            trust1, trust2 = trust[0][at1], trust[1][at2]
            x0, x1, x2 = STRETCH[p[some] >> 4], STRETCH[trust1 >> 4] * (2 * bit1 - 1) * on1, STRETCH[trust2 >> 4] * (2 * bit2 - 1) * on2
            set_ = own * 16 + on2 * (1 + np.minimum(luck2[some], 2)) * 4 + on1 * (1 + np.minimum(luck1[some], 2))
            w0, w1, w2 = (w[set_] for w in weights)
            sum_ = (w0 * x0 + w1 * x1 + w2 * x2 >> 16) + 2048
            mixed = SQUASH[np.minimum(np.maximum(sum_, 1), 4095)]
            p[some] = mixed
        if writing:
            left -= 1
            y = goal >> left & 1
            coder.code(p, y == 1)
        else:
            y = coder.code(p, None).astype(np.int64)
        if len(some):
            err = ((y[some] << 16) - mixed) * 10
            for w, old, x in zip(weights, (w0, w1, w2), (x0, x1, x2)):
                w[set_] = old + (x * err >> 20)
            right1, right2 = (bit1 == y[some]) * on1, (bit2 == y[some]) * on2
            trust[0][at1] = trust1 + on1 * (right1 * (ONE - 1) - trust1 >> 5)
            trust[1][at2] = trust2 + on2 * (right2 * (ONE - 1) - trust2 >> 5)
            live[some] = right1 | right2 << 1
        seen = counter & 255
        odds += (y * ((1 << 22) - 1) - odds) * RATE[seen] >> 16
        odds <<= 8
        odds |= np.minimum(seen + 1, LIMIT)
        nodes[place] = odds
        node <<= 1
        node |= y
        depth += 1
        done = np.flatnonzero(node < stop[depth])
        if not len(done):
            continue
        found = node[done] + shift[depth[done]]
        here = at[done]
        if not writing:
            out[here] = found
        for table, slot in zip(guesses, (slot1[done], slot2[done])):
            guess = table[slot]
            luck = guess & 7
            table[slot] = np.where(guess >> 3 == found + 1, guess + (luck < 7), np.where(luck == 0, found + 1 << 3, (guess & ~7) | luck >> 1))
        last2[done] = last1[done]
        last1[done] = found + 1
        a, own = (found + 1) * 40503, lane[done] << SLOTS
        slot1[done] = next1 = own + (a >> 3 & (1 << SLOTS) - 1)
        slot2[done] = next2 = own + ((a ^ last2[done] * 210077) >> 4 & (1 << SLOTS) - 1)
        guess1, guess2 = guesses[0][next1].astype(np.int64), guesses[1][next2].astype(np.int64)
        id1, id2 = np.maximum((guess1 >> 3) - 1, 0), np.maximum((guess2 >> 3) - 1, 0)
        way1[done], size1[done], luck1[done] = path[id1], length[id1], guess1 & 7
        way2[done], size2[done], luck2[done] = path[id2], length[id2], guess2 & 7
        # after one id a guess counts once it was right, after two at once
        live[done] = (guess1 & 7 > 0) | (guess2 > 0) << 1
        node[done], depth[done] = 1, 0
        here += 1
        at[done] = here
        if writing:
            after = out[np.minimum(here, len(out) - 1)]
            goal[done], left[done] = path[after], length[after]
        over = here == end[done]
        if over.any():
            stays = np.ones(len(lane), bool)
            stays[done[over]] = False
            k = np.flatnonzero(stays)
            coder.keep(k)
            lane, base, node, depth, at, end, last1, last2 = (x[k] for x in (lane, base, node, depth, at, end, last1, last2))
            slot1, slot2, way1, way2, size1, size2, luck1, luck2, live = (x[k] for x in (slot1, slot2, way1, way2, size1, size2, luck1, luck2, live))
            goal, left = goal[k], left[k]
    return out


def write_file(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be from 0 to 2**32 - 1")
    cuts = np.arange(0, len(ids), BLOCK)
    sizes = np.diff(np.append(cuts, len(ids)))
    table, coded = b"", []
    if len(ids):
        code, places = Code.of(ids)
        table = code.table()
        for k in range(0, len(cuts), LANES):
            own = sizes[k : k + LANES]
            coder = Coder(len(own))
            _run(code, own, places[cuts[k] : cuts[k] + int(own.sum())], coder)
            coded += coder.written(len(own))
    head = [MAGIC, struct.pack("<IQI", len(cuts), len(ids), len(table)), table]
    for a, n, words in zip(cuts, sizes, coded):
        head.append(struct.pack("<III", n, len(words), zlib.crc32(ids[a : a + n].astype("<u4").tobytes())))
    front = b"".join(head)
    return b"".join([front, struct.pack("<I", zlib.crc32(front)), *coded])


def read_blocks(data: bytes) -> list[np.ndarray | None]:
    """The ids of each block, None for a damaged one."""
    first = len(MAGIC) + 16
    if data[: len(MAGIC)] != MAGIC or len(data) < first:
        raise ValueError("not a token file")
    count, total, size = struct.unpack_from("<IQI", data, len(MAGIC))
    at = first + size + 12 * count
    if len(data) < at + 4 or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the file's head is damaged")
    heads = np.frombuffer(data, "<u4", 3 * count, first + size).reshape(count, 3).astype(np.int64)
    if not count:
        return []
    code = Code.read(data[first : first + size])
    body = np.frombuffer(data[at + 4 :][: (len(data) - at - 4) // 2 * 2], "<u2").astype(np.int64)
    ends = np.cumsum(heads[:, 1] // 2)
    out: list[np.ndarray | None] = []
    for k in range(0, count, LANES):
        own, stop = heads[k : k + LANES], np.minimum(ends[k : k + LANES], len(body))
        start = np.minimum(ends[k : k + LANES] - own[:, 1] // 2, len(body))
        ids = code.symbols[_run(code, own[:, 0], None, Coder(len(own), body, start, stop))]
        for block, crc in zip(np.split(ids, np.cumsum(own[:, 0])[:-1]), own[:, 2]):
            out.append(block if zlib.crc32(block.astype("<u4").tobytes()) == crc else None)
    return out


def read_file(data: bytes) -> np.ndarray:
    blocks = read_blocks(data)
    lost = [k for k, b in enumerate(blocks) if b is None]
    if lost:
        raise ValueError(f"blocks fail their checksum: {lost}")
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def _on_jvm(spark: SparkSession, what: str) -> str:
    """Write (of a code's table and the ids' places) or Read (of a file), as a function of Spark's."""
    settings = np.concatenate([[BLOCK, DEEPEST, NODES, SLOTS, LIMIT], STRETCH, SQUASH, RATE]).astype("<i4").tobytes()
    return jvm.register(spark, f"marlstone_token_file_{what.lower()}", "RangeCoder.java", f"marlstone.RangeCoder${what}", MAGIC, settings)


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written dataset: (run, file, n_ids, documents, data), runs in ascending doc_id order."""
    ship_code(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        codec = tokens.codec(vocabulary)
        held: list[np.ndarray] = []
        names: list[tuple[int, int, int]] = []
        size = number = 0

        def close() -> pd.DataFrame:
            ids = np.concatenate(held)
            table = b"".join(struct.pack("<?qI", *x) for x in names)
            code, places = Code.of(ids)
            return pd.DataFrame({"run": [part], "file": [number], "n_ids": [len(ids)], "documents": [zlib.compress(table)], "code": [code.table()], "places": [places.astype("<i4").tobytes()]})

        for pdf in frames:
            at, known = 0, ids_of(pdf)
            for batch in tokens.batches(pdf["text"].tolist(), tokens.PIECE * 2):
                for name, ids in zip(known[at : at + len(batch)], codec.encode(batch)):
                    held.append(np.append(ids, ids.dtype.type(end_id)))
                    names.append((name is None, name or 0, len(ids) + 1))
                    size += len(ids) + 1
                at += len(batch)
                if size >= FILE_IDS:
                    yield close()
                    held, names, size, number = [], [], 0, number + 1
        if held:
            yield close()
        release()  # the codec keeps its words for the worker's next task

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.xxhash64(text_col).alias("_tie"))
    placed = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select(*id_columns("doc_id"), "text")
    coded = placed.mapInPandas(run, "run int, file int, n_ids long, documents binary, code binary, places binary")
    data = F.call_udf(_on_jvm(docs.sparkSession, "Write"), "code", "places").alias("data")
    return materialise(coded.select("run", "file", "n_ids", "documents", data), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file_bytes of every document, from the files alone."""
    sizes = files.groupBy("run").agg(F.sum("n_ids").alias("n"))
    # one row for each task that wrote: thousands at most
    starts, total = [], 0
    for r in sorted(sizes.collect()):
        starts += [0] * (r["run"] + 1 - len(starts))
        starts[r["run"]] = total
        total += r["n"]
    base = F.array(*[F.lit(x).cast("long") for x in starts or [0]])[F.col("run")]
    before = F.sum("n_ids").over(Window.partitionBy("run").orderBy("file")) - F.col("n_ids")
    places = files.select("run", "file", (base + before).alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, number, table, ids in zip(pdf["run"], pdf["file"], pdf["documents"], pdf["ids"]):
                entries = list(struct.iter_unpack("<?qI", zlib.decompress(bytes(table))))
                rows, at = [], 0
                for null, name, n in entries:
                    rows.append((part, number, None if null else name, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)])))
                    at += n
                out = pd.DataFrame(rows, columns=["run", "file", "doc_id", "at", "n_tokens", "ids_crc32"])
                out["doc_id"] = longs([r[2] for r in rows])
                yield out
        release()

    ids = F.call_udf(_on_jvm(files.sparkSession, "Read"), "data").alias("ids")
    found = files.select("run", "file", "documents", ids).mapInPandas(run, "run int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(places, ["run", "file"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
