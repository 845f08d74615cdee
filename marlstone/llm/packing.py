"""Vector bin packing of token sequences by the dot-product heuristic.

An item is what is left of a document, with demands on three dimensions: tokens, segments (one)
and loss-bearing tokens.  The first ``PROMPT`` tokens of a document are its prompt and bear no
loss; a sequence holds at most ``LOSS`` tokens that do.  So a sequence from the middle of a long
document is full at ``LOSS`` tokens, unless the beginnings of others fill it up.  A bin takes, again
and again, the fitting item whose demand has the largest dot product with what the bin still has,
both in units of the limits.  Where none fits, an item is cut to fill the bin.  What cannot fill a
last sequence is cut to sequences whose lengths are powers of two, which need no padding.

Each partition packs what it reads, in windows of ``WINDOW`` documents whose part-filled bins
go back to the pool: no shuffle, memory bounded by a window, and a lost task packs its own rows
again.  Sequence numbers are ``partition << 32 | number``.

Cases: null and empty texts are one end token; a document longer than a sequence fills whole
sequences first; equal ids and repeated rows are separate documents in their own pieces; an
empty table gives no piece; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import tokens
from .common import id_columns, ids_of, longs, release, ship_code, text_or_empty

WINDOW = 4096
PROMPT = 16  #: tokens at a document's start that bear no loss
LOSS = 2032  #: loss-bearing tokens of a sequence, at most
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Gives places to items; sequences are numbered as they open."""

    def __init__(self, limit: int = 2048, segments: int = 256, loss: int = LOSS, prompt: int = PROMPT):
        if min(limit, segments, loss) < 1 or prompt < 0:
            raise ValueError("limits must be positive")
        self.limit, self.segments, self.loss, self.prompt = limit, segments, loss, prompt
        self.opened = 0
        self.pool: list[tuple[int, int, int]] = []  #: (document, start, tokens left)

    def bearing(self, start, length):
        """Loss-bearing tokens of a piece: those past its document's prompt."""
        return length - np.minimum(length, np.maximum(0, self.prompt - start))

    def _most(self, start: int, room: int, loss: int) -> int:
        """Tokens that a piece from ``start`` may have."""
        return min(room, loss + max(0, self.prompt - start))

    def _open(self) -> int:
        self.opened += 1
        return self.opened - 1

    def add(self, document: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of the sequences that a long document
        fills by itself; the rest waits for fill()."""
        start = 0
        while length - start >= self.limit:
            n = self._most(start, self.limit, self.loss)
            yield document, start, n, self._open(), 0
            start += n
        if length > start:
            self.pool.append((document, start, length - start))

    def fill(self, last: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """Places of what the pool holds.  What cannot fill a sequence stays, unless last."""
        doc, start, left = (np.array(x, np.int64) for x in (zip(*self.pool) if self.pool else ((), (), ())))
        self.pool = []
        alive = np.ones(len(doc), bool)
        total = int(left.sum())
        while alive.any():
            if total < self.limit and not last:
                break
            room, seats, loss = self.limit, self.segments, self.loss
            placed: list[tuple[int, int, int]] = []
            while room and seats and loss > 0 and alive.any():
                own = np.flatnonzero(alive)
                need, bears = left[own], self.bearing(start[own], left[own])
                fits = (need <= room) & (bears <= loss)
                if fits.any():
                    score = need * (room / self.limit**2) + bears * (loss / self.loss**2) + seats / self.segments**2
                    k = own[int(np.argmax(np.where(fits, score, -1.0)))]
                    n = int(left[k])
                else:
                    k = own[int(np.argmax(need))]
                    n = min(self._most(int(start[k]), room, loss), int(left[k]))
                placed.append((int(k), int(start[k]), n))
                room, seats, loss = room - n, seats - 1, loss - int(self.bearing(int(start[k]), n))
                start[k] += n
                left[k] -= n
                total -= n
                alive[k] = left[k] > 0
            if not alive.any() and room and not last:
                self.pool = [(int(doc[k]), s, n) for k, s, n in placed]
                return
            if not alive.any() and room:
                yield from self._tail([(int(doc[k]), s, n) for k, s, n in placed])
                return
            seq, at = self._open(), 0
            for k, s, n in placed:
                yield int(doc[k]), s, n, seq, at
                at += n
        self.pool += [(int(d), int(s), int(n)) for d, s, n in zip(doc[alive], start[alive], left[alive])]

    def _tail(self, pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        total = sum(n for _, _, n in pieces)
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        seq, at, size = self._open(), 0, sizes.pop(0) if sizes else 0
        for d, s, n in pieces:
            while n:
                if at == size:
                    seq, at, size = self._open(), 0, sizes.pop(0)
                m = min(n, size - at)
                yield d, s, m, seq, at
                s, n, at = s + m, n - m, at + m


def pack(
    docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, segments: int = 256, loss: int = LOSS,
    prompt: int = PROMPT, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document."""
    ship_code(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        codec = tokens.codec(vocabulary)
        packer = Packer(limit, segments, loss, prompt)
        held: dict[int, tuple[object, np.ndarray]] = {}
        count = 0

        def rows(places) -> pd.DataFrame:
            out = []
            for k, start, n, seq, at in places:
                name, ids = held[k]
                crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                out.append((name, start, n, crc, len(ids), first + seq, at, int(packer.bearing(start, n))))
            done = set(held) - {k for k, _, _ in packer.pool}
            for k in done:
                del held[k]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])
            frame["doc_id"] = longs([r[0] for r in out])
            return frame

        for pdf in batches:
            for lo in range(0, len(pdf), WINDOW):
                part = pdf.iloc[lo : lo + WINDOW]
                places = []
                for name, ids in zip(ids_of(part), codec.encode(part["text"].tolist())):
                    held[count] = (name, np.append(ids, ids.dtype.type(end_id)))
                    places += packer.add(count, len(ids) + 1)
                    count += 1
                places += packer.fill(last=False)
                yield rows(places)
        yield rows(list(packer.fill(last=True)))
        codec.forget()
        release()

    return docs.select(*id_columns(id_col), text_or_empty(text_col).alias("text")).mapInPandas(run, SCHEMA)
