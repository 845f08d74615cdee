"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding.  The tokens that
end at a position come from a suffix automaton over the vocabulary (states are prefixes of
tokens, each with a link to its longest proper suffix that is one too).  A token of length L may
end the prefix of length i if it stands alone (L = i) or if the pair (last token of prefix
i - L, token) is compatible, that is, if merging the two spelled-out tokens yields just these
two.  Storing the last token for each prefix makes the encoding a walk along back-pointers.

Words are independent under the vocabulary's rules, so equal words are encoded once for each
batch, and prefixes that words share are kept between words (a bounded number).

Cases: null and empty texts have no token, and the digest of ""; strings of special tokens in a
text become those tokens; any length of word is linear; repeated rows give equal rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import id_columns, ids_of, longs, release, ship_code, text_or_empty

WORDS = 800_000  #: words remembered by a worker, from task to task
PREFIXES = 300_000  #: prefixes remembered
SHARED = 64  #: letters of a prefix that is remembered, at most
PAIRS = 300_000  #: compatibility answers remembered


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next
    free code point from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PrefixEncoder:
    """Words to ids for a merge list whose ids rise with the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for m in model["merges"]:
            x, y = m if isinstance(m, list) else m.split(" ")
            a, b, t = self.vocab[x], self.vocab[y], self.vocab[x + y]
            if (a, b) not in self.merge:
                self.merge[a, b] = t
            self.parts.setdefault(t, (a, b))
        self.pairs: dict[tuple[int, int], bool] = {}
        self._build()
        self.prefixes: dict[str, tuple[int, int]] = {"": (0, -1)}

    # -- automaton ------------------------------------------------------------------------

    def _symbols(self, token: str) -> list[str]:
        """A token's symbols: letters, the last one with the end mark if the token has it."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _build(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        self.length = {}
        for token, t in self.vocab.items():
            symbols = self._symbols(token)
            self.length[t] = len(symbols)
            if len(symbols) > 1 and not self._own(t):
                continue
            s = 0
            for c in symbols:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    ends.append(-1)
                s = self.next[s][c]
            ends[s] = t
        self.link = [0] * len(self.next)
        self.ending: list[tuple[int, ...]] = [()] * len(self.next)
        queue = [0]
        for s in queue:
            for c, n in self.next[s].items():
                if s:
                    f = self.link[s]
                    while f and c not in self.next[f]:
                        f = self.link[f]
                    self.link[n] = self.next[f].get(c, 0)
                self.ending[n] = ((ends[n],) if ends[n] >= 0 else ()) + self.ending[self.link[n]]
                queue.append(n)

    def _own(self, t: int) -> bool:
        """Whether a token spelled out merges back to itself."""
        if t not in self.parts:
            return False
        a, b = self.parts[t]
        return all(x not in self.parts or self._own(x) for x in (a, b)) and self._apart(a, b, below=t)

    def _step(self, s: int, c: str) -> int:
        while s and c not in self.next[s]:
            s = self.link[s]
        return self.next[s].get(c, 0)

    # -- compatibility --------------------------------------------------------------------

    def _apart(self, left: int, right: int, below: int | None = None) -> bool:
        """No merge earlier than ``below`` joins the two tokens while they are being built.

        Goes down the two tokens along their shared border: whichever of the two inner tokens
        was made later is taken apart first, and a merge across the border counts if it comes
        before the one that was undone last.
        """
        limit = below if below is not None else 1 << 62
        while True:
            made = self.merge.get((left, right))
            if made is not None and made < limit:
                return False
            if left in self.parts and (left > right or right not in self.parts):
                limit = left
                left = self.parts[left][1]
            elif right in self.parts:
                limit = right + 1
                right = self.parts[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(left, right)
        return found

    # -- encoding -------------------------------------------------------------------------

    def _last(self, state: int, i: int, before) -> int:
        """The token that ends the encoding of a prefix of length i; before(j) is that of length j."""
        for t in self.ending[state]:
            n = self.length[t]
            if n == i:
                return t
            if n < i:
                left = before(i - n)
                if left >= 0 and self.compatible(left, t):
                    return t
        return -1

    def encode_word(self, word: str) -> list[int]:
        if word.isascii() and word.isprintable():  # these bytes' letters are themselves
            body = word
        else:
            body = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])
        n = len(body)
        if not n:
            return []
        head = body[:-1] if self.suffix else body
        known = self.prefixes
        if len(known) > PREFIXES:
            known = self.prefixes = {"": (0, -1)}
        if len(head) > SHARED:  # prefixes of long words aren't shared
            last, state = [-1], 0
            before = last.__getitem__
            for i, c in enumerate(head, 1):
                state = self._step(state, c)
                last.append(self._last(state, i, before))
        else:
            # with a prefix all shorter ones are known
            i = len(head)
            while head[:i] not in known:
                i -= 1
            state = known[head[:i]][0]
            before = lambda j: known[head[:j]][1]
            for i in range(i + 1, len(head) + 1):
                state = self._step(state, head[i - 1])
                known[head[:i]] = (state, self._last(state, i, before))
        t = self._last(self._step(state, body[-1] + self.suffix), n, before) if self.suffix else before(n)
        out, i = [], n
        while True:
            out.append(t)
            i -= self.length[t]
            if i <= 0:
                return out[::-1]
            t = before(i)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.encode_word(w) for w in words]


_CODECS: dict[str, tokens.WordCodec] = {}


def codec(path: str) -> tokens.WordCodec:
    if path not in _CODECS:
        _CODECS[path] = tokens.WordCodec(path, PrefixEncoder(path).encode_words, WORDS)
    return _CODECS[path]


def decode(ids: list[int], names: dict[int, str]) -> str:
    """The vocabulary has no decoder of its own: tokens joined by one space; ids that it does
    not know are left out."""
    return " ".join([names[i] for i in ids if i in names])


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_words."""
    ship_code(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(vocabulary)
        for pdf in frames:
            counts, digests, decoded, words = [], [], [], []
            for batch in tokens.batches(pdf["text"].tolist()):
                table, number, per_text = coder.words(batch)
                lists = [np.frombuffer(x, coder.kind).tolist() for x in table]
                as_ids = [" ".join(map(str, x)) for x in lists]
                as_text = [decode(x, coder.tokens) for x in lists]
                sizes = np.array([len(x) for x in lists], np.int64)
                at, order = 0, number.tolist()
                for n in per_text.tolist():
                    own = order[at : at + n]
                    counts.append(int(sizes[number[at : at + n]].sum()))
                    digests.append(hashlib.sha256(" ".join([as_ids[k] for k in own]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join([as_text[k] for k in own]).encode("utf-8", "surrogatepass")).hexdigest())
                    words.append(n)
                    at += n
            yield pd.DataFrame({"doc_id": longs(ids_of(pdf)), "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": decoded, "n_words": words})
        release()

    return docs.select(*id_columns(id_col), text_or_empty(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long"
    )
