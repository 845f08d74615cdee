"""Exact token ids for whole batches of texts, by distinct words.

The vocabulary's own rules are: canonical composition, white space dropped, lower case, then
words (contractions, letter runs, single digits, runs of anything else), each encoded for
itself.  So a batch is cut into words with numpy over code points, equal words are grouped by
hash and then compared letter by letter with the first of their group, and each distinct word is
encoded once by the tokenizers library (or by any function given).  Texts that hold the strings
of special tokens are cut at them first.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

LETTER, DIGIT, OTHER = 1, 2, 3
PIECE = 1 << 20  #: characters handled at once
MEMORY = 400_000  #: distinct words remembered
TOGETHER = 512  #: words given to the library as one text

_CLASSES: np.ndarray | None = None
_CODECS: dict[str, WordCodec] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def char_classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                first, last = ord(m[0][0]), ord(m[0][-1])
                table[first : last + 1] = kind
        # The code points with the White_Space property
        for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            table[c] = 0
        _CLASSES = table
    return _CLASSES


def normalised(text: str) -> str:
    """NFC and lower case letter by letter (no final-sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def cut_words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in an array of code points that ends with white space."""
    kind = char_classes().take(cp)
    before = np.empty_like(kind)
    before[0] = 0
    before[1:] = kind[:-1]
    start = (kind != 0) & ((kind != before) | (kind == DIGIT))
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        x, y = pad[quote + 1], pad[quote + 2]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        for at, n in ((quote[one], 1), (quote[two], 2)):
            start[at + 1] = False
            after = at + 1 + n
            after = after[after < len(cp)]
            start[after] |= kind[after] == LETTER
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, starts
    # a word ends where the next one starts or where white space follows it
    space = np.flatnonzero((kind == 0) & (before != 0))
    nearest = space[np.searchsorted(space, starts, side="right")]
    following = np.append(starts[1:], len(cp))
    return starts, np.minimum(nearest, following)


class WordCodec:
    """Encodes batches; remembers a bounded number of distinct words."""

    def __init__(self, path: str, encode_words: Callable[[list[str]], list[list[int]]] | None = None, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.encode_words = encode_words
        if encode_words is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(self.tokens) + 1, bool)
            self.ends[[k for k, t in self.tokens.items() if suffix and t.endswith(suffix)]] = True
        self.kind = np.dtype("<u2" if max(self.tokens) < 65536 else "<u4")
        self.known: dict[str, bytes] = {}

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words."""
        if len(self.known) > self.memory:
            self.known = {}
        out = list(map(self.known.get, words))
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            unknown = [words[k] for k in new]
            for k, w, x in zip(new, unknown, self._packed(unknown)):
                out[k] = self.known[w] = x
        return out

    def _packed(self, words: list[str]) -> list[bytes]:
        if self.encode_words is not None:
            return [np.array(ids, self.kind).tobytes() for ids in self.encode_words(words)]
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1  # the last token of each word
            if len(last) != len(group) or last[-1] != len(ids):
                out += [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(group, add_special_tokens=False)]
                continue
            raw, cuts = ids.tobytes(), (last * self.kind.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def forget(self) -> None:
        """Let go of the words of a task that has ended."""
        self.known = {}

    def words(self, texts: list[str]):
        """For a batch: (packed ids of each distinct word, the distinct words' numbers in order of
        the text, the number of words of each text).  A special token counts as a word."""
        pieces, owners = [], []
        for k, text in enumerate(texts):
            if "<|" in text and self.cut.search(text):
                for part in self.cut.split(text):
                    pieces.append(f"{part}" if False else part)
                    owners.append((k, self.special.get(part)))
            else:
                pieces.append(text)
                owners.append((k, None))
        clean = ["" if s is not None else normalised(p) for p, (_, s) in zip(pieces, owners)]
        whole = "\n".join(clean) + "\n"
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = cut_words(cp)
        bounds = np.cumsum([len(c) + 1 for c in clean])
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
        if len(starts):
            cp = cp[starts[0] :]
            begins = starts - starts[0]
            span = np.diff(np.append(begins, len(cp)))
            place = np.arange(len(cp)) - np.repeat(begins, span)
            inside = char_classes().take(cp) != 0
            power = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            mixed = (cp.astype(np.uint64) + np.uint64(0x51ED2701)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            mixed *= power.take(place)
            mixed *= inside  # white space between words counts nothing
            hashes = np.add.reduceat(mixed, begins)
            hashes ^= hashes >> np.uint64(32)
            hashes *= np.uint64(0xD6E8FEB86659FD93)
            _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            # a group's words are compared with its first one; those that differ stand alone
            place += np.repeat(begins[first][number], span)
            unlike = inside & (cp.take(place, mode="clip") != cp)
            wrong = ends - starts != (ends - starts)[first][number]
            if unlike.any():
                wrong |= np.logical_or.reduceat(unlike, begins)
            words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            if wrong.any():
                own: dict[str, int] = {}
                for w in np.flatnonzero(wrong).tolist():
                    number[w] = own.setdefault(whole[starts[w] : ends[w]], len(first) + len(own))
                words += own
            table = self._lookup(words)
        else:
            table, number = [], np.zeros(0, np.int64)
        if any(s is not None for _, s in owners):
            at = np.cumsum(counts)
            where = [int(at[i]) for i, (_, s) in enumerate(owners) if s is not None]
            put = [s for _, s in owners if s is not None]
            base = len(table)
            for s in dict.fromkeys(put):
                table.append(np.array([s], self.kind).tobytes())
            code = {s: base + i for i, s in enumerate(dict.fromkeys(put))}
            number = np.insert(number, where, [code[s] for s in put])
            counts = counts + np.array([s is not None for _, s in owners])
        per_text = np.bincount([k for k, _ in owners], weights=counts, minlength=len(texts)).astype(np.int64)
        return table, number, per_text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint16 where the vocabulary allows it."""
        out: list[np.ndarray] = []
        for batch in batches(texts):
            table, number, per_text = self.words(batch)
            if not len(number):
                out += [np.zeros(0, self.kind)] * len(batch)
                continue
            sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
            flat = np.frombuffer(b"".join(table), self.kind)
            begin = np.cumsum(sizes) - sizes
            n = sizes[number]
            past = np.cumsum(n)
            ids = flat.take(np.repeat(begin[number] - (past - n), n) + np.arange(past[-1]))
            ends = np.concatenate([[0], past])[np.cumsum(per_text)]
            out += np.split(ids, ends[:-1])
        return out


def batches(texts: list[str], most: int = PIECE):
    """Runs of texts with about so many characters; a longer text stands alone."""
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def codec(path: str) -> WordCodec:
    """The worker's codec for a vocabulary, built once."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]
