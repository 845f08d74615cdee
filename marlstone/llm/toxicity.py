"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A text is
cut into overlapping windows; each window is compressed under either dictionary, and the bytes
that the toxic one saves are the window's gain.  A text's features are its largest gain, and the
number and share of windows that pass each of three gains; a logistic model fitted on training
rows that the dictionaries haven't seen calibrates them to a score.

Toxic texts are mostly ordinary prose, so dictionaries trained on whole texts of either kind would
be alike.  The toxic one's samples are therefore the places that tell the two kinds apart: the
words whose beginnings stand in a far larger share of toxic training documents than of ordinary
ones, each occurrence one sample.  Both dictionaries end with the one trained on ordinary
windows, so that ordinary prose gains nothing under either.

Training documents are whole and bounded in number: ``PER_CLASS`` of each label.  Scoring reads
whole texts.  Labels, language, source and id are never inputs.

Cases: null and empty texts score as a text without windows; a text shorter than a window is one
window; equal texts score equally; without training rows of both labels every score is 0;
extra columns are kept by keep_clean().
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, ship_code

PER_CLASS = 2000  #: labelled documents used for training, for each label
SIZE = 16 << 10  #: bytes of the ordinary dictionary
TOXIC_SIZE = 4 << 10  #: bytes, at most, of the toxic one before the ordinary content
WORD = re.compile(rb"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def windows(raw: bytes, size: int = 64, stride: int = 48) -> list[bytes]:
    """Overlapping windows that cover the whole text."""
    return [raw[k : k + size] for k in range(0, max(1, len(raw) - size + stride), stride)]


def telling_beginnings(toxic: list[bytes], ordinary: list[bytes], ratio: float = 20.0, shortest: int = 4, longest: int = 12) -> list[bytes]:
    """The shortest beginnings of words (or whole words) whose share of toxic documents is
    ``ratio`` times their share of ordinary ones, the most frequent first."""
    least = max(3, len(toxic) // 50)

    def cut(w: bytes) -> Iterator[bytes]:
        return (w[:n] for n in range(shortest, min(len(w), longest) + 1))

    def shares(texts: list[bytes]) -> Counter:
        return Counter(x for t in texts for x in {x for w in set(WORD.findall(t)) for x in cut(w)})

    seen, other = shares(toxic), shares(ordinary)
    telling = {x for x, n in seen.items() if n >= least and (n / len(toxic)) / ((other[x] + 0.5) / len(ordinary)) >= ratio}
    # what only copies of a few texts share stands after few different words
    after = defaultdict(set)
    for t in toxic:
        words = WORD.findall(t)
        for before, w in zip([b"", *words], words):
            for x in cut(w):
                if x in telling:
                    after[x].add(before)
    telling = {x for x in telling if len(after[x]) >= least}
    first = [x for x in telling if not any(x[:n] in telling for n in range(shortest, len(x)))]
    return sorted(first, key=lambda x: (-seen[x], x))


def trained(samples: list[bytes], size: int, segment: int, piece: int) -> bytes:
    """A dictionary's content, trained by zstandard.  Few samples are given to the trainer several
    times over, as it asks for eight times the size of the dictionary."""
    import zstandard

    total = sum(map(len, samples))
    if not total:
        return b""
    return zstandard.train_dictionary(size, samples * max(1, -(-8 * size // total)), k=segment, d=piece).as_bytes()


class Distance:
    """Lengths of windows under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            window_log=17, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.compress = []
        for content in (toxic + ordinary, ordinary):
            d = z.ZstdCompressionDict(content or b" " * 16, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compress.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def gains(self, raw: bytes) -> np.ndarray:
        toxic, ordinary = self.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(raw)])


@dataclass
class Model:
    """Two dictionaries, the calibrated gains, and the weights over the features."""

    toxic: bytes
    ordinary: bytes
    gates: tuple[int, ...] = (1, 2, 4)
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.distance = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "distance"} | {"distance": None}

    def features(self, raw: bytes) -> np.ndarray:
        if self.distance is None:
            self.distance = Distance(self.toxic, self.ordinary)
        g = self.distance.gains(raw)
        hits = [int((g >= x).sum()) for x in self.gates]
        return np.array([1.0, int(g.max()), *[math.log1p(h) for h in hits], *[min(1.0, 4 * h / len(g)) for h in hits]])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.features(lowered(text)) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(texts: list[str | None], labels: list[int], size: int = SIZE) -> Model:
    """Dictionaries from one half of the training texts, calibration on the other."""
    raw = [lowered(t) for t in texts]
    y = np.array(labels, float)
    half = [np.arange(len(raw)) % 2 == h for h in (0, 1)]
    if not (half[0] & (y == 1)).any() or not (half[0] & (y == 0)).any():
        return Model(b"", b"")
    toxic = [r for r, u, v in zip(raw, half[0], y) if u and v == 1]
    ordinary = [r for r, u, v in zip(raw, half[0], y) if u and v == 0]
    base = trained([w for t in ordinary for w in windows(t, 128, 128)], size, 64, 8)
    begin = set(telling_beginnings(toxic, ordinary))
    telling = [b" %s " % w for t in toxic for w in WORD.findall(t) if any(w[:n] in begin for n in range(4, 13))]
    model = Model(trained(telling, TOXIC_SIZE, 32, 6), base)
    x = np.array([model.features(r) for r, u in zip(raw, half[1]) if u])
    model.weights = _logistic(x, y[half[1]])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge
    eye[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of labelled documents that aren't held out; the same rows at every run."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for y in (0, 1):  # a bounded number of ids of each label, by a hash of the id
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])  # at most 2 * per_class documents
    return fit([r["text"] for r in got], [r["toxic"] for r in got])


def scored(docs: DataFrame, model: Model, column: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of docs and the score."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries and eight weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield texts.map(model.score).astype("float64")
        release()

    return docs.withColumn(column, score(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold; all columns as they are."""
    name = fresh(docs, "_toxicity_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)
