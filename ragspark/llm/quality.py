"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words are runs of letters (lower-cased), of digits and of other signs, and after each run of letters its shape (small,
capitalised, capitals, mixed). A word is hashed into a bucket with a sparse random index vector of a few +1 and -1. Its
context vector is the sum of the index vectors of its neighbours within REACH words, over all texts of the corpus; a word's
vector is its index vector plus its scaled context vector. A document is the mean of its words' vectors; a layer of
rectified units and a logistic unit score it. The network is trained by stochastic gradient descent on a bounded sample of
labelled rows (SAMPLE, chosen by a hash of key and text; equal texts of one label count once); a held part of it sets the
temperature. Context sums and words of whole texts are counted by Spark tasks.

Defined results: null and empty texts count as no words and get the score of the zero vector; without labelled rows every
score is 0.5; ties don't matter, as every row is scored by itself; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.shared import share_of

HASHED, SHAPES = 8192, 4
BUCKETS = HASHED + SHAPES
WIDTH, NONZERO, REACH = 64, 4, 2
HIDDEN, SAMPLE, EPOCHS, BATCH, RATE = 32, 6_000, 30, 32, 0.05
#: Score from which a document is accepted.
ACCEPT = 0.3
AT_ONCE = 1_000_000


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind (0 white space, 1 letter, 2 digit, 3 other), small letter, whether it is a capital."""
    every = [chr(i) for i in range(0x110000)]
    kind = np.fromiter((0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 for c in every), np.uint8, len(every))
    small = np.fromiter((ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(every)), np.uint32, len(every))
    return kind, small, np.fromiter((c.isupper() for c in every), bool, len(every))


def words(text: str) -> Iterator[np.ndarray]:
    """Buckets of the words and shapes in their order, for each part of at most AT_ONCE characters."""
    kinds, smalls, capitals = _characters()
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    at = 0
    while at < len(text):
        end = min(len(text), at + AT_ONCE)
        if end < len(text):  # cut at white space where there is some
            space = text.rfind(" ", at, end)
            end = space + 1 if space > at else end
        c = np.frombuffer(text[at:end].encode("utf-32-le"), "<u4")
        at = end
        kind = kinds[c]
        begins = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        own = kind[begins]
        sizes = np.diff(np.append(begins, len(c)))
        place = (np.arange(len(c)) - np.repeat(begins, sizes)) & 63
        mixed = np.add.reduceat(smalls[c].astype(np.uint64) * power[place], begins)
        bucket = ((mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.int64)
        upper = np.add.reduceat(capitals[c].astype(np.int64), begins)
        shape = HASHED + np.where(upper == 0, 0, np.where((upper == sizes) & (sizes > 1), 2, np.where((upper == 1) & capitals[c[begins]], 1, 3)))
        both = np.stack([bucket, shape], axis=1)
        yield both[np.stack([own != 0, own == 1], axis=1)]


@lru_cache(maxsize=1)
def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each bucket's index vector."""
    random = np.random.default_rng(11)
    places = np.stack([random.choice(WIDTH, NONZERO, replace=False) for _ in range(BUCKETS)])
    return places, random.choice((-1.0, 1.0), (BUCKETS, NONZERO))


def index_vectors() -> np.ndarray:
    places, signs = _index()
    out = np.zeros((BUCKETS, WIDTH))
    np.put_along_axis(out, places, signs, axis=1)
    return out / np.sqrt(NONZERO)


class Contexts:
    """Sums of the index vectors' signs over each word's neighbours. Neighbours across a cut of AT_ONCE characters don't count.

    Pairs of neighbours are sorted and counted first; so many texts at once hold most of their pairs often."""

    def __init__(self) -> None:
        self.total, self.waiting, self.size = np.zeros(BUCKETS * WIDTH), [], 0

    def add(self, text: str, at_once: int = 8_000_000) -> None:
        for w in words(text):
            w = w.astype(np.uint32)
            for d in range(1, REACH + 1):
                self.waiting.append(w[:-d] << np.uint32(16) | w[d:])
                self.size += len(w)
        if self.size > at_once:
            self.count()

    def count(self) -> np.ndarray:
        """The sums of all texts so far."""
        keys, (places, signs) = np.sort(np.concatenate(self.waiting)) if self.size else np.zeros(0, np.uint32), _index()
        if len(keys):
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(begins, len(keys)))[:, None]
            pair = (keys[begins] >> np.uint32(16)).astype(np.int64), (keys[begins] & np.uint32(65535)).astype(np.int64)
            for a, b in (pair, pair[::-1]):
                self.total += np.bincount((a[:, None] * WIDTH + places[b]).ravel(), (times * signs[b]).ravel(), BUCKETS * WIDTH)
        self.waiting, self.size = [], 0
        return self.total.reshape(BUCKETS, WIDTH)


def contexts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context sums over all these texts, whole: each task sums its own, then Spark sums by word."""
    names = [f"c{k}" for k in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Contexts()
        for batch in batches:
            for x in batch.column(0):
                own.add(x.as_py() or "")
        total = np.rint(own.count()).astype(np.int64)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c) for c in total[some].T)], names=["bucket", *names])

    sums = docs.select(text).mapInArrow(run, ", ".join(f"{c} long" for c in ["bucket", *names])).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
    rows, out = sums.toPandas(), np.zeros((BUCKETS, WIDTH))  # a row for each of BUCKETS at most
    out[rows["bucket"]] = rows[names]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return index_vectors() + sums / np.maximum(norms, 1e-9) * (norms > 0)


@dataclass
class Model:
    vectors: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    heat: float

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.first + self.first_bias, 0) @ self.second + self.second_bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(pooled_of(text, self.vectors)) / self.heat, -50, 50))))


def train(pooled: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Model:
    random = np.random.default_rng(5)
    first = random.normal(0, np.sqrt(2 / WIDTH), (WIDTH, HIDDEN))
    model = Model(vectors, first, np.zeros(HIDDEN), random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0, 1.0)
    if not len(labels):
        model.second[:] = 0
        return model
    order = random.permutation(len(labels))
    held, fitted = order[: len(order) // 5], order[len(order) // 5 :]
    scale = 1 / max(1e-9, float(pooled.std()))
    x, y, moved = pooled * scale, labels.astype(float), [np.zeros_like(model.first), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0]
    for epoch in range(EPOCHS):
        random.shuffle(fitted)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(fitted), BATCH):
            some = fitted[at : at + BATCH]
            inner = x[some] @ model.first + model.first_bias
            out = np.maximum(inner, 0)
            error = (1 / (1 + np.exp(-np.clip(out @ model.second + model.second_bias, -50, 50))) - y[some]) / len(some)
            back = np.outer(error, model.second) * (inner > 0)
            for k, slope in enumerate((x[some].T @ back + 1e-4 * model.first, back.sum(axis=0), out.T @ error + 1e-4 * model.second, error.sum())):
                moved[k] = 0.9 * moved[k] - rate * slope
            model.first, model.first_bias = model.first + moved[0], model.first_bias + moved[1]
            model.second, model.second_bias = model.second + moved[2], model.second_bias + moved[3]
    model.first = model.first * scale
    some = held if len(held) else fitted
    raw = model.raw(pooled[some])
    loss = lambda t: np.logaddexp(0, np.where(y[some] > 0, -raw, raw) / t).mean()
    model.heat = float(min(np.geomspace(0.25, 8, 31), key=loss))
    return model


def pooled_of(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """The mean of the vectors of a text's words; zeros for a text without any."""
    total, n = np.zeros(WIDTH), 0
    for w in words(text or ""):
        n += len(w)
        total += vectors[w].sum(axis=0) if len(w) < 5000 else np.bincount(w, minlength=BUCKETS) @ vectors
    return total / max(1, n)


def fit(labelled: DataFrame, sums: np.ndarray | None = None, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The model of labelled rows (label 0 or 1). Only text and label are learned from. sums: context sums of the corpus, else
    those of the labelled texts."""
    vectors = word_vectors(contexts(labelled, text) if sums is None else sums)
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"), F.col(key).alias("key")).filter("label in (0, 1)")
    chosen = rows.filter(share_of(sample, rows.count(), "key", "text")).select("label", "text").distinct()
    sent = labelled.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "pooled": [pooled_of(x, sent.value).tobytes() for x in batch["text"]]})

    got = chosen.mapInPandas(features, "label int, pooled binary").toPandas().sort_values(["label", "pooled"])  # one order, whatever the tasks'
    return train(np.frombuffer(b"".join(got["pooled"]), float).reshape(-1, WIDTH), got["label"].to_numpy(), vectors)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the calibrated probability that its label is 1. A column of that name is replaced."""
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType(), False)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            column = pa.array([of.score(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
