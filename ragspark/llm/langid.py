"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text's subwords are its runs of 1 to 4 characters, lower-cased, white space as one border character, without runs that
have a border inside. Each is hashed into one of BUCKETS embeddings; their average goes through a linear layer and a
softmax. Embeddings and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows
(SAMPLE in all, alike for each language, chosen by a hash of key and text, so copies of one text are chosen each by itself; equal
texts of one language then count once; twice SAMPLE at most, the first by their texts' hashes). A held part of the sample gives the softmax its temperature and
the score below which a prediction is rejected: the score that ALLOWED of the rightly labelled held texts fall below, at most
CAUTIOUS. Counting subwords of whole texts, in training and prediction, is done by Spark tasks.

Defined results: a null text or one without a letter (Unicode category L) is `und` with score 0 and rejected; so is all without labelled rows.
Ties between languages go to the first by name; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, WIDTH, LONGEST = 4096, 16, 4
SAMPLE, EPOCHS, BATCH, RATE = 4_000, 8, 32, 0.5
ALLOWED, CAUTIOUS = 0.001, 0.5
UNKNOWN = "und"
#: Characters that are counted at once. Runs over a cut are counted by the later part.
AT_ONCE = 1_000_000
_LETTER = regex.compile(r"\p{L}")
_SPACE = re.compile(r"\s+")


def subwords(text: str) -> np.ndarray:
    """How often each bucket occurs in the text."""
    counts = np.zeros(BUCKETS, np.int64)
    before = " "
    for at in range(0, len(text), AT_ONCE):
        part = before + _SPACE.sub(" ", text[at : at + AT_ONCE].lower()) + (" " if at + AT_ONCE >= len(text) else "")
        c = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.uint64)
        border = c == 32
        inner, mixed = np.zeros(len(c), bool), c * np.uint64(0x9E3779B97F4A7C15)
        for n in range(1, LONGEST + 1):
            if n > 1:
                mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
            inner = border[:] if n == 1 else (np.zeros(len(mixed), bool) if n == 2 else inner[:-1] | border[n - 2 : len(c) - 1])
            keep = mixed if n == 2 else mixed[~inner[: len(mixed)]]
            counts += np.bincount((keep * np.uint64(0x94D049BB133111EB) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
        before = part[-(LONGEST - 1) :]
    return counts


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    names: list[str]
    scores: np.ndarray  # of each bucket for each language: embedding times layer
    bias: np.ndarray
    heat: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, rejected)"""
        if not self.names or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        counts = subwords(text)
        p = softmax((counts @ self.scores / counts.sum() + self.bias) / self.heat)
        best = int(p.argmax())
        return self.names[best], float(p[best]), bool(p[best] < self.least)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, names: list[str]) -> Model:
    """rows: (buckets, counts) of each text; labels: places in names."""
    if not len(rows):
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    random = np.random.default_rng(7)
    order = random.permutation(len(rows))
    held, fitted = order[: len(rows) // 5], order[len(rows) // 5 :]

    def dense(some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), BUCKETS), np.float32)
        for i, k in enumerate(some):
            x[i, rows[k][0]] = rows[k][1] / rows[k][1].sum()
        return x

    embedding = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = EPOCHS * -(-len(fitted) // BATCH), 0
    for _ in range(EPOCHS):
        random.shuffle(fitted)
        for at in range(0, len(fitted), BATCH):
            some = fitted[at : at + BATCH]
            x, rate = dense(some), RATE * (1 - step / steps)
            hidden = x @ embedding
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            error /= len(some)
            # an average over thousands of buckets moves each little, so embeddings take a rate that is as much larger
            back = x.T @ (error @ layer.T)
            layer -= rate * 20 * (hidden.T @ error)
            bias -= rate * error.sum(axis=0)
            embedding -= rate * 200 * back
            step += 1
    scores = embedding @ layer
    some = held if len(held) else fitted
    raw = np.concatenate([dense(some[i : i + 256]) @ scores + bias for i in range(0, len(some), 256)]).astype(np.float64)
    truth = labels[some]
    loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(some)), truth] + 1e-12).mean()
    heat = float(min(np.geomspace(0.25, 8, 31), key=loss))
    p = softmax(raw / heat)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    least = min(CAUTIOUS, float(right[int(ALLOWED * len(right))])) if len(right) else CAUTIOUS
    return Model(names, scores.astype(np.float64), bias.astype(np.float64), heat, least)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The model of labelled rows. Only text and label are learned from; key and text choose the sample."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(key).alias("key")).filter("label is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row for each language
    if not sizes:
        return train([], np.zeros(0, np.int64), [])
    names = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, sample / len(names) / sizes[k]))))
    chosen = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)) < F.element_at(share, F.col("label")) * (1 << 40)).select("label", "text").distinct()
    # the shares bound the sample in the mean, the limit in any case
    chosen = chosen.orderBy(F.xxhash64("text"), "label", "text").limit(2 * sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [subwords(x) for x in batch["text"]]
            at = [np.nonzero(c)[0] for c in found]
            yield pd.DataFrame({"label": batch["label"], "buckets": [a.astype("<u2").tobytes() for a in at], "counts": [np.minimum(c[a], 1 << 30).astype("<u4").tobytes() for c, a in zip(found, at, strict=True)]})

    got = chosen.mapInPandas(features, "label string, buckets binary, counts binary").toPandas()
    got = got[got["buckets"].map(len) > 0].sort_values(["label", "buckets", "counts"])  # one order, whatever the tasks'
    pairs = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.float32)) for b, c in zip(got["buckets"], got["counts"], strict=True)]
    return train(pairs, got["label"].map(names.index).to_numpy(np.int64), names)


def predict(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the language, its calibrated score and whether it is rejected. Columns of those names are replaced."""
    kept = docs.drop(*out)
    schema = T.StructType([*kept.schema.fields, *map(T.StructField, out, (T.StringType(), T.DoubleType(), T.BooleanType()), (False,) * 3)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            found = [of.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *out])

    return kept.mapInArrow(run, schema)
