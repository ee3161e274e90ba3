"""Compression classifier of text quality.

Two zstandard dictionaries, one built from good and one from bad labelled text, compress every
block of a text. Where the good dictionary saves more, the text resembles good text: the difference
of the compressed sizes, divided by their sum, is the signal. A logistic curve over it and over the
ratio of compression itself, fitted on labelled documents that built no dictionary, turns it into a
probability. The shorter a text, the nearer its score to the share of good labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.llm.common import lean, stepped

#: Bounds of training: documents of a class for its dictionary and for the curve.
DICTIONARY_DOCS, CURVE_DOCS = 3000, 3000
BLOCK_CHARS = 2000
DICTIONARY_BYTES = 64 << 10
SHORT_BYTES, PROSE_RATIO = 200, 0.35
LEVEL = 3


@dataclass
class Model:
    """Two dictionaries, the log odds of a good label, and the curve's weights for a text's features."""

    good: bytes
    bad: bytes
    prior: float
    weights: np.ndarray


class Meter:
    """Signals of texts under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = [self._side(raw) for raw in (good, bad)]
        self.frame = [len(side.compress(b"")) for side in self.sides]

    @staticmethod
    def _side(raw: bytes) -> zstandard.ZstdCompressor:
        if not raw:
            return zstandard.ZstdCompressor(level=LEVEL)
        held = zstandard.ZstdCompressionDict(raw)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held)

    def __call__(self, text: str | None) -> tuple[float, ...]:
        """Features of a whole text; of a null or empty one, zeros."""
        if not text:
            return (0.0, 0.0, 0.0, 0.0)
        size = good = bad = 0
        for start in range(0, len(text), BLOCK_CHARS):
            block = text[start : start + BLOCK_CHARS].encode()
            size += len(block)
            good += len(self.sides[0].compress(block)) - self.frame[0]
            bad += len(self.sides[1].compress(block)) - self.frame[1]
        trust = size / (size + SHORT_BYTES)
        signal = trust * (bad - good) / max(1, bad + good)
        ratio = trust * (min(good, bad) / size - PROSE_RATIO)
        return (trust, signal, ratio, ratio * abs(ratio))


def _fit(x: np.ndarray, y: np.ndarray, each: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Logistic weights by damped Newton steps; ``each``: what a row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = scores(x, prior, w)
        grad = x.T @ (each * (p - y)) + ridge * w
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def scores(features: np.ndarray, prior: float, weights: np.ndarray) -> np.ndarray:
    logit = prior * (1 - features[:, 0]) + features @ weights
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _measured(
    docs: DataFrame, good: bytes, bad: bytes, text: str, curve: tuple[float, np.ndarray] | None, keep_text: bool = False
) -> DataFrame:
    gone = ("features", "score") if keep_text else (text, "features", "score")
    kept = [f for f in docs.schema.fields if f.name not in gone]
    added = T.StructField("score", T.DoubleType()) if curve else T.StructField("features", T.ArrayType(T.DoubleType()))

    def step(batches):
        meter = Meter(good, bad)
        for batch in stepped(batches, text):
            found = np.array([meter(t) for t in batch.column(text).to_pylist()])
            if curve:
                column = pa.array(scores(found, *curve))
            else:
                column = pa.array(found.tolist(), pa.list_(pa.float64()))
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, column], [*(f.name for f in kept), added.name])

    return docs.mapInArrow(lean(step), T.StructType([*kept, added]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    dictionary_docs: int = DICTIONARY_DOCS,
    curve_docs: int = CURVE_DOCS,
) -> Model:
    """A model from the labelled documents (label 1 good, 0 bad; other labels and null keys: none).

    Of each class a bounded sample is taken by the hash of the key: ``dictionary_docs`` for its
    dictionary, one block of each, and ``curve_docs`` others for the curve. With a class missing
    the score is about the share of good labels (0.5 without any).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y")).distinct()
    ordered = F.xxhash64(key, F.lit("quality")), F.col(key)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    per_class = dictionary_docs + curve_docs
    picked = [
        [r[key] for r in known.where(F.col("y") == y).orderBy(*ordered).limit(per_class).select(key).collect()] for y in (0, 1)
    ]
    # A class of few documents gives half of them to each use.
    uses = [
        (k, y, int(i < min(dictionary_docs, (len(keys) + 1) // 2))) for y, keys in enumerate(picked) for i, k in enumerate(keys)
    ]
    spark = docs.sparkSession
    schema = T.StructType([docs.schema[key], T.StructField("y", T.IntegerType()), T.StructField("builds", T.IntegerType())])
    chosen = spark.createDataFrame(uses, schema)  # 2 * per_class rows at most
    rows = docs.select(key, text).join(F.broadcast(chosen), key)
    blocks = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(BLOCK_CHARS)))
    place = F.pmod(F.xxhash64(key, F.lit("block")), blocks) * BLOCK_CHARS + 1
    texts = (
        rows.where((F.col("builds") == 1) & (F.length(text) > 0))
        .select("y", F.substring(text, place.cast("int"), F.lit(BLOCK_CHARS)).alias("block"))
        .collect()
    )
    raw = [sorted(r["block"].encode() for r in texts if r["y"] == y) for y in (0, 1)]
    bad, good = (_dictionary(samples) for samples in raw)
    curve = _measured(rows.where("builds = 0").select("y", text), good, bad, text, None).collect()
    y = np.array([r["y"] for r in curve], float)
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    if len(set(y.tolist())) < 2:
        return Model(good, bad, prior, np.array([prior, 0, 0, 0]))
    # The sample holds as many of either class; each row counts as the class does among all labels.
    each = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) * len(y) / sum(counts.values())
    return Model(good, bad, prior, _fit(np.array([r["features"] for r in curve]), y, each, prior))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples for training, their bytes as they are."""
    if sum(map(len, samples)) < 10 * DICTIONARY_BYTES or len(samples) < 100:
        return b"".join(samples)[-DICTIONARY_BYTES:]
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8, f=18, steps=1, level=LEVEL).as_bytes()


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1), and without the text unless ``keep_text``.

    Null and empty texts get the share of good labels. An input column called ``score`` or ``features`` is replaced. Rows are independent: no shuffle.
    """
    return _measured(docs, model.good, model.bad, text, (model.prior, model.weights), keep_text)
