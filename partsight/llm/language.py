"""Hierarchical language identification: the family first, then one-versus-one linear SVMs in it.

Features are hashed byte bigrams and trigrams of the lower-cased text, square-rooted and scaled to
length 1. Closely related languages meet only each other, in pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.llm.common import stepped

BUCKETS = 2048
#: Bound of training: documents over all languages. Beyond so many languages each still has one document.
TRAINING_DOCS = 4000
#: Parts that the keys of a language are dealt to.
PARTS = 256
#: Language codes by family. Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af fy lb yi da no nb nn sv is fo",
    "romance": "fr es it pt ca gl oc ro",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "iranian": "fa ps ku tg",
    "indic": "hi bn mr ne pa gu ur sa",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
#: Every ASCII character that is no letter becomes a space.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"own:{lang}")


def features(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """One row of hashed n-gram counts for each text (zeros for a null or empty one)."""
    out = np.zeros((len(texts), buckets), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b"  ", np.uint8).astype(np.uint32)
        pair = raw[:-2] * np.uint32(251) + raw[1:-1]
        triple = pair * np.uint32(65599) + raw[2:] * np.uint32(40503)
        for grams in (pair, triple):
            place = (grams * np.uint32(2654435761)) >> np.uint32(32 - 11)
            out[i] += np.bincount(place, minlength=buckets)[:buckets]
    np.sqrt(out, out=out)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 200) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear SVM; y is 1 or -1. Accelerated full-batch steps."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    each = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    w = np.zeros(x.shape[1], np.float32)
    v = w.copy()
    rate = 1 / (1 + 4 * cost * each.max())  # rows have length sqrt(2) at most
    for n in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v - 2 * cost * (x.T @ (each * slack * y).astype(np.float32)) / len(y)
        new = v - rate * grad
        v = new + n / (n + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """families: names in order; weights: one column for each; pairs: (family, a, b, weights)."""

    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    training_docs: int = TRAINING_DOCS,
) -> Model:
    """A model from text and language of ``docs`` (null language, key or text: not learned from).

    Every language is learned. A sample of ``training_docs`` rows, or one a language if there are more of
    them, spread over the languages by the hash of the key; whole texts. The smallest hashes are found in
    ``PARTS`` parts of a language first, so that a language with most rows is not ranked in one task.
    Without any language the model predicts ``und``.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(key, lang)
    languages = known.select(lang).distinct().count()
    if not languages:
        return Model([], {}, np.zeros((BUCKETS + 1, 0), np.float32), {})
    quota = max(1, training_docs // languages)
    chosen = known.withColumns({"drawn": F.xxhash64(key, F.lit("language")), "part": F.pmod(F.xxhash64(key), F.lit(PARTS))})
    for group in ([lang, "part"], [lang]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("drawn", key))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= quota).drop("place")
    chosen = chosen.select(key, lang)

    schema = T.StructType([T.StructField(lang, T.StringType()), T.StructField("x", T.BinaryType())])

    def step(batches):
        for batch in stepped(batches, text):
            found = features(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(lang), pa.array([r.astype(np.float16).tobytes() for r in found], pa.binary())], [lang, "x"]
            )

    # chosen has training_docs rows, or one a language
    rows = docs.select(key, text).join(F.broadcast(chosen.distinct()), key).select(lang, text).mapInArrow(step, schema).collect()
    rows.sort(key=lambda r: (r[lang], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), BUCKETS)
    langs = np.array([r[lang] for r in rows])
    members: dict[str, list[str]] = {}
    for code in sorted(set(langs.tolist())):
        members.setdefault(family_of(code), []).append(code)
    families = sorted(members)
    of = np.array([family_of(code) for code in langs.tolist()])
    family_weights = np.column_stack([linear_svm(x, np.where(of == f, 1.0, -1.0)) for f in families])
    pairs = {}
    for family, codes in members.items():
        pairs[family] = []
        for a in range(len(codes)):
            for b in range(a + 1, len(codes)):
                here = (langs == codes[a]) | (langs == codes[b])
                pairs[family].append((a, b, linear_svm(x[here], np.where(langs[here] == codes[a], 1.0, -1.0))))
    return Model(families, members, family_weights, pairs)


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 for a null text or one without letters."""
    langs, score = ["und"] * len(texts), np.zeros(len(texts))
    lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
    if not model.families or not lettered.any():
        return langs, score
    x = features(texts)
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    margins = x @ model.family_weights
    best = margins.argmax(axis=1)
    share = np.exp(np.clip(2 * margins, -30, 30))
    share = share[np.arange(len(x)), best] / share.sum(axis=1)
    for f, family in enumerate(model.families):
        here = np.flatnonzero(lettered & (best == f))
        codes = model.members[family]
        votes, trust = np.zeros((len(here), len(codes))), np.ones((len(here), len(codes)))
        for a, b, w in model.pairs[family]:
            p = 1 / (1 + np.exp(-np.clip(4 * (x[here] @ w), -30, 30)))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            trust[:, a] = np.minimum(trust[:, a], p)
            trust[:, b] = np.minimum(trust[:, b], 1 - p)
        win = (votes + trust / 2).argmax(axis=1)
        for i, k in zip(here.tolist(), win.tolist()):
            langs[i] = codes[k]
        score[here] = share[here] * trust[np.arange(len(here)), win]
    return langs, score


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score (0 to 1); same-named columns are replaced.

    Rows are independent: no shuffle; repeated rows stay, no rows give no rows.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def step(batches):
        for batch in stepped(batches, text):
            langs, score = classify(model, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(score)],
                [*(f.name for f in kept), "lang_pred", "score"],
            )

    return docs.mapInArrow(step, T.StructType([*kept, *added]))
