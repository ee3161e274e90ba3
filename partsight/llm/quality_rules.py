"""Quality rules with thresholds that each language and source sets for itself.

1. *Measures.* One pass over the texts counts words, symbols, repeated lines and words in repeated
   windows. Two base rules are fixed; a document that fails one is out.
2. *Sketches.* Of the documents that pass, each (language, source) keeps a quantile sketch of every
   measure: counts in buckets that grow with the value, ``SUB`` to each doubling, so that any quantile
   is known to one part in ``SUB``. Sketches merge by adding counts, in any order, and their size does
   not depend on the documents: a source with a third of all rows is as many rows as any other.
3. *Thresholds.* A measure's fence lies ``REACH`` times the distance of its quartiles beyond them. A
   source with fewer than ``LEAST_DOCS`` documents takes the fences of the merged sketch of its
   language, a language with fewer those of all.
4. *Filter.* The fences are joined to the documents, and one beyond a fence goes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.llm.common import lean, stepped, stored

LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW_WORDS = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
SUB, REACH, LEAST_DOCS = 32, 3, 200
#: (measure, its least distance of quartiles, whether too little of it is bad too). All are whole numbers.
MEASURES = (
    ("word_length", 40, True),  # hundredths of a character a word
    ("symbol_rate", 10, False),  # symbols in a thousand words
    ("line_repeats", 50, False),  # repeated lines of a thousand
    ("word_repeats", 30, False),  # words in repeated windows of a thousand
)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACE = b" \t\n\x0b\x0c\r"
_SPACES, _LINE = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\n]+")
#: Bytes of a text that are split into words at a time.
_PART_BYTES = 1 << 20


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _words(raw: bytes, numbers: _Numbers) -> np.ndarray:
    """The numbers of a text's words, in order."""
    parts, start = [], 0
    while start < len(raw):
        cut = _SPACES.search(raw, start + _PART_BYTES) if len(raw) - start > _PART_BYTES else None
        end = cut.start() if cut else len(raw)
        words = raw[start:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(words: np.ndarray, lengths: np.ndarray, width: int = WINDOW_WORDS) -> np.ndarray:
    """Of texts laid end to end as numbered words: each text's words in windows that it holds twice or more."""
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    names, n = words, 1
    while n < width and len(names):  # windows of n words are numbered; two of them name one of up to 2n
        step = min(n, width - n)
        names = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)[1] if len(names) > step else names[:0]
        n += step
    covered = np.zeros(len(words) + 1, np.int64)
    if len(names):
        at = np.arange(len(names))
        inside = at + width <= ends[text[at]]
        at = at[inside]
        key = text[at] * (int(names.max()) + 1) + names[at]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        at = at[times[which] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + width, -1)
    return np.bincount(text[np.cumsum(covered[:-1]) > 0], minlength=len(lengths))


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    if b"\n" not in raw:
        return int(bool(raw.strip())), 0
    n, seen = 0, set()
    for line in _LINE.finditer(raw):
        if line[0].strip():
            n += 1
            seen.add(line[0])
    return n, n - len(seen)


def measures(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns in ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each row.

    Words are what stands between blanks, tabs and line ends of ASCII. Null and empty texts have zeros.
    """
    raw = docs.select(*keep, F.col(text).cast("binary").alias("_raw"), F.char_length(text).cast("long").alias("_chars"))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def step(batches):
        for batch in stepped(batches, "_raw", 1 << 20):
            raws = [r or b"" for r in batch.column("_raw").to_pylist()]
            numbers = _Numbers()
            words = [_words(r, numbers) for r in raws]
            lengths = np.array([len(w) for w in words], np.int64)
            lines = [_lines(r) for r in raws]
            counts = [
                lengths,
                np.array([len(r.translate(None, _SPACE)) for r in raws], np.int64),
                np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raws], np.int64),
                np.array([d for _, d in lines], np.int64),
                repeated_words(np.concatenate(words), lengths).astype(np.int64),
                np.array([n for n, _ in lines], np.int64),
            ]
            # Bytes in words, less the bytes that characters of more than one byte have besides.
            chars = batch.column("_chars").fill_null(0).to_numpy(zero_copy_only=False)
            counts[1] -= np.array([len(r) for r in raws], np.int64) - chars
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, counts)], schema.names)

    return raw.mapInArrow(lean(step), schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The measures of a document that passes the base rules (it has words, so lines too)."""
    rate = "{} * {} div nullif({}, 0)"
    of = {
        "word_length": rate.format(100, "word_chars", "n_words"),
        "symbol_rate": rate.format(1000, "n_symbols", "n_words"),
        "line_repeats": rate.format(1000, "n_dup_lines", "n_lines"),
        "word_repeats": rate.format(1000, "n_repeat_words", "n_words"),
    }
    return {name: F.expr(text) for name, text in of.items()}


def bucket(value: str) -> Column:
    """The bucket of a whole number: itself below 2 * SUB, then SUB buckets to each doubling."""
    shift = f"greatest(length(bin({value})) - {(2 * SUB - 1).bit_length()}, 0)"
    return F.expr(f"shiftright({value}, {shift}) + {SUB} * {shift}")


def least_of(number: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(number / SUB) - 1, F.lit(0)).cast("int")
    return F.when(number < 2 * SUB, number).otherwise(((number - SUB * shift) * F.pow(F.lit(2.0), shift)).cast("long"))


def sketches(measured: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Of each group and measure: bucket and n, the documents in it."""
    rows = measured.where(~base_failed()).select(*groups, *(c.alias(n) for n, c in rates().items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n, _, _ in MEASURES)))
    return (
        rows.select(*groups, each.alias("m"))
        .select(*groups, "m.measure", bucket("m.value").cast("int").alias("bucket"))
        .groupBy(*groups, "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Of each group and measure of a sketch: q1, q3, docs. A quartile is the least value of its bucket.

    The buckets before each one are counted by a window: as many rows as a sketch has buckets.
    """
    keys = ", ".join([*groups, "measure"])
    rows = sketch.withColumns(
        {
            "before": F.expr(f"sum(n) OVER (PARTITION BY {keys} ORDER BY bucket)"),
            "docs": F.expr(f"sum(n) OVER (PARTITION BY {keys})"),
        }
    )
    quartile = {q: F.min(F.when(4 * F.col("before") >= k * F.col("docs"), F.col("bucket"))) for q, k in (("q1", 1), ("q3", 3))}
    found = rows.groupBy(*groups, "measure").agg(F.max("docs").alias("docs"), *(c.alias(q) for q, c in quartile.items()))
    return found.withColumns({q: least_of(F.col(q)) for q in quartile})


def _fences(found: DataFrame, groups: tuple[str, ...], name: str) -> DataFrame:
    """One row a group: docs, and of each measure the least and most that pass, as struct ``name``."""
    columns = []
    for measure, least_distance, low in MEASURES:
        distance = F.greatest(F.col("q3") - F.col("q1"), F.lit(least_distance))
        here = F.col("measure") == measure
        columns.append(F.max(F.when(here, F.col("q3") + REACH * distance)).alias(f"{measure}_most"))
        least = F.col("q1") - REACH * distance if low else F.lit(-1)
        columns.append(F.max(F.when(here, least)).cast("long").alias(f"{measure}_least"))
    fences = found.groupBy(*groups).agg(F.max("docs").alias("docs"), *columns)
    return fences.select(*groups, F.struct(*fences.columns[len(groups) :]).alias(name))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Of each (``lang``, ``source``) with documents that pass the base rules: fences, a struct of the least and most of each measure.

    Null and empty languages, and sources, are one.
    """
    sketch = stored(sketches(measured, (lang, source)), "quality-sketches")
    merged = sketch.groupBy(lang, "measure", "bucket").agg(F.sum("n").alias("n"))
    every = merged.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    per_source = _fences(quartiles(sketch, (lang, source)), (lang, source), "own")
    per_language = _fences(quartiles(merged, (lang,)), (lang,), "of_language")
    of_all = _fences(quartiles(every, ()), (), "of_all")
    chosen = F.when(F.col("own.docs") >= LEAST_DOCS, F.col("own")).when(F.col("of_language.docs") >= LEAST_DOCS, F.col("of_language"))
    # The fences of all are one row: a scalar subquery.
    return per_source.join(per_language, lang).select(lang, source, chosen.otherwise(of_all.scalar()).alias("fences"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Of each row: ``key``, the counts, base_failed, kept, and failed: the measures beyond their fence.

    Languages and sources set the thresholds only. Null and empty texts fail the base rules; repeated
    rows are judged alike and count each; an empty table gives no rows. Other columns are not read.
    """
    given = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))
    )
    measured = stored(measures(given, ("_key", "lang", "source"), "_text"), "quality-measures")
    fences = thresholds(measured)
    rows = measured.withColumns({"base_failed": base_failed()}).join(fences, ["lang", "source"], "left")
    beyond = [
        F.when((value > F.col(f"fences.{name}_most")) | (value < F.col(f"fences.{name}_least")), F.lit(name))
        for name, value in rates().items()
    ]
    failed = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond)))
    return rows.withColumn("failed", failed).select(
        F.col("_key").alias(key), *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed"
    )


def quartiles_sql(source: str, groups: str) -> str:
    """``quartiles`` of a sketch in SQL, for oracles."""
    keys = f"{groups}, measure" if groups else "measure"
    value = f"CASE WHEN {{0}} < {2 * SUB} THEN {{0}} ELSE ({{0}} - {SUB} * ({{0}} // {SUB} - 1)) << ({{0}} // {SUB} - 1) END"
    return f"""
  SELECT {keys}, docs, {value.format("b1")} AS q1, {value.format("b3")} AS q3 FROM (
    SELECT {keys}, max(docs) AS docs, min(bucket) FILTER (4 * before >= docs) AS b1, min(bucket) FILTER (4 * before >= 3 * docs) AS b3
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS before, sum(n) OVER (PARTITION BY {keys}) AS docs FROM {source})
    GROUP BY {keys})"""
