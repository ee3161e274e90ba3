"""Normalised views of a text and measures on it.

``with_views`` adds the columns the detectors work on. Rows that are already clean (the usual
case) never leave the JVM; the others go through one Arrow UDF, because Spark has no NFKC.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.functions.spans import (
    SPAN, quote, rlike_sql, span_sql, spans_sql, unicode_regex,
)
from partsight.session import spread

# Characters that are invisible without being format characters, controls that stay,
# the one character NFKC must not touch, and the look-alike folding maps.
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵⠀ㅤﾠ￼"
ALLOWED_CONTROLS = "\t\n\r"
KEEP_AS_IS = "№"
LAT_TO_CYR = (
    "aceopxykABCEHKMOPTXYαοεκρτυχΑΒΕΗΙΚΜΝΟΡΤΧΥ",
    "асеорхукАВСЕНКМОРТХУаоекртухАВЕНІКМНОРТХУ",
)
CYR_TO_LAT = (
    "аеорсухкіјѕԁӏАВЕКМНОРСТХУІЈЅαοεκρτυχνΑΒΕΗΙΚΜΝΟΡΤΧΥΖ",
    "aeopcyxkijsdlABEKMHOPCTXYIJSaoekptyxvABEHIKMNOPTXYZ",
)

# Characters that normalisation leaves alone and that no rule drops: printable ASCII, Latin letters
# without compatibility forms, Russian letters, common punctuation and currency signs.
_CLEAN = (
    "\t\n\r\x20-\x7e¡-§©«¬®°±¶·»"
    "¿-ıĴ-ľŁ-ňŊ-žЁА-яё–—"
    "‘-‚“-„•€₽№"
)
# Rows whose views and offsets a worker holds at once: a batch of Spark's has up to ten thousand texts.
_ROWS_AT_ONCE = 256
_CLEAN_RUN = re.compile(f"[{_CLEAN}]+")

_SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
_NT = (
    T.StructType()
    .add("text", T.StringType())
    .add("starts", T.ArrayType(T.IntegerType()))
    .add("ends", T.ArrayType(T.IntegerType()))
    .add("hidden", _SPANS)
    .add("invalid", _SPANS)
)


def _is_mark(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M"


def _is_invisible(ch: str) -> bool:
    return unicodedata.category(ch) in ("Cf", "Cn", "Co") or ch in INVISIBLE_EXTRA


def _plain(cluster: str) -> str:
    """NFKC of one base character with its marks, marks dropped, any decimal digit as ASCII."""
    if cluster[0] in KEEP_AS_IS:
        return cluster[0]
    kept = (c for c in unicodedata.normalize("NFKC", cluster)
            if not _is_mark(c) and unicodedata.category(c) != "Cf")
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in kept)


def _normalise(text: str) -> tuple:
    """(view, starts, ends, hidden, invalid); clean stretches are copied whole.

    The offsets are four bytes each: as Python numbers in lists they took eighteen times that for every character of a batch.
    """
    view, starts, ends, hidden, invalid = [], array("i"), array("i"), [], []
    i, n = 0, len(text)
    while i < n:
        run = _CLEAN_RUN.match(text, i)
        stop = run.end() if run else i
        if stop < n and stop > i and _is_mark(text[stop]):
            stop -= 1  # the mark belongs to the last character
        if stop > i:
            view.append(text[i:stop])
            starts.extend(range(i, stop))
            ends.extend(range(i + 1, stop + 1))
            i = stop
            continue
        ch = text[i]
        j = i + 1
        if unicodedata.category(ch) in ("Cc", "Cs") and ch not in ALLOWED_CONTROLS:
            invalid.append((i, j))
        elif _is_invisible(ch):
            hidden.append((i, j))
        else:
            while j < n and _is_mark(text[j]) and not _is_invisible(text[j]):
                j += 1
            out = _plain(text[i:j])
            view.append(out)
            starts.extend([i] * len(out))
            ends.extend([j] * len(out))
        i = j
    return "".join(view), np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32), hidden, invalid


def _normalised(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append((None,) * 5)
            continue
        view, starts, ends, hidden, invalid = _normalise(text)
        as_spans = [[{"start": a, "end": b} for a, b in part] for part in (hidden, invalid)]
        rows.append((view, starts, ends, *as_spans))
    return pd.DataFrame(rows, columns=["text", "starts", "ends", "hidden", "invalid"])


@F.pandas_udf(_NT)
def _normalise_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), _ROWS_AT_ONCE):
            yield _normalised(batch.iloc[start : start + _ROWS_AT_ONCE])


def is_clean(text: Column) -> Column:
    """Would normalisation leave the text as it is?"""
    return text.rlike(f"^[{_CLEAN}]*$")


def with_views(rows: DataFrame, text: str = "text") -> DataFrame:
    """A01 + A02: adds ``nt`` (normalised text), ``cyr``, ``lat`` (look-alikes folded), ``starts``
    and ``ends`` (offset map, NULL = identity), ``hidden`` and ``invalid`` spans.

    Only rows that fail the clean test are sent to Python (the others send NULL). The rows are dealt over
    all cores first, as the detectors take far longer than reading.
    """
    dirty = F.when(~is_clean(F.col(text)), F.col(text))
    return (
        spread(rows).withColumn("__n", _normalise_udf(dirty))
        .withColumns(
            {
                "nt": F.coalesce("__n.text", text),
                "starts": F.col("__n.starts"),
                "ends": F.col("__n.ends"),
                "hidden": F.coalesce("__n.hidden", F.array().cast(SPAN)),
                "invalid": F.coalesce("__n.invalid", F.array().cast(SPAN)),
            }
        )
        .drop("__n")
        .withColumns({"cyr": fold_cyr(F.col("nt")), "lat": fold_lat(F.col("nt"))})
    )


def fold_cyr(view: Column) -> Column:
    """Latin and Greek look-alikes as Cyrillic."""
    return F.translate(view, *LAT_TO_CYR)


def fold_lat(view: Column) -> Column:
    """Cyrillic and Greek look-alikes as Latin."""
    return F.translate(view, *CYR_TO_LAT)


def to_original(start: Column, end: Column) -> tuple[Column, Column]:
    """A non-empty span of the views in the original text."""
    return (
        F.coalesce(F.element_at("starts", start + 1), start).cast("int"),
        F.coalesce(F.element_at("ends", end), end).cast("int"),
    )


def from_original(start: Column, end: Column) -> tuple[Column, Column]:
    """The span of the views whose characters lie inside an original span; empty if none."""
    first = F.when(F.col("starts").isNull(), start).otherwise(
        F.size(F.filter("starts", lambda s: s < start))
    )
    last = F.when(F.col("ends").isNull(), end).otherwise(
        F.size(F.filter("ends", lambda e: e <= end))
    )
    return first.cast("int"), F.greatest(first, last).cast("int")


# -- obfuscation (A12-A15) ---------------------------------------------------------------------------

_FOREIGN = (
    r"[\p{L}&&[^A-Za-zªµºÀ-ÖØ-öø-ÿĞğİ"
    r"ıŞşА-яЁё]]+|[ªµº]+"
)
LETTER_RUN = r"[^\W\d_]+"
# The signs of a foreign run, or of two scripts in one, are outside what most texts are made of: two short classes
# settle that with few steps a character, which the full class does not.
_MAY_BE_FOREIGN = r"[^\x00-\x7f[À-ÖØ-öø-ÿĞğİıŞşА-яЁё[ -©«-´¶-¹»-¿‐-‧…€№₽]]]"
_BRAND_WITH_ENDING = (
    "^[A-Za-z]{3,}(?:а|у|е|ом|ой|ы|ов|ам|ами|ах|ский|ская|ское|ские|шный|шная|шное|шные)$"
)
_LONE = r"[^\W\d_](?![^\W\d_])"
_SPACED = rf"(?<![^\W\d_])(?:{_LONE}(?:\s{{1,3}}+|[-._*·/|+~])(?={_LONE})){{3,}}+{_LONE}"
_CYRILLIC = r"[Ѐ-ԯᲀ-᲏Ꙁ-ꚟ]"
_LATIN = r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]"
_GREEK = r"[Ͱ-Ͽἀ-῿]"
#: One of them is Cyrillic or Greek wherever two scripts touch.
_SCRIPTS = f"[{_CYRILLIC[1:-1]}{_GREEK[1:-1]}]"
COMPACT_SEPARATORS = r"[\s\-|+~_*·.]"


def foreign_spans(view: str) -> Column:
    """Runs of letters outside ASCII, Latin-1, Turkish and Russian."""
    return F.expr(spans_sql(view, unicode_regex(_FOREIGN, ignore_case=False), probe=rlike_sql(view, _MAY_BE_FOREIGN)))


def mixed_script_spans(view: str) -> Column:
    """Letter runs of more than one script, except a Latin brand with a Russian ending."""
    word = span_sql(view)
    scripts = " + ".join(
        f"CAST({rlike_sql(word, p)} AS INT)" for p in (_CYRILLIC, _LATIN, _GREEK)
    )
    # A run can only be mixed where two scripts touch: most texts never do.
    touch = (
        f"{_CYRILLIC}(?:{_LATIN}|{_GREEK})|{_LATIN}(?:{_CYRILLIC}|{_GREEK})"
        f"|{_GREEK}(?:{_CYRILLIC}|{_LATIN})"
    )
    runs = spans_sql(view, unicode_regex(LETTER_RUN, ignore_case=False),
                     probe=f"({rlike_sql(view, _SCRIPTS)} AND {rlike_sql(view, touch)})")
    return F.expr(
        f"filter({runs}, s -> ({scripts}) > 1 AND NOT {rlike_sql(word, _BRAND_WITH_ENDING)})"
    )


def spaced_letter_spans(view: str) -> Column:
    """Words spelled letter by letter: four letters if one is Cyrillic, else six."""
    word = span_sql(view)
    letters = f"length(regexp_replace({word}, {quote(chr(92) + 'P{L}')}, ''))"
    found = spans_sql(view, unicode_regex(_SPACED, ignore_case=False))
    return F.expr(
        f"filter({found}, s -> {letters} >= IF({rlike_sql(word, _CYRILLIC)}, 4, 6))"
    )


def compact(view: Column) -> Column:
    """The view without whitespace and separators."""
    return F.regexp_replace(view, unicode_regex(COMPACT_SEPARATORS, ignore_case=False), "")


# -- sizes and segments (B01, B02, B14) ---------------------------------------------------------------


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def part_fits(text: Column, max_utf16: int = 1000, max_utf8: int = 1000) -> Column:
    """B01."""
    return (utf16_units(text) <= max_utf16) & (F.octet_length(text) <= max_utf8)


def first_index_beyond(text: Column, max_utf16: int = 1000, max_utf8: int = 1000) -> Column:
    """The first character that no longer fits.

    Both sizes grow with every character, by at least a byte, so the answer lies in the first ``max_utf8`` and is
    found by halving. A character has no more UTF-16 units than bytes: units are only counted if they may decide.
    """
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(max_utf8.bit_length()))))
    chars = F.length(text)

    def step(n: Column, half: Column) -> Column:
        head = F.substring(text, F.lit(1), n + half)
        fits = (n + half <= chars) & (F.octet_length(head) <= max_utf8)
        if max_utf16 < max_utf8:
            fits &= utf16_units(head) <= max_utf16
        return F.when(fits, n + half).otherwise(n)

    return F.when(text.isNotNull(), F.aggregate(halves, F.lit(0), step).cast("bigint"))


SENTENCE_END = r"[.!?\n]"
CLAUSE_END = r"[.!?\n;,—–]"


def segments(view: str, ends: str) -> Column:
    """The segments of a text, each with its terminating character."""
    body = f"{ends.replace('[', '[^', 1)}*{ends}|{ends.replace('[', '[^', 1)}+"
    return F.expr(spans_sql(view, body, probe=f"length({view}) > 0"))
