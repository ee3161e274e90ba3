"""Exact match offsets without leaving the JVM.

Spark has no function that returns match positions. Every match is wrapped in two control
characters (which normalised text never contains), the text is split on them, and the lengths of
the pieces give the offsets: the odd pieces are the matches.

Java regex needs ``(?U)`` for Unicode ``\\w``/``\\b`` and, with it, ``(?i)`` folds all scripts.

The expressions are built as SQL text over column names: detectors combine dozens of them, and one
``expr`` per detector keeps plan building fast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
SPAN = "array<struct<start:int,end:int>>"
NO_SPANS = f"CAST(array() AS {SPAN})"
NO_TEXT_SPANS = "CAST(array() AS array<struct<start:int,end:int,text:string>>)"


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unicode_regex(pattern: str, *, ignore_case: bool = True) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def rlike_sql(view: str, pattern: str) -> str:
    return f"rlike({view}, {quote(pattern)})"


def _pieces(view: str, pattern: str, wrap: str, before: str) -> str:
    marked = f"regexp_replace({view}, {quote(pattern)}, {quote(before + OPEN + wrap + CLOSE)})"
    return f"split({marked}, {quote(f'[{OPEN}{CLOSE}]')}, -1)"


def spans_sql(
    view: str, pattern: str, wrap: str = "$0", before: str = "", probe: str | None = None,
    with_text: bool = False,
) -> str:
    """Non-empty matches as ``array<struct<start,end>>`` (0-based, end exclusive).

    With groups, ``before`` names the part of the match outside the span (``"$1"``) and ``wrap``
    the part inside (``"$2"``). ``probe`` is a cheap necessary condition of any match; most texts
    fail it, and then the full pattern never runs. ``with_text`` adds the matched text to the spans.
    """
    parts = _pieces(view, pattern, wrap, before)
    # The offsets are gathered in a string: growing an array copies every element at every step.
    offsets = (
        f"aggregate({parts}, struct(0 AS pos, false AS inside, '' AS out), "
        "(acc, p) -> struct(acc.pos + length(p) AS pos, NOT acc.inside AS inside, "
        "IF(acc.inside AND length(p) > 0, concat(acc.out, acc.pos, ',', acc.pos + length(p), ';'), "
        "acc.out) AS out), acc -> acc.out)"
    )
    found = (
        f"transform(filter(split({offsets}, ';'), x -> x <> ''), x -> struct("
        "CAST(split_part(x, ',', 1) AS INT) AS start, CAST(split_part(x, ',', 2) AS INT) AS `end`))"
    )
    none = NO_SPANS
    if with_text:
        texts = f"filter(filter({parts}, (p, i) -> i % 2 = 1), p -> p <> '')"
        found = f"zip_with({found}, {texts}, (s, t) -> struct(s.start, s.`end`, t AS text))"
        none = NO_TEXT_SPANS
    return f"IF({probe or rlike_sql(view, pattern)}, {found}, {none})"


def spans(view: str, pattern: str, **kw: str) -> Column:
    return F.expr(spans_sql(view, pattern, **kw))


def span_sql(view: str, span: str = "s") -> str:
    """The text of a span."""
    return f"substring({view}, {span}.start + 1, {span}.`end` - {span}.start)"


def head_sql(view: str, found: str, pattern: str) -> str:
    """The spans cut to what the anchored pattern finds at their start; spans without it are gone."""
    kept = f"length(regexp_extract({span_sql(view)}, {quote(pattern)}, 0))"
    cut = f"transform({found}, s -> struct(s.start AS start, s.start + {kept} AS `end`))"
    return f"filter({cut}, s -> s.`end` > s.start)"


def trimmed_sql(view: str, found: str, punctuation: str) -> str:
    """The spans without trailing punctuation; spans that were nothing else are gone."""
    kept = f"length(trim(TRAILING {quote(punctuation)} FROM {span_sql(view)}))"
    cut = f"transform({found}, s -> struct(s.start AS start, s.start + {kept} AS `end`))"
    return f"filter({cut}, s -> s.`end` > s.start)"


def inside_sql(span: str, regions: str) -> str:
    """Is the span wholly inside one of the regions?"""
    return f"exists({regions}, r -> r.start <= {span}.start AND {span}.`end` <= r.`end`)"


def explode_rows(rows: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element. ``explode`` would make the optimiser repeat the whole array
    expression in a ``size(...) > 0`` filter; the outer form with a NULL test computes it once."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
