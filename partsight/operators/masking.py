"""Masking jobs over a text column. All narrow: one pass, no shuffle before a roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.functions import pii
from partsight.functions.spans import explode_rows, spans_sql, unicode_regex
from partsight.functions.text import to_original, with_views
from partsight.operators.joins import shuffled


def route_oversize(rows: DataFrame, limit: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(up to the limit, longer), for a caller whose sink bounds its texts. Masking itself has
    no limit."""
    long = F.length(text) > limit
    return rows.where(~F.coalesce(long, F.lit(False))), rows.where(long)


def detect(rows: DataFrame, text: str = "text") -> DataFrame:
    """A04 + A05 on the normalised views: adds ``pii`` in normalised offsets."""
    return pii.with_detections(with_views(rows, text))


def mask_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``masked``, ``spans`` and ``mask_status`` per row, for texts of any length."""
    found = pii.with_tokens(detect(rows, text))
    return found.withColumns(
        {
            "masked": pii.masked_text(text),
            "mask_status": F.when(F.col(text).isNull(), "no_text").otherwise("masked"),
        }
    ).select(*rows.columns, "masked", "spans", "mask_status")


def token_mappings(rows: DataFrame, text: str = "text") -> DataFrame:
    """The restricted token -> original output, apart from the masked one; empty maps for
    texts without detections."""
    found = pii.with_tokens(detect(rows, text))
    return found.withColumn("mapping", pii.token_mapping(text)).select(*rows.columns, "mapping")


def detection_stats(detected: DataFrame, keys: list[str]) -> DataFrame:
    """A10: detections and texts with detections, by type and the given columns."""
    types = F.transform("pii", lambda s: s["type"])
    per_text = F.transform(
        F.array_distinct(types),
        lambda t: F.struct(
            t.alias("type"), F.size(F.filter("pii", lambda s: s["type"] == t)).alias("n")
        ),
    )
    return explode_rows(detected, per_text, "p", *keys).groupBy(*keys, "p.type").agg(
        F.sum("p.n").alias("detections"), F.count(F.lit(1)).alias("texts")
    )


# -- A11 -----------------------------------------------------------------------------------------

_GROUP = r"[A-Za-z0-9]++(?![^\W_])"
_RUN = rf"(?<![^\W_]){_GROUP}(?:[ ./-]{_GROUP})*+"
_MAX_GROUPS = 6


def part_number_candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``candidates``: spans that may be part numbers with their keys, the first place of
    each key, by position. A candidate is up to six blank-separated groups of a run."""
    run = spans_sql("lat", unicode_regex(_RUN, ignore_case=False), probe="rlike(lat, '[0-9]')",
                    with_text=True)
    # Runs without five digits cannot hold a candidate.
    runs = (
        f"transform(filter({run}, r -> length(regexp_replace(r.text, '[^0-9]', '')) >= 5), "
        "r -> struct(r.start AS start, split(r.text, ' ') AS g))"
    )
    value = "array_join(slice(r.g, i + 1, w), ' ')"
    windows = (
        "flatten(transform(__runs, r -> flatten(transform(sequence(0, size(r.g) - 1), i -> "
        f"transform(sequence(1, least(size(r.g) - i, {_MAX_GROUPS})), w -> struct("
        f"upper(regexp_replace({value}, '[^A-Za-z0-9]', '')) AS key, "
        "r.start + IF(i = 0, 0, length(array_join(slice(r.g, 1, i), ' ')) + 1) AS start, "
        f"length({value}) AS n))))))"
    )
    found = (
        f"transform(filter({windows}, c -> length(c.key) BETWEEN 6 AND 20 AND "
        "length(regexp_replace(c.key, '[^0-9]', '')) >= 5), "
        "c -> struct(c.key, c.start, c.start + c.n AS `end`))"
    )

    def placed(c: Column) -> Column:
        start, end = to_original(c["start"], c["end"])
        return F.struct(start.alias("start"), end.alias("end"), c["key"].alias("key"))

    return (
        with_views(rows, text)
        .withColumn("__runs", F.expr(runs))
        .withColumn("__all", F.expr(f"array_sort({found})"))
        .withColumn(
            "__first",
            F.filter(
                "__all", lambda c, i: (i == 0) | (F.get("__all", i - 1)["key"] != c["key"])
            ),
        )
        .withColumn("candidates", F.array_sort(F.transform("__first", placed)))
        .select(*rows.columns, "candidates")
    )


def match_part_numbers(candidates: DataFrame, oems: DataFrame, id_column: str) -> DataFrame:
    """Candidates that are known part numbers: an equi-join on the key."""
    long = explode_rows(candidates, F.col("candidates"), "c", id_column).select(
        id_column, "c.key", "c.start", "c.end"
    )
    return long.join(shuffled(oems.select(F.col("oem_key").alias("key"), "sku").distinct()), "key")
