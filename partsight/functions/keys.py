"""Comparison keys for codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(value: Column) -> Column:
    """Case-folded, without anything that is not a letter or digit."""
    return F.regexp_replace(F.lower(value), r"(?U)[\W_]+", "")


def title_key(value: Column) -> Column:
    """Letters and digits only, case-folded."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def oem_key(value: Column) -> Column:
    """Part number without spaces, dashes, dots and slashes, upper case."""
    return F.upper(F.regexp_replace(value, r"(?U)[\s\-./]+", ""))


def sku_key(value: Column) -> Column:
    return F.upper(F.trim(value))
