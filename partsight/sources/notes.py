"""Note trees as tables: scan, decode, frontmatter, inline fields, tables, CSV.

A note is one row; its parts come out of bounded regular expressions on the whole text, so a note
never needs a window or a group of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.functions.spans import explode_rows
from partsight.functions import markdown as M
from partsight.functions.values import safe_label, strip, unquote
from partsight.session import spread


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: relative folder, name, extension, size, content. Hidden files
    and folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "")
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return files.select(
        rel.alias("rel"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folder"),
        name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), "content",
    ).where(~F.exists(F.split("rel", "/"), lambda p: p.startswith(".")))


# Spark decodes no cp1251: read as Latin-1, then move the upper half.
_HIGH_LATIN1 = bytes(range(128, 256)).decode("latin-1")
_HIGH_CP1251 = bytes(range(128, 256)).decode("cp1251", errors="replace")


@F.pandas_udf(T.StringType())
def _decode_utf16(data: pd.Series) -> pd.Series:
    """Broken UTF-16 must not fail the job, so it is decoded with replacement characters. Only
    UTF-16 files are sent here; the others are NULL."""
    return data.map(lambda b: None if b is None else bytes(b).decode("utf-16", errors="replace"))


def decode(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """UTF-16 by its mark, UTF-8 with or without one, else cp1251. Whole files, unless the
    caller gives ``max_bytes``: then ``cut`` says that a file is longer. A UTF-8 character cut at the end does not make the file cp1251."""
    data = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    cut = F.lit(False) if max_bytes is None else F.length("content") > max_bytes
    head = F.hex(F.substring(data, 1, 3))
    utf16 = head.startswith("FFFE") | head.startswith("FEFF")
    bom = head == "EFBBBF"
    body = F.when(bom, F.expr("substring(data, 4)")).otherwise(F.col("data"))
    # A cut may split a character: try the text without its last one to three bytes too.
    tries = [F.expr(f"substring(body, 1, length(body) - {k})") for k in (1, 2, 3)]
    good = F.call_function("is_valid_utf8", F.col("body").cast("string"))
    trimmed = F.lit(None).cast("binary")
    for t in reversed(tries):
        trimmed = F.when(F.call_function("is_valid_utf8", t.cast("string")), t).otherwise(trimmed)
    staged = (
        files.withColumns({"data": data, "cut": cut, "utf16": utf16, "bom": bom})
        .withColumn("body", body)
        .withColumn(
            "utf8",
            F.when(good, F.col("body")).when(F.col("cut"), trimmed),
        )
    )
    name = F.when(F.col("bom"), "utf-8-bom").otherwise("utf-8")
    return staged.select(
        *[c for c in files.columns if c != "content"], "cut",
        F.when(F.col("utf16"), "utf-16")
        .when(F.col("utf8").isNotNull(), name).otherwise("cp1251").alias("encoding"),
        F.when(F.col("utf16"), _decode_utf16(F.when(F.col("utf16"), F.col("data"))))
        .when(F.col("utf8").isNotNull(), F.col("utf8").cast("string"))
        .otherwise(F.translate(F.decode("body", "ISO-8859-1"), _HIGH_LATIN1, _HIGH_CP1251))
        .alias("text"),
    )


def split_frontmatter(notes: DataFrame) -> DataFrame:
    """Adds ``frontmatter`` (NULL if none), ``body`` and ``malformed`` (opened, never closed).

    The notes are dealt over all cores first: what follows takes far longer than reading them.
    """
    text = F.regexp_replace("text", r"\r\n?", "\n")
    opened = text.rlike(r"^[ \t]*---[ \t]*(?:\n|\z)")
    whole = r"(?s)^[ \t]*---[ \t]*\n(.*?)(?:(?<=\n)[ \t]*(?:---|\.\.\.)[ \t]*(?:\n|\z))(.*)\z"
    closed = opened & text.rlike(whole)
    return spread(notes).withColumns(
        {
            "frontmatter": F.when(closed, F.regexp_extract(text, whole, 1)),
            "body": F.when(closed, F.regexp_extract(text, whole, 2)).otherwise(text),
            "malformed": opened & ~closed,
        }
    )


def _key_value(line: Column) -> Column:
    """(key, rest) of a line ``key: rest``; null where the line is none. A key may be quoted."""
    sign = F.substring(line, 1, 1)
    inside = F.substring(line, F.lit(2), F.length(line))
    closed = F.replace(inside, F.lit('\\"'), F.lit("\u0003\u0003"))
    quoted = sign.isin('"', "'") & F.when(sign == '"', closed.contains('"')).otherwise(inside.contains("'"))
    length = F.when(sign == '"', F.instr(closed, '"') + 1).otherwise(F.instr(inside, "'") + 1)
    key = F.when(quoted, F.substring(line, F.lit(1), length)).otherwise(F.substring_index(line, ":", 1))
    behind = F.substring(line, F.length(key) + 1, F.length(line))
    colon = F.ltrim(behind).startswith(":")
    rest = F.substring(F.ltrim(behind), F.lit(2), F.length(behind))
    second = F.substring(line, 2, 1)
    begins = F.when(sign == "-", ~second.isin("", " ", "\t", ":")).otherwise(~sign.rlike(r"[\s#{}\[\]:'\"]"))
    good = colon & (key != "") & (quoted | begins) & ((rest == "") | rest.startswith(" ") | rest.startswith("\t"))
    return F.when(good, F.struct(key.alias("key"), F.ltrim(F.translate(rest, "\t", " ")).alias("rest")))


# An item ends at a comma outside quotes and brackets; an unclosed one takes the rest.
_ITEM = (
    r"(?s)(?:\"[^\"]*+\"|'[^']*+'|\[\[[^\]]*+\]\]|\[[^\]]*+\]|\{[^}]*+\}|[^,\"'\[\]{}]"
    r"|[\"'\[\]{}].*)++"
)


def _no_comment(value: Column) -> Column:
    return F.when(value.rlike("^[\"']"), value).otherwise(F.regexp_replace(value, r"\s+#.*$", ""))


def _flow_items(inner: Column) -> Column:
    items = F.regexp_extract_all(inner, F.lit(_ITEM), F.lit(0))
    return F.filter(F.transform(items, unquote), lambda v: F.length(F.trim(v)) > 0)


def frontmatter_fields(notes: DataFrame, *keep: str) -> DataFrame:
    """One row per key: ``key, kind`` (scalar, list, object, block) ``, items``. Nested mappings
    add ``parent.child`` keys, one level deep. A repeated key keeps its last value."""
    chunk = F.col("chunk")
    # A top-level line starts in the first column; what follows indented or with a dash belongs to it.
    chunks = explode_rows(
        notes.where(F.col("frontmatter").isNotNull()),
        F.transform(F.split("frontmatter", r"\n(?=[^\s#-]|-[^\s:])"),
                    lambda c, i: F.struct(i.alias("i"), c.alias("c"))),
        "x", *keep,
    ).select(*keep, F.col("x.i").alias("i"), F.col("x.c").alias("chunk"))
    head = _key_value(F.substring_index(chunk, "\n", 1))
    keyed = chunks.withColumn("head", head).where("head IS NOT NULL").select(
        *keep, "i",
        strip(unquote(F.col("head.key"))).alias("key"),
        strip(_no_comment(strip(F.col("head.rest")))).alias("rest"),
        F.filter(
            F.slice(F.split(chunk, "\n"), 2, 100_000_000),
            lambda line: (F.length(F.trim(line)) > 0) & line.rlike(r"^[ \t-]"),
        ).alias("block"),
    )
    rest, block = F.col("rest"), F.col("block")
    dash = F.ltrim(F.get(block, 0)).startswith("-")
    joined = F.array_join(F.transform(block, lambda b: F.trim(b)), " ")
    list_items = F.transform(
        F.filter(block, lambda b: F.ltrim(b).startswith("-")),
        lambda b: unquote(_no_comment(F.trim(F.substring(F.trim(b), F.lit(2), F.length(b))))),
    )
    flow = rest.startswith("[")
    mapping = rest.startswith("{")
    inner = F.regexp_replace(F.substring(rest, F.lit(2), F.length(rest)), r"[\]\s]+$", "")
    inner_map = F.regexp_replace(F.substring(rest, F.lit(2), F.length(rest)), r"[}\s]+$", "")
    is_block = rest.rlike(r"^[|>][+-]?\d*$")
    kind = (
        F.when(is_block, "block").when(flow, "list").when(mapping, "object")
        .when(rest != "", "scalar").when(dash, "list").when(F.size(block) > 0, "object")
        .otherwise("scalar")
    )
    items = (
        F.when(is_block, F.array(joined))
        .when(flow, _flow_items(inner))
        .when(mapping, _flow_items(inner_map))
        .when(rest != "", F.array(F.trim(F.concat(rest, F.lit(" "), joined))))
        .when(dash, list_items)
        .when(F.size(block) > 0, F.array(F.lit("x")))
        .otherwise(F.array(F.lit("")))
    )
    indent = F.array_min(F.transform(block, lambda b: F.length(b) - F.length(F.ltrim(b))))
    own = F.filter(
        F.transform(F.filter(block, lambda b: F.length(b) - F.length(F.ltrim(b)) == indent), lambda b: _key_value(F.trim(b))),
        lambda x: x.isNotNull(),
    )
    child_of_block = F.transform(
        own, lambda x: F.struct(strip(unquote(x["key"])).alias("k"), _no_comment(F.trim(x["rest"])).alias("v"))
    )
    child_of_flow = F.filter(
        F.transform(
            F.col("items"),
            lambda c: F.struct(
                strip(unquote(F.regexp_extract(c, "^([^:]*)", 1))).alias("k"),
                F.trim(F.regexp_extract(c, "^[^:]*:(.*)$", 1)).alias("v"),
            ),
        ),
        lambda c: c["k"] != "",
    )
    none = F.array().cast("array<struct<k:string,v:string>>")
    children = (
        F.when((F.col("kind") == "object") & mapping, child_of_flow)
        .when((F.col("kind") == "object") & (rest == ""), child_of_block)
        .otherwise(none)
    )
    full = keyed.withColumns({"kind": kind, "items": items}).withColumn("children", children)
    own_row = F.array(F.struct(F.col("key").alias("key"), F.col("kind").alias("kind"), F.col("items").alias("items")))
    child_rows = F.transform(
        "children",
        lambda c: F.struct(F.concat("key", F.lit("."), c["k"]).alias("key"), F.lit("scalar").alias("kind"),
                           F.array(c["v"]).alias("items")),
    )
    long = explode_rows(full, F.concat(own_row, child_rows), "f", *keep, "i")
    return long.groupBy(*keep, F.col("f.key").alias("key")).agg(
        F.max_by(F.struct("f.kind", "f.items"), "i").alias("v")
    ).select(*keep, "key", "v.kind", "v.items")


def without_fences(body: Column) -> Column:
    """The body without fenced code."""
    return M.without_fences(body)


def inline_fields(notes: DataFrame, *keep: str) -> DataFrame:
    """``key:: value`` lines and bracketed fields outside fenced code; one row per key of a
    note with its values in order."""
    body = without_fences(F.regexp_replace("text", r"\r\n?", "\n"))

    every = F.transform(
        M.inline_fields(F.col("b")),
        lambda p: F.struct(safe_label(F.trim(p["k"], F.lit("*_ "))).alias("key"), p["v"].alias("value")),
    )
    rows = spread(notes).withColumn("b", body).where(F.col("b").contains("::"))
    return explode_rows(rows, every, "f", *keep).select(*keep, "f.key", "f.value")


def table_rows(notes: DataFrame, *keep: str) -> DataFrame:
    """Markdown tables outside fenced code: one row per table with ``header`` (labels) and
    ``rows`` (cells). Escaped pipes and links keep their pipe."""
    body = without_fences(F.regexp_replace("text", r"\r\n?", "\n"))
    rows = notes.withColumn("b", body).where(F.col("b").contains("|"))
    numbered = F.transform(M.tables(F.col("b")), lambda t, i: F.struct(i.alias("table_no"), t.alias("t")))
    return explode_rows(rows, numbered, "x", *keep).select(
        *keep, "x.table_no",
        F.transform(split_cells(F.col("x.t.head")), lambda c: safe_label(c)).alias("header"),
        F.transform("x.t.lines", split_cells).alias("rows"),
    )


def split_cells(line: Column) -> Column:
    """Cells of a table row: pipes split, except escaped ones and those inside ``[[...]]``."""
    held = F.regexp_replace(strip(line), r"\\\|", "\u0003")
    held = F.regexp_replace(F.regexp_replace(held, r"^\|", ""), r"\|$", "")
    pieces = F.regexp_extract_all(held, F.lit(r"((?:\[\[[^\]\n]*+\]\]|[^|])*+)(?:\||$)"), F.lit(1))
    # The pattern also matches the empty rest at the very end of a line that does not end in a cell.
    n = F.length(F.regexp_replace(F.regexp_replace(held, r"\[\[[^\]\n]*\]\]", ""), r"[^|]", "")) + 1
    return F.transform(F.slice(pieces, F.lit(1), n), lambda c: strip(F.translate(c, "\u0003", "|")))


def csv_rows(files: DataFrame, *keep: str) -> DataFrame:
    """Delimiter (the most frequent of comma, semicolon, tab in the first line), header labels
    and the number of data rows of a CSV text."""
    first = F.regexp_extract("text", r"^([^\n]*)", 1)

    def count(ch: str) -> Column:
        return F.length(first) - F.length(F.replace(first, F.lit(ch), F.lit("")))

    comma, semi, tab = count(","), count(";"), count("\t")
    delimiter = (
        F.when((comma >= semi) & (comma >= tab), ",").when(semi >= tab, ";").otherwise("\t")
    )
    lines = F.filter(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n"), lambda s: s != "")
    header = F.when(delimiter == ",", F.split(first, ",")).when(
        delimiter == ";", F.split(first, ";")
    ).otherwise(F.split(first, "\t"))
    return files.select(
        *keep, delimiter.alias("delimiter"),
        F.transform(header, lambda c: safe_label(F.trim(c, F.lit("\"\r ")))).alias("header"),
        (F.size(lines) - 1).alias("data_rows"),
    )
