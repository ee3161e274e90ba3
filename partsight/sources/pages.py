"""Lenient ingest of saved API replies.

A reply body is one JSON text. Lists are found by endpoint, entries that fit their schema are kept
with unknown fields in a VARIANT, entries that do not fit leave only their index and field names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entry schemas as (field, accepted kinds, required). "text" takes numbers too.
USER_ID = "int|text"
SCHEMAS: dict[str, tuple[tuple[str, str, bool], ...]] = {
    "account": (("id", "int", True), ("name", "text", False), ("email", "text", False),
                ("phone", "text", False), ("phones", "list", False), ("profile_url", "text", False)),
    "content": (("text", "text", False), ("flow_id", "text", False), ("image", "object", False),
                ("item", "object", False), ("link", "object", False), ("location", "object", False),
                ("call", "object", False), ("voice", "object", False)),
    "quote": (("id", "text", False), ("author_id", USER_ID, False), ("created", "int", False),
              ("type", "text", False), ("content", "object", False)),
    "message": (("id", "text", True), ("created", "int", True), ("author_id", USER_ID, False),
                ("direction", "text", False), ("type", "text", False), ("content", "object", False),
                ("is_read", "bool", False), ("read", "int", False), ("quote", "object", False)),
    "chat": (("id", "text", True), ("created", "int", False), ("updated", "int", False),
             ("context", "object", False), ("users", "list", False),
             ("last_message", "object", False)),
    "item": (("id", "int", True), ("title", "text", False), ("price", "number", False),
             ("status", "text", False), ("url", "text", False), ("category", "object", False),
             ("address", "text", False)),
    "item_detail": (("status", "text", False), ("url", "text", False), ("start_time", "text", False),
                    ("finish_time", "text", False), ("autoload_item_id", "text", False),
                    ("vas", "list", False)),
    "meta": (("page", "int", False), ("per_page", "int", False)),
    "voice_files": (("voices_urls", "object", False),),
}
NESTED = {("message", "content"): "content", ("message", "quote"): "quote"}
LISTS = {"chats_list": ("chats", "chat"), "messages_list": ("messages", "message"),
         "items_list": ("resources", "item")}
OBJECTS = {"accounts_self": "account", "chat_detail": "chat", "voice_files": "voice_files",
           "item_detail": "item_detail"}
# Message types seen in the API description.
KNOWN_MESSAGE_TYPES = (
    "text", "image", "link", "item", "location", "call", "deleted", "voice", "system",
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved replies, one file each: ``path, body``."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def _kind_ok(value: Column, kinds: str) -> Column:
    """Does a variant value have one of the accepted kinds? Missing and JSON null are judged by the
    caller."""
    shape = F.schema_of_variant(value)
    whole = shape.isin("BIGINT") | (
        (shape.startswith("DECIMAL") | (shape == "DOUBLE"))
        & (F.try_variant_get(value, "$", "double") == F.floor(F.try_variant_get(value, "$", "double")))
    )
    numeric = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    digits = (shape == "STRING") & F.try_variant_get(value, "$", "string").rlike(r"^\s*[+-]?\d+\s*$")
    tests = {
        "int": whole | digits,
        "number": numeric | digits,
        "text": (shape == "STRING") | numeric,
        "bool": shape == "BOOLEAN",
        "list": shape.startswith("ARRAY"),
        "object": shape.startswith("OBJECT"),
    }
    out = F.lit(False)
    for kind in kinds.split("|"):
        out = out | tests[kind]
    return out


def issue_fields(entry: Column, schema: str, prefix: str = "") -> Column:
    """names of the fields of ``entry`` (variant) that do not fit, sorted."""
    found = []
    for name, kinds, required in SCHEMAS[schema]:
        value = F.try_variant_get(entry, f"$.{name}", "variant")
        absent = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))
        ok = F.when(absent, F.lit(not required)).otherwise(_kind_ok(value, kinds))
        found.append(F.when(~F.coalesce(ok, F.lit(False)), F.array(F.lit(prefix + name))))
        nested = NESTED.get((schema, name))
        if nested:
            inner = issue_fields(value, nested, f"{prefix}{name}.")
            found.append(F.when(~absent & _kind_ok(value, kinds), inner))
    empty = F.array().cast("array<string>")
    return F.array_sort(F.concat(*[F.coalesce(f, empty) for f in found]))


def list_entries(pages: DataFrame, endpoint: str) -> DataFrame:
    """One row per entry of a list reply; ``shape_ok`` is false (and the entry NULL) when
    the reply has no such list. A null list is an empty page; messages may be a bare array."""
    key, _ = LISTS[endpoint]
    body = F.try_parse_json(F.col("body"))
    at_key = F.try_variant_get(body, f"$.{key}", "variant")
    bare = F.try_variant_get(body, "$", "array<variant>")
    is_list = F.coalesce(F.schema_of_variant(at_key).startswith("ARRAY"), F.lit(False))
    is_bare = F.coalesce(F.schema_of_variant(body).startswith("ARRAY"), F.lit(False))
    if endpoint != "messages_list":
        is_bare = F.lit(False)
    null_list = F.coalesce(F.is_variant_null(at_key), F.lit(False))
    entries = F.when(is_list, F.try_variant_get(body, f"$.{key}", "array<variant>")).when(
        is_bare, bare
    )
    rows = pages.withColumns(
        {"shape_ok": is_list | is_bare | null_list, "entries": entries}
    )
    return rows.select(
        *[c for c in pages.columns if c != "body"], "shape_ok",
        F.coalesce(F.size("entries"), F.lit(0)).alias("raw_count"),
        F.posexplode_outer("entries").alias("index", "entry"),
    )


def parse_entries(entries: DataFrame, schema: str) -> DataFrame:
    """``issues`` (field names) per entry; an entry without issues is a kept item."""
    is_object = F.coalesce(F.schema_of_variant("entry").startswith("OBJECT"), F.lit(False))
    fields = F.when(is_object, issue_fields(F.col("entry"), schema)).otherwise(
        F.array(F.lit("<root>"))
    )
    return entries.where(F.col("entry").isNotNull()).withColumn("issues", fields).withColumn(
        "kept", F.size("issues") == 0
    )


def page_meta(pages: DataFrame) -> DataFrame:
    """page and per_page of an item listing."""
    body = F.try_parse_json(F.col("body"))
    return pages.select(
        *[c for c in pages.columns if c != "body"],
        F.try_variant_get(body, "$.meta.page", "int").alias("page"),
        F.try_variant_get(body, "$.meta.per_page", "int").alias("per_page"),
    )


def parse_objects(pages: DataFrame, endpoint: str) -> DataFrame:
    """single-object replies with their issues."""
    single = pages.withColumn("entry", F.try_parse_json(F.col("body"))).drop("body")
    return parse_entries(single, OBJECTS[endpoint])


def voice_urls(pages: DataFrame) -> DataFrame:
    """the id -> URL map of a voice reply, one row per voice."""
    urls = F.from_json(F.get_json_object("body", "$.voices_urls"), "map<string,string>")
    return pages.select(
        *[c for c in pages.columns if c != "body"], F.explode(urls).alias("voice_id", "url")
    )


def error_code(body: Column) -> Column:
    """the error code of a reply in the three shapes seen, at most 64 characters."""
    doc = F.try_parse_json(body)

    def scalar(path: str) -> Column:
        value = F.try_variant_get(doc, path, "variant")
        shape = F.schema_of_variant(value)
        flat = ~(shape.startswith("OBJECT") | shape.startswith("ARRAY"))
        return F.when(flat, F.try_variant_get(doc, path, "string"))

    def shape(path: str) -> Column:
        return F.coalesce(
            F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit("")
        )

    error, code = shape("$.error"), shape("$.code")
    first = shape("$.errors[0]")
    found = (
        F.when(error.startswith("OBJECT"), scalar("$.error.code"))
        .when(code != "", scalar("$.code"))
        .when(first.startswith("OBJECT"), scalar("$.errors[0].code"))
        .when(first != "", F.lit(None))
        .when(error == "STRING", scalar("$.error"))
    )
    return F.substring(found, 1, 64)
