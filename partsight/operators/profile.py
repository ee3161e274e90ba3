"""The note profile as group-bys over long tables of fields, tables and links.

Only names, types, shapes and counts come out; values do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.functions import markdown as M
from partsight.functions import values as V
from partsight.functions.spans import explode_rows
from partsight.rules import profile as R


def observe(fields: DataFrame) -> DataFrame:
    """G08, row level: per field occurrence its type, whether it is filled and its scalars.

    ``fields`` holds ``source, key, kind, items``; blocks and objects carry no scalars.
    """
    filled = F.filter("items", lambda x: F.length(F.trim(V.unquote(x))) > 0)
    scalar = F.coalesce(F.get("items", 0), F.lit(""))
    kind = (
        F.when(F.col("kind") == "list", R.T_LIST)
        .when(F.col("kind") == "object", R.T_OBJECT)
        .when(F.col("kind") == "block", R.T_TEXT)
        .otherwise(V.value_type(scalar))
    )
    none = F.array().cast("array<string>")
    plain = ~F.col("kind").isin("block", "object")
    return fields.withColumn("filled_items", filled).withColumns(
        {
            "value_type": kind,
            "is_filled": F.size("filled_items") > 0,
            "scalars": F.when(plain, F.transform("filled_items", lambda x: F.trim(V.unquote(x)))).otherwise(none),
        }
    )


def field_stats(observed: DataFrame, *, exact: bool = True) -> DataFrame:
    """G08 + G23: per (source, key) how often it is present and filled, its scalars, the code-like
    ones, their distinct keys and images; two group-bys, no cap on distinct values. ``exact=False``
    estimates the distinct keys."""
    present = observed.groupBy("source", "key").agg(
        F.count(F.lit(1)).alias("present"), F.count_if("is_filled").alias("filled")
    )
    long = explode_rows(observed, F.col("scalars"), "v", "source", "key")
    ids = F.when(V.is_idlike(F.col("v")), V.id_key(F.col("v")))
    counted = long.withColumn("id", ids).groupBy("source", "key").agg(
        F.count(F.lit(1)).alias("scalars"),
        F.count("id").alias("idlike"),
        (F.countDistinct("id") if exact else F.approx_count_distinct("id")).alias("distinct_ids"),
        F.count_if(V.value_type(F.col("v")) == R.T_IMAGE).alias("images"),
    )
    return present.join(counted, ["source", "key"], "left").fillna(0).withColumn(
        "filled_percent", F.round(100 * F.col("filled") / F.col("present")).cast("bigint")
    )


def type_counts(observed: DataFrame) -> DataFrame:
    """Types per field, and item types of lists."""
    own = observed.select("source", "key", F.lit("value").alias("level"), "value_type")
    lists = explode_rows(
        observed.where(F.col("kind") == "list"), F.col("filled_items"), "x", "source", "key"
    ).select("source", "key", F.lit("item").alias("level"), V.value_type(F.col("x")).alias("value_type"))
    return own.unionByName(lists).groupBy("source", "key", "level", "value_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def key_candidates(observed: DataFrame, stats: DataFrame) -> DataFrame:
    """Fields that look like keys, with uniqueness and their three most frequent shapes."""
    share = F.col("idlike") / F.col("scalars")
    hint = F.lower("key").rlike("|".join(R.ID_NAME_HINTS))
    chosen = stats.where((F.col("scalars") > 0) & ((share >= 0.5) | (hint & (share >= 0.2))))
    long = explode_rows(observed, F.col("scalars"), "v", "source", "key").where(
        V.is_idlike(F.col("v"))
    )
    shapes = long.groupBy("source", "key", V.shape(F.col("v")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("source", "key").orderBy(F.desc("n"), "shape")
    top = (
        shapes.withColumn("r", F.row_number().over(w)).where("r <= 3")
        .groupBy("source", "key")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "shape"))),
                                      lambda x: x["shape"]), " | ").alias("top_shapes"))
    )
    return chosen.join(top, ["source", "key"], "left").select(
        "source", "key", "scalars", "idlike", "distinct_ids",
        F.round(100 * F.col("distinct_ids") / F.col("idlike")).cast("bigint").alias("unique_percent"),
        F.coalesce("top_shapes", F.lit("")).alias("top_shapes"),
    )


def template_groups(fields: DataFrame, notes: DataFrame, top: int = 12) -> DataFrame:
    """Notes grouped by their sorted set of keys: templates, singletons, notes, with_image, share of all notes.

    The ``top`` templates with at least two notes are rows of their own (templates = 1), all others one row
    named "other". ``fields``: ``note_id, key`` (labels); ``notes``: ``note_id, has_image``. A note has few
    keys, so its key set is a small array.
    """
    signature = fields.groupBy("note_id").agg(
        F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("signature")
    )
    per_note = notes.join(signature, "note_id", "left").fillna({"signature": ""})
    total = notes.agg(F.count(F.lit(1))).scalar()
    groups = per_note.groupBy("signature").agg(
        F.count(F.lit(1)).alias("notes"), F.count_if("has_image").alias("with_image")
    )
    named = groups.where("notes >= 2").orderBy(F.desc("notes"), "signature").limit(top).select("signature", F.lit(True).alias("named"))
    marked = groups.join(named, "signature", "left")
    return marked.groupBy(F.when(F.col("named"), F.col("signature")).otherwise(R.OTHER).alias("signature")).agg(
        F.count(F.lit(1)).alias("templates"), F.count_if(F.col("notes") == 1).alias("singletons"),
        F.sum("notes").alias("notes"), F.sum("with_image").alias("with_image"),
        F.round(100 * F.sum("notes") / total).cast("bigint").alias("share_percent"),
    )


def table_groups(tables: DataFrame) -> DataFrame:
    """Tables with the same header: tables, rows, longest, notes, rows with a code and an
    image. ``tables``: ``note_id, header, rows``."""
    has_id = lambda r: F.exists(r, V.is_idlike)
    has_image = lambda r: F.exists(r, lambda c: V.value_type(c) == R.T_IMAGE)
    return tables.groupBy(F.array_join("header", " | ").alias("header")).agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum(F.size("rows")).alias("data_rows"),
        F.max(F.size("rows")).cast("bigint").alias("max_rows"),
        F.countDistinct("note_id").alias("notes"),
        F.sum(F.size(F.filter("rows", lambda r: has_id(r) & has_image(r)))).alias("id_image_rows"),
    )


def headings(notes: DataFrame, body: Column) -> DataFrame:
    """Headings outside fenced code, one row each."""
    return explode_rows(notes, M.headings(body), "h", "note_id").select(
        "note_id", "h.level", F.regexp_replace("h.name", r"\s+", " ").alias("heading")
    )


def note_counters(notes: DataFrame, body: Column) -> DataFrame:
    """Per note: inline queries, tags, template markers, fences by language."""
    tags = M.tag_count(M.without_headings(M.without_links(F.col("b"))))
    return notes.withColumn("b", body).select(
        "note_id",
        F.regexp_count("b", F.lit(r"(?m)^.*(?:`=|`\$=).*$")).alias("inline_queries"),
        tags.alias("tags"),
        (F.col("text").contains("{{") | F.col("text").contains("<%")).alias("has_template_marker"),
    )


def fence_languages(notes: DataFrame) -> DataFrame:
    """Fenced blocks by language; only known languages are named."""
    lang = F.lower(F.col("lang"))
    return (
        explode_rows(notes, M.fence_words(F.col("text")), "lang", "note_id")
        .groupBy(F.when(lang.isin(*R.KNOWN_CODE_LANGUAGES), lang).otherwise(R.OTHER).alias("language"))
        .agg(F.count(F.lit(1)).alias("blocks"))
    )


def suppress_rare(counts: DataFrame, name: str, n: str, k: int, placeholder: str = "*") -> DataFrame:
    """Names seen fewer than ``k`` times are only counted."""
    rare = F.col(n) < k
    return counts.groupBy(F.when(rare, placeholder).otherwise(F.col(name)).alias(name)).agg(
        F.count(F.lit(1)).alias("names"), F.sum(n).alias(n)
    )


def links(notes: DataFrame, body: Column) -> DataFrame:
    """Every link with its kind, target file and whether it is an image."""
    long = explode_rows(
        notes.withColumn("b", body).where(F.col("b").contains("[")), M.links(F.col("b")), "l", "note_id"
    ).select("note_id", "l.style", "l.embed", "l.target")
    image = V.is_image_target(F.col("target"))
    url = F.col("target").rlike("(?i)^[a-z]+://")
    kind = (
        F.when((F.col("style") == "wiki") & F.col("embed") & image, "image_embed")
        .when((F.col("style") == "wiki") & F.col("embed"), "other_embed")
        .when(F.col("style") == "wiki", "wikilink")
        .when(url, "url_link")
        .when(F.col("embed") & image, "image_embed_md")
        .otherwise("md_local_link")
    )
    name = V.target_name(F.when(F.col("style") == "md", F.replace("target", F.lit("%20"), F.lit(" ")))
                        .otherwise(F.col("target")))
    named = F.when((F.col("style") == "wiki") & ~F.col("embed") & ~name.contains("."),
                   F.concat(name, F.lit(".md"))).otherwise(name)
    return long.select(
        "note_id", kind.alias("kind"),
        F.when(~url | (F.col("style") == "wiki"), named).alias("file"),
        (F.col("target").contains("|") & (F.col("style") == "wiki") & ~F.col("embed")).alias("alias"),
        (F.col("target").contains("#") & (F.col("style") == "wiki") & ~F.col("embed")).alias("to_heading"),
        image.alias("image"),
    )


def link_counts(found: DataFrame) -> DataFrame:
    """Links by kind, plus aliases and heading links."""
    return found.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("alias").alias("aliases"),
        F.count_if("to_heading").alias("heading_links"),
    )


def embed_histogram(found: DataFrame) -> DataFrame:
    """Notes by their number of image embeds."""
    per_note = found.where(F.col("kind").startswith("image_embed")).groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_note.groupBy(V.embed_bucket(F.col("n")).alias("embeds")).agg(
        F.count(F.lit(1)).alias("notes")
    )


def resolve_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """Image files that some note uses, and image targets that do not exist (``files``: ``name``
    lower case). Semi- and anti-join on distinct names."""
    targets = found.where("image AND file IS NOT NULL").select(F.col("file").alias("name")).distinct()
    names = files.select("name").distinct()
    used = names.join(targets, "name", "left_semi").select("name", F.lit("used").alias("state"))
    missing = targets.join(names, "name", "left_anti").select("name", F.lit("missing").alias("state"))
    return used.unionByName(missing)


def image_matches_id(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes where an image name contains one of the note's own codes (five characters or
    more). Joined per note on pieces of the name as long as the codes, never image by code."""
    codes = ids.where(F.length("id") >= 5).select("note_id", "id").distinct()
    sizes = codes.groupBy("note_id").agg(F.collect_set(F.length("id")).alias("sizes"))
    names = found.where("image AND file IS NOT NULL").select("note_id", V.id_key(F.col("file")).alias("k"))
    pieces = F.flatten(
        F.transform(
            "sizes",
            lambda n: F.when(
                F.length("k") >= n,
                F.transform(F.sequence(F.lit(1), F.length("k") - n + 1), lambda i: F.substring(F.col("k"), i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    cut = names.distinct().join(sizes, "note_id")
    long = explode_rows(cut, F.array_distinct(pieces), "id", "note_id")
    return long.join(codes, ["note_id", "id"], "left_semi").select("note_id").distinct()


def path_rollup(paths: DataFrame, depth: int, max_children: int) -> DataFrame:
    """Per folder the entries directly in it and in its subtree, down to ``depth``; beyond
    ``max_children`` children of a folder the rest is one row. ``paths``: ``folder`` (array).

    Folders are summed up before their prefixes are exploded, so a folder with very many entries
    costs one row per level.
    """
    direct = paths.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size("folder"), F.lit(depth))),
        lambda k: F.struct(k.alias("level"), F.array_join(F.slice("folder", F.lit(1), k), "/").alias("path"),
                           F.array_join(F.slice("folder", F.lit(1), F.greatest(k - 1, F.lit(0))), "/").alias("parent"),
                           (k == F.size("folder")).alias("here")),
    )
    totals = (
        direct.select("n", F.explode(prefixes).alias("p"))
        .groupBy("p.level", "p.path", "p.parent")
        .agg(F.sum(F.when(F.col("p.here"), F.col("n")).otherwise(0)).alias("direct"),
             F.sum("n").alias("total"))
    )
    # Only the first children are ranked (the limit works before the shuffle); the rest of a folder
    # is what its children sum up to without them.
    w = Window.partitionBy("level", "parent").orderBy(F.desc("total"), "path")
    top = F.when(F.col("level") == 0, F.lit(1)).otherwise(F.lit(max_children))
    shown = (
        totals.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max(max_children, 1))
        .where(F.col("rank") <= top)
        .select("level", "parent", "path", "direct", "total", F.lit(1).cast("bigint").alias("folders"))
    )
    sums = [F.sum("direct").alias("direct"), F.sum("total").alias("total")]
    every = totals.groupBy("level", "parent").agg(*sums, F.count(F.lit(1)).alias("folders"))
    seen = shown.groupBy("level", "parent").agg(*sums, F.sum("folders").alias("folders"))
    rest = (
        every.alias("e").join(seen.alias("s"), ["level", "parent"])
        .where(F.col("e.folders") > F.col("s.folders"))
        .select(
            "level", "parent", F.concat("parent", F.lit("/…")).alias("path"),
            *[(F.col(f"e.{c}") - F.col(f"s.{c}")).alias(c) for c in ("direct", "total", "folders")],
        )
    )
    return shown.unionByName(rest)


def size_report(files: DataFrame) -> DataFrame:
    """Files by extension label and size bucket. ``files``: ``ext, size``."""
    return files.groupBy(
        V.extension_label(F.col("ext")).alias("extension"), V.size_bucket(F.col("size")).alias("size")
    ).agg(F.count(F.lit(1)).alias("files"))


def image_folders(files: DataFrame, depth: int, top: int = 8) -> DataFrame:
    """The folders with most images, cut at ``depth``."""
    images = files.where(F.col("ext").isin(*[f".{e}" for e in R.IMAGE_EXTENSIONS]))
    cut = F.concat(
        F.array_join(F.slice("folder", F.lit(1), F.lit(depth)), "/"),
        F.when(F.size("folder") > depth, "/…").otherwise(""),
    )
    return images.groupBy(cut.alias("folder")).agg(F.count(F.lit(1)).alias("images")).orderBy(
        F.desc("images"), "folder"
    ).limit(top)


def redact(name: Column, salt: str, prefix: str = "K") -> Column:
    """A salted hash label. The salt is a job parameter; take a new one for every report."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 32))
