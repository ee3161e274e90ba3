"""Queries of area A (normalisation, detection, masking, part numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.functions import pii, text as tx
from partsight.functions.keys import oem_key
from partsight.functions.spans import explode_rows
from partsight.operators import masking as mk
from partsight.plans.registry import query
from partsight.sources.domain import Domain, with_domain


def _docs(d: Domain) -> DataFrame:
    return d["documents"].select("doc_id", "source", "text")


def _with_damage(d: Domain) -> DataFrame:
    """Documents, some of them with zero-width characters, full-width digits and combining marks."""
    damaged = (
        F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "e", "e​"))
        .when(F.col("doc_id") % 5 == 1, F.translate("text", "0123456789", "０１２３４５６７８９"))
        .when(F.col("doc_id") % 5 == 2, F.regexp_replace("text", "a", "á"))
        .otherwise(F.col("text"))
    )
    return _docs(d).withColumn("text", damaged)


@query("text_normalize")
def text_normalize(d: Domain) -> DataFrame:
    """Sizes before and after, hidden and invalid characters, per document."""
    return tx.with_views(_with_damage(d)).select(
        "doc_id", F.length("text").alias("chars"), F.length("nt").alias("view_chars"),
        F.size("hidden").alias("hidden"), F.size("invalid").alias("invalid"),
        F.md5("nt").alias("view_md5"),
    )


@query("text_fold_views", f"""
    SELECT doc_id, md5(translate(text, '{tx.LAT_TO_CYR[0]}', '{tx.LAT_TO_CYR[1]}')) AS cyr_md5,
      md5(translate(text, '{tx.CYR_TO_LAT[0]}', '{tx.CYR_TO_LAT[1]}')) AS lat_md5,
      length(text) AS chars FROM documents""")
def text_fold_views(d: Domain) -> DataFrame:
    """A02."""
    return d["documents"].select(
        "doc_id", F.md5(tx.fold_cyr(F.col("text"))).alias("cyr_md5"),
        F.md5(tx.fold_lat(F.col("text"))).alias("lat_md5"), F.length("text").cast("bigint").alias("chars"),
    )


@query("pii_candidates")
def pii_candidates(d: Domain) -> DataFrame:
    """Every hit of every detector, by type."""
    found = pii.with_candidates(tx.with_views(_docs(d)))
    return (
        explode_rows(found, F.col("candidates"), "c", "source")
        .groupBy("source", F.col("c.type").alias("type"))
        .agg(F.count(F.lit(1)).alias("candidates"))
    )


_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INTEGER)
       ELSE (2 * CAST(substr(reverse(digits), i, 1) AS INTEGER)) // 10
            + (2 * CAST(substr(reverse(digits), i, 1) AS INTEGER)) % 10 END)) % 10 = 0"""


@query("pii_card_luhn", f"""
    WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text,
        '[0-9A-Za-z]+', ' \\0 ', 'g'), '[0-9]+(?:(?:  | [ \\t-] )[0-9]+)*')) AS run FROM documents),
    d AS (SELECT doc_id, regexp_replace(run, '[^0-9]', '', 'g') AS digits FROM runs)
    SELECT doc_id, count(*) AS long_numbers, count(*) FILTER ({_LUHN}) AS cards
    FROM d WHERE length(digits) BETWEEN 13 AND 19 GROUP BY doc_id""")
def pii_card_luhn(d: Domain) -> DataFrame:
    """A04, cards: digit runs of 13 to 19 digits (single separators) and the Luhn check."""
    padded = F.regexp_replace("text", "[0-9A-Za-z]+", " $0 ")
    runs = F.regexp_extract_all(padded, F.lit(r"[0-9]+(?:(?:  | [ \t-] )[0-9]+)*"), F.lit(0))
    digits = d["documents"].select("doc_id", F.explode(runs).alias("run")).select(
        "doc_id", F.regexp_replace("run", "[^0-9]", "").alias("digits")
    )
    return (
        digits.where(F.length("digits").between(13, 19))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("long_numbers"), F.count_if(pii.is_card(F.col("digits"))).alias("cards"))
    )


@query("pii_spans")
def pii_spans(d: Domain) -> DataFrame:
    """Chosen spans, one row each, in normalised offsets."""
    return explode_rows(mk.detect(_docs(d)), F.col("pii"), "s", "doc_id").select(
        "doc_id", "s.type", "s.start", "s.end"
    )


_TYPES = "['EMAIL', 'SOCIAL', 'URL', 'CARD', 'PHONE', 'VIN', 'PLATE']"
_PLANTED_SQL = f"""planted AS (SELECT event_id, event_type, {_TYPES}[event_id % 7 + 1] AS t1, {_TYPES}[(event_id + 1) % 7 + 1] AS t2 FROM events),
    spans AS (SELECT event_id, event_type, t1 AS type, '[' || t1 || '_1]' AS token, 2 AS n FROM planted
      UNION ALL SELECT event_id, event_type, t1, '[' || t1 || '_2]', 1 FROM planted
      UNION ALL SELECT event_id, event_type, t2, '[' || t2 || '_1]', 1 FROM planted)"""


def _planted(d: Domain) -> DataFrame:
    """Texts with two values of one of the seven types, the first one twice, and a value of the next type."""

    def value(kind: F.Column, number: F.Column) -> F.Column:
        n, odd = F.lpad((number % 10000).cast("string"), 4, "0"), number % 2 == 1
        return (
            F.when(kind == 0, F.concat(F.lit("u"), n, F.lit("@mail.ru")))
            .when(kind == 1, F.concat(F.lit("@user_"), n))
            .when(kind == 2, F.concat(F.lit("https://example.com/a"), n))
            .when(kind == 3, F.when(odd, "4111 1111 1111 1111").otherwise("5500-0000-0000-0004"))
            .when(kind == 4, F.concat(F.lit("+7 (900) 123-"), F.substring(n, 1, 2), F.lit("-"), F.substring(n, 3, 2)))
            .when(kind == 5, F.concat(F.lit("WDB2130421A12"), n))
            .otherwise(F.when(odd, "А123ВС77").otherwise("В 456 ЕК 199"))
        )

    k = F.col("event_id")
    one, two, three = value(k % 7, k), value((k + 1) % 7, k), value(k % 7, k + 1)
    text = F.concat(F.lit("see "), one, F.lit(" or "), two, F.lit(", not "), three, F.lit("; again "), one, F.lit("!"))
    return d["events"].select(k, "event_type", text.alias("text"))


@query("pii_tokens", f"""
    WITH {_PLANTED_SQL}
    SELECT event_id, token, CAST(n AS BIGINT) AS occurrences FROM spans""")
def pii_tokens(d: Domain) -> DataFrame:
    """Equal values share a token, numbers count by first appearance; all seven types."""
    found = pii.with_tokens(mk.detect(_planted(d)))
    return explode_rows(found, F.col("spans"), "s", "event_id").groupBy("event_id", F.col("s.token").alias("token")).agg(
        F.count(F.lit(1)).alias("occurrences")
    )


@query("pii_mask")
def pii_mask(d: Domain) -> DataFrame:
    """A07."""
    return mk.mask_texts(_docs(d)).select(
        "doc_id", "mask_status", F.size("spans").alias("spans"), F.md5("masked").alias("masked_md5"),
        F.length("masked").alias("chars"),
    )


@query("pii_mapping")
def pii_mapping(d: Domain) -> DataFrame:
    """Only sizes leave the query; the mapping itself is a restricted output."""
    return mk.token_mappings(_docs(d)).select("doc_id", F.size("mapping").alias("tokens"))


@query("pii_route_oversize", """
    SELECT source, count(*) FILTER (length(text) <= 10000) AS maskable,
      count(*) FILTER (length(text) > 10000) AS too_long FROM documents GROUP BY source""")
def pii_route_oversize(d: Domain) -> DataFrame:
    """A09 with a limit that the data reaches."""
    fits, long = mk.route_oversize(_docs(d), limit=10_000)
    both = fits.select("source", F.lit(True).alias("fits")).unionByName(
        long.select("source", F.lit(False).alias("fits"))
    )
    return both.groupBy("source").agg(
        F.count_if("fits").alias("maskable"), F.count_if(~F.col("fits")).alias("too_long")
    )


@query("pii_stats", f"""
    WITH {_PLANTED_SQL}
    SELECT event_type, type, CAST(sum(n) AS BIGINT) AS detections, count(DISTINCT event_id) AS texts FROM spans GROUP BY ALL""")
def pii_stats(d: Domain) -> DataFrame:
    """A10: detections of every type by source."""
    return mk.detection_stats(mk.detect(_planted(d)), ["event_type"])


@query("part_number_candidates")
def part_number_candidates(d: Domain) -> DataFrame:
    """A11 over whole documents."""
    return mk.part_number_candidates(_docs(d)).select(
        "doc_id", F.size("candidates").alias("candidates"),
        F.md5(F.array_join(F.transform("candidates", lambda c: c["key"]), ",")).alias("keys_md5"),
    )


@query("part_number_match", with_domain("product_oem", """,
    q AS (SELECT oem_id, 'Looking for ' || oem_number || ', thanks.' AS text FROM product_oem
          UNION ALL SELECT oem_id, 'No number here' FROM product_oem WHERE oem_id % 3 = 0)
    SELECT oem_id, upper(regexp_replace(oem_number, '[ \\-./]', '', 'g')) AS key,
      count(DISTINCT sku) AS products, CAST(12 AS INTEGER) AS start FROM product_oem GROUP BY ALL"""))
def part_number_match(d: Domain) -> DataFrame:
    """Numbers written in a sentence are found again in the catalogue."""
    texts = d["product_oem"].select(
        "oem_id", F.concat(F.lit("Looking for "), "oem_number", F.lit(", thanks.")).alias("text")
    ).unionByName(
        d["product_oem"].where("oem_id % 3 = 0").select("oem_id", F.lit("No number here").alias("text"))
    )
    keys = d["product_oem"].select("sku", oem_key(F.col("oem_number")).alias("oem_key"))
    found = mk.match_part_numbers(mk.part_number_candidates(texts), keys, "oem_id")
    return found.groupBy("oem_id", "key").agg(
        F.countDistinct("sku").alias("products"), F.min("start").alias("start")
    )


# -- obfuscation -----------------------------------------------------------------------------------

_RU = "скидка"


def _odd_words(d: Domain) -> DataFrame:
    """Supplier-style names with mixed scripts, foreign letters and spelled-out words."""
    word = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("C"), F.lit("кидка "), "p_name"))
        .when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" Mercedesа")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("п о з в о н и "), "p_name"))
        .otherwise(F.concat(F.lit("ѕcript "), "p_name"))
    )
    return d["part"].select("p_partkey", word.alias("nt"))


@query("obf_foreign")
def obf_foreign(d: Domain) -> DataFrame:
    """A12."""
    return _odd_words(d).select(
        "p_partkey", F.size(tx.foreign_spans("nt")).alias("foreign_spans")
    )


@query("obf_mixed_script", """
    SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 IN (0, 3) THEN 1 ELSE 0 END AS INTEGER)
      AS mixed_spans FROM part""")
def obf_mixed_script(d: Domain) -> DataFrame:
    """A Latin brand with a Russian ending is ordinary."""
    return _odd_words(d).select(
        "p_partkey", F.size(tx.mixed_script_spans("nt")).alias("mixed_spans")
    )


@query("obf_spaced", """
    SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS INTEGER)
      AS spaced_spans FROM part""")
def obf_spaced(d: Domain) -> DataFrame:
    """A14."""
    return _odd_words(d).select(
        "p_partkey", F.size(tx.spaced_letter_spans("nt")).alias("spaced_spans")
    )
