"""The registered queries of this package: each operator over its whole table, in the fixed result form."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partsight.llm import (
    alignment, byte_bpe, conversation_repair, language, licences, near_duplicates, neighbours, packing, quality, quality_rules, repeats,
    secret_scan, topk,
)
from partsight.llm.common import table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PREDICT_AT = 0.7


def _fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys give -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labels outside the held-out quarter."""
    return quality.train(docs, labels.where(_fold("doc_id", 4) != 2))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model).select(
        "doc_id",
        (_fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.encode(docs, MULTI_RANKS, public_tokenizers.PATTERN, decoded="raw", keep_text=False).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(docs.where(_fold("doc_id", 3) != 1))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_TOKENIZER)


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == F.lit(kind))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_scan.scan(docs, BYTE_RANKS, public_tokenizers.PATTERN).select("doc_id", "secrets")
    of = {k: _of_kind("secrets", k) for k in secret_scan.KINDS[:3]}
    base = F.filter("secrets", lambda s: s["kind"] != F.lit(secret_scan.KINDS[3]))
    return found.select(
        "doc_id",
        *(F.size(spans).cast("long").alias(f"n_{k}") for k, spans in of.items()),
        F.sha2(_spans_text(base), 256).alias("base_sha256"),
        _spans_text(F.col("secrets")).alias("spans"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return licences.summary(docs, licences.scan(docs, licences.known_digests(spark), hints=licences.HINTS))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_TOKENIZER, PIECE_MODEL)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).drop("n_lines", "failed")


def _damaged(turns: DataFrame) -> DataFrame:
    """One turn in 20 each: dropped, emptied, without sentence ends, repeated, given to the user."""
    space = F.lit(" ")
    named = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    damage = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    return turns.withColumn("damage", damage).select(
        "conv_id",
        "turn",
        (F.col("damage") != 0).alias("left"),
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = conversation_repair.prepared(_damaged(turns), present=F.col("left"))
    return conversation_repair.repair(rows, turns.schema["conv_id"].dataType)


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_topk": op2_topk,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_licences": op10_licences,
    "op11_alignment": op11_alignment,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversations": op13_conversations,
}

#: Licence lookup in SQL: the same rewrites and the same digests, of lines and of whole texts.
_KNOWN = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, kinds in licences.KNOWN_TEXTS.items() for text in kinds
)
_OP10_SQL = f"""
WITH known AS (
  SELECT min(licence) AS licence, sha256({licences.rewrites_sql("body")}) AS digest
  FROM (VALUES {_KNOWN}) AS v(licence, body) GROUP BY 2
), units AS (
  SELECT doc_id, TRUE AS entire, text AS unit FROM documents
  UNION ALL
  SELECT doc_id, FALSE, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))
), hits AS (
  SELECT doc_id, entire, licence FROM units JOIN known ON sha256({licences.rewrites_sql("unit")}) = digest
  WHERE {" OR ".join(f"contains(lower(unit), '{h}')" for h in licences.HINTS)}
), each AS (
  SELECT doc_id, min(CASE WHEN entire THEN licence END) AS whole_licence,
         count(*) FILTER (NOT entire) AS n_notices,
         array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, whole_licence, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN each e ON d.doc_id = e.doc_id
"""

_OP2_SQL = """
WITH rows AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM rows q JOIN rows p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

_BUCKET = "(v >> greatest(length(bin(v)) - 6, 0)) + 32 * greatest(length(bin(v)) - 6, 0)"
_FENCE = (
    "max(CASE WHEN measure = '{0}' THEN q3 + {2} * greatest(q3 - q1, {1}) END) AS {0}_most, "
    "max(CASE WHEN measure = '{0}' THEN {3} END) AS {0}_least"
)
_FENCES = ", ".join(
    _FENCE.format(m, d, quality_rules.REACH, f"q1 - {quality_rules.REACH} * greatest(q3 - q1, {d})" if low else "-1")
    for m, d, low in quality_rules.MEASURES
)
_CHOSEN = ", ".join(
    f"CASE WHEN o.docs >= {quality_rules.LEAST_DOCS} THEN o.{c} WHEN l.docs >= {quality_rules.LEAST_DOCS} THEN l.{c} ELSE e.{c} END AS {c}"
    for m, _, _ in quality_rules.MEASURES
    for c in (f"{m}_most", f"{m}_least")
)
_BEYOND = " OR ".join(f"{m} > {m}_most OR {m} < {m}_least" for m, _, _ in quality_rules.MEASURES)
_OP12_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (
    SELECT doc_id, i, unnest(range(8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, words) AS times FROM windows) WHERE times > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY doc_id
), measured AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.again, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM words LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * word_chars // n_words AS word_length,
         1000 * n_symbols // n_words AS symbol_rate, 1000 * n_dup_lines // n_lines AS line_repeats,
         1000 * n_repeat_words // n_words AS word_repeats
  FROM measured
), sketch AS (
  SELECT lang, source, measure, {_BUCKET} AS bucket, count(*) AS n FROM (
    UNPIVOT (SELECT lang, source, word_length, symbol_rate, line_repeats, word_repeats FROM based WHERE NOT base_failed)
    ON word_length, symbol_rate, line_repeats, word_repeats INTO NAME measure VALUE v)
  GROUP BY ALL
), of_language AS (SELECT lang, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL
), of_all AS (SELECT measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL
), o AS (SELECT lang, source, max(docs) AS docs, {_FENCES} FROM ({quality_rules.quartiles_sql("sketch", "lang, source")}) GROUP BY lang, source
), l AS (SELECT lang, max(docs) AS docs, {_FENCES} FROM ({quality_rules.quartiles_sql("of_language", "lang")}) GROUP BY lang
), e AS (SELECT {_FENCES} FROM ({quality_rules.quartiles_sql("of_all", "")})
), fences AS (SELECT o.lang, o.source, {_CHOSEN} FROM o JOIN l ON o.lang = l.lang CROSS JOIN e)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({_BEYOND}, FALSE) AS kept
FROM based LEFT JOIN fences USING (lang, source)
"""

ORACLES = {"op12_quality_rules": _OP12_SQL, "op2_topk": _OP2_SQL, "op9_near_duplicates": _OP9_SQL, "op10_licences": _OP10_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
