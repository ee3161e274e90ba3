"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Quality classifier (rejected documents go), near-duplicates (one document of each component stays),
repeated passages (their bytes go, and documents that consisted of nothing else), secrets (replaced
by a mark) and packing. All but the last return the columns of ``documents``; n_chars follows the text.
Null texts count as empty and stay null; rows with a null doc_id pass every stage; extra columns of
``documents`` do not pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partsight.llm import near_duplicates, packing, quality, repeats, secret_scan
from partsight.llm.common import small_batches, stored, table
from partsight.llm.queries import BYTE_RANKS, PREDICT_AT, WORD_TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated passage: 50 words of English are longer. And the q-grams that find it.
PASSAGE_BYTES, PASSAGE_GRAMS = 250, (64, 160, 224, 240, 247)
#: Chunks that a worker of the packing stage remembers: fewer than usual, as the stages before left their memory used.
PACKING_MEMORY = 400_000
#: Near-duplicates here: five words a shingle, a similarity of 0.8.
WORDS, PERCENT = 5, 80


def _begun(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What a stage reads of its input; texts go to Python in small batches."""
    small_batches(spark)
    return docs.select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from all labels."""
    docs = _begun(spark, docs)
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model, keep_text=True)
    return scored.where(F.col("score") >= PREDICT_AT).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id; of rows equal in id and text, one."""
    docs = _begun(spark, docs)
    found = near_duplicates.near_duplicates(docs, words=WORDS, percent=PERCENT)
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]).join(kept, "doc_id", "left_semi")
    return known.unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without strings of ``PASSAGE_BYTES`` that stand anywhere else; documents left empty by it go."""
    docs = _begun(spark, docs)
    marked = docs.withColumn("given", F.col("text").isNotNull())
    found = repeats.remove_repeats(
        marked, window=PASSAGE_BYTES, grams=PASSAGE_GRAMS, carry=("lang", "source", "n_chars", "given")
    )
    cut = repeats.kept_texts(found)
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return (
        cut.where((F.col("n_removed") == 0) | (F.col("text") != ""))
        .withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
        .withColumn("text", F.when(F.col("given"), F.col("text")))
        .select(*COLUMNS)
    )


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with secrets replaced by a mark."""
    docs = _begun(spark, docs)
    found = secret_scan.redact(secret_scan.scan(docs, BYTE_RANKS, public_tokenizers.PATTERN))
    changed = F.size("secrets") > 0
    chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", chars).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048."""
    return packing.pack_documents(_begun(spark, docs), WORD_TOKENIZER, memory=PACKING_MEMORY)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No stage but the scan for secrets can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
