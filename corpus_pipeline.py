"""A corpus pipeline of five stages: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes what its predecessor has written and does its work on all of it. All but the last return the
columns of ``documents``, whatever others the input has. Decisions are about documents: rows that share a doc_id (null
or not) and a text get the same one, rows that share a doc_id alone don't. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import bpe, decontaminate, jaccard, language, secrets
from tesseral.llm.common import cleared, crc_bucket, quoted, scratch, table, text_of
from tesseral.llm.queries import END_ID, LANGUAGE_FOLDS, TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near copies share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null texts and those without any letter go; rows without a doc_id or a
    language are judged too, but not learned from. If nothing was learned, nothing can be told and all go."""
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), LANGUAGE_FOLDS) == 0, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id, a null one last, then by text hash.

    Repeated rows of that document all stay. Null texts, and those without words, are no copies of anything."""
    classes = jaccard.classes(docs.select("doc_id", "text"), size=NEAR_WORDS, percent=NEAR_PERCENT, keyed=True)
    gone = classes.where(~F.col("first")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__gone")).distinct()
    rows = docs.select(*COLUMNS).withColumn("__key", F.sha2(text_of(docs, "text"), 256))
    same = rows["__key"].eqNullSafe(gone["__gone"]) & rows["doc_id"].eqNullSafe(gone["__id"])
    return rows.join(gone, same, "left_anti").select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null texts hold none. Items that are null teach nothing."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mark, and n_chars to match; null texts stay null."""
    found = secrets.Ledger(spark, scratch(spark, "secret-ledger")).scan(docs.select(*COLUMNS))
    masked = F.when(F.size("spans") > 0, secrets.redacted(text_of(docs, "text"), "spans")).otherwise(quoted("text"))
    found = found.withColumn("text", masked)
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids with the end id, as little-endian 32-bit numbers; decoding gives the text.

    A row for each row; a null text has the end id alone."""
    encoded = bpe.encode(docs.select("doc_id", "text"), TOKENIZER)
    end = F.lit(END_ID.to_bytes(4, "little"))
    ids = F.concat(F.col("ids"), end)
    return encoded.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark", drop_benchmark_passages),
    ("secrets", mask_secrets),
    ("tokens", encode_tokens),
]

#: Language models, components and tokenizers can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with cleared(spark):  # what the stage wrote on its way is not needed after it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
