"""A corpus cleaned in stages; each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, contamination, language, line_dedup, simhash
from shelfmark.llm.registry import tokenizer
from shelfmark.sources.tables import checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a language; those called ``und`` (null, or without a letter) go."""
    lexicons = language.fit(language.training_rows(docs))
    return docs.withColumn("__is", language.predicted(docs, lexicons)).where(F.col("__is.lang_pred") != language.UNKNOWN).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that a document with a larger id keeps; n_chars follows the text."""
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    changed = F.col("kept.n_dropped") > 0
    kept = done.withColumn("text", F.when(changed, F.col("kept.kept")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies: the one with the smallest id. Null ids stay."""
    gone = simhash.classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by passages of the benchmark."""
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, their number, and whether the ids spell the text again."""
    coded = bpe.transcode(docs, tokenizer())
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_copies),
    ("decontamination", decontaminate),
    ("bpe", encode_tokens),
]
#: SQL can express neither the language model, the classes of near-copies, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through Parquet folders in the shared checkpoint folder."""
    docs, root = table(spark, sf_dir, "documents").select(*COLUMNS), f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{root}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
