"""A corpus pipeline: language ID, exact dedup, near-duplicate join, secret scan, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame, is written as Parquet and read again as the docs of the next one;
all but the last return the columns of documents, whatever further columns there are: rows go through as one struct. Stages decide on all rows they get and keep the order of no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import table, written
from foliospark.llm.exact_dedup import exact_duplicates
from foliospark.llm.language_id import UNKNOWN, identify, training_samples
from foliospark.llm.ngram_join import similar_groups
from foliospark.llm.packing import packed, public_tokenizer
from foliospark.llm.secrets import find_secrets, masked

#: What stands in place of a secret.
MASK = "[SECRET]"
#: Stands for the samples where nothing is labelled: a single language, so only texts without a letter are unknown.
NO_LABELS = (("any", ""),)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null or have no letter, whatever the labels; other columns stay as they are."""
    samples = tuple(s for s in training_samples(docs) if s[0] != UNKNOWN)
    found = identify(docs.select(F.struct(*docs.columns).alias("row")), samples or NO_LABELS, "row.text")
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest id stays, of rows repeated with the same id one: the first by its columns that have an order (maps have none)."""
    own = docs.columns
    ordered = [f.name for f in docs.schema if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    kept = exact_duplicates(docs, keep="largest").where("kept").select(F.xxhash64("doc_id", "text_sha256").alias("kept_key"))
    rows = docs.select(F.struct(*own).alias("row"), F.xxhash64(F.col("doc_id"), digest).alias("kept_key")).join(kept, "kept_key", "left_semi")
    copy = F.row_number().over(Window.partitionBy("kept_key").orderBy(*(F.col("row")[c] for c in ordered)))
    return rows.withColumn("copy", copy).where("copy = 1").select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of word 5-grams (Jaccard similarity of 0.8 or more) connect, the one with the smallest id stays."""
    groups = similar_groups(docs, n=5, percent=80)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("component").isNotNull()).groupBy("component").agg(F.min("row_key").alias("kept_key"))
    kept = first.select("kept_key").unionByName(groups.where(F.col("component").isNull()).select(F.col("row_key").alias("kept_key")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("kept_key"))
    return rows.join(kept, "kept_key", "left_semi").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the new text. No row goes."""
    found, changed = masked(find_secrets(docs), MASK), F.size("found") > 0
    new = {"text": F.col("masked_text"), "n_chars": F.length("masked_text").cast("bigint")}
    own = lambda c: F.when(changed, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]
    return found.select(*(own(c).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a task holds one batch of texts, and one group of pieces."""
    return packed(docs, public_tokenizer())


STAGES = [("language ID", language_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("secret scan", secrets_stage), ("packing", packing_stage)]

#: SQL has no counterpart of the language ID and the packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
