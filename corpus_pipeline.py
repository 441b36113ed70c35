"""The documents table, cleaned, deduplicated, mixed and tokenised: five stages, each written and read again.

Every stage takes all rows that its predecessor kept; all but the last return the columns of documents, in that order, whatever
other columns come along. Ids and any other column may be null, rows may repeat, texts may be of any length; an empty table
gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scratch import shared_dir
from threadloom.llm import bpe, jaccard, mixing, quality, suffix
from threadloom.llm.common import remove_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those without text among them; of the others, lines that fail a rule go. Equal rows fare alike."""
    return quality.keep_clean(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the least id stays; rows count by id and text, those without words all stay."""
    return jaccard.keep_first(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes found twice are cut out of the texts; no row goes. Null texts stay null, and a null ``n_chars`` goes with them."""
    return suffix.remove(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order; a source's last copy ends at its target.

    Rows without a word have nothing to be taken and go; equal rows are mixed one by one.
    """
    order = mixing.training_order(mixing.mix(docs, keep=("text", "lang", "source")))
    gap = "[^ \\t-\\r]+[ \\t-\\r]*"
    whole = F.col("kept.text")
    part = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(gap), F.lit(0)), 1, F.col("copy_words").cast("int")), "")
    text = F.when(F.col("copy_words") < F.col("size"), part).otherwise(whole)
    return order.select("doc_id", text.alias("text"), "kept.lang", "kept.source", F.length(text).cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per copy; a null text is an empty one, of no tokens."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Near duplicates, repeated passages and BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is deleted when that of the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == last:
            break
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove_folder(spark, f"{base}/{k - 1}")
    return out
