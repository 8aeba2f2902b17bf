"""A training corpus from raw documents: filter, deduplicate, redact, mix, encode.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last return the
columns of `documents`. Rows that repeat one doc_id are one document and stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.llm._labelled import remainder
from vigilark.llm._tables import settle
from vigilark.llm.bpe import bpe_encode
from vigilark.llm.mixing import Target, mix
from vigilark.llm.pii import redact
from vigilark.llm.simhash_dedup import near_duplicates
from vigilark.llm.toxicity import keep_clean, train_toxicity

#: No source recurs more than this many times as often as another.
MAX_REPEATS = 1.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject; it learns from the labels' rows
    whose crc32 remainder modulo 4 is not 2. Documents without an id are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, train_toxicity(docs, labels, remainder("doc_id", 4) != 2))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class. Those without an id stay."""
    classes = near_duplicates(docs.select("doc_id", "text"))
    copies = settle(classes.filter("doc_id <> component_id").select("doc_id").distinct(), columnar=True)
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars is counted again."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources more than once, as the mix asks for. Copies of one
    document that the mix draws are equal rows."""
    return mix(docs, Target(max_repeats=MAX_REPEATS)).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their number, and a digest of the text they decode to."""
    rows = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The first stage is a trained machine, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), columnar=True)
    return STAGES[-1][1](spark, docs, sf_dir)
