"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again
as the next stage's docs. All but the last return the columns of `documents`.

Defined results: a document without an id is dropped by the first stage, as no decision can be traced to it; one with a null text is judged like an empty one; repeated rows are judged alike, and as they
are copies one row of them stays after the second stage; columns beyond those of `documents` are not passed on; an empty
table passes through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwise.llm import bpe, mixing, near_dup, quality, secrets
from shardwise.llm.queries import MIX, labelled_domains, table
from shardwise.llm.storage import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The domain whose tokens are all wanted; the others' follow from the target weights.
ANCHOR = "good"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling rejects."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels")).where("kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(judged, "doc_id", "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates (five words, 80 %)."""
    kept = near_dup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    once = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; no document is dropped, and n_chars follows the text."""
    redacted = secrets.redact(docs.select(*COLUMNS).withColumn("before", F.length("text")))
    return redacted.withColumn("n_chars", F.when(F.length("text") != F.col("before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents by a seeded draw at their rates in the mix of the target weights MIX that has all tokens of ANCHOR."""
    mixed = mixing.mix(docs, labelled_domains(spark, sf_dir), MIX, anchor=ANCHOR)
    return docs.select(*COLUMNS).join(mixing.drawn(mixed).select("doc_id").distinct(), "doc_id", "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document: doc_id, ids, n_tokens and digests."""
    encoded = bpe.encode_column(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
