"""Corpus preparation: toxic documents go, then repeated lines, near copies and repeated passages; what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import line_dedup, ngram_join, packing, substrings, toxicity
from pulsegrid.llm.common import checkpoint_dir, remove, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic go. The labels are those of sf_dir, outside the held-out fold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line chunks that repeat are taken out of texts; n_chars follows. All documents stay."""
    return line_dedup.dedup_lines(docs, length="n_chars")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id stays."""
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are taken out; n_chars follows. All documents stay."""
    return substrings.dedup_substrings(docs, length="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; what each stage returns is written as Parquet and read again, and removed once
    the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Tokenizers, dictionaries and hashed anchors have no SQL form.
ORACLE_SQL = None
