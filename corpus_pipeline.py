"""A training-corpus pipeline over ``documents``: each stage's output is written and reread as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm import content_sort, mixing, ngram_join, packing, quality
from ocellus.llm.common import drop_all, written
from ocellus.llm.queries import held_out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of this table's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels, lambda i: ~held_out(i)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of smallest id."""
    drop_all(spark)  # the stage before is stored
    return content_sort.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (Jaccard of five-word shingles 0.8 or more, transitively) the document of smallest id."""
    drop_all(spark)  # the stage before is stored
    return ngram_join.distinct_near_documents(docs, width=5, num=8, den=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as long, as the mix takes them; n_chars follows a cut text."""
    drop_all(spark)  # the stage before is stored
    out = mixing.mixture(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 1024."""
    drop_all(spark)  # the stage before is stored
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("source mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, keep=True)
    return docs
