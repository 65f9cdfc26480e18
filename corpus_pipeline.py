"""From raw documents to packed training sequences: toxicity, near copies, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before it kept, and its verdicts take effect: toxic documents go, one
document of each group of near copies stays, repeated passages are cut out, documents that leak a benchmark item go, and
the rest is packed. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placespark.llm import decontamination, packing, similarity_join, suffix_dedup, toxicity
from placespark.llm.catalog import tokenizer_path
from placespark.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and drops what it grades above 0."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of documents with a similarity of 0.8 or more."""
    return similarity_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what a document with a smaller doc_id also has; drops documents of which nothing is left."""
    return suffix_dedup.clean(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with the same or other numbers, names and units."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens with the corpus's mix of sources."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("packing", pack),
]

#: The first stage is a fitted model, which SQL does not express; tests/llm/test_pipeline.py has plain versions of all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
