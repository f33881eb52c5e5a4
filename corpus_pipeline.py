"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that its predecessor kept; all but the last return the columns
of ``documents``.

Defined results of all stages: null, empty and blank texts are documents without words
(clean, near each other, nothing to cut, size 0 and so not taken by the mix); null ids,
sources and languages stay null; equal rows count each until the SimHash stage keeps one
of them; an empty table gives empty tables; further columns pass through unchanged,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglot_spark.llm import mixing, packing, simhash, substrings, toxicity
from polyglot_spark.llm.common import Scratch, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF tagger does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; ``n_chars`` follows the text."""
    apart = docs.toDF(*[c if c in ("doc_id", "text") else f"__own_{k}" for k, c in enumerate(docs.columns)])  # clear of the columns that it adds
    left = substrings.remove_repeats(apart).drop("n_words", "n_removed", "kept_sha256").toDF(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place, packed in windows of the order in which the mix has stored its documents."""
    kept = docs.select("doc_id", "text")
    return packing.pack(packing.in_stored_order(kept, "__position"), order="__position")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, tokenizers and connected components are beyond one SQL statement; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result is written as Parquet and read again for the next stage, after which it is deleted."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch(stage(spark, docs, sf_dir))
            scratch.clear(keep=1)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
