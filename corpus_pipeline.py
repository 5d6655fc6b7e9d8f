"""A training corpus from raw documents: five stages, each a table made from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import bpe, decontam, lines, nbsvm, neardup
from lanternfish.llm.common import discard, materialize, table
from lanternfish.llm.queries import TOKENIZERS


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """names' columns, n_chars that of the text as it is now."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    return nbsvm.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; one that so loses all its words goes."""
    got = lines.dedup(docs)
    left = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return _counted(got.where((F.size("removed") == 0) | F.coalesce(left, F.lit(False))), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return neardup.dedup(docs, 5, 0.8).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that is half such passages goes."""
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    got = bpe.encode_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", decoded=True)
    return got.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", encode)]

#: Classifier, fingerprints and tokens are beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
            discard(before)
    return docs
