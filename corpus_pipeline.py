"""Corpus preparation: toxic documents go, one of each near-duplicate group stays, repeated strings
are cut, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and all but the last
return the columns of `documents`. Between stages, documents are written as Parquet and read again.

Defined cases: null and empty texts are kept by every filter and packed as empty; null ids are kept
by the near-duplicate stage; columns besides doc_id and text pass through, but n_chars follows the
text; an empty table runs through to an empty result.
"""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shapeloom.llm import neardup, packing, suffixes, toxicity
from shapeloom.llm.common import held_out, saved, table

SIZE = 2048
# A classifier, MinHash groups and an induced suffix order are beyond SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a machine that learns from labels outside the held-out fifth."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out("doc_id"))
    return docs.filter(toxicity.scores(model, F.col("text")) < 0.5)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 of five-word shingles."""
    return neardup.representatives(docs, percent=80, size=5)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that start elsewhere too."""
    out = suffixes.removed(docs, width=200)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of SIZE tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=SIZE, end=0, pattern=public_tokenizers.PATTERN)


STAGES = [("toxicity", nontoxic), ("near_dedup", deduplicated), ("suffix_dedup", unrepeated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
