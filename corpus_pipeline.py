"""A corpus pipeline of training-data operators; each stage works on all that its predecessor kept.

Every stage takes null, empty and repeated rows, empty tables and further columns of any name: null and empty
texts are scored by the classifier like others, are no near copies of anything, lose nothing and hold
nothing private, and have no words to pack (one row, no bin). Rows that are equal share every decision;
rows of one doc_id with different texts are different documents. All stages but the last give the columns of
documents back in their order; n_chars follows the text where a stage changes it.

The pseudonyms' key is read from the file named in VEILFRAME_KEY_FILE (32 bytes at least). Only where that is
unset, as in tests, a published key is used, with which anyone could undo them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import near_duplicates, packing, pii, quality, substrings
from veilframe.llm.common import materialize, release, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), least=0.3)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return near_duplicates.keep_one(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that repeats over 200 bytes or more goes."""
    return substrings.cleaned(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format."""
    return pii.pseudonymize(docs, pii.key_from_environment())


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are laid into training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_classifier), ("minhash", minhash), ("suffix_array", suffix_array), ("pii", pseudonyms), ("packing", best_fit)]

#: No SQL expresses these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
