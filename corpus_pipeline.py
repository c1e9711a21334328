"""The corpus pipeline: five stages, each an operator of corpusloom.llm over all its predecessor kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and any others that docs has, whatever
their names. Of an empty table every stage makes an empty one; what nulls, empty texts and repeated rows
come to is said below, and in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import materialize, release, table
from corpusloom.llm.jaccard_join import keep_one
from corpusloom.llm.mixing import apply_mix
from corpusloom.llm.packing import pack
from corpusloom.llm.quality_classifier import keep_good
from corpusloom.llm.quality_rules import apply_quality_rules


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant rejects go. A null or empty text is scored as one of no words."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules reject, or that lose most of their words to boilerplate lines, go;
    the others lose those lines. A null or empty text fails the base rules; a null source is a host of its own."""
    return apply_quality_rules(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at a Jaccard of 0.8, stays: that of the
    smallest doc_id, one row of it if it repeats. Documents without a word all stay."""
    return keep_one(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come by target weight, a document as often as it is drawn. Documents without a word come with their block;
    a null source is a source of its own."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is the end id alone; repeated rows are packed each."""
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("mixing", mixing), ("packing", packing)]

#: Learnt models, sampling and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "_stored_at"):
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
