"""The corpus pipeline: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Stages call the operators of ``sparkrel.llm`` and add nothing of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrel.llm import lines, mixing, packing, quality, simhash
from sparkrel.llm.common import discard, stored, table
from sparkrel.llm.tokens import default_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, rates as good."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one, up to 2 edits."""
    return lines.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by the operator's contract (3 words, 3 bits)."""
    return simhash.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a row for each time that a document is taken."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs, default_path())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Models, edit distances and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``, each written and read again before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)  # what the stage has read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
