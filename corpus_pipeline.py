"""A training corpus from raw documents, in five stages; each works on all that the stage before kept.

``run`` writes what each stage returns to the shared folder and reads it back for the next.

Null, empty and wordless texts are sound unless the labels say otherwise, have no lines, shingles or windows, and reach the last
stage with the tokens of the empty text. Long texts are read whole; ties go to the least doc_id, and ids must be distinct. An empty table of
documents gives empty results; without labels or benchmark nothing is toxic by label or contaminated. Other columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spellaudit.llm import bpe, decontaminate, lines, near_dups, quality
from spellaudit.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither junk nor toxic."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that earlier lines repeat; documents with nothing left go."""
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dups.drop_near_duplicates(docs, percent=80, trees=24)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no twentieth is in windows of benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and of the decoded bytes."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("byte-level BPE", encoding)]
#: The classifier, the trees and the merges are no SQL; tests/llm/test_pipeline.py compares the stages and run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name=name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
