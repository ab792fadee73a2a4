"""A corpus pipeline: each stage reads what the one before it wrote.

All stages but the last keep all columns of documents, whatever their names.
Null and empty texts count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, decontamination, quality, secrets, simhash
from strandloom.llm.queries import WORD_BPE, table
from strandloom.sources.shared import remove, scratch, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A text without words has the score of the labels' shares, so it stays or
    goes as most labels say; without labels of both classes all stay. Repeated
    rows are judged alike. Labels with a null id or label are never learnt from.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, nulls last, then the smallest hash of the text.

    Texts without words are near-duplicates of one another. Of rows equal in id
    and text one stays; an id that several texts share, or null, joins no groups.
    """
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Texts and items without words hold no window; an item of fewer words than a
    window is one. Repeated rows stay or go together; an empty benchmark keeps all.
    """
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, overlapping ones together, and n_chars is counted anew there; null texts stay null, repeated rows change alike."""
    return secrets.redact_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the digests of ids and decoded text; a row for every row, no ids for null and empty texts."""
    return bpe.encode_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding", encoding_stage),
]

#: SQL can't express a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on their way is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + "-".join(name.lower().split()))
            now = made.pop()
        if before:
            remove(spark, before)
        before = now
    return docs
