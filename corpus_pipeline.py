"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

1. language_id: documents whose language can't be told are dropped.
2. line_dedup: recurring lines are dropped from all documents but the first that has them;
   documents that this leaves empty, having had text, are dropped.
3. ngram_jaccard_join: of each group of near copies (five-word shingles, similarity 0.8) the
   document of the smallest id stays.
4. pii: personal data is masked.
5. best_fit_packing: what is left is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import jaccard_join, language_id, line_templates, packing, pii
from pricewright.llm.storage import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the present text."""
    n_chars = F.length("text").cast("long")
    return docs.withColumn("n_chars", n_chars).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(docs.select(*COLUMNS))
    return _counted(cleaned.filter(F.trim(F.coalesce("text", F.lit(""))) != ""))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_copies(docs.select(*COLUMNS), size=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.mask_personal_data(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The models and the packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
