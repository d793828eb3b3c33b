"""A training corpus from raw documents in five stages; each works on all that the one before kept.

1. quality: documents that the rules or the trees reject go.
2. near_dedup: of documents linked at similarity 0.8 of 5-word shingles, the one of least doc_id stays.
3. decontaminate: documents that hold a window of a benchmark item go.
4. secrets: secrets are replaced by a mark; n_chars follows the text.
5. bpe: texts become token ids, with digests of the ids and of what they decode to.

Every stage takes an empty table, repeated rows, texts of any length and columns beyond those of `documents`; what it does
with nulls is said there and in the operator's own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import op2_secret_scan, op3_decontaminate, op4_quality, op5_bpe, op8_bottomk
from tidewatch.llm.common import set_aside, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts and those of under 50 words go.  Columns that have the names of its figures stay as they are."""
    forest = op4_quality.fit(docs, table(spark, sf_dir, "labels"))
    given, back = set_aside(docs, *op4_quality.BASE, "base_failed", "quality", "kept")
    return op4_quality.rate(given, forest).where("kept").select(*given.columns).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without doc_id or without words stay; rows that repeat a doc_id are judged by their own texts, equal ones are one."""
    return op8_bottomk.dedup(docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words stay."""
    return op3_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; a null text stays null.  A repository is a source and language, an owner a source."""
    clean = op2_secret_scan.redacted(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; a null text has no ids."""
    return op5_bpe.bpe(docs, op5_bpe.vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("bpe", bpe)]

#: Trees and tokens are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
