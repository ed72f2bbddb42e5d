"""From raw documents to a token table: each stage works on all that the one before kept.

In every stage rows with null ids or texts and empty texts take part as their operator says (none crashes, and only a decision removes a row), very long texts count whole, repeated rows are
judged alike, an empty table stays empty, and columns come back as given whatever their names; the last stage returns the token table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantra.llm.common import stored
from quantra.llm.dac import token_table
from quantra.llm.mixing import mixed
from quantra.llm.posindex import decontaminate
from quantra.llm.simhash import drop_near_copies
from quantra.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labelled rows among them. Without labels all stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the least doc_id. Texts without words all stay."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; one without words as often as its source's certain copies."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and where each document stands in them; a null or empty text is its end id."""
    return token_table(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", tokens),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


#: Rows of an Arrow batch while the pipeline runs: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written and read again."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return docs
    finally:
        spark.conf.set(BATCH_SETTING, before)
