"""Incremental runs (K01, K02): file streams whose batches reuse the batch operators.

foreachBatch runs at least once, so every write is idempotent: priced bills overwrite their own partitions, log rows are keyed by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantra.operators.library import merge_reviews
from quantra.operators.sinks import refresh


def price_new_bills(spark: SparkSession, folder: str, schema, price: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each new file of bill lines is priced once; a batch's results are one partition, which a replay of the batch overwrites. So there are as many folders as
    batches, however many bills; `priced_bills` reads the last results of each."""

    def batch(lines: DataFrame, number: int) -> None:
        price(lines).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def priced_bills(spark: SparkSession, out: str) -> DataFrame:
    """The results of all batches; of a bill that came again, those of its last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("boq_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["boq_id", "batch"], "left_semi").drop("batch")


def apply_decisions(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Review decisions arrive as files. The table they are kept in has the last decision of each candidate, one row, in a fixed number of buckets; a batch reads and replaces those it
    touches. A decision that comes late, or again, changes nothing, so a replayed batch is harmless and the order of the files does not matter."""

    def last(held: DataFrame, rows: DataFrame) -> DataFrame:
        both = held.unionByName(rows)
        return both.groupBy("candidate_row_number").agg(F.max_by(F.struct(*(c for c in both.columns if c != "candidate_row_number")), F.struct("ts", "event_id")).alias("d")).select("candidate_row_number", "d.*")

    def batch(rows: DataFrame, number: int) -> None:
        refresh(rows.where("reviewer_status <> 'pending'"), out, "candidate_row_number", last)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(candidates: DataFrame, decisions: DataFrame, reviewer: str = "reviewer") -> DataFrame:
    """The candidates after all decisions that have arrived: a join, as the table has one row a candidate."""
    return merge_reviews(candidates, decisions.drop("bucket"), reviewer, settled=True)
