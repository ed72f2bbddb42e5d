"""Where intermediate tables go: spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a temporary folder on a local master (tests), an error on a cluster, whose executors could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however many results start from it, and without lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is sent to every task as a whole; larger ones are left to Spark.
SENT_ROWS = 1 << 17


def by_distinct(rows: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what make adds to their distinct columns (one row each, which keeps them): for work that depends on these columns alone, so that it is done once a combination and not once a row.
    Columns that make adds take the place of those of rows. rows are read twice."""
    return joined_back(rows, stored(make(rows.select(*columns).distinct()), "distinct"), columns)


def joined_back(rows: DataFrame, made: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """rows with what made, a stored table of one row a combination of columns (nulls are equal), adds to them; nulls where it has no such row. Columns of made take the place of those of rows.
    how: inner where each row has its row in made."""
    sent = F.broadcast(made) if made.count() <= SENT_ROWS else made
    named = sent.withColumnsRenamed({c: f"__{c}" for c in columns})
    kept = rows.drop(*(c for c in made.columns if c not in columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return kept.join(named, same, how).drop(*(f"__{c}" for c in columns))


def spread(rows: DataFrame, column: str) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has, however few files or row groups they are read from: for rows that take long each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()
