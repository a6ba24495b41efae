"""Incremental counts: each micro-batch adds its counts to a table, under its own batch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.config import Grid, TimeSlice
from ..operators import cube as C
from ..sources.features import vocabulary


def start(features: DataFrame, slices: list[TimeSlice], grids: list[Grid], path: str, most: int = 0) -> StreamingQuery:
    """Writes a streaming DataFrame's counts; a batch that is run again overwrites its own folder, so nothing counts twice."""

    def add(batch: DataFrame, number: int) -> None:
        C.counts(batch, slices, grids, most).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        vocabulary(batch).write.mode("overwrite").parquet(f"{path}/vocabulary/batch={number}")

    return features.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counts").groupBy(*C.KEYS).agg(F.sum("cnt").alias("cnt"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name) of all types and tags seen so far."""
    return spark.read.parquet(f"{path}/vocabulary").select("kind", "name").distinct()
