"""Cubes on disk: Parquet by resolution, histograms, metadata as JSON."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import MAX_COMBO, Grid, TimeSlice, overall
from ..operators import cube as C
from .features import vocabulary

VERSION = "1.0"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query run inside deletes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def build(features: DataFrame, slices: list[TimeSlice], grids: list[Grid], path: str, most: int = MAX_COMBO) -> None:
    """Counts of all resolutions, base, tag and combination histograms, vocabularies and metadata under `path`."""
    spark = features.sparkSession
    C.counts(features, slices, grids, most).write.mode("overwrite").partitionBy("resolution").parquet(f"{path}/counts")
    cube = spark.read.parquet(f"{path}/counts")
    first = cube.filter(F.col("resolution") == grids[0].name)
    first.groupBy("record_type", "tag_key", "tag_parts", "slice_key").agg(F.sum("cnt").alias("cnt")).write.mode("overwrite").parquet(f"{path}/histograms")
    vocabulary(features).write.mode("overwrite").parquet(f"{path}/vocabulary")
    bins = spark.read.parquet(f"{path}/histograms")
    tags = bins.filter(F.size("tag_parts") == 1)
    vocabulary_by_slice = bins.filter("tag_key = ''").select("slice_key", F.lit("record_type").alias("kind"), F.col("record_type").alias("name")).unionByName(tags.select("slice_key", F.lit("tag").alias("kind"), F.col("tag_key").alias("name"))).distinct()
    vocabulary_by_slice.write.mode("overwrite").parquet(f"{path}/vocabulary_by_slice")
    g, span = grids[0].bounds, overall(slices)
    names = spark.read.parquet(f"{path}/vocabulary").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(n) for k, n in (("record_type", "record_types"), ("tag", "tags"))])
    total = bins.filter("tag_key = ''").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_features"))
    shape = lambda x: F.struct(F.lit(x.name).alias("resolution"), *[F.lit(getattr(x, k)).alias(k) for k in ("rows", "cols", "cell_width", "cell_height")])
    meta = total.crossJoin(names).withColumns(
        {
            "version": F.lit(VERSION),
            "resolutions": F.array(*[F.lit(x.name) for x in grids]),
            "dimensions": F.array(*map(shape, grids)),
            "slices": F.array(*[F.struct(F.lit(x.key).alias("key"), F.lit(x.label).alias("label"), F.lit(x.start).alias("start_year"), F.lit(x.end).alias("end_year")) for x in slices]),
            "start_year": F.lit(span.start),
            "end_year": F.lit(span.end),
            "bounds": F.struct(*[F.lit(v).alias(k) for k, v in vars(g).items()]),
            "n_cells": F.lit(grids[0].cols * grids[0].rows),
        }
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """counts, histograms (incidences without cells), vocabulary, vocabulary_by_slice and metadata of a stored cube."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("counts", "histograms", "vocabulary", "vocabulary_by_slice")} | {"metadata": spark.read.json(f"{path}/metadata")}


def as_json(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., json): rows as JSON lines for an answer, made by the executors."""
    return rows.select(*by, F.to_json(F.struct(*rows.columns)).alias("json"))
