"""Merges of heatmaps, histograms and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cell-wise sums of several heatmaps of one resolution."""
    return cells.groupBy(*by, "row", "col", "cell_idx").agg(F.sum("cnt").alias("cnt"))


def merge_types(cells: DataFrame, types: list[str]) -> DataFrame:
    """Heatmaps of several record types as one, named by the sorted types joined by '+'."""
    some = cells.filter(F.col("record_type").isin(types))
    return merge_cells(some, ["resolution", "slice_key", "tag_key"]).withColumn("record_type", F.lit("+".join(sorted(types))))


def merge_heatmaps(parts: list[DataFrame], blueprint: DataFrame) -> DataFrame:
    """(row, col, cell_idx, cnt) of several heatmaps, zeros for cells in none of them; a cell outside the blueprint is an error."""
    cells = blueprint.select("row", "col", "cell_idx")
    if not parts:
        return cells.withColumn("cnt", F.lit(0).cast("long"))
    rows = parts[0].select("row", "col", "cell_idx", "cnt")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("row", "col", "cell_idx", "cnt"))
    full = cells.withColumn("_known", F.lit(True)).join(merge_cells(rows, []), ["row", "col", "cell_idx"], "full")
    misfit = F.raise_error(F.lit("heatmaps of different sizes can't be merged")).cast("long")
    return full.select("row", "col", "cell_idx", F.when(F.col("_known").isNull(), misfit).otherwise(F.coalesce("cnt", F.lit(0))).alias("cnt"))


def merge_bins(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by, "slice_key").agg(F.sum("cnt").alias("cnt"))


def merged_summary(bins: DataFrame, slices: DataFrame) -> DataFrame:
    """One row for merged histograms: greatest bin, total, range of years, types and tags they hold."""
    per = merge_bins(bins, []).agg(F.max("cnt").alias("max_count"), F.sum("cnt").alias("total_features"))
    span = bins.join(F.broadcast(slices.select("slice_key", "start_date", "end_date")), "slice_key").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.array_join(F.array_sort(F.collect_set("record_type")), ",").alias("record_types"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("tag_key") != "", F.col("tag_key")))), ",").alias("tags"))
    return per.crossJoin(span)


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several artifacts; of equal keys the first artifact's stays."""
    if not parts:
        raise ValueError("nothing to merge")
    numbered = [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
    rows = numbered[0]
    for p in numbered[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("_source"))).filter("_rn = 1").drop("_rn", "_source")


def or_sum(cube: DataFrame, tags: list[str]) -> DataFrame:
    """Any of the tags, by adding their heatmaps: a record with two of them counts twice."""
    return merge_cells(cube.filter(F.col("tag_key").isin(tags) & (F.size("tag_parts") == 1)), ["resolution", "slice_key", "record_type"])


def or_union(placed: DataFrame, tags: list[str]) -> DataFrame:
    """Any of the tags, every record once; from placed records, as counts don't tell."""
    some = placed.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return some.groupBy("resolution", "slice_key", "record_type", "row", "col", "cell_idx").agg(F.count(F.lit(1)).alias("cnt"))


def or_union_bins(features: DataFrame, tags: list[str]) -> DataFrame:
    """(record_type, slice_key, cnt) of records with any of the tags, each once; from records assigned to cells and slices."""
    some = features.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return some.groupBy("record_type", "slice_key").agg(F.count(F.lit(1)).alias("cnt"))
