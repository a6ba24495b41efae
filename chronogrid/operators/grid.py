"""Spatial binning: cells, blueprints, polygons, chunks."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Bounds, Grid


_SIZES, _EDGES = ["cols", "rows", "cell_width", "cell_height"], ["min_lon", "max_lon", "min_lat", "max_lat"]


def _axis(value: Column, low: float | Column, high: float | Column, size: float | Column, n: int | Column) -> Column:
    """Index on one axis; the exact upper bound falls into the last cell, outside is null."""
    low, high, size, n = map(F.lit, (low, high, size, n))
    at = F.floor((value - low) / size).cast("int")
    at = F.when((value == high) & (at >= n), n - 1).otherwise(at)
    return F.when((at >= 0) & (at < n), at)


def _place(b, grid) -> tuple[Column, Column]:
    """Row and column of a point; the numbers of the grid are constants or columns."""
    return _axis(F.col("lat"), b.min_lat, b.max_lat, grid.cell_height, grid.rows), _axis(F.col("lon"), b.min_lon, b.max_lon, grid.cell_width, grid.cols)


def cell(grid: Grid) -> Column:
    """struct(resolution, row, col, cell_idx), null outside the grid."""
    row, col = _place(grid.bounds, grid)
    return F.when(col.isNotNull() & row.isNotNull(), F.struct(F.lit(grid.name).alias("resolution"), row.alias("row"), col.alias("col"), (row * grid.cols + col).alias("cell_idx")))


def assign_cells(features: DataFrame, grids: list[Grid]) -> DataFrame:
    """One row for each record and grid it lies in; one pass for all grids, the numbers of the grids being columns."""
    if len(grids) == 1:
        row, col = _place(grids[0].bounds, grids[0])
        each, name, n = features, F.lit(grids[0].name), F.lit(grids[0].cols)
    else:
        numbers = [F.struct(F.lit(g.name).alias("name"), *[F.lit(getattr(o, k)).alias(k) for o, ks in ((g, _SIZES), (g.bounds, _EDGES)) for k in ks]) for g in grids]
        each = features.withColumn("_grid", F.explode(F.array(*numbers)))
        g = SimpleNamespace(**{k: F.col(f"_grid.{k}") for k in _SIZES + _EDGES})
        row, col = _place(g, g)
        name, n = F.col("_grid.name"), g.cols
    cells = each.select(*features.columns, name.alias("resolution"), row.alias("row"), col.alias("col"), n.alias("_cols"))
    return cells.filter("row is not null and col is not null").withColumn("cell_idx", F.col("row") * F.col("_cols") + F.col("col")).drop("_cols")


def blueprint(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells row by row with their bounds; last row and column end at the exact bound."""
    b, i = grid.bounds, F.col("id")
    row, col = (i / grid.cols).cast("int"), (i % grid.cols).cast("int")
    at = spark.range(grid.cols * grid.rows).select(row.alias("row"), col.alias("col"), i.cast("int").alias("cell_idx"))
    low = lambda k, start, size: F.lit(start) + F.col(k) * F.lit(size)
    high = lambda k, start, size, n, end: F.when(F.col(k) == n - 1, F.lit(end)).otherwise(F.lit(start) + (F.col(k) + 1) * F.lit(size))
    return at.select(
        F.concat_ws("_", "row", "col").alias("cell_id"), "row", "col", "cell_idx",
        low("col", b.min_lon, grid.cell_width).alias("min_lon"), high("col", b.min_lon, grid.cell_width, grid.cols, b.max_lon).alias("max_lon"),
        low("row", b.min_lat, grid.cell_height).alias("min_lat"), high("row", b.min_lat, grid.cell_height, grid.rows, b.max_lat).alias("max_lat"),
    )


def polygons(cells: DataFrame) -> DataFrame:
    """Closed five-point rings of cells as GeoJSON-ready arrays."""
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"), p("min_lon", "min_lat"))
    return cells.withColumn("ring", ring)


def chunks(spark: SparkSession, bounds: Bounds, rows: int = 4, cols: int = 4) -> DataFrame:
    """Equal boxes that partition the bounds, row by row."""
    w, h = bounds.max_lon - bounds.min_lon, bounds.max_lat - bounds.min_lat
    at = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    part = lambda k, start, size, n: F.lit(start) + k * F.lit(size) / F.lit(float(n))
    return at.select(
        F.concat(F.lit("chunk_"), "r", F.lit("_"), "c").alias("chunk_id"), "r", "c",
        part(F.col("c"), bounds.min_lon, w, cols).alias("min_lon"), part(F.col("c") + 1, bounds.min_lon, w, cols).alias("max_lon"),
        part(F.col("r"), bounds.min_lat, h, rows).alias("min_lat"), part(F.col("r") + 1, bounds.min_lat, h, rows).alias("max_lat"),
    )


def chunk_of(bounds: Bounds, rows: int = 4, cols: int = 4) -> Column:
    """chunk_id of a point, edges belonging to the upper chunk, so none counts twice."""
    c = _axis(F.col("lon"), bounds.min_lon, bounds.max_lon, (bounds.max_lon - bounds.min_lon) / cols, cols)
    r = _axis(F.col("lat"), bounds.min_lat, bounds.max_lat, (bounds.max_lat - bounds.min_lat) / rows, rows)
    return F.concat(F.lit("chunk_"), r, F.lit("_"), c)
