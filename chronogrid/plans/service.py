"""Questions to the cubes: heatmaps, histograms, tags, validation, drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import Grid
from ..operators import cube as C
from ..operators import merge as M
from ..operators.grid import cell


class UnknownRecordType(ValueError):
    pass


def params(text: str | None) -> list[str]:
    """Comma-separated request parameter: trimmed, empty parts dropped."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def known_types(spark_types: DataFrame) -> list[str]:
    return [r[0] for r in spark_types.select("record_type").distinct().orderBy("record_type").collect()]


def check_types(cube: DataFrame, types: list[str] | None, known: list[str] | None = None) -> list[str]:
    """The wanted types (all when none are); unknown ones are an error. `known`: all types, from the metadata, else asked of the cube."""
    have = known_types(cube) if known is None else known
    missing = [t for t in types or [] if t not in have]
    if missing:
        raise UnknownRecordType(f"RecordTypes \"{', '.join(missing)}\" not found; available: {', '.join(have)}")
    return types or have


def usable_types(asked: list[str], have: list[str]) -> tuple[list[str], list[str]]:
    """(types to use, unknown ones) of a request: the known among those asked for, all where none is known."""
    return [t for t in asked if t in have] or list(have), [t for t in asked if t not in have]


def usable_tags(asked: list[str], vocabulary: DataFrame) -> DataFrame:
    """(tag, known) of the tags asked for."""
    spark = vocabulary.sparkSession
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "_i int, tag string")
    have = vocabulary.filter("kind = 'tag'").select(F.col("name").alias("tag"), F.lit(True).alias("_have")).distinct()
    return rows.join(have, "tag", "left").select("tag", F.coalesce("_have", F.lit(False)).alias("known"))


def source_params(asked: dict) -> dict:
    """Arguments of `drilldown` from a request's names: recordtype, tag_operator (OR unless said), empty lists dropped."""
    names = {"recordTypes": "types", "recordtype": "types", "tagOperator": "operator", "tag_operator": "operator"}
    out = {names.get(k, k): v for k, v in asked.items() if v not in (None, [], "")}
    return {"operator": "OR"} | out


def combo_key(tags: list[str]) -> str:
    return "+".join(sorted(tags))


def heatmaps(cube: DataFrame, resolution: str, types: list[str] | None = None, tags: list[str] | None = None, operator: str = "AND", merged: bool | None = None, or_mode: str = "sum", placed: DataFrame | None = None, blueprint: DataFrame | None = None, known: list[str] | None = None) -> DataFrame:
    """Counts and densities of one resolution.

    No tags: the base; one tag: its heatmap; AND: the stored combination; OR: sum over tags, or
    with or_mode 'union' each record once (from `placed`). Types are merged when no tags are
    asked for, unless `merged` says otherwise. Unknown types are an error. With a `blueprint`
    every slice and type that has any record has all its cells, zeros where a tag or combination
    is missing; without it only cells with records.
    """
    types = check_types(cube, types, known)
    whole = cube.filter((F.col("resolution") == resolution) & F.col("record_type").isin(types))
    tags = tags or []
    if operator == "OR" and len(tags) > 1:
        if or_mode == "union":
            out = M.or_union(placed.filter((F.col("resolution") == resolution) & F.col("record_type").isin(types)), tags)
        else:
            out = M.or_sum(whole, tags)
        out = out.withColumn("tag_key", F.lit(combo_key(tags)))
    else:
        out = whole.filter((F.col("tag_key") == combo_key(tags)) & (F.size("tag_parts") == len(tags))).drop("tag_parts")
    if blueprint is not None:
        keys = whole.filter("tag_key = ''").select("resolution", "slice_key", "record_type").distinct().withColumn("tag_key", F.lit(combo_key(tags)))
        out = C.densify(out.select(*keys.columns, "row", "col", "cell_idx", "cnt"), blueprint, keys)
    if merged if merged is not None else not tags:
        out = M.merge_types(out, types)
    return C.density(out.select("resolution", "slice_key", "record_type", "tag_key", "row", "col", "cell_idx", "cnt"), ["resolution", "slice_key", "record_type", "tag_key"])


def histograms(bins: DataFrame, slices: list, types: list[str] | None = None, tags: list[str] | None = None, operator: str = "AND", or_mode: str = "sum", placed: DataFrame | None = None, known: list[str] | None = None) -> DataFrame:
    """(record_type, tag_key, slice_key, cnt): bins of every wanted type, zeros where the tag or combination is missing.

    No tags: the base; one: its own; AND: the stored combination; OR: the sum over tags, with
    or_mode 'union' each record once (from `placed`), with 'reference' the base once for each
    tag. Unknown types are an error.
    """
    spark = bins.sparkSession
    types = check_types(bins, types, known)
    tags = tags or []
    some = bins.filter(F.col("record_type").isin(types))
    if operator == "OR" and len(tags) > 1:
        if or_mode == "union":
            found = M.or_union_bins(placed.filter(F.col("record_type").isin(types)), tags)
        elif or_mode == "reference":
            found = some.filter("tag_key = ''").withColumn("cnt", F.col("cnt") * len(tags))
        else:
            found = some.filter(F.col("tag_key").isin(tags) & (F.size("tag_parts") == 1))
    else:
        found = some.filter((F.col("tag_key") == combo_key(tags)) & (F.size("tag_parts") == len(tags)))
    keys = spark.createDataFrame([(t,) for t in types], "record_type string")
    return C.histogram(found, slices, keys).withColumn("tag_key", F.lit(combo_key(tags))).select("record_type", "tag_key", "slice_key", "cnt")


def by_name(tags: DataFrame, name: str = "tag") -> DataFrame:
    """Rows in the locale's order of a name, case after letters, with their rank."""
    return tags.withColumn("rank", F.row_number().over(W.orderBy(F.collate(name, "UNICODE"), name))).orderBy("rank")


def tag_totals(bins: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(tag, total, record_types) of single tags, sums over slices, none without records; `bins` are histograms (or counts of one resolution)."""
    rows = bins.filter(F.size("tag_parts") == 1)
    rows = rows.filter(F.col("record_type").isin(types)) if types else rows
    return rows.groupBy(F.col("tag_key").alias("tag")).agg(F.sum("cnt").alias("total"), F.array_join(F.array_sort(F.collect_set("record_type")), ",").alias("record_types")).filter("total > 0")


def next_tags(bins: DataFrame, selected: list[str], types: list[str] | None = None) -> DataFrame:
    """Tags that occur together with all selected ones, with their totals."""
    if not selected:
        return tag_totals(bins, types)
    rows = bins.filter(F.size("tag_parts") == len(selected) + 1)
    rows = rows.filter(F.col("record_type").isin(types)) if types else rows
    chosen = F.array(*map(F.lit, selected))
    rows = rows.filter(F.forall(chosen, lambda t: F.array_contains("tag_parts", t)))
    extra = rows.withColumn("tag", F.explode(F.array_except("tag_parts", chosen)))
    return extra.groupBy("tag").agg(F.sum("cnt").alias("total"), F.array_join(F.array_sort(F.collect_set("record_type")), ",").alias("record_types")).filter("total > 0")


def validate_combinations(cube: DataFrame, combos: DataFrame) -> DataFrame:
    """(combo_key, valid): up to one tag is always valid, more are when any type has them stored; combos has combo_key, n_tags."""
    have = cube.filter(F.size("tag_parts") > 1).select(F.col("tag_key").alias("combo_key"), F.lit(True).alias("_have")).distinct()
    return combos.join(have, "combo_key", "left").select("combo_key", ((F.col("n_tags") <= 1) | F.coalesce("_have", F.lit(False))).alias("valid"))


def drilldown(features: DataFrame, grid: Grid, row: int, col: int, start: int, end: int, types: list[str] | None = None, tags: list[str] | None = None, operator: str = "OR", exact: bool = True) -> DataFrame:
    """Records of one cell and period; exact: by the cube's cell, else by the closed box of the cell's bounds."""
    b = grid.bounds
    x, y = b.min_lon + col * grid.cell_width, b.min_lat + row * grid.cell_height
    x2 = b.max_lon if col == grid.cols - 1 else b.min_lon + (col + 1) * grid.cell_width
    y2 = b.max_lat if row == grid.rows - 1 else b.min_lat + (row + 1) * grid.cell_height
    out = features.filter(F.col("lon").between(x - 1e-9, x2 + 1e-9) & F.col("lat").between(y - 1e-9, y2 + 1e-9)) if exact else features.filter(F.col("lon").between(x, x2) & F.col("lat").between(y, y2))
    if exact:
        out = out.withColumn("_cell", cell(grid)).filter((F.col("_cell.row") == row) & (F.col("_cell.col") == col)).drop("_cell")
    out = out.filter((F.col("start_year") <= end) & (F.col("end_year") >= start))
    if types:
        out = out.filter(F.col("record_type").isin(types))
    if tags:
        wanted = F.array(*map(F.lit, tags))
        out = out.filter(F.arrays_overlap("tags", wanted) if operator == "OR" else F.forall(wanted, lambda t: F.array_contains("tags", t)))
    return out


def page(rows: DataFrame, order: list[str], number: int, size: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def validate_periods(asked: DataFrame, slices: DataFrame, longest: int = 50) -> DataFrame:
    """(period, verdict), checked in the order format, chronology, duration, availability."""
    parts = F.split("period", "_")
    start, end = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    have = slices.select(F.col("slice_key").alias("period"), F.lit(True).alias("_have"))
    verdict = F.when(~F.col("period").rlike(r"^\d{4}_\d{4}$"), "format").when(start >= end, "chronology").when(end - start > longest, "duration").when(F.col("_have").isNull(), "unavailable").otherwise("valid")
    return asked.join(F.broadcast(have), "period", "left").select("period", verdict.alias("verdict"))


def last_period(slices: DataFrame) -> DataFrame:
    """The period shown where the one asked for can't be: the last."""
    return slices.agg(F.max_by("slice_key", "start_year").alias("period"))


def chosen_periods(asked: DataFrame, slices: DataFrame, longest: int = 50) -> DataFrame:
    """(period, verdict, shown): the period itself where valid, else the last one."""
    return validate_periods(asked, slices, longest).crossJoin(F.broadcast(last_period(slices).withColumnRenamed("period", "_last"))).select("period", "verdict", F.when(F.col("verdict") == "valid", F.col("period")).otherwise(F.col("_last")).alias("shown"))


def validate_cells(asked: DataFrame, grid: Grid, blueprint: DataFrame | None = None) -> DataFrame:
    """(cell_id, verdict): format, then the grid's size, then, with a blueprint, whether it holds the cell."""
    parts = F.split("cell_id", "_")
    row, col = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    have = asked.withColumn("_have", F.lit(True)) if blueprint is None else asked.join(F.broadcast(blueprint.select("cell_id", F.lit(True).alias("_have"))), "cell_id", "left")
    verdict = F.when(~F.col("cell_id").rlike(r"^\d+_\d+$"), "format").when((row >= grid.rows) | (col >= grid.cols) | row.isNull() | col.isNull(), "outside").when(F.col("_have").isNull(), "unknown").otherwise("valid")
    return have.select("cell_id", verdict.alias("verdict"))
