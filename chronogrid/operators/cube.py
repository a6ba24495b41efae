"""Slices, tag keys, counts, densities, histograms, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import MAX_COMBO, Grid, TimeSlice
from .grid import assign_cells, cell


def time_slices(spark: SparkSession, slices: list[TimeSlice]) -> DataFrame:
    rows = [(i, s.key, s.label, f"{s.start:04d}-01-01", f"{s.end:04d}-12-31", s.start, s.end, s.end - s.start) for i, s in enumerate(slices)]
    return spark.createDataFrame(rows, "ordinal int, slice_key string, label string, start_date string, end_date string, start_year int, end_year int, duration_years int")


def assign_slices(features: DataFrame, slices: list[TimeSlice]) -> DataFrame:
    """One row for each record and slice its period touches (closed on both sides): one scan, a broadcast of the slice list."""
    keys = time_slices(features.sparkSession, slices).select("slice_key", F.col("start_year").alias("_from"), F.col("end_year").alias("_to"))
    return features.join(F.broadcast(keys), (F.col("start_year") <= F.col("_to")) & (F.col("end_year") >= F.col("_from"))).drop("_from", "_to")


def tag_sets(tags: Column, most: int, least: int = 0, containing: list[str] | None = None) -> Column:
    """All combinations of `least` to `most` tags by position, sorted, that hold all of `containing`; the empty one stands for the base.

    Built tag by tag from those that still have room, so n tags give C(n, 0..most) sets and any number of tags will do.
    """
    none = F.array(F.array().cast("array<string>"))
    if most == 0:
        sets = none
    elif most == 1:
        sets = F.concat(none, F.transform(F.sort_array(tags), lambda t: F.array(t)))
    else:
        sets = F.aggregate(F.sort_array(tags), none, lambda acc, t: F.concat(acc, F.transform(F.filter(acc, lambda p: F.size(p) < most), lambda p: F.concat(p, F.array(t)))))
    chosen = F.array(*map(F.lit, containing)) if containing else None
    if least > 0 or containing:
        sets = F.filter(sets, lambda p: (F.size(p) >= least) & (F.forall(chosen, lambda t: F.array_contains(p, t)) if containing else F.lit(True)))
    return sets


KEYS = ["resolution", "slice_key", "record_type", "tag_key", "tag_parts", "row", "col", "cell_idx"]


def _holding(features: DataFrame, least: int, containing: list[str] | None) -> DataFrame:
    """The records that have any of the combinations asked for."""
    if least > 0:
        features = features.filter(F.size("tags") >= least)
    if containing:  # others have no such combination
        features = features.filter(F.forall(F.array(*map(F.lit, containing)), lambda t: F.array_contains("tags", t)))
    return features


def _one(least: int) -> Column:
    """A row for each tag of a list, and a null one for the base unless `least` is 1."""
    return (F.explode("tags") if least else F.explode(F.concat(F.array(F.lit(None).cast("string")), "tags"))).alias("_tag")


def _parts() -> Column:
    """tag_parts of what `_one` makes."""
    return F.when(F.col("_tag").isNull(), F.array().cast("array<string>")).otherwise(F.array("_tag"))


def _counted(features: DataFrame, place: Callable[[DataFrame], DataFrame], keys: list[str], most: int, least: int, containing: list[str] | None) -> DataFrame:
    """Incidences by `keys` (with tag_key and tag_parts) of the rows that `place` makes of records; the key string is made once for each group.

    Records are first counted by their whole tag list, so what follows grows with cells and
    distinct lists, not with records. Combinations come from a dictionary of the distinct
    lists, whose sets are made once each and joined (broadcast where the planner finds them
    small enough).
    """
    plain = [k for k in keys if k not in ("tag_key", "tag_parts")]
    features = _holding(features, least, containing)
    if most == 0:
        return place(features).groupBy(*plain).agg(F.count(F.lit(1)).alias("cnt")).withColumn("tag_parts", F.array().cast("array<string>")).withColumn("tag_key", F.lit("")).select(*keys, "cnt")
    features = features.withColumn("tags", F.sort_array("tags"))
    lists = place(features).groupBy(*plain, "tags").agg(F.count(F.lit(1)).alias("_n"))
    if most == 1 and not containing:
        found = lists.select(*plain, "_n", _one(least)).groupBy(*plain, "_tag").agg(F.sum("_n").alias("cnt")).withColumn("tag_parts", _parts())
    else:
        sets = features.select("tags").distinct().withColumn("_sets", tag_sets(F.col("tags"), most, least, containing))
        # An inner explode would push "has any set" down, and so make the sets of every record.
        found = lists.join(sets, "tags").select(*plain, "_n", F.explode_outer("_sets").alias("tag_parts")).filter("tag_parts is not null").groupBy(*plain, "tag_parts").agg(F.sum("_n").alias("cnt"))
    return found.withColumn("tag_key", F.array_join("tag_parts", "+")).select(*keys, "cnt")


def counts(features: DataFrame, slices: list[TimeSlice], grids: list[Grid], most: int = MAX_COMBO, least: int = 0, containing: list[str] | None = None) -> DataFrame:
    """The sparse cube: incidences by resolution, slice, type, tag key and cell, with map-side combining on coarse grids."""
    if most > 0 and max(g.rows * g.cols for g in grids) > FINE:
        return _counted_by_block(features, slices, grids, most, least, containing)
    return _counted(features, lambda f: assign_slices(assign_cells(f, grids), slices), KEYS, most, least, containing)


#: Cells of a grid from which on map-side combining by cell and tag list leaves about as many rows as it gets.
FINE = 1024
#: About so many blocks of neighbouring cells a grid is dealt out by.
BLOCKS = 600


def _counted_by_block(features: DataFrame, slices: list[TimeSlice], grids: list[Grid], most: int, least: int, containing: list[str] | None) -> DataFrame:
    """What `_counted` returns, for fine grids: each record is shuffled once, as a short row, for all its slices and grids.

    Records go to blocks of neighbouring cells of the finest grid and are counted there by slice, cell
    of each grid and tag list; these counts, which are bounded by cells and lists, go by slice and
    cell, so that combinations are made and summed up where the lists lie, without a shuffle of
    their own. Single tags are counted in the blocks already: over fine grids nearly every record
    has a list of its own in its cell, so that lists would weigh more than the records.
    """
    single = most == 1 and not containing
    fine = max(range(len(grids)), key=lambda i: grids[i].rows * grids[i].cols)
    side = max(1, int((grids[fine].rows * grids[fine].cols / BLOCKS) ** 0.5))
    # A slice's end is at or after a start if and only if it is so for the first of all ends that is; likewise its start.
    first = F.array_min(F.filter(F.array(*[F.lit(s.end) for s in slices]), lambda y: y >= F.col("start_year")))
    last = F.array_max(F.filter(F.array(*[F.lit(s.start) for s in slices]), lambda y: y <= F.col("end_year")))
    ats = [f"_at{i}" for i in range(len(grids))]
    rows = _holding(features, least, containing).select("record_type", "tags" if single else F.sort_array("tags").alias("tags"), first.alias("_first"), last.alias("_last"), *[cell(g)["cell_idx"].alias(a) for g, a in zip(grids, ats, strict=True)])
    rows = rows.filter(F.col("_first").isNotNull() & F.col("_last").isNotNull() & F.coalesce(*ats).isNotNull())
    n = grids[fine].cols
    block = F.floor(F.col(ats[fine]) / (n * side)) * n + F.floor(F.col(ats[fine]) % n / side)
    rows = rows.withColumn("_block", F.coalesce(block, -1 - F.coalesce(*ats).cast("long"))).repartition("_block", "record_type")

    touched = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s.start).alias("start"), F.lit(s.end).alias("end")) for i, s in enumerate(slices)]), lambda s: (F.col("_first") <= s["end"]) & (F.col("_last") >= s["start"]))
    places = F.filter(F.array(*[F.struct(F.lit(i).alias("grid"), F.col(a).alias("cell")) for i, a in enumerate(ats)]), lambda p: p["cell"].isNotNull())
    what, known = ("_tag" if single else "tags"), ["_block", "record_type", "_first", "_last", *ats]
    if single:  # before they are multiplied by slices and grids
        rows = rows.select(*known, _one(least)).groupBy(*known, "_tag").agg(F.count(F.lit(1)).alias("_n"))
    else:
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    each = rows.select("_block", "record_type", what, "_n", F.explode(F.transform(touched, lambda s: s["i"])).alias("_slice"), *ats).select("_block", "record_type", what, "_n", "_slice", F.explode(places).alias("_place"))
    keys = ["_grid", "_cell", "_slice", "record_type"]
    lists = each.select("_block", F.col("_place.grid").alias("_grid"), F.col("_place.cell").alias("_cell"), "_slice", "record_type", what, "_n").groupBy("_block", *keys, what).agg(F.sum("_n").alias("_n"))
    lists = lists.repartition(*keys).groupBy(*keys, what).agg(F.sum("_n").alias("_n"))
    if single:
        found = lists.select(*keys, F.col("_n").alias("cnt"), _parts().alias("tag_parts"))
    else:
        # Outer here too, so that no record's sets are made below.
        found = lists.select(*keys, "_n", F.explode_outer(tag_sets(F.col("tags"), most, least, containing)).alias("tag_parts")).filter("tag_parts is not null").groupBy(*keys, "tag_parts").agg(F.sum("_n").alias("cnt"))

    of = lambda values, i: F.get(F.array(*map(F.lit, values)), F.col(i))
    named = {"resolution": of([g.name for g in grids], "_grid"), "slice_key": of([s.key for s in slices], "_slice"), "cell_idx": F.col("_cell"), "tag_key": F.array_join("tag_parts", "+"), "_cols": of([g.cols for g in grids], "_grid")}
    return found.withColumns(named).withColumns({"row": F.floor(F.col("_cell") / F.col("_cols")).cast("int"), "col": F.col("_cell") % F.col("_cols")}).select(*KEYS, "cnt")


def incidences(features: DataFrame, slices: list[TimeSlice], grid: Grid, most: int = MAX_COMBO, least: int = 0, containing: list[str] | None = None) -> DataFrame:
    """(record_type, tag_key, tag_parts, slice_key, cnt): what a histogram holds, without cells: in-grid records by slice."""
    place = lambda f: assign_slices(assign_cells(f, [grid]).select("record_type", "tags", "start_year", "end_year"), slices)
    return _counted(features, place, ["record_type", "tag_key", "tag_parts", "slice_key"], most, least, containing)


def density(cells: DataFrame, by: list[str]) -> DataFrame:
    """ln(count + 1) / ln(greatest count + 1) within each heatmap, 0 for empty cells."""
    top = F.max("cnt").over(W.partitionBy(*by))
    return cells.withColumn("density", F.when((F.col("cnt") > 0) & (top > 0), F.log(F.col("cnt") + F.lit(1.0)) / F.log(top + F.lit(1.0))).otherwise(F.lit(0.0)))


def densify(cells: DataFrame, blueprint: DataFrame, keys: DataFrame) -> DataFrame:
    """Zero-filled cells of the heatmaps in `keys` (a few of them: never the whole cube)."""
    return keys.crossJoin(blueprint.select("row", "col", "cell_idx")).join(cells, [*keys.columns, "row", "col", "cell_idx"], "left").fillna(0, ["cnt"])


def histogram(cube: DataFrame, slices: list[TimeSlice], keys: DataFrame, primary: str | None = None) -> DataFrame:
    """(keys..., slice_key, cnt): sums over cells of the primary resolution, zero where absent; `cube` may be incidences."""
    names = keys.columns
    rows = cube.filter(F.col("resolution") == primary) if primary else cube
    sums = rows.groupBy(*names, "slice_key").agg(F.sum("cnt").alias("cnt"))
    every = keys.crossJoin(F.broadcast(time_slices(cube.sparkSession, sorted(slices, key=lambda x: x.start)).select("slice_key")))
    return every.join(sums, [*names, "slice_key"], "left").fillna(0, ["cnt"])


def empty_histograms(spark: SparkSession, types: list[str], tags: list[str], slices: list[TimeSlice], first: int = 5) -> DataFrame:
    """Zero bins of every type's base ('') and first tags, without data."""
    rows = [(t, k, s.key, 0) for t in types for k in ["", *tags[:first]] for s in sorted(slices, key=lambda x: x.start)]
    return spark.createDataFrame(rows, "record_type string, tag_key string, slice_key string, cnt long")


def statistics(base: DataFrame, slices: list[TimeSlice], grids: list[Grid]) -> DataFrame:
    """(record_type, features, n_slices, n_cells, n_resolutions) of each type and of the total, from the base counts of one resolution."""
    per = base.groupBy("record_type").agg(F.sum("cnt").alias("features"))
    total = base.agg(F.sum("cnt").alias("features")).withColumn("record_type", F.lit("total"))
    return per.unionByName(total).withColumns({"n_slices": F.lit(len(slices)), "n_cells": F.lit(grids[0].rows * grids[0].cols), "n_resolutions": F.lit(len(grids))})


def summary(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg(F.max("cnt").alias("max_count"), F.sum("cnt").alias("total_features"), F.count(F.lit(1)).alias("n_bins"))


def first_tags(features: DataFrame, n: int) -> DataFrame:
    """The n tags of a histogram: most frequent first, then by name (a data set has no order of discovery)."""
    return features.select(F.explode("tags").alias("tag_key")).groupBy("tag_key").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "tag_key").limit(n).select("tag_key")


def top_combinations(cube: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """The n most frequent combinations, of all or of each group in `by` (slice, resolution)."""
    if by:
        found = cube.filter(F.size("tag_parts") > 1).groupBy(*by, "tag_key").agg(F.sum("cnt").alias("cnt"))
        return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("cnt"), "tag_key"))).filter(F.col("rank") <= n)
    combos = cube.filter(F.size("tag_parts") > 1).groupBy("tag_key").agg(F.sum("cnt").alias("cnt"))
    return combos.orderBy(F.desc("cnt"), "tag_key").limit(n)


def bar_heights(bins: DataFrame, by: list[str], high: float = 15.0, least: float = 1.0) -> DataFrame:
    top = F.max("cnt").over(W.partitionBy(*by)) if by else F.max("cnt").over(W.partitionBy(F.lit(1)))
    return bins.withColumn("height", F.when((F.col("cnt") > 0) & (top > 0), F.greatest(F.log(F.col("cnt") + F.lit(1.0)) / F.log(top + F.lit(1.0)) * F.lit(high), F.lit(least))).otherwise(F.lit(0.0)))
