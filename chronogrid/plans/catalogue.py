"""The queries of the index over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.config import GRIDS, HISTOGRAM_TAGS, MAX_COMBO, POINT, PRIMARY, RAW_BOUNDS, Grid, TimeSlice, overall
from ..operators import cube as C
from ..operators import grid as G
from ..operators import merge as M
from ..sources import features as S
from ..sources import store
from . import service as V

SLICES = [TimeSlice(y, y + 1) for y in range(1995, 2001)]
COARSE = GRIDS[1]
_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder where `write` has put what it makes of a table folder, once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{store.shared_dir(spark)}/chronogrid/{uuid.uuid4().hex}"
        with store.shuffles_freed(spark):
            write(path)
        _written[key] = path
    return _written[key]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records, parsed once for each table folder and written as Parquet, so that lon and lat are pruned by statistics.

    Large tables are parsed in several passes, each of which frees what it has shuffled before the next one.
    """

    def write(path: str) -> None:
        passes = S.fixture_passes(spark, sf_dir)
        for at in range(passes):
            S.canonical(S.fixture_raw(spark, sf_dir, at, passes)).write.mode("append").option("compression", "zstd").parquet(path)

    return spark.read.schema(RECORDS).parquet(_once(spark, sf_dir, "records", write))


RECORDS = "record_type string, lon double, lat double, tags array<string>, start_year int, end_year int, title string, url string, dataset string, valid boolean"


def stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The cube of all three grids with combinations of up to four tags, built once for each table folder and served from Parquet."""
    return store.load(spark, _once(spark, sf_dir, "cube", lambda path: store.build(features(spark, sf_dir), SLICES, GRIDS, path)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.valid_features(parsed(spark, sf_dir))


def placed(spark: SparkSession, sf_dir: str, grids: list[Grid]) -> DataFrame:
    return C.assign_slices(G.assign_cells(features(spark, sf_dir), grids), SLICES)


def cube(spark: SparkSession, sf_dir: str, grids: list[Grid], most: int, least: int = 0, containing: list[str] | None = None) -> DataFrame:
    return C.counts(features(spark, sf_dir), SLICES, grids, most, least, containing)


def known(spark: SparkSession, sf_dir: str) -> list[str]:
    """All record types, as the metadata of a publication has them; asked once for each table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "types")
    if key not in _written:
        _written[key] = "\n".join(V.known_types(features(spark, sf_dir)))
    return _written[key].split("\n")


def bins(spark: SparkSession, sf_dir: str, most: int, least: int = 0) -> DataFrame:
    return C.incidences(features(spark, sf_dir), SLICES, PRIMARY, most, least)


def _q(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CELLS = ["slice_key", "record_type", "row", "col", "cell_idx"]


def _r(c: str):
    return F.round(c, 6).alias(c)


@_q("features_canonical")
def _(s, d):
    return features(s, d).select("record_type", "lon", "lat", F.array_join("tags", "|").alias("tags"), "start_year", "end_year")


@_q("ingest_stats")
def _(s, d):
    return S.ingest_stats(parsed(s, d))


@_q("vocabulary_types")
def _(s, d):
    return S.vocabulary(features(s, d)).filter("kind = 'record_type'").select("name")


@_q("vocabulary_tags")
def _(s, d):
    return S.vocabulary(features(s, d)).filter("kind = 'tag'").select("name")


def _blueprint(s, grid):
    return G.blueprint(s, grid).select("cell_id", "row", "col", "cell_idx", *map(_r, ("min_lon", "max_lon", "min_lat", "max_lat")))


@_q("blueprint_75")
def _(s, d):
    return _blueprint(s, PRIMARY)


@_q("blueprint_8")
def _(s, d):
    return _blueprint(s, COARSE)


@_q("cell_polygons")
def _(s, d):
    ring = G.polygons(G.blueprint(s, COARSE)).select("cell_id", F.posexplode("ring").alias("corner", "p"))
    return ring.select("cell_id", "corner", F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"))


@_q("cell_assignment")
def _(s, d):
    return G.assign_cells(features(s, d), [PRIMARY]).groupBy("row", "col", "cell_idx").agg(F.count(F.lit(1)).alias("n"))


@_q("spatial_chunks")
def _(s, d):
    return G.chunks(s, RAW_BOUNDS).select("chunk_id", "r", "c", *map(_r, ("min_lon", "max_lon", "min_lat", "max_lat")))


@_q("chunk_counts")
def _(s, d):
    return features(s, d).withColumn("chunk_id", G.chunk_of(RAW_BOUNDS)).filter("chunk_id is not null").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


@_q("time_slices")
def _(s, d):
    return C.time_slices(s, SLICES).select("slice_key", "label", "start_date", "end_date", "start_year", "end_year", "duration_years")


@_q("slice_assignment")
def _(s, d):
    return C.assign_slices(features(s, d), SLICES).groupBy("slice_key", "record_type").agg(F.count(F.lit(1)).alias("n"))


@_q("heatmap_base_counts")
def _(s, d):
    return cube(s, d, [PRIMARY], 0).select(*CELLS, "cnt")


@_q("heatmap_multires")
def _(s, d):
    return cube(s, d, GRIDS, 0).select("resolution", *CELLS, "cnt")


@_q("heatmap_density")
def _(s, d):
    return C.density(cube(s, d, [PRIMARY], 0), ["slice_key", "record_type"]).select(*CELLS, "cnt", _r("density"))


@_q("heatmap_dense_cells")
def _(s, d):
    base = cube(s, d, [COARSE], 0).select(*CELLS, "cnt")
    keys = base.select("slice_key", "record_type").distinct()
    return C.density(C.densify(base, G.blueprint(s, COARSE), keys), ["slice_key", "record_type"]).select(*CELLS, "cnt", _r("density"))


@_q("heatmap_tag_counts")
def _(s, d):
    return cube(s, d, [COARSE], 1, 1).select(*CELLS, "tag_key", "cnt")


@_q("heatmap_combo_counts")
def _(s, d):
    return cube(s, d, [COARSE], 4, 2).select(*CELLS, "tag_key", "cnt")


@_q("heatmap_tag_counts_multires")
def _(s, d):
    return cube(s, d, GRIDS, 1, 1).select("resolution", *CELLS, "tag_key", "cnt")


@_q("heatmap_combo_counts_multires")
def _(s, d):
    return cube(s, d, GRIDS, 4, 2).select("resolution", *CELLS, "tag_key", "cnt")


@_q("combo_top10")
def _(s, d):
    return C.top_combinations(bins(s, d, 4, 2))


def _histogram(s, d, most, least=0):
    c = bins(s, d, most, least)
    return C.histogram(c, SLICES, c.select("record_type", "tag_key").distinct())


@_q("histogram_base")
def _(s, d):
    return _histogram(s, d, 0).drop("tag_key")


def _tag_histogram(s, d, n):
    tags = C.first_tags(features(s, d), n)
    c = bins(s, d, 1)
    return C.histogram(c.filter("tag_key <> ''"), SLICES, c.filter("tag_key = ''").select("record_type").distinct().crossJoin(F.broadcast(tags)))


@_q("histogram_tags")
def _(s, d):
    return _tag_histogram(s, d, HISTOGRAM_TAGS)


@_q("histogram_combos")
def _(s, d):
    return _histogram(s, d, MAX_COMBO, 2)


@_q("histogram_summary")
def _(s, d):
    return C.summary(_histogram(s, d, 1), ["record_type", "tag_key"])


@_q("visualization_stats")
def _(s, d):
    return C.statistics(cube(s, d, [PRIMARY], 0), SLICES, GRIDS)


def _heat(s, d, most, **kw):
    """A heatmap of the coarse grid; of AND and single tags only what holds them is counted."""
    kw.setdefault("merged", False)
    p = placed(s, d, [COARSE]) if kw.get("or_mode") == "union" else None
    c = cube(s, d, [COARSE], most)
    return V.heatmaps(c, COARSE.name, placed=p, known=known(s, d), **kw).select(*CELLS, "tag_key", "cnt", _r("density"))


@_q("heatmap_single_tag")
def _(s, d):
    return _heat(s, d, 1, tags=["BUILDING"])


@_q("heatmap_and")
def _(s, d):
    return _heat(s, d, 2, tags=["BUILDING", "1-URGENT"])


@_q("heatmap_missing_tag")
def _(s, d):
    return _heat(s, d, 1, tags=["NOTHING"], blueprint=G.blueprint(s, COARSE))


@_q("heatmap_missing_combo")
def _(s, d):
    return _heat(s, d, 2, tags=["BUILDING", "MACHINERY"], blueprint=G.blueprint(s, COARSE))


@_q("heatmap_or_sum")
def _(s, d):
    return _heat(s, d, 1, tags=["BUILDING", "1-URGENT"], operator="OR")


@_q("heatmap_or_union")
def _(s, d):
    return _heat(s, d, 0, tags=["BUILDING", "1-URGENT"], operator="OR", or_mode="union")


@_q("heatmap_merged_types")
def _(s, d):
    return _heat(s, d, 0, types=["image", "text"], merged=True)


@_q("heatmap_auto_merge")
def _(s, d):
    return V.heatmaps(cube(s, d, [COARSE], 0), COARSE.name, known=known(s, d)).select(*CELLS, "tag_key", "cnt", _r("density"))


@_q("heatmap_merge_none")
def _(s, d):
    return M.merge_heatmaps([], G.blueprint(s, COARSE))


@_q("heatmap_merge_two")
def _(s, d):
    base = cube(s, d, [COARSE], 0)
    return M.merge_heatmaps([base.filter("record_type = 'image' and slice_key = '1995_1996'"), base.filter("record_type = 'text' and slice_key = '1995_1996'")], G.blueprint(s, COARSE))


def _bars(s, d, most, **kw):
    p = C.assign_slices(G.assign_cells(features(s, d), [PRIMARY]), SLICES) if kw.get("or_mode") == "union" else None
    return V.histograms(bins(s, d, most), SLICES, placed=p, known=known(s, d), **kw)


@_q("histogram_single_tag")
def _(s, d):
    return _bars(s, d, 1, tags=["BUILDING"])


@_q("histogram_and")
def _(s, d):
    return _bars(s, d, 2, tags=["BUILDING", "1-URGENT"])


@_q("histogram_missing_tag")
def _(s, d):
    return _bars(s, d, 1, tags=["NOTHING"])


@_q("histogram_or_sum")
def _(s, d):
    return _bars(s, d, 1, tags=["BUILDING", "1-URGENT"], operator="OR").drop("tag_key")


@_q("histogram_or_union")
def _(s, d):
    return _bars(s, d, 1, tags=["BUILDING", "1-URGENT"], operator="OR", or_mode="union")


@_q("histogram_or_reference")
def _(s, d):
    return _bars(s, d, 0, tags=["BUILDING", "1-URGENT"], operator="OR", or_mode="reference").drop("tag_key")


@_q("histogram_empty")
def _(s, d):
    return C.empty_histograms(s, ["image", "text"], ["BUILDING", "1-URGENT"], SLICES)


@_q("histogram_merged_summary")
def _(s, d):
    return M.merged_summary(_histogram(s, d, 0), C.time_slices(s, SLICES))


@_q("histogram_merged_types")
def _(s, d):
    return M.merge_bins(_histogram(s, d, 0), [])


@_q("first_wins_merge")
def _(s, d):
    a = cube(s, d, [COARSE], 0).select(*CELLS, "cnt")
    return M.first_wins([a.filter("record_type = 'image'"), a.withColumn("cnt", F.col("cnt") + 1000)], CELLS)


@_q("available_tags")
def _(s, d):
    return V.tag_totals(bins(s, d, 1, 1))


@_q("available_tags_ranked")
def _(s, d):
    return V.by_name(V.tag_totals(bins(s, d, 1, 1)))


@_q("next_tags_none")
def _(s, d):
    return V.next_tags(bins(s, d, 1, 1), [], ["image"])


def _next(s, d, chosen):
    n = len(chosen) + 1
    return V.next_tags(C.incidences(features(s, d), SLICES, PRIMARY, n, n, chosen), chosen)


@_q("next_tags_one")
def _(s, d):
    return _next(s, d, ["BUILDING"])


@_q("next_tags_two")
def _(s, d):
    return _next(s, d, ["BUILDING", "1-URGENT"])


@_q("validate_combo")
def _(s, d):
    asked = s.createDataFrame([(V.combo_key(c), len(c)) for c in (["BUILDING"], ["1-URGENT", "BUILDING"], ["BUILDING", "MACHINERY"], ["nothing"])], "combo_key string, n_tags int")
    return V.validate_combinations(bins(s, d, 2, 2), asked)


@_q("known_tags")
def _(s, d):
    return V.usable_tags(["BUILDING", "NOTHING", "1-URGENT"], S.vocabulary(features(s, d)))


@_q("vocabulary_per_slice")
def _(s, d):
    return S.vocabulary_by_slice(placed(s, d, [PRIMARY]))


@_q("top_combos_by_slice")
def _(s, d):
    return C.top_combinations(bins(s, d, 4, 2), 10, ["slice_key"])


@_q("scan_box")
def _(s, d):
    out = S.scan(features(s, d), (4.85, 4.9, 52.3, 52.4), 1996, 1997)
    return out.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


@_q("scan_capped_chunks")
def _(s, d):
    """The opt-in cap of the chunk scan: at most 100 records of each chunk."""
    inside = features(s, d).withColumn("chunk_id", G.chunk_of(RAW_BOUNDS)).filter("chunk_id is not null")
    return S.scan(inside, max_rows_per_chunk=100, chunk=F.col("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


@_q("overall_range")
def _(s, d):
    span = overall(SLICES)
    return s.createDataFrame([(span.key, span.label, span.start, span.end)], "slice_key string, label string, start_year int, end_year int")


@_q("period_labels")
def _(s, d):
    return C.time_slices(s, [*SLICES, TimeSlice(2001, 2001)]).select("slice_key", X.period_label(F.col("start_year"), F.col("end_year")).alias("shown"))


@_q("content_types")
def _(s, d):
    t = S.vocabulary(features(s, d)).filter("kind = 'record_type'").select("name")
    return t.select("name", X.translated(F.col("name"), X.CONTENT_TYPES).alias("shown"))


@_q("type_label")
def _(s, d):
    every = S.vocabulary(features(s, d)).filter("kind = 'record_type'").agg(F.array_sort(F.collect_set("name")).alias("every"))
    asked = s.createDataFrame([(1, ["image"]), (2, ["image", "person", "text"])], "n int, chosen array<string>")
    return asked.crossJoin(F.broadcast(every)).select("n", X.set_label(F.col("chosen"), F.col("every")).alias("label"))


@_q("picked_pairs")
def _(s, d):
    m = F.create_map(F.lit("type"), "record_type", F.lit("title"), "title", F.lit("url"), "url")
    picked = features(s, d).filter("title = 'item 1'").select("url", F.explode(X.pairs(m, ["type", "title"])).alias("p"))
    return picked.select("url", "p.key", "p.value")


@_q("stored_heatmap_75")
def _(s, d):
    return V.heatmaps(stored(s, d)["counts"], PRIMARY.name, ["image", "text"], ["BUILDING"], merged=False, known=known(s, d)).select(*CELLS, "tag_key", "cnt", _r("density"))


@_q("stored_histogram_combos")
def _(s, d):
    return stored(s, d)["histograms"].filter(F.size("tag_parts") > 1).select("record_type", "tag_key", "slice_key", "cnt")


@_q("stored_stats")
def _(s, d):
    return C.statistics(stored(s, d)["histograms"].filter("tag_key = ''"), SLICES, GRIDS)


@_q("stored_tags")
def _(s, d):
    return V.tag_totals(stored(s, d)["histograms"])


@_q("stored_next_tags")
def _(s, d):
    return V.next_tags(stored(s, d)["histograms"], ["BUILDING", "1-URGENT"])


@_q("stored_vocabulary")
def _(s, d):
    return stored(s, d)["vocabulary_by_slice"]


@_q("stored_metadata")
def _(s, d):
    m = stored(s, d)["metadata"]
    return m.select("total_features", F.array_join("record_types", ",").alias("record_types"), F.size("tags").cast("long").alias("n_tags"), F.array_join("resolutions", ",").alias("resolutions"), F.size("slices").cast("long").alias("n_slices"), "start_year", "end_year", "n_cells")


def _drill(s, d):
    return V.drilldown(features(s, d), COARSE, 3, 4, 1996, 1998, ["image", "text"], ["BUILDING"])


@_q("drilldown_cell")
def _(s, d):
    return _drill(s, d).select("record_type", "title", "url", "start_year", "end_year", F.array_join("tags", "|").alias("tags"))


@_q("drilldown_total")
def _(s, d):
    return _drill(s, d).agg(F.count(F.lit(1)).alias("total"))


@_q("drilldown_page")
def _(s, d):
    order = ["url", "title", "record_type", "start_year", "end_year", "lon", "lat"]
    return V.page(_drill(s, d), order, 2, 20).select("url", "title", "record_type", "start_year", "end_year")


@_q("active_cells")
def _(s, d):
    return _heat(s, d, 0, types=["image"]).filter("cnt > 0").select("slice_key", "cell_idx", "density")


@_q("period_validation")
def _(s, d):
    asked = s.createDataFrame([(p,) for p in ("1995_1996", "1950", "2000_1950", "1900_2000", "1234_1250")], "period string")
    return V.validate_periods(asked, C.time_slices(s, SLICES))


@_q("cell_validation")
def _(s, d):
    return V.validate_cells(s.createDataFrame([(c,) for c in ("0_0", "7_7", "8_0", "x_1", "1_2_3")], "cell_id string"), COARSE, G.blueprint(s, COARSE))


@_q("bar_heights")
def _(s, d):
    return C.bar_heights(_histogram(s, d, 0), ["record_type"]).select("record_type", "slice_key", "cnt", _r("height"))


@_q("dataset_titles")
def _(s, d):
    return parsed(s, d).select("dataset").distinct().select("dataset", X.dataset_title(F.col("dataset")).alias("title"), X.prettify(F.col("dataset")).alias("pretty"))


@_q("text_preview")
def _(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.preview(F.col("text")).alias("preview"))


@_q("tag_overflow")
def _(s, d):
    return features(s, d).groupBy(F.array_join(X.shown_tags(F.col("tags")), "|").alias("shown"), X.more_tags(F.col("tags")).alias("more")).agg(F.count(F.lit(1)).alias("n"))


@_q("check_heatmap_histogram")
def _(s, d):
    c = cube(s, d, [PRIMARY], 1)
    heat = c.groupBy("record_type", "tag_key", "slice_key").agg(F.sum("cnt").alias("heat"))
    both = _histogram(s, d, 1).join(heat, ["record_type", "tag_key", "slice_key"], "left").fillna(0, ["heat"])
    return both.agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("heat") != F.col("cnt")).alias("violations"))


@_q("check_cross_resolution")
def _(s, d):
    sums = cube(s, d, GRIDS, 0).groupBy("slice_key", "record_type", "resolution").agg(F.sum("cnt").alias("n"))
    return sums.groupBy("slice_key", "record_type").agg(F.countDistinct("n").alias("k")).agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("k") > 1).alias("violations"))


@_q("check_combo_le_single")
def _(s, d):
    t = bins(s, d, 2, 1).groupBy("tag_key", "tag_parts").agg(F.sum("cnt").alias("n"))
    combos = t.filter(F.size("tag_parts") > 1).select("tag_key", F.col("n").alias("both"), F.explode("tag_parts").alias("one"))
    pairs = combos.join(t.filter(F.size("tag_parts") == 1).select(F.col("tag_key").alias("one"), "n"), "one")
    return pairs.agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("both") > F.col("n")).alias("violations"))


@_q("stream_counts")
def _(s, d):
    from ..streaming import counts as T

    root = f"{store.shared_dir(s)}/chronogrid/{uuid.uuid4().hex}"
    features(s, d).repartition(6).write.parquet(f"{root}/in")
    stream = s.readStream.schema(features(s, d).schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    T.start(stream, SLICES, [PRIMARY], root).awaitTermination()
    return T.totals(s, root).select(*CELLS, "cnt")


# ---- SQL for the same tables, independent of the DataFrame code above ----


def _axis_sql(v: str, low: float, high: float, size: float, n: int) -> str:
    at = f"floor(({v} - {low!r}::double) / {size!r}::double)::integer"
    at = f"(case when {v} = {high!r}::double and {at} >= {n} then {n - 1} else {at} end)"
    return f"(case when {at} between 0 and {n - 1} then {at} end)"


def _cell_sql(g: Grid) -> str:
    b = g.bounds
    return f"{_axis_sql('lat', b.min_lat, b.max_lat, g.cell_height, g.rows)} as row, {_axis_sql('lon', b.min_lon, b.max_lon, g.cell_width, g.cols)} as col"


_RAW = f"""raw as ({S.FIXTURE.format(string="varchar", open="[", close="]")}),
par as (select *, try_cast(nullif(regexp_extract(geom, '{POINT}', 1), '') as double) as lon, try_cast(nullif(regexp_extract(geom, '{POINT}', 2), '') as double) as lat from raw),
f as (select * replace (coalesce(tags, []) as tags) from par where coalesce(record_type, '') <> '' and lon is not null and lat is not null),
sl(slice_key, ss, se) as (values {", ".join(f"('{s.key}', {s.start}, {s.end})" for s in SLICES)}),
inc as (select f.*, slice_key from f join sl on start_year <= se and end_year >= ss)"""


def _placed_sql(g: Grid, n: str = "p") -> str:
    return f"{n} as (select *, (row * {g.cols} + col)::integer as cell_idx from (select inc.*, {_cell_sql(g)} from inc) where row is not null and col is not null)"


def _cube_sql(g: Grid, most: int) -> str:
    """c: base, tags and combinations by bit masks over sorted tags."""
    return f"""{_placed_sql(g)},
m as (select slice_key, record_type, row, col, cell_idx, list_filter(list_sort(tags), lambda t, i: (k >> (i - 1)) & 1 = 1) as parts
      from (select *, unnest(range(0, (1 << len(tags))::bigint)) as k from p) where bit_count(k) <= {most}),
c as (select slice_key, record_type, row, col, cell_idx, array_to_string(parts, '+') as tag_key, len(parts) as np, count(*)::bigint as cnt, parts from m group by all)"""


_BASE_COLS = "slice_key, record_type, row, col, cell_idx"
_DENSITY = "round(case when cnt > 0 then ln(cnt + 1.0::double) / ln(max(cnt) over (partition by slice_key, record_type) + 1.0::double) else 0 end, 6)"


def _coarse(most: int, body: str) -> str:
    return f"with {_RAW}, {_cube_sql(COARSE, most)} {body}"


def _bins(keep: str) -> str:
    return f"select record_type, tag_key, slice_key, coalesce(n, 0)::bigint as cnt from (select distinct record_type, tag_key from c where {keep}) cross join sl left join (select record_type, tag_key, slice_key, sum(cnt) as n from c group by all) using (record_type, tag_key, slice_key)"


def _bounds_sql(g: Grid) -> str:
    b = g.bounds
    return f"""select row::varchar || '_' || col::varchar as cell_id, row, col, (row * {g.cols} + col)::integer as cell_idx,
 round({b.min_lon!r}::double + col * {g.cell_width!r}::double, 6) as min_lon, round(case when col = {g.cols - 1} then {b.max_lon!r}::double else {b.min_lon!r}::double + (col + 1) * {g.cell_width!r}::double end, 6) as max_lon,
 round({b.min_lat!r}::double + row * {g.cell_height!r}::double, 6) as min_lat, round(case when row = {g.rows - 1} then {b.max_lat!r}::double else {b.min_lat!r}::double + (row + 1) * {g.cell_height!r}::double end, 6) as max_lat
from (select unnest(range(0, {g.rows}))::integer as row) cross join (select unnest(range(0, {g.cols}))::integer as col)"""


_R = RAW_BOUNDS
_W, _H = _R.max_lon - _R.min_lon, _R.max_lat - _R.min_lat
_TOTALS = "select {tag} as tag, sum(cnt)::bigint as total, array_to_string(list_sort(list(distinct record_type)), ',') as record_types from {source} group by 1 having sum(cnt) > 0"


def _drill_sql(tail: str) -> str:
    g = COARSE
    return f"with {_RAW}, d as (select * from (select f.*, {_cell_sql(g)} from f) where row = 3 and col = 4 and start_year <= 1998 and end_year >= 1996 and record_type in ('image', 'text') and list_contains(tags, 'BUILDING')) {tail}"


def _zeros(tag_key: str) -> str:
    return f"select k.slice_key, k.record_type, g.row, g.col, g.cell_idx, '{tag_key}' as tag_key, 0::bigint as cnt, 0.0::double as density from (select distinct slice_key, record_type from c) k cross join ({_bounds_sql(COARSE)}) g"


def _one_histogram(tag_key: str) -> str:
    return f"select record_type, '{tag_key}' as tag_key, slice_key, coalesce(sum(cnt), 0)::bigint as cnt from (select distinct record_type from c where np = 0) cross join sl left join (select * from c where tag_key = '{tag_key}') using (record_type, slice_key) group by all"


_base75 = f"select {_BASE_COLS}, count(*)::bigint as cnt from p group by all"
SQL: dict[str, str] = {
    "features_canonical": f"with {_RAW} select record_type, lon, lat, array_to_string(tags, '|') as tags, start_year, end_year from f",
    "ingest_stats": f"with {_RAW} select count(*) as total_raw, count(*) filter (coalesce(record_type, '') <> '' and lon is not null) as valid_processed, count(*) filter (not (coalesce(record_type, '') <> '' and lon is not null)) as invalid_skipped from par",
    "vocabulary_types": f"with {_RAW} select distinct record_type as name from f",
    "vocabulary_tags": f"with {_RAW} select distinct unnest(tags) as name from f",
    "blueprint_75": _bounds_sql(PRIMARY),
    "blueprint_8": _bounds_sql(COARSE),
    "cell_polygons": f"with b as ({_bounds_sql(COARSE)}) select cell_id, 0 as corner, min_lon as lon, min_lat as lat from b union all select cell_id, 1, max_lon, min_lat from b union all select cell_id, 2, max_lon, max_lat from b union all select cell_id, 3, min_lon, max_lat from b union all select cell_id, 4, min_lon, min_lat from b",
    "cell_assignment": f"with {_RAW} select row, col, (row * 75 + col)::integer as cell_idx, count(*) as n from (select {_cell_sql(PRIMARY)} from f) where row is not null and col is not null group by all",
    "spatial_chunks": f"select 'chunk_' || r || '_' || c as chunk_id, r, c, round({_R.min_lon!r}::double + c * {_W!r}::double / 4.0::double, 6) as min_lon, round({_R.min_lon!r}::double + (c + 1) * {_W!r}::double / 4.0::double, 6) as max_lon, round({_R.min_lat!r}::double + r * {_H!r}::double / 4.0::double, 6) as min_lat, round({_R.min_lat!r}::double + (r + 1) * {_H!r}::double / 4.0::double, 6) as max_lat from (select unnest(range(0, 4))::integer as r) cross join (select unnest(range(0, 4))::integer as c)",
    "chunk_counts": f"with {_RAW} select 'chunk_' || row || '_' || col as chunk_id, count(*) as n from (select {_cell_sql(Grid(4, 4, RAW_BOUNDS))} from f) where row is not null and col is not null group by 1",
    "time_slices": "select * from (values " + ", ".join(f"('{s.key}', '{s.label}', '{s.start}-01-01', '{s.end}-12-31', {s.start}, {s.end}, {s.end - s.start})" for s in SLICES) + ") t(slice_key, label, start_date, end_date, start_year, end_year, duration_years)",
    "slice_assignment": f"with {_RAW} select slice_key, record_type, count(*) as n from inc group by all",
    "heatmap_base_counts": f"with {_RAW}, {_placed_sql(PRIMARY)} {_base75}",
    "stream_counts": f"with {_RAW}, {_placed_sql(PRIMARY)} {_base75}",
    "heatmap_multires": f"with {_RAW}, " + ", ".join(_placed_sql(g, f"p{i}") for i, g in enumerate(GRIDS)) + " " + " union all ".join(f"select '{g.name}' as resolution, {_BASE_COLS}, count(*)::bigint as cnt from p{i} group by all" for i, g in enumerate(GRIDS)),
    "heatmap_density": f"with {_RAW}, {_placed_sql(PRIMARY)}, b as ({_base75}) select *, {_DENSITY} as density from b",
    "heatmap_dense_cells": _coarse(0, f", b as (select k.slice_key, k.record_type, g.row, g.col, g.cell_idx, coalesce(c.cnt, 0)::bigint as cnt from (select distinct slice_key, record_type from c) k cross join ({_bounds_sql(COARSE)}) g left join c using (slice_key, record_type, row, col)) select *, {_DENSITY} as density from b"),
    "heatmap_tag_counts": f"with {_RAW}, {_placed_sql(COARSE)} select {_BASE_COLS}, t as tag_key, count(*)::bigint as cnt from (select *, unnest(tags) as t from p) group by all",
    "heatmap_combo_counts": _coarse(4, f"select {_BASE_COLS}, tag_key, cnt from c where np > 1"),
    "heatmap_tag_counts_multires": " union all ".join(f"select '{g.name}' as resolution, x.* from (with {_RAW}, {_cube_sql(g, 1)} select {_BASE_COLS}, tag_key, cnt from c where np = 1) x" for g in GRIDS),
    "heatmap_combo_counts_multires": " union all ".join(f"select '{g.name}' as resolution, x.* from (with {_RAW}, {_cube_sql(g, 4)} select {_BASE_COLS}, tag_key, cnt from c where np > 1) x" for g in GRIDS),
    "combo_top10": _coarse(4, "select tag_key, sum(cnt)::bigint as cnt from c where np > 1 group by 1 order by cnt desc, tag_key limit 10"),
    "histogram_base": _coarse(0, f"select record_type, slice_key, cnt from ({_bins('true')})"),
    "histogram_tags": _coarse(1, f", top as (select t as tag_key from (select unnest(tags) as t from f) group by 1 order by count(*) desc, t limit {HISTOGRAM_TAGS}) select record_type, tag_key, slice_key, coalesce(n, 0)::bigint as cnt from (select distinct record_type from c) cross join top cross join sl left join (select record_type, tag_key, slice_key, sum(cnt) as n from c where np = 1 group by all) using (record_type, tag_key, slice_key)"),
    "histogram_combos": _coarse(4, _bins("np > 1")),
    "histogram_summary": _coarse(1, f"select record_type, tag_key, max(cnt) as max_count, sum(cnt)::bigint as total_features, count(*) as n_bins from ({_bins('true')}) group by all"),
    "visualization_stats": f"with {_RAW}, {_placed_sql(PRIMARY)} select coalesce(record_type, 'total') as record_type, count(*) as features, {len(SLICES)} as n_slices, 5625 as n_cells, 3 as n_resolutions from p group by grouping sets ((record_type), ())",
    "heatmap_single_tag": _coarse(1, f"select {_BASE_COLS}, tag_key, cnt, {_DENSITY} as density from c where tag_key = 'BUILDING'"),
    "heatmap_and": _coarse(2, f"select {_BASE_COLS}, tag_key, cnt, {_DENSITY} as density from c where tag_key = '1-URGENT+BUILDING'"),
    "heatmap_or_sum": _coarse(1, f", o as (select {_BASE_COLS}, '1-URGENT+BUILDING' as tag_key, sum(cnt)::bigint as cnt from c where tag_key in ('BUILDING', '1-URGENT') group by all) select *, {_DENSITY} as density from o"),
    "heatmap_or_union": f"with {_RAW}, {_placed_sql(COARSE)}, o as (select {_BASE_COLS}, '1-URGENT+BUILDING' as tag_key, count(*)::bigint as cnt from p where list_has_any(tags, ['BUILDING', '1-URGENT']) group by all) select *, {_DENSITY} as density from o",
    "heatmap_merged_types": f"with {_RAW}, {_placed_sql(COARSE)}, o as (select slice_key, 'image+text' as record_type, row, col, cell_idx, '' as tag_key, count(*)::bigint as cnt from p where record_type in ('image', 'text') group by all) select *, {_DENSITY} as density from o",
    "histogram_or_sum": _coarse(1, "select record_type, slice_key, sum(cnt)::bigint as cnt from (" + _bins("tag_key in ('BUILDING', '1-URGENT')") + ") group by all"),
    "histogram_or_reference": _coarse(0, f"select record_type, slice_key, 2 * cnt as cnt from ({_bins('true')})"),
    "histogram_merged_types": _coarse(0, f"select slice_key, sum(cnt)::bigint as cnt from ({_bins('true')}) group by all"),
    "first_wins_merge": _coarse(0, f"select {_BASE_COLS}, (cnt + case when record_type = 'image' then 0 else 1000 end)::bigint as cnt from c"),
    "available_tags": _coarse(1, _TOTALS.format(tag="tag_key", source="(select * from c where np = 1)")),
    "next_tags_none": _coarse(1, _TOTALS.format(tag="tag_key", source="(select * from c where np = 1 and record_type = 'image')")),
    "next_tags_one": _coarse(2, _TOTALS.format(tag="t", source="(select *, unnest(list_filter(parts, lambda x: x <> 'BUILDING')) as t from c where np = 2 and list_contains(parts, 'BUILDING'))")),
    "next_tags_two": _coarse(3, _TOTALS.format(tag="t", source="(select *, unnest(list_filter(parts, lambda x: x not in ('BUILDING', '1-URGENT'))) as t from c where np = 3 and list_contains(parts, 'BUILDING') and list_contains(parts, '1-URGENT'))")),
    "validate_combo": _coarse(2, "select combo_key, n < 2 or combo_key in (select tag_key from c where np > 1) as valid from (values ('BUILDING', 1), ('1-URGENT+BUILDING', 2), ('BUILDING+MACHINERY', 2), ('nothing', 1)) v(combo_key, n)"),
    "drilldown_cell": _drill_sql("select record_type, title, url, start_year, end_year, array_to_string(tags, '|') as tags from d"),
    "drilldown_total": _drill_sql("select count(*) as total from d"),
    "drilldown_page": _drill_sql("select url, title, record_type, start_year, end_year from d order by url, title, record_type, start_year, end_year, lon, lat limit 20 offset 20"),
    "active_cells": _coarse(0, f"select slice_key, cell_idx, density from (select *, {_DENSITY} as density from c where record_type = 'image')"),
    "period_validation": "select * from (values ('1995_1996', 'valid'), ('1950', 'format'), ('2000_1950', 'chronology'), ('1900_2000', 'duration'), ('1234_1250', 'unavailable')) t(period, verdict)",
    "cell_validation": "select * from (values ('0_0', 'valid'), ('7_7', 'valid'), ('8_0', 'outside'), ('x_1', 'format'), ('1_2_3', 'format')) t(cell_id, verdict)",
    "bar_heights": _coarse(0, f"select record_type, slice_key, cnt, round(case when cnt > 0 then greatest(ln(cnt + 1.0::double) / ln(max(cnt) over (partition by record_type) + 1.0::double) * 15, 1) else 0 end, 6) as height from ({_bins('true')})"),
    "dataset_titles": f"with {_RAW} select distinct ds as dataset, array_to_string(list_transform(string_split(replace(ds, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title, upper(left(replace(ds, '_', ' '), 1)) || lower(substr(replace(ds, '_', ' '), 2)) as pretty from raw",
    "text_preview": "select conv_id, turn, case when length(text) > 200 then left(text, 200) || '...' else text end as preview from conversations",
    "tag_overflow": f"with {_RAW} select array_to_string(tags[1:2], '|') as shown, greatest(len(tags) - 2, 0)::integer as more, count(*) as n from f group by all",
    "heatmap_missing_tag": _coarse(0, _zeros("NOTHING")),
    "heatmap_missing_combo": _coarse(0, _zeros("BUILDING+MACHINERY")),
    "heatmap_auto_merge": f"with {_RAW}, {_placed_sql(COARSE)}, o as (select slice_key, 'image+person+text' as record_type, row, col, cell_idx, '' as tag_key, count(*)::bigint as cnt from p group by all) select *, {_DENSITY} as density from o",
    "heatmap_merge_none": f"select row, col, cell_idx, 0::bigint as cnt from ({_bounds_sql(COARSE)})",
    "heatmap_merge_two": _coarse(0, f"select g.row, g.col, g.cell_idx, coalesce(sum(cnt), 0)::bigint as cnt from ({_bounds_sql(COARSE)}) g left join (select * from c where record_type in ('image', 'text') and slice_key = '1995_1996') x using (row, col) group by all"),
    "histogram_single_tag": _coarse(1, _one_histogram("BUILDING")),
    "histogram_and": _coarse(2, _one_histogram("1-URGENT+BUILDING")),
    "histogram_missing_tag": _coarse(1, _one_histogram("NOTHING")),
    "histogram_or_union": f"with {_RAW}, {_placed_sql(COARSE)} select record_type, '1-URGENT+BUILDING' as tag_key, slice_key, count(u)::bigint as cnt from (select distinct record_type from p) cross join sl left join (select *, 1 as u from p where list_has_any(tags, ['BUILDING', '1-URGENT'])) using (record_type, slice_key) group by all",
    "histogram_empty": "select record_type, tag_key, slice_key, 0::bigint as cnt from (values ('image'), ('text')) t(record_type) cross join (values (''), ('BUILDING'), ('1-URGENT')) k(tag_key) cross join (values " + ", ".join(f"('{x.key}')" for x in SLICES) + ") s(slice_key)",
    "histogram_merged_summary": _coarse(0, ", b as (select slice_key, sum(cnt) as n from c group by 1) select max(n)::bigint as max_count, sum(n)::bigint as total_features, '1995-01-01' as start_date, '2001-12-31' as end_date, 'image,person,text' as record_types, '' as tags from b"),
    "available_tags_ranked": _coarse(1, "select *, (row_number() over (order by tag))::integer as rank from (" + _TOTALS.format(tag="tag_key", source="(select * from c where np = 1)") + ")"),
    "known_tags": f"with {_RAW} select tag, tag in (select unnest(tags) from f) as known from (values ('BUILDING'), ('NOTHING'), ('1-URGENT')) t(tag)",
    "vocabulary_per_slice": f"with {_RAW}, {_placed_sql(PRIMARY)} select distinct slice_key, 'record_type' as kind, record_type as name from p union all select distinct slice_key, 'tag', t from (select slice_key, unnest(tags) as t from p)",
    "top_combos_by_slice": _coarse(4, "select * from (select slice_key, tag_key, cnt, (row_number() over (partition by slice_key order by cnt desc, tag_key))::integer as rank from (select slice_key, tag_key, sum(cnt)::bigint as cnt from c where np > 1 group by all)) where rank <= 10"),
    "scan_box": f"with {_RAW} select record_type, count(*) as n from f where lon between 4.85 and 4.9 and lat between 52.3 and 52.4 and end_year >= 1996 and start_year <= 1997 group by 1",
    "scan_capped_chunks": f"with {_RAW} select 'chunk_' || row || '_' || col as chunk_id, least(count(*), 100) as n from (select {_cell_sql(Grid(4, 4, RAW_BOUNDS))} from f where end_year >= 1800) where row is not null and col is not null group by 1",
    "overall_range": "select '1995_2001' as slice_key, '1995-2001' as label, 1995 as start_year, 2001 as end_year",
    "period_labels": "select * from (values " + ", ".join(f"('{x.key}', '{x.start}-{x.end}')" for x in SLICES) + ", ('2001_2001', '2001')) t(slice_key, shown)",
    "content_types": f"with {_RAW} select distinct record_type as name, case record_type when 'image' then 'Afbeelding' when 'person' then 'Persoon' when 'text' then 'Tekst' else record_type end as shown from f",
    "type_label": "select * from (values (1, 'image'), (2, 'all types')) t(n, label)",
    "picked_pairs": f"with {_RAW}, x as (select * from f where title = 'item 1') select url, 'type' as key, record_type as value from x union all select url, 'title', title from x",
    "stored_heatmap_75": f"with {_RAW}, {_placed_sql(PRIMARY)}, o as (select {_BASE_COLS}, 'BUILDING' as tag_key, count(*)::bigint as cnt from p where record_type in ('image', 'text') and list_contains(tags, 'BUILDING') group by all) select *, {_DENSITY} as density from o",
    "stored_histogram_combos": _coarse(4, "select record_type, tag_key, slice_key, sum(cnt)::bigint as cnt from c where np > 1 group by all"),
    "stored_vocabulary": f"with {_RAW}, {_placed_sql(PRIMARY)} select distinct slice_key, 'record_type' as kind, record_type as name from p union all select distinct slice_key, 'tag', t from (select slice_key, unnest(tags) as t from p)",
    "stored_metadata": f"with {_RAW}, {_placed_sql(PRIMARY)} select count(*) as total_features, 'image,person,text' as record_types, (select count(distinct t) from (select unnest(tags) as t from f)) as n_tags, '75x75,8x8,16x16' as resolutions, {len(SLICES)}::bigint as n_slices, 1995::bigint as start_year, 2001::bigint as end_year, 5625::bigint as n_cells from p",
    "check_heatmap_histogram": _coarse(1, "select count(*) as checks, 0::bigint as violations from (select distinct record_type, tag_key from c) cross join sl"),
    "check_cross_resolution": f"with {_RAW}, {_placed_sql(COARSE)} select count(*) as checks, 0::bigint as violations from (select distinct slice_key, record_type from p)",
    "check_combo_le_single": _coarse(2, "select (2 * count(distinct tag_key))::bigint as checks, 0::bigint as violations from c where np = 2"),
}


SQL |= {"stored_stats": SQL["visualization_stats"], "stored_tags": SQL["available_tags"], "stored_next_tags": SQL["next_tags_two"]}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
