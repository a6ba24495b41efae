"""Unit rows for what the derived tables don't hold, and queries against their SQL."""

import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from chronogrid.functions import text as X
from chronogrid.functions.config import GRIDS, PRIMARY, RAW_BOUNDS, Bounds, Grid, TimeSlice
from chronogrid.operators import cube as C
from chronogrid.operators import grid as G
from chronogrid.plans import catalogue, service
from chronogrid.sources import features as S
from chronogrid.sources import store

SF = "/root/testdata/sf0.001"
SLOW = {"heatmap_combo_counts_multires", "stream_counts"}
FAST = [n for n in catalogue.QUERIES if n not in SLOW]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.sql(catalogue.SQL[name])
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(found.columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, df.select(*found.columns).collect()), key=key) == sorted(found.fetchall(), key=key)


@pytest.mark.parametrize(
    "wkt,point",
    [("POINT(-1.5 +2)", (-1.5, 2.0)), ("POINT(.5 2)", (0.5, 2.0)), ("SRID=4326;POINT(1 2)", (1.0, 2.0)), ("MULTIPOINT(1 2)", (1.0, 2.0))]
    + [(w, (None, None)) for w in ("POINT (1 2)", "point(1 2)", "POINT(1e-3 2)", "POINT(5. 2)", "POINT(1 2 3)", "LINESTRING(1 2, 3 4)", None)],
)
def test_points(spark, wkt, point):
    row = spark.createDataFrame([(wkt,)], "geom string").select(S.coordinate(F.col("geom"), 1), S.coordinate(F.col("geom"), 2)).first()
    assert tuple(row) == point


def test_edges_of_the_grid(spark):
    b = PRIMARY.bounds
    rows = [(b.min_lon, b.min_lat), (b.max_lon, b.max_lat), (b.max_lon + 1e-6, b.min_lat), (b.min_lon - 1e-6, b.min_lat)]
    got = spark.createDataFrame(rows, "lon double, lat double").select(G.cell(PRIMARY).alias("c")).select("c.row", "c.col").collect()
    assert [tuple(r) for r in got] == [(0, 0), (74, 74), (None, None), (None, None)]


def test_chunks_partition_the_bounds(spark):
    for n in (2, 3, 5):
        rows = G.chunks(spark, RAW_BOUNDS, n, n).collect()
        area = sum((r.max_lon - r.min_lon) * (r.max_lat - r.min_lat) for r in rows)
        assert len(rows) == n * n
        assert abs(area - (RAW_BOUNDS.max_lon - RAW_BOUNDS.min_lon) * (RAW_BOUNDS.max_lat - RAW_BOUNDS.min_lat)) < 1e-10


def test_tag_sets(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["b", "a"],), (["a", "a", "b"],), (list("edcba"),)], "tags array<string>")
    got = [sorted(map(tuple, r[0])) for r in rows.select(C.tag_sets(F.col("tags"), 2)).collect()]
    assert got[0] == [()] and got[1] == [(), ("a",)] and got[2] == [(), ("a",), ("a", "b"), ("b",)]
    assert got[3] == [(), ("a",), ("a",), ("a", "a"), ("a", "b"), ("a", "b"), ("b",)] and len(got[4]) == 16


def test_records_with_many_tags(spark):
    """No limit on the tags of a record: 25 of them give 25 single ones and 300 pairs."""
    rows = spark.createDataFrame([([f"t{i:02}" for i in range(25)],)], "tags array<string>")
    assert [len(rows.select(C.tag_sets(F.col("tags"), most, least)).first()[0]) for most, least in ((1, 1), (2, 2), (3, 0))] == [25, 300, 1 + 25 + 300 + 2300]
    assert [tuple(x) for x in rows.select(C.tag_sets(F.col("tags"), 2, 2, ["t24"])).first()[0]] == [(f"t{i:02}", "t24") for i in range(24)]


def test_invalid_records_are_counted(spark):
    raw = spark.createDataFrame([("d", "POINT(1 2)", [1, 2], "t", "u", t, None) for t in ("image", "", None)] + [("d", "x", [1, 2], "t", "u", "image", None), ("d", "POINT(1 2)", None, "t", "u", "image", None)], "ds string, geom string, per array<int>, tit string, url string, recordType string, tags array<string>")
    assert tuple(S.ingest_stats(S.canonical(raw)).first()) == (5, 1, 4)


def test_types_of_a_request(spark):
    cube = spark.createDataFrame([("image",)], "record_type string")
    assert service.check_types(cube, []) == ["image"]
    with pytest.raises(service.UnknownRecordType):
        service.check_types(cube, ["film"])
    with pytest.raises(service.UnknownRecordType):
        service.heatmaps(cube, "8x8", ["film"], known=["image"])
    assert service.usable_types(["film", "image"], ["image", "text"]) == (["image"], ["film"])
    assert service.usable_types(["film"], ["image", "text"]) == (["image", "text"], ["film"])
    assert service.params(" a, ,b,") == ["a", "b"] and service.params(None) == []
    assert service.source_params({"recordTypes": ["image"], "tags": [], "limit": 5}) == {"operator": "OR", "types": ["image"], "limit": 5}


def test_raw_records_and_pages(spark, tmp_path):
    record = '{"ds": "a", "geom": "POINT(1 2)", "per": [1900, 1950], "tit": "t", "url": "u", "recordType": "image", "tags": ["x"]}'
    (tmp_path / "raw.json").write_text(record + "\n")
    (tmp_path / "pages.json").write_text(f'{{"data": [{record}, {record}], "total": 3, "page": 1, "page_size": 2, "returned": 2, "total_pages": 2}}\n{{"data": [{record}], "total": 3, "page": 2}}\n')
    assert tuple(S.canonical(S.read_raw(spark, str(tmp_path / "raw.json"))).select("lon", "lat", "start_year", "valid").first()) == (1.0, 2.0, 1900, True)
    assert S.canonical(S.read_pages(spark, str(tmp_path / "pages.json"))).filter("valid").count() == 3
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_raw(spark, str(tmp_path / "bad.json")).collect()


def test_names_in_the_order_of_the_locale(spark):
    tags = spark.createDataFrame([(t,) for t in ("B", "a", "é", "A", "b")], "tag string")
    assert [r.tag for r in service.by_name(tags).collect()] == ["a", "A", "b", "B", "é"]


def test_merges_of_nothing_and_of_other_sizes(spark):
    small, large = catalogue.G.blueprint(spark, GRIDS[1]), catalogue.G.blueprint(spark, GRIDS[2])
    with pytest.raises(ValueError):
        catalogue.M.first_wins([], ["row"])
    with pytest.raises(Exception, match="different sizes"):
        catalogue.M.merge_heatmaps([large.withColumn("cnt", F.lit(1))], small).collect()


def test_periods_and_pages(spark):
    asked = spark.createDataFrame([("1995_1996",), ("1950",)], "period string")
    slices = C.time_slices(spark, catalogue.SLICES)
    assert {r.period: r.shown for r in service.chosen_periods(asked, slices).collect()} == {"1995_1996": "1995_1996", "1950": "2000_2001"}
    row = spark.createDataFrame([(45, 3, 20), (40, 2, 20), (0, 1, 20)], "total int, number int, size int").select(X.page_bounds(F.col("total"), F.col("number"), F.col("size")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in row] == [(3, 41, 45), (2, 21, 40), (0, 1, 0)]
    assert (TimeSlice(1900, 1950, "-", " to ").key, TimeSlice(1900, 1950, "-", " to ").label) == ("1900-1950", "1900 to 1950")


def test_cells_of_a_blueprint(spark):
    asked = spark.createDataFrame([(c,) for c in ("0_0", "1_1", "9_9", "x")], "cell_id string")
    some = catalogue.G.blueprint(spark, GRIDS[1]).filter("cell_id != '1_1'")
    assert {r.cell_id: r.verdict for r in service.validate_cells(asked, GRIDS[1], some).collect()} == {"0_0": "valid", "1_1": "unknown", "9_9": "outside", "x": "format"}


def test_streamed_names(spark, tmp_path):
    from chronogrid.streaming import counts as T

    f = catalogue.features(spark, SF)
    f.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.start(stream, catalogue.SLICES, [PRIMARY], str(tmp_path / "out")).awaitTermination()
    assert T.names(spark, str(tmp_path / "out")).exceptAll(S.vocabulary(f)).count() == 0
    assert T.names(spark, str(tmp_path / "out")).count() == S.vocabulary(f).count()
    assert T.totals(spark, str(tmp_path / "out")).agg(F.sum("cnt")).first()[0] == C.counts(f, catalogue.SLICES, [PRIMARY], 0).agg(F.sum("cnt")).first()[0]


def test_json_of_rows(spark):
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    assert tuple(store.as_json(rows, ["k"]).first()) == ("a", '{"k":"a","n":1}')


def test_store_round_trip(spark, tmp_path):
    f = catalogue.features(spark, SF)
    slices = [TimeSlice(1995, 1998), TimeSlice(1998, 2001)]
    store.build(f, slices, GRIDS[1:], str(tmp_path), 2)
    back = store.load(spark, str(tmp_path))
    cube = C.counts(f, slices, GRIDS[1:], 2)
    assert back["counts"].select(*C.KEYS, "cnt").exceptAll(cube.select(*C.KEYS, "cnt")).count() == 0
    assert back["counts"].count() == cube.count()
    assert back["metadata"].first()["total_features"] > 0


def test_histograms_of_the_first_tags(spark):
    """The first 20 tags have histograms; the fixture has 18, so all of them."""
    tags = {r.tag for r in catalogue.features(spark, SF).select(F.explode("tags").alias("tag")).distinct().collect()}
    assert 5 < len(tags) <= 20
    assert {r.tag_key for r in catalogue.QUERIES["histogram_tags"](spark, SF).collect()} == tags


@pytest.mark.parametrize("name", ["heatmap_tag_counts_multires", "heatmap_combo_counts_multires"])
def test_tag_maps_on_every_grid(spark, name):
    assert {r.resolution for r in catalogue.QUERIES[name](spark, SF).select("resolution").distinct().collect()} == {g.name for g in GRIDS}
    test_query_equals_its_sql(spark, name)


def test_fine_grids_shuffle_records_and_lists_only(spark):
    """Over a fine grid nothing is shuffled by tag or combination, and records go out before they are multiplied by slices and grids."""
    f = catalogue.features(spark, SF)
    for most, least in ((1, 1), (4, 2), (4, 0)):
        plan = C.counts(f, catalogue.SLICES, GRIDS, most, least)._jdf.queryExecution().executedPlan().toString().split("\n")
        exchanges = [i for i, x in enumerate(plan) if "Exchange" in x]
        assert len(exchanges) == 2 and not any(k in plan[i] for i in exchanges for k in ("tag_parts", "_tag#"))
        assert not any("Generate" in x or "Join" in x for x in plan[exchanges[-1] :])


@pytest.mark.parametrize("most,least,containing", [(1, 0, None), (1, 1, None), (2, 2, None), (3, 0, None), (2, 1, ["b"]), (1, 1, ["b"])])
def test_counts_by_block_equal_counts_by_list(spark, most, least, containing):
    """Also off some of the grids, with repeated tags, none, periods before, between, around and after the slices, or backwards."""
    small = Bounds(4.85, 4.9, 52.3, 52.35)
    grids = [Grid(40, 40, small), GRIDS[2], Grid(3, 5, Bounds(0.0, 10.0, 50.0, 54.0))]
    slices = [TimeSlice(1990, 1995), TimeSlice(1950, 1960), TimeSlice(1995, 1996), TimeSlice(1940, 1992)]
    points = [(4.8502, 52.3002), (4.9, 52.35), (4.87, 52.32), (4.95, 52.4), (1.0, 51.0), (20.0, 20.0)]
    tags = [[], ["a"], ["b", "a"], ["a", "b", "b"], ["c", "b", "a", "d"]]
    periods = [(1900, 1930), (1930, 1945), (1961, 1970), (1993, 1994), (1995, 1995), (1900, 2000), (1997, 2005), (1995, 1951), (2000, 1900), (None, 1990)]
    rows = [(t, x, y, g, a, b) for t in ("image", "text") for x, y in points for g in tags for a, b in periods]
    f = spark.createDataFrame(rows, "record_type string, lon double, lat double, tags array<string>, start_year int, end_year int")
    assert max(g.rows * g.cols for g in grids) > C.FINE
    got = C.counts(f, slices, grids, most, least, containing)
    want = C._counted(f, lambda x: C.assign_slices(G.assign_cells(x, grids), slices), C.KEYS, most, least, containing)
    assert got.dtypes == want.dtypes
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) != []


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    """What ingest and store shuffle is deleted when each write ends, so that it doesn't add to the disk of what follows."""
    places = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    there = lambda: {p for d in places for p in Path(d).rglob("shuffle_*.data")}
    sf = tmp_path / "sf"
    sf.symlink_to(SF)  # a folder of its own, that no other test has ingested
    before = there()
    catalogue.parsed(spark, str(sf))
    catalogue.stored(spark, str(sf))
    for _ in range(100):
        if not (left := there() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _exchanges(df):
    """The columns that each shuffle of a plan carries, from the top down."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


def test_single_tags_are_counted_before_lists_are_shuffled(spark):
    """In its cell nearly every record has a list of its own, so lists by slice and grid would weigh more than the records."""
    f = catalogue.features(spark, SF)
    for least in (0, 1):
        counts, records = _exchanges(C.counts(f, catalogue.SLICES, GRIDS, 1, least))
        assert "_tag" in counts and "tags" not in counts and "tags" in records


def test_ingest_shuffles_lines_twice_and_no_made_text(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _exchanges(S.canonical(S.fixture_raw(spark, SF, 1, S.PASSES)))
        plan = S.fixture_raw(spark, SF, 1, S.PASSES)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("l_linenumber" in x for x in found) == 2
    assert not any({"url", "tit", "title", "geom", "ds", "dataset", "tags"} & x for x in found)
    assert "xxhash64(o_orderkey" in plan  # a pass leaves out the other passes' orders, too


def test_ingest_in_passes_gives_the_same_records(spark, tmp_path, monkeypatch):
    rows = {}
    for size in (1, 1 << 40):
        monkeypatch.setattr(S, "PASS_BYTES", size)
        assert S.fixture_passes(spark, SF) == (S.PASSES if size == 1 else 1)
        (tmp_path / str(size)).symlink_to(SF)
        rows[size] = sorted(map(repr, catalogue.parsed(spark, str(tmp_path / str(size))).collect()))
    assert rows[1] == rows[1 << 40] != []
    shares = [S.fixture_raw(spark, SF, at, 3).count() for at in range(3)]
    assert sum(shares) == len(rows[1]) and min(shares) > 0
