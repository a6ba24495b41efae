"""Ingest of raw records: parsing, validation, counters, vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import DEFAULT_START, POINT

RAW = "ds string, geom string, per array<int>, tit string, url string, recordType string, tags array<string>, thumbnail string, alt string, text string"


PAGE = f"data array<struct<{RAW.replace(' array', ': array').replace(' string', ': string')}>>, total long, page int, page_size int, returned int, total_pages int"


def read_raw(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw records from files with a fixed schema; a malformed JSON line fails the job."""
    reader = spark.read.schema(RAW).option("mode", "FAILFAST") if fmt == "json" else spark.read
    return reader.format(fmt).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw records from saved answers of a paged source, one envelope a line: (data, total, page, ...)."""
    pages = spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)
    return pages.select(F.explode("data").alias("_r")).select("_r.*")


def scan(features: DataFrame, box: tuple[float, float, float, float] | None = None, start: int = DEFAULT_START, end: int | None = None, max_rows_per_chunk: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Records in a closed box (lon, lon_to, lat, lat_to) whose period touches start to end.

    `max_rows_per_chunk` with `chunk` keeps that many records of each chunk, by url, title and
    place; without it nothing is left out.
    """
    out = features.filter(F.col("end_year") >= start)
    if end is not None:
        out = out.filter(F.col("start_year") <= end)
    if box is not None:
        out = out.filter(within(*box))
    if max_rows_per_chunk is not None:
        order = W.partitionBy("_chunk").orderBy("url", "title", "lon", "lat")
        out = out.withColumn("_chunk", chunk).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_rows_per_chunk).drop("_chunk", "_n")
    return out


def coordinate(wkt: Column, part: int) -> Column:
    """Longitude (1) or latitude (2) of a WKT point, null where the text holds none."""
    return F.regexp_extract(wkt, POINT, part).try_cast("double")


def canonical(raw: DataFrame) -> DataFrame:
    """(record_type, lon, lat, tags, start_year, end_year, title, url, dataset, valid) of raw records; missing tags are empty."""
    out = raw.select(
        F.col("recordType").alias("record_type"),
        coordinate(F.col("geom"), 1).alias("lon"),
        coordinate(F.col("geom"), 2).alias("lat"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.get("per", F.lit(0)).alias("start_year"),
        F.get("per", F.lit(1)).alias("end_year"),
        F.col("tit").alias("title"),
        "url",
        F.col("ds").alias("dataset"),
        F.col("per").isNotNull().alias("_dated"),
    )
    valid = F.coalesce(F.col("record_type") != "", F.lit(False)) & F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("_dated")
    return out.withColumn("valid", valid).drop("_dated")


def valid_features(features: DataFrame) -> DataFrame:
    return features.filter("valid").drop("valid")


def ingest_stats(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("total_raw"), F.count_if("valid").alias("valid_processed"), F.count_if(~F.col("valid")).alias("invalid_skipped"))


def vocabulary(features: DataFrame) -> DataFrame:
    """(kind, name) of all record types and tags of valid records, on and off the grid."""
    types = features.select(F.lit("record_type").alias("kind"), F.col("record_type").alias("name"))
    tags = features.select(F.lit("tag").alias("kind"), F.explode("tags").alias("name"))
    return types.unionByName(tags).distinct()


def vocabulary_by_slice(placed: DataFrame) -> DataFrame:
    """(slice_key, kind, name) of the types and tags of records on the grid."""
    types = placed.select("slice_key", F.lit("record_type").alias("kind"), F.col("record_type").alias("name"))
    tags = placed.select("slice_key", F.lit("tag").alias("kind"), F.explode("tags").alias("name"))
    return types.unionByName(tags).distinct()


def within(lon: float, lon_to: float, lat: float, lat_to: float) -> Column:
    """Closed bounding box on parsed columns, which Parquet statistics can prune."""
    return F.col("lon").between(lon, lon_to) & F.col("lat").between(lat, lat_to)


#: The derived records of the test tables, in both SQL dialects (string type, array literal).
FIXTURE = """
select concat('ds_', l.l_linestatus, '_', l.l_returnflag) as ds,
  concat('POINT(', cast(cast(4.80e0 + 0.18e0 * (((c.c_custkey*7919) % 10007)/10007.0e0) as decimal(12,7)) as {string}), ' ',
         cast(cast(52.22e0 + 0.24e0 * (((l.l_partkey*104729) % 10007)/10007.0e0) as decimal(12,7)) as {string}), ')') as geom,
  cast(least(year(o.o_orderdate), year(l.l_shipdate)) as int) as start_year,
  cast(greatest(year(o.o_orderdate), year(l.l_shipdate)) as int) as end_year,
  concat('item ', cast(l.l_partkey as {string})) as title,
  concat('http://example.org/', cast(l.l_orderkey as {string}), '/', cast(l.l_linenumber as {string})) as url,
  case when o.o_orderstatus='F' then 'image' when o.o_orderstatus='O' then 'text'
       when l.l_linestatus='F' then 'person' end as record_type,
  case when l.l_returnflag='N' then null
       else {open}o.o_orderpriority, c.c_mktsegment, p.p_type, l.l_returnflag{close} end as tags
from lineitem l join orders o on l.l_orderkey=o.o_orderkey
  join customer c on o.o_custkey=c.c_custkey join part p on l.l_partkey=p.p_partkey
"""


#: Bytes of lines for each pass in which records are made, and the most passes, so that reading stays in proportion.
PASS_BYTES, PASSES = 64 << 20, 8


def fixture_raw(spark: SparkSession, sf_dir: str, at: int = 0, passes: int = 1) -> DataFrame:
    """Raw records of the test tables, or the share `at` of `passes` equal ones, by order.

    The joins of FIXTURE in an order in which two of them shuffle lines (that with part and the
    last), and these without text of their own: url, title and the like are made behind them.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "part")}
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.trunc("l_shipdate", "year").alias("l_shipdate"))
    orders = t["orders"].withColumn("o_orderdate", F.trunc("o_orderdate", "year"))
    if passes > 1:  # The planner infers the same of orders. Not the hash of shuffles, which would leave most of their partitions empty.
        lines = lines.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(passes)) == at)
    if passes < PASSES:  # up to about 450 MB lines may be one task or a few up to the end, if others are broadcast
        lines = lines.hint("rebalance")
    bought = orders.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = FIXTURE.format(string="string", open="array(", close=")").partition("from lineitem")[0]
    rows = spark.sql(re.sub(r"\b[locp]\.(?=[locp]_)", "", columns) + "from {joined}", joined=joined)
    return rows.select("ds", "geom", F.array("start_year", "end_year").alias("per"), F.col("title").alias("tit"), "url", F.col("record_type").alias("recordType"), "tags")


def fixture_passes(spark: SparkSession, sf_dir: str) -> int:
    """In how many passes to make the records of a table folder; from the sizes of files, without a job."""
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet")._jdf.queryExecution().analyzed().stats().sizeInBytes()
    return max(1, min(PASSES, -(-int(str(found)) // PASS_BYTES)))
