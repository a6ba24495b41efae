"""The second run of each headline query, and how long its first one and the ingest of the records took; one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from chronogrid.plans import catalogue

NAMES = ["heatmap_base_counts", "heatmap_multires", "heatmap_density", "heatmap_combo_counts", "histogram_tags", "heatmap_or_union", "next_tags_one", "drilldown_cell"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, first = {}, {}
    began = time.time()
    catalogue.parsed(spark, sf_dir)
    ingest = round(time.time() - began, 3)
    for name in NAMES:
        times = []
        for _ in range(2):
            began = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        first[name], queries[name] = round(times[0], 3), round(times[-1], 3)
    print(json.dumps({"metric": "sum of second runs", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "first_runs": first, "ingest": ingest, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
