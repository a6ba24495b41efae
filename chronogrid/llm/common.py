"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every text contract here defines it.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def by_value(name: str) -> None:
    """Pickle the functions of module `name` by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) alone, so further columns of any name can't clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    Lost executors then cost a re-read, not a recomputation. The tables lie under
    <spark.checkpoint.dir>/chronogrid; those an operator needs no longer it discards, the others
    can go once the query's result is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronogrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Hand free memory back to the system: workers live on between stages, beside the JVM's own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """`run` over Arrow batches, with its memory released at the end of the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def lean_group(settle: Callable) -> Callable:
    """`settle` of one group, with its memory released."""

    def task(t: pa.Table) -> pa.Table:
        out = settle(t)
        release()
        return out

    return task


def distinct_ids(docs: DataFrame) -> DataFrame:
    """docs (_id, _text, others) with an _id of its own for every row, in the order of the given ones.

    Where no id is repeated, docs as it is. Else rows are sorted by id, those that share one by
    a hash of their text, equal texts in any order, numbered, and written once.
    """
    if docs.groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
        return docs
    ordered = docs.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()}).orderBy("_id", "_hash", "_row")
    return materialize(ordered.withColumn("_id", F.monotonically_increasing_id()).select(*docs.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text as an array; JVM side."""
    return F.array_remove(F.split(text, WS_CLASS + "+"), "")


by_value(__name__)
