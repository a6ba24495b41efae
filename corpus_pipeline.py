"""From raw documents to packed training sequences, stage by stage.

Every stage works on all documents its predecessor kept. The stages before the last return the
columns of documents; where a stage changes texts, n_chars follows, and a document that it
leaves without a word goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import discard, materialize, table
from chronogrid.llm.line_dedup import line_dedup
from chronogrid.llm.minhash_dedup import near_dedup
from chronogrid.llm.packing import pack
from chronogrid.llm.quality import quality_filter
from chronogrid.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _cleaned(docs: DataFrame, removed: str) -> DataFrame:
    left = docs.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier keeps. Null texts are scored as empty ones; of rows that share an id, all stay if one does; null ids are scored. An empty table gives an empty one."""
    return quality_filter(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or the same one, has already. A document left without a word goes; one that had none stays. An empty table gives an empty one."""
    return _cleaned(line_dedup(docs.select(*COLUMNS)), "n_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Null, empty and blank texts are groups of their own. An empty table gives an empty one."""
    return near_dedup(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that occur earlier, their words joined by one space where any went. A document left without a word goes. An empty table gives an empty one."""
    return _cleaned(substring_dedup(docs.select(*COLUMNS)), "n_removed")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end id alone. An empty table gives an empty one."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("substring dedup", substrings), ("packing", packing)]

#: The classifier and the tokenizer aren't SQL; tests/llm holds the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
