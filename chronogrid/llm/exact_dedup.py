"""Exact dedup by skew-safe combining, with DataFrame functions only.

Local: the partial aggregate of each input task keeps at most `salts` rows per text of that
task. Salted: those rows are merged per (digest, text, salt), so a text that a third of all rows
share is merged by `salts` tasks. Global: the at most `salts` winners of a text are merged.
The full normalised text is a grouping key at every stage, so equality is never a matter of
digests. Rows then find their group by three fingerprints of the text (SHA-256, a 64-bit
hash, length) and one of 64 lanes, a group being there once for each lane its rows have, so that
the rows of one text meet their group in up to 64 tasks. Should two different texts ever share
all three fingerprints, the query raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, id_text, table

_TOP = "9223372036854775807"
_STEP = "20000000000000000000"
_LANES = 64


def _priority(length: Column, row_id: Column) -> Column:
    """One decimal that orders rows: longer first, then smaller id, null ids last."""
    after = F.coalesce(F.lit(_TOP).cast("decimal(38,0)") - row_id.cast("decimal(20,0)") + F.lit(1), F.lit(0))
    return (length.cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(21,0)") + after).cast("decimal(38,0)")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting all white space [\\x20\\x09-\\x0D]; the row
    with the most code points, then the smallest id, stays. Null text counts as empty, and
    empty texts form one group. A null id ranks after all others; rows that repeat both the
    winning id and its length are all marked kept. An empty table gives an empty result;
    further columns are ignored whatever their names.
    """
    text = F.regexp_replace("_text", WS_CLASS + "+", "")
    rows = id_text(df, id_col, text_col).select("_id", F.length("_text").alias("_len"), text.alias("_norm"))
    # Neither is ever null; said so that the planner filters on neither, and makes no text and digest twice for it.
    rows = rows.withColumn("_digest", F.coalesce(F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)), F.lit(b"")))
    rows = rows.withColumn("_lane", F.xxhash64(F.coalesce("_id", F.lit(-1))).bitwiseAND(_LANES - 1).cast("int"))
    # The lanes of a text are the bits of a number, which is cheaper than a set of them.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_lane"))
    salted = rows.groupBy("_digest", "_norm", (F.col("_lane") % salts).alias("_salt")).agg(
        F.max(_priority(F.col("_len"), F.col("_id"))).alias("_best"), F.count(F.lit(1)).alias("_n"), F.bit_or(bit).alias("_bits")
    )
    whole = salted.groupBy("_digest", "_norm").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"), F.bit_or("_bits").alias("_bits"))
    prints = lambda d: [d["_digest"], F.xxhash64(d["_norm"]).alias("_h"), F.length(d["_norm"]).alias("_w")]
    groups = (
        whole.select(*prints(whole), "_best", "_n", "_bits")
        .groupBy("_digest", "_h", "_w")
        .agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"), F.bit_or("_bits").alias("_bits"), F.count(F.lit(1)).alias("_texts"))
        .withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two texts share all fingerprints"))))
    )
    has = lambda i: F.getbit(F.col("_bits"), i) == 1
    groups = groups.withColumn("_lane", F.explode(F.filter(F.sequence(F.lit(0), F.lit(_LANES - 1)), has))).drop("_bits")
    after = (F.col("_best") % F.lit(_STEP).cast("decimal(21,0)")).cast("decimal(21,0)")
    keep = F.when(after != 0, (F.lit(_TOP).cast("decimal(20,0)") - after + 1).cast("long"))
    return (
        rows.select(*prints(rows), "_lane", "_id", "_len")
        .join(groups.withColumn("_keep", keep), ["_digest", "_h", "_w", "_lane"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_n").cast("long").alias("group_size"),
            (F.col("_id").eqNullSafe(F.col("_keep")) & (_priority(F.col("_len"), F.col("_id")) == F.col("_best"))).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; null, empty and blank texts are one group, an empty table gives no rows."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
     w as (select *, first_value(doc_id) over (partition by norm order by len desc, doc_id) as keep_id,
                  count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from w
"""
