"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_text, line_dedup, minhash_dedup, mtree, packing, quality, substring_dedup, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": mtree.op1_top_k,
        "op2_quality": quality.op2_quality,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_bpe": bpe.op5_bpe,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_packing": packing.op7_packing,
        "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": mtree.OP1_SQL, "op4_substring_dedup": substring_dedup.OP4_SQL, "op8_minhash_dedup": minhash_dedup.OP8_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op10_line_dedup": line_dedup.OP10_SQL}
