"""Nulls in any column, empty texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronogrid.llm import bpe, exact_dedup, html_text, line_dedup, minhash_dedup, mtree, packing, quality, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, _more string, kept string, n_removed string, length string, ids string, component_id string, start string, _batch string, _node string, score string, n_words string, _p string"
LONG = " ".join(f"word{i}" for i in range(60)) + ".\nA second line, with commas, and enough words to count as one of prose."


def rows():
    texts = [(1, LONG), (2, None), (3, ""), (4, " \n\t "), (None, LONG + " more"), (None, None), (5, LONG), (5, LONG), (6, "short"), (7, "short")]
    out = [(i, t, "en" if n % 2 else None, None if n % 3 else "host", None, *["x" if n % 2 else None] * 14) for n, (i, t) in enumerate(texts)]
    return out + [out[0]]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).select("*")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, None), (5, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, l: quality.score(d, l),
    "suffix": lambda d, l: suffix_dedup.suffix_dedup(d),
    "substring": lambda d, l: substring_dedup.substring_dedup(d),
    "encode": lambda d, l: bpe.bpe_encode(d),
    "decode": lambda d, l: bpe.bpe_decode(d.drop("ids").withColumn("ids", F.lit(None).cast("binary"))),
    "exact": lambda d, l: exact_dedup.exact_dedup(d),
    "groups": lambda d, l: minhash_dedup.near_groups(d),
    "html": lambda d, l: html_text.extract(d.withColumnRenamed("text", "html")),
    "lines": lambda d, l: line_dedup.line_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(hard, labels, name):
    out = OPERATORS[name](hard, labels)
    assert out.count() == hard.count()
    if "doc_id" in out.columns:
        assert sorted(r.doc_id or -1 for r in out.select("doc_id").collect()) == sorted(r[0] or -1 for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(hard, labels, name):
    assert OPERATORS[name](hard.limit(0), labels.limit(0)).count() == 0


def test_results_of_null_and_repeated_texts(hard):
    empty = {None, "", " \n\t "}
    own = {(r[0], r[1]): r for r in rows()}
    assert {r.n_words for r in substring_dedup.substring_dedup(hard).collect() if (r.text or "") == "" and r.n_removed == 0} == {0}
    groups = [r for r in minhash_dedup.near_groups(hard).collect()]
    assert sum(r.n_shingles == 0 for r in groups) == sum(t in empty for _, t in [(r[0], r[1]) for r in rows()])
    assert sum(r.kept for r in groups) == 4 + 1 + 1  # the empty texts, the long one, the short one
    exact = [r for r in exact_dedup.exact_dedup(hard).collect() if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(exact) == 4 and {r.group_size for r in exact} == {4}
    packed = packing.pack(hard).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()
    assert {r.doc_id: r.n for r in packed}[2] == 1 and len(own) == 9
    kept = minhash_dedup.near_dedup(hard)
    assert kept.columns == hard.columns and kept.count() == 6
    good = quality.quality_filter(hard, hard.select("doc_id", F.lit(1).alias("quality")).limit(0))
    assert good.columns == hard.columns and good.count() == hard.count()


def test_vectors_with_nulls_and_clashing_columns(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [2.0, 1.0], None), (1, [2.0, 1.0], "b"), (2, None, "c"), (None, [1.0, 1.0], "d"), (3, [], "e"), (50, [1.0, 2.0], "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _v string").withColumns({c: F.lit("x") for c in ("_id", "_q", "score", "rank", "query_id", "_pivot")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df).collect())
    assert got == [(0, 1, 50, 327680), (0, 2, 1, 262144), (50, 1, 0, 327680), (50, 2, 1, 262144)]
    assert mtree.top_k(df.limit(0)).count() == 0


def test_sparse_sites_follow_their_prior(spark):
    """One document of a host of its own is judged near the global rate, one of many on a bad host by its host."""
    good, bad = LONG, "## @@ 1234 %% ^^ && ((( ### $$$ 999 ||| ~~~ " * 6
    docs = [(i, good if i % 10 else bad, "en", "good") for i in range(300)] + [(1000 + i, bad if i % 10 else good, "en", "bad") for i in range(300)]
    docs += [(2000, good, "en", "alone"), (2001, good, "xx", "bad"), (2002, good, "en", "bad")]
    labels = [(i, int(t == good)) for i, t, _, h in docs if h in ("good", "bad") and i < 1300 and i % 3 == 0]
    out = {r.doc_id: r for r in quality.score(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    mean = sum(r.doc_prob for r in out.values()) / len(out)
    assert abs(out[2000].host_rate - mean) < 0.02 and abs(out[2000].path_rate - mean) < 0.02
    assert out[2002].host_rate < 0.2 < 0.8 < out[1].host_rate
    assert abs(out[2001].path_rate - out[2001].host_rate) < 0.02  # a path of its own follows the host
    assert out[2002].score < out[2000].score < out[1].score


def test_stages_on_hard_rows(spark, hard, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    hard.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.select(*corpus_pipeline.COLUMNS).limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 0
