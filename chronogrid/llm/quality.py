"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model on a few surface features gives each document's own evidence. Grouped sums of
those probabilities give every host and every path of a host a posterior rate: a host's rate is
shrunk toward the global one, a path's toward its host's, by prior strengths estimated from the
spread between sites (method of moments), so sparse sites follow their prior. A document's odds
are its evidence, as a likelihood ratio, times the odds of its path's rate, where both rates are
taken without the document itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, lean, materialize, table
from .tokens import small_batches

N_FEATURES = 9
_LEAST = 1e-6


def features(text: str) -> list[float]:
    """Shares of symbols, digits, capitals, punctuation; word length; repetition; length; lines."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(counts.sum()))
    split = text.split()
    w = max(1, len(split))
    capitals, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    letters = capitals + int(counts[97:123].sum()) + int(counts[128:].sum())
    space = int(counts[32] + counts[9:14].sum())
    marks = int(counts[np.frombuffer(b".,;:!?'\"-", np.uint8)].sum())
    return [1.0, (n - letters - space - digits - marks) / n, digits / n, capitals / n, marks / n, min(n / w, 40.0), len(set(split)) / w, math.log(w), int(counts[10]) / w]


def _features(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """`columns` of docs and the features of each text."""
    small_batches(docs.sparkSession)
    source = docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"), "_x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(len(columns)).to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[:-1], x], names=[*columns, "_x"])

    return source.mapInArrow(lean(run), schema)


def fit(rows: list[tuple[list[float], int]]) -> tuple[list[float], float]:
    """(weights on raw features, share of good documents): ridge logistic regression by Newton's method.

    Without both classes the weights are zero, and every document is as good as its site.
    """
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return [0.0] * N_FEATURES, 0.5
    x = np.array([r[0] for r in rows])
    mean, sd = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.c_[np.ones(len(y)), (x[:, 1:] - mean) / sd]
    w = np.zeros(N_FEATURES)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(N_FEATURES)
        step = np.linalg.solve(h, z.T @ (y - p) - np.r_[0, w[1:]])
        w += step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[1:] / sd
    return [float(w[0] - raw @ mean), *map(float, raw)], float(y.mean())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000) -> tuple[list[float], float]:
    """Fit on at most `most` labelled rows, those whose ids hash lowest; the bound makes the broadcast and the fit small."""
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    known = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).join(F.broadcast(chosen), "_id")
    # Where documents share a labelled id, the join has more rows than were chosen: the bound holds for them too.
    found = _features(known, ["_id", "_y"], text_col).orderBy(F.xxhash64("_id"), "_id", "_y", F.xxhash64("_x")).limit(most)
    return fit([(r["_x"], r["_y"]) for r in found.select("_x", "_y").collect()])


def _rate(own: Column, total: Column, n: Column, strength: float, prior: Column) -> Column:
    return (total - own + F.lit(strength) * prior) / (n - 1 + F.lit(strength))


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level: m(1 - m) / between-group variance - 1, from columns _s (sum), _n (rows), _v (sum of p(1-p)), _m (rate above)."""
    r = groups.filter("_n > 1").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.col("_m"), 2)).alias("spread"), F.sum(F.col("_v") / F.col("_n")).alias("noise"), F.sum(F.col("_n") * F.col("_m") * (1 - F.col("_m"))).alias("within")).first()
    if not r["n"]:
        return 10.0
    between = (r["spread"] - r["noise"]) / r["n"]
    return float(min(1e4, max(2.0, (r["within"] / r["n"]) / max(between, 1e-9) - 1)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.2, most_labelled: int = 20_000) -> DataFrame:
    """One row per document: <id_col>, doc_prob, host_rate, path_rate, score, kept (score >= threshold).

    A null host or path is a site of its own; null text counts as empty; labels with nulls are
    left out; a null id can't be labelled but is scored. Repeated rows each count. An empty
    table gives an empty result, and without labels of both classes every document is kept.
    """
    weights, base = train(docs, labels, id_col, text_col, label_col, most_labelled)
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("_host"), F.coalesce(F.col(path_col).cast("string"), F.lit("\x00")).alias("_path"), F.col(text_col))
    x = _features(plain, ["_id", "_host", "_path"], text_col)
    logit = sum((F.col("_x")[i] * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))
    p = 1 / (1 + F.exp(-logit))
    scored = materialize(x.select("_id", "_host", "_path", F.least(F.lit(1 - _LEAST), F.greatest(F.lit(_LEAST), p)).alias("_p")))
    q = F.col("_p")
    paths = scored.groupBy("_host", "_path").agg(F.sum("_p").alias("_ps"), F.count(F.lit(1)).alias("_pn"), F.sum(q * (1 - q)).alias("_pv"))
    hosts = paths.groupBy("_host").agg(F.sum("_ps").alias("_hs"), F.sum("_pn").alias("_hn"), F.sum("_pv").alias("_hv"))
    whole = hosts.agg(F.sum("_hs").alias("s"), F.sum("_hn").alias("n")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    host_k = _strength(hosts.select(F.col("_hs").alias("_s"), F.col("_hn").alias("_n"), F.col("_hv").alias("_v"), F.lit(mean).alias("_m")))
    sites = paths.join(hosts, "_host")
    path_k = _strength(sites.select(F.col("_ps").alias("_s"), F.col("_pn").alias("_n"), F.col("_pv").alias("_v"), ((F.col("_hs") + host_k * mean) / (F.col("_hn") + host_k)).alias("_m")))
    odds = lambda c: c / (1 - c)
    out = scored.join(sites, ["_host", "_path"])
    out = out.withColumn("_hr", _rate(q, F.col("_hs"), F.col("_hn"), host_k, F.lit(mean)))
    out = out.withColumn("_pr", _rate(q, F.col("_ps"), F.col("_pn"), path_k, F.col("_hr")))
    o = odds(q) / F.lit(base / (1 - base)) * odds(F.col("_pr"))
    s = o / (1 + o)
    return out.select(F.col("_id").alias(id_col), q.alias("doc_prob"), F.col("_hr").alias("host_rate"), F.col("_pr").alias("path_rate"), s.alias("score"), (s >= F.lit(threshold)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that `score` keeps, with all their columns; rows that share an id go only if all are rejected."""
    kept = score(docs, labels, id_col, **options).filter("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_prob, host_rate, path_rate, score, kept of every document; null and empty texts are scored too, an empty table gives no rows."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


by_value(__name__)
