"""Exact top-k search by inner product, best first over M-trees.

Vectors x become (x, sqrt(M^2 - |x|^2)) with M the largest norm, queries (q, 0): then
d^2 = |q|^2 + M^2 - 2 q.x, so the k nearest are the k with the highest inner products. Equal
vectors are one entry with their k + 1 smallest ids. Entries are dealt to their nearest pivot,
of which there are more the more entries there are, and each pivot's entries are cut by their
distance from it into rings, and these into pages of bounded size. Each page is an M-tree whose
nodes hold routing vector, covering radius and distance to the parent's routing vector, and
whose leaf entries hold their distance to the leaf's. Queries go, in blocks, first to one page,
the one that may lie nearest, then to every page whose ring reaches within the distance found
so far, by |d(q, pivot) - ring|. A search pops the node with the least possible distance,
beginning with the page's own ball, skips children and entries by |d(q, parent) - stored
distance| without computing, and ends when no node can improve.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, lean, materialize, table

_SLACK = 1e-7
#: Up to this squared norm doubles hold all inner products exactly; up to _MOST they fit a long.
_EXACT, _MOST = 2.0**53, 2.0**62
_RINGS = 64


class Page:
    """An M-tree over the rows of `vectors` (integers, held as doubles where these are exact), bulk loaded."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], big: float, leaf: int = 256, fan: int = 24):
        self.vectors, self.ids = vectors, ids
        self.tail = _tail(vectors, big)
        self.nodes: list[tuple] = []  # (kids or None, entries, distances to this node's routing vector, kids' radii)
        self.pick = np.random.default_rng(7)
        self.leaf, self.fan = leaf, fan
        self.centre = 0
        self.root, self.radius = self.build(np.arange(len(vectors)), 0)

    def stored(self) -> bytes:
        return pickle.dumps((self.vectors, self.ids, self.nodes, self.root, self.radius, self.centre), 5)

    @classmethod
    def read(cls, raw: bytes) -> "Page":
        page = cls.__new__(cls)
        page.vectors, page.ids, page.nodes, page.root, page.radius, page.centre = pickle.loads(raw)
        return page

    def far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.vectors[rows].astype(float) - self.vectors[centre].astype(float)
        return np.sqrt((d * d).sum(1) + (self.tail[rows] - self.tail[centre]) ** 2)

    def build(self, rows: np.ndarray, centre: int) -> tuple[int, float]:
        d = self.far(rows, centre)
        if len(rows) <= self.leaf:
            self.nodes.append((None, rows, d, None))
            return len(self.nodes) - 1, float(d.max())
        centres = self.pick.choice(rows, min(self.fan, -(-2 * len(rows) // self.leaf)), replace=False)
        near = np.argmin(np.stack([self.far(rows, c) for c in centres]), 0)
        if np.bincount(near).max() == len(rows):
            near = np.arange(len(rows)) % len(centres)
        kids, own, radii = [], [], []
        for i, c in enumerate(centres):
            part = rows[near == i]
            if len(part):
                kid, r = self.build(part, int(c))
                kids.append(kid)
                own.append(int(c))
                radii.append(r)
        at = np.array(own)
        self.nodes.append((np.array(kids), at, self.far(at, centre), np.array(radii)))
        return len(self.nodes) - 1, float(d.max())

    def search(self, q: np.ndarray, own: int, k: int, big: float, least: float) -> list[tuple[float, int]]:
        """Up to k (score, id), best first; `least`: a score that k others are known to reach."""
        qq = float(q.astype(float) @ q.astype(float)) + big
        away = lambda s: np.sqrt(np.maximum(0.0, qq - 2.0 * s))
        if big > _EXACT and least > -np.inf:  # known as a double only
            least -= abs(least) * 1e-12
        room = 1 + _SLACK
        best: list[tuple[float, int]] = []  # a heap, worst first, of (score, -id)
        bound = float(away(least)) * room + 1e-6 if least > -np.inf else np.inf
        start = float(away(self.vectors[self.centre] @ q))
        heap = [(max(0.0, start - self.radius), self.root, start)]
        while heap:
            low, node, d = heapq.heappop(heap)
            if low > bound:
                break
            kids, rows, stored, radii = self.nodes[node]
            if kids is None:
                rows = rows[np.abs(d - stored) <= bound]
                if not len(rows):
                    continue
                scores = self.vectors[rows] @ q
                # Of k + 1 entries one at most is the query itself alone: lower ones can't be among the k best.
                cut = least if len(scores) <= k + 1 else max(least, np.partition(scores, -k - 1)[-k - 1].item())
                hits = np.flatnonzero(scores >= cut)
                for s, row in zip(scores[hits].tolist(), rows[hits].tolist()):
                    for i in self.ids[row]:
                        if i != own:
                            if len(best) < k:
                                heapq.heappush(best, (s, -i))
                            elif (s, -i) > best[0]:
                                heapq.heapreplace(best, (s, -i))
                if len(best) == k and best[0][0] > least:
                    least = best[0][0]
                    bound = float(away(least)) * room + 1e-6
                continue
            near = np.flatnonzero(np.abs(d - stored) - radii <= bound)
            dist = away(self.vectors[rows[near]] @ q)
            lows = np.maximum(0.0, dist - radii[near])
            for j in np.flatnonzero(lows <= bound).tolist():
                heapq.heappush(heap, (float(lows[j]), int(kids[near[j]]), float(dist[j])))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _tail(x: np.ndarray, big: float) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt(np.maximum(0.0, big - (x * x).sum(1)))


def _valid(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(_id, _v: little-endian int64 components, _d: their number, _nn: squared norm) of vectors without null or non-finite components."""
    for batch in batches:
        ids, out, norms = [], [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is not None and x and None not in x and np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    a = np.floor(scale * np.array(x, float))
                    norm = float(a @ a)
                ids.append(i)
                norms.append(norm)
                out.append((a if norm <= _MOST else np.zeros(len(a))).astype("<i8").tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array([len(a) // 8 for a in out], pa.int32()), pa.array(norms, pa.float64())], names=["_id", "_v", "_d", "_nn"])


def _read(v: bytes, big: float = 0.0) -> np.ndarray:
    """Components as doubles, or as integers where `big`, the largest squared norm, is too large for exact doubles."""
    x = np.frombuffer(v, "<i8")
    return x if big > _EXACT else x.astype(float)


def top_k(df: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, every: int = 50, pivots: int = 16, page_rows: int = 4096, block: int = 256, most_pivots: int = 1024) -> DataFrame:
    """query_id, rank (from 1), <id_col>, score: the k rows with the highest integer inner products for each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`;
    rows with the query's own id are no candidates. Ties go to the smaller id; with fewer than
    k candidates all are returned. Null ids, and vectors that are null, empty or hold null or
    non-finite components take no part; vectors of different lengths aren't compared, and each
    length, however many there are, is a search of its own. Rows that repeat id and vector count
    once. An empty table gives an empty result. Scores are exact: as doubles while squared norms
    are at most 2^53, as integers up to 2^62; above, products needn't fit a long, and the query
    ends in a ValueError. There are `pivots` pivots, more beyond `pivots` * 16 pages, at most
    `most_pivots`; the driver holds a sample of 8 vectors for each.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(lean(lambda b: _valid(b, scale)), "_id long, _v binary, _d int, _nn double").distinct()
    rows = materialize(rows)
    parts = [_search(rows.filter(F.col("_d") == d), k, every, pivots, page_rows, block, most_pivots) for d in _lengths(rows)]
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_id", id_col)


def _lengths(rows: DataFrame) -> list[int]:
    return sorted(r["_d"] for r in rows.select("_d").distinct().collect())


def _search(rows: DataFrame, k: int, every: int, pivots: int, page_rows: int, block: int, most_pivots: int) -> DataFrame:
    n_rows, big = rows.agg(F.count(F.lit(1)), F.max("_nn")).first()
    if big > _MOST:
        raise ValueError(f"a vector's squared norm is {big}: inner products above 2^62 needn't fit a long")
    pivots = max(pivots, min(most_pivots, n_rows // (16 * page_rows)))
    first = W.partitionBy("_v").orderBy("_id")
    entries = rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k + 1).groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    sample = [_read(r["_v"]) for r in rows.orderBy(F.xxhash64("_v"), "_id").limit(8 * pivots).select("_v").distinct().collect()]
    centres = [sample[0]]  # farthest-first over the sample
    gap = np.full(len(sample), np.inf)
    every_one = np.stack(sample)
    while len(centres) < min(pivots, len(sample)):
        gap = np.minimum(gap, ((every_one - centres[-1]) ** 2).sum(1))
        if gap.max() == 0:
            break
        centres.append(sample[int(gap.argmax())])
    c = np.stack(centres)
    tail = _tail(c, big)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_pylist()
            if v:
                x = np.stack([_read(b) for b in v])
                d2 = big + big - 2 * (x @ c.T + _tail(x, big)[:, None] * tail)
                near = d2.argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(np.sqrt(np.maximum(0.0, d2.min(1))), pa.float64())], names=["_v", "_ids", "_pivot", "_far"])

    dealt = materialize(entries.mapInArrow(lean(deal), "_v binary, _ids array<long>, _pivot int, _far double"))
    # Each pivot's distances in up to _RINGS rings of about as many pages each.
    shares = [i / _RINGS for i in range(1, _RINGS)]
    balls = {r["_pivot"]: r for r in dealt.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n"), F.min("_far").alias("low"), F.max("_far").alias("high"), F.percentile_approx("_far", shares, 1000).alias("cuts")).collect()}
    pages = {p: -(-r["n"] // page_rows) for p, r in balls.items()}
    edges = {}
    for p, r in balls.items():
        m = min(_RINGS, pages[p])
        edges[p] = np.array([r["low"], *[r["cuts"][_RINGS * j // m - 1] for j in range(1, m)], r["high"]])
    parts = {p: -(-pages[p] // _RINGS) for p in pages}
    # All rings: pivot, number, least and greatest distance from the pivot.
    ring_p, ring_r, ring_low, ring_high = (np.array(x) for x in zip(*[(p, j, e[j], e[j + 1]) for p, e in sorted(edges.items()) for j in range(len(e) - 1)]))

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = []
            for v, p, far in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                ring = int(np.searchsorted(edges[p][1:-1], far, "left"))
                page.append(ring * parts[p] + zlib.crc32(v) % parts[p])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(page, pa.int32())], names=["_v", "_ids", "_pivot", "_page"])

    def load(key, pdf):
        import pandas as pd

        page = Page(np.stack([_read(v, big) for v in pdf["_v"]]), [list(map(int, i)) for i in pdf["_ids"]], big)
        return pd.DataFrame({"_pivot": [key[0]], "_page": [key[1]], "_tree": [page.stored()]})

    trees = materialize(dealt.mapInArrow(lean(paged), "_v binary, _ids array<long>, _pivot int, _page int").groupBy("_pivot", "_page").applyInPandas(load, "_pivot int, _page int, _tree binary"))

    def route(first_round: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vs, least, to, page, bound = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], [], []
                out_i, out_v = [], []
                for i, v, s in zip(ids, vs, least):
                    q = _read(v)
                    d = np.sqrt(np.maximum(0.0, q @ q + big - 2 * (c @ q)))[ring_p]
                    # No entry of a ring is nearer to the query than this.
                    low = np.maximum(0.0, np.maximum(ring_low - d, d - ring_high))
                    best = int(np.lexsort((d, low))[0])
                    if first_round:
                        went = [(best, 0)]
                    else:
                        most = np.sqrt(max(0.0, q @ q + big - 2 * s)) * (1 + _SLACK) + 1e-6 if s is not None else np.inf
                        went = [(r, x) for r in np.flatnonzero(low * (1 - _SLACK) <= most).tolist() for x in range(parts[int(ring_p[r])]) if r != best or x]
                    for r, x in went:
                        out_i.append(i)
                        out_v.append(v)
                        to.append(int(ring_p[r]))
                        page.append(int(ring_r[r]) * parts[int(ring_p[r])] + x)
                        bound.append(s)
                yield pa.record_batch([pa.array(out_i, pa.int64()), pa.array(out_v, pa.binary()), pa.array(bound, pa.float64()), pa.array(to, pa.int32()), pa.array(page, pa.int32())], names=["_q", "_v", "_least", "_pivot", "_page"])

        return run

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                page, got = Page.read(batch.column(0)[at].as_py()), []
                for r in batch.column(1)[at].as_py():
                    s = r["_least"]
                    got += [(r["_q"], i, int(x)) for x, i in page.search(_read(r["_v"], big), r["_q"], k, big, -np.inf if s is None else s)]
                if got:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*got)], names=["_q", "_id", "score"])

    def visit(queries: DataFrame, first_round: bool) -> DataFrame:
        routed = queries.mapInArrow(lean(route(first_round)), "_q long, _v binary, _least double, _pivot int, _page int")
        # Blocks of about `block` queries by hash: no block grows with the number of queries.
        n = max(1, -(-n_queries // block))
        blocks = routed.groupBy("_pivot", "_page", F.pmod(F.xxhash64("_q"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("_q", "_v", "_least")).alias("_queries"))
        return trees.join(blocks, ["_pivot", "_page"]).select("_tree", "_queries").mapInArrow(lean(walk), "_q long, _id long, score long")

    queries = rows.filter(F.col("_id") % every == 0).select(F.col("_id").alias("_q"), "_v").distinct()
    n_queries = queries.count()
    order = W.partitionBy("_q").orderBy(F.desc("score"), "_id")
    near = materialize(visit(queries.withColumn("_least", F.lit(None).cast("double")), True).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k))
    known = near.filter(F.col("_rank") == k).select("_q", F.col("score").cast("double").alias("_least"))
    rest = visit(queries.join(known, "_q", "left").select("_q", "_v", "_least"), False)
    both = near.select("_q", "_id", "score").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("_q").alias("query_id"), F.col("rank").cast("int"), "_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of every query, all where there are fewer.

    Null ids, null or empty vectors and vectors with null or non-finite components take no part; rows that
    repeat id and vector count once; an empty table gives no rows.
    """
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
           from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""

by_value(__name__)
