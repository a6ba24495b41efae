"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

Texts with the same lower-cased words are one node. A node's MinHash samples serve twice: in
bands of `rows` samples, whose buckets propose candidates, and folded into an odd sketch, a
bitmap in which every sample toggles one bit. The population count of two sketches' exclusive-or
estimates their similarity, most precisely where it is high, and only candidates that may reach
the threshold are confirmed on their full shingle sets.

Buckets don't emit all pairs. Every member is tried with its bucket's lead, another node in
each band; confirmed links are joined to components. In buckets that still hold several
components, members are tried with a second lead, the one whose shingles are most common there.
Those still apart from it meet others only through a shingle that both have among their rarest
(prefix filter: a linked pair always has one), so members of a large group that lie just below
the threshold, each by words of its own, do not meet at all. Shingles are ordered by how many
open nodes have them, counted exactly but for hash collisions; any order gives the same links.
Nothing is capped.

With 40 bands of 6 samples a pair shares no bucket with probability (1 - s^6)^40: 6e-9 at
similarity s = 0.85, 5e-6 at 0.80, less above. The sketch test allows six standard deviations
and refuses a pair right at the threshold with probability 1.4e-8 at 0.85, 2.9e-8 at 0.80. No
later step retries a pair refused after the prefix filter, so what is said of it above holds up
to these two.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, discard, distinct_ids, lean, materialize, shuffle_partitions, table
from .repeats import MESSAGE, Often, answers, ask, batch_numbers, bucket_bits
from .tokens import small_batches
from .windows import Words, grams, mix, text_slices

_LAST = 2**63 - 1
_LONGS = 16
SKETCH = 64 * _LONGS
#: Sizes of sets are in classes, each this many times the one before.
_RATIO = 1.05


def _family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng(20240501)
    return pick.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1), pick.integers(0, 2**63, samples, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of each hash function over the shingles, in blocks of bounded size."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * a + b).min(0), out=least)
    return least >> np.uint64(24)


def odd_sketch(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples, as rows of 64-bit integers."""
    n, k = signatures.shape
    bit = (mix(signatures + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * SKETCH + bit).ravel(), minlength=n * SKETCH).reshape(n, SKETCH) & 1
    return np.packbits(counts.astype(np.uint8), axis=1).view("<i8")


def most_bits(samples: int, least: float) -> int:
    """Bits in which the sketches of a pair at `least` may differ: six standard deviations above the mean.

    Of the samples, Binomial(samples, 1 - least) differ, and each toggles two bits.
    """
    differ, spread = samples * (1 - least), math.sqrt(samples * least * (1 - least))
    fade = math.exp(-4 * differ / SKETCH)
    bits = SKETCH / 2 * (1 - fade)
    own = math.sqrt(max(0.0, SKETCH / 4 * (1 - fade * fade))) * math.sqrt(differ / SKETCH)
    return math.ceil(bits + 6 * math.hypot(2 * fade * spread, own))


def _class(n: int) -> int:
    return math.floor(math.log(n) / math.log(_RATIO) + 1e-9)


def prefix_lengths(n: int, percent: int) -> list[tuple[int, int, bool]]:
    """(size class of the smaller set of a pair, how many of the rarest shingles must be searched, whether this set is it).

    Sets whose intersection holds t shingles or more share one among the first size - t + 1 of
    each in any common order, and a linked pair has t >= percent * (sum of sizes) / (100 + percent).
    """
    own, least = _class(n), -(-percent * n // 100)
    out = [(own, n, True)]
    for c in range(_class(least), own + 1):
        low = max(math.ceil(_RATIO**c - 1e-6), least)
        if low <= n and _class(low) == c:
            out.append((c, n + 1 - -(-percent * (n + low) // (100 + percent)), False))
    low = math.ceil(_RATIO**own - 1e-6)
    out[0] = (own, n + 1 - -(-percent * (n + min(low, n)) // (100 + percent)), True)
    return out


def _components(edges: DataFrame) -> DataFrame:
    """(_node, _root: the least node linked to it) of every node of an edge, as a written table, by alternating large and small stars on written tables."""
    now = materialize(edges.select("_a", "_b").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
        large = both.join(least, "_a").filter(F.col("_b") > F.col("_a")).select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        down = large.filter("_a != _b").distinct()
        small = down.groupBy("_a").agg(F.min("_b").alias("_m"))
        joined = down.join(small, "_a")
        after = materialize(joined.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(small.select("_a", F.col("_m").alias("_b"))).filter("_a != _b").distinct())
        discard(now)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
    out = materialize(roots.unionByName(now.select(F.col("_b").alias("_node"), F.col("_b").alias("_root")).distinct()))
    discard(now)
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, samples: int = 256) -> DataFrame:
    """One row per input row: <id_col>, n_shingles, component_id, kept.

    A text's set holds its distinct runs of `shingle` words, lower-cased A-Z, or its words as
    one where they are fewer. Texts are linked when 100 * intersection >= percent * union;
    component_id is the smallest id reachable and kept holds for one row of each component,
    which has this id. Texts without words (null, empty, blank) have an empty set and no
    links. Null ids rank after all others; a component of null ids only has a null
    component_id. Rows that share an id are documents of their own, ranked by a hash of their
    text. An empty table gives an empty result.
    """
    given = _documents(df, id_col, text_col)
    docs = distinct_ids(given)
    out = _groups(docs, shingle, percent, bands, rows, samples)
    kept = F.col("_id") == F.col("_component")
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    if docs is given:
        return out.select(known("_id").alias(id_col), F.col("_n").alias("n_shingles"), known("_component").alias("component_id"), kept.alias("kept"))
    ids = lambda key, name: docs.select(F.col("_id").alias(key), F.col("_given").alias(name))
    named = out.join(ids("_id", "_own"), "_id").join(ids("_component", "_least"), "_component")
    return named.select(F.col("_own").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_least").alias("component_id"), kept.alias("kept"))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, null as the last, _text, _given: the id as it is, _more: all columns)."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).cast("long").alias("_given"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_more"))


def _groups(rows_of: DataFrame, shingle: int, percent: int, bands: int, rows: int, samples: int) -> DataFrame:
    """(_id, _n: number of shingles, _component: least _id of the row's component) of rows with distinct _id."""
    spark = rows_of.sparkSession
    small_batches(spark, 4 * 2**20)  # hashes of words and bands take many times the text
    docs = rows_of.select("_id", "_text")
    a, b = _family(samples)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for x, y, texts in text_slices(batch.column(1)):
                low = [t.lower() for t in texts]
                w = Words(low)
                h = w.hashes()
                g = grams(h, shingle)
                names, sizes, own = [], [], []
                for i, (s, e) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    if s == e:
                        names.append(None)
                        sizes.append(0)
                        continue
                    found = np.unique(g[s : e - shingle + 1]) if e - s >= shingle else grams(h[s:e], e - s)
                    names.append(hashlib.blake2b(b" ".join(low[i].split()), digest_size=16).digest())
                    sizes.append(len(found))
                    own.append(signature(found, a, b))
                sig = np.stack(own) if own else np.zeros((0, samples), np.uint64)
                keys = np.stack([mix(grams(sig[:, j * rows : (j + 1) * rows].ravel(), rows)[::rows] + np.uint64(j)) if len(sig) else np.zeros(0, np.uint64) for j in range(bands)], 1).view(np.int64)
                odd = odd_sketch(sig) if len(sig) else np.zeros((0, _LONGS), np.int64)
                row, bs, os = 0, [], []
                for n in sizes:
                    bs.append(keys[row].tolist() if n else None)
                    os.append(odd[row].tolist() if n else None)
                    row += n > 0
                yield pa.record_batch([ids[x:y], pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bs, pa.list_(pa.int64())), pa.array(os, pa.list_(pa.int64()))], names=["_id", "_node", "_n", "_bands", "_odd"])

    sketched = materialize(docs.mapInArrow(lean(sketch), "_id long, _node binary, _n long, _bands array<long>, _odd array<long>"))
    # A node goes by its least _id, which then also names its component.
    reps = materialize(sketched.filter("_n > 0").groupBy("_node").agg(F.min("_id").alias("_rep")))
    nodes = sketched.join(reps.select(F.col("_rep").alias("_id")), "_id", "left_semi").select(F.col("_id").alias("_node"), "_bands", "_odd")
    spots = nodes.select("_node", F.explode("_bands").alias("_key")).repartition(F.col("_key"))
    # A bucket's lead is the node that comes first in an order of the bucket's own.
    own = F.xxhash64("_key")
    buckets = spots.groupBy("_key").agg(F.min(F.col("_node").bitwiseXOR(own)).alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    full = materialize(spots.join(buckets, "_key").select("_key", "_node", F.col("_first").bitwiseXOR(own).alias("_lead")))
    odd = materialize(nodes.join(full.select("_node").distinct(), "_node", "left_semi").select("_node", "_odd"))
    limit = most_bits(samples, percent / 100)

    def plausible(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (_a, _b) whose sketches allow the threshold, as a written table."""
        side = lambda s: odd.select(F.col("_node").alias(f"_{s}"), F.col("_odd").alias(f"_{s}_odd"))
        differ = sum((F.bit_count(F.col("_a_odd")[i].bitwiseXOR(F.col("_b_odd")[i])) for i in range(_LONGS)), F.lit(0))
        ordered = pairs.select(F.least(*pairs.columns).alias("_a"), F.greatest(*pairs.columns).alias("_b")).filter("_a != _b").distinct()
        return materialize(ordered.join(side("a"), "_a").join(side("b"), "_b").filter(differ <= limit).select("_a", "_b"))

    def texts_of(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(texts of the nodes in column _id, the written ids): a small table of ids, as the planner sees by its size, spares the shuffle of all texts."""
        ids = materialize(ids.distinct())
        return docs.join(ids, "_id", "left_semi"), ids

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough, as a written table; `pairs` is discarded."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def shingles(text: bytes) -> set:
                w = text.lower().split()
                return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)}

            for batch in batches:
                last, had, near = None, None, []
                for x, y, one in text_slices(batch.column(2)):
                    for i, s, t in zip(range(x, y), one, batch.column(3)[x:y].cast(pa.binary()).to_pylist()):
                        if s != last:
                            last, had = s, shingles(s)
                        other = shingles(t)
                        both = len(had & other)
                        if 100 * both >= percent * (len(had) + len(other) - both):
                            near.append(i)
                yield pa.record_batch([batch.column(c).take(pa.array(near, pa.int64())) for c in (0, 1)], names=["_a", "_b"])

        texts, ids = texts_of(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")))
        side = lambda s: texts.select(F.col("_id").alias(f"_{s}"), F.col("_text").alias(f"_{s}_text"))
        both = pairs.join(side("a"), "_a").join(side("b"), "_b")
        out = materialize(both.select("_a", "_b", "_a_text", "_b_text").mapInArrow(lean(check), "_a long, _b long"))
        discard(pairs, ids)
        return out

    links = confirmed(plausible(full.select("_lead", "_node")))
    roots = _components(links)
    rooted = lambda d, c, r: d.join(roots.select(F.col("_node").alias(c), F.col("_root").alias(r)), c, "left").withColumn(r, F.coalesce(r, c))
    # Buckets that still hold several components.
    placed = rooted(full.select("_key", "_node"), "_node", "_root")
    split = placed.groupBy("_key").agg(F.min("_root").alias("_x"), F.max("_root").alias("_y")).filter("_x != _y").select("_key")
    members = materialize(placed.join(split, "_key").select("_key", "_node"))
    texts, ids = texts_of(members.select(F.col("_node").alias("_id")))
    ranked = _ranked(texts.select(F.col("_id").alias("_node"), "_text"), shingle, percent)
    # A second lead: the member whose shingles the others have most often.
    leads = members.join(ranked.select("_node", "_mid"), "_node").groupBy("_key").agg(F.max_by("_node", F.struct("_mid", "_node")).alias("_lead"))
    led = materialize(members.join(leads, "_key").select("_node", "_lead").distinct())
    discard(full, members, ids)
    second = rooted(rooted(led, "_node", "_root"), "_lead", "_lead_root").filter("_root != _lead_root")
    links, roots = _joined(links, confirmed(plausible(second.select("_lead", "_node"))), roots)
    # The rest exactly: members apart from their second lead, by the prefixes of their rarest shingles.
    apart = rooted(rooted(led, "_node", "_root"), "_lead", "_lead_root").groupBy("_node", "_root").agg(F.max(F.col("_root") != F.col("_lead_root")).alias("_apart"))
    tagged = ranked.select("_node", "_n", "_alone", "_rare").join(apart, "_node").select("_node", "_n", "_alone", "_rare", "_root", "_apart")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, alone, rare, root, far = [batch.column(c).to_pylist() for c in range(6)]
            who, keys, small, places = [], [], [], []
            for i in range(len(names)):
                g = np.frombuffer(rare[i], "<u8")
                for c, reach, is_small in prefix_lengths(n[i], percent):
                    m = max(0, reach - alone[i])
                    if m:
                        keys.append(mix(g[:m] + np.uint64(c * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64))
                        places.append(np.arange(alone[i], alone[i] + m, dtype=np.int32))
                        who.append(np.full(m, i))
                        small.append(np.full(m, is_small))
            if who:
                at = pa.array(np.concatenate(who))
                took = [batch.column(c).take(at) for c in (0, 4, 5, 1)]
                yield pa.record_batch([*took, pa.array(np.concatenate(keys)), pa.array(np.concatenate(small)), pa.array(np.concatenate(places))], names=["_node", "_root", "_apart", "_size", "_k", "_small", "_p"])

    entries = materialize(tagged.mapInArrow(lean(prefixes), "_node long, _root long, _apart boolean, _size int, _k long, _small boolean, _p int"))
    # Keys within one component link nothing new.
    across = entries.groupBy("_k").agg(F.min("_root").alias("_x"), F.max("_root").alias("_y")).filter("_x != _y").select("_k")
    met_by = entries.join(across, "_k", "left_semi")
    side = lambda d, s: d.select("_k", *[F.col(c).alias(f"{c}_{s}") for c in ("_node", "_root", "_apart", "_p", "_size")])
    shorter, longer = side(met_by.filter("_small"), "s"), side(met_by.filter("not _small"), "l")
    test = F.expr(f"_root_s != _root_l and {100 + percent} * least(_size_s - _p_s, _size_l - _p_l) >= {percent} * (_size_s + _size_l)")
    met = [x.join(y, "_k").filter(test).select("_node_s", "_node_l") for x, y in ((shorter.filter("_apart_s"), longer), (shorter.filter("not _apart_s"), longer.filter("_apart_l")))]
    late = met[0].unionByName(met[1])
    links, roots = _joined(links, confirmed(plausible(late)), roots)
    discard(links, led, ranked, entries, odd)
    whole = reps.join(roots, reps["_rep"] == roots["_node"], "left").select(reps["_node"], F.coalesce("_root", "_rep").alias("_component"))
    out = sketched.select("_id", "_node", "_n").join(whole, "_node", "left").withColumn("_component", F.coalesce("_component", "_id"))
    return out.select("_id", "_n", "_component")


def _joined(links: DataFrame, more: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with further ones, and the components of all; written tables that are replaced are discarded."""
    if more.isEmpty():
        discard(more)
        return links, roots
    both = materialize(links.unionByName(more))
    discard(links, more, roots)
    return both, _components(both)


def _ranked(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The shingles of open nodes in common order, rarest first, as a written table.

    (_node, _n: how many, _alone: how many no other open node has, _mid: mean logarithm of how
    many have them, _rare: those after the lone ones as far as any prefix reaches, uint64.)
    Lone shingles come first and meet nobody, so they aren't kept.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = batch_numbers()
        for batch in batches:
            for x, y, slice_texts in text_slices(batch.column(1)):
                w = Words([t.lower() for t in slice_texts])
                h = w.hashes()
                g = grams(h, shingle)
                sets = [np.unique(g[s : e - shingle + 1]) if e - s >= shingle else grams(h[s:e], e - s) for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
                blob = np.concatenate(sets).astype("<u8").tobytes()
                yield pa.record_batch([pa.array([next(number)], pa.int64()), pa.array([batch.column(0)[x:y].to_pylist()], pa.list_(pa.int64())), pa.array([list(map(len, sets))], pa.list_(pa.int32())), pa.array([blob], pa.binary())], names=["_batch", "_nodes", "_sizes", "_sets"])

    packed = materialize(texts.mapInArrow(lean(pack), "_batch long, _nodes array<long>, _sizes array<int>, _sets binary"))
    size = packed.agg(F.sum(F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = bucket_bits(size, shuffle_partitions(texts.sparkSession))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield ask(number, np.frombuffer(blob, "<u8"), bits)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                names, sizes, blob, often = [batch.column(c)[i].as_py() for c in range(4)]
                g = np.frombuffer(blob, "<u8")
                count = Often(often, bits).of(g)
                by = np.lexsort((g, count, np.repeat(np.arange(len(sizes)), sizes)))
                g, count = g[by], count[by]
                alone, mid, rare, at = [], [], [], 0
                for n in sizes:
                    own = count[at : at + n]
                    one = int(np.searchsorted(own, 2))
                    alone.append(one)
                    mid.append(float(np.log(own).mean()))
                    rare.append(g[at + one : at + max(one, max(r for _, r, _ in prefix_lengths(n, percent)))].tobytes())
                    at += n
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(alone, pa.int32()), pa.array(mid, pa.float64()), pa.array(rare, pa.binary())], names=["_node", "_n", "_alone", "_mid", "_rare"])

    found = packed.join(answers(packed.select("_batch", "_sets").mapInArrow(lean(asked), MESSAGE)), "_batch", "left").select("_nodes", "_sizes", "_sets", "_often")
    out = materialize(found.mapInArrow(lean(rank), "_node long, _n int, _alone int, _mid double, _rare binary"))
    discard(packed)
    return out


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, samples: int = 256) -> DataFrame:
    """One row of each group, the one near_groups keeps, with all its columns."""
    docs = distinct_ids(_documents(df, id_col, text_col))
    kept = _groups(docs, shingle, percent, bands, rows, samples).filter("_id = _component").select("_id")
    return docs.join(kept, "_id", "left_semi").select("_more.*")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Null, empty and blank texts have 0 shingles and are components of their own; repeated rows are linked as
    equal texts, of which one is kept; an empty table gives no rows.
    """
    return near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


#: All pairs by common shingles, then everything reachable; DuckDB.
OP8_SQL = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
     s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as k from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from t where len(w) > 0)),
     n as (select doc_id, count(*) as n from s group by doc_id),
     p as (select a.doc_id as a, b.doc_id as b from s a join s b on a.k = b.k and a.doc_id <> b.doc_id
           join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id where 100 * y.n >= 85 * x.n and 100 * x.n >= 85 * y.n
           group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
     r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
select t.doc_id, coalesce(n.n, 0) as n_shingles, least(t.doc_id, coalesce(min(r.b), t.doc_id)) as component_id,
       t.doc_id = least(t.doc_id, coalesce(min(r.b), t.doc_id)) as kept
from t left join n on n.doc_id = t.doc_id left join r on r.a = t.doc_id group by t.doc_id, n.n
"""


by_value(__name__)
