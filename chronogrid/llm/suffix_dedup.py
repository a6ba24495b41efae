"""Suffix-array dedup of byte strings: sampled splitters, range-partitioned buckets, local sorts.

A full suffix array holds a suffix for every byte. Here the suffixes are those that start at
anchors: of the grams in a window of `length` bytes the one with the least hash, so equal
windows have equal anchors at equal distances, and one byte in about 85 starts a suffix. Every
window belongs to one anchor, so nothing is lost. Anchors whose gram occurs once are dropped;
how often one occurs is asked batch by batch (see repeats).

Each remaining suffix takes the bytes of its windows along and goes to the bucket whose range,
between splitters sampled from the corpus, holds its leading bytes. A leading string that is
more frequent than a bucket is large appears among the splitters several times: its suffixes
are dealt to all the buckets it spans. A bucket sorts its suffixes by multikey quicksort on
eight-byte characters as far as their windows reach. The common prefix with its neighbours in
that order bounds what a suffix may share with any other, so only windows whose part right of
the anchor lies within it remain; those are grouped by hash over both sides of the anchor, and
each group is compared byte by byte. Windows of leading strings that span buckets are then
compared across those boundaries, one for each bucket and window, by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, lean, lean_group, shuffle_partitions, table
from .repeats import MESSAGE, Often, answers, ask, bucket_bits, bucket_of
from .substring_dedup import batched, keyed_docs, places, rows_of, text_bytes, with_answers
from .tokens import small_batches
from .windows import RUN, anchors, between, by_document, cover, grams, runs, spread, sums, text_slices, verified

_STEP = 0xC2B2AE3D27D4EB4F | 1
#: A suffix: place of its document in the batch, start of its first window, number of windows, distance of the anchor, seen before in this batch, leading string spans buckets.
SUFFIX = np.dtype([("i", "<i4"), ("s", "<i4"), ("n", "<i4"), ("a", "<i4"), ("twice", "?"), ("wide", "?")])
#: A window that may lie in several buckets: its digest, its batch, place of its document there and start, seen twice.
WINDOW = np.dtype([("h", "S16"), ("b", "<i8"), ("i", "<i4"), ("s", "<i4"), ("twice", "?")])


def multikey_sort(keys: np.ndarray, few: int = 24) -> np.ndarray:
    """Order of rows of 8-byte characters: three-way partitioning by one character, equal parts go on with the next."""
    n, depth = keys.shape
    order = np.arange(n)
    raw = np.ascontiguousarray(keys.astype(">u8")).view(f"V{8 * depth}").ravel() if depth else None
    todo = [(0, n, 0)]
    while todo:
        low, high, at = todo.pop()
        if high - low < 2 or at == depth:
            continue
        rows = order[low:high]
        if high - low <= few:
            order[low:high] = sorted(rows.tolist(), key=lambda r: raw[r].tobytes())
            continue
        c = keys[rows, at]
        pivot = np.sort(c[:: max(1, len(c) // 9)])[-(-len(c[:: max(1, len(c) // 9)]) // 2) - 1]
        less, same = c < pivot, c == pivot
        parts = rows[less], rows[same], rows[~less & ~same]
        order[low:high] = np.concatenate(parts)
        a, b = low + len(parts[0]), low + len(parts[0]) + len(parts[1])
        todo += [(low, a, at), (a, b, at + 1), (b, high, at)]
    return order


def common_prefixes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row with the row before it in `order`; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = keys[order[1:]] ^ keys[order[:-1]]
        at = np.argmax(differ != 0, 1)
        x = differ[np.arange(len(differ)), at]
        width = np.zeros(len(x), np.int64)
        for b in range(1, 8):  # leading zero bytes of the first character that differs
            width += x < np.uint64(1 << 8 * b)
        out[1:] = np.where(x == 0, 8 * keys.shape[1], 8 * at + width)
    return out


class Shift:
    """x -> x + by, in place of an array of all places."""

    def __init__(self, by: int):
        self.by = by

    def __getitem__(self, x):
        return x + self.by


def _parts(sizes: np.ndarray, most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of stretches of about `most` bytes together."""
    upto, out, a = np.cumsum(sizes), [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes one after the other, where each text starts and the last one ends)."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), first


def alike(h: np.ndarray, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each one's equals, whether it has any) of stretches of bytes with hashes h, compared byte by byte."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    v = h[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rest = np.flatnonzero(head != np.arange(n))
    same = verified(data, at[order[rest]], at[order[head[rest]]], begin, end)
    first = np.arange(n)
    first[order[rest]] = order[head[rest]]
    for wrong in np.unique(v[rest[~same]]).tolist():  # two strings with one hash: by the strings themselves
        seen: dict[bytes, int] = {}
        for i in order[v == np.uint64(wrong)].tolist():
            first[i] = seen.setdefault(bytes(data[begin[at[i]] : end[at[i]]]), i)
    return first, np.bincount(first, minlength=n)[first] > 1


def suffix_dedup(df: DataFrame, length: int = 200, lead: int = 32, id_col: str = "doc_id", text_col: str = "text", sampled_docs: int = 4000) -> DataFrame:
    """One row per input row: <id_col>, kept (binary), n_bytes, n_removed, n_spans.

    Texts are UTF-8 bytes, null text is empty. Every byte goes that lies in a string of
    `length` bytes which also starts anywhere else in the table, in the same text or another;
    occurrences may overlap, matches stay within a text, and strings are judged on the input.
    n_spans counts maximal removed runs. Texts shorter than `length` stay whole. Rows that
    share an id, or have none, are texts of their own. An empty table gives an empty result;
    other columns are ignored. Splitters come from about `sampled_docs` documents; the sample
    shapes the buckets, not the result.
    """
    spark = df.sparkSession
    small_batches(spark)
    lead = min(lead, length)
    docs, _ = keyed_docs(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    size = text_bytes(docs)
    bits = bucket_bits(size // 40, shuffle_partitions(spark))
    # Ranges, and beyond what the driver should hold of splitters, parts of them by hash of the leading bytes: about 5 MB of text each.
    wanted = 2 ** bucket_bits(size // 40, shuffle_partitions(spark), 125_000)
    buckets = min(2**17, wanted)
    parts = wanted // buckets
    packed = batched(docs)

    def anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(bytes, where texts start, hash of each anchor's gram, and what `anchors` gives)."""
        data, first = _buffer(texts)
        g = grams(data.astype(np.uint64) + np.uint64(1), lead)
        found = anchors(g, first, lead, length)
        return data, first, g[found[1]], *found

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts, _, _ in rows_of(batches):
            yield ask(number, anchored(texts.to_pylist())[2], bits)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0)):
                data, _, _, _, place, _, _ = anchored(texts)
                pick = place[np.random.default_rng(5).permutation(len(place))[: 16 * (b - a)]]
                yield pa.record_batch([pa.array([data[p : p + lead].tobytes() for p in pick.tolist()], pa.binary())], names=["lead"])

    share = min(1.0, sampled_docs / max(1, docs.count()))
    seen = sorted(bytes(r["lead"]) for r in docs.select("_text").sample(share, 11).mapInArrow(lean(leads), "lead binary").collect())
    cuts = [seen[len(seen) * i // buckets] for i in range(1, buckets)] if seen else []
    # Splitters as rows of characters; their number is that of the buckets.
    splitters = np.array(cuts, f"S{lead}") if cuts else np.zeros(0, f"S{lead}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts, _, often in rows_of(batches):
            if not often:
                continue
            data, first, key, owner, place, start, count = anchored(texts.to_pylist())
            mine = Often(often, bits).of(key) > 1
            owner, place, start, count, key = owner[mine], place[mine], start[mine], count[mine], key[mine]
            if not len(owner):
                continue
            # Suffixes with the same bytes on both sides of the anchor: one of them stands for all.
            whole = sums(data.astype(np.uint64) + np.uint64(1), _STEP)
            end = start + count + length - 1
            sign = between(whole, start, end, _STEP) + (place - start).astype(np.uint64)
            same, twice = alike(sign, data, np.arange(len(owner)), start, end)
            one = np.empty(len(owner), SUFFIX)
            one["i"], one["s"], one["n"], one["a"], one["twice"] = owner, start - first[owner], count, place - start, twice
            gone = runs(owner[twice].repeat(count[twice]), spread(one["s"][twice].astype(np.int64), count[twice]))
            at = np.unique(same)
            strings = np.ascontiguousarray(data[place[at][:, None] + np.arange(lead)]).view(f"S{lead}").ravel()
            low, high = np.searchsorted(splitters, strings, "left"), np.searchsorted(splitters, strings, "right")
            wide = high - low > 1
            one["wide"][at] = wide
            to = np.where(wide, low + (sign[at] % (high - low + 1).astype(np.uint64)).astype(np.int64), high)
            to = to * parts + ((key[at] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            at, to = at[by], to[by]
            edge = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
            sizes = end[at] - start[at]
            text = data[spread(start[at], sizes)].tobytes()
            upto = np.concatenate([[0], np.cumsum(sizes)])
            rows = [(int(to[x]), one[at[x:y]].tobytes(), text[upto[x] : upto[y]]) for x, y in zip(edge[:-1], edge[1:])]
            if len(gone):  # windows known to go already pass through the buckets
                rows.append((bucket_of(number, bits), None, gone.tobytes()))
            yield pa.record_batch([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["_batch", "_bucket", "_suffixes", "_bytes"])

    def settle(t: pa.Table) -> pa.Table:
        numbers, gone, across, heads, bodies, of = t["_batch"].to_pylist(), [], [], [], [], []
        for r, (s, raw) in enumerate(zip(t["_suffixes"].to_pylist(), t["_bytes"].to_pylist())):
            if s is None:
                gone.append((numbers[r], raw))
            else:
                heads.append(np.frombuffer(s, SUFFIX))
                bodies.append(raw)
                of.append(np.full(len(heads[-1]), r))
        if heads:
            one, row, data = np.concatenate(heads), np.concatenate(of), np.frombuffer(b"".join(bodies), np.uint8)
            n, a = one["n"].astype(np.int64), one["a"].astype(np.int64)
            sizes = n + length - 1
            at = np.cumsum(sizes) - sizes
            # Bytes from the anchor on, as far as the windows reach, zeros after them.
            reach = sizes - a
            depth = -(-length // 8)
            more = np.concatenate([data, np.zeros(8 * depth, np.uint8)])
            keys = np.empty((len(one), depth), np.uint64)
            for x in range(0, len(one), 2048):
                chars = more[(at + a)[x : x + 2048, None] + np.arange(8 * depth)]
                chars[np.arange(8 * depth) >= reach[x : x + 2048, None]] = 0
                keys[x : x + 2048] = chars.view(">u8")
            order = multikey_sort(keys)
            common = common_prefixes(keys, order)
            most = np.empty(len(one), np.int64)
            most[order] = np.maximum(common, np.concatenate([common[1:], [0]]))
            most = np.where(one["wide"] | one["twice"], length, np.minimum(most, reach))
            # Window j has length - a + j bytes from the anchor on: those in which a neighbour agrees remain.
            left = np.clip(most - length + a + 1, 0, n)
            where, r = spread(at, left), np.repeat(np.arange(len(one)), left)
            h, upto = np.empty(len(where), np.uint64), np.concatenate([[0], np.cumsum(left)])
            for x, y in _parts(sizes):
                own, from_at = slice(int(upto[x]), int(upto[y])), int(at[x])
                some = sums(data[from_at : int(at[y - 1] + sizes[y - 1])].astype(np.uint64) + np.uint64(1), _STEP)
                h[own] = between(some, where[own] - from_at, where[own] - from_at + length, _STEP)
            first, twice = alike(h, data, where, Shift(0), Shift(length))
            # A suffix seen before in its batch: its windows go, and so do their equals.
            twice |= np.bincount(first, one["twice"][r], len(first))[first] > 0
            start = one["s"][r] + (where - at[r])
            key = row[r].astype(np.int64) << 32 | one["i"][r]
            gone += places(runs(key[twice], start[twice].astype(np.int64)), numbers)
            pick = np.flatnonzero(one["wide"][r] & (first == np.arange(len(first))))
            if len(pick):
                met = np.empty(len(pick), WINDOW)
                met["h"] = [hashlib.blake2b(data[x : x + length].tobytes(), digest_size=16, key=b"1").digest() for x in where[pick].tolist()]
                met["b"], met["i"], met["s"], met["twice"] = np.array(numbers, np.int64)[row[r[pick]]], one["i"][r[pick]], start[pick], twice[pick]
                spot = np.frombuffer(met["h"].tobytes(), "<u8")[::2] % np.uint64(wanted)
                for s in np.unique(spot).tolist():
                    across.append((s, met[spot == s].tobytes()))
        rows = [(b, bucket_of(b, bits), None, x) for b, x in gone] + [(0, s, x, None) for s, x in across]
        return pa.table([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.binary())], names=["_batch", "_bucket", "_met", "_gone"])

    def meet(t: pa.Table) -> pa.Table:
        gone = [(b, x) for b, x in zip(t["_batch"].to_pylist(), t["_gone"].to_pylist()) if x is not None]
        found = np.frombuffer(b"".join(x for x in t["_met"].to_pylist() if x is not None), WINDOW)
        if len(found):
            _, of, n = np.unique(found["h"], return_inverse=True, return_counts=True)
            found = found[(n[of] > 1) | (np.bincount(of, found["twice"])[of] > 0)]
            numbers, of = np.unique(found["b"], return_inverse=True)
            gone += places(runs(of.astype(np.int64) << 32 | found["i"], found["s"].astype(np.int64)), numbers.tolist())
        return pa.table([pa.array([b for b, _ in gone], pa.int64()), pa.array([x for _, x in gone], pa.binary())], names=["_batch", "_gone"])

    once = answers(packed.select("_batch", "_ids", "_texts", "_more").mapInArrow(lean(first_level), MESSAGE))
    dealt = with_answers(packed, once).mapInArrow(lean(deal), "_batch long, _bucket int, _suffixes binary, _bytes binary")
    local = dealt.groupBy("_bucket").applyInArrow(lean_group(settle), "_batch long, _bucket int, _met binary, _gone binary")
    gone = local.groupBy("_bucket").applyInArrow(lean_group(meet), "_batch long, _gone binary").groupBy("_batch").agg(F.collect_list("_gone").alias("_gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts, more, gone in rows_of(batches):
            lists = dict(zip(*by_document(np.frombuffer(b"".join(gone or []), RUN))))
            texts = texts.to_pylist()
            out, cut, spans = [], [], []
            for i, text in enumerate(texts):
                if i not in lists:
                    out.append(text)
                    cut.append(0)
                    spans.append(0)
                    continue
                off = cover([lists[i]], length, len(text))
                out.append(np.frombuffer(text, np.uint8)[~off].tobytes())
                cut.append(int(off.sum()))
                spans.append(int((off & ~np.concatenate([[False], off[:-1]])).sum()))
            yield pa.record_batch([more, pa.array(out, pa.binary()), pa.array(map(len, texts), pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, pa.int64())], names=["_more", "kept", "n_bytes", "n_removed", "n_spans"])

    id_type = docs.schema["_more"].dataType.simpleString()
    done = with_answers(packed, gone).mapInArrow(lean(strip), f"_more {id_type}, kept binary, n_bytes long, n_removed long, n_spans long")
    return done.select(F.col("_more.id").alias(id_col), "kept", "n_bytes", "n_removed", "n_spans")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null and empty texts have 0 bytes and the hash of the empty string. Repeated rows are texts of their own
    and remove each other where they are long enough; an empty table gives no rows.
    """
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


by_value(__name__)
