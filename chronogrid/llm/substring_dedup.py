"""Substring dedup by level-wise doubling of word windows.

Level `window` / 4: of the grams of that length in a window, each window takes the one with the
least hash, so equal windows take equal grams, one gram in about eight words. Windows whose
gram occurs once end there. Level `window` / 2: the grams that remain are doubled within their
window, to the right where the window has room and else to the left, and those that occur once
end. Level `window`: what is left is compared in full, and a window goes when an equal one
starts earlier. The contract judges windows of this length, so no candidates survive it.

Documents lie in packed batches. The first two levels ask batch by batch how often a gram
occurs (see repeats), so a gram that a third of all documents share costs one entry for each
batch. For the last level, windows that follow each other travel as one stretch of text to the
range of their gram; of equal stretches a batch sends only the first. There windows are sorted
by hash, and each is compared with the first of its hash byte by byte before it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, distinct_ids, lean, lean_group, shuffle_partitions, table
from .repeats import MESSAGE, Often, answers, ask, batch_numbers, bucket_bits, bucket_of
from .tokens import small_batches
from .windows import LUT, RUN, Words, anchors, between, by_document, cover, grams, row_slices, runs, spread, sums, verified

_NO_ID = 2**63 - 1
_STEP = 0x9E3779B97F4A7C15 | 1
#: Windows of a document that follow each other: its id, its place in the batch, first start, how many, bytes of their text.
STRETCH = np.dtype([("d", "<i8"), ("i", "<i4"), ("s", "<i4"), ("n", "<i4"), ("b", "<i4")])


def keyed_docs(df: DataFrame, id_col: str, text_col: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(_id: one for each row, _text, _more: the other columns); null ids come last."""
    other = [c for c in df.columns if c not in (text_col, *drop)]
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in other]).alias("_more"))
    return distinct_ids(docs), other


def batched(docs: DataFrame) -> DataFrame:
    """(_batch, _ids, _texts, _more): documents in rows of about 3 MB of text.

    All joins on _batch read the same columns, so that they share one exchange of the texts. An
    input that comes out of a shuffle should be written first: a task that is run again must
    find its rows in the same order.
    """
    more = docs.schema["_more"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = batch_numbers()
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c)[a:b]) for c in range(3)]
                yield pa.record_batch([pa.array([next(number)], pa.int64()), *lists], names=["_batch", "_ids", "_texts", "_more"])

    return docs.select("_id", "_text", "_more").mapInArrow(lean(run), f"_batch long, _ids array<long>, _texts array<string>, _more array<{more}>")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, pa.Array, list | None]]:
    """(batch number, ids, texts as binary, other columns, what the join added) of each packed batch."""
    for batch in batches:
        for i in range(len(batch)):
            lists = [batch.column(c)[i].values for c in (1, 2, 3)]
            yield batch.column(0)[i].as_py(), lists[0], lists[1].cast(pa.binary()), lists[2], batch.column(4)[i].as_py() if batch.num_columns > 4 else None


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0


def with_answers(packed: DataFrame, got: DataFrame) -> DataFrame:
    """Packed batches with what each was answered, null for none: outer joins all, so that their sides of texts are one exchange."""
    return packed.join(got, "_batch", "left").select("_batch", "_ids", "_texts", "_more", got.columns[1])


def doubled(owner: np.ndarray, place: np.ndarray, start: np.ndarray, count: np.ndarray, k: int, half: int, window: int) -> tuple[np.ndarray, ...]:
    """(document, place of the gram of `half` units, first window start, number) of anchors of `k` units.

    Windows with room for `half` units from the anchor on extend it to the right, the others to the left.
    """
    turn = np.clip(place + half - window - start, 0, count)  # windows that start before this one extend to the left
    left, right = turn > 0, turn < count
    return tuple(np.concatenate(x) for x in ((owner[left], owner[right]), (place[left] + k - half, place[right]), (start[left], (start + turn)[right]), (turn[left], (count - turn)[right])))


def later(found: np.ndarray, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows go: those with the bytes of one that comes first in (d, s).

    found: structured, with h, d, s; window i lies at place at[i] of begin and end.
    """
    by = np.lexsort((found["s"], found["d"], found["h"]))
    h = found["h"][by]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    rest = np.flatnonzero(head != np.arange(len(h)))
    same = verified(data, at[by[rest]], at[by[head[rest]]], begin, end)
    out = np.zeros(len(found), bool)
    first = by[head[rest]]
    # A window may have travelled twice: its own place isn't an earlier one.
    apart = (found["d"][by[rest]] != found["d"][first]) | (found["s"][by[rest]] != found["s"][first])
    out[by[rest]] = same & apart
    for h_wrong in np.unique(h[rest[~same]]).tolist():  # two texts with one hash: by the texts themselves
        seen: dict[bytes, tuple] = {}
        for i in by[h == np.uint64(h_wrong)].tolist():
            text, spot = bytes(data[begin[at[i]] : end[at[i]]]), (int(found["d"][i]), int(found["s"][i]))
            out[i] = seen.setdefault(text, spot) != spot
    return out


def substring_dedup(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns with `text_col` reduced to its kept words, joined by one space, and n_words, n_removed.

    A word goes when a window of `window` words over it has the same words as a window that
    starts earlier: in a document of smaller id, or before it in the same one. Windows are
    judged on the input. Null text has no words; a text shorter than a window keeps all.
    Null ids rank after all others (as id 2^63 - 1); rows that share an id are documents of
    their own, ranked by a hash of their text. Columns n_words and n_removed of df are
    replaced. An empty table gives an empty one.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs, other = keyed_docs(df, id_col, text_col, ("n_words", "n_removed"))
    k = max(1, window // 4)
    half = max(k, window // 2)
    bits = bucket_bits(text_bytes(docs) // 40, shuffle_partitions(spark))
    packed = batched(docs)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts, _, _ in rows_of(batches):
            w = Words(texts.to_pylist())
            g = grams(w.hashes(), k)
            yield ask(number, g[anchors(g, w.first, k, window)[1]], bits)

    def second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts, _, often in rows_of(batches):
            if not often:
                continue
            w = Words(texts.to_pylist())
            h = w.hashes()
            g = grams(h, k)
            found = anchors(g, w.first, k, window)
            mine = Often(often, bits).of(g[found[1]]) > 1
            _, place, _, _ = doubled(*[x[mine] for x in found], k, half, window)
            yield ask(number, grams(h, half)[place], bits)

    def full_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts, _, often in rows_of(batches):
            if not often:
                continue
            w = Words(texts.to_pylist())
            h = w.hashes()
            g = grams(h, half)
            owner, place, start, count = doubled(*anchors(grams(h, k), w.first, k, window), k, half, window)
            mine = Often(often, bits).of(g[place]) > 1
            owner, place, start, count = owner[mine], place[mine], start[mine], count[mine]
            if not len(owner):
                continue
            # The words with one space after each.
            size = w.ends - w.starts + 1
            begin = np.cumsum(size) - size
            data = np.full(int(size.sum()), 32, np.uint8)
            data[spread(begin, size - 1)] = w.buffer[~LUT[w.buffer]]
            last = start + count + window - 2
            one = np.empty(len(owner), STRETCH)
            one["d"], one["i"], one["s"], one["n"] = ids.to_numpy()[owner], owner, start - w.first[owner], count
            one["b"] = begin[last] + size[last] - begin[start]
            whole = np.empty(len(owner), [("h", "<u8"), ("d", "<i8"), ("s", "<i8")])
            whole["h"], whole["d"], whole["s"] = between(sums(h, _STEP), start, last + 1, _STEP), one["d"], one["s"]
            # Each stretch is a window of its own size here: place i of `from_at` and `to_at`.
            from_at, to_at = begin[start], begin[start] + one["b"]
            known = later(whole, data, np.arange(len(owner)), from_at, to_at)
            bucket = (g[place] >> np.uint64(64 - bits)).astype(np.int64)
            keep = np.flatnonzero(~known)
            keep = keep[np.argsort(bucket[keep], kind="stable")]
            of = bucket[keep]
            edge = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            text = data[spread(from_at[keep], one["b"][keep].astype(np.int64))].tobytes()
            upto = np.concatenate([[0], np.cumsum(one["b"][keep], dtype=np.int64)])
            rows = [(int(of[a]), one[keep[a:b]].tobytes(), text[upto[a] : upto[b]]) for a, b in zip(edge[:-1], edge[1:])]
            gone = runs(owner[known].repeat(count[known]), spread(one["s"][known].astype(np.int64), count[known]))
            if len(gone):
                rows.append((bucket_of(number, bits), None, gone.tobytes()))
            yield pa.record_batch([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["_batch", "_bucket", "_heads", "_blob"])

    def settle(t: pa.Table) -> pa.Table:
        numbers, gone, heads, texts, of = t["_batch"].to_pylist(), [], [], [], []
        for row, (head, blob) in enumerate(zip(t["_heads"].to_pylist(), t["_blob"].to_pylist())):
            if head is None:
                gone.append((numbers[row], blob))
            else:
                heads.append(np.frombuffer(head, STRETCH))
                texts.append(blob)
                of.append(np.full(len(heads[-1]), row))
        if heads:
            one, row = np.concatenate(heads), np.concatenate(of)
            w = Words([b"".join(texts)])
            n = one["n"].astype(np.int64)
            words = n + window - 1
            first = np.cumsum(words) - words
            at, whose = spread(first, n), np.repeat(np.arange(len(one)), n)
            found = np.empty(len(at), [("h", "<u8"), ("d", "<i8"), ("s", "<i4")])
            found["h"], found["d"], found["s"] = grams(w.hashes(), window)[at], one["d"][whose], one["s"][whose] + (at - first[whose])
            begin, end = w.starts[: len(w.starts) - window + 1], w.ends[window - 1 :]
            out = later(found, w.buffer, at, begin, end)
            key = row[whose[out]].astype(np.int64) << 32 | one["i"][whose[out]]
            gone += places(runs(key, found["s"][out].astype(np.int64)), numbers)
        return pa.table([pa.array([b for b, _ in gone], pa.int64()), pa.array([x for _, x in gone], pa.binary())], names=["_batch", "_gone"])

    asked = packed.select("_batch", "_ids", "_texts", "_more")
    once = answers(asked.mapInArrow(lean(first_level), MESSAGE))
    twice = answers(with_answers(packed, once).mapInArrow(lean(second_level), MESSAGE))
    sent = with_answers(packed, twice).mapInArrow(lean(full_level), "_batch long, _bucket int, _heads binary, _blob binary")
    gone = sent.groupBy("_bucket").applyInArrow(lean_group(settle), "_batch long, _gone binary").groupBy("_batch").agg(F.collect_list("_gone").alias("_gone"))
    fields = [f for f in df.schema if f.name in other]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts, more, gone in rows_of(batches):
            lists = dict(zip(*by_document(np.frombuffer(b"".join(gone or []), RUN))))
            out, n, cut = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                found = Words([text])
                stays = np.ones(len(found.starts), bool)
                if i in lists:
                    stays = ~cover([lists[i]], window, len(stays))
                out.append(b" ".join(text[a:b] for a, b in zip(found.starts[stays].tolist(), found.ends[stays].tolist())))
                n.append(len(stays))
                cut.append(int(len(stays) - stays.sum()))
            yield pa.record_batch([more, pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(cut, pa.int64())], names=["_more", "_kept", "n_words", "n_removed"])

    more = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    done = with_answers(packed, gone).mapInArrow(lean(strip), f"_more struct<{more}>, _kept string, n_words long, n_removed long")
    columns = [F.col("_kept").alias(c) if c == text_col else F.col("_more")[c].alias(c) for c in df.columns if c not in ("n_words", "n_removed")]
    return done.select(*columns, "n_words", "n_removed")


def places(gone: np.ndarray, numbers: list[int]) -> list[tuple[int, bytes]]:
    """(batch, packed runs by place in the batch) of runs whose d holds the message's row, then 32 bits of place."""
    row = gone["d"] >> 32
    gone = gone.copy()
    gone["d"] &= 0xFFFFFFFF
    cut = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)] if len(row) else [0]
    return [(numbers[int(row[a])], gone[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    Null, empty and blank texts have no words: 0, 0 and the hash of the empty string. Repeated rows are
    documents of their own, of which the first keeps its words; an empty table gives no rows.
    """
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Every window as a string, all but the first of equal ones gone; DuckDB.
OP4_SQL = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
     s as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) as rn
           from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from t where len(w) >= 20)),
     g as (select distinct doc_id, unnest(generate_series(i, i + 19)) as j from s where rn > 1),
     v as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as j from t),
     k as (select v.doc_id, count(*) as n_words, count(g.j) as n_removed, coalesce(string_agg(x, ' ' order by v.j) filter (g.j is null), '') as kept
           from v left join g on g.doc_id = v.doc_id and g.j = v.j group by v.doc_id)
select t.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join k on k.doc_id = t.doc_id
"""

by_value(__name__)
