"""BPE encoding and decoding with a pair occurrence index.

Each batch of a task lays the distinct pre-tokens of its texts out in one array and keeps an index from each
mergeable pair to all its positions there. Ranks that occur are applied in ascending order:
all positions of a pair are merged at once, and only the lists of the pairs beside them
change. A merge's product has a lower rank than any merge that uses it, so ascending order
over the whole array gives each pre-token what encoding it alone would give.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, id_text, lean, table
from .tokens import SPLIT, Encoder, Vocabulary, default_path, slices, small_batches, spread

_NONE = np.int32(2**31 - 1)


class PairIndex:
    """Applies a vocabulary's merges to many pre-tokens at once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.wide, self.split = vocab, np.int64(len(vocab.bytes)), regex.compile(SPLIT)
        code = vocab.left * self.wide + vocab.right
        self.order = np.argsort(code, kind="stable").astype(np.int32)
        self.codes = code[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], _NONE)

    def encode(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, number of ids of each)."""
        raw = [t.encode("utf-8") for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(sizes.sum())
        sym = self.vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int32)
        ends = np.cumsum(sizes)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1
        alive, merged = np.ones(n, bool), np.zeros(n, bool)
        rank = np.full(n, _NONE, np.int32)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put positions whose pair has a rank on that pair's list."""
            if not len(at):
                return
            of = rank[at]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for a, b in zip(starts[:-1], starts[1:]):
                r = int(of[a])
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(at[a:b])

        def look(at: np.ndarray) -> None:
            at = at[nxt[at] >= 0]
            rank[at] = got = self.ranks(sym[at], sym[nxt[at]])
            add(at[got != _NONE])

        look(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0]
            if len(lists) > 1:
                at = np.sort(np.concatenate(lists))
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if self.vocab.left[r] == self.vocab.right[r]:  # overlapping occurrences: every other one of a run, from its left end
                at = np.sort(at)
                joined = np.concatenate([[False], at[1:] == nxt[at[:-1]]])
                number = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[number % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.vocab.made[r]
            alive[gone] = False
            rank[gone] = _NONE
            rank[at] = _NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            before = before[before >= 0]
            merged[at] = True
            before = before[~merged[before]]
            merged[at] = False
            look(np.concatenate([at, before]))
        left = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], left[ends] - left[ends - sizes]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each), by way of distinct pre-tokens."""
        found = list(map(self.split.findall, texts))
        count = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array([t for f in found for t in f], pa.large_string()).dictionary_encode()
        ids, sizes = self.encode(coded.dictionary.to_pylist())
        w = coded.indices.to_numpy(zero_copy_only=False)
        to = np.concatenate([[0], np.cumsum(sizes[w])])
        flat = ids[spread((np.cumsum(sizes) - sizes)[w], sizes[w])].astype(np.uint32)
        return flat, np.diff(to[np.concatenate([[0], np.cumsum(count)])])


def bpe_encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_tokens, ids (little-endian unsigned 32-bit integers).

    Whole texts; null text is empty and has no ids. The vocabulary's special tokens written in
    a text get their own ids, none are added. Repeated rows stay, null ids stay null, an empty
    table gives an empty result, and other columns are ignored.
    """
    where = path or default_path()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(where)
        encoder = Encoder(vocab, PairIndex(vocab).encode_many)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, at = encoder.encode(texts[a:b])
                raw = ids.astype("<u4").tobytes()
                blobs = [raw[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(np.diff(at), pa.int64()), pa.array(blobs, pa.binary())], names=["_id", "n_tokens", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(lean(run), "_id long, n_tokens long, ids binary").withColumnRenamed("_id", id_col)


def bpe_decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds column `into`: the text of the ids, special tokens included; null ids give an empty text.

    Bytes that aren't UTF-8 become U+FFFD. A column named like `into` is replaced.
    """
    where = path or default_path()
    keep = [c for c in df.columns if c != into]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vocabulary(where).bytes.__getitem__
        for batch in batches:
            column = batch.column(keep.index(ids_col))
            texts = [b"".join(map(of, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in column.to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*keep, into])

    return source.mapInArrow(lean(run), schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null and empty texts have no ids, an empty table gives no rows."""
    out = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


by_value(__name__)
