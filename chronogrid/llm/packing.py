"""Harmonic packing of token sequences.

A piece of length l is in class k when capacity/(k+1) < l <= capacity/k; a bin of class k takes
exactly k pieces of that class. Every task packs its own documents, so nothing is shuffled: a
bin's sequence_id holds the task's number. Documents are cut at two places only: where they
are longer than a sequence, and where the head of the next document fills what the k pieces of
a full bin leave free. Gaps of fewer than `least` tokens stay open, and no cut leaves a piece
below `least`, so shorter pieces are whole documents. Pieces in bins still open at a task's
end, fewer than k in each class, are packed first-fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_value, id_text, lean, table
from .tokens import Encoder, Vocabulary, default_path, slices, small_batches

_LONG_RUN = re.compile(r"\s{1000}|\S{1000}")
SCHEMA = "_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def library_ids(path: str, vocab: Vocabulary):
    """Ids of texts by installed tokenizer libraries, from the same vocabulary file.

    Ordinary texts go through tiktoken, which gives the ids of the tokenizers library in less
    time; texts with a very long run of white space or of other characters, where its pattern
    gives up, through the tokenizers library itself, without truncation and padding.
    """
    import public_tokenizers

    special = set(vocab.special.values())
    ranks = {b: i for i, b in enumerate(vocab.bytes) if i not in special}
    encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    library: list[Tokenizer] = []

    def slow(text: str) -> np.ndarray:
        if not library:
            library.append(Tokenizer.from_file(path))
            library[0].no_truncation()
            library[0].no_padding()
        return np.array(library[0].encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [slow(t) if _LONG_RUN.search(t) else encode(t) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    return run


class Bins:
    """The open bins of one task: one for each class, and full ones that still have a gap."""

    def __init__(self, capacity: int, least: int, task: int):
        self.capacity, self.least, self.next = capacity, least, task << 40
        self.open: dict[int, list[tuple]] = {}
        self.gaps: list[tuple[int, list[tuple]]] = []
        self.done: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, length, total, ids in pieces:
            self.done.append((doc, start, length, total, self.next, at, ids))
            at += length
        self.next += 1

    def add(self, doc, total: int, ids: bytes) -> None:
        """Place a document of `total` ids."""
        start, least = 0, self.least
        piece = lambda n: (doc, start, n, total, ids[4 * start : 4 * (start + n)])
        while start < total and self.gaps:
            free, pieces = self.gaps[-1]
            left = total - start
            n = left if left <= free else free if left - free >= least else left - least
            if n < min(left, least):  # nothing can be cut off without a splinter
                break
            pieces.append(piece(n))
            start += n
            if free - n < least:
                self.gaps.pop()
                self.close(pieces)
            else:
                self.gaps[-1] = (free - n, pieces)
        while start < total:
            left = total - start
            n = min(left, self.capacity)
            if 0 < left - n < least:
                n = left - least
            k = self.capacity // n
            pieces = self.open.setdefault(k, [])
            pieces.append(piece(n))
            start += n
            if len(pieces) == k:
                del self.open[k]
                free = self.capacity - sum(p[2] for p in pieces)
                if free < least:
                    self.close(pieces)
                else:
                    self.gaps.append((free, pieces))
                    if len(self.gaps) > 64:  # what no document could fill stays padding, so a task's memory is bounded
                        self.close(self.gaps.pop(0)[1])

    def finish(self) -> None:
        rest = list(self.gaps)
        for p in sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2]):
            for i, (free, pieces) in enumerate(rest):
                if p[2] <= free:
                    pieces.append(p)
                    rest[i] = (free - p[2], pieces)
                    break
            else:
                rest.append((self.capacity - p[2], [p]))
        self.open, self.gaps = {}, []
        for _, pieces in rest:
            self.close(pieces)


def pack(df: DataFrame, path: str | None = None, capacity: int = 1024, least: int = 16, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: <id_col>, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    A document's ids are those of its whole text, null text being empty, then `end_id`, so
    every row has a piece. Each id lies in one piece, the pieces of a sequence are gapless from
    0 and no longer than `capacity` together. Repeated rows are packed as often as they occur,
    a null id stays null, an empty table gives no pieces; other columns are ignored. An input
    that comes out of a shuffle should be sorted within partitions, for equal retries.
    """
    where = path or default_path()
    small_batches(df.sparkSession)
    least = max(1, min(least, capacity // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(where)
        encoder = Encoder(vocab, library_ids(where, vocab))
        bins = Bins(capacity, least, TaskContext.get().partitionId())
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*bins.done), kinds)], names=names)
            bins.done = []
            return out

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 4_000_000):
                ids, at = encoder.encode(texts[a:b])
                raw, at = ids.astype("<u4").tobytes(), at.tolist()
                for doc, x, y in zip(docs[a:b], at[:-1], at[1:]):
                    bins.add(doc, y - x + 1, raw[4 * x : 4 * y] + end)
                if bins.done:
                    yield flush()
        bins.finish()
        if bins.done:
            yield flush()

    return id_text(df, id_col, text_col).mapInArrow(lean(run), SCHEMA).withColumnRenamed("_id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone: one piece of length 1. Repeated rows are packed as often as
    they occur; an empty table gives no rows.
    """
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


by_value(__name__)
