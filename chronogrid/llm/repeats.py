"""How often keys occur over all batches of a table, asked and answered batch by batch.

A batch sends each of its distinct keys once, with its own count, packed for the range the key
lies in; a range adds up and answers each batch with those of its keys that occur more than
once. So a key that a third of all rows hold costs one entry for each batch, and no row is
shuffled for a single key. Keys are hashes; of each, `bits` + 32 bits are compared. Two keys
that agree in them look repeated, which lets a candidate through and never drops one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, lean_group

MESSAGE = "_batch long, _bucket int, _blob binary"


def bucket_bits(n_keys: int, least: int, each: int = 2_000_000) -> int:
    """The number of ranges as a power of two: `least`, and more where a range would hold over `each` keys."""
    return min(30, max(1, least - 1, -(-n_keys // each) - 1).bit_length())


def batch_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives to its batches, the same when the task is run again."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def bucket_of(batch: int, bits: int) -> int:
    """A range for what concerns one batch alone, spread evenly over all of them."""
    return (batch + (batch >> 32)) % 2**bits


def split(codes: np.ndarray, parts: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """(bucket, blob of the parts one after the other) of sorted codes; the low 32 bits go along as the first part."""
    if not len(codes):
        return [], []
    of = (codes >> np.uint64(32)).astype(np.int64)
    cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(codes)]
    low = (codes & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [int(of[a]) for a in cut[:-1]], [b"".join(p[a:b].tobytes() for p in (low, *parts)) for a, b in zip(cut[:-1], cut[1:])]


def ask(batch: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """Messages of one batch: its distinct keys and how often it holds each."""
    codes, n = np.unique(keys >> np.uint64(32 - bits), return_counts=True)
    buckets, blobs = split(codes, [n.astype("<u4")])
    return pa.record_batch([pa.array([batch] * len(buckets), pa.int64()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["_batch", "_bucket", "_blob"])


def _halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, "<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def _add(t: pa.Table) -> pa.Table:
    pairs = [_halves(b) for b in t["_blob"].to_pylist()]
    keys, n = np.concatenate([k for k, _ in pairs]), np.concatenate([c for _, c in pairs])
    src = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(k) for k, _ in pairs])
    order = np.argsort(keys, kind="stable")
    keys, n, src = keys[order], n[order], src[order]
    group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
    total = np.minimum(np.bincount(group, n.astype(float)), 2**32 - 1).astype("<u4")[group]
    often = total > 1
    keys, total, src = keys[often], total[often], src[often]
    by = np.argsort(src, kind="stable")  # within a batch the keys stay sorted
    keys, total, src = keys[by], total[by], src[by]
    cut = [0, *(np.flatnonzero(src[1:] != src[:-1]) + 1).tolist(), len(src)] if len(src) else [0]
    rows = src[cut[:-1]]
    blobs = [keys[a:b].tobytes() + total[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    at = pa.array(rows, pa.int32())
    return pa.table([t["_batch"].take(at), t["_bucket"].take(at), pa.array(blobs, pa.binary())], names=["_batch", "_bucket", "_blob"])


def answers(messages: DataFrame) -> DataFrame:
    """(_batch, _often: list of (bucket, blob)) of all batches with a key that occurs more than once in the table."""
    back = messages.groupBy("_bucket").applyInArrow(lean_group(_add), MESSAGE)
    return back.groupBy("_batch").agg(F.collect_list(F.struct("_bucket", "_blob")).alias("_often"))


class Often:
    """What one batch was answered."""

    def __init__(self, often: list[dict] | None, bits: int):
        self.shift = np.uint64(32 - bits)
        often = sorted(often or [], key=lambda r: r["_bucket"])
        pairs = [_halves(r["_blob"]) for r in often]
        self.codes = np.concatenate([np.zeros(0, np.uint64), *[k.astype(np.uint64) | np.uint64(r["_bucket"] << 32) for r, (k, _) in zip(often, pairs)]])
        self.totals = np.concatenate([np.zeros(0, np.int64), *[c.astype(np.int64) for _, c in pairs]])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """How often each key occurs in the table."""
        if not len(self.codes):
            return np.ones(len(keys), np.int64)
        code = keys >> self.shift
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.totals[at], 1)


by_value(__name__)
