"""Hashes of windows over words or bytes, and places chosen by content, for batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import by_value

#: Words longer than this are hashed one by one.
_LONG = 64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
LUT = np.zeros(256, bool)
LUT[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) modulo 2^64 for i in 0..n."""
    had = _powers.get(base)
    if had is None or len(had[0]) <= n:
        up = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n + 1, b, np.uint64)]))
        had = _powers[base] = (up(np.uint64(base)), up(np.uint64(pow(base, -1, 2**64))))
    return had


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values * base^i, from which `between` takes the hash of any stretch."""
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    _, down = powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    at = np.arange(len(values) - k + 1)
    return between(sums(values, _STEP), at, at + k, _STEP)


class Words:
    """Words of a batch of texts given as bytes: where they lie, whose they are, their hashes."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = b" ".join(texts)
        self.buffer = np.frombuffer(self.raw, np.uint8)
        space = np.concatenate([[True], LUT[self.buffer], [True]])
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = turn[::2], turn[1::2]
        self.offsets = np.cumsum(sizes + 1) - sizes - 1
        self.first = np.searchsorted(self.starts, np.concatenate([self.offsets, [len(self.buffer) + 1]]))

    def hashes(self) -> np.ndarray:
        """Hash of each word: eight bytes at a time through a bijective mixer, long words by XXH3.

        No two words of the same length up to eight bytes are equal in it, and no algebraic
        pattern of letters cancels, as it does in a polynomial modulo 2^64.
        """
        n = self.ends - self.starts
        out = mix(n.astype(np.uint64) * np.uint64(_BASE))
        bytes_at = np.lib.stride_tricks.as_strided(np.concatenate([self.buffer, np.zeros(8, np.uint8)]).view(np.uint8), (len(self.buffer) + 1, 8), (1, 1))
        live, done = np.arange(len(n)), 0
        while len(live) and done < _LONG:
            left = n[live] - done
            chunk = np.ascontiguousarray(bytes_at[self.starts[live] + done]).view("<u8").ravel()
            short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
            chunk = np.where(left < 8, chunk & ((np.uint64(1) << (short & np.uint64(63))) - np.uint64(1)), chunk)
            out[live] = mix(out[live] ^ chunk)
            live, done = live[left > 8], done + 8
        for i in live.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]])
        return out


def argmin(values: np.ndarray, m: int) -> np.ndarray:
    """For every stretch of m values, the place of its least value, the leftmost of equal ones."""
    at = np.arange(len(values), dtype=np.int32)
    size = 1
    while size < m:
        step = min(size, m - size)
        left, right = values[:-step], values[step:]
        take = right < left
        values = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        size += step
    return at


def anchors(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: (document, place of the anchor gram, first window start, number of starts).

    `hashes`: of the k-grams; `first`: where each document's units start, and the end. A
    window's anchor is the gram in it with the least hash, so equal windows have equal anchors.
    The starts that share an anchor follow each other.
    """
    m = window - k + 1
    empty = np.zeros(0, np.int64)
    if len(hashes) < m:
        return empty, empty, empty, empty
    at = argmin((hashes >> np.uint64(32)).astype(np.uint32), m)
    sizes = np.diff(first)
    docs = np.flatnonzero(sizes >= window)
    if not len(docs):
        return empty, empty, empty, empty
    counts = sizes[docs] - window + 1
    starts = spread(first[docs], counts)
    owner = np.repeat(docs, counts)
    place = at[starts]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    cut = np.flatnonzero(new)
    return owner[cut], place[cut].astype(np.int64), starts[cut], np.diff(np.concatenate([cut, [len(starts)]]))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... for sizes[i] places each, one after the other."""
    to = np.cumsum(sizes) - sizes
    return np.repeat(starts - to, sizes) + np.arange(int(sizes.sum()))


def byte_slices(texts: list[bytes], most: int = 3_000_000):
    """Ranges of rows with about `most` bytes each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def row_slices(column: pa.Array, most: int = 3_000_000):
    """Ranges of rows of a column of texts with about `most` bytes each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def text_slices(column: pa.Array, most: int = 3_000_000):
    """(a, b, texts a to b as bytes): only one slice at a time is held as Python objects, however large the batch."""
    column = column.cast(pa.binary())
    for a, b in row_slices(column, most):
        yield a, b, column[a:b].to_pylist()


def equal_stretches(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """Whether data[x : x + n] equals data[y : y + n], for each of many stretches, byte by byte."""
    out = np.ones(len(x), bool)
    upto = np.cumsum(n)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        one, two = spread(x[a:b], n[a:b]), spread(y[a:b], n[a:b])
        wrong = np.flatnonzero(data[one] != data[two])
        if len(wrong):
            out[a + np.searchsorted(np.cumsum(n[a:b]), wrong, "right")] = False
        a = b
    return out


def verified(data: np.ndarray, at: np.ndarray, like: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether window at[i] has the same bytes as window like[i]; window w covers data[begin[w] : end[w]].

    Windows follow each other in runs, and so do their partners: each run is compared once.
    """
    by = np.argsort(at, kind="stable")
    p, q = at[by], like[by]
    if not len(p):
        return np.zeros(0, bool)
    new = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
    for w in (p, q):  # no gaps, nothing out of order
        new |= (begin[w[1:]] < begin[w[:-1]]) | (end[w[1:]] < end[w[:-1]]) | (begin[w[1:]] > end[w[:-1]] + 1)
    head = np.flatnonzero(np.concatenate([[True], new]))
    last = np.concatenate([head[1:], [len(p)]]) - 1
    n, m = end[p[last]] - begin[p[head]], end[q[last]] - begin[q[head]]
    good = n == m
    good[good] = equal_stretches(data, begin[p[head]][good], begin[q[head]][good], n[good])
    each = np.repeat(good, np.diff(np.concatenate([head, [len(p)]])))
    for i in np.flatnonzero(~each).tolist():  # a run that differs somewhere: window by window
        each[i] = bytes(data[begin[p[i]] : end[p[i]]]) == bytes(data[begin[q[i]] : end[q[i]]])
    out = np.empty(len(at), bool)
    out[by] = each
    return out


#: Starts s, s + 1, ... s + n - 1 of a document.
RUN = np.dtype([("d", "<i8"), ("s", "<i4"), ("n", "<i4")])


def runs(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The starts, repeated ones once, as maximal runs by document."""
    by = np.lexsort((s, d))
    d, s = d[by], s[by]
    if not len(d):
        return np.zeros(0, RUN)
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
    d, s = d[fresh], s[fresh]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)]))
    out = np.empty(len(head), RUN)
    out["d"], out["s"], out["n"] = d[head], s[head], np.diff(np.concatenate([head, [len(d)]]))
    return out


def by_document(gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(documents, the packed runs of each)."""
    gone = gone[np.argsort(gone["d"], kind="stable")]
    if not len(gone):
        return np.zeros(0, np.int64), []
    cut = np.flatnonzero(np.concatenate([[True], gone["d"][1:] != gone["d"][:-1]]))
    return gone["d"][cut].astype(np.int64), [p.tobytes() for p in np.split(gone, cut[1:])]


def cover(packed: list[bytes], width: int, n: int) -> np.ndarray:
    """Which of n places lie in a stretch of `width` that starts in one of the packed runs."""
    gone = np.frombuffer(b"".join(packed), RUN)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(gone["s"], n), 1)
    np.add.at(edge, np.minimum(gone["s"].astype(np.int64) + gone["n"] - 1 + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


by_value(__name__)
