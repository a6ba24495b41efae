"""Byte-level BPE vocabularies and the splitting of texts into chunks that encode alone.

A tokenizer file's pattern never lets a token run over a space that follows a non-space
character, so a text falls into chunks that start at such spaces. Chunks repeat far more
often than texts: each is encoded once per batch of texts and then looked up.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from .common import by_value

#: The pattern of the public vocabulary, with its white space spelt as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space between white space (or before the end): such texts don't fall into chunks at every space.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_SPACE} ({_SPACE}|\z)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: bytes of each id, merges in order, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes[i] = as_bytes(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None


class Encoder:
    """Encodes lists of texts.

    Distinct chunks are joined to texts of about `joined` bytes. `encode_many(texts)` gives the ids of texts without special tokens (flat, and how many each);
    it is called for the distinct chunks of a list, written one after the other, and for what
    doesn't fall into chunks.
    """

    def __init__(self, vocab: Vocabulary, encode_many, joined: int = 300_000):
        self.vocab, self.encode_many, self.joined = vocab, encode_many, joined
        self.size = np.fromiter(map(len, vocab.bytes), np.int64, len(vocab.bytes))

    def chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each); a chunk is a space and what follows it."""
        alone = pc.match_substring_regex(distinct, r"^\s|\s$|^$").to_numpy(zero_copy_only=False)
        some = distinct.filter(pa.array(~alone))
        sizes = np.zeros(len(distinct), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(some):
            ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), self.joined))[1:] + 1)
            cuts = np.concatenate([[0], cuts[cuts < len(some)], [len(some)]])
            rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), some)
            flat, _ = self.encode_many([" " + x for x in pc.binary_join(rows, " ").to_pylist()])
            upto = np.searchsorted(np.cumsum(self.size[flat]), ends) + 1
            sizes[~alone] = np.diff(upto, prepend=0)
            parts.append((np.flatnonzero(~alone), flat))
        if alone.any():
            flat, n = self.encode_many([" " + x for x in distinct.filter(pa.array(alone)).to_pylist()])
            sizes[alone] = n
            parts.append((np.flatnonzero(alone), flat))
        at = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for which, flat in parts:
            out[spread(at[which], sizes[which])] = flat
        return out, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, where each text starts and the last one ends)."""
        n = len(texts)
        array = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(array, _ODD).to_numpy(zero_copy_only=False)
        for s in self.vocab.special:
            odd = odd | pc.match_substring(array, s).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd & (pc.binary_length(array).to_numpy(zero_copy_only=False) > 0))
        # Every text is a row of pieces: each piece has a place in `flat` and a size.
        owner: list[np.ndarray] = []
        order: list[np.ndarray] = []
        start: list[np.ndarray] = []
        size: list[np.ndarray] = []
        flats: list[np.ndarray] = []
        base = 0

        def put(rows, places, starts, sizes):
            owner.append(np.asarray(rows, np.int64))
            order.append(np.asarray(places, np.int64))
            start.append(np.asarray(starts, np.int64) + base)
            size.append(np.asarray(sizes, np.int64))

        if len(plain):
            lists = pc.split_pattern(array.take(pa.array(plain)), " ")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            rest = np.ones(len(which), bool)
            rest[bounds[:-1]] = False
            used = np.unique(which[rest])
            flat, sizes = self.chunks(coded.dictionary.take(pa.array(used)))
            to = np.zeros(len(coded.dictionary), np.int64)
            to[used] = np.arange(len(used))
            at, w = np.cumsum(sizes) - sizes, to[which[rest]]
            rows = np.repeat(plain, np.diff(bounds) - 1)
            put(rows, np.ones(len(rows)), at[w], sizes[w])
            flats.append(flat)
            base += len(flat)
            flat, sizes = self.encode_many(coded.dictionary.take(pa.array(which[bounds[:-1]])).to_pylist())
            put(plain, np.zeros(len(plain)), np.cumsum(sizes) - sizes, sizes)
            flats.append(flat)
            base += len(flat)
        parts = [(i, p) for i in range(n) if odd[i] for p in (self.vocab.parts.split(texts[i]) if self.vocab.parts else [texts[i]]) if p]
        if parts:
            special = self.vocab.special
            flat, sizes = self.encode_many(["" if p in special else p for _, p in parts])
            ids, at = [], 0
            for (_, p), k in zip(parts, sizes.tolist()):
                ids.append(np.array([special[p]], np.uint32) if p in special else flat[at : at + k])
                at += k
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            put([i for i, _ in parts], np.arange(len(parts)), np.cumsum(sizes) - sizes, sizes)
            flats.append(np.concatenate(ids))
        if not flats:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        rows, sizes = np.concatenate(owner), np.concatenate(size)
        by = np.lexsort((np.concatenate(order), rows))
        ids = np.concatenate(flats).astype(np.uint32)[spread(np.concatenate(start)[by], sizes[by])]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(rows, sizes, n).astype(np.int64))])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... for sizes[i] places each, one after the other."""
    to = np.cumsum(sizes) - sizes
    return np.repeat(starts - to, sizes) + np.arange(int(sizes.sum()))


def slices(texts: list[str], most: int = 8_000_000):
    """Ranges of rows with about `most` characters each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def small_batches(spark: SparkSession, most: int = 8 * 2**20) -> None:
    """Arrow batches of at most `most` bytes, so that long texts don't fill a Python worker; a smaller limit of the session stays.

    The limit is read when a plan is made, at the latest with the query's action, so it can't be put back here.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set(key, str(most))


by_value(__name__)
