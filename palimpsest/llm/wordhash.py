"""Words of a batch of texts as numpy arrays, without a Python object per word.

A batch is an Arrow string array.  Its UTF-8 bytes are looked at as one numpy
array; words are maximal runs of bytes outside a separator class, and never
cross a text's end.  Every separator class used here is ASCII, so byte classes
and code-point classes agree.  A span's 64-bit key is a sum over its blocks of
eight bytes, each mixed with its place, so that no regular pattern of bytes
makes two spans' keys agree; an independent second key tells spans apart where
a first one may have met another span's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All bytes but digits, a-z and those of non-ASCII characters.
NOT_WORDLIKE = np.ones(256, bool)
NOT_WORDLIKE[0x30:0x3A] = NOT_WORDLIKE[0x61:0x7B] = NOT_WORDLIKE[0x80:] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


#: Multipliers of the words of a window, drawn at random once.
_FACTORS = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=U64)
#: Bits of a block's first bytes.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Words(NamedTuple):
    raw: np.ndarray  # bytes of the slice, lower-cased where asked
    bounds: np.ndarray  # n_docs + 1 offsets of texts in raw
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    doc: np.ndarray  # of each word, 0-based in the slice
    key: np.ndarray  # 64-bit key of each word
    first: np.ndarray  # n_docs + 1 offsets of texts in the word arrays


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each, one row at least."""
    _, offsets = text_bytes(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def cuts(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``separators``, cut at ``bounds``."""
    inside = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    return np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))


def _span_sums(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed, the spans' keys: mixed sums of their blocks, each mixed with its place and the seed."""
    size = end - start
    padded = np.append(raw, np.zeros(8, np.uint8))
    loads = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
    long = np.flatnonzero(size > 8)
    extra = (size[long] + 7) // 8 - 1
    ends = np.cumsum(extra)
    number = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - extra, extra) + 1
    first = loads[start] & _MASKS[np.minimum(size, 8)]
    rest = loads[np.repeat(start[long], extra) + 8 * number] & _MASKS[np.minimum(np.repeat(size[long], extra) - 8 * number, 8)]
    out = []
    with np.errstate(over="ignore"):
        for seed in seeds:
            salt = mix(np.array([seed + 1], U64) * _ODD)
            total = mix(first ^ salt)
            if len(long):
                places = mix(np.arange(1, int(extra.max()) + 1, dtype=U64) * _ODD + salt)
                total[long] += np.add.reduceat(mix(rest ^ places[number - 1]), ends - extra)
            out.append(mix(total + size.astype(U64) * _ODD))
    return out


def span_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys of byte spans; equal bytes have equal keys."""
    return _span_sums(raw, start, end, (2 * seed,))[0]


def span_pairs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``span_keys`` and independent second keys, together 128 bits."""
    key, check = _span_sums(raw, start, end, (2 * seed, 2 * seed + 1))
    return key, check


def number(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct (key, check), and each one's number among these."""
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if len(key) and (check[first][inverse] != check).any():
        _, first, inverse = np.unique(np.stack([key, check], 1), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


class Memory:
    """Numbers of spans met before, by both of their keys; owners keep the spans' values by number.

    Should two spans have one key but different second keys, all is forgotten
    and keys are made with another seed.
    """

    def __init__(self, limit: int):
        self.limit, self.seed = limit, 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.numbers = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)

    def _lookup(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, bool]:
        """Numbers of distinct keys (-1: not known), and whether a key is another span's."""
        if not len(self.keys):
            return np.full(len(key), -1), False
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[at] == key
        return np.where(same, self.numbers[at], -1), bool((same & (self.checks[at] != check)).any())

    def places(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Each span's number; the places of one span for each number that is new, in order; whether all older numbers are void.

        Spans of different ``kind`` are different, whatever their bytes.
        """
        afresh = False
        while True:
            key, check = span_pairs(raw, start, end, self.seed)
            if kind is not None:
                key, check = mix(key + kind.astype(U64)), mix(check + kind.astype(U64))
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            found, clash = self._lookup(distinct, check[first])
            if not clash and (check[first][inverse] == check).all():
                break
            self.seed += 1
            self.clear()
            afresh = True
        new = found < 0
        if len(self.keys) + new.sum() > self.limit and len(self.keys):
            self.clear()
            afresh, new = True, np.ones(len(found), bool)
        found[new] = len(self.keys) + np.arange(new.sum())
        keys = np.concatenate([self.keys, distinct[new]])
        order = np.argsort(keys, kind="stable")
        self.checks = np.concatenate([self.checks, check[first[new]]])[order]
        self.numbers = np.concatenate([self.numbers, found[new]])[order]
        self.keys = keys[order]
        return found[inverse], first[new], afresh


def words(texts: pa.Array, separators: np.ndarray, lower: bool) -> Words:
    raw, bounds = text_bytes(texts)
    if lower:
        raw = _LOWER[raw]
    start, end = cuts(raw, bounds, separators)
    doc = np.searchsorted(bounds, start, "right") - 1
    first = np.searchsorted(start, bounds)
    return Words(raw, bounds, start, end, doc, span_keys(raw, start, end), first)


def gram_keys(key: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-word windows (n up to 256) that start at each of the first len(key)-n+1 words."""
    size = len(key) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = np.zeros(size, U64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += key[i : i + size] * _FACTORS[i]
    return mix(out)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles: their texts' numbers and keys, sorted by both.

    A text with fewer words, but not none, has its whole sequence as its only shingle.
    """
    count = np.diff(w.first)
    keys = gram_keys(w.key, n)
    at = np.arange(len(keys))
    whole = w.doc[: len(keys)] == w.doc[n - 1 :] if len(keys) else np.zeros(0, bool)
    docs, keys = w.doc[at[whole]], keys[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        out = np.zeros(len(short), U64)
        with np.errstate(over="ignore"):
            for i in range(n):
                use = count[short] > i
                out[use] += w.key[w.first[short[use]] + i] * _FACTORS[i]
            out = mix(out + count[short].astype(U64))
        docs, keys = np.concatenate([docs, short]), np.concatenate([keys, out])
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]
