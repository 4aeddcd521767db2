"""Token ids of whole texts, encoding each distinct word of a task only once.

The word-level BPE drops white space and never merges across it, nor between
an ASCII letter and a full stop or comma, so a text's ids are those of such
pieces, one after another.  Pieces are found with numpy; those not met before
go to the tokenizer; ids are gathered by piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import wordhash as W

#: Distinct pieces whose ids a Python worker remembers; beyond, it starts afresh.
REMEMBER = 1_500_000
_ALPHA = np.zeros(256, bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = True
_STOPS = np.zeros(256, bool)
_STOPS[[0x2C, 0x2E]] = True


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a tokenizer does to texts if its ids are those of their pieces, one after another.
_NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(2)
def by_pieces(path: str) -> bool:
    """Whether a tokenizer drops white space and splits letters from stops, so that texts may be cut there."""
    kind = json.loads(tokenizer(path).to_str())
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (kind.get("normalizer") or {}).get("normalizers", [])]
    splits = [x for x in (kind.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    return steps == _NORMALIZERS and len(splits) == 1 and splits[0]["pattern"].get("Regex", "").endswith(_SPLIT) and splits[0]["behavior"] == "Removed" and splits[0]["invert"]


class Ids:
    """Ids of pieces by their number in ``memory``: ``start`` and ``size`` point into ``flat``."""

    def __init__(self, path: str):
        self.path, self.memory = path, W.Memory(REMEMBER)
        self.clear()

    def clear(self) -> None:
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        whole = raw.tobytes()
        flat, size = _encode([whole[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())], self.path)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def of(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and the n + 1 offsets of texts in them."""
        start, end = _pieces(raw, bounds)
        at, new, afresh = self.memory.places(raw, start, end)
        if afresh:
            self.clear()
        if len(new):
            self.learn(raw, start[new], end[new])
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)] if total else np.zeros(0, np.uint32)
        before = np.concatenate([[0], ends])
        return flat, before[np.searchsorted(start, bounds)]


def _encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, one after another, and how many each has."""
    ids = [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for one in ids for x in one), np.uint32, int(size.sum())), size


def _pieces(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, cut between an ASCII letter and a stop."""
    start, end = W.cuts(raw, bounds, W.SPACE)
    if len(raw) < 2:
        return start, end
    inner = np.flatnonzero(_ALPHA[raw[:-1]] & _STOPS[raw[1:]]) + 1
    inner = inner[~np.isin(inner, bounds, assume_unique=False)]
    return np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))


@lru_cache(2)
def remembered(path: str) -> Ids:
    """One memory for each Python worker, kept over its tasks."""
    return Ids(path)


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of an Arrow string array: first row, ids, offsets of rows in the ids.  Null counts as empty.

    A tokenizer that doesn't allow pieces (``by_pieces``) gets whole texts.
    """
    ids = remembered(path)
    for a, b in W.slices(texts):
        if not by_pieces(path):
            flat, size = _encode([x or "" for x in texts.slice(a, b - a).to_pylist()], path)
            yield a, flat, np.concatenate([[0], np.cumsum(size)])
            continue
        raw, bounds = W.text_bytes(texts.slice(a, b - a))
        flat, offsets = ids.of(raw, bounds)
        yield a, flat, offsets
