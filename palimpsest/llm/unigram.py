"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches by their end;
dynamic programming carries the best score and the piece count, never the
pieces.  Ties are those of the ``tokenizers`` library's Unigram model: a later
candidate must score strictly more, candidates at one end come by ascending
start, a character that is no piece of its own counts as unknown at the lowest
score less 10, and an unknown character is one token for each of its bytes.

The public piece file that the registered query passes holds a BPE vocabulary:
its scores are merge ranks, not log-probabilities.  The method is applied to
these scores as given (tokenizers aren't trained here), so the query's counts
are those of the best-scoring segmentation under that file, not the counts that
its own BPE encoder would give.  A unigram file gives its tokenizer's counts.

Pieces start at blanks (written as U+2581), and none has a line break or tab
inside, so both cut a text into parts that are scored on their own.  Distinct
parts are scored once a task.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct parts that a Python worker remembers; beyond, it starts afresh.
REMEMBER = 2_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Scores parts of texts against one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        if any("\n" in p or "\t" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in pieces):
            raise ValueError("a piece has a line break or tab, or goes over a blank")
        names = {p for p, _ in pieces}
        if not all(f"<0x{b:02X}>" in names for b in range(256)):
            raise ValueError("the vocabulary lacks a piece for each byte")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in names if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def count(self, part: str) -> tuple[int, float]:
        """Tokens and score of the best segmentation of one part."""
        n = len(part)
        best, tokens = [0.0] + [None] * n, [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            ends[end].append(match)
        for end, c in enumerate(part):
            top, number = None, 0
            for length, score in sorted(ends[end], reverse=True):  # longest first: starts ascend
                candidate = best[end + 1 - length] + score
                if top is None or candidate > top:
                    top, number = candidate, tokens[end + 1 - length] + 1
            if c not in self.single:
                candidate = best[end] + self.unknown
                if top is None or candidate > top:
                    top, number = candidate, tokens[end] + len(c.encode())
            best[end + 1], tokens[end + 1] = top, number
        return tokens[n], best[n]


_START = np.zeros(256, bool)
_START[0x20] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[[9, 10]] = True
_MARK = SPACE_MARK.encode()


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


class _Parts:
    """Counts and scores of parts by their number in ``memory``, kept over a worker's tasks."""

    def __init__(self, path: str):
        self.counter, self.memory = _counter(path), W.Memory(REMEMBER)
        self.clear()

    def clear(self) -> None:
        self.tokens, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def of(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of a slice's texts."""
        start, end, blank, origin = _parts(raw, bounds)
        at, new, afresh = self.memory.places(raw, start, end, blank)
        if afresh:
            self.clear()
        if len(new):
            whole = raw.tobytes()
            found = [self.counter.count((SPACE_MARK if m else "") + whole[a:b].decode("utf-8", "replace")) for a, b, m in zip(start[new].tolist(), end[new].tolist(), blank[new].tolist())]
            self.tokens = np.concatenate([self.tokens, np.array([t for t, _ in found], np.int64)])
            self.scores = np.concatenate([self.scores, np.array([s for _, s in found])])
        doc = np.searchsorted(bounds, origin, "right") - 1
        n = len(bounds) - 1
        return np.bincount(doc, self.tokens[at], n).astype(np.int64), np.bincount(doc, self.scores[at], n)


def _parts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of parts, whether each begins with a blank's mark, and a place in its text.

    A text begins with a mark, unless it is empty or its own first character is
    a blank.  A blank starts a part that goes up to the next blank, break or
    tab; runs of breaks and tabs and of others are parts without mark.
    """
    blank, control = _START[raw], _CONTROL[raw]
    n = len(raw)
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    new = head[:n].copy()
    new |= blank
    new[1:] |= control[1:] != control[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)[: len(start)]
    mark = blank[start] | (head[start] & ~control[start])
    begin = start + blank[start]
    # a text that begins with a break or tab still has a mark of its own, alone
    alone = start[head[start] & control[start]]
    return np.concatenate([begin, alone]), np.concatenate([end, alone]), np.concatenate([mark, np.ones(len(alone), bool)]), np.concatenate([start, alone])


@lru_cache(2)
def _remembered(path: str) -> _Parts:
    return _Parts(path)


def _count_map(path: str):
    def run(batches):
        parts = _remembered(path)
        for batch in batches:
            text = batch.column(1)
            for a, b in W.slices(text):
                raw, bounds = W.text_bytes(text.slice(a, b - a))
                whole = raw.tobytes()
                if _MARK in whole:  # a text's own marks are blanks too
                    texts = pa.array([(x or "").replace(SPACE_MARK, " ") for x in text.slice(a, b - a).to_pylist()])
                    raw, bounds = W.text_bytes(texts)
                tokens, scores = parts.of(raw, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tokens), pa.array(scores)], ["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and the best segmentation's score.  A null or empty text has 0 tokens.

    Rows are independent: repeated rows have equal results, a null id stays null.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count_map(vocabulary_path), "doc_id long, n_tokens long, score double")
