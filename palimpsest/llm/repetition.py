"""Quality rules on repetition by suffix array and longest-common-prefix intervals.

The texts of a slice are one sequence of words, a symbol of its own after each
text, so one suffix array serves all.  Prefix doubling sorts only suffixes whose
rank still has a tie.  Intervals of the LCP array with at least ``min_repeat``
words, and different words before, are maximal repeated substrings; the union
of their spans and the longest are limited.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

#: Production parameters of the method's verdict.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 10, 30, 60
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and each suffix's rank.  ``symbols`` are non-negative; the end sorts first."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    x = symbols[order]
    group = np.cumsum(np.append(0, x[1:] != x[:-1])) if n else np.zeros(0, np.int64)
    # a suffix's rank is the place of its group's first member, so that groups split without new ranks elsewhere
    first = np.searchsorted(group, np.arange(group[-1] + 1 if n else 0))
    rank = np.empty(n, np.int64)
    rank[order] = first[group]
    step, tied = 1, np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else np.zeros(0, np.int64)
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[tied]))
        tied, second, old = tied[by], second[by], rank[tied[by]]
        new_old = np.append(True, old[1:] != old[:-1])
        new = new_old | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(tied))
        start_old, start = np.maximum.accumulate(np.where(new_old, place, 0)), np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = old + start - start_old
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in the suffix array (0 for the first).

    Pairs that still agree are compared a doubling stretch at a time, by keys of
    2**k symbols that are built level by level, then the stretches halve.
    """
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b, at = order[:-1], order[1:], np.arange(1, n)
    levels = [W.mix(symbols.astype(np.uint64) + np.uint64(1))]
    live = symbols[a] == symbols[b]
    a, b, at = a[live], b[live], at[live]
    pairs = [(a, b, at)]
    while len(at):
        size = 1 << len(levels)
        if size > n:
            break
        key = levels[-1]
        with np.errstate(over="ignore"):
            levels.append(W.mix(key[: len(key) - size // 2] * np.uint64(0x9E3779B97F4A7C15) + key[size // 2 :]))
        fits = np.maximum(a, b) + size <= n
        live = np.zeros(len(at), bool)
        live[fits] = levels[-1][a[fits]] == levels[-1][b[fits]]
        if not live.any():
            levels.pop()
            break
        a, b, at = a[live], b[live], at[live]
        pairs.append((a, b, at))
    # the largest level at which a pair agrees, then down through the smaller ones
    a, b, at = pairs[0] if pairs else (a, b, at)
    for k in range(len(levels) - 1, -1, -1):
        size, x, y = 1 << k, order[at - 1] + lcp[at], order[at] + lcp[at]
        fits = np.flatnonzero(np.maximum(x, y) + size <= n)
        same = fits[levels[k][x[fits]] == levels[k][y[fits]]]
        lcp[at[same]] += size
    return lcp


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of LCP intervals of ``least`` symbols or more whose suffixes differ in the symbol before."""
    out, stack = [], []  # length, left end, the symbol before: -2 unknown, -1 several
    before = np.where(order > 0, symbols[np.maximum(order - 1, 0)], -3)

    def joined(x: int, y: int) -> int:
        return y if x == -2 else x if y in (-2, x) else -1

    for i in (np.flatnonzero(lcp >= least)).tolist():
        if stack and i != last + 1:  # noqa: F821
            _close(stack, 0, last, out, joined)  # noqa: F821
        value, left, seen = int(lcp[i]), i - 1, int(before[i - 1])
        if stack:
            popped = _close(stack, value, i - 1, out, joined)
            if popped:
                left, seen = popped
            else:
                seen = int(before[i - 1])
        if not stack or stack[-1][0] < value:
            stack.append([value, left, seen])
        stack[-1][2] = joined(stack[-1][2], int(before[i]))
        last = i
    if stack:
        _close(stack, 0, last, out, joined)
    return out


def _close(stack: list, value: int, right: int, out: list, joined) -> tuple[int, int] | None:
    """Ends the intervals longer than ``value`` at ``right``; the last one's left end and symbol go on."""
    popped = None
    while stack and stack[-1][0] > value:
        length, left, seen = stack.pop()
        if popped:
            seen = joined(seen, popped[1])
        if seen == -1 or seen == -3:
            out.append((length, left, right))
        popped = (left, seen)
        if stack and stack[-1][0] >= value:
            stack[-1][2] = joined(stack[-1][2], seen)
            popped = popped if stack[-1][0] > value else None
    return popped


def _longest_at(n: int, repeats: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the longest of the repeats (length, first, last) whose interval has it; 0: none.

    An interval is two overlapping stretches of 2**k places; stretches hand their
    lengths down to their halves, so the work is n log n for any nesting.
    """
    out = np.zeros(n, np.int64)
    if not len(repeats):
        return out
    length, first, last = repeats.T
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max()), -1, -1):
        size = 1 << k
        own = level == k
        np.maximum.at(out, first[own], length[own])
        np.maximum.at(out, last[own] - size + 1, length[own])
        if k:
            held = np.flatnonzero(out)
            np.maximum.at(out, held + size // 2, out[held].copy())
    return out


class Figures(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_covered: np.ndarray
    longest: np.ndarray


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def _covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def figures(texts: pa.Array, min_repeat: int) -> Figures:
    """The base counts and the suffix array's figures of each text of a slice."""
    w = W.words(texts, W.SPACE, lower=False)
    n_docs, n = len(texts), len(w.key)
    codepoint = (w.raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(codepoint)])
    word_chars = np.bincount(w.doc, chars[w.end] - chars[w.start], n_docs).astype(np.int64)
    symbols = _per_text(_SYMBOLS[w.raw], w.bounds)
    # lines with a word, by whole line
    breaks = np.flatnonzero(w.raw == 10)
    line_start = np.unique(np.concatenate([w.bounds[:-1], breaks + 1]))
    line_start = line_start[line_start < len(w.raw)]
    line_doc = np.searchsorted(w.bounds, line_start, "right") - 1
    next_break = np.append(breaks, len(w.raw))[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(next_break, w.bounds[line_doc + 1])
    worded = np.searchsorted(w.start, line_start) < np.searchsorted(w.start, line_end)
    line_doc, (_, line) = line_doc[worded], W.number(*W.span_pairs(w.raw, line_start[worded], line_end[worded]))
    order = np.lexsort((line, line_doc))
    again = np.append(False, (np.diff(line_doc[order]) == 0) & (np.diff(line[order]) == 0)) if len(line) else np.zeros(0, bool)
    dup_lines = np.bincount(line_doc[order][again], minlength=n_docs)
    # one sequence: words by their number, then an own symbol after each text
    _, number = W.number(*W.span_pairs(w.raw, w.start, w.end))
    place = np.arange(n) + w.doc
    symbols_of = np.empty(n + n_docs, np.int64)
    symbols_of[place] = number + n_docs
    symbols_of[w.first[1:] + np.arange(n_docs)] = np.arange(n_docs)
    # a word's number says which text it is in, too: repeats are looked for inside a text only
    inside = np.repeat(np.arange(n_docs), np.diff(w.first) + 1)
    _, symbols_of = np.unique(symbols_of * n_docs + inside, return_inverse=True)
    sa, rank = suffix_array(symbols_of)
    lcp = common_prefixes(symbols_of, sa)
    deepest = np.maximum(lcp, np.append(lcp[1:], 0))[rank][place]  # each word's longest repeat from there on
    three = deepest >= 3
    repeat_words = _covered(n, np.flatnonzero(three), np.full(three.sum(), 3))
    repeats = np.array(maximal_repeats(symbols_of, sa, lcp, min_repeat), np.int64).reshape(-1, 3)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, inside[sa[repeats[:, 1]]], repeats[:, 0])
    # spans that begin at one word lie in the longest of them, so their union needs only that one
    span = _longest_at(len(sa), repeats)[rank][place]
    start = np.flatnonzero(span)
    covered = _covered(n, start, span[start])
    return Figures(np.diff(w.first), word_chars, symbols, dup_lines, _per_text(repeat_words, w.first), _per_text(covered, w.first), longest)


def _figures_map(min_repeat: int):
    def run(batches):
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                f = figures(batch.column(1).slice(a, b - a), min_repeat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.asarray(x, np.int64)) for x in f)], ["doc_id", *Figures._fields])

    return run


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Per row: the base counts, ``base_failed``, ``kept``, ``n_covered`` and ``longest``.

    ``n_covered`` are words inside maximal repeats of ``min_repeat`` words or
    more, ``longest`` is the longest of these (0: none).  A document is kept if
    the base rules pass, at most ``max_covered_percent`` of its words are
    covered and no repeat is longer than ``max_longest`` words.  A null or empty
    text has no words and fails the base rules.  Rows are independent, so
    repeated rows and ids have equal results.
    """
    kind = "doc_id long, " + ", ".join(f"{c} long" for c in Figures._fields)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_figures_map(min_repeat), kind)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= max_covered_percent * F.col("n_words")) & (F.col("longest") <= max_longest)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), "n_covered", "longest")
