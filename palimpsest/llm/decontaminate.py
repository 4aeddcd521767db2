"""Benchmark passages in documents by Wu-Manber search over words.

The alphabet is words (by 64-bit key), a block is two words.  A shift table,
indexed by block hash, tells how far a search may move on: no window ends
there otherwise.  At shift 0, windows whose last block has that hash (their
suffix bucket) are compared word by word.  All texts of a slice are searched in
step, long ones in overlapping stretches, so each step is a few numpy calls.
What agrees by the words' keys is confirmed by comparing the words' bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import cut

#: Words of a benchmark window.
WINDOW = 10
#: Windows of items that a pass broadcasts (about 100 bytes and their text each), and bytes of their texts; more are searched in several passes.
PASS_WINDOWS, PASS_BYTES = 400_000, 64_000_000
#: Entries of a shift table, as a power of two.
TABLE_BITS = 20
#: Words of a stretch of a long text; bytes that are compared at once.
STRETCH, COMPARED = 2048, 4_000_000


class Windows(NamedTuple):
    """Distinct windows of one length, sorted by their last block's hash, and the items that have them."""

    words: np.ndarray  # windows x length
    suffix: np.ndarray  # hash of each window's last block
    shift: np.ndarray  # by block hash
    text: np.ndarray  # bytes of all windows' words, a blank after each
    text_first: np.ndarray
    item_first: np.ndarray
    items: list


def _blocks(keys: np.ndarray, size: int) -> np.ndarray:
    return (W.gram_keys(keys, size) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build(words: list[np.ndarray], texts: list[bytes], items: list) -> Windows:
    """Tables for windows of one length: their words' keys, the words with a blank after each, their items."""
    of_text: dict[bytes, int] = {}
    row = [of_text.setdefault(t, len(of_text)) for t in texts]
    rows = np.zeros((len(of_text), len(words[0])), np.uint64)
    for r, keys in zip(row, words):
        rows[r] = keys
    m = rows.shape[1]
    block = min(2, m)
    shift = np.full(1 << TABLE_BITS, m - block + 1, np.uint8)
    hashes = np.stack([_blocks(r, block) for r in rows])
    for end in range(hashes.shape[1]):  # later blocks of a window have smaller shifts
        np.minimum.at(shift, hashes[:, end], hashes.shape[1] - 1 - end)
    order = np.argsort(hashes[:, -1], kind="stable")
    place = np.argsort(order)
    by_row = sorted({(int(place[r]), i) for r, i in zip(row, items)})
    first = np.searchsorted([r for r, _ in by_row], np.arange(len(rows) + 1))
    ordered = [t for _, t in sorted((int(place[r]), t) for t, r in of_text.items())]
    text_first = np.concatenate([[0], np.cumsum([len(t) for t in ordered])])
    return Windows(rows[order], hashes[order, -1], shift, np.frombuffer(b"".join(ordered), np.uint8), text_first, first, [i for _, i in by_row])


def _confirmed(tables: Windows, w: W.Words, start: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether the words from each start on are the window's, byte for byte."""
    m = tables.words.shape[1]
    at = start[:, None] + np.arange(m)
    sizes = w.end[at] - w.start[at] + 1
    want = tables.text_first[window + 1] - tables.text_first[window]
    out = sizes.sum(1) == want
    use = np.flatnonzero(out)
    total = np.cumsum(want[use])
    while len(use):
        n = max(1, int(np.searchsorted(total, (total[0] - want[use[0]]) + COMPARED, "right")))
        part, use, total = use[:n], use[n:], total[n:]
        size = sizes[part].ravel()
        ends = np.cumsum(size)
        inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
        own = w.raw[np.minimum(np.repeat(w.start[at[part]].ravel(), size) + inner, len(w.raw) - 1)]
        own[ends - 1] = 0x20
        length = want[part]
        stops = np.cumsum(length)
        theirs = tables.text[np.arange(stops[-1]) - np.repeat(stops - length - tables.text_first[window[part]], length)]
        out[part] = np.add.reduceat((own != theirs).astype(np.int64), stops - length) == 0
    return out


def search(tables: Windows, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts of occurrences among the words of a slice, and their windows."""
    keys, first = w.key, w.first
    m = tables.words.shape[1]
    block = min(2, m)
    if len(keys) < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = _blocks(keys, block)
    lengths = np.diff(first)
    parts = np.maximum(0, -(-(lengths - m + 1) // STRETCH))
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    # positions are those of a window's last block
    at = first[text] + number * STRETCH + m - block
    end = np.minimum(first[text] + (number + 1) * STRETCH + m - block, first[text + 1] - block + 1)
    found_at, found = [], []
    while len(at):
        hash_ = hashed[at]
        step = tables.shift[hash_].astype(np.int64)
        zero = np.flatnonzero(step == 0)
        if len(zero):
            here, suffix = at[zero], hash_[zero]
            low, high = np.searchsorted(tables.suffix, suffix), np.searchsorted(tables.suffix, suffix, "right")
            size = high - low
            ends = np.cumsum(size)
            window = np.arange(ends[-1]) - np.repeat(ends - size - low, size)
            start = np.repeat(here, size) - (m - block)
            same = np.ones(len(window), bool)
            for i in range(m):
                live = np.flatnonzero(same)
                same[live] = keys[start[live] + i] == tables.words[window[live], i]
            start, window = start[same], window[same]
            same = _confirmed(tables, w, start, window)
            found_at.append(start[same])
            found.append(window[same])
            step[zero] = 1
        at = at + step
        live = at < end
        at, end = at[live], end[live]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)


def _windows_map(window: int):
    schema = pa.schema([("item", pa.int64()), ("words", pa.binary()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            for a, b in W.slices(text):
                w = W.words(text.slice(a, b - a), W.NOT_WORDLIKE, lower=True)
                names, out = batch.column(0).slice(a, b - a).to_pylist(), []
                for i, name in enumerate(names):
                    own = w.key[w.first[i] : w.first[i + 1]]
                    if len(own):
                        m = min(window, len(own))
                        spelt = [w.raw[x:y].tobytes() + b" " for x, y in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
                        out += [(name, own[j : j + m].tobytes(), b"".join(spelt[j : j + m])) for j in range(len(own) - m + 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _search_map(tables, names: list[str]):
    """Adds a pass's hits to the packed marks (a bit for each word) and item lists that rows carry."""

    def run(batches):
        searchers = tables.value
        for batch in batches:
            text, marks_in, items_in = (batch.column(batch.schema.get_field_index(c)) for c in names)
            counts, hits, marks_out, items_out = [], [], [], []
            for a, b in W.slices(text):
                w = W.words(text.slice(a, b - a), W.NOT_WORDLIKE, lower=True)
                edge = np.zeros(len(w.key) + 1, np.int64)
                pairs = set()
                for t in searchers:
                    start, window = search(t, w)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + t.words.shape[1], -1)
                    doc = w.doc[start] if len(start) else start
                    for d, x in set(zip(doc.tolist(), window.tolist())):
                        pairs.update((d, i) for i in t.items[t.item_first[x] : t.item_first[x + 1]])
                hit = np.cumsum(edge[:-1]) > 0
                of: dict[int, set] = {}
                for d, i in pairs:
                    of.setdefault(d, set()).add(i)
                total = np.concatenate([[0], np.cumsum(hit)])
                own = total[w.first[1:]] - total[w.first[:-1]]
                for d in range(b - a):
                    before, x, y = marks_in[a + d].as_py(), w.first[d], w.first[d + 1]
                    items = of.get(d, set()) | set(items_in[a + d].as_py() or ())
                    marks, n = before, int(own[d])
                    if n or before:
                        mine = hit[x:y]
                        if before:
                            mine = mine | np.unpackbits(np.frombuffer(before, np.uint8), count=y - x).astype(bool)
                        marks, n = np.packbits(mine).tobytes(), int(mine.sum())
                    counts.append(int(y - x))
                    hits.append(n)
                    marks_out.append(marks)
                    items_out.append(sorted(items))
            new = {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "marks": pa.array(marks_out, pa.binary()), "items": pa.array(items_out, pa.list_(pa.int64()))}
            cols = [new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([(f.name, c.type) for f, c in zip(batch.schema, cols)]))

    return run


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_windows: int = PASS_WINDOWS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``row`` (a document's row, whatever its columns), ``text``, ``n_words``, ``n_hit``, ``items`` and ``marks``.

    ``n_hit`` counts words inside an occurrence, ``marks`` has a bit for each
    word, ``items`` are the sorted ids of items with occurrences.

    A null or wordless text has no words and no hits; an item without words or
    id is left out; repeated items count once; item ids are integers.  Rows are
    not shuffled.  The benchmark's windows are measured first: up to
    ``pass_windows`` windows of items and ``pass_bytes`` bytes of their texts go
    out in one broadcast, more in as many passes as needed.  A window that very
    many items share is dealt over passes like any others, as marks and items
    add up.
    """
    spark = docs.sparkSession
    windows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    windows = cut(windows.mapInArrow(_windows_map(window), "item long, words binary, body binary").distinct())
    size = F.sum(F.length("body"))
    n, total = windows.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    passes, own = max(1, -(-n // pass_windows), -(-total // pass_bytes)), F.lit(0)
    while passes > 1:
        own = F.pmod(F.xxhash64("item", "body"), F.lit(passes))
        most, most_bytes = windows.groupBy(own).agg(F.count("*").alias("n"), size.alias("b")).agg(F.max("n"), F.max("b")).first()
        if most <= 1.25 * pass_windows and most_bytes <= 1.25 * pass_bytes or passes >= n:
            break
        passes *= 2
    zero = F.lit(0).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), zero.alias("n_words"), zero.alias("n_hit"), F.lit(None).cast("binary").alias("marks"), F.array().cast("array<bigint>").alias("items"))
    for number in range(passes):
        by_size: dict[int, tuple[list, list, list]] = {}
        for item, words, body in windows.where(own == number).toLocalIterator():
            keys, texts, names = by_size.setdefault(len(words) // 8, ([], [], []))
            keys.append(np.frombuffer(words, np.uint64))
            texts.append(bytes(body))
            names.append(item)
        tables = spark.sparkContext.broadcast([build(*x) for x in by_size.values()])
        rows = rows.mapInArrow(_search_map(tables, ["text", "marks", "items"]), rows.schema)
        if passes > 1:
            rows = cut(rows)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    marked = mark_contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )
