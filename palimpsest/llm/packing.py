"""Best-fit-decreasing packing of token pieces into sequences of fixed length.

``pack_matrices`` (ids, segments and position resets of whole sequences) and
``pack_certified`` (a plan with as few sequences as can be shown) share the
segment tree, the lossless split of overlong documents and the tokenizer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import cut

#: Pieces that one task packs at once.
GROUP_ROWS = 40_000
#: Fewest groups of id matrices, so that they spread over a cluster's tasks.
LEAST_GROUPS = 16
#: Most rounds of exchange between groups whose bound leaves a gap.
ROUNDS = 6
#: Bits of a sequence's number inside its group.
BIN_BITS = 20
#: Token ids that a task holds while it writes matrices.
GROUP_TOKENS = 2_000_000
#: Rounded sizes k of the dual feasible functions u(k).
ROUNDED = range(1, 33)


class Capacities:
    """A segment tree over remaining capacities: which are held by some open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        at = left + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin of the smallest remaining capacity of at least ``need``, and that capacity."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not count[at]:
                    at += 1
        left = at - self.size
        bin_ = self.bins[left].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return bin_, left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), and the capacity left in each bin.

    Ties between equal lengths go by their order, ties between bins to the one filled last.
    """
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, left = Capacities(capacity), []
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(need) if need < capacity else None
        bin_, room = found or (len(left), capacity)
        if found is None:
            left.append(capacity)
        bin_of[i], offset[i] = bin_, capacity - room
        left[bin_] = room - need
        if room > need:
            tree.add(room - need, bin_)
    return bin_of, offset, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins by dual feasible functions: sizes, thresholds (L2) and rounding u(k)."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same of how many items each length from 0 to the capacity has."""
    if not count[1:].any():
        return 0
    size = np.arange(capacity + 1)
    total, items = np.concatenate([[0], np.cumsum(count * size)]), np.concatenate([[0], np.cumsum(count)])
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    low = np.arange(1, half + 1)  # items below it are left out, those above capacity - low have a bin each
    alone = items[-1] - items[capacity - low + 1]
    large = items[capacity - low + 1] - items[half + 1]
    room = large * capacity - (total[capacity - low + 1] - total[half + 1])
    small = total[half + 1] - total[low]
    if half:
        best = max(best, int((alone + large + np.maximum(0, -((room - small) // capacity))).max()))
    for k in ROUNDED:
        whole = size * (k + 1) % capacity == 0
        scaled = np.where(whole, size * k, size * (k + 1) // capacity * capacity)  # k times u(k)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def cut_pieces(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """Number, start and length of a document's pieces; only one above capacity is cut."""
    for piece, start in enumerate(range(0, n, capacity)):
        yield piece, start, min(capacity, n - start)


def _pieces_map(path: str, capacity: int, end_id: int, ids_as: str | None):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if ids_as else []))

    def run(batches):
        seen = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, flat, offsets in tokens.encoded(batch.column(1), path):
                out = []
                little = np.ascontiguousarray(flat, "<u4")
                for i in range(len(offsets) - 1):
                    ids = np.append(little[offsets[i] : offsets[i + 1]], np.array([end_id], "<u4"))
                    for piece, start, length in cut_pieces(len(ids), capacity):
                        raw = ids[start : start + length].tobytes()
                        kept = (ids[start : start + length].astype(ids_as).tobytes(),) if ids_as else ()
                        out.append((names[a + i], piece, start, length, zlib.crc32(raw), seen) + kept)
                        seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids_as: str | None = None) -> DataFrame:
    """One row for each piece of a document's ids followed by ``end_id``; a null text counts as empty.

    Document ids are integers.  With ``ids_as``, a number format, the ids go along.  ``salt`` numbers the pieces of a map task, so that repeated or null ids spread too.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + (", ids binary" if ids_as else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces_map(tokenizer_path, capacity, end_id, ids_as), kind)


_CARRIED = ("doc_id", "piece", "start", "length", "ids_crc32", "salt")
_PLAN = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, settled boolean, group_bins long, group_bound long"


def _pack_group(capacity: int, last: bool, number: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        lengths = t.column("length").to_numpy()
        bin_of, offset, left = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        # a certified group gives up its emptiest bin, one with a gap all that aren't full: their pieces are exchanged
        stays = np.full(len(left), True) if last or len(left) == bound else left == 0
        if not last and len(left) == bound:
            stays[left.argmax()] = left.max() == 0
        settled = stays[bin_of]
        sequence = (number << 56) + (key[0].as_py() << BIN_BITS) + bin_of
        out = {c: t.column(c) for c in _CARRIED}
        n = len(lengths)
        return pa.table(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "settled": pa.array(settled), "group_bins": pa.array(np.full(n, len(left))), "group_bound": pa.array(np.full(n, bound))})

    return run


def pack_certified(pieces: DataFrame, *, capacity: int = 2048, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, in as few sequences as the rounds reach, and their groups' certificates.

    Groups of bounded size are packed by best-fit decreasing, and lower bounds
    certify a group's number of sequences.  A certified group keeps all but its
    emptiest sequence, as groups' bounds are rounded up one by one; a group with
    a gap keeps its full ones.  The other pieces are exchanged: dealt to fewer
    groups and packed anew, until one group holds all that is left or the rounds
    are over.  ``group_bins`` and ``group_bound`` are the sequences of the group that
    a piece was last packed in and their lower bound; ``certified`` tells whether
    they agree, so what the rounds leave uncertified is seen in the result, and
    ``certificate`` holds the whole plan against the bound of all pieces.  Repeated rows are pieces like any other; no rows give no rows.
    """
    if not 0 < group_rows < 1 << BIN_BITS:
        raise ValueError(f"groups have less than {1 << BIN_BITS} pieces")
    spark, keep = pieces.sparkSession, [*_CARRIED, "sequence_id", "offset", "group_bins", "group_bound", F.expr("group_bins = group_bound").alias("certified")]
    waiting, done = cut(pieces.select(*_CARRIED)), None
    n = waiting.count()
    for number in range(rounds):
        groups = max(1, -(-n // group_rows))
        last = groups == 1 or number == rounds - 1
        spread = F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(number)), F.lit(groups)).alias("part")
        packed = cut(waiting.select(*_CARRIED, spread).repartition(groups, "part").groupBy("part").applyInArrow(_pack_group(capacity, last, number), _PLAN))
        settled = packed.where("settled").select(*keep)
        done = settled if done is None else done.unionByName(settled)
        waiting = packed.where("not settled")
        n = waiting.count()
        if not n:
            break
    return done if done is not None else spark.createDataFrame([], _PLAN).select(*keep)


def certificate(plan: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """One row: ``sequences`` of a plan, their lower ``bound`` over all its pieces, ``gap``, and ``uncertified`` pieces.

    What comes to the driver is how many pieces each length has: ``capacity`` rows at most.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in plan.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    bound = F.lit(bound_of_counts(counts, capacity)).cast("long")
    found = plan.agg(F.count_distinct("sequence_id").alias("sequences"), F.count_if(~F.col("certified")).alias("uncertified"))
    return found.select("sequences", bound.alias("bound"), (F.col("sequences") - bound).alias("gap"), "uncertified")


def _matrix_group(capacity: int, pad_id: int, ids_as: str):
    kind = np.dtype(ids_as)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        lengths = t.column("length").to_numpy()
        bin_of, offset, left = best_fit_decreasing(lengths, capacity)
        matrix = np.full((len(left), capacity), pad_id, kind)
        for i, raw in enumerate(t.column("ids").to_pylist()):
            matrix[bin_of[i], offset[i] : offset[i] + lengths[i]] = np.frombuffer(raw, kind)
        order = np.lexsort((offset, bin_of))
        first = np.searchsorted(bin_of[order], np.arange(len(left)))
        runs = pa.array(np.append(first, len(order)).astype(np.int32))
        segments = lambda c: pa.ListArray.from_arrays(runs, c.combine_chunks().take(pa.array(order)) if isinstance(c, pa.ChunkedArray) else pa.array(c[order]))
        ends = (offset + lengths).astype(np.int32)
        cumulative = [[0, *x] for x in segments(ends).to_pylist()]
        return pa.table(
            {
                "sequence_id": pa.array((key[0].as_py() << 24) + np.arange(len(left))),
                "n_tokens": pa.array(capacity - left),
                "ids": pa.array([row.tobytes() for row in matrix], pa.binary()),
                "cu_seqlens": pa.array(cumulative, pa.list_(pa.int32())),
                "position_resets": segments(offset.astype(np.int32)),
                "doc_ids": segments(t.column("doc_id")),
                "starts": segments(t.column("start")),
            }
        )

    return run


def pack_matrices(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed sequences of all documents' ids, each a row of the id matrix.

    ``ids`` are ``capacity`` little-endian unsigned ids of 16 bits (32 if the
    vocabulary has more than 65,536), padded with ``pad_id`` after ``n_tokens``; ``cu_seqlens`` are the cumulative segment
    lengths from 0; positions start again at ``position_resets``; ``doc_ids``
    and ``starts`` tell where a segment comes from, so that documents can be put
    together again without loss.  A null text is a document of ``end_id`` alone.
    Groups of about ``GROUP_TOKENS`` ids are packed on their own.
    """
    largest = tokens.tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1
    ids_as = "<u2" if max(largest, end_id, pad_id) < 1 << 16 else "<u4"
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    groups = max(LEAST_GROUPS, int(chars) // 2 // GROUP_TOKENS)
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, ids_as=ids_as)
    part = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)).alias("part")
    kind = "sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"
    return pieces.select("doc_id", "piece", "start", "length", "salt", "ids", part).repartition(groups, "part").groupBy("part").applyInArrow(_matrix_group(capacity, pad_id, ids_as), kind)
