"""Exact Jaccard join of documents in metric space.

``1 - J`` is a metric, so pivots, Voronoi regions and triangle-inequality
windows find every linked pair without looking at all pairs:

1. *Isolation.*  Half of the shingle space (top key bit 0) is dealt to buckets
   as packed fingerprints.  A document with more unshared shingles there than
   the threshold allows to miss is farther than the radius from all others.
   A shingle met twice in a map task's run is known to be shared: the run's
   documents are credited there, and one witness of it goes to its bucket, so
   that a shingle of a third of all documents costs its bucket an entry a run.
2. *Classes.*  Documents with equal sets are one point from here on.
3. *Sparse distances.*  Exact document frequencies of the rest order their
   shingles, rarest first.  Points closer than the radius share a shingle of
   their prefixes, so distances to all other points need not be looked at.
   Shingles of very many points are found first, by counts of map tasks' runs;
   they come last in the order and never go to a bucket.
4. *Regions.*  The members of a prefix shingle elect a pivot; a point goes to
   each pivot elected by one of its shingles (its boundary copies).  Both ends
   of a link meet in a region.
5. *Recursion.*  A region of over ``REGION_ROWS`` points is split by DataFrame
   rounds: it picks ``PIVOTS`` pivots, each point's distances to them are taken,
   and the point goes to the nearest one's Voronoi cell and, as boundary copies,
   to each cell j with ``d(x, p_j) <= min(d(x, home) + 2 r, radius_j + r)``.
   Cells are regions of the next round until they are small.  Points linked with
   one pivot are one component: a cell of these alone is done.  Regions that
   their pivots don't make smaller are compared as pairs of blocks.
6. *Small regions.*  One task compares a small region's points, by pivots, cells
   and windows again, then exactly where all pivot distances differ by at most r.

Links leave a region as a spanning forest, so their number follows the number
of points, and components come from iterated label spreading.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import connected, cut

#: Fingerprints that a bucket should hold, at 4 bytes and a share of a document's run each.
BUCKET_ROWS = 2_000_000
#: Fewest buckets, so that they spread over a cluster's tasks.
LEAST_BUCKETS = 96
#: Shingles gathered before a map task writes a packed row for each bucket.
FLUSH = 2_000_000
#: Points of a region that one task compares; larger ones are split by pivots.
REGION_ROWS = 400
#: Rounds of splitting, and share of a region's pairs that its cells may keep to be worth a split.
ROUNDS, SHRINK = 8, 0.8
#: A shingle is hot if it has as many points, this share of all, and runs of map tasks with so many.  So there are at
#: most (mean set size) / HOT_SHARE hot shingles, which are broadcast with 8 bytes each.
HOT_POINTS, HOT_SHARE, HOT_RUN = 1000, 0.002, 16
#: Stands for the frequency of a hot shingle.
HOT = 2**32 - 1
#: Rows of a table of regions, and bytes of their pivots' sets, up to which these are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: Points that a cell compares without further pivots, and pivots of a region.
LEAF, PIVOTS = 48, 6
#: Stands for a null id while nodes are compared, so that it is the largest.
NO_ID = 2**63 - 1

_KEY = "id long, th long"
_PACK = "bucket int, ids binary, ths binary, runs binary, prints binary, n binary, n_half binary, h1 binary, h2 binary, known binary"


_SIZES = ("n", "n_half", "h1", "h2", "known")


def _need(n, num, den):
    """Fewest shingles of a set of n that a linked set must share: ceil(num * n / den)."""
    return -(-num * n // den)


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _packed(bucket, doc, prints, ids, ths, kind) -> list[tuple]:
    """Rows (bucket, ids, ths, runs, prints): each bucket's entries, document by document.  doc ascends."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, prints = bucket[order], doc[order], prints[order]
    if not len(bucket):
        return []
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    runs = np.diff(np.append(start, len(bucket)))
    owner, of = doc[start], bucket[start]
    cut_runs = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    out = []
    for a, b in zip(cut_runs, np.append(cut_runs[1:], len(of))):
        lo, hi = start[a], start[b] if b < len(start) else len(bucket)
        who = owner[a:b]
        out.append((int(of[a]), _bytes(ids[who], np.int64), _bytes(ths[who], np.int64), _bytes(runs[a:b], np.uint32), _bytes(prints[lo:hi], kind)))
    return out


def _by_bucket(bucket: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and its prints."""
    order = np.argsort(bucket, kind="stable")
    of, starts = np.unique(bucket[order], return_index=True)
    return zip(of.tolist(), np.split(prints[order], starts[1:]))


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """For each slice of a batch (id, th, text): ids, ths, then documents and keys of their shingles."""
    text = batch.column(2)
    for a, b in W.slices(text):
        w = W.words(text.slice(a, b - a), W.SPACE, lower=True)
        doc, key = W.shingle_sets(w, size)
        yield _longs(batch.column(0))[a:b], _longs(batch.column(1))[a:b], doc, key


def _isolation_map(size: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in ("ids", "ths", "runs", "prints", *_SIZES)])

    def rows(held: list) -> pa.RecordBatch:
        base, docs, keys, ids, ths = 0, [], [], [], []
        for i, t, d, k in held:
            docs.append(d + base)
            keys.append(k)
            ids.append(i)
            ths.append(t)
            base += len(i)
        doc, key, ids, ths = (np.concatenate(x) for x in (docs, keys, ids, ths))
        half = key >> np.uint64(63) == 0
        n = np.bincount(doc, minlength=base)
        n_half = np.bincount(doc[half], minlength=base)
        h1, h2 = np.zeros(base, np.uint64), np.zeros(base, np.uint64)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        some = n > 0
        if some.any():
            h1[some] = np.add.reduceat(key, first[some])
            h2[some] = np.bitwise_xor.reduceat(W.mix(key ^ np.uint64(0x5851F42D4C957F2D)), first[some])
        doc, key = doc[half], key[half]
        bucket, prints = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), key & np.uint64(0xFFFFFFFF)
        twice = _shared_mask(key)
        known, once = np.bincount(doc[twice], minlength=base), ~twice
        none = (None,) * len(_SIZES)
        out = [x + none for x in _packed(bucket[once], doc[once], prints[once], ids, ths, np.uint32)]
        _, witness = np.unique(key[twice], return_index=True)
        out += [(b, None, None, None, _bytes(p, np.uint32)) + none for b, p in _by_bucket(bucket[twice][witness], prints[twice][witness])]
        where = int(ths[0] % buckets) if base else 0
        out.append((where, _bytes(ids, np.int64), _bytes(ths, np.int64), None, None, _bytes(n, np.int64), _bytes(n_half, np.int64), _bytes(h1, np.uint64), _bytes(h2, np.uint64), _bytes(known, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in _sets(batch, size):
                held.append(part)
                count += len(part[3]) + len(part[0])
                if count >= FLUSH:
                    yield rows(held)
                    held, count = [], 0
        if held:
            yield rows(held)

    return run


def _unpack(t: pa.Table, kind) -> tuple[np.ndarray, ...]:
    """Entry keys and, for each, the number of its document; then ids and ths of documents."""
    packs = [(np.frombuffer(i, np.int64), np.frombuffer(h, np.int64), np.frombuffer(r, np.uint32), np.frombuffer(p, kind)) for i, h, r, p in zip(*(t.column(c).to_pylist() for c in ("ids", "ths", "runs", "prints"))) if r is not None]
    if not packs:
        return np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, ths, runs, prints = (np.concatenate(x) for x in zip(*packs))
    return prints, np.repeat(np.arange(len(ids)), runs), ids, ths


def _shared_mask(prints: np.ndarray) -> np.ndarray:
    """Entries whose print occurs more than once."""
    order = np.argsort(prints, kind="stable")
    x = prints[order]
    same = x[1:] == x[:-1]
    twice = np.zeros(len(x), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(x), bool)
    out[order] = twice
    return out


def _isolation_reduce(t: pa.Table) -> pa.Table:
    """Shared shingles of each document in one bucket; the rows that tell sizes pass through."""
    prints, doc, ids, ths = _unpack(t, np.uint32)
    witnesses = [np.frombuffer(p, np.uint32) for r, p in zip(t.column("runs").to_pylist(), t.column("prints").to_pylist()) if r is None and p is not None]
    witness = np.unique(np.concatenate(witnesses)) if witnesses else np.zeros(0, np.uint32)
    # a witness stands for at least two documents elsewhere, so it comes twice
    mask = _shared_mask(np.concatenate([prints, witness, witness]))[: len(prints)]
    shared = np.bincount(doc[mask], minlength=len(ids))
    use = np.flatnonzero(shared)
    cols = {"id": [ids[use]], "th": [ths[use]], "shared": [shared[use]], "n": [np.full(len(use), -1)]} | {c: [np.zeros(len(use))] for c in ("n_half", "h1", "h2")}
    for i, h, *sizes in zip(*(t.column(c).to_pylist() for c in ("ids", "ths", *_SIZES))):
        if sizes[0] is not None:
            own = dict(zip(("id", "th", "n", "n_half", "h1", "h2", "shared"), (i, h, *sizes)))
            for c, x in own.items():
                cols[c].append(np.frombuffer(x, np.int64))
    return pa.table({c: pa.array(np.concatenate(x).astype(np.int64)) for c, x in cols.items()})


def _first_rows(ids: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """Rows whose id and text hash no earlier row has."""
    order = np.lexsort((ths, ids))
    i, t = ids[order], ths[order]
    new = np.ones(len(order), bool)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
    out = np.zeros(len(order), bool)
    out[order] = new
    return out


def _hot_map(size: int):
    """Shingles that many texts of a map task's run have, and how many."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def counted(held: list) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= HOT_RUN
        return pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(n[many])], schema=schema)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for *_, key in _sets(batch, size):
                held.append(key)
                count += len(key)
                if count >= FLUSH:
                    yield counted(held)
                    held, count = [], 0
        if held:
            yield counted(held)

    return run


def _in(hot: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted hot ones."""
    if not len(hot):
        return np.zeros(len(key), bool)
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key


_SETS = "bucket int, ids binary, ths binary, runs binary, prints binary, n binary, hot boolean"


def _frequency_map(size: int, buckets: int, hot):
    """Whole sets of the remaining points, dealt by shingle, hot ones by document; ``n`` goes along with each document's run."""
    schema = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in ("ids", "ths", "runs", "prints", "n")] + [("hot", pa.bool_())])

    def run(batches):
        for batch in batches:
            for ids, ths, doc, key in _sets(batch, size):
                n = np.bincount(doc, minlength=len(ids))
                once = _first_rows(ids, ths)[doc]
                doc, key = doc[once], key[once]
                own = W.mix(ths.view(np.uint64))
                often = _in(hot.value, key)
                sizes = dict(zip(zip(ids.tolist(), ths.tolist()), n.tolist()))
                out = []
                for is_hot in (False, True):
                    d, k = doc[often == is_hot], key[often == is_hot]
                    bucket = ((own[d] if is_hot else k >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
                    for r in _packed(bucket, d, k, ids, ths, np.uint64):
                        out.append((*r, _bytes([sizes[x] for x in zip(np.frombuffer(r[1], np.int64).tolist(), np.frombuffer(r[2], np.int64).tolist())], np.int64), is_hot))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _frequency_reduce(t: pa.Table) -> pa.Table:
    """Of each point, its shingles in one bucket that other points have too, and their document frequencies.  Repeated rows are one point."""
    columns = {c: [] for c in ("id", "th", "n", "keys", "dfs")}
    for is_hot in (False, True):
        part = t.filter(pa.array(np.array(t.column("hot").to_numpy(zero_copy_only=False), bool) == is_hot))
        prints, doc, ids, ths = _unpack(part, np.uint64)
        n = np.concatenate([np.frombuffer(x, np.int64) for x in part.column("n").to_pylist()] or [np.zeros(0, np.int64)])
        once = _first_rows(ids, ths)[doc]
        prints, doc = prints[once], doc[once]
        if is_hot:
            df = np.full(len(prints), HOT)
        else:
            _, inverse, count = np.unique(prints, return_inverse=True, return_counts=True)
            df = count[inverse]
            use = df > 1
            prints, doc, df = prints[use], doc[use], df[use]
        cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(doc))
        who = doc[cuts]
        columns["id"] += ids[who].tolist()
        columns["th"] += ths[who].tolist()
        columns["n"] += n[who].tolist()
        columns["keys"] += [_bytes(prints[a:b], np.uint64) for a, b in zip(cuts, ends)]
        columns["dfs"] += [_bytes(df[a:b], np.uint32) for a, b in zip(cuts, ends)]
    return pa.table([pa.array(v, pa.binary() if c in ("keys", "dfs") else pa.int64()) for c, v in columns.items()], names=list(columns))


def _points(num: int, den: int):
    """Points that may have links: their shared shingles, rarest first, and how many of these make the prefix."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("prefix", pa.int64()), ("keys", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for i, t, n, keys, dfs in zip(*(c.to_pylist() for c in batch.columns)):
                key = np.concatenate([np.frombuffer(x, np.uint64) for x in keys])
                df = np.concatenate([np.frombuffer(x, np.uint32) for x in dfs])
                prefix = len(key) - _need(n, num, den) + 1
                if prefix > 0:
                    out.append((i, t, n, prefix, _bytes(key[np.lexsort((key, df))], np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _prefix_map(buckets: int, hot):
    """Points' prefix shingles that aren't hot, dealt by shingle."""
    schema = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in ("ids", "ths", "runs", "prints")])

    def run(batches):
        for batch in batches:
            ids, ths, doc, key = _prefixes(batch)
            use = ~_in(hot.value, key)
            doc, key = doc[use], key[use]
            rows = _packed(((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), doc, key, ids, ths, np.uint64)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _hot_prefix_map(hot):
    """Points' hot prefix shingles, a row each."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, ths, doc, key = _prefixes(batch)
            use = _in(hot.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[doc[use]], ths[doc[use]], key[use].view(np.int64))], schema=schema)

    return run


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    ids, ths, prefix = (_longs(batch.column(c)) for c in (0, 1, 3))
    keys = [np.frombuffer(k, np.uint64)[:p] for k, p in zip(batch.column(4).to_pylist(), prefix)]
    return ids, ths, np.repeat(np.arange(len(keys)), prefix), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _elect(t: pa.Table) -> pa.Table:
    """Points and the pivots of their prefix shingles; the member first in a fixed random order is the pivot."""
    prints, doc, ids, ths = _unpack(t, np.uint64)
    rank = W.mix(ids.astype(np.uint64) ^ W.mix(ths.view(np.uint64)))
    order = np.lexsort((rank[doc], prints))
    prints, doc = prints[order], doc[order]
    new = np.append(True, prints[1:] != prints[:-1]) if len(prints) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    runs = np.diff(np.append(start, len(prints)))
    many = np.repeat(runs > 1, runs)
    pivot = np.repeat(doc[start], runs)
    pairs = np.unique(np.stack([doc[many], pivot[many]], 1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
    return pa.table({"id": ids[pairs[:, 0]], "th": ths[pairs[:, 0]], "pid": ids[pairs[:, 1]], "pth": ths[pairs[:, 1]]})


def _pivot_sets(pivots: list) -> list[tuple[int, np.ndarray]]:
    return [(p["n"], np.sort(np.frombuffer(p["keys"], np.uint64))) for p in pivots]


def _distances(num: int, den: int, sent=None):
    """Each member's distances to its region's pivots, and which pivots it is linked with.  Without ``sent``, rows carry the pivots."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "th", "rk")] + [("far", pa.list_(pa.float64())), ("linked", pa.list_(pa.int32()))])

    def run(batches):
        held = {} if sent is None else sent.value
        for batch in batches:
            ids, ths, rks, n = (_longs(batch.column(c)) for c in ("id", "th", "rk", "n"))
            far, linked = [], []
            for i, (rk, size, keys) in enumerate(zip(rks.tolist(), n.tolist(), batch.column("keys").to_pylist())):
                if rk not in held:
                    held.clear()
                    held[rk] = _pivot_sets(batch.column("pivots")[i].as_py())
                own = np.sort(np.frombuffer(keys, np.uint64))
                both = np.array([int(_in(other, own).sum()) for _, other in held[rk]], np.int64)
                union = np.array([m for m, _ in held[rk]], np.int64) + size - both
                far.append(1 - both / union)
                linked.append(np.flatnonzero(den * both >= num * union).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, ths, rks)), pa.array(far, schema.field("far").type), pa.array(linked, schema.field("linked").type)], schema=schema)

    return run


class _Region:
    """Points of one region, compared exactly; ``label`` holds their components."""

    def __init__(self, n: np.ndarray, keys: list[np.ndarray], side: np.ndarray, num: int, den: int):
        flat = np.concatenate(keys)
        _, self.ids = np.unique(flat, return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        self.n, self.side, self.num, self.den = n.astype(np.int64), side, num, den
        self.radius = 1 - num / den
        self.mask = np.zeros(int(self.ids.max()) + 1 if len(flat) else 1, bool)
        self.label = np.arange(len(n))
        self.links: list[tuple[int, int]] = []

    def overlap(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x's set with the others'."""
        own = self.ids[self.first[x] : self.first[x + 1]]
        self.mask[own] = True
        lengths = self.first[others + 1] - self.first[others]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(self.first[others], lengths)
        sums = np.concatenate([[0], np.cumsum(self.mask[self.ids[at]])])
        self.mask[own] = False
        return sums[ends] - sums[ends - lengths]

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.overlap(x, others)
        return 1 - both / (self.n[x] + self.n[others] - both)

    def test(self, x: int, others: np.ndarray) -> None:
        """Link x with those of the others that are close enough; those of its component need no test."""
        n, have = self.n, self.first[others + 1] - self.first[others]
        own = self.first[x + 1] - self.first[x]
        # fewer shared shingles than a link needs, or sizes too far apart
        can = (self.label[others] != self.label[x]) & (np.minimum(have, own) * (self.num + self.den) >= self.num * (n[x] + n[others]))
        others = others[can]
        if not len(others):
            return
        both = self.overlap(x, others)
        for y in others[self.den * both >= self.num * (n[x] + n[others] - both)]:
            if self.label[y] != self.label[x]:
                self.links.append((x, int(y)))
                low, high = sorted((self.label[x], self.label[y]))
                self.label[self.label == high] = low

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        if len(members) <= LEAF:
            self.compare(members, np.zeros((0, len(members))))
            return
        pivots = members[np.unique(np.linspace(0, len(members) - 1, PIVOTS).astype(int))]
        far = np.stack([self.distance(int(p), members) for p in pivots])
        home, r = far.argmin(0), self.radius + 1e-9
        nearest = far.min(0)
        cells = []
        for j in range(len(pivots)):
            core = home == j
            if core.any():
                cells.append(core | (far[j] <= np.minimum(nearest + 2 * r, nearest[core].max() + r)))
        if depth < 12 and sum(int(c.sum()) ** 2 for c in cells) < 0.8 * len(members) ** 2:
            for c in cells:
                self.join(members[c], depth + 1)
        else:
            self.compare(members, far)

    def compare(self, members: np.ndarray, far: np.ndarray) -> None:
        r = self.radius + 1e-9
        for i, x in enumerate(members):
            later = np.arange(i + 1, len(members))
            if len(far):
                later = later[(np.abs(far[:, i + 1 :] - far[:, i : i + 1]) <= r).all(0)]
            others = members[later]
            if self.side[x] >= 0:  # two blocks: pairs inside a block are another task's
                others = others[self.side[others] != self.side[x]]
            if len(others):
                self.test(int(x), others)


def _regions(num: int, den: int):
    """Links of the regions of one partition, whose rows come sorted by region."""
    schema = pa.schema([("uid", pa.int64()), ("uth", pa.int64()), ("vid", pa.int64()), ("vth", pa.int64())])

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        keys = [np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()]
        ids, ths, n, own, bi, bj = (t.column(c).to_numpy() for c in ("id", "th", "n", "own", "bi", "bj"))
        side = np.where(bi == bj, -1, own).astype(np.int64)
        region = _Region(n, keys, side, num, den)
        region.join(np.lexsort((ths, ids)))
        if not region.links:
            return None
        x, y = np.array(region.links).T
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[x], ths[x], ids[y], ths[y])], schema=schema)

    def run(batches):
        held, of = [], None
        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("rk", "bi", "bj")]
            if not batch.num_rows:
                continue
            new = np.append(True, np.any([c[1:] != c[:-1] for c in names], axis=0))
            start = np.flatnonzero(new)
            for a, b in zip(start, np.append(start[1:], batch.num_rows)):
                this = tuple(c[a] for c in names)
                if this != of and held:
                    if (links := solve(pa.Table.from_batches(held))) is not None:
                        yield links
                    held = []
                of = this
                held.append(batch.slice(a, b - a))
        if held and (links := solve(pa.Table.from_batches(held))) is not None:
            yield links

    return run


class _Rounds:
    """Splits large regions by pivots until they are small; collects links, small regions and blocks."""

    def __init__(self, points: DataFrame, num: int, den: int):
        self.points, self.num, self.den, self.radius = points, num, den, 1 - num / den + 1e-9
        self.links: list[DataFrame] = []  # uid, uth, vid, vth
        self.dealt: list[DataFrame] = []  # id, th, rk, own, bi, bj

    def _small(self, table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= BROADCAST_ROWS else table

    def run(self, members: DataFrame) -> None:
        """``members`` (id, th, rk) of regions above the limit."""
        for number in range(ROUNDS):
            members = self._round(members, last=number == ROUNDS - 1)
            if members is None:
                return

    def _measured(self, members: DataFrame) -> tuple[DataFrame, int]:
        order = F.row_number().over(Window.partitionBy("rk").orderBy(F.xxhash64("id", "th", "rk"), "id", "th"))
        chosen = members.withColumn("place", order).where(F.col("place") <= PIVOTS)
        sets = chosen.join(self.points.select("id", "th", "n", "keys"), ["id", "th"])
        pivots = cut(sets.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("place", "id", "th", "n", "keys"))).alias("pivots")))
        regions, size = pivots.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda a, p: a + F.length(p["keys"]))), F.lit(0))).first()
        owned = self.points.select("id", "th", "n", "keys").join(members, ["id", "th"])
        if regions <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
            sets = {r.rk: _pivot_sets(r.pivots) for r in pivots.toLocalIterator()}
            given, look = owned.select("id", "th", "rk", "n", "keys"), _distances(self.num, self.den, pivots.sparkSession.sparkContext.broadcast(sets))
        else:
            given, look = owned.join(pivots, "rk").select("id", "th", "rk", "n", "keys", "pivots"), _distances(self.num, self.den)
        found = given.mapInArrow(look, "id long, th long, rk long, far array<double>, linked array<int>")
        named = pivots.select("rk", F.transform("pivots", lambda p: F.struct(p["id"].alias("id"), p["th"].alias("th"))).alias("pivots"))
        far = cut(found.join(self._small(named, regions), "rk"))
        pivot = lambda c: F.col(f"pivots.{c}")[F.col("j")]
        self.links.append(far.select("id", "th", "pivots", F.explode("linked").alias("j")).select(F.col("id").alias("uid"), F.col("th").alias("uth"), pivot("id").alias("vid"), pivot("th").alias("vth")).where("not (uid = vid and uth = vth)"))
        return far, regions

    def _round(self, members: DataFrame, last: bool) -> DataFrame | None:
        far, regions = self._measured(members)
        at = F.array_position("far", F.array_min("far")).cast("int") - 1
        far = far.select("id", "th", "rk", "far", F.coalesce(F.try_element_at("linked", F.lit(1)), F.lit(-1)).alias("label"), at.alias("home"), F.array_min("far").alias("near"))
        cells = far.groupBy("rk", "home").agg(F.max("near").alias("radius"))
        radii = cells.groupBy("rk").agg(F.map_from_entries(F.collect_list(F.struct("home", "radius"))).alias("radii"))
        window = lambda j: F.element_at("far", j + 1) <= F.least(F.col("near") + 2 * self.radius, F.try_element_at("radii", j) + self.radius)
        into = F.filter(F.sequence(F.lit(0), F.size("far") - 1), lambda j: F.map_contains_key("radii", j) & window(j))
        copies = far.join(self._small(radii, regions), "rk").select("id", "th", "rk", "label", F.explode(into).alias("j")).withColumn("cell", F.xxhash64("rk", "j"))
        one_label = (F.min("label") == F.max("label")) & (F.min("label") >= 0)
        sizes = cut(copies.groupBy("rk", "cell").agg(F.count("*").alias("size"), one_label.alias("done")))
        labels = far.groupBy("rk", "label").count().groupBy("rk").agg(F.sum("count").alias("all"), F.max_by("label", F.when(F.col("label") >= 0, F.col("count"))).alias("core"), F.max(F.when(F.col("label") >= 0, F.col("count"))).alias("cores"))
        left = sizes.where("not done").groupBy("rk").agg(F.sum(F.expr("double(size) * size")).alias("pairs"))
        plan = cut(labels.join(left, "rk", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0.0))))
        splits = (F.lit(not last) & (F.col("pairs") < SHRINK * F.col("all") * F.col("all"))) | (F.col("pairs") == 0)
        self._blocks(far, plan.where(~splits), regions)
        live = sizes.join(self._small(plan.where(splits).select("rk"), regions), "rk", "left_semi").where("not done")
        n_live = live.count()
        kept = cut(copies.select("id", "th", "cell").join(self._small(live.select("cell", "size"), n_live), "cell"))
        self.dealt.append(kept.where(F.col("size") <= REGION_ROWS).select("id", "th", F.col("cell").alias("rk"), *[F.lit(0).alias(c) for c in ("own", "bi", "bj")]))
        large = kept.where(F.col("size") > REGION_ROWS).select("id", "th", F.col("cell").alias("rk"))
        return None if large.isEmpty() else large

    def _blocks(self, far: DataFrame, plan: DataFrame, regions: int) -> None:
        """Pairs of blocks; of points linked with the pivot that has the most, none are compared with each other."""
        blocks = lambda n: F.ceil(n / REGION_ROWS).cast("int")
        cores = F.coalesce("cores", F.lit(0))
        counts = plan.select("rk", "core", blocks(F.col("all") - cores).alias("rest"), blocks(cores).alias("cores")).where("rest > 0")
        marked = far.select("id", "th", "rk", "label").join(self._small(counts, regions), "rk")
        place = lambda c: F.pmod(F.hash("id", "th"), F.greatest(F.col(c), F.lit(1)))
        is_core = F.col("label") == F.coalesce("core", F.lit(-2))
        # blocks of the rest come first; they meet all blocks, the pivot's neighbours only those
        own = marked.withColumn("is_core", is_core).withColumn("own", F.when(F.col("is_core"), F.col("rest") + place("cores")).otherwise(place("rest")))
        met = F.when(F.col("is_core"), F.col("rest")).otherwise(F.col("rest") + F.col("cores"))
        pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
        self.dealt.append(pairs.select("id", "th", "rk", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Per distinct id and text: ``id, th`` (the text's hash), ``n`` (set size), ``first`` (struct id, th), ``copies`` (rows).

    ``first`` is the least id, and of equal ids the least text hash, of the
    component; ids are integers, a null one is the largest.  A null or wordless
    text has an empty set and is its own component.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // 10 // BUCKET_ROWS)
    packed = rows.mapInArrow(_isolation_map(shingle, buckets), _PACK).repartition(buckets, "bucket")
    counted = packed.groupBy("bucket").applyInArrow(_isolation_reduce, f"{_KEY}, shared long, n long, n_half long, h1 long, h2 long")
    told = F.col("n") >= 0
    stats = cut(
        counted.groupBy("id", "th")
        .agg(F.sum("shared").alias("shared"), F.max("n").alias("n"), F.max(F.when(told, F.col("n_half"))).alias("n_half"), F.max(F.when(told, F.col("h1"))).alias("h1"), F.max(F.when(told, F.col("h2"))).alias("h2"), F.count_if(told).alias("copies"))
    )
    node = F.struct("id", "th")
    missing = F.col("n_half") - F.least("shared", "n_half")
    classes = cut(stats.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(node).alias("rep"), F.max(missing).alias("missing")))
    close = cut(classes.where(F.col("missing") <= F.col("n") - F.ceil(F.col("n") * num / den)).select("rep.*"))
    n_close = close.count()
    few = max(LEAST_BUCKETS, buckets // 4)
    texts = rows.join(close, ["id", "th"], "left_semi")
    often = texts.mapInArrow(_hot_map(shingle), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_POINTS, HOT_SHARE * n_close))
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in often.collect()], np.int64).view(np.uint64)))
    sets = texts.mapInArrow(_frequency_map(shingle, few, hot), _SETS).repartition(few, "bucket")
    shared = sets.groupBy("bucket").applyInArrow(_frequency_reduce, f"{_KEY}, n long, keys binary, dfs binary")
    gathered = shared.groupBy("id", "th").agg(F.max("n").alias("n"), F.collect_list("keys").alias("keys"), F.collect_list("dfs").alias("dfs"))
    points = cut(gathered.mapInArrow(_points(num, den), f"{_KEY}, n long, prefix long, keys binary"))
    elected = points.mapInArrow(_prefix_map(few, hot), "bucket int, ids binary, ths binary, runs binary, prints binary").repartition(few, "bucket").groupBy("bucket").applyInArrow(_elect, f"{_KEY}, pid long, pth long")
    if len(hot.value):
        in_hot = points.mapInArrow(_hot_prefix_map(hot), "id long, th long, key long")
        first = in_hot.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "th"), "id", "th")).alias("p"))  # as many rows as hot shingles
        elected = elected.unionByName(in_hot.join(F.broadcast(first), "key").select("id", "th", F.col("p.id").alias("pid"), F.col("p.th").alias("pth")))
    homes = cut(elected.distinct().withColumn("rk", F.xxhash64("pid", "pth")).select("id", "th", "rk").distinct())
    # kept, so that the join with homes has two plain exchanges and a hot pivot's side can be split
    sizes = cut(homes.groupBy("rk").agg(F.count("*").alias("size")).where("size > 1"))
    sized = homes.join(sizes, "rk")
    rounds = _Rounds(points, num, den)
    rounds.dealt.append(sized.where(F.col("size") <= REGION_ROWS).select("id", "th", "rk", *[F.lit(0).alias(c) for c in ("own", "bi", "bj")]))
    if not sizes.where(F.col("size") > REGION_ROWS).isEmpty():
        rounds.run(cut(sized.where(F.col("size") > REGION_ROWS).select("id", "th", "rk")))
    dealt = reduce(DataFrame.unionByName, rounds.dealt)
    full = dealt.join(points.select("id", "th", "n", "keys"), ["id", "th"])
    region = ["rk", "bi", "bj"]
    found = full.repartition(few, *region).sortWithinPartitions(*region).mapInArrow(_regions(num, den), "uid long, uth long, vid long, vth long")
    links = cut(reduce(DataFrame.unionByName, rounds.links, found))
    edge = lambda a: F.struct(F.col(f"{a}id").alias("id"), F.col(f"{a}th").alias("th"))
    labels = connected(links.select(edge("u").alias("u"), edge("v").alias("v")))
    homes_of = classes.join(labels, classes.rep == labels.node, "left").select("h1", "h2", "n", F.coalesce("label", "rep").alias("first"))
    out = stats.join(homes_of, ["h1", "h2", "n"], "left")
    return out.select("id", "th", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct("id", "th")).alias("first"), "copies")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Components of documents linked by ``den * |A & B| >= num * |A | B|`` of their word shingles.

    Returns ``doc_id, n_shingles, component_id``, one row for each row of
    ``docs``.  A null or wordless text has an empty set (``n_shingles`` 0) and
    is its own component.  Repeated rows keep their number; rows that share an
    id but not a text are points of their own under that id.  A null id counts
    as larger than all others, and a component of null ids alone has a null
    ``component_id``.  Ids are integers.  Other columns are not looked at.
    """
    out = jaccard_classes(docs, id_col=id_col, text_col=text_col, shingle=shingle, num=num, den=den)
    out = out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(shown("id").alias(id_col), F.col("n").alias("n_shingles"), shown("first.id").alias("component_id"))
