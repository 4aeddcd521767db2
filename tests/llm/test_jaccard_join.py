import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from palimpsest.llm import jaccard_join
from palimpsest.llm import wordhash as W
from palimpsest.llm.jaccard_join import _Region, jaccard_components

from .helpers import SCHEMA, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_labels(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    return label


def brute(rows):
    big = 2**63 - 1
    sets, label = [shingles(r[1]) for r in rows], brute_labels(rows)
    ids = [big if r[0] is None else r[0] for r in rows]
    low = {}
    for i, x in enumerate(label):
        low[x] = min(low.get(x, big), ids[i])
    shown = lambda x: None if x == big else x
    return sorted(((shown(ids[i]), len(sets[i]), shown(low[label[i]])) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = awkward(random.Random(seed))
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as n", "3 as component_id", "4 as th")
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("copies", [2, 3])
def test_repeated_rows_do_not_link_distant_documents(spark, copies):
    """A whole table repeated: pairs of J from 0.2 to 0.9 around the bound, and shingles shared with a third document."""
    rng = random.Random(copies)
    rows = []
    for i in range(40):
        base = [f"d{i}w{j}" for j in range(100)]
        kept = rng.randrange(35, 97)
        rows.append((2 * i, " ".join(base), None, None, None))
        rows.append((2 * i + 1, " ".join(base[:kept] + [f"e{i}w{j}" for j in range(100 - kept)]), None, None, None))
    rows *= copies
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_large_regions_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 10)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        near = list(base)
        for _ in range(rng.randrange(1, 8)):
            near[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), None, None, None))
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_no_documents(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_a_region_recurs_exactly(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 10**6, 60)
        for _ in range(rng.integers(1, 40)):
            near = base.copy()
            near[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 10**6)
            sets.append(np.unique(near).astype(np.uint64))
    n = np.array([len(s) for s in sets])
    region = _Region(n, sets, np.full(len(sets), -1), 75, 100)
    region.join(np.arange(len(sets)))
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (n[i] + n[j] - both) and label[i] != label[j]:
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    assert len({(a, b) for a, b in zip(label, region.label)}) == len(set(label)) == len(set(region.label.tolist()))


@pytest.mark.parametrize("flush", [1, 40, 10**6])
def test_shared_shingles_are_counted_alike_within_and_across_runs(monkeypatch, flush):
    monkeypatch.setattr(jaccard_join, "FLUSH", flush)
    rng = random.Random(flush)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(common[: rng.randrange(31)] + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(20))]) for _ in range(60)]
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 10)), pa.array(range(i, i + 10)), pa.array(texts[i : i + 10])], schema=schema) for i in range(0, 60, 10)]
    packed = pa.Table.from_batches(list(jaccard_join._isolation_map(5, 7)(iter(batches))))
    got, told = dict.fromkeys(range(60), 0), {}
    for b in range(7):
        counted = jaccard_join._isolation_reduce(packed.filter(pc.equal(packed["bucket"], b)))
        for row in counted.to_pylist():
            got[row["id"]] += row["shared"]
            if row["n"] >= 0:
                told[row["id"]] = row["n"]
    sets = []
    for t in texts:
        keys = W.shingle_sets(W.words(pa.array([t]), W.SPACE, lower=True), 5)[1]
        sets.append(keys[keys >> np.uint64(63) == 0].tolist())
    often = Counter(k for s in sets for k in s)
    assert got == {i: sum(often[k] > 1 for k in s) for i, s in enumerate(sets)}
    assert told == {i: len(shingles(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("changes", "broadcast"), [(1, 10**6), (12, 10**6), (12, 0)])
def test_a_group_around_its_pivot_is_linked_without_block_pairs(spark, monkeypatch, changes, broadcast):
    """Few changes: all points are linked with the pivot.  Many: only some are."""
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", broadcast)
    rng = random.Random(changes)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(70):
        near = list(base)
        for _ in range(rng.randrange(changes + 1)):
            near[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), None, None, None))
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def near_copies(rng, n, changes, size=120):
    base, rows = [f"b{i}" for i in range(size)], []
    for i in range(n):
        near = list(base)
        for _ in range(rng.randrange(changes + 1)):
            near[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), None, None, None))
    return rows


def test_hot_shingles_take_their_own_way(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_POINTS", 5)
    monkeypatch.setattr(jaccard_join, "HOT_RUN", 2)
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 12)
    rows = near_copies(random.Random(3), 60, 9) + awkward(random.Random(3))
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize(("rounds", "size"), [(1, 10**8), (6, 10**8), (6, 0)])
def test_regions_split_by_pivots_are_whole(spark, monkeypatch, rounds, size):
    """Several groups that share a rare passage: cells part them; with one round only, blocks do; without broadcast, joins do."""
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 6)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", size)
    rng = random.Random(rounds)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for group in range(5):
        own = [f"g{group}w{i}" for i in range(60)]
        for _ in range(14):
            near = own + passage
            for _ in range(rng.randrange(14)):
                near[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near), None, None, None))
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
