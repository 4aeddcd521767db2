import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from palimpsest.llm.packing import best_fit_decreasing, lower_bound, pack_certified, pack_matrices, token_pieces
from tokenizers import Tokenizer

from .helpers import SCHEMA, awkward

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a.b.c, d.,e", "x<|endoftext|>y. <|startoftext|>", "É.é,A.'s it's. they'll, é.", "ΑΣ. ΑΣ, ſ.K.", " a.　b, \x1c c.", "123.4,5 a1.b", "don't.'re,'ll a.'s", "ﬁ.,İ.i̇, ȧ."]


def rows_of(seed):
    rows = awkward(random.Random(seed))
    return rows + [(500 + i, t, None, None, None) for i, t in enumerate(ODD)]


def brute_best_fit(lengths, capacity):
    left, bins = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [b for b in range(len(left)) if left[b] >= lengths[i]]
        if fits:
            b = min(fits, key=lambda b: left[b])
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= lengths[i]
        bins[i] = b
    return len(left), sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing_and_its_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 16, 100, 2048]))
    lengths = rng.integers(1, capacity + 1, 200)
    bin_of, offset, left = best_fit_decreasing(lengths, capacity)
    assert (len(left), sorted(left.tolist())) == brute_best_fit(lengths.tolist(), capacity)
    for b in range(len(left)):
        own = sorted(zip(offset[bin_of == b], lengths[bin_of == b]))
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) + left[b] == capacity
    assert -(-lengths.sum() // capacity) <= lower_bound(lengths, capacity) <= len(left)


def test_bounds_see_large_items():
    assert lower_bound(np.array([1500] * 10), 2048) == 10
    assert lower_bound(np.array([683] * 9), 2048) == 5
    assert lower_bound(np.zeros(0, np.int64), 2048) == 0


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def test_plan_is_whole_and_tight(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "2 as salt", "3 as length")
    plan = pack_certified(token_pieces(docs, PATH, capacity=512), capacity=512, group_rows=40).collect()
    want = []
    for r in rows:
        ids = ids_of(r[1])
        for k, start in enumerate(range(0, len(ids), 512)):
            part = ids[start : start + 512]
            want.append((r[0], k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in plan), key=str) == sorted(want, key=str)
    bins = {}
    for r in plan:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 512
    assert len(bins) <= lower_bound(np.array([r.length for r in plan]), 512) + 1


def test_matrices_round_trip(spark):
    rows = rows_of(2)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "2 as starts")
    parts = {}
    for r in pack_matrices(docs, PATH, capacity=256).collect():
        line = np.frombuffer(r.ids, "<u2")
        assert len(line) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not line[r.n_tokens :].any()
        assert list(r.position_resets) == list(r.cu_seqlens[:-1])
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault((doc, start), []).append(line[a:b].tolist())
    want = {}
    for r in rows:
        ids = ids_of(r[1])
        for start in range(0, len(ids), 256):
            want.setdefault((r[0], start), []).append(ids[start : start + 256])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack_matrices(none, PATH).collect() == []
    assert pack_certified(token_pieces(none, PATH)).collect() == []
