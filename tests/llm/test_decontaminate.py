import hashlib
import random
import re

import pytest
from palimpsest.llm.decontaminate import contamination

from .helpers import SCHEMA, awkward, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = split(text)
        if w and item is not None:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if of := windows.get(tuple(w[i : i + m])):
                    found |= of
                    hit.update(range(i, i + m))
        names = ",".join(sorted(map(str, found)))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    rows = awkward(rng)
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 20_000).split()
    items = [(i, " ".join(words(rng, rng.choice([10, 12, 30])))) for i in range(20)]
    items += [(100, " ".join(long[500:540])), (101, " ".join(long[515:530])), (102, " ".join(long[2040:2060])), (103, "a"), (104, "a a"), (105, "a a a"), (9, ""), (10, None), (None, "w1 w2"), (106, "W3 w4!"), (100, " ".join(long[500:540]))]
    for i, (_, text) in enumerate(items[:8]):
        rows.append((1000 + i, f"Start, {text.upper()}. and {text[:60]}", None, None, None))
    return rows, items


@pytest.mark.parametrize("limit", [400_000, 50])
def test_hits_match_brute_force(spark, limit):
    rows, items = tables(3)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as item_id", "2 as n_hit", "3 as n_words")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as words")
    got = sorted((tuple(r)[:6] for r in contamination(docs, bench, pass_windows=limit).collect()), key=str)
    assert got == brute(rows, items)


def test_empty_tables(spark):
    rows, items = tables(4)
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination(spark.createDataFrame(rows, SCHEMA), none).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)
    assert contamination(spark.createDataFrame([], SCHEMA), none).collect() == []
