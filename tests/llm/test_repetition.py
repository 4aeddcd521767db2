import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from palimpsest.llm import repetition
from palimpsest.llm.repetition import common_prefixes, figures, maximal_repeats, repetition_rules, suffix_array

from .helpers import SCHEMA, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(w, n):
    if len(w) < n:
        return 0
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    seen = Counter(grams)
    return len({p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + n)})


def brute(text, least):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = max((n for n in range(1, len(w)) if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1), default=0) if len(w) < 500 else None
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), covered(w, 3), covered(w, least), longest if longest is None or longest >= least else 0]


@pytest.mark.parametrize("seed", range(3))
def test_figures_match_brute_force(seed):
    rng = random.Random(seed)
    texts = [r[1] for r in awkward(rng)]
    for _ in range(30):
        part = " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        texts.append("\n".join(rng.choice([part, "# x <b>", "", " ", "y z é"]) for _ in range(rng.randrange(9))))
    f = figures(pa.array(texts), 4)
    for i, text in enumerate(texts):
        want = brute(text, 4)
        got = [int(c[i]) for c in f]
        assert got[:6] == want[:6], text
        assert want[6] is None or got[6] == want[6], text


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, 60)
    order, rank = suffix_array(x)
    assert [tuple(x[i:]) for i in order] == sorted(tuple(x[i:]) for i in range(60))
    lcp = common_prefixes(x, order)
    got = {tuple(x[order[a] : order[a] + n]): b - a + 1 for n, a, b in maximal_repeats(x, order, lcp, 2)}
    want = {}
    for n in range(2, 60):
        places = {}
        for i in range(60 - n + 1):
            places.setdefault(tuple(x[i : i + n]), []).append(i)
        for gram, at in places.items():
            if len(at) > 1 and len({x[i - 1] if i else -1 for i in at}) > 1 and len({x[i + n] if i + n < 60 else -1 for i in at}) > 1:
                want[gram] = len(at)
    assert got == want


def test_rules(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    passage = " ".join(f"p{i}" for i in range(61))
    rows = [(1, clean), (2, clean + " " + clean), (3, None), (4, f"{clean} {passage} {' '.join(f'z{i}' for i in range(900))} {passage}"), (5, "a b c"), (5, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words", "'x' as longest")
    got = {r.doc_id: (r.base_failed, r.kept, r.longest) for r in repetition_rules(docs).collect()}
    assert got == {1: (False, True, 0), 2: (True, False, 80), 3: (True, False, 0), 4: (False, False, 61), 5: (True, False, 0)}
    assert repetition_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repetition.MIN_REPEAT >= 3
