import itertools
import random

import numpy as np
import pytest
from palimpsest.llm import language
from palimpsest.llm.language import fit, identify, marginals, train

from .helpers import SCHEMA

SYLLABLES = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "eit", "pf"], "zz": ["éo", "ção", "nh", "lhe"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_forward_backward_is_exact(seed, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 3)
    rng = np.random.default_rng(seed)
    lengths, k = [1, 5, 0, 7, 3, 6], 3
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores, trans = rng.normal(size=(first[-1], k)), rng.normal(size=(k, k))
    got = marginals(scores, first, trans)
    for a, b in zip(first, first[1:]):
        want, total = np.zeros((b - a, k)), 0.0
        for path in itertools.product(range(k), repeat=b - a):
            if path:
                start = np.log(np.exp(trans[:, path[0]]).mean())
                p = np.exp(start + sum(scores[a + i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
                total += p
                for i, y in enumerate(path):
                    want[i, y] += p
        if b > a:
            np.testing.assert_allclose(got[a:b], want / total, rtol=1e-9)


def test_held_out_accuracy_and_code_switches(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(20, 80)), lang, None, None) for i in range(150) for lang in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train(docs, usable=lambda i: i % 4 != 2)
    assert model.langs == ["xx", "yy", "zz"]
    odd = [(1000, None, None), (1001, "", None), (1002, "123 ... !", None), (1003, "—«»", None), (1004, text(rng, "xx", 20_000), "xx"), (None, "katomi", "xx"), (1005, text(rng, "xx", 20) + " " + text(rng, "yy", 30), "yy"), (1005, text(rng, "zz", 20), "zz")]
    tested = docs.where("doc_id % 4 = 2").union(spark.createDataFrame([(*x, None, None) for x in odd], SCHEMA)).selectExpr("*", "1 as score", "2 as lang_pred")
    got = identify(tested, model, extra=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got if r.lang) >= 0.97 * sum(r.lang is not None for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002, 1003}
    switched = next(r for r in got if r.doc_id == 1005 and r.lang == "yy")
    assert 1 <= switched.n_switches <= 3 and switched.lang_pred == "yy"


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in identify(docs, train(docs)).collect()] == [("und", 0.0)]
    assert identify(spark.createDataFrame([], SCHEMA), fit(["ka", "sch"], ["xx", "yy"])).collect() == []
