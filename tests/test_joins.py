"""Joins on variables that may be unbound, distinct aggregates, keys of several columns and bound path ends, against brute force."""

import itertools
import random

import pytest
from palimpsest.functions import terms as T
from palimpsest.functions.terms import I, L
from palimpsest.operators import aggregates as A
from palimpsest.operators import paths as P
from palimpsest.plans.graph import Graph, Var, values
from palimpsest.sources.lift import edges, lift_table
from pyspark.sql import functions as F

x, y = Var("x"), Var("y")


def table(spark, names, rows):
    m = values(spark, names, [[None if v is None else L(v) for v in r] for r in rows])
    m.maybe = frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows))
    return m


def plain(m):
    return sorted((tuple(None if r[v] is None else int(r[v].lex) for v in sorted(m.vars)) for r in m.df.collect()), key=str)


def compatible(a, b):
    return all(a[k] is None or b[k] is None or a[k] == b[k] for k in a.keys() & b.keys())


def merged(a, b):
    return {k: a.get(k) if a.get(k) is not None else b.get(k) for k in a.keys() | b.keys()}


@pytest.mark.parametrize("seed", range(3))
def test_unbound_variables_join_with_anything(spark, seed):
    rng = random.Random(seed)
    one = [[rng.choice([None, 1, 2, 3]) for _ in "ab"] + [i] for i in range(12)]
    two = [[rng.choice([None, 1, 2, 3]) for _ in "ab"] + [i] for i in range(9)]
    left, right = table(spark, ["a", "b", "l"], one), table(spark, ["a", "b", "r"], two)
    ls, rs = [dict(zip("abl", r)) for r in one], [dict(zip("abr", r)) for r in two]
    rows = lambda found: sorted((tuple(r[k] for k in sorted(r)) for r in found), key=str)
    both = [merged(a, b) for a, b in itertools.product(ls, rs) if compatible(a, b)]
    alone = [a for a in ls if not any(compatible(a, b) for b in rs)]
    assert plain(left.join(right)) == rows(both)
    assert plain(left.optional(right)) == rows(both + [a | {"r": None} for a in alone])
    assert plain(left.exists(right, negated=True)) == rows(alone)
    assert plain(left.exists(right)) == rows([a for a in ls if a not in alone])
    shares = lambda a, b: any(a[k] is not None and b[k] is not None for k in "ab")
    assert plain(left.minus(right)) == rows([a for a in ls if not any(compatible(a, b) and shares(a, b) for b in rs)])
    plan = left.project("a", "l").join(right.project("b", "r").rename(a="b")).df._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_distinct_sums_are_of_terms(spark):
    m = values(spark, ["k", "v"], [[L("g"), L(1)], [L("g"), L("01", T.INTEGER)], [L("g"), L(3)], [L("g"), L(3)], [L("h"), L(5)], [None, L(7)], [None, L(7)]])
    got = {None if r.k is None else r.k.lex: (r.s.lex, float(r.a.lex), r.n.lex) for r in m.group("k", s=A.sum_("v", distinct=True), a=A.avg("v", distinct=True), n=A.count()).df.collect()}
    assert {k: (v[0], round(v[1], 4), v[2]) for k, v in got.items()} == {"g": ("5", 1.6667, "4"), "h": ("5", 5.0, "1"), None: ("7", 7.0, "2")}
    whole = m.group(s=A.sum_("v", distinct=True)).df.first()
    assert whole.s.lex == "17"  # 1, 01, 3, 5, 7


def test_sums_of_too_many_digits_are_errors(spark):
    m = values(spark, ["v"], [[L("9" * 27, T.INTEGER)]] * 30)
    assert m.group(s=A.sum_("v"), n=A.count()).df.first().n.lex == "30"


def test_keys_of_several_columns_do_not_run_together(spark):
    d = spark.createDataFrame([("1", "23", 1), ("12", "3", 2), ("1/2", "3", 3), ("1", "2/3", 4), ("1%2F2", "3", 5)], "a string, b string, c int")
    assert lift_table(d, "t", columns=["c"], keys=["a", "b"]).select(F.col("s.lex")).distinct().count() == 5


@pytest.mark.parametrize("seed", range(2))
def test_paths_from_a_bound_end(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)]
    q = Graph(edges(spark.createDataFrame(links, "x long, y long")), merge=False)
    reach = set(links)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    number = lambda t: int(t.lex.rsplit("/", 1)[-1])
    at = links[0][0]
    here = I(f"urn:t:v/{at}")
    step = P.Link(I("urn:e"))
    assert {number(r.y) for r in P.match(q, here, P.Plus(step), y).df.collect()} == {b for a, b in reach if a == at}
    assert {number(r.y) for r in P.match(q, here, P.Star(step), y).df.collect()} == {b for a, b in reach if a == at} | {at}
    assert {number(r.x) for r in P.match(q, x, P.Plus(step), here).df.collect()} == {a for a, b in reach if b == at}
    assert P.match(q, here, P.Plus(step), here).df.count() == ((at, at) in reach)
    both = {(number(r.x), number(r.y)) for r in P.match(q, x, P.Plus(step), y).df.collect()}
    assert both == reach
