"""The seed graph of nine people triples, and graphs that trap wrong joins."""

import pytest
from palimpsest.functions import terms as T
from palimpsest.functions.terms import I, L
from palimpsest.operators import aggregates as A
from palimpsest.operators import paths as P
from palimpsest.plans.graph import DEFAULT, Graph, Var, is_cyclic, values
from pyspark.sql import functions as F

EX = "http://example.org/"
TYPE = I(T.RDF + "type")


def ex(x):
    return I(EX + x)


def table(spark, rows):
    """Quads of constants (s, p, o[, g])."""
    cells = [F.struct(*[x.column().alias(c) for x, c in zip([*r, DEFAULT][:4], "spog")]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("q")).select("q.*")


@pytest.fixture(scope="module")
def people(spark):
    a, b, c = ex("alice"), ex("bob"), ex("carol")
    rows = [(x, TYPE, ex("Person")) for x in (a, b, c)] + [(a, ex("name"), L("Alice")), (b, ex("name"), L("Bob")), (a, ex("knows"), b), (b, ex("knows"), c), (a, ex("age"), L(30)), (b, ex("age"), L(25))]
    return Graph(table(spark, rows))


def got(solutions, *names):
    df = solutions.df if hasattr(solutions, "df") else solutions
    return sorted(tuple(None if r[n] is None else r[n].lex.removeprefix(EX) for n in names or df.columns) for r in df.collect())


s, o, n, x, y = Var("s"), Var("o"), Var("n"), Var("x"), Var("y")


def test_patterns(people):
    assert got(people.bgp((s, TYPE, ex("Person")), (s, ex("name"), n)), "s", "n") == [("alice", "Alice"), ("bob", "Bob")]
    assert got(people.bgp((ex("alice"), TYPE, ex("Person")), (x, ex("age"), y)), "x", "y") == [("alice", "30"), ("bob", "25")]
    assert got(people.bgp((ex("alice"), TYPE, ex("Dog")), (x, ex("age"), y))) == []
    assert got(people.bgp((x, ex("knows"), x))) == []
    assert people.bgp((ex("alice"), TYPE, ex("Person"))).ask().first().ask and not people.bgp((ex("alice"), TYPE, ex("Dog"))).ask().first().ask


def test_optional_minus_exists_union(people):
    person = people.bgp((s, TYPE, ex("Person")))
    named, aged, knows = people.bgp((s, ex("name"), n)), people.bgp((s, ex("age"), o)), people.bgp((s, ex("knows"), x))
    both = person.optional(named)
    assert both.maybe == {"n"} and got(both, "s", "n") == sorted([("alice", "Alice"), ("bob", "Bob"), ("carol", None)], key=str)
    assert got(person.optional(aged, T.gt(F.col("o"), L(26))), "s", "o") == [("alice", "30"), ("bob", None), ("carol", None)]
    assert got(person.minus(named), "s") == [("carol",)]
    assert got(person.minus(people.bgp((x, ex("name"), n))), "s") == [("alice",), ("bob",), ("carol",)]
    assert got(person.exists(knows), "s") == [("alice",), ("bob",)] and got(person.exists(knows, negated=True), "s") == [("carol",)]
    assert len(got(named.rename(o="n").union(aged), "s", "o")) == 4
    # an unbound variable joins with anything
    again = both.join(people.bgp((y, ex("name"), n)))
    assert got(again.project("s", "n"), "s", "n") == [("alice", "Alice"), ("bob", "Bob"), ("carol", "Alice"), ("carol", "Bob")]


def test_values_bind_filter_order(people, spark):
    v = values(spark, ["s", "o"], [[ex("alice"), None], [None, L(25)]])
    assert got(people.bgp((s, ex("age"), o)).join(v), "s", "o") == [("alice", "30"), ("bob", "25")]
    ages = people.bgp((s, ex("age"), o)).bind("d", T.multiply(F.col("o"), L(2)))
    assert got(ages.filter(T.lt(F.col("d"), L(55))), "d") == [("50",)]
    assert [r.o.lex for r in ages.order_by(("o", "desc")).df.collect()] == ["30", "25"]
    assert [r.o.lex for r in ages.order_by("o").slice(1, 1).df.collect()] == ["30"]
    mixed = values(spark, ["v"], [[L(10)], [L(9)], [L("a")], [ex("z")], [None], [L(9.5)]])
    assert [r.v and r.v.lex.removeprefix(EX) for r in mixed.order_by("v").df.collect()] == [None, "z", "9", "9.5", "10", "a"]


def test_aggregates(people, spark):
    ages = people.bgp((s, ex("age"), o))
    r = ages.group(n=A.count(), total=A.sum_("o"), mean=A.avg("o"), low=A.min_("o"), high=A.max_("o"), all=A.group_concat("o", ","), d=A.count("o", distinct=True)).df.first()
    assert [r[k].lex for k in ("n", "total", "mean", "low", "high", "all", "d")] == ["2", "55", "27.5", "25", "30", "25,30", "2"]
    assert r["total"].dt == T.INTEGER and r["mean"].dt == T.DECIMAL
    none = people.bgp((s, ex("nothing"), o)).group(n=A.count(), total=A.sum_("o"), mean=A.avg("o"), low=A.min_("o")).df.first()
    assert (none.n.lex, none.total.lex, none["mean"].lex, none.low) == ("0", "0", "0", None)
    bad = values(spark, ["k", "v"], [[L("a"), L(1)], [L("a"), L("x")], [L("b"), L(1)], [L("b"), L(1.5)]]).group("k", t=A.sum_("v"))
    assert got(bad, "k", "t") == [("a", None), ("b", "2.5")]


def test_construct_and_describe(people, spark):
    made = people.bgp((s, ex("knows"), o)).construct((o, ex("knownBy"), s), (T.Const(T.BNODE, "n"), ex("of"), s)).collect()
    assert len(made) == 4 and len({r.s.lex for r in made if r.s.kind == T.BNODE}) == 2
    assert people.describe(values(spark, ["s"], [[ex("alice")]]), "s").count() == 4


def test_named_graphs(spark):
    crm, li = I("g:crm"), I("g:linkedin")
    q = table(spark, [(ex("alice"), ex("worksAt"), ex("acme"), crm), (ex("alice"), ex("worksAt"), ex("acme-co"), li), (ex("bob"), ex("worksAt"), ex("beta"), li), (ex("alice"), ex("knows"), ex("bob"), DEFAULT), (ex("bob"), ex("worksAt"), ex("beta"), crm)])
    g = Var("g")
    assert Graph(q).bgp((s, x, o)).df.count() == 4
    assert got(Graph(q).bgp((s, ex("worksAt"), o), graph=crm), "s", "o") == [("alice", "acme"), ("bob", "beta")]
    assert Graph(q).bgp((s, ex("worksAt"), o), graph=g).df.count() == 4
    assert Graph(q, named=[li]).bgp((s, ex("worksAt"), o), graph=g).df.count() == 2
    assert Graph(q, default=[crm, li]).bgp((s, x, o)).df.count() == 3
    assert sorted(r.g for r in Graph(q).contexts().collect()) == ["g:crm", "g:linkedin"]
    assert Graph(q).size().first()[0] == 5


def test_paths_keep_graphs_apart(spark):
    """(a p1 b) in g1 and (a p2 c) in g2."""
    a, b, c, p1, p2 = (ex(k) for k in ("a", "b", "c", "p1", "p2"))
    g, t = Var("g"), Var("t")
    graph = Graph(table(spark, [(a, p1, b, I("g:1")), (a, p2, c, I("g:2"))]))
    star = P.match(graph, x, P.Star(P.Link(p1)), y, graph=g)
    assert got(star, "g", "x", "y") == [("g:1", "a", "a"), ("g:1", "a", "b"), ("g:1", "b", "b"), ("g:2", "a", "a"), ("g:2", "c", "c")]
    assert got(P.match(graph, t, P.Star(P.Link(p1)), t, graph=g), "g", "t") == [("g:1", "a"), ("g:1", "b"), ("g:2", "a"), ("g:2", "c")]
    one = Graph(table(spark, [(a, p1, b)]))
    assert got(P.match(one, x, P.Star(P.Link(p1)), y).project("y"), "y") == [("a",), ("b",), ("b",)]
    missing = P.match(graph, ex("zz"), P.Star(P.Link(p1)), y, graph=g)
    assert got(missing, "y", "g") == [("zz", None)]


def test_path_forms(spark):
    a, b, c, d, p, q = (ex(k) for k in "abcdpq")
    graph = Graph(table(spark, [(a, p, b), (b, p, c), (c, p, a), (a, q, d), (c, q, d)]))
    m = lambda path, *ends: got(P.match(graph, *(ends or (x, y))[:1], path, *(ends or (x, y))[1:]))
    assert m(P.Link(p) / P.Link(q)) == [("b", "d"), ("c", "d")]
    assert m(~P.Link(q)) == [("d", "a"), ("d", "c")]
    assert len(m(P.Link(p) | P.Link(q))) == 5
    assert len(m(P.Plus(P.Link(p)))) == 9 and len(m(P.Star(P.Link(p)))) == 10
    assert m(P.Negated((p,))) == [("a", "d"), ("c", "d")] and m(P.Negated((), (p,))) == [("d", "a"), ("d", "c")]
    assert m(P.Optional_(P.Link(q)), a, y) == [("a",), ("d",)]


@pytest.mark.parametrize("seed", range(3))
def test_triangles_agree_with_joins(spark, seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.randrange(6), rng.randrange(6)) for _ in range(14)]
    df = spark.createDataFrame(edges, "x int, y int")
    have = set(edges)
    want = sorted((i, j, k) for i, j in have for k in range(6) if (j, k) in have and (k, i) in have)
    assert sorted(tuple(r) for r in P.triangles(df).collect()) == want


def test_cyclic_patterns():
    a, b, c, d = (Var(v) for v in "abcd")
    p = ex("p")
    assert is_cyclic([(a, p, b), (b, p, c), (c, p, a)]) and is_cyclic([(a, p, b), (b, p, c), (c, p, d), (d, p, a)])
    assert not is_cyclic([(a, p, b), (b, p, c)]) and not is_cyclic([(a, p, b), (a, p, c), (a, p, d)])
