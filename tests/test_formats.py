"""Turtle, numeric escapes, parts of quoted triples, presets, and a repository's smaller services."""

import pytest
from palimpsest.functions import terms as T
from palimpsest.functions.terms import BNODE, Const, I, L
from palimpsest.history.repository import Conflict, Repository, SyncLimits, TooLarge
from palimpsest.operators import canon, update
from palimpsest.plans.graph import DEFAULT, Graph, Var
from palimpsest.sources import rdf, turtle
from pyspark.sql import functions as F

from .test_graph import ex, table


def triples(df):
    return sorted((r.s.lex, r.p.lex, r.o.lex, r.o.dt, r.o.lang, r.g.lex) for r in df.collect())


def parsed(spark, *texts):
    return turtle.parse_documents(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, value string"))


def test_turtle_terms(spark):
    text = r"""
    @prefix : <http://a/b#> . @base <http://a/dir/x> . # a comment
    PREFIX e.x: <urn:ex:>
    <y> a :Thing ; :says "one\n\"q\"", 'it''s'@EN-gb, "éé\U0001F600"^^e.x:t ; ; :n 1, -2.5, 1e3 , true.
    e.x:a.b :long ""+"";
    """.replace("""'it''s'""", """'it\\'s'""").replace('""+""', '"""two\nlines "here" """').replace("lines", "lines", 1)
    got = triples(parsed(spark, text.rstrip().rstrip(";") + " ."))
    s, p = "http://a/dir/y", "http://a/b#"
    assert got == sorted(
        [
            (s, T.RDF + "type", p + "Thing", None, None, ""),
            (s, p + "says", 'one\n"q"', T.STRING, None, ""),
            (s, p + "says", "it's", T.LANG, "en-gb", ""),
            (s, p + "says", "éé😀", "urn:ex:t", None, ""),
            (s, p + "n", "1", T.INTEGER, None, ""),
            (s, p + "n", "-2.5", T.DECIMAL, None, ""),
            (s, p + "n", "1e3", T.DOUBLE, None, ""),
            (s, p + "n", "true", T.BOOLEAN, None, ""),
            ("urn:ex:a.b", p + "long", 'two\nlines "here" ', T.STRING, None, ""),
        ]
    )


def test_turtle_nodes_lists_graphs(spark):
    q = parsed(spark, "<urn:l> <urn:p> (1 [ <urn:q> _:x ]) . [ <urn:alone> 2 ] . << <urn:a> <urn:b> 'c' >> <urn:r> _:x .", "<urn:g> { <urn:s> <urn:p> _:x } GRAPH <urn:h> { <urn:s> <urn:p> () . } { <urn:s> <urn:p> 3 . }")
    rows = q.collect()
    assert len(rows) == 11 and sum(r.p.lex == T.RDF + "first" for r in rows) == 2
    nodes = {r.o.lex for r in rows if r.p.lex in ("urn:q", "urn:r")}
    assert len(nodes) == 1 and not nodes & {r.o.lex for r in rows if r.g.lex == "urn:g"}, "labels are of one file"
    assert sorted(r.g.lex for r in rows if r.s.lex == "urn:s") == ["", "urn:g", "urn:h"]
    assert [r.s.lex for r in rows if r.p.lex == "urn:r"] == ['<< <urn:a> <urn:b> "c" >>']
    assert parsed(spark, "", "# nothing\n").count() == 0
    for wrong in ("<urn:a> <urn:b> .", "<urn:a> <urn:b> <urn:c>", "x:y <urn:b> <urn:c> .", "§"):
        with pytest.raises(Exception):  # noqa: B017
            parsed(spark, wrong).collect()


def test_turtle_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("_:x <urn:p> 'one' .")
    (tmp_path / "b.ttl").write_text("_:x <urn:p> 'two' .")
    got = turtle.read_turtle(spark, str(tmp_path), graph=I("urn:g")).collect()
    assert len({r.s.lex for r in got}) == 2 and {r.g.lex for r in got} == {"urn:g"}


def test_numeric_escapes(spark):
    lines = [r'<urn:é> <urn:p> "A\\u0042 \U0001F600😀 \b\f\'" .', r'_:u <urn:p> "plain" .', r'_:v <urn:p> "\\n" .']
    got = rdf.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.s.lex, r.o.lex) for r in got.collect()] == [("urn:é", "A\\u0042 😀😀 \b\f'"), ("u", "plain"), ("v", "\\n")]


def test_parts_of_quoted_triples(spark):
    one = T.quoted(I("urn:a"), I("urn:p"), L('x" >> <urn:q> "y'))
    two = T.quoted(one, I("urn:q"), T.quoted(Const(BNODE, "b"), I("urn:p"), L("z", lang="en")))
    df = spark.range(1).select(two.column().alias("t"), L("<< no >>").column().alias("l"))
    t = T.Ref("t")
    row = df.select(*[T.ntriples(x) for x in (T.object_(T.subject(t)), T.predicate(t), T.subject(T.object_(t)), T.object_(T.object_(t)))], T.subject(T.Ref("l")).lex, T.subject(T.predicate(t)).lex).first()
    assert list(row) == ['"x\\" >> <urn:q> \\"y"', "<urn:q>", "_:b", '"z"@en', None, None]


def test_quoted_triples_and_presets(spark):
    said = T.quoted(ex("a"), ex("p"), L(1))
    q = table(spark, [(ex("x"), ex("p"), L(1)), (ex("y"), ex("p"), L(1)), (ex("y"), ex("p"), ex("x"))])
    more = q.limit(1).select(ex("z").column().alias("s"), ex("says").column().alias("p"), said.column().alias("o"), DEFAULT.column().alias("g"))
    g = Graph(q.unionByName(more).unionByName(more))
    assert g.quoted_triples(s=ex("a")).count() == 1 and g.quoted_triples(o=L(2)).count() == 0 and g.quoted_triples().count() == 1
    s, o, z = Var("s"), Var("o"), Var("z")
    got = g.bgp((s, ex("p"), o), given={"s": ex("y"), "z": ex("x")})
    assert sorted(r.o.lex for r in got.df.collect()) == sorted(["1", ex("x").value]) and sorted(got.vars) == ["o", "s"]
    assert g.bgp((s, ex("p"), o), (s, ex("p"), z), given={"z": L(3)}).df.count() == 0


def test_repository_services(spark, tmp_path):
    repo, seen = Repository(spark, str(tmp_path / "r")), []
    repo.listeners.append(lambda commit, delta: seen.append((commit.message, delta.count())))
    row = lambda i: table(spark, [(ex(f"s{i}"), ex("p"), L(i))])
    for i in (1, 2):
        repo.update("main", lambda q, i=i: update.insert_data(q, row(i)), message=f"m{i}")
    repo.update("main", lambda q: update.delete_data(q, row(1)), message="m3")
    assert seen == [("m1", 1), ("m2", 1), ("m3", 1)]
    first, second, _ = repo.chain("main")
    assert [r.commit for r in repo.lookup("main", ex("s2"), ex("p"), L(2)).collect()] == [second]
    assert repo.lookup("main", ex("s1"), ex("p"), L(1)).count() == 0 and [r.commit for r in repo.lookup(second, ex("s1"), ex("p"), L(1)).collect()] == [first]
    repo.add_remote("up/stream", str(tmp_path / "o"))
    with pytest.raises(Conflict):
        repo.add_remote("up/stream", "x")
    other = repo.remote("up/stream")
    for limits in (SyncLimits(commits=2), SyncLimits(bytes=10)):
        with pytest.raises(TooLarge):
            repo.push(other, "main", limits=limits)
        assert other.ref("main") is None and not other.files.names("commits")
    repo.push(other, "main", limits=SyncLimits(commits=3, bytes=10**9))
    assert other.head("main").count() == 1
    assert repo.set_prefixes("main", {"a": "urn:a"}) and repo.set_prefixes("main", {"a": "urn:a"}) is None and repo.prefixes("main") == {"a": "urn:a"}


def test_canonical_refinement(spark):
    """A long path is settled by rounds of joins; a small ring by search; copies of either are numbered from 0; a large one with ties fails before a search."""
    node = lambda *n: Const(BNODE, "_".join(map(str, n)))
    path = lambda name, n: [(node(name, i), ex("p"), node(name, i + 1)) for i in range(n)]
    ring = lambda name, n: [(node(name, i), ex("p"), node(name, (i + 1) % n)) for i in range(n)]
    q = table(spark, path("a", 9) + path("b", 9) + ring("c", 3) + ring("d", 3))
    rows = canon._mentions(q).join(canon.components(q), "b")
    settled = {r.component: r.settled for r in canon.refined(rows).select("component", "settled").distinct().collect()}
    assert settled == {"a_0": True, "b_0": True, "c_0": False, "d_0": False}
    labels = {r.b: r.label.split("_") for r in canon.labels(q).collect()}
    assert len({tuple(v) for v in labels.values()}) == 26
    assert sorted({labels[f"{x}_0"][2] for x in "ab"}) == ["0", "1"] == sorted({labels[f"{x}_0"][2] for x in "cd"})
    assert labels["a_4"][1] == labels["b_4"][1] and labels["a_4"][3] == labels["b_4"][3]
    most, canon.MOST_MENTIONS = canon.MOST_MENTIONS, 5
    try:
        with pytest.raises(canon.BudgetExceeded, match="ties"):
            canon.labels(q)
    finally:
        canon.MOST_MENTIONS = most
    assert canon.labels(q.where(F.lit(False))).count() == 0
