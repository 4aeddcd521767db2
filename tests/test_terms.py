"""Functions on terms, one row each: expression, expected lexical form (or boolean, or None for an error)."""

import pytest
from palimpsest.functions import terms as T
from palimpsest.functions.terms import I, L
from pyspark.sql import functions as F

D = "2011-01-10T14:45:13.815-05:00"
CASES = [
    (lambda: T.add(L(1), L(2)), "3", T.INTEGER),
    (lambda: T.add(L(1), L("2.50", T.DECIMAL)), "3.5", T.DECIMAL),
    (lambda: T.add(L("1", T.XSD + "byte"), L("2", T.XSD + "int")), "3", T.INTEGER),
    (lambda: T.multiply(L(2), L(1.5)), "3.0", T.DOUBLE),
    (lambda: T.divide(L(7), L(2)), "3.5", T.DECIMAL),
    (lambda: T.divide(L(7), L(0)), None, None),
    (lambda: T.divide(L(7.0), L(0)), "INF", T.DOUBLE),
    (lambda: T.subtract(L(1), L("x")), None, None),
    (lambda: T.round_(L("-2.5", T.DECIMAL)), "-2", T.DECIMAL),
    (lambda: T.round_(L("2.5", T.DECIMAL)), "3", T.DECIMAL),
    (lambda: T.ceil(L(1.2)), "2.0", T.DOUBLE),
    (lambda: T.floor(L("-1.2", T.DECIMAL)), "-2", T.DECIMAL),
    (lambda: T.abs_(L(-3)), "3", T.INTEGER),
    (lambda: T.eq(L("1", T.INTEGER), L("01", T.INTEGER)), True, None),
    (lambda: T.same_term(L("1", T.INTEGER), L("01", T.INTEGER)), False, None),
    (lambda: T.eq(L("a", "urn:d"), L("b", "urn:d")), None, None),
    (lambda: T.eq(L("a", "urn:d"), L("a", "urn:d")), True, None),
    (lambda: T.eq(L("x"), L("x", lang="en")), False, None),
    (lambda: T.eq(I("urn:a"), L("a")), False, None),
    (lambda: T.eq(L(1), L("a")), None, None),
    (lambda: T.eq(L("2020-01-01T00:00:00Z", T.DATETIME), L("2020-01-01T01:00:00+01:00", T.DATETIME)), True, None),
    (lambda: T.lt(L(9), L(10)), True, None),
    (lambda: T.lt(L("9"), L("10")), False, None),
    (lambda: T.lt(L(1), L("a")), None, None),
    (lambda: T.le(L(1), L("1.0", T.DECIMAL)), True, None),
    (lambda: T.lt(L(False), L(True)), True, None),
    (lambda: T.eq(L("NaN", T.DOUBLE), L("NaN", T.DOUBLE)), False, None),
    (lambda: T.is_in(L(2), L("a"), L(2)), True, None),
    (lambda: T.is_in(L(2), L("a"), L(3)), None, None),
    (lambda: T.ebv(L("")), False, None),
    (lambda: T.ebv(L("abc", T.INTEGER)), False, None),
    (lambda: T.ebv(L("x", "urn:d")), None, None),
    (lambda: T.is_numeric(L("abc", T.INTEGER)), False, None),
    (lambda: T.is_numeric(L("7", T.XSD + "positiveInteger")), True, None),
    (lambda: T.strlen(L("naïve")), "5", T.INTEGER),
    (lambda: T.substr(L("foobar", lang="en"), 4, 2), "ba", T.LANG),
    (lambda: T.ucase(L("é")), "É", T.STRING),
    (lambda: T.strbefore(L("abc", lang="en"), L("b")), "a", T.LANG),
    (lambda: T.strbefore(L("abc"), L("z")), "", T.STRING),
    (lambda: T.strafter(L("abc", lang="en"), L("b", lang="fr")), None, None),
    (lambda: T.concat(L("a", lang="en"), L("b", lang="en")), "ab", T.LANG),
    (lambda: T.concat(L("a", lang="en"), L("b")), "ab", T.STRING),
    (lambda: T.contains(L("abc"), L("b")), True, None),
    (lambda: T.encode_for_uri(L("a b/é~*+")), "a%20b%2F%C3%A9~%2A%2B", T.STRING),
    (lambda: T.regex(L("Hello"), "^h", "i"), True, None),
    (lambda: T.regex(L("a.c"), "a.c", "q"), True, None),
    (lambda: T.replace(L("abab"), "b(.)", "[$1]"), "a[a]b", T.STRING),
    (lambda: T.lang_matches(T.lang(L("x", lang="en-GB")), "EN"), True, None),
    (lambda: T.lang_matches(T.lang(L("x")), "*"), False, None),
    (lambda: T.datatype(L("x", lang="en")), T.LANG, None),
    (lambda: T.year(L(D, T.DATETIME)), "2011", T.INTEGER),
    (lambda: T.seconds(L(D, T.DATETIME)), "13.815", T.DECIMAL),
    (lambda: T.timezone(L(D, T.DATETIME)), "-PT5H", None),
    (lambda: T.timezone(L("2011-01-10T14:45:13Z", T.DATETIME)), "PT0S", None),
    (lambda: T.timezone(L("2011-01-10T14:45:13", T.DATETIME)), None, None),
    (lambda: T.tz_term(L("2011-01-10T14:45:13", T.DATETIME)), "", T.STRING),
    (lambda: T.sha1(L("abc")), "a9993e364706816aba3e25717850c26c9cd0d89d", T.STRING),
    (lambda: T.sha2(L("abc"), 384), "cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7", T.STRING),
    (lambda: T.cast(L("1e3"), T.DOUBLE), "1000.0", T.DOUBLE),
    (lambda: T.cast(L("-7.9", T.DECIMAL), T.INTEGER), "-7", T.INTEGER),
    (lambda: T.cast(L("7.9"), T.INTEGER), None, None),
    (lambda: T.cast(L(True), T.INTEGER), "1", T.INTEGER),
    (lambda: T.cast(L("0"), T.BOOLEAN), "false", T.BOOLEAN),
    (lambda: T.cast(I("urn:a"), T.STRING), "urn:a", T.STRING),
    (lambda: T.if_(T.lt(L(1), L("a")), L(1), L(2)), None, None),
    (lambda: T.coalesce(T.divide(L(1), L(0)), L("z")), "z", T.STRING),
    (lambda: T.strdt(L("1"), I(T.INTEGER)), "1", T.INTEGER),
    (lambda: T.strlang(L("x"), L("EN")), "x", T.LANG),
]


def test_functions(spark):
    cells = []
    for i, (f, _, _) in enumerate(CASES):
        t = f()
        parts = (t.lex, t.dt) if isinstance(t, T.Term) else (t.cast("string"), F.lit(None).cast("string"))
        cells += [parts[0].alias(f"v{i}"), parts[1].alias(f"d{i}")]
    wrong = []
    for a in range(0, len(CASES), 12):
        row = spark.range(1).select(*cells[2 * a : 2 * a + 24]).first()
        for i in range(a, min(a + 12, len(CASES))):
            want, dt = CASES[i][1:]
            want = str(want).lower() if isinstance(want, bool) else want
            if row[f"v{i}"] != want or (dt and row[f"d{i}"] != dt):
                wrong.append((i, row[f"v{i}"], row[f"d{i}"], want, dt))
    assert not wrong


FORMS = [L("plain"), L("tab\t\"quote\" back\\slash\nline\r"), L("x", lang="EN-gb"), L(5), L("01", T.INTEGER), L("1.0E0", T.DOUBLE), L("INF", T.DOUBLE), L("abc", T.INTEGER), L("z", "urn:own"), I("http://e/x#y"), T.Const(T.BNODE, "b0"), L("\\n literally"), L("")]


def test_ntriples_round_trip(spark):
    cells = F.array(*[t.column() for t in FORMS])
    got = spark.range(1).select(F.explode(cells).alias("t")).select("t", T.parse_ntriples(T.ntriples(F.col("t"))).alias("u")).collect()
    assert len({r.t.id for r in got}) == len(FORMS) and all(r.t == r.u for r in got)


@pytest.mark.parametrize("bad", ["<a> <b>", "just words ."])
def test_bad_lines_raise(spark, tmp_path, bad):
    from palimpsest.sources.rdf import read_nquads

    (tmp_path / "x.nt").write_text(f"# comment\n\n<urn:a> <urn:p> \"v\"@en .\n_:b <urn:p> <urn:c> <urn:g> .\n{bad}\n")
    with pytest.raises(Exception, match="not a statement"):
        read_nquads(spark, str(tmp_path / "x.nt")).collect()


def test_files_and_results(spark, tmp_path):
    from palimpsest.plans.graph import Graph, Var, values
    from palimpsest.sources import rdf

    (tmp_path / "x.nq").write_text('# c\n<urn:a> <urn:p> "v \\"q\\""@en .\n_:b <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> . # end\n')
    q = rdf.read_nquads(spark, str(tmp_path / "x.nq"), scope="f1-")
    assert sorted((r.s.lex, r.o.lex, r.g.lex) for r in q.collect()) == [("f1-b", "5", "urn:g"), ("urn:a", 'v "q"', "")]
    assert sorted(r.value for r in rdf.to_nquads(q).collect()) == ['<urn:a> <urn:p> "v \\"q\\""@en .', '_:f1-b <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .']
    m = values(spark, ["a", "b"], [[I("urn:x"), L('q"1')], [None, L(5)]])
    assert [r.value for r in rdf.results_csv(m).collect()] == ['urn:x,"q""1"', ",5"]
    assert [r.value for r in rdf.results_tsv(m).collect()] == ['<urn:x>\t"q\\"1"', "\t5"]
    assert "<uri>urn:x</uri>" in rdf.results_xml(m).collect()[0].value
    assert Graph(q).bgp((Var("s"), I("urn:p"), Var("o"))).df.count() == 2
