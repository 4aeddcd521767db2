"""N-Triples and N-Quads as DataFrames, and query results as lines of the SPARQL result formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.graph import DEFAULT, Solutions

_TERM = r'(<<.*?>>|<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>|_:[^\s]+)?\s*\.\s*(?:#.*)?$"


def read_nquads(spark: SparkSession, path: str, *, scope: str = "", graph: T.Const | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads files; blank lines and comments are left out, any other line that is no statement raises.

    Blank nodes get ``scope`` before their label, so that loads don't share them.
    """
    return parse_lines(spark.read.text(path), scope=scope, graph=graph)


def parse_lines(lines: DataFrame, *, scope: str = "", graph: T.Const | None = None) -> DataFrame:
    """The same for lines in a column ``value``."""

    def part(n: int) -> T.Term:
        return T.parse_ntriples(F.regexp_extract("value", _LINE, n))

    def scoped(t: T.Term) -> Column:
        return T.make(t.kind, F.when(t.kind == T.BNODE, F.concat(F.lit(scope), t.lex)).otherwise(t.lex), t.dt, t.lang).column()

    plain = lines.select(F.col("value"), T.numeric_escapes(F.col("value")).alias("plain"))
    sound = F.when(F.col("plain").rlike(_LINE), F.col("plain")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("value"))))
    # a generator, so that no later filter goes below the test or repeats it
    checked = plain.select(F.explode(F.when(~F.col("value").rlike(r"^\s*(#.*)?$"), F.array(sound))).alias("value"))
    named = F.regexp_extract("value", _LINE, 4)
    default = (graph or DEFAULT).column()
    return checked.select(scoped(part(1)).alias("s"), part(2).alias("p"), scoped(part(3)).alias("o"), F.when(named != "", scoped(part(4))).otherwise(default).alias("g"))


def to_nquads(quads: DataFrame) -> DataFrame:
    """One line a quad in canonical form, in a column ``value`` that ``write.text`` takes."""
    graph = F.when(F.col("g")["lex"] == "", F.lit("")).otherwise(F.concat(T.ntriples(F.col("g")), F.lit(" ")))
    return quads.select(F.concat(T.ntriples(F.col("s")), F.lit(" "), T.ntriples(F.col("p")), F.lit(" "), T.ntriples(F.col("o")), F.lit(" "), graph, F.lit(".")).alias("value"))


def results_json(solutions: Solutions) -> DataFrame:
    """A SPARQL-JSON binding object a row."""

    def cell(v: str) -> Column:
        t = T.as_term(v)
        kind = F.when(t.kind == T.IRI, "uri").when(t.kind == T.BNODE, "bnode").when(t.kind == T.LITERAL, "literal").otherwise("triple")
        dt = F.when((t.dt != T.STRING) & t.lang.isNull(), t.dt)
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), t.lex.alias("value"), dt.alias("datatype"), t.lang.alias("xml:lang"))).alias(v)

    return solutions.df.select(F.to_json(F.struct(*[cell(v) for v in solutions.vars])).alias("value"))


def results_csv(solutions: Solutions) -> DataFrame:
    def cell(v: str) -> Column:
        t = T.as_term(v)
        raw = F.coalesce(F.when(t.kind == T.BNODE, F.concat(F.lit("_:"), t.lex)).otherwise(t.lex), F.lit(""))
        return F.when(raw.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(raw, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(raw)

    return solutions.df.select(F.concat_ws(",", *[cell(v) for v in solutions.vars]).alias("value"))


def results_tsv(solutions: Solutions) -> DataFrame:
    """Numbers of the XSD types that Turtle abbreviates are written bare."""

    def cell(v: str) -> Column:
        t = T.as_term(v)
        bare = t.dt.isin(T.INTEGER, T.DECIMAL) | ((t.dt == T.DOUBLE) & t.lex.rlike("[eE]"))
        return F.coalesce(F.when(bare, t.lex).otherwise(T.ntriples(t)), F.lit(""))

    return solutions.df.select(F.concat_ws("\t", *[cell(v) for v in solutions.vars]).alias("value"))


def results_xml(solutions: Solutions) -> DataFrame:
    """A ``<result>`` element a row."""

    def escape(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def cell(v: str) -> Column:
        t = T.as_term(v)
        lang = F.when(t.lang.isNotNull(), F.concat(F.lit(' xml:lang="'), t.lang, F.lit('"'))).otherwise(F.when(t.dt != T.STRING, F.concat(F.lit(' datatype="'), t.dt, F.lit('"'))).otherwise(F.lit("")))
        body = F.when(t.kind == T.IRI, F.concat(F.lit("<uri>"), escape(t.lex), F.lit("</uri>"))).when(t.kind == T.BNODE, F.concat(F.lit("<bnode>"), t.lex, F.lit("</bnode>"))).otherwise(F.concat(F.lit("<literal"), lang, F.lit(">"), escape(t.lex), F.lit("</literal>")))
        return F.coalesce(F.concat(F.lit(f'<binding name="{v}">'), body, F.lit("</binding>")), F.lit(""))

    return solutions.df.select(F.concat(F.lit("<result>"), *[cell(v) for v in solutions.vars], F.lit("</result>")).alias("value"))
