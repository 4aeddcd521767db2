"""RDF terms as Spark structs, and SPARQL's functions on them as column expressions.

A term is ``STRUCT<id, kind, lex, dt, lang>``: ``kind`` is 0 IRI, 1 blank node,
2 literal, 3 quoted triple; ``lex`` is verbatim; ``id`` is a 128-bit hash of the
rest (two 64-bit ones with different seeds), so term equality, joins, DISTINCT and GROUP BY need the id alone.  Value
comparison works on values derived at query time.  An unbound variable and an
expression error are both NULL, which SQL's three-valued logic treats as SPARQL
does.  Functions take columns, constants or ``Term`` objects and give ``Term``
objects (or boolean columns), whose parts are separate expressions, so that
nesting them doesn't build and take apart structs; ``column()`` builds one at the
end.  Nothing here leaves the JVM.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
IRI, BNODE, LITERAL, TRIPLE = 0, 1, 2, 3
STRING, BOOLEAN, INTEGER, DECIMAL = XSD + "string", XSD + "boolean", XSD + "integer", XSD + "decimal"
FLOAT, DOUBLE, DATETIME, DATE = XSD + "float", XSD + "double", XSD + "dateTime", XSD + "date"
LANG = RDF + "langString"
TERM = "struct<id:struct<a:bigint,b:bigint>,kind:tinyint,lex:string,dt:string,lang:string>"
#: Datatypes that count as integers.
INTEGERS = [XSD + x for x in ("integer", "byte", "short", "int", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger")]


class Term:
    """A term's parts as columns; ``number`` and ``rank`` are kept where a function already has them."""

    def __init__(self, kind: Column, lex: Column, dt: Column, lang: Column, id_: Column | None = None, exact: Column | None = None, wide: Column | None = None, rank_: Column | None = None):
        self.kind, self.lex, self.dt, self.lang = kind, lex, dt, lang
        self._id, self.exact, self.wide, self.rank = id_, exact, wide, rank_
        self.whole: Column | None = None  # the struct, where there is one

    @property
    def id(self) -> Column:
        if self._id is None:
            return F.when(self.lex.isNotNull(), self._hash())
        return self._id

    def _hash(self) -> Column:
        parts = [self.kind, self.lex, F.coalesce(self.dt, F.lit("")), F.coalesce(self.lang, F.lit(""))]
        return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))

    def struct(self) -> Column:
        """The struct of a term that is always there; single fields then need no struct at all."""
        id_ = self._id if self._id is not None else self._hash()
        return F.struct(id_.alias("id"), self.kind.alias("kind"), self.lex.alias("lex"), self.dt.alias("dt"), self.lang.alias("lang"))

    def column(self) -> Column:
        """The struct; NULL where the lexical form is."""
        return self.whole if self.whole is not None else F.when(self.lex.isNotNull(), self.struct())

    def alias(self, name: str) -> Column:
        return self.column().alias(name)

    def isNotNull(self) -> Column:  # noqa: N802
        return self.lex.isNotNull()

    def isNull(self) -> Column:  # noqa: N802
        return self.lex.isNull()


@dataclass(frozen=True)
class Const:
    """A constant term of a pattern or expression."""

    kind: int
    value: str
    datatype: str | None = None
    tag: str | None = None

    def term(self) -> Term:
        return make(self.kind, F.lit(self.value), self.datatype, None if self.tag is None else F.lit(self.tag.lower()))

    def column(self) -> Column:
        return self.term().struct()


@dataclass(frozen=True)
class Ref:
    """A term column by name, for use before there is a session."""

    name: str


def numbered(name: str) -> Term:
    """A variable whose numeric parts ``Solutions.numbers`` has made columns of."""
    t = as_term(name)
    return Term(t.kind, t.lex, t.dt, t.lang, t.id, F.col(f"{name}__exact"), F.col(f"{name}__wide"), F.col(f"{name}__rank"))


def as_term(x) -> Term:
    if isinstance(x, Term):
        return x
    if isinstance(x, Ref):
        x = x.name
    if isinstance(x, Const):
        return constant_number(x) if x.kind == LITERAL and x.datatype in (*INTEGERS, DECIMAL, DOUBLE) and re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", x.value) else x.term()
    x = F.col(x) if isinstance(x, str) else x
    t = Term(x["kind"], x["lex"], x["dt"], x["lang"], x["id"])
    t.whole = x
    return t


def on_terms(f):
    """Columns, names and constants become terms; other arguments stay."""

    @functools.wraps(f)
    def run(*args, **options):
        return f(*[as_term(a) if isinstance(a, (Column, Const, Ref, Term)) else a for a in args], **options)

    return run


def make(kind, lex: Column, dt: Column | str | None = None, lang: Column | None = None) -> Term:
    kind = F.lit(kind).cast("tinyint") if isinstance(kind, int) else kind
    dt = F.lit(dt) if isinstance(dt, str) or dt is None else dt
    return Term(kind, lex, dt.cast("string"), (F.lit(None) if lang is None else lang).cast("string"))


def iri(c: Column) -> Term:
    return make(IRI, c.cast("string"))


def bnode(c: Column) -> Term:
    return make(BNODE, c.cast("string"))


def literal(c: Column, dt: Column | str = STRING) -> Term:
    return make(LITERAL, c.cast("string"), dt)


def lang_literal(c: Column, lang: Column) -> Term:
    return make(LITERAL, c, LANG, F.lower(lang))


@on_terms
def quoted(s, p, o) -> Term:
    """A quoted triple (RDF-star); its lexical form is the triple's N-Triples form."""
    return make(TRIPLE, F.concat(F.lit("<< "), ntriples(s), F.lit(" "), ntriples(p), F.lit(" "), ntriples(o), F.lit(" >>")))


def I(value: str) -> Const:  # noqa: E743
    return Const(IRI, value)


def L(value, dt: str | None = None, lang: str | None = None) -> Const:
    """A literal; Python booleans, integers, floats and strings have their XSD types."""
    if lang is not None:
        return Const(LITERAL, str(value), LANG, lang)
    if dt is None:
        dt = BOOLEAN if isinstance(value, bool) else INTEGER if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING
    return Const(LITERAL, str(value).lower() if isinstance(value, bool) else str(value), dt)


def choose(condition: Column, a, b=None) -> Term:
    """``a`` where a boolean column is true, else ``b`` (NULL if there is none)."""
    a = as_term(a)
    if b is None:
        return Term(a.kind, F.when(condition, a.lex), a.dt, a.lang)
    b = as_term(b)
    return Term(*(F.when(condition, x).otherwise(y) for x, y in zip((a.kind, a.lex, a.dt, a.lang), (b.kind, b.lex, b.dt, b.lang))))


def if_(condition: Column, a, b) -> Term:
    """SPARQL ``IF``: an error if the condition is one."""
    either = choose(condition, a, b)
    return Term(either.kind, F.when(condition.isNotNull(), either.lex), either.dt, either.lang)


@on_terms
def coalesce(*terms) -> Term:
    out = terms[-1]
    for t in reversed(terms[:-1]):
        out = choose(t.lex.isNotNull(), t, out)
    return out


# tests -------------------------------------------------------------------------------------------------------------


@on_terms
def is_iri(t):
    return t.kind == IRI


@on_terms
def is_blank(t):
    return t.kind == BNODE


@on_terms
def is_literal(t):
    return t.kind == LITERAL


@on_terms
def is_triple(t):
    return t.kind == TRIPLE


@on_terms
def same_term(a, b):
    return a.id == b.id


@on_terms
def bound(t):
    return t.isNotNull()


# values ------------------------------------------------------------------------------------------------------------


@on_terms
def rank(t) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; NULL for other terms."""
    if t.rank is not None:
        return t.rank
    return F.when(t.dt.isin(INTEGERS), 1).when(t.dt == DECIMAL, 2).when(t.dt == FLOAT, 3).when(t.dt == DOUBLE, 4)


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@on_terms
def is_numeric(t):
    return F.coalesce(dbl(t).isNotNull(), F.lit(False))


@on_terms
def dbl(t) -> Column:
    """A numeric literal's value as a double; NULL if ill-typed."""
    if t.wide is not None:
        return t.wide
    special = F.when(t.lex == "INF", F.lit(float("inf"))).when(t.lex == "-INF", F.lit(float("-inf"))).when(t.lex == "NaN", F.lit(float("nan")))
    plain = F.when(t.lex.rlike(_NUMBER), t.lex.try_cast("double"))
    return F.when(rank(t) <= 2, F.when(~t.lex.rlike("[eE]"), plain)).when(rank(t) >= 3, F.coalesce(special, plain))


@on_terms
def dec(t) -> Column:
    """An integer's or decimal's exact value; NULL beyond 38 digits."""
    if t.rank is not None:
        return t.exact
    return F.when(rank(t) <= 2, F.when(t.lex.rlike(_NUMBER) & ~t.lex.rlike("[eE]"), t.lex.try_cast("decimal(38,10)")))


@on_terms
def boolean(t) -> Column:
    return F.when(t.dt == BOOLEAN, F.when(t.lex.isin("true", "1"), True).when(t.lex.isin("false", "0"), False))


_STAMP = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?$"


@on_terms
def _part(t, n: int) -> Column:
    x = F.regexp_extract(t.lex, _STAMP, n)
    return F.when(t.dt.isin(DATETIME, DATE) & (x != ""), x)


@on_terms
def tz(t) -> Column:
    """The time zone as written, empty if absent."""
    return F.when(t.dt.isin(DATETIME, DATE) & t.lex.rlike(_STAMP), F.regexp_extract(t.lex, _STAMP, 7))


@on_terms
def stamp(t) -> Column:
    """Microseconds on the time line of a dateTime or date; one without a zone counts as UTC."""
    local = F.concat_ws(" ", F.concat_ws("-", _part(t, 1), _part(t, 2), _part(t, 3)), F.coalesce(F.concat_ws(":", _part(t, 4), _part(t, 5), _part(t, 6)), F.lit("")))
    zone = F.regexp_extract(t.lex, _STAMP, 7)
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    return F.when(t.dt.isin(DATETIME, DATE), F.unix_micros(F.trim(local).try_cast("timestamp")) - shift.cast("long") * 60_000_000)


@on_terms
def _text(t) -> Column:
    return F.when(t.dt == STRING, t.lex)


@on_terms
def ebv(t) -> Column:
    """Effective boolean value."""
    number = dbl(t)
    return F.when(t.dt == BOOLEAN, F.coalesce(boolean(t), F.lit(False))).when(t.dt.isin(STRING, LANG), t.lex != "").when(rank(t).isNotNull(), F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))


@on_terms
def eq(a, b) -> Column:
    """SPARQL ``=``: value equality of known types, else term equality, or an error for unlike literals of unknown types."""
    numbers = rank(a).isNotNull() & rank(b).isNotNull()
    if a.rank is not None or b.rank is not None:  # a number: nothing but a number is equal to it
        return F.when(numbers, F.coalesce(dec(a) == dec(b), _equal_doubles(a, b))).when((a.kind != LITERAL) | (b.kind != LITERAL), False)
    exact = F.coalesce(dec(a) == dec(b), _equal_doubles(a, b))
    stamps = a.dt.isin(DATETIME, DATE) & (a.dt == b.dt)
    known = a.dt.isin(STRING, LANG) & b.dt.isin(STRING, LANG)
    return (
        F.when(numbers, exact)
        .when((a.dt == BOOLEAN) & (b.dt == BOOLEAN), boolean(a) == boolean(b))
        .when(stamps, stamp(a) == stamp(b))
        .when(a.id == b.id, True)
        .when((a.kind != LITERAL) | (b.kind != LITERAL) | known, False)
    )


@on_terms
def _equal_doubles(a, b):
    x, y = dbl(a), dbl(b)
    return (x == y) & ~F.isnan(x) & ~F.isnan(y)


def ne(a, b) -> Column:
    return ~eq(a, b)


@on_terms
def lt(a, b) -> Column:
    """SPARQL ``<``; incomparable literals are an error."""
    x, y = dbl(a), dbl(b)
    numeric = F.when(rank(a).isNotNull() & rank(b).isNotNull(), F.coalesce(dec(a) < dec(b), (x < y) & ~F.isnan(x) & ~F.isnan(y)))
    if a.rank is not None or b.rank is not None:
        return numeric
    return (
        numeric
        .when((a.dt == STRING) & (b.dt == STRING), a.lex < b.lex)
        .when((a.dt == BOOLEAN) & (b.dt == BOOLEAN), ~boolean(a) & boolean(b))
        .when(a.dt.isin(DATETIME, DATE) & (a.dt == b.dt), stamp(a) < stamp(b))
    )


def gt(a, b) -> Column:
    return lt(b, a)


def le(a, b) -> Column:
    return lt(a, b) | eq(a, b)


def ge(a, b) -> Column:
    return le(b, a)


def is_in(a, *others) -> Column:
    """An OR of ``=``, so that an error counts only where nothing is equal."""
    out = F.lit(False)
    for b in others:
        out = out | eq(a, b)
    return out


@on_terms
def order_keys(t, descending: bool = False) -> list[Column]:
    """Sort keys: unbound < blank node < IRI < literal; literals by value, then lexically."""
    level = F.when(t.lex.isNull(), 0).when(t.kind == BNODE, 1).when(t.kind == IRI, 2).otherwise(3)
    keys = [level, F.when(rank(t).isNotNull(), 0).when(t.dt.isin(DATETIME, DATE), 1).when(t.dt == BOOLEAN, 2).otherwise(3), dbl(t), stamp(t), t.lex, t.dt, t.lang]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


# construction of results -------------------------------------------------------------------------------------------


def constant_number(c: Const) -> Term:
    """A numeric constant with its value worked out here."""
    t = c.term()
    r = 1 if c.datatype in INTEGERS else {DECIMAL: 2, FLOAT: 3, DOUBLE: 4}[c.datatype]
    exact = F.lit(c.value).cast("decimal(38,10)") if r <= 2 else F.lit(None).cast("decimal(38,10)")
    return Term(t.kind, t.lex, t.dt, t.lang, None, exact, F.lit(float(c.value)), F.lit(r))


def number(exact: Column | None, wide: Column, r: Column) -> Term:
    """A numeric literal of rank r; integers and decimals in their shortest form."""
    if exact is None:
        exact = F.lit(None)
    fixed = exact.try_cast("decimal(38,10)")
    short = F.regexp_replace(F.regexp_replace(fixed.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    shown = F.when(F.isnan(wide), F.lit("NaN")).when(wide == float("inf"), F.lit("INF")).when(wide == float("-inf"), F.lit("-INF")).otherwise(wide.cast("string"))
    dt = F.when(r == 1, F.lit(INTEGER)).when(r == 2, F.lit(DECIMAL)).when(r == 3, F.lit(FLOAT)).when(r == 4, F.lit(DOUBLE))
    return Term(F.lit(LITERAL).cast("tinyint"), F.when(r <= 2, short).when(r > 2, shown), dt, F.lit(None).cast("string"), None, F.when(r <= 2, fixed), wide, r)


def true_or_false(c: Column) -> Term:
    return literal(F.when(c, F.lit("true")).when(~c, F.lit("false")), BOOLEAN)


def integer(c: Column) -> Term:
    return literal(c.cast("decimal(38,0)").cast("string"), INTEGER)


def _arithmetic(a, b, exact, wide, least: int = 1) -> Term:
    a, b = as_term(a), as_term(b)
    r = F.when(rank(a).isNotNull() & rank(b).isNotNull(), F.greatest(rank(a), rank(b), F.lit(least)))
    fixed = exact(dec(a), dec(b))
    return number(F.when(r <= 2, fixed), F.when(r <= 2, fixed.cast("double")).otherwise(wide(dbl(a), dbl(b))), r)


def add(a, b) -> Term:
    return _arithmetic(a, b, lambda x, y: F.try_add(x, y), lambda x, y: x + y)


@on_terms
def subtract(a, b) -> Term:
    return _arithmetic(a, b, lambda x, y: F.try_subtract(x, y), lambda x, y: x - y)


@on_terms
def multiply(a, b) -> Term:
    return _arithmetic(a, b, lambda x, y: F.try_multiply(x, y), lambda x, y: x * y)


@on_terms
def divide(a, b) -> Term:
    """integer / integer is a decimal; division of exact numbers by zero is an error."""
    inf = lambda x, y: F.when(y == 0, F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))).otherwise(F.try_divide(x, y))
    return _arithmetic(a, b, lambda x, y: F.try_divide(x, y), inf, 2)


def negate(a) -> Term:
    return subtract(L(0), a)


@on_terms
def _numeric(t, exact, wide):
    fixed = exact(dec(t)).cast("decimal(38,10)")
    return number(fixed, F.when(rank(t) <= 2, fixed.cast("double")).otherwise(wide(dbl(t))), rank(t))


@on_terms
def abs_(t) -> Term:
    return _numeric(t, F.abs, F.abs)


@on_terms
def ceil(t) -> Term:
    return _numeric(t, F.ceil, lambda x: F.ceil(x).cast("double"))


@on_terms
def floor(t) -> Term:
    return _numeric(t, F.floor, lambda x: F.floor(x).cast("double"))


@on_terms
def round_(t) -> Term:
    """Halves go up."""
    return _numeric(t, lambda x: F.floor(x + F.lit("0.5").cast("decimal(2,1)")), lambda x: F.floor(x + 0.5).cast("double"))


def rand():
    return literal(F.rand().cast("string"), DOUBLE)


# terms and strings -------------------------------------------------------------------------------------------------


@on_terms
def str_(t):
    return literal(F.when(t.kind.isin(IRI, LITERAL), t.lex))


@on_terms
def lang(t):
    return literal(F.when(t.kind == LITERAL, F.coalesce(t.lang, F.lit(""))))


@on_terms
def datatype(t):
    return iri(F.when(t.kind == LITERAL, t.dt))


@on_terms
def strdt(t, dt):
    return literal(_text(t), dt.lex)


@on_terms
def strlang(t, tag):
    return lang_literal(_text(t), tag.lex)


@on_terms
def to_iri(t):
    return iri(F.when((t.kind == IRI) | (t.dt == STRING), t.lex))


def fresh_bnode():
    return bnode(F.concat(F.lit("u"), F.regexp_replace(F.uuid(), "-", "")))


def uuid_iri():
    return iri(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid():
    return literal(F.uuid())


@on_terms
def _stringy(t) -> Column:
    return F.when(t.dt.isin(STRING, LANG), t.lex)


def _like(t: Term, lex: Column) -> Term:
    """A literal with t's datatype and language."""
    return make(LITERAL, lex, t.dt, t.lang)


@on_terms
def _fits(a, b):
    """Arguments go together: the second is plain, or both have the same language."""
    return (b.dt == STRING) | (a.lang.eqNullSafe(b.lang) & a.lang.isNotNull())


@on_terms
def strlen(t):
    return integer(F.length(_stringy(t)))


@on_terms
def ucase(t):
    return _like(t, F.upper(_stringy(t)))


@on_terms
def lcase(t):
    return _like(t, F.lower(_stringy(t)))


@on_terms
def substr(t, start: int, length: int | None = None):
    """Positions from 1, as XPath: characters before the first are cut off."""
    lo = max(start, 1)
    n = F.lit(2**31 - 1) if length is None else F.lit(max(0, start + length - lo))
    return _like(t, F.substring(_stringy(t), F.lit(lo), n))


@on_terms
def strstarts(a, b):
    return F.when(_fits(a, b), F.startswith(_stringy(a), b.lex))


@on_terms
def strends(a, b):
    return F.when(_fits(a, b), F.endswith(_stringy(a), b.lex))


@on_terms
def contains(a, b):
    return F.when(_fits(a, b), F.contains(_stringy(a), b.lex))


@on_terms
def strbefore(a, b):
    at = F.position(b.lex, a.lex)
    return choose(_fits(a, b) & _stringy(a).isNotNull(), choose(at > 0, _like(a, F.substring(a.lex, F.lit(1), at - 1)), L("")))


@on_terms
def strafter(a, b):
    at = F.position(b.lex, a.lex)
    return choose(_fits(a, b) & _stringy(a).isNotNull(), choose(at > 0, _like(a, F.substring(a.lex, at + F.length(b.lex), F.lit(2**31 - 1))), L("")))


@on_terms
def encode_for_uri(t):
    encoded = F.url_encode(_stringy(t))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return literal(encoded)


@on_terms
def concat(*parts):
    """Language-tagged if all parts have one tag, else plain."""
    lex = F.concat(*[_stringy(p) for p in parts])
    one = F.lit(True)
    for p in parts:
        one = one & p.lang.isNotNull() & (p.lang == parts[0].lang)
    return choose(one, lang_literal(lex, parts[0].lang), literal(lex))


@on_terms
def lang_matches(t, range_: str):
    tag = F.lower(_text(t))
    if range_ == "*":
        return tag != ""
    return (tag == range_.lower()) | tag.startswith(range_.lower() + "-")


def _regex(pattern: str, flags: str) -> str:
    pattern = re.escape(pattern) if "q" in flags else pattern
    inline = "".join(f for f in flags if f in "imsx")
    return f"(?{inline}){pattern}" if inline else pattern


@on_terms
def regex(t, pattern: str, flags: str = ""):
    return _stringy(t).rlike(_regex(pattern, flags))


@on_terms
def replace(t, pattern: str, by: str, flags: str = ""):
    return _like(t, F.regexp_replace(_stringy(t), _regex(pattern, flags), by))


# dates and hashes --------------------------------------------------------------------------------------------------


def now():
    return literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), DATETIME)


@on_terms
def year(t):
    return integer(_part(t, 1).try_cast("int"))


@on_terms
def month(t):
    return integer(_part(t, 2).try_cast("int"))


@on_terms
def day(t):
    return integer(_part(t, 3).try_cast("int"))


@on_terms
def hours(t):
    return integer(_part(t, 4).try_cast("int"))


@on_terms
def minutes(t):
    return integer(_part(t, 5).try_cast("int"))


@on_terms
def seconds(t):
    return number(_part(t, 6).try_cast("decimal(38,10)"), _part(t, 6).try_cast("double"), F.lit(2))


@on_terms
def timezone(t):
    """A dayTimeDuration; an error without a zone."""
    z = tz(t)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    shown = F.concat(F.when(z.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(F.lit("")), F.when((h == 0) & (m == 0), F.lit("0S")).otherwise(F.lit("")))
    return literal(F.when(z.isin("Z"), F.lit("PT0S")).when(z != "", shown), XSD + "dayTimeDuration")


@on_terms
def tz_term(t):
    return literal(tz(t))


@on_terms
def md5(t):
    return literal(F.md5(_text(t).cast("binary")))


@on_terms
def sha1(t):
    return literal(F.sha1(_text(t).cast("binary")))


@on_terms
def sha2(t, bits: int):
    return literal(F.sha2(_text(t).cast("binary"), bits))


# casts -------------------------------------------------------------------------------------------------------------


@on_terms
def cast(t, dt: str):
    """``xsd:*`` constructor functions; a value that doesn't fit is an error."""
    b = boolean(t)
    if dt == STRING:
        return str_(t)
    if dt == BOOLEAN:
        from_text = F.when(t.dt == STRING, F.when(t.lex.isin("true", "1"), True).when(t.lex.isin("false", "0"), False))
        return true_or_false(F.coalesce(b, from_text, F.when(rank(t).isNotNull(), (dbl(t) != 0) & ~F.isnan(dbl(t)))))
    if dt in (INTEGER, DECIMAL):
        text = F.when((t.dt == STRING) & t.lex.rlike(r"^[+-]?[0-9]+$" if dt == INTEGER else r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), t.lex.try_cast("decimal(38,10)"))
        value = F.coalesce(dec(t), F.when(rank(t) >= 3, dbl(t).try_cast("decimal(38,10)")), text, F.when(b, 1).when(~b, 0).cast("decimal(38,10)"))
        value = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("decimal(38,10)") if dt == INTEGER else value
        return number(value, value.cast("double"), F.lit(1 if dt == INTEGER else 2))
    if dt in (FLOAT, DOUBLE):
        text = F.when((t.dt == STRING) & t.lex.rlike(_NUMBER), t.lex.try_cast("double"))
        return number(None, F.coalesce(dbl(t), text, F.when(b, 1.0).when(~b, 0.0)), F.lit(3 if dt == FLOAT else 4))
    if dt == DATETIME:
        return literal(F.when(t.dt.isin(DATETIME, STRING) & t.lex.rlike(_STAMP) & t.lex.contains("T"), t.lex), DATETIME)
    raise ValueError(f"no cast to {dt}")


# N-Triples ---------------------------------------------------------------------------------------------------------


@on_terms
def ntriples(t) -> Column:
    """A term's canonical N-Triples form."""
    lex = t.lex
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    body = F.concat(F.lit('"'), lex, F.lit('"'))
    return (
        F.when(t.kind == IRI, F.concat(F.lit("<"), t.lex, F.lit(">")))
        .when(t.kind == BNODE, F.concat(F.lit("_:"), t.lex))
        .when(t.kind == TRIPLE, t.lex)
        .when(t.lang.isNotNull(), F.concat(body, F.lit("@"), t.lang))
        .when(t.dt == STRING, body)
        .otherwise(F.concat(body, F.lit("^^<"), t.dt, F.lit(">")))
    )


def _once(c: Column, f) -> Column:
    """``f(c)``, where ``f`` names its argument many times and ``c`` is to be there once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def numeric_escapes(line: Column) -> Column:
    """A line of N-Triples with ``\\uXXXX`` and ``\\UXXXXXXXX`` as characters; those that a string can't hold as such become short escapes."""

    def decoded(x: Column, mark: str, charset: str) -> Column:
        return F.when(x.startswith(mark), F.coalesce(F.decode(F.unhex(F.replace(x, F.lit(mark), F.lit(""))), charset), x)).otherwise(x)

    def whole(x: Column) -> Column:
        x = F.replace(x, F.lit("\\\\"), F.lit("\u0000"))
        for code, short in (("22", '\\"'), ("5[Cc]", "\u0000"), ("0[Aa]", "\\n"), ("0[Dd]", "\\r")):
            x = F.regexp_replace(x, rf"\\(?:u00|U000000){code}", short.replace("\\", "\\\\"))
        for letter, digits, charset in (("U", 8, "UTF-32"), ("u", 4, "UTF-16BE")):
            # a run of escapes is decoded as a whole, as two of them may be one character's halves
            pieces = F.split(F.regexp_replace(x, rf"((?:\\{letter}[0-9A-Fa-f]{{{digits}}})+)", "\u0001$1\u0001"), "\u0001")
            x = F.array_join(F.transform(pieces, lambda y: decoded(y, f"\\{letter}", charset)), "")  # noqa: B023
        return F.replace(x, F.lit("\u0000"), F.lit("\\\\"))

    return F.when(line.rlike(r"\\[uU]"), whole(line)).otherwise(line)


def parse_ntriples(c: Column) -> Term:
    """A term from its N-Triples form, without numeric escapes; NULL if it has none."""
    body = F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$', 1)
    dt = F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$', 2)
    tag = F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$', 3)
    for a, b in (("\\\\", "\u0000"), ('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
        body = F.replace(body, F.lit(a), F.lit(b))
    body = F.replace(body, F.lit("\u0000"), F.lit("\\"))
    tagged = choose(tag != "", lang_literal(body, tag), literal(body, F.when(dt != "", dt).otherwise(F.lit(STRING))))
    other = choose(c.startswith("_:"), bnode(F.substring(c, F.lit(3), F.length(c))), choose(c.startswith('"'), tagged))
    return choose(c.startswith("<<"), make(TRIPLE, c), choose(c.startswith("<"), iri(F.substring(c, F.lit(2), F.length(c) - 2)), other))


#: How deep quoted triples may be nested for their parts to be told.
NESTED = 4


def _quoted_pattern() -> str:
    """A quoted triple's N-Triples form, its parts as groups; terms inside are nested up to ``NESTED`` deep."""
    plain = r'<[^<>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?'
    term = plain
    for _ in range(NESTED - 1):
        term = rf"{plain}|<<\s*(?:{term})\s+<[^<>]*>\s+(?:{term})\s*>>"
    return rf"(?s)^<<\s*({term})\s+(<[^<>]*>)\s+({term})\s*>>$"


def _part_of_triple(t: Term, group: int) -> Term:
    text = F.regexp_extract(F.when(t.kind == TRIPLE, t.lex), _quoted_pattern(), group)
    return as_term(_once(text, lambda x: parse_ntriples(x).column()))


@on_terms
def subject(t) -> Term:
    """SPARQL-star ``SUBJECT``; NULL for terms that are no quoted triple, or nested more than ``NESTED`` deep."""
    return _part_of_triple(t, 1)


@on_terms
def predicate(t) -> Term:
    return _part_of_triple(t, 2)


@on_terms
def object_(t) -> Term:
    return _part_of_triple(t, 3)
