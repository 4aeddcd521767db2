"""Graph patterns over quads, as DataFrame operations.

``Graph`` is the active dataset: a DataFrame of quads whose columns ``s, p, o,
g`` are term structs (see ``functions.terms``).  ``Solutions`` is a bag of
solution mappings: a DataFrame with a term column for each variable, and which
of these may be unbound.  Joins use ids alone; lexical forms that a query
doesn't ask for are pruned by Catalyst before they are shuffled.  Join
strategies are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T


@dataclass(frozen=True)
class Var:
    name: str


V = Var
#: The default graph's name in the column ``g``.
DEFAULT = T.Const(T.IRI, "")


def const_filter(column: str, term: T.Const) -> Column:
    """Equality with a constant, part by part, so that scans can use it."""
    c = F.col(column)
    out = (c["kind"] == term.kind) & (c["lex"] == term.value)
    if term.datatype:
        out &= c["dt"] == term.datatype
    return out & (c["lang"] == term.tag.lower()) if term.tag else out


@dataclass(frozen=True)
class DistinctTerms:
    """An aggregate over the distinct terms of a variable; ``over_terms`` builds it for one row a term."""

    name: str
    over_terms: Callable[[], T.Term]


class Solutions:
    """A bag of solutions; ``maybe`` are the variables that can be unbound."""

    def __init__(self, df: DataFrame, maybe: Iterable[str] = ()):
        self.df, self.maybe = df, frozenset(maybe)

    @property
    def vars(self) -> list[str]:
        return self.df.columns

    # joins
    def _cases(self, other: Solutions) -> list[tuple[Column, Column, Column]]:
        """Ways in which rows of both sides are compatible: tests of the left and right rows, and an equality of ids.

        An unbound variable is compatible with anything.  Each variable that may
        be unbound is bound on both sides, or unbound left, or unbound right only,
        so that each way is a join on equal ids, and no pair of rows has two ways.
        """
        cases = [(F.lit(True), F.lit(True), F.lit(True))]
        for v in (v for v in self.vars if v in other.vars):
            a, b = F.col(v), F.col(f"{v}__r")
            ways = [(a.isNotNull() if v in self.maybe else F.lit(True), b.isNotNull() if v in other.maybe else F.lit(True), a["id"] == b["id"])]
            if v in self.maybe:
                ways.append((a.isNull(), F.lit(True), F.lit(True)))
            if v in other.maybe:
                ways.append((a.isNotNull() if v in self.maybe else F.lit(True), b.isNull(), F.lit(True)))
            cases = [(x & left, y & right, z & on) for x, y, z in cases for left, right, on in ways]
        return cases

    def _joined(self, other: Solutions, how: str, extra: Column | None = None) -> tuple[DataFrame, list[str]]:
        shared = [v for v in self.vars if v in other.vars]
        right = other.df.select(*[F.col(f"`{v}`").alias(f"{v}__r" if v in shared else v) for v in other.vars])
        extra = F.lit(True) if extra is None else F.coalesce(extra, F.lit(False))
        cases = self._cases(other)
        if len(cases) == 1:
            return self.df.join(right, cases[0][2] & extra, how), shared
        matched = [self.df.where(x).join(right.where(y), z & extra) for x, y, z in cases] if how in ("inner", "left") else []
        rest, found = self.df, []
        if how != "inner":
            for x, y, z in cases:
                # the left test goes into the condition: rows that fail it stay among the rest
                if how == "left_semi":
                    found.append(rest.join(right.where(y), x & z & extra, "left_semi"))
                rest = rest.join(right.where(y), x & z & extra, "left_anti")
        if how == "left_semi":
            return reduce(DataFrame.unionByName, found), shared
        if how == "left_anti":
            return rest, shared
        out = reduce(DataFrame.unionByName, matched)
        return (out.unionByName(rest, allowMissingColumns=True) if how == "left" else out), shared

    def _merged(self, df: DataFrame, other: Solutions, shared: list[str]) -> DataFrame:
        cols = [F.coalesce(v, f"{v}__r").alias(v) if v in shared and v in self.maybe else F.col(v) for v in self.vars]
        return df.select(*cols, *[F.col(v) for v in other.vars if v not in shared])

    def join(self, other: Solutions) -> Solutions:
        df, shared = self._joined(other, "inner")
        both = {v for v in shared if v in self.maybe and v in other.maybe}
        return Solutions(self._merged(df, other, shared), both | {v for v in self.maybe | other.maybe if v not in shared})

    def optional(self, other: Solutions, condition: Column | None = None) -> Solutions:
        """Left join; the condition sees the variables of both sides."""
        df, shared = self._joined(other, "left", condition)
        return Solutions(self._merged(df, other, shared), (self.maybe & set(shared)) | {v for v in self.maybe if v not in shared} | {v for v in other.vars if v not in shared})

    def minus(self, other: Solutions) -> Solutions:
        """Rows without a compatible row that shares a bound variable."""
        shared = [v for v in self.vars if v in other.vars]
        if not shared:
            return self
        overlap = F.lit(False)
        if any(v not in self.maybe and v not in other.maybe for v in shared):
            overlap = None
        else:
            for v in shared:
                overlap = overlap | (F.col(v).isNotNull() & F.col(f"{v}__r").isNotNull())
        df, _ = self._joined(other, "left_anti", overlap)
        return Solutions(df, self.maybe)

    def exists(self, other: Solutions, negated: bool = False, condition: Column | None = None) -> Solutions:
        """FILTER [NOT] EXISTS with the pattern's solutions."""
        df, _ = self._joined(other, "left_anti" if negated else "left_semi", condition)
        return Solutions(df, self.maybe)

    def union(self, other: Solutions) -> Solutions:
        missing = set(self.vars) ^ set(other.vars)
        return Solutions(self.df.unionByName(other.df, allowMissingColumns=True), self.maybe | other.maybe | missing)

    # expressions
    def filter(self, condition: Column) -> Solutions:
        """Rows for which a boolean column is true; an error (NULL) removes them."""
        return Solutions(self.df.where(condition), self.maybe)

    def bind(self, name: str, term) -> Solutions:
        return Solutions(self.df.withColumn(name, T.as_term(term).column()), self.maybe | {name})

    def numbers(self, *names: str) -> Solutions:
        """Works out numeric values once, as columns beside the terms, for ``terms.numbered`` in what follows."""
        new = {}
        for n in names:
            t = T.as_term(n)
            new |= {f"{n}__exact": T.dec(t), f"{n}__wide": T.dbl(t), f"{n}__rank": T.rank(t)}
        return Solutions(self.df.withColumns(new), self.maybe)

    def project(self, *names: str) -> Solutions:
        return Solutions(self.df.select(*names), self.maybe & set(names))

    def rename(self, **names: str) -> Solutions:
        """``new=old`` for each variable to be renamed."""
        back = {old: new for new, old in names.items()}
        return Solutions(self.df.select(*[F.col(v).alias(back.get(v, v)) for v in self.vars]), {back.get(v, v) for v in self.maybe})

    def distinct(self) -> Solutions:
        # whole terms are the key: they are merged by hash where they are; by ids, the rest of each would have to be sorted
        return Solutions(self.df.distinct(), self.maybe)

    def order_by(self, *keys) -> Solutions:
        """By value; a key is a variable, or (variable, "desc")."""
        columns = []
        for k in keys:
            name, down = (k, False) if isinstance(k, str) else (k[0], k[1] == "desc")
            columns += T.order_keys(F.col(name), down)
        return Solutions(self.df.orderBy(*columns), self.maybe)

    def slice(self, limit: int | None = None, offset: int = 0) -> Solutions:
        df = self.df.offset(offset) if offset else self.df
        return Solutions(df if limit is None else df.limit(limit), self.maybe)

    def group(self, *by: str, **aggregates: Callable[[], T.Term] | Column) -> Solutions:
        """GROUP BY term; without keys one group, of an empty bag too.  Aggregates: see ``operators.aggregates``."""
        distinct = {k: a for k, a in aggregates.items() if isinstance(a, DistinctTerms)}
        if distinct:
            return self._group_distinct(by, aggregates, distinct)
        out = {k: (a.column() if isinstance(a, T.Term) else a) for k, a in aggregates.items()}
        if not by:
            return Solutions(self.df.agg(*[c.alias(k) for k, c in out.items()]), out)
        keyed = self.df.groupBy(*[F.col(v)["id"].alias(f"_{v}") for v in by])
        df = keyed.agg(*[F.first(v).alias(v) for v in by], *[c.alias(k) for k, c in out.items()])
        return Solutions(df.select(*by, *out), (self.maybe & set(by)) | set(out))

    def _group_distinct(self, by: tuple[str, ...], aggregates: dict, distinct: dict) -> Solutions:
        """Each aggregate of distinct terms over one row a term, joined with the others by the keys' ids."""
        ids = [F.col(v)["id"].alias(f"_{v}") for v in by]
        rest = {k: a for k, a in aggregates.items() if k not in distinct}
        parts = [self.df.groupBy(*ids).agg(*[F.first(v).alias(v) for v in by], *[(a.column() if isinstance(a, T.Term) else a).alias(k) for k, a in rest.items()], F.count("*").alias("__n"))]
        for k, a in distinct.items():
            names = [F.col(f"_{v}") for v in by]
            once = self.df.select(*ids, F.col(a.name), F.col(a.name)["id"].alias("__id")).groupBy(*names, "__id").agg(F.first(a.name).alias(a.name))
            parts.append(once.groupBy(*[F.col(f"_{v}").alias(f"_{v}__r") for v in by]).agg(a.over_terms().column().alias(k)))
        df = parts[0]
        for part in parts[1:]:
            on = F.lit(True)
            for v in by:
                on = on & F.col(f"_{v}").eqNullSafe(F.col(f"_{v}__r"))
            df = df.join(part, on).drop(*[f"_{v}__r" for v in by])
        return Solutions(df.select(*by, *aggregates), (self.maybe & set(by)) | set(aggregates))

    # forms
    def ask(self) -> DataFrame:
        return self.df.limit(1).agg((F.count("*") > 0).alias("ask"))

    def construct(self, *template: tuple) -> DataFrame:
        """Distinct triples of the template; a blank node constant is fresh for each solution; rows with unbound parts give none."""
        ground = self.df.withColumn("_row", F.xxhash64(*[F.col(v)["id"] for v in self.vars], F.monotonically_increasing_id()) if any(isinstance(x, T.Const) and x.kind == T.BNODE for t in template for x in t) else F.lit(0))

        def part(x):
            if isinstance(x, Var):
                return F.col(x.name)
            return T.bnode(F.concat(F.lit(x.value), F.lit("_"), F.hex("_row"))).column() if x.kind == T.BNODE else x.column()

        rows = F.array(*[F.struct(*[part(x).alias(n) for x, n in zip(t, "spo")]) for t in template])
        triples = ground.select(F.explode(rows).alias("t")).select("t.*").where("s is not null and p is not null and o is not null and s.kind in (0, 1, 3) and p.kind = 0")
        return distinct_quads(triples)

    def native(self, **casts: str) -> DataFrame:
        """Lexical forms as native columns: ``name="double"`` and so on; others are strings."""
        return self.df.select(*[(F.col(v)["lex"].try_cast(casts[v]) if v in casts else F.col(v)["lex"]).alias(v) for v in self.vars])


def distinct_quads(quads: DataFrame) -> DataFrame:
    """Set semantics by term ids."""
    names = quads.columns
    return quads.select("*", *[F.col(n)["id"].alias(f"_{n}") for n in names]).dropDuplicates([f"_{n}" for n in names]).select(*names)


def is_cyclic(patterns: list[tuple]) -> bool:
    """Whether the patterns' variables form a cyclic hypergraph (ear removal leaves something)."""
    edges = [e for e in ({x.name for x in p if isinstance(x, Var)} for p in patterns) if e]
    while True:
        for i, e in enumerate(edges):
            others = edges[:i] + edges[i + 1 :]
            inside = {v for v in e if any(v in o for o in others)}
            if not inside or any(inside <= o for o in others):
                edges = others
                break
        else:
            return bool(edges)


class Graph:
    """The active dataset of a query.

    Without a clause the default graph is the union of all graphs; ``default``
    limits it (FROM), ``named`` limits what GRAPH sees (FROM NAMED).  A triple
    that is in several of the merged graphs counts once; ``merge=False`` says
    that none is, which saves that shuffle.
    """

    def __init__(self, quads: DataFrame, *, default: list[T.Const] | None = None, named: list[T.Const] | None = None, merge: bool = True):
        self.quads, self.default, self.named, self.merge = quads, default, named, merge

    def _in(self, graphs: list[T.Const]) -> DataFrame:
        return self.quads.where(F.col("g")["lex"].isin([g.value for g in graphs]))

    def triples(self, graph: T.Const | Var | None = None) -> DataFrame:
        """Columns s, p, o of the default graph or of one named graph; and g where it is a variable."""
        if graph is None:
            quads = self.quads if self.default is None else self._in(self.default)
            triples = quads.select("s", "p", "o")
            return distinct_quads(triples) if self.merge and (self.default is None or len(self.default) > 1) else triples
        quads = self.quads.where(F.col("g")["lex"] != "") if self.named is None else self._in(self.named)
        if isinstance(graph, Var):
            return quads
        return quads.where(const_filter("g", graph)).select("s", "p", "o")

    def scan(self, s, p, o, graph: T.Const | Var | None = None) -> Solutions:
        """Solutions of one pattern; constants are pushed down, a repeated variable is an equality."""
        # constants go before the merge of graphs, which doesn't change what they select
        source = Graph(self.quads.where(_constants(s, p, o)), default=self.default, named=self.named, merge=self.merge)
        df = source.triples(graph)
        first: dict[str, str] = {}
        for column, x in zip("spog", (s, p, o, graph)):
            if isinstance(x, Var):
                if x.name in first:
                    df = df.where(F.col(column)["id"] == F.col(first[x.name])["id"])
                else:
                    first[x.name] = column
        return Solutions(df.select(*[F.col(c).alias(v) for v, c in first.items()]))

    def bgp(self, *patterns: tuple, graph: T.Const | Var | None = None, given: dict[str, T.Const] | None = None, closing: str | None = None) -> Solutions:
        """A basic graph pattern.  Joins follow shared variables, patterns with more constants first.

        ``closing`` is a join hint for patterns that close a cycle, their variables being bound by then.  Open paths
        may be many more than the pattern's own rows: with ``shuffle_hash`` these alone are held and nothing is sorted.

        A pattern of constants alone is an existence test of the whole.
        ``given`` are variables with preset values: scans see constants in their
        place, and the solutions have them.
        """
        if given:
            preset = lambda t: given.get(t.name, t) if isinstance(t, Var) else t
            found = self.bgp(*[tuple(preset(t) for t in one) for one in patterns], graph=preset(graph), closing=closing)
            named = [x.name for one in (*patterns, (graph,)) for x in one if isinstance(x, Var)]
            cells = [given[v].column().alias(v) for v in given if v in named]
            return Solutions(found.df.select("*", *cells), found.maybe)
        waiting = list(patterns)
        bound = lambda p: {x.name for x in p if isinstance(x, Var)}
        tests = [p for p in waiting if not bound(p) and not isinstance(graph, Var)]
        waiting = [p for p in waiting if p not in tests]
        out: Solutions | None = None
        while waiting:
            have = set(out.vars) if out else set()
            best = min(waiting, key=lambda p: (not (bound(p) & have) if out else False, -len(bound(p) & have), len(bound(p)), patterns.index(p)))
            waiting.remove(best)
            part = self.scan(*best, graph=graph)
            if closing and len(bound(best)) > 1 and bound(best) <= have:
                part = Solutions(part.df.hint(closing), part.maybe)
            out = part if out is None else out.join(part)
        if out is None:
            out = Solutions(self.quads.sparkSession.range(1).select())
        for t in tests:
            found = self.scan(*t, graph=graph).df.select(F.lit(1).alias("_t")).limit(1)
            out = Solutions(out.df.join(found, F.lit(True), "left_semi"))
        return out

    def contexts(self) -> DataFrame:
        return self.quads.where(F.col("g")["lex"] != "").select("g").dropDuplicates().select(F.col("g")["lex"].alias("g"))

    def size(self, *graphs: T.Const) -> DataFrame:
        return (self._in(list(graphs)) if graphs else self.quads).agg(F.count("*").alias("size"))

    def contains(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` (s, p, o, g) that are in the dataset."""
        keys = [F.col(f"w.{c}")["id"] == F.col(f"q.{c}")["id"] for c in "spog"]
        return wanted.alias("w").join(self.quads.alias("q"), keys, "left_semi")

    def quoted_triples(self, s: T.Const | None = None, p: T.Const | None = None, o: T.Const | None = None) -> DataFrame:
        """Distinct quoted triples ``t`` that are a subject or an object, and their parts; constants limit the parts."""
        ends = self.triples().select(F.explode(F.array("s", "o")).alias("t")).where(F.col("t")["kind"] == T.TRIPLE)
        parts = distinct_quads(ends).select("t", *[part(F.col("t")).alias(c) for c, part in (("s", T.subject), ("p", T.predicate), ("o", T.object_))])
        return parts.where(_constants(s, p, o))

    def describe(self, resources: Solutions, name: str) -> DataFrame:
        """Triples whose subject is a resource, and those of the blank nodes that these lead to."""
        triples = self.triples()
        seen = resources.df.select(F.col(name)["id"].alias("n")).distinct()
        got = triples.join(seen, triples.s["id"] == seen.n, "left_semi")
        while True:
            more = got.where("o.kind = 1").select(F.col("o")["id"].alias("n")).distinct().join(seen, "n", "left_anti")
            if not more.limit(1).count():
                return distinct_quads(got)
            seen = cut(seen.union(more))
            got = triples.join(seen, triples.s["id"] == seen.n, "left_semi")


def _constants(*parts) -> Column:
    out = F.lit(True)
    for column, x in zip("spo", parts):
        if isinstance(x, T.Const):
            out = out & const_filter(column, x)
    return out


def values(spark, names: list[str], rows: list[list[T.Const | None]]) -> Solutions:
    """VALUES: a table of constants; None is unbound."""
    null = F.lit(None).cast(T.TERM)
    cells = F.array(*[F.struct(*[(null if x is None else x.column()).alias(n) for n, x in zip(names, r)]) for r in rows])
    df = spark.range(1).select(F.explode(cells).alias("r")).select("r.*")
    return Solutions(df, {n for i, n in enumerate(names) if any(r[i] is None for r in rows)})


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only on one machine a temporary one may stand in."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Rows that a task gets of narrow rows which are to be made wide.
TASK_ROWS = 100_000


def dealt(df: DataFrame, *keys, rows: int = TASK_ROWS) -> DataFrame:
    """``df``, which is counted, dealt by keys to tasks of about ``rows`` rows, however few bytes these have."""
    return df.repartition(df.count() // rows + 1, *keys)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: what is dear to make and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
