"""Property paths and cyclic patterns.

A path expression compiles to a DataFrame of pairs ``start, end`` (and ``g``
when each named graph counts on its own).  ``/``, ``^`` and ``|`` keep
duplicates; ``?``, ``*`` and ``+`` give sets of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.graph import Graph, Solutions, Var, const_filter, cut


class Path:
    def __truediv__(self, other: Path) -> Path:
        return Seq(self, other)

    def __or__(self, other: Path) -> Path:
        return Alt(self, other)

    def __invert__(self) -> Path:
        return Inverse(self)


@dataclass(frozen=True)
class Link(Path):
    predicate: T.Const


@dataclass(frozen=True)
class Seq(Path):
    first: Path
    then: Path


@dataclass(frozen=True)
class Alt(Path):
    one: Path
    other: Path


@dataclass(frozen=True)
class Inverse(Path):
    path: Path


@dataclass(frozen=True)
class Negated(Path):
    """``!(p1 | ^p2)``: any predicate but these, forward if some are forward, backward if some are backward."""

    forward: tuple[T.Const, ...] = ()
    backward: tuple[T.Const, ...] = ()


@dataclass(frozen=True)
class Optional_(Path):
    path: Path


@dataclass(frozen=True)
class Plus(Path):
    path: Path


@dataclass(frozen=True)
class Star(Path):
    path: Path


#: Rows up to which a frontier, or what it has reached, goes to every task.
BROADCAST_ROWS = 200_000


def vertices(triples: DataFrame) -> DataFrame:
    """Every subject and object, once (once a graph if there is a column g)."""
    more = [c for c in triples.columns if c == "g"]
    # whole terms are the key, so that hubs are merged by hash before the shuffle
    once = triples.select(F.explode(F.array("s", "o")).alias("start"), *more).distinct()
    return once.select("start", F.col("start").alias("end"), *more)


def _ids(*names: str) -> list:
    """Halves of ids as columns of their own, which are narrower than structs."""
    return [F.col(c)["id"][h].alias(f"{c}_{h}") for c in names for h in "ab"]


def _numbered(ends: DataFrame) -> DataFrame:
    """``n, start`` (and ``g``): terms, in each graph by itself, with a number; kept, so that numbers stay."""
    return cut(ends.withColumn("n", F.monotonically_increasing_id()))


def _reach(steps: DataFrame) -> DataFrame:
    """All pairs of numbers ``a, b`` joined by one step or more.

    ``far`` are the pairs whose shortest path has exactly 1, 2, 4, 8 ... steps,
    ``near`` those with a shorter one.  A pair between two such distances is one
    of ``near``, then one of ``far``: it is found once for each middle on its
    shortest paths, and not for each way of cutting it in two.  Where no shortest path has
    2^k steps, none has more.
    """
    on = lambda one, two: one.select("a", F.col("b").alias("m")).join(two.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
    far, near = cut(steps.distinct()), None
    while True:
        whole = far if near is None else near.union(far)
        if near is not None:
            whole = whole.union(cut(on(near, far).join(whole, ["a", "b"], "left_anti")))
        far, near = cut(on(far, far).join(whole, ["a", "b"], "left_anti")), whole
        if far.isEmpty():
            return near


def closure(pairs: DataFrame, zero: DataFrame | None = None) -> DataFrame:
    """All pairs joined by one step or more, and each of the vertices ``zero`` with itself.

    Rounds grow with the logarithm of the longest path.  They join numbers of
    vertices alone, a vertex being a term in a graph; terms come back at the end,
    those of ends first, while rows are narrow, as ends are often hubs.  Each round is kept in
    the shared checkpoint folder.
    """
    more = [c for c in pairs.columns if c == "g"]
    node = _numbered((zero if zero is not None else vertices(pairs.select(F.col("start").alias("s"), F.col("end").alias("o"), *more))).select("start", *more))
    steps = pairs.select(*_ids("start", "end", *more))
    for c, n in (("end", "b"), ("start", "a")):
        keys = [f"{x}_{h}" for x in (c, *more) for h in "ab"]
        own = node.select(*[k.alias(name) for k, name in zip(_ids("start", *more), keys)], F.col("n").alias(n))
        steps = steps.join(own, keys).drop(f"{c}_a", f"{c}_b")
    found = _reach(steps.select("a", "b"))
    if zero is not None:
        found = found.where("a <> b")
    found = found.join(node.select(F.col("n").alias("b"), F.col("start").alias("end")), "b").join(node.withColumnRenamed("n", "a"), "a").select("start", "end", *more)
    return found if zero is None else found.unionByName(node.select("start", F.col("start").alias("end"), *more))


def closure_from(pairs: DataFrame, end: str, term: T.Const) -> DataFrame:
    """The closure's pairs whose ``end`` (start or end) is a constant: a frontier goes out from it, one step a round.

    A small frontier goes to every task, so that the steps are read in a round, but not shuffled.
    """
    more = [c for c in pairs.columns if c == "g"]
    other, graphs = "end" if end == "start" else "start", [f"g_{h}" for h in "ab"] if more else []
    here, there = [f"{end}_{h}" for h in "ab"], [f"{other}_{h}" for h in "ab"]
    steps = cut(pairs.select(*_ids("start", "end", *more)))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    new = reach = cut(pairs.where(const_filter(end, term)).select(*_ids(other, *more)).distinct())
    total = count = new.count()
    while count:
        # the frontier's far side becomes the next step's near side
        onward = steps.join(small(new.select(*[F.col(t).alias(h) for t, h in zip(there, here)], *graphs), count), [*here, *graphs]).select(*there, *graphs).distinct()
        new = cut(onward.join(small(reach, total), [*there, *graphs], "left_anti"))
        count = new.count()
        reach, total = reach.union(new), total + count
    # each end that was reached is the far end of some step, which has its term
    ends = pairs.select(F.col(other), *more, *_ids(other, *more)).join(small(reach, total), [*there, *graphs], "left_semi").select(other, *more).distinct()
    return ends.select(term.column().alias(end), other, *more).select("start", "end", *more)


def pairs(path: Path, triples: DataFrame) -> DataFrame:
    """Pairs of a path over triples; with a column g, paths stay inside a graph."""
    more = [c for c in triples.columns if c == "g"]
    again = lambda p: pairs(p, triples)
    if isinstance(path, Link):
        return triples.where(const_filter("p", path.predicate)).select(F.col("s").alias("start"), F.col("o").alias("end"), *more)
    if isinstance(path, Inverse):
        return again(path.path).select(F.col("end").alias("start"), F.col("start").alias("end"), *more)
    if isinstance(path, Seq):
        a, b = again(path.first), again(path.then)
        b = b.select(F.col("start").alias("mid"), F.col("end").alias("far"), *[F.col(m).alias(f"{m}2") for m in more])
        on = a["end"]["id"] == b["mid"]["id"]
        for m in more:
            on = on & (a[m]["id"] == b[f"{m}2"]["id"])
        return a.join(b, on).select("start", F.col("far").alias("end"), *more)
    if isinstance(path, Alt):
        return again(path.one).unionByName(again(path.other))
    if isinstance(path, Negated):
        out = None
        for predicates, swap in ((path.forward, False), (path.backward, True)):
            if predicates:
                rest = triples.where(~F.col("p")["lex"].isin([p.value for p in predicates]))
                step = rest.select(F.col("o" if swap else "s").alias("start"), F.col("s" if swap else "o").alias("end"), *more)
                out = step if out is None else out.unionByName(step)
        return out if out is not None else triples.select(F.col("s").alias("start"), F.col("o").alias("end"), *more)
    if isinstance(path, Optional_):
        # pairs of one vertex are all there by the path without a step
        return again(path.path).where(F.col("start")["id"] != F.col("end")["id"]).distinct().unionByName(vertices(triples))
    if isinstance(path, Plus):
        return closure(again(path.path))
    if isinstance(path, Star):
        return closure(again(path.path), vertices(triples))
    raise TypeError(path)


def match(dataset: Graph, start, path: Path, end, graph: T.Const | Var | None = None) -> Solutions:
    """Solutions of ``start path end``.

    With a graph variable, zero-length and repeated paths are taken in each
    graph on its own.  A constant end matches itself by a zero-length path even
    where it isn't in the data (the graph variable is then unbound).
    """
    triples = dataset.triples(graph)
    fixed = next(((c, x) for c, x in (("start", start), ("end", end)) if isinstance(x, T.Const)), None)
    if fixed and isinstance(path, (Plus, Star)):
        df = closure_from(pairs(path.path, triples), *fixed)
        if isinstance(path, Star):
            # the constant as a vertex: looked for before vertices are merged
            own = triples.where(const_filter("s", fixed[1]) | const_filter("o", fixed[1]))
            df = df.unionByName(vertices(own).where(const_filter(*fixed))).distinct()
    else:
        df = pairs(path, triples)
    maybe = set()
    zero = isinstance(path, (Star, Optional_))
    for x, y in ((start, end), (end, start)):
        if zero and isinstance(x, T.Const) and (isinstance(y, Var) or x == y):
            loop = triples.sparkSession.range(1).select(x.column().alias("start"), x.column().alias("end"))
            have = df.where(const_filter("start", x) & const_filter("end", x)).select(F.lit(1).alias("_")).limit(1)
            loop = loop.join(have, F.lit(True), "left_anti")
            df = df.unionByName(loop, allowMissingColumns=True)
            maybe |= {graph.name} if isinstance(graph, Var) else set()
            break
    names: dict[str, str] = {}
    for column, x in (("start", start), ("end", end), ("g", graph)):
        if isinstance(x, T.Const) and column != "g":
            df = df.where(const_filter(column, x))
        elif isinstance(x, Var):
            if x.name in names:
                df = df.where(F.col(column)["id"] == F.col(names[x.name])["id"])
            else:
                names[x.name] = column
    return Solutions(df.select(*[F.col(c).alias(v) for v, c in names.items()]), maybe)


def triangles(edges: DataFrame) -> DataFrame:
    """Directed triangles a -> b -> c -> a of the distinct pairs ``x, y``, all three rotations.

    Each edge goes from its end of smaller degree to the other, so that a hub's
    neighbours are never paired with each other: wedges are bounded by edges
    times the square root of edges.  Both directions travel as flags of one row.
    """
    plain = edges.select("x", "y").distinct()
    loops = plain.where("x = y").select(F.col("x").alias("l"))
    proper = plain.where("x <> y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    both = proper.groupBy(low.alias("u"), high.alias("v")).agg(F.bool_or(F.col("x") < F.col("y")).alias("up"), F.bool_or(F.col("x") > F.col("y")).alias("down"))
    both = cut(both)
    degree = both.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    ranked = both.join(degree.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    forward = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    arcs = cut(ranked.select(pick("u", "v").alias("a"), pick("v", "u").alias("b"), pick("up", "down").alias("to"), pick("down", "up").alias("back"), pick("du", "dv").alias("da"), pick("dv", "du").alias("db")))
    one = arcs.select("a", F.col("b").alias("b"), F.col("to").alias("ab"), F.col("back").alias("ba"), F.struct(F.col("db"), F.col("b")).alias("kb"))
    two = arcs.select("a", F.col("b").alias("c"), F.col("to").alias("ac"), F.col("back").alias("ca"), F.struct(F.col("db"), F.col("b")).alias("kc"))
    third = arcs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("to").alias("bc"), F.col("back").alias("cb"))
    found = one.join(two, (one.a == two.a) & (one.kb < two.kc)).select(one.a, "b", "c", "ab", "ba", "ac", "ca").join(third, ["b", "c"])
    turn = lambda f, x, y, z: F.when(f, F.array(*[F.struct(F.col(i).alias("a"), F.col(j).alias("b"), F.col(k).alias("c")) for i, j, k in ((x, y, z), (y, z, x), (z, x, y))]))
    none = F.array().cast("array<struct<a:bigint,b:bigint,c:bigint>>")
    kind = "array<struct<a:bigint,b:bigint,c:bigint>>"
    ways = F.concat(F.coalesce(turn(F.col("ab") & F.col("bc") & F.col("ca"), "a", "b", "c").cast(kind), none), F.coalesce(turn(F.col("ac") & F.col("cb") & F.col("ba"), "a", "c", "b").cast(kind), none))
    out = found.select(F.inline(ways))
    # with loops: all ends the same, or a loop and an edge both ways
    bigint = lambda *c: [F.col(x).cast("bigint").alias(n) for x, n in zip(c, "abc")]
    out = out.unionByName(loops.select(*bigint("l", "l", "l")))
    mutual = both.where("up and down").select("u", "v").union(both.where("up and down").select("v", "u")).toDF("l", "m").join(loops, "l")
    for form in (("l", "l", "m"), ("l", "m", "l"), ("m", "l", "l")):
        out = out.unionByName(mutual.select(*bigint(*form)))
    return out
