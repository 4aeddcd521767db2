"""Updates as deltas: DataFrames ``op, s, p, o, g`` with ``op`` 1 (insert) or -1 (delete).

A request reads the state before it; its deletes come before its inserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.graph import DEFAULT, Graph, Solutions, Var, const_filter, distinct_quads

QUAD = ["s", "p", "o", "g"]


def _keyed(quads: DataFrame) -> DataFrame:
    return quads.select("*", *[F.col(c)["id"].alias(f"_{c}") for c in QUAD])


_KEY = [f"_{c}" for c in QUAD]


def subtract(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return _keyed(quads).join(_keyed(gone).select(*_KEY), _KEY, "left_anti").select(*quads.columns)


def intersect(quads: DataFrame, other: DataFrame) -> DataFrame:
    return _keyed(quads).join(_keyed(other).select(*_KEY), _KEY, "left_semi").select(*quads.columns)


def signed(added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    parts = [df.select(F.lit(op).cast("tinyint").alias("op"), *QUAD) for df, op in ((added, 1), (removed, -1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def net(quads: DataFrame, added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """What really changes: quads to add that aren't there, quads to remove that are and aren't added again."""
    plus = None if added is None else subtract(distinct_quads(added.select(*QUAD)), quads)
    minus = None if removed is None else intersect(quads.select(*QUAD), removed)
    if minus is not None and added is not None:
        minus = subtract(minus, added)
    return signed(plus, minus)


def apply(quads: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a net delta."""
    return subtract(quads.select(*QUAD), delta.where("op = -1").select(*QUAD)).unionByName(delta.where("op = 1").select(*QUAD))


def fold(operations: DataFrame) -> DataFrame:
    """The last operation on each quad by ``seq``: add, remove, add leaves it there."""
    last = Window.partitionBy(*_KEY).orderBy(F.col("seq").desc())
    keyed = operations.select("*", *[F.col(c)["id"].alias(f"_{c}") for c in QUAD])
    return keyed.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("op", *QUAD)


def instantiate(solutions: Solutions, *template: tuple, graph: T.Const | None = None) -> DataFrame:
    """Quads of a template of (s, p, o) or (s, p, o, g)."""
    triples = [t for t in template if len(t) == 3]
    out = None
    if triples:
        out = solutions.construct(*triples).withColumn("g", (graph or DEFAULT).column())
    for s, p, o, g in (t for t in template if len(t) == 4):
        part = solutions.construct((s, p, o)) if isinstance(g, T.Const) else None
        if part is None:
            cells = [F.col(x.name).alias(c) if isinstance(x, Var) else x.column().alias(c) for x, c in zip((s, p, o, g), QUAD)]
            part = distinct_quads(solutions.df.select(*cells).where(" and ".join(f"{c} is not null" for c in QUAD)))
        else:
            part = part.withColumn("g", g.column())
        out = part if out is None else out.unionByName(part)
    return out


def insert_data(quads: DataFrame, data: DataFrame) -> DataFrame:
    return net(quads, data, None)


def delete_data(quads: DataFrame, data: DataFrame) -> DataFrame:
    return net(quads, None, data)


def modify(quads: DataFrame, where: Solutions, *, delete: list[tuple] | None = None, insert: list[tuple] | None = None, graph: T.Const | None = None) -> DataFrame:
    """DELETE/INSERT ... WHERE; ``graph`` is WITH.  ``where`` comes from the state before."""
    gone = instantiate(where, *delete, graph=graph) if delete else None
    new = instantiate(where, *insert, graph=graph) if insert else None
    return net(quads, new, gone)


def remove(quads: DataFrame, s=None, p=None, o=None, graphs: list[T.Const] | None = None) -> DataFrame:
    """Removes matches of a pattern with wildcards, each in its own graph; ``graphs`` None is every graph."""
    cond = F.lit(True)
    for c, x in zip("spo", (s, p, o)):
        if x is not None:
            cond = cond & const_filter(c, x)
    if graphs is not None:
        cond = cond & F.col("g")["lex"].isin([g.value for g in graphs])
    return signed(None, quads.where(cond))


def clear(quads: DataFrame, *graphs: T.Const) -> DataFrame:
    """CLEAR or DROP; no graph means all."""
    return remove(quads, graphs=list(graphs) or None)


def _moved(quads: DataFrame, source: T.Const, target: T.Const) -> DataFrame:
    return quads.where(const_filter("g", source)).select("s", "p", "o", target.column().alias("g"))


def add(quads: DataFrame, source: T.Const, target: T.Const) -> DataFrame:
    return net(quads, _moved(quads, source, target), None)


def copy(quads: DataFrame, source: T.Const, target: T.Const) -> DataFrame:
    """COPY onto itself changes nothing."""
    if source == target:
        return net(quads, quads.limit(0), None)
    return net(quads, _moved(quads, source, target), quads.where(const_filter("g", target)))


def move(quads: DataFrame, source: T.Const, target: T.Const) -> DataFrame:
    if source == target:
        return net(quads, quads.limit(0), None)
    return net(quads, _moved(quads, source, target), quads.where(F.col("g")["lex"].isin(source.value, target.value)))


def load(quads: DataFrame, data: DataFrame, graph: T.Const = DEFAULT) -> DataFrame:
    return net(quads, data.select("s", "p", "o", graph.column().alias("g")), None)


def graph_of(quads: DataFrame, **options) -> Graph:
    return Graph(quads, **options)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """A keyed table after puts and deletes."""
    kept = table.join(rows.select(*keys), keys, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select(*keys), keys, "left_anti")
    return kept.unionByName(rows)
