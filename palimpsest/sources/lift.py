"""Relational tables as quads, one union of column scans.

A row's subject is ``urn:t:<table>/<key>``, a column's predicate
``urn:t:<table>#<column>``; foreign keys become the referenced row's IRI, other
values typed literals.  A table without a key that is read from files has a
row's file and place there as its key.  Each column is a branch whose predicate is a constant,
so a pattern with a constant predicate prunes all branches but one and reads
that column and the key alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import terms as T
from ..plans.graph import DEFAULT, distinct_quads

#: Key of each table, and the table that a column refers to.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"]}
REFERENCES = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}


def subject(table: str, *keys: Column) -> T.Term:
    """A row's IRI; parts of a key of several columns are escaped and joined by a slash, so that no two keys run together."""
    parts = [k.cast("string") for k in keys]
    if len(parts) > 1:
        parts = [F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")) for x in parts]
        parts = [x for i, k in enumerate(parts) for x in ((F.lit("/"), k) if i else (k,))]
    return T.iri(F.concat(F.lit(f"urn:t:{table}/"), *parts))


def predicate(table: str, column: str) -> T.Const:
    return T.I(f"urn:t:{table}#{column}")


def value(c: Column, kind: S.DataType) -> T.Term:
    if isinstance(kind, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return T.literal(c, T.INTEGER)
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return T.literal(c, T.DOUBLE)
    if isinstance(kind, S.DecimalType):
        return T.literal(c, T.DECIMAL)
    if isinstance(kind, S.BooleanType):
        return T.literal(c, T.BOOLEAN)
    if isinstance(kind, S.DateType):
        return T.literal(c, T.DATE)
    if isinstance(kind, (S.TimestampType, S.TimestampNTZType)):
        return T.literal(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), T.DATETIME)
    return T.literal(c)


def lift_table(df: DataFrame, table: str, *, columns: list[str] | None = None, keys: list[str] | None = None, graph: Column | None = None) -> DataFrame:
    """Quads of one table; NULLs give none.  A table without a key has a 128-bit hash of whole rows as subject."""
    keys = keys or KEYS.get(table)
    s = subject(table, *[F.col(k) for k in keys]) if keys else subject(table, *[F.lpad(F.hex(F.xxhash64(F.lit(i), *df.columns)), 16, "0") for i in (1, 2)])
    g = DEFAULT.column() if graph is None else graph
    types = {f.name: f.dataType for f in df.schema}
    parts = []
    for c in columns or df.columns:
        o = subject(REFERENCES[c], F.col(c)) if c in REFERENCES else value(F.col(c), types[c])
        parts.append(df.where(F.col(c).isNotNull()).select(s.struct().alias("s"), predicate(table, c).column().alias("p"), o.struct().alias("o"), g.alias("g")))
    return reduce(DataFrame.union, parts)


def lift(spark: SparkSession, sf_dir: str, *columns: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Quads of the given columns, named ``table.column``."""
    by_table: dict[str, list[str]] = {}
    for c in columns:
        table, column = c.split(".")
        by_table.setdefault(table, []).append(column)
    parts = []
    for t, cs in by_table.items():
        df, keys = (tables or {}).get(t), KEYS.get(t)
        if df is None:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if keys is None:
                # a row's file and place in it: neither reads another column
                df, keys = df.select("*", F.hex(F.xxhash64("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row")), ["_file", "_row"]
        parts.append(lift_table(df, t, columns=cs, keys=keys))
    return reduce(DataFrame.union, parts)


def edges(df: DataFrame, p: str = "urn:e") -> DataFrame:
    """Quads of an edge table with integer columns x and y."""
    return df.select(subject("v", F.col("x")).struct().alias("s"), T.I(p).column().alias("p"), subject("v", F.col("y")).struct().alias("o"), DEFAULT.column().alias("g"))


def in_graph(quads: DataFrame, graph: T.Const) -> DataFrame:
    return quads.withColumn("g", graph.column())


def as_set(quads: DataFrame) -> DataFrame:
    return distinct_quads(quads.select("s", "p", "o", "g"))
