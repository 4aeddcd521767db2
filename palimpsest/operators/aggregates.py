"""SPARQL aggregates over term columns, to be given to ``Solutions.group``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.graph import DistinctTerms, cut


def count(name: str | None = None, distinct: bool = False) -> T.Term:
    if name is None:
        return T.integer(F.count("*"))
    x = F.col(name)["id"]
    return T.integer(F.count_distinct(x) if distinct else F.count(x))


def _exact_sum(t: T.Term) -> Column:
    """The decimal sum, 0 of nothing; NULL where it has too many digits."""
    return F.when(F.count(T.dec(t)) == 0, F.lit(0).cast("decimal(38,10)")).otherwise(F.try_sum(T.dec(t)).try_cast("decimal(38,10)"))


def sum_(name, distinct: bool = False) -> T.Term | DistinctTerms:
    """Promoted sum; 0 of nothing; an error if a value isn't numeric or an exact sum has too many digits.  DISTINCT is by term: 1 and 01 are two."""
    if distinct:
        return DistinctTerms(name, lambda: sum_(name))
    t = T.as_term(name)
    r = F.coalesce(F.max(T.rank(t)), F.lit(1))
    return T.choose(F.count("*") == F.count(T.dbl(t)), T.number(_exact_sum(t), F.coalesce(F.sum(T.dbl(t)), F.lit(0.0)), r))


def avg(name, distinct: bool = False) -> T.Term | DistinctTerms:
    """Promoted mean (a decimal at least); 0 of nothing; an error as for the sum."""
    if distinct:
        return DistinctTerms(name, lambda: avg(name))
    t = T.as_term(name)
    n = F.count(t.lex)
    r = F.coalesce(F.greatest(F.max(T.rank(t)), F.lit(2)), F.lit(1))
    exact = F.when(n == 0, F.lit(0).cast("decimal(38,10)")).otherwise(F.try_divide(_exact_sum(t), n.cast("decimal(38,0)")).try_cast("decimal(38,10)"))
    wide = F.coalesce(F.try_divide(F.sum(T.dbl(t)), n), F.lit(0.0))
    return T.choose(F.count("*") == F.count(T.dbl(t)), T.number(exact, wide, r))


def _sortable(name: str) -> Column:
    """A struct whose order is SPARQL's."""
    t = T.as_term(name)
    level = F.when(t.kind == T.BNODE, 1).when(t.kind == T.IRI, 2).otherwise(3)
    kind = F.when(T.rank(t).isNotNull(), 0).when(t.dt.isin(T.DATETIME, T.DATE), 1).when(t.dt == T.BOOLEAN, 2).otherwise(3)
    return F.struct(level, kind, F.coalesce(T.dbl(t), F.lit(0.0)), F.coalesce(T.stamp(t), F.lit(0)), t.lex, F.coalesce(t.dt, F.lit("")), F.coalesce(t.lang, F.lit("")))


def min_(name: str) -> Column:
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), _sortable(name)))


def max_(name: str) -> Column:
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), _sortable(name)))


def sample(name: str) -> Column:
    """Any bound term; the first in order, so that results repeat."""
    return min_(name)


def group_concat(name: str, separator: str = " ", distinct: bool = False) -> T.Term:
    """Lexical forms in their order, so that results repeat."""
    gather = F.collect_set if distinct else F.collect_list
    return T.literal(F.array_join(F.array_sort(gather(F.col(name)["lex"])), separator))


def term_stats(quads: DataFrame) -> DataFrame:
    """How often each term occurs, in any position."""
    every = F.explode(F.array("s", "p", "o")).alias("t")
    return quads.select(every).groupBy(F.col("t")["id"].alias("id")).agg(F.first(F.col("t")["lex"]).alias("term"), F.count("*").alias("n"))


def predicate_stats(quads: DataFrame) -> DataFrame:
    """VoID-like statistics: triples, distinct subjects and objects of each predicate."""
    return quads.groupBy(F.col("p")["lex"].alias("predicate")).agg(
        F.count("*").alias("triples"), F.count_distinct(F.col("s")["id"]).alias("subjects"), F.count_distinct(F.col("o")["id"]).alias("objects")
    )


#: Ranges of values in which each group's rows are counted.
RANGES = 64


def count_below(rows: DataFrame) -> DataFrame:
    """``x, n``: of rows ``x, v, low, high`` with one x, the pairs of a low one and a high one of larger v; groups without a pair are left out.

    Equal values are one row, and a group is sorted in ranges of values, so that no task sorts a whole group.
    """
    kept = cut(rows.groupBy("x", "v").agg(F.sum("low").alias("low"), F.sum("high").alias("high")))
    cuts = kept.approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.005)
    kept = kept.withColumn("part", sum((F.col("v") >= F.lit(b)).cast("int") for b in sorted(set(cuts))) if cuts else F.lit(0))
    over = Window.partitionBy("x").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.groupBy("x", "part").agg(F.sum("high").alias("own")).select("x", "part", F.coalesce(F.sum("own").over(over), F.lit(0)).alias("later"))
    inside = Window.partitionBy("x", "part").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    above = kept.withColumn("above", F.coalesce(F.sum("high").over(inside), F.lit(0))).join(parts, ["x", "part"])
    return above.groupBy("x").agg(F.sum(F.col("low") * (F.col("above") + F.col("later"))).alias("n")).where("n > 0")
