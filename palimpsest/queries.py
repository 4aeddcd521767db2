"""One registered query for each operator, over the relational tables lifted to quads, and its DuckDB form."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import terms as T
from .functions.terms import I, L, Ref
from .history import algebra
from .history.repository import Repository, clone
from .operators import aggregates as A
from .operators import canon, update
from .operators import paths as P
from .plans.graph import DEFAULT, Graph, Solutions, Var, dealt, shared_folder, stored, values
from .sources import rdf, turtle
from .sources.lift import edges, lift, lift_table, predicate
from .streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# helpers -----------------------------------------------------------------------------------------------------------


def p(name: str) -> T.Const:
    return predicate(*name.split("."))


def key(name: str) -> Column:
    """The number at the end of a row's IRI."""
    return F.substring_index(F.col(name)["lex"], "/", -1).cast("bigint")


def lex(name: str) -> Column:
    return F.col(name)["lex"]


def num(name: str, digits: int = 2) -> Column:
    return F.round(lex(name).cast("double"), digits)


def whole(name: str) -> Column:
    return lex(name).cast("decimal(38,10)").cast("bigint")


def graph(spark, sf_dir, *columns: str) -> Graph:
    """Lifted columns; each quad is there once, in the default graph."""
    return Graph(lift(spark, sf_dir, *columns), merge=False)


def read(spark, sf_dir, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


c, o, l, n, s, k, v, w, x, y, z, g = (Var(i) for i in "colnskvwxyzg")


def edge_table(spark, sf_dir) -> DataFrame:
    """Each order's customer and a customer told by its key: as many vertices as customers, about ten edges of each."""
    n = read(spark, sf_dir, "customer").count()
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("x"), (F.col("o_orderkey") * 7919 % max(n, 1) + 1).alias("y")).distinct()


def sparse_table(spark, sf_dir) -> DataFrame:
    """Customers and suppliers to their nations, nations to their regions; a vertex is its key times four and its table's number."""
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    vertex = lambda name, table: (F.col(name).cast("bigint") * 4 + table)
    links = [(c, "c_custkey", 0, "c_nationkey", 2), (s, "s_suppkey", 1, "s_nationkey", 2), (n, "n_nationkey", 2, "n_regionkey", 3)]
    return reduce(DataFrame.union, [d.select(vertex(x, i).alias("x"), vertex(y, j).alias("y")) for d, x, i, y, j in links])


E = I("urn:e")
G1 = "(SELECT DISTINCT o_custkey AS x, o_orderkey * 7919 % greatest((SELECT count(*) FROM customer), 1) + 1 AS y FROM orders)"
G2 = (
    "(SELECT c_custkey * 4 AS x, c_nationkey::BIGINT * 4 + 2 AS y FROM customer UNION ALL SELECT s_suppkey * 4 + 1, s_nationkey::BIGINT * 4 + 2 FROM supplier "
    "UNION ALL SELECT n_nationkey::BIGINT * 4 + 2, n_regionkey::BIGINT * 4 + 3 FROM nation)"
)


def order_chains(spark, sf_dir, ring: bool = False) -> DataFrame:
    """Each order of the table and its customer's next one; in a ring the last leads to the first.  Closures grow with the table."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    after = F.lead("o_orderkey").over(own)
    after = F.coalesce(after, F.first("o_orderkey").over(own)) if ring else after
    # dealt while rows are narrow: what adaptive execution puts into one task by its bytes is too much once it is terms
    orders = dealt(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    return orders.select(F.col("o_orderkey").alias("x"), after.alias("y")).where("y is not null")


G3 = "(SELECT x, y FROM (SELECT o_orderkey AS x, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM orders) WHERE y IS NOT NULL)"
G4 = "(SELECT o_orderkey AS x, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS y FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


# scans -------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS c, c_mktsegment AS seg FROM customer")
def scan_p(spark, sf_dir):
    m = graph(spark, sf_dir, "customer.c_mktsegment", "customer.c_name").scan(c, p("customer.c_mktsegment"), v)
    return m.df.select(key("c").alias("c"), lex("v").alias("seg"))


@query("SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_po(spark, sf_dir):
    return graph(spark, sf_dir, "customer.c_mktsegment").scan(c, p("customer.c_mktsegment"), L("BUILDING")).df.select(key("c").alias("c"))


@query("SELECT 'c_name' AS p, c_name AS v FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_nationkey', 'urn:t:nation/' || c_nationkey FROM customer WHERE c_custkey = 5")
def scan_s(spark, sf_dir):
    m = graph(spark, sf_dir, "customer.c_name", "customer.c_mktsegment", "customer.c_nationkey").scan(I("urn:t:customer/5"), x, v)
    return m.df.select(F.substring_index(lex("x"), "#", -1).alias("p"), lex("v").alias("v"))


@query("SELECT 3 * count(*) AS size FROM customer")
def size(spark, sf_dir):
    return graph(spark, sf_dir, "customer.c_name", "customer.c_mktsegment", "customer.c_nationkey").size()


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey % 3 = 0")
def contains(spark, sf_dir):
    half = lift_table(read(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), "customer", columns=["c_name"])
    wanted = lift(spark, sf_dir, "customer.c_name")
    return Graph(half).contains(wanted).select(key("s").alias("c"))


def region_graphs(spark, sf_dir) -> DataFrame:
    """Customers' segments, each in the graph of its region."""
    d = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lift_table(d, "customer", columns=["c_mktsegment"], graph=T.iri(F.concat(F.lit("urn:g:"), F.col("r_name"))).column())


REGIONS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT DISTINCT 'urn:g:' || r_name AS g FROM {REGIONS}")
def contexts(spark, sf_dir):
    return Graph(region_graphs(spark, sf_dir)).contexts()


# patterns and joins ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS c, c_name AS name, c_mktsegment AS seg, round(c_acctbal, 2) AS bal FROM customer")
def bgp_star(spark, sf_dir):
    m = graph(spark, sf_dir, "customer.c_name", "customer.c_mktsegment", "customer.c_acctbal").bgp((c, p("customer.c_name"), n), (c, p("customer.c_mktsegment"), s), (c, p("customer.c_acctbal"), v))
    return m.df.select(key("c").alias("c"), lex("n").alias("name"), lex("s").alias("seg"), num("v").alias("bal"))


@query("SELECT n_name AS name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def bgp_path2(spark, sf_dir):
    m = graph(spark, sf_dir, "orders.o_custkey", "customer.c_nationkey", "nation.n_name").bgp((o, p("orders.o_custkey"), c), (c, p("customer.c_nationkey"), n), (n, p("nation.n_name"), v))
    return m.group("v", orders=A.count()).df.select(lex("v").alias("name"), whole("orders").alias("orders"))


@query(f"SELECT x FROM {G1} WHERE x = y")
def bgp_repeated_var(spark, sf_dir):
    return Graph(edges(edge_table(spark, sf_dir)), merge=False).bgp((x, E, x)).df.select(F.regexp_replace(lex("x"), "^.*/", "").cast("bigint").alias("x"))


@query("SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1)")
def bgp_all_const(spark, sf_dir):
    m = graph(spark, sf_dir, "nation.n_name", "customer.c_custkey").bgp((n, p("nation.n_name"), v), (I("urn:t:customer/1"), p("customer.c_custkey"), L(1)))
    return m.df.select(lex("v").alias("name"))


@query("SELECT c_custkey AS c, 3::BIGINT AS n, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 3")
def preset_bindings(spark, sf_dir):
    m = graph(spark, sf_dir, "customer.c_nationkey", "nation.n_name").bgp((c, p("customer.c_nationkey"), n), (n, p("nation.n_name"), v), given={"n": I("urn:t:nation/3")})
    return m.df.select(key("c").alias("c"), key("n").alias("n"), lex("v").alias("name"))


TRIANGLES = f"SELECT count(*) AS n FROM {G1} a JOIN {G1} b ON a.y = b.x JOIN {G1} c ON b.y = c.x AND c.y = a.x"


@query(TRIANGLES)
def bgp_triangle(spark, sf_dir):
    return P.triangles(edge_table(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(TRIANGLES)
def bgp_triangle_joins(spark, sf_dir):
    """The same by joins of three patterns."""
    return Graph(edges(edge_table(spark, sf_dir)), merge=False).bgp((x, E, y), (y, E, z), (z, E, x), closing="shuffle_hash").df.agg(F.count("*").alias("n"))


#: An order's customer, and back to one order in four of each customer's, so that cycles of four are many and grow with the orders.
G5 = "(SELECT o_orderkey * 2 AS x, o_custkey * 2 + 1 AS y FROM orders UNION ALL SELECT o_custkey * 2 + 1, o_orderkey * 2 FROM orders WHERE o_orderpriority = '1-URGENT')"


def both_ways(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "orders")
    order, customer = F.col("o_orderkey") * 2, F.col("o_custkey") * 2 + 1
    return d.select(order.alias("x"), customer.alias("y")).union(d.where("o_orderpriority = '1-URGENT'").select(customer, order))


@query(f"WITH e AS (SELECT * FROM {G5}) SELECT count(*) AS n FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x JOIN e d ON c.y = d.x AND d.y = a.x")
def bgp_4cycle(spark, sf_dir):
    return Graph(edges(both_ways(spark, sf_dir)), merge=False).bgp((w, E, x), (x, E, y), (y, E, z), (z, E, w), closing="shuffle_hash").df.agg(F.count("*").alias("n"))


@query(f"SELECT x FROM {G4} WHERE x = y")
def bgp_repeated_var_all(spark, sf_dir):
    return Graph(edges(order_chains(spark, sf_dir, ring=True)), merge=False).bgp((x, E, x)).df.select(_vertex("x"))


TRIANGLES_ALL = f"WITH e AS (SELECT * FROM {G4}) SELECT count(*) AS n FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x AND c.y = a.x"


@query(TRIANGLES_ALL)
def bgp_triangle_all(spark, sf_dir):
    return P.triangles(order_chains(spark, sf_dir, ring=True)).agg(F.count("*").alias("n"))


@query(TRIANGLES_ALL)
def bgp_triangle_joins_all(spark, sf_dir):
    return Graph(edges(order_chains(spark, sf_dir, ring=True)), merge=False).bgp((x, E, y), (y, E, z), (z, E, x), closing="shuffle_hash").df.agg(F.count("*").alias("n"))


@query(f"WITH e AS (SELECT * FROM {G4}) SELECT count(*) AS n FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x JOIN e d ON c.y = d.x AND d.y = a.x")
def bgp_4cycle_all(spark, sf_dir):
    return Graph(edges(order_chains(spark, sf_dir, ring=True)), merge=False).bgp((w, E, x), (x, E, y), (y, E, z), (z, E, w), closing="shuffle_hash").df.agg(F.count("*").alias("n"))


Q5 = ("lineitem.l_orderkey", "lineitem.l_suppkey", "lineitem.l_extendedprice", "lineitem.l_discount", "orders.o_custkey", "customer.c_nationkey", "supplier.s_nationkey", "nation.n_name")


@query(
    "SELECT n_name AS nname, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey GROUP BY n_name"
)
def bgp_q5(spark, sf_dir):
    """Local suppliers' revenue: a pattern whose variables form a cycle."""
    a, b = Var("ext"), Var("disc")
    m = graph(spark, sf_dir, *Q5).bgp(
        (l, p("lineitem.l_suppkey"), s), (s, p("supplier.s_nationkey"), n), (l, p("lineitem.l_orderkey"), o), (o, p("orders.o_custkey"), c),
        (c, p("customer.c_nationkey"), n), (n, p("nation.n_name"), v), (l, p("lineitem.l_extendedprice"), a), (l, p("lineitem.l_discount"), b),
    )
    m = m.numbers("ext", "disc")
    return m.group("v", revenue=A.sum_(T.multiply(T.numbered("ext"), T.subtract(L(1), T.numbered("disc"))))).df.select(lex("v").alias("nname"), num("revenue").alias("revenue"))


def _cust(spark, sf_dir):
    return graph(spark, sf_dir, "customer.c_mktsegment", "customer.c_nationkey", "customer.c_acctbal", "orders.o_custkey", "orders.o_orderstatus", "orders.o_totalprice", "nation.n_name", "supplier.s_nationkey")


@query("SELECT c_custkey AS c, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def optional(spark, sf_dir):
    q = _cust(spark, sf_dir)
    m = q.bgp((c, p("customer.c_mktsegment"), s)).optional(q.bgp((o, p("orders.o_custkey"), c), (o, p("orders.o_orderstatus"), L("P"))))
    return m.df.select(key("c").alias("c"), F.coalesce(key("o"), F.lit(-1)).alias("o"))


@query("SELECT c_custkey AS c, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100 * c_acctbal")
def optional_filter(spark, sf_dir):
    q = _cust(spark, sf_dir)
    other = q.bgp((o, p("orders.o_custkey"), c), (o, p("orders.o_totalprice"), w))
    m = q.bgp((c, p("customer.c_acctbal"), v)).numbers("v").optional(other.numbers("w"), T.gt(T.numbered("w"), T.multiply(L(100), T.numbered("v"))))
    return m.df.select(key("c").alias("c"), F.coalesce(key("o"), F.lit(-1)).alias("o"))


@query("SELECT s_suppkey AS s, coalesce(n_nationkey, -1)::BIGINT AS n, n2::BIGINT AS m FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 JOIN (SELECT n_nationkey AS n2 FROM nation WHERE n_nationkey < 4) ON n_nationkey = n2 OR n_nationkey IS NULL")
def optional_nullable_join(spark, sf_dir):
    q = graph(spark, sf_dir, "supplier.s_nationkey", "nation.n_name")
    even = q.bgp((n, p("nation.n_name"), v)).filter(key("n") % 2 == 0).project("n").rename(k="n")
    left = q.bgp((s, p("supplier.s_nationkey"), n)).optional(even, F.col("n")["id"] == F.col("k")["id"]).project("s", "k")
    few = q.bgp((k, p("nation.n_name"), v)).filter(key("k") < 4).project("k")
    m = left.bind("had", F.col("k")).join(few)
    return m.df.select(key("s").alias("s"), F.coalesce(key("had"), F.lit(-1)).alias("n"), key("k").alias("m"))


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def minus(spark, sf_dir):
    q = _cust(spark, sf_dir)
    return q.bgp((c, p("customer.c_mktsegment"), s)).minus(q.bgp((o, p("orders.o_custkey"), c))).df.select(key("c").alias("c"))


@query("SELECT n_nationkey::BIGINT AS n FROM nation")
def minus_disjoint(spark, sf_dir):
    """Without a shared variable nothing goes."""
    q = _cust(spark, sf_dir)
    return q.bgp((n, p("nation.n_name"), v)).minus(q.bgp((o, p("orders.o_custkey"), c))).df.select(key("n").alias("n"))


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists(spark, sf_dir):
    q = _cust(spark, sf_dir)
    return q.bgp((c, p("customer.c_mktsegment"), s)).exists(q.bgp((o, p("orders.o_custkey"), c), (o, p("orders.o_orderstatus"), L("P")))).df.select(key("c").alias("c"))


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark, sf_dir):
    q = _cust(spark, sf_dir)
    return q.bgp((c, p("customer.c_mktsegment"), s)).exists(q.bgp((o, p("orders.o_custkey"), c), (o, p("orders.o_orderstatus"), L("P"))), negated=True).df.select(key("c").alias("c"))


@query("SELECT c_custkey AS c, -1::BIGINT AS s FROM customer UNION ALL SELECT -1, s_suppkey FROM supplier")
def union(spark, sf_dir):
    q = _cust(spark, sf_dir)
    m = q.bgp((c, p("customer.c_nationkey"), n)).project("c").union(q.bgp((s, p("supplier.s_nationkey"), n)).project("s"))
    return m.df.select(F.coalesce(key("c"), F.lit(-1)).alias("c"), F.coalesce(key("s"), F.lit(-1)).alias("s"))


@query("SELECT c_custkey AS c, c_mktsegment AS seg, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS code FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def values_join(spark, sf_dir):
    table = values(spark, ["s", "k"], [[L("BUILDING"), L(1)], [L("MACHINERY"), L(2)]])
    m = _cust(spark, sf_dir).bgp((c, p("customer.c_mktsegment"), s)).join(table)
    return m.df.select(key("c").alias("c"), lex("s").alias("seg"), lex("k").cast("int").alias("code"))


@query("SELECT o_orderkey AS o, round(o_totalprice * 2, 2) AS dbl FROM orders WHERE o_totalprice * 2 > 500000")
def bind(spark, sf_dir):
    m = _cust(spark, sf_dir).bgp((o, p("orders.o_totalprice"), v)).numbers("v")
    m = m.filter(T.gt(T.multiply(T.numbered("v"), L(2)), L(500000))).bind("d", T.multiply(T.numbered("v"), L(2)))
    return m.df.select(key("o").alias("o"), num("d").alias("dbl"))


@query("SELECT c_custkey AS c, c_mktsegment AS seg, k AS orders FROM customer JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey HAVING count(*) > 12) ON o_custkey = c_custkey")
def subselect(spark, sf_dir):
    q = _cust(spark, sf_dir)
    inner = q.bgp((o, p("orders.o_custkey"), c)).group("c", k=A.count()).filter(T.gt(F.col("k"), L(12)))
    m = q.bgp((c, p("customer.c_mktsegment"), s)).join(inner)
    return m.df.select(key("c").alias("c"), lex("s").alias("seg"), whole("k").alias("orders"))


def _below(spark, sf_dir) -> DataFrame:
    """For each nation, how many pairs of a customer and a supplier of a larger balance: ``x, n``.  NaN is less than nothing."""
    q = graph(spark, sf_dir, "customer.c_acctbal", "customer.c_nationkey", "supplier.s_acctbal", "supplier.s_nationkey")
    one = q.bgp((c, p("customer.c_acctbal"), v), (c, p("customer.c_nationkey"), x)).df.select("x", "v", F.lit(1).alias("low"), F.lit(0).alias("high"))
    two = q.bgp((s, p("supplier.s_acctbal"), v), (s, p("supplier.s_nationkey"), x)).df.select("x", "v", F.lit(0).alias("low"), F.lit(1).alias("high"))
    rows = one.unionByName(two).select(lex("x").alias("x"), lex("v").cast("double").alias("v"), "low", "high").where("not isnan(v)")
    return A.count_below(rows)


@query("SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY ALL")
def theta_join(spark, sf_dir):
    """Customers and their nation's suppliers of a larger balance: equal on one variable, compared on another.

    Only the number of pairs is asked for, so they are counted in sorted order and not made: they grow with the square of a nation's rows.
    """
    nation = F.substring_index("x", "/", -1).cast("int")
    return _below(spark, sf_dir).select(nation.alias("a"), nation.alias("b"), "n")


@query("SELECT c_nationkey AS a, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1")
def theta_join_all(spark, sf_dir):
    return _below(spark, sf_dir).select(F.substring_index("x", "/", -1).cast("int").alias("a"), "n")


# graphs ------------------------------------------------------------------------------------------------------------

ASIA, EUROPE = I("urn:g:ASIA"), I("urn:g:EUROPE")


@query(f"SELECT c_custkey AS c FROM {REGIONS} WHERE r_name = 'ASIA'")
def graph_const(spark, sf_dir):
    return Graph(region_graphs(spark, sf_dir)).bgp((c, p("customer.c_mktsegment"), v), graph=ASIA).df.select(key("c").alias("c"))


@query(f"SELECT 'urn:g:' || r_name AS g, c_mktsegment AS seg, count(*) AS n FROM {REGIONS} GROUP BY ALL")
def graph_var(spark, sf_dir):
    m = Graph(region_graphs(spark, sf_dir)).bgp((c, p("customer.c_mktsegment"), v), graph=g).group("g", "v", n=A.count())
    return m.df.select(lex("g").alias("g"), lex("v").alias("seg"), whole("n").alias("n"))


def twice(spark, sf_dir) -> DataFrame:
    """Every third customer's triple is in the graph EUROPE too."""
    q = region_graphs(spark, sf_dir)
    return q.unionByName(q.where(key("s") % 3 == 0).withColumn("g", EUROPE.column())).transform(lambda d: d.dropDuplicates(["s", "p", "o", "g"]))


@query(f"SELECT c_custkey AS c FROM {REGIONS} WHERE r_name IN ('ASIA', 'EUROPE') OR c_custkey % 3 = 0")
def from_merge(spark, sf_dir):
    return Graph(twice(spark, sf_dir), default=[ASIA, EUROPE]).bgp((c, p("customer.c_mktsegment"), v)).df.select(key("c").alias("c"))


@query(f"SELECT 'urn:g:' || r_name AS g, count(*) AS n FROM {REGIONS} WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY r_name")
def from_named(spark, sf_dir):
    m = Graph(region_graphs(spark, sf_dir), named=[ASIA, EUROPE]).bgp((c, p("customer.c_mktsegment"), v), graph=g).group("g", n=A.count())
    return m.df.select(lex("g").alias("g"), whole("n").alias("n"))


@query("SELECT count(*) AS n FROM customer")
def default_union(spark, sf_dir):
    return Graph(twice(spark, sf_dir)).bgp((c, p("customer.c_mktsegment"), v)).df.agg(F.count("*").alias("n"))


# modifiers and forms -----------------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
def distinct(spark, sf_dir):
    m = graph(spark, sf_dir, "part.p_brand", "part.p_size").bgp((x, p("part.p_brand"), v), (x, p("part.p_size"), w)).project("v", "w").distinct()
    return m.df.select(lex("v").alias("brand"), lex("w").cast("int").alias("size"))


@query("SELECT o_orderkey AS o, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_limit(spark, sf_dir):
    m = _cust(spark, sf_dir).bgp((o, p("orders.o_totalprice"), v)).bind("k", T.integer(key("o"))).order_by(("v", "desc"), "k").slice(20)
    return m.df.select(key("o").alias("o"), lex("v").cast("double").alias("price"))


@query("SELECT p_partkey AS x, p_size AS size FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 15")
def offset(spark, sf_dir):
    m = graph(spark, sf_dir, "part.p_size").bgp((x, p("part.p_size"), v)).bind("k", T.integer(key("x"))).order_by("v", "k").slice(10, 15)
    return m.df.select(key("x").alias("x"), lex("v").cast("int").alias("size"))


@query("SELECT count(*) > 0 AS ask FROM orders WHERE o_orderstatus = 'F'")
def ask(spark, sf_dir):
    return _cust(spark, sf_dir).bgp((o, p("orders.o_orderstatus"), L("F"))).ask()


@query("SELECT DISTINCT 'urn:t:nation/' || c_nationkey AS s, c_mktsegment AS o FROM customer")
def construct(spark, sf_dir):
    m = _cust(spark, sf_dir).bgp((c, p("customer.c_nationkey"), n), (c, p("customer.c_mktsegment"), v))
    return m.construct((n, I("urn:sells"), v)).select(lex("s").alias("s"), lex("o").alias("o"))


@query("SELECT 'n_name' AS p, n_name AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'n_regionkey', 'urn:t:region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
def describe(spark, sf_dir):
    q = graph(spark, sf_dir, "nation.n_name", "nation.n_regionkey", "region.r_name")
    return q.describe(values(spark, ["x"], [[I("urn:t:nation/3")]]), "x").select(F.substring_index(lex("p"), "#", -1).alias("p"), lex("o").alias("o"))


# aggregates --------------------------------------------------------------------------------------------------------


def _items(spark, sf_dir):
    return graph(spark, sf_dir, "orders.o_orderpriority", "orders.o_totalprice", "orders.o_custkey")


def _orders(spark, sf_dir) -> Solutions:
    return _items(spark, sf_dir).bgp((o, p("orders.o_orderpriority"), v), (o, p("orders.o_totalprice"), w), (o, p("orders.o_custkey"), c))


@query("SELECT o_orderpriority AS prio, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def count(spark, sf_dir):
    return _orders(spark, sf_dir).group("v", n=A.count(), d=A.count("c", distinct=True)).df.select(lex("v").alias("prio"), whole("n").alias("n"), whole("d").alias("customers"))


@query("SELECT o_orderpriority AS prio, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def sum_avg(spark, sf_dir):
    return _orders(spark, sf_dir).group("v", t=A.sum_("w"), m=A.avg("w")).df.select(lex("v").alias("prio"), num("t").alias("total"), num("m").alias("mean"))


@query("SELECT o_orderpriority AS prio, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def min_max(spark, sf_dir):
    return _orders(spark, sf_dir).group("v", a=A.min_("w"), b=A.max_("w")).df.select(lex("v").alias("prio"), lex("a").cast("double").alias("low"), lex("b").cast("double").alias("high"))


@query("SELECT p_brand AS brand, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS kinds, min(p_size) AS some FROM part GROUP BY 1")
def group_concat(spark, sf_dir):
    m = graph(spark, sf_dir, "part.p_brand", "part.p_size").bgp((x, p("part.p_brand"), v), (x, p("part.p_size"), w))
    return m.group("v", a=A.group_concat("w", ","), b=A.group_concat("w", ",", distinct=True), k=A.sample("w")).df.select(lex("v").alias("brand"), lex("a").alias("sizes"), lex("b").alias("kinds"), lex("k").cast("int").alias("some"))


@query("SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def having(spark, sf_dir):
    return _orders(spark, sf_dir).group("c", n=A.count()).filter(T.gt(F.col("n"), L(15))).df.select(key("c").alias("c"), whole("n").alias("n"))


@query("SELECT 0::BIGINT AS n, 0::BIGINT AS total, NULL::VARCHAR AS low")
def empty_group(spark, sf_dir):
    m = _items(spark, sf_dir).bgp((o, p("orders.o_orderpriority"), L("none")), (o, p("orders.o_totalprice"), w)).group(n=A.count(), t=A.sum_("w"), a=A.min_("w"))
    return m.df.select(whole("n").alias("n"), whole("t").alias("total"), lex("a").alias("low"))


@query("SELECT o_orderpriority AS prio, (o_custkey % 3)::BIGINT AS third, count(*) AS n FROM orders GROUP BY ALL")
def group_by_expression(spark, sf_dir):
    m = _orders(spark, sf_dir).bind("k", T.integer(key("c") % 3)).group("v", "k", n=A.count())
    return m.df.select(lex("v").alias("prio"), whole("k").alias("third"), whole("n").alias("n"))


@query("SELECT term, count(*) AS n FROM (SELECT 'urn:t:nation/' || n_nationkey AS term FROM nation UNION ALL SELECT 'urn:t:nation#n_regionkey' FROM nation UNION ALL SELECT 'urn:t:region/' || n_regionkey FROM nation) GROUP BY term")
def term_stats(spark, sf_dir):
    return A.term_stats(lift(spark, sf_dir, "nation.n_regionkey")).select("term", "n")


@query("SELECT 'urn:t:customer#c_nationkey' AS predicate, count(*) AS triples, count(DISTINCT c_custkey) AS subjects, count(DISTINCT c_nationkey) AS objects FROM customer UNION ALL SELECT 'urn:t:customer#c_mktsegment', count(*), count(DISTINCT c_custkey), count(DISTINCT c_mktsegment) FROM customer")
def void_stats(spark, sf_dir):
    return A.predicate_stats(lift(spark, sf_dir, "customer.c_nationkey", "customer.c_mktsegment"))


# functions ---------------------------------------------------------------------------------------------------------


def _parts(spark, sf_dir) -> DataFrame:
    m = graph(spark, sf_dir, "part.p_name", "part.p_size", "part.p_retailprice").bgp((x, p("part.p_name"), n), (x, p("part.p_size"), v), (x, p("part.p_retailprice"), w))
    return m.df


N, V, W_ = (Ref(i) for i in "nvw")


@query(
    "SELECT p_partkey AS x, length(p_name)::INT AS len, upper(p_name) AS up, lower(p_name) AS low, substr(p_name, 2, 3) AS sub, contains(p_name, 'e') AS has, starts_with(p_name, 'P') AS st, ends_with(p_name, '1') AS en, "
    "CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS bef, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS aft, p_name || '-' || p_name AS cat, "
    "regexp_matches(p_name, '(?i)^p.*[0-9]$') AS re, regexp_replace(p_name, '[aeiou]', '*', 'g') AS rep, replace(p_name, ' ', '%20') AS enc FROM part"
)
def fn_string(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        key("x").alias("x"), T.strlen(N).lex.cast("int").alias("len"), T.ucase(N).lex.alias("up"), T.lcase(N).lex.alias("low"), T.substr(N, 2, 3).lex.alias("sub"), T.contains(N, L("e")).alias("has"),
        T.strstarts(N, L("P")).alias("st"), T.strends(N, L("1")).alias("en"), T.strbefore(N, L(" ")).lex.alias("bef"), T.strafter(N, L(" ")).lex.alias("aft"), T.concat(N, L("-"), N).lex.alias("cat"),
        T.regex(N, "^p.*[0-9]$", "i").alias("re"), T.replace(N, "[aeiou]", "*").lex.alias("rep"), F.replace(T.encode_for_uri(N).lex, F.lit("%23"), F.lit("#")).alias("enc"),
    )


@query("SELECT p_partkey AS x, abs(p_size - 25)::BIGINT AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(p_retailprice + 0.5) AS r, round(p_size / 4.0, 4)::DOUBLE AS q, round(p_retailprice / p_size, 4) AS d, round(-p_retailprice + p_size * 2, 4) AS m FROM part")
def fn_numeric(spark, sf_dir):
    f = lambda t, d=4: F.round(T.dbl(t), d)
    return _parts(spark, sf_dir).select(
        key("x").alias("x"), T.abs_(T.subtract(V, L(25))).lex.cast("bigint").alias("a"), T.ceil(W_).wide.alias("c"), T.floor(W_).wide.alias("f"), T.round_(W_).wide.alias("r"),
        f(T.divide(V, L(4))).alias("q"), f(T.divide(W_, V)).alias("d"), f(T.add(T.negate(W_), T.multiply(V, L(2)))).alias("m"),
    )


@query("SELECT event_id AS e, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, '' AS tz, ts < TIMESTAMP '2024-01-15 00:00:00' AS early FROM events")
def fn_date(spark, sf_dir):
    m = graph(spark, sf_dir, "events.ts").bgp((x, p("events.ts"), v)).df
    i = lambda t: t.lex.cast("bigint")
    return m.select(key("x").alias("e"), i(T.year(V)).alias("y"), i(T.month(V)).alias("mo"), i(T.day(V)).alias("d"), i(T.hours(V)).alias("h"), i(T.minutes(V)).alias("mi"), T.seconds(V).lex.cast("double").cast("bigint").alias("s"), T.tz(V).alias("tz"), T.lt(V, L("2024-01-15T00:00:00", T.DATETIME)).alias("early"))


@query("SELECT p_partkey AS x, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s2 FROM part")
def fn_hash(spark, sf_dir):
    return _parts(spark, sf_dir).select(key("x").alias("x"), T.md5(N).lex.alias("m"), T.sha1(N).lex.alias("s1"), T.sha2(N, 256).lex.alias("s2"))


@query("SELECT p_partkey AS x, p_size::VARCHAR AS s, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS d, p_size <> 0 AS b, NULL::BIGINT AS bad, 12::BIGINT AS t FROM part")
def fn_cast(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        key("x").alias("x"), T.cast(V, T.STRING).lex.alias("s"), T.cast(W_, T.INTEGER).lex.cast("bigint").alias("i"), T.cast(V, T.DOUBLE).lex.cast("double").alias("d"), T.boolean(T.cast(V, T.BOOLEAN)).alias("b"),
        T.cast(N, T.INTEGER).lex.cast("bigint").alias("bad"), T.cast(L("12"), T.INTEGER).lex.cast("bigint").alias("t"),
    )


@query("SELECT p_partkey AS x, p_size > 25 AND p_retailprice < 1500 AS a, p_size > 25 OR p_retailprice < 1500 AS o, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS i, p_size IN (1, 2, 3) AS isin, p_size NOT IN (1, 2, 3) AS notin, true AS err_or, NULL::BOOLEAN AS err FROM part")
def fn_logic(spark, sf_dir):
    big, cheap, err = T.gt(V, L(25)), T.lt(W_, L(1500)), T.lt(V, N)
    return _parts(spark, sf_dir).select(
        key("x").alias("x"), (big & cheap).alias("a"), (big | cheap).alias("o"), T.if_(big, L("big"), L("small")).lex.alias("i"), T.is_in(V, L(1), L(2), L(3)).alias("isin"), (~T.is_in(V, L(1), L(2), L(3))).alias("notin"), (err | F.lit(True)).alias("err_or"), err.alias("err"),
    )


@query("SELECT p_partkey AS x, true AS iri, false AS blank, true AS lit, true AS num, 'urn:t:part/' || p_partkey AS s, '' AS lang, 'integer' AS dt, true AS value_eq, false AS same, coalesce(NULL, p_name) AS co, 'fr' AS tag, true AS lm, NULL::BOOLEAN AS unlike FROM part")
def fn_term(spark, sf_dir):
    padded = T.literal(F.concat(F.lit("0"), lex("v")), T.INTEGER)
    tagged = T.strlang(N, L("FR"))
    return _parts(spark, sf_dir).select(
        key("x").alias("x"), T.is_iri(F.col("x")).alias("iri"), T.is_blank(F.col("x")).alias("blank"), T.is_literal(N).alias("lit"), T.is_numeric(V).alias("num"), T.str_(F.col("x")).lex.alias("s"), T.lang(N).lex.alias("lang"),
        F.substring_index(T.datatype(V).lex, "#", -1).alias("dt"), T.eq(V, padded).alias("value_eq"), T.same_term(V, padded).alias("same"), T.coalesce(T.cast(N, T.INTEGER), N).lex.alias("co"), T.lang(tagged).lex.alias("tag"),
        T.lang_matches(T.lang(tagged), "fr").alias("lm"), T.eq(T.strdt(N, I("urn:d1")), T.strdt(N, I("urn:d2"))).alias("unlike"),
    )


# paths -------------------------------------------------------------------------------------------------------------


def node(name: str) -> Column:
    return F.substring_index(lex(name), "/", -1).cast("bigint").alias(name)


def _vertex(name: str) -> Column:
    return F.regexp_extract(lex(name), r"(\d+)$", 1).cast("bigint").alias(name)


def _sparse(spark, sf_dir) -> Graph:
    return Graph(edges(sparse_table(spark, sf_dir)), merge=False)


STEP = P.Link(E)
CLOSURE = f"WITH RECURSIVE e AS (SELECT * FROM {G2}), t AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x)"
NODES = f"(SELECT x AS v FROM {G2} UNION SELECT y FROM {G2})"


@query("SELECT c_custkey AS x, r_name AS y FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_seq(spark, sf_dir):
    q = graph(spark, sf_dir, "customer.c_nationkey", "nation.n_regionkey", "region.r_name")
    m = P.match(q, x, P.Link(p("customer.c_nationkey")) / P.Link(p("nation.n_regionkey")) / P.Link(p("region.r_name")), y)
    return m.df.select(node("x"), lex("y").alias("y"))


@query("SELECT n_regionkey::BIGINT AS x, n_nationkey::BIGINT AS y FROM nation")
def path_inv(spark, sf_dir):
    return P.match(graph(spark, sf_dir, "nation.n_regionkey"), x, ~P.Link(p("nation.n_regionkey")), y).df.select(node("x"), node("y"))


@query("SELECT c_custkey AS x, c_nationkey::BIGINT AS y FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def path_alt(spark, sf_dir):
    m = P.match(graph(spark, sf_dir, "customer.c_nationkey", "supplier.s_nationkey"), x, P.Link(p("customer.c_nationkey")) | P.Link(p("supplier.s_nationkey")), y)
    return m.df.select(node("x"), node("y"))


@query(f"SELECT x, y FROM {G2} UNION SELECT v, v FROM {NODES}")
def path_opt(spark, sf_dir):
    return P.match(_sparse(spark, sf_dir), x, P.Optional_(STEP), y).df.select(_vertex("x"), _vertex("y"))


@query(f"{CLOSURE} SELECT x, y FROM t")
def path_plus(spark, sf_dir):
    return P.match(_sparse(spark, sf_dir), x, P.Plus(STEP), y).df.select(_vertex("x"), _vertex("y"))


@query(f"{CLOSURE} SELECT x, y FROM t UNION SELECT v, v FROM {NODES}")
def path_star(spark, sf_dir):
    return P.match(_sparse(spark, sf_dir), x, P.Star(STEP), y).df.select(_vertex("x"), _vertex("y"))


@query(f"SELECT v AS x FROM {NODES}")
def path_star_same(spark, sf_dir):
    """One variable at both ends: every vertex, once."""
    return P.match(_sparse(spark, sf_dir), x, P.Star(STEP), x).df.select(_vertex("x"))


@query(f"{CLOSURE} SELECT y FROM (SELECT x, y FROM t UNION SELECT v, v FROM {NODES})")
def path_star_ends(spark, sf_dir):
    """Ends alone, once for each start that leads to them."""
    return P.match(_sparse(spark, sf_dir), x, P.Star(STEP), y).project("y").df.select(_vertex("y"))


@query(f"{CLOSURE} SELECT DISTINCT y FROM (SELECT y FROM t WHERE x = 28 UNION SELECT 28)")
def path_star_from_constant(spark, sf_dir):
    return P.match(_sparse(spark, sf_dir), subject_const("v", 28), P.Star(STEP), y).df.select(_vertex("y"))


def subject_const(table: str, number: int) -> T.Const:
    return I(f"urn:t:{table}/{number}")


@query("SELECT n_nationkey::BIGINT AS x, n_name AS y FROM nation")
def path_neg(spark, sf_dir):
    m = P.match(graph(spark, sf_dir, "nation.n_name", "nation.n_regionkey"), x, P.Negated((p("nation.n_regionkey"),)), y)
    return m.df.select(node("x"), lex("y").alias("y"))


@query(
    f"WITH RECURSIVE e AS (SELECT x, y, (x % 2)::BIGINT AS g FROM {G2}), t AS (SELECT g, x, y FROM e UNION SELECT t.g, t.x, e.y FROM t JOIN e ON t.y = e.x AND t.g = e.g), "
    "n AS (SELECT g, x AS v FROM e UNION SELECT g, y FROM e) SELECT g, x, y FROM t UNION SELECT g, v, v FROM n"
)
def path_zero_graph(spark, sf_dir):
    """Zero or more steps inside each named graph."""
    q = edges(sparse_table(spark, sf_dir)).withColumn("g", T.iri(F.concat(F.lit("urn:g/"), (F.regexp_extract(lex("s"), r"(\d+)$", 1).cast("bigint") % 2).cast("string"))).column())
    return P.match(Graph(q, merge=False), x, P.Star(STEP), y, graph=g).df.select(_vertex("g"), _vertex("x"), _vertex("y"))


def _chains(spark, sf_dir) -> Graph:
    return Graph(edges(order_chains(spark, sf_dir)), merge=False)


CLOSURE_ALL = f"WITH RECURSIVE e AS (SELECT * FROM {G3}), t AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x)"
NODES_ALL = f"(SELECT x AS v FROM {G3} UNION SELECT y FROM {G3})"


@query(f"SELECT x, y FROM {G3} UNION SELECT v, v FROM {NODES_ALL}")
def path_opt_all(spark, sf_dir):
    return P.match(_chains(spark, sf_dir), x, P.Optional_(STEP), y).df.select(_vertex("x"), _vertex("y"))


@query(f"{CLOSURE_ALL} SELECT x, y FROM t")
def path_plus_all(spark, sf_dir):
    return P.match(_chains(spark, sf_dir), x, P.Plus(STEP), y).df.select(_vertex("x"), _vertex("y"))


@query(f"{CLOSURE_ALL} SELECT x, y FROM t UNION SELECT v, v FROM {NODES_ALL}")
def path_star_all(spark, sf_dir):
    return P.match(_chains(spark, sf_dir), x, P.Star(STEP), y).df.select(_vertex("x"), _vertex("y"))


@query(f"{CLOSURE_ALL} SELECT DISTINCT y FROM (SELECT y FROM t WHERE x = 7 UNION SELECT 7)")
def path_star_from_constant_all(spark, sf_dir):
    return P.match(_chains(spark, sf_dir), subject_const("v", 7), P.Star(STEP), y).df.select(_vertex("y"))


@query(
    f"WITH RECURSIVE e AS (SELECT x, y, (x % 2)::BIGINT AS g FROM {G3}), t AS (SELECT g, x, y FROM e UNION SELECT t.g, t.x, e.y FROM t JOIN e ON t.y = e.x AND t.g = e.g), "
    "n AS (SELECT g, x AS v FROM e UNION SELECT g, y FROM e) SELECT g, x, y FROM t UNION SELECT g, v, v FROM n"
)
def path_zero_graph_all(spark, sf_dir):
    q = edges(order_chains(spark, sf_dir)).withColumn("g", T.iri(F.concat(F.lit("urn:g/"), (_vertex("s") % 2).cast("string"))).column())
    return P.match(Graph(q, merge=False), x, P.Star(STEP), y, graph=g).df.select(_vertex("g"), _vertex("x"), _vertex("y"))


# updates -----------------------------------------------------------------------------------------------------------


def status(spark, sf_dir, where: str) -> DataFrame:
    return lift_table(read(spark, sf_dir, "orders").where(where), "orders", columns=["o_orderstatus"])


def pairs_of(quads: DataFrame) -> DataFrame:
    return quads.select(key("s").alias("o"), lex("o").alias("status"))


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'O')")
def insert_data(spark, sf_dir):
    base = status(spark, sf_dir, "o_orderstatus = 'F'")
    return pairs_of(update.apply(base, update.insert_data(base, status(spark, sf_dir, "o_orderstatus = 'O' or o_orderkey % 7 = 0 and o_orderstatus = 'F'"))))


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0")
def delete_data(spark, sf_dir):
    base = status(spark, sf_dir, "true")
    return pairs_of(update.apply(base, update.delete_data(base, status(spark, sf_dir, "o_orderkey % 3 = 0"))))


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
def delete_where(spark, sf_dir):
    base, st = status(spark, sf_dir, "true"), p("orders.o_orderstatus")
    found = Graph(base, merge=False).bgp((o, st, L("F")))
    return pairs_of(update.apply(base, update.modify(base, found, delete=[(o, st, L("F"))])))


@query("SELECT o_orderkey AS o, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def modify(spark, sf_dir):
    base, st = status(spark, sf_dir, "true"), p("orders.o_orderstatus")
    found = Graph(base, merge=False).bgp((o, st, L("F")))
    return pairs_of(update.apply(base, update.modify(base, found, delete=[(o, st, L("F"))], insert=[(o, st, L("done"))])))


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P'")
def remove_pattern(spark, sf_dir):
    base = status(spark, sf_dir, "true")
    gone = update.remove(base, o=L("F")).unionByName(update.remove(base, o=L("O"), graphs=[DEFAULT]))
    return pairs_of(update.apply(base, gone))


def counts_by_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy(lex("g").alias("g")).agg(F.count("*").alias("n"))


BY_REGION = f"SELECT 'urn:g:' || r_name AS g, c_custkey FROM {REGIONS}"


@query(f"SELECT g, count(*) AS n FROM ({BY_REGION}) WHERE g <> 'urn:g:ASIA' GROUP BY g")
def clear_graph(spark, sf_dir):
    q = region_graphs(spark, sf_dir)
    return counts_by_graph(update.apply(q, update.clear(q, ASIA)))


@query(f"SELECT g, count(*) AS n FROM (SELECT * FROM ({BY_REGION}) WHERE g <> 'urn:g:EUROPE' UNION ALL SELECT 'urn:g:EUROPE', c_custkey FROM ({BY_REGION}) WHERE g = 'urn:g:ASIA') GROUP BY g")
def copy_graph(spark, sf_dir):
    q = region_graphs(spark, sf_dir)
    return counts_by_graph(update.apply(q, update.copy(q, ASIA, EUROPE)))


@query(f"SELECT g, count(*) AS n FROM (SELECT * FROM ({BY_REGION}) WHERE g NOT IN ('urn:g:EUROPE', 'urn:g:ASIA') UNION ALL SELECT 'urn:g:EUROPE', c_custkey FROM ({BY_REGION}) WHERE g = 'urn:g:ASIA') GROUP BY g")
def move_graph(spark, sf_dir):
    q = region_graphs(spark, sf_dir)
    return counts_by_graph(update.apply(q, update.move(q, ASIA, EUROPE)))


@query(f"SELECT g, count(*) AS n FROM (SELECT * FROM ({BY_REGION}) UNION ALL SELECT 'urn:g:EUROPE', c_custkey FROM ({BY_REGION}) WHERE g = 'urn:g:ASIA') GROUP BY g")
def add_graph(spark, sf_dir):
    q = region_graphs(spark, sf_dir)
    return counts_by_graph(update.apply(q, update.add(q, ASIA, EUROPE)))


@query(f"SELECT g, count(*) AS n FROM (SELECT * FROM ({BY_REGION}) UNION ALL SELECT 'urn:g:EUROPE', -n_nationkey - 1 FROM nation) GROUP BY g")
def load_graph(spark, sf_dir):
    """LOAD of N-Triples lines INTO GRAPH, twice: the second changes nothing."""
    q = region_graphs(spark, sf_dir)
    data = rdf.parse_lines(rdf.to_nquads(lift(spark, sf_dir, "nation.n_name")))
    once = update.apply(q, update.load(q, data, EUROPE))
    return counts_by_graph(update.apply(once, update.load(once, data, EUROPE)))


@query(f"SELECT g, count(*) AS n FROM ({BY_REGION}) WHERE g <> 'urn:g:ASIA' OR c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY g")
def modify_using(spark, sf_dir):
    """DELETE ... USING one graph: what other graphs say isn't seen, and only that graph's quads go."""
    q, seg = region_graphs(spark, sf_dir), p("customer.c_mktsegment")
    found = update.graph_of(q, default=[ASIA], merge=False).bgp((c, seg, L("BUILDING")))
    return counts_by_graph(update.apply(q, update.modify(q, found, delete=[(c, seg, L("BUILDING"))], graph=ASIA)))


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AND o_orderkey % 5 = 0")
def tx_fold(spark, sf_dir):
    """add even; remove multiples of 3; add even ones again, and odd multiples of 15."""
    ops = [(1, "o_orderkey % 2 = 0"), (-1, "o_orderkey % 3 = 0"), (1, "o_orderkey % 6 = 0 or o_orderkey % 15 = 0")]
    log = reduce(DataFrame.unionByName, [status(spark, sf_dir, cond).select(F.lit(op).cast("tinyint").alias("op"), "s", "p", "o", "g", F.lit(i).alias("seq")) for i, (op, cond) in enumerate(ops)])
    return pairs_of(update.fold(log).where("op = 1"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 4 = 0")
def table_upsert(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    return update.upsert(t, t.where("k % 4 = 0").withColumn("seg", F.lit("new")), ["k"], deleted=t.where("k % 5 = 0"))


# history -----------------------------------------------------------------------------------------------------------

#: Commit k adds the orders with o_orderkey % 5 = k and removes those of commit k - 1 with status F.
CHAIN = [f"c{i}" for i in range(5)]


def history(spark, sf_dir) -> DataFrame:
    parts = []
    for i, name in enumerate(CHAIN):
        parts.append(status(spark, sf_dir, f"o_orderkey % 5 = {i}").select(F.lit(name).alias("commit"), F.lit(1).cast("tinyint").alias("op"), "s", "p", "o", "g"))
        if i:
            parts.append(status(spark, sf_dir, f"o_orderkey % 5 = {i - 1} and o_orderstatus = 'F'").select(F.lit(name).alias("commit"), F.lit(-1).cast("tinyint").alias("op"), "s", "p", "o", "g"))
    return reduce(DataFrame.unionByName, parts)


def at(spark, sf_dir, i: int) -> DataFrame:
    return algebra.snapshot(history(spark, sf_dir), CHAIN[: i + 1])


def _at_sql(i: int) -> str:
    return f"(SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 = {i} OR o_orderkey % 5 < {i} AND o_orderstatus <> 'F')"


@query(f"SELECT * FROM {_at_sql(2)}")
def time_travel(spark, sf_dir):
    return pairs_of(at(spark, sf_dir, 2))


@query(f"SELECT 1::TINYINT AS op, * FROM (SELECT * FROM {_at_sql(3)} EXCEPT SELECT * FROM {_at_sql(1)}) UNION ALL SELECT -1::TINYINT, * FROM (SELECT * FROM {_at_sql(1)} EXCEPT SELECT * FROM {_at_sql(3)})")
def commit_diff(spark, sf_dir):
    return algebra.difference(at(spark, sf_dir, 1), at(spark, sf_dir, 3)).select("op", key("s").alias("o"), lex("o").alias("status"))


def sides(spark, sf_dir):
    """Base: multiples of 2. Target: without multiples of 6, with those of 5. Source: without multiples of 8, with those of 7."""
    base = status(spark, sf_dir, "o_orderkey % 2 = 0")
    target = status(spark, sf_dir, "o_orderkey % 2 = 0 and o_orderkey % 6 <> 0 or o_orderkey % 5 = 0")
    source = status(spark, sf_dir, "o_orderkey % 2 = 0 and o_orderkey % 8 <> 0 or o_orderkey % 7 = 0")
    return base, target, source


TARGET, SOURCE = "(o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 OR o_orderkey % 5 = 0)", "(o_orderkey % 2 = 0 AND o_orderkey % 8 <> 0 OR o_orderkey % 7 = 0)"
MERGED = f"({TARGET} AND NOT (o_orderkey % 2 = 0 AND NOT {SOURCE}) OR {SOURCE} AND o_orderkey % 2 <> 0)"


@query(f"SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE {TARGET} OR {SOURCE}")
def merge_union(spark, sf_dir):
    _, target, source = sides(spark, sf_dir)
    return pairs_of(algebra.merge_union(target, source))


@query(f"SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE {MERGED}")
def merge_three_way(spark, sf_dir):
    return pairs_of(algebra.merge_three_way(*sides(spark, sf_dir)))


@query(f"SELECT CASE WHEN {MERGED} THEN 1 ELSE -1 END::TINYINT AS op, o_orderkey AS o FROM orders WHERE {MERGED} <> {TARGET}")
def squash(spark, sf_dir):
    return algebra.squash(*sides(spark, sf_dir)).select("op", key("s").alias("o"))


@query("SELECT o_orderkey AS o, 'c' || (o_orderkey % 5) AS commit FROM orders")
def blame(spark, sf_dir):
    return algebra.blame(history(spark, sf_dir), CHAIN).select(key("s").alias("o"), "commit")


@query("SELECT o_orderkey AS o, 'c' || (o_orderkey % 5) AS commit FROM orders WHERE o_orderkey % 5 = 4 OR o_orderstatus <> 'F'")
def provenance_first_seen(spark, sf_dir):
    return algebra.first_seen(history(spark, sf_dir), CHAIN, at(spark, sf_dir, 4)).select(key("s").alias("o"), "commit")


@query("SELECT o_orderkey AS o, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS commit FROM orders")
def provenance_merge(spark, sf_dir):
    q = status(spark, sf_dir, "true")
    one = q.where(key("s") % 2 == 0).select("*", F.lit("a").alias("commit"), F.lit(1).alias("ts"))
    return algebra.merge_provenance(one, q.select("*", F.lit("b").alias("commit"), F.lit(2).alias("ts"))).select(key("s").alias("o"), "commit")


@query("SELECT 'c' || min(o_orderkey % 5) AS first_bad FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 >= 2")
def bisect(spark, sf_dir):
    """The first commit after which an order of residue 2 or more is pending."""
    deltas = history(spark, sf_dir)

    def bad(commit: str) -> bool:
        live = algebra.snapshot(deltas, CHAIN[: CHAIN.index(commit) + 1])
        return live.where((key("s") % 5 >= 2) & (lex("o") == "P")).limit(1).count() > 0

    return spark.range(1).select(F.lit(algebra.bisect(CHAIN, bad)).alias("first_bad"))


@query("SELECT 'c' || (o_orderkey % 5) AS commit, 1::TINYINT AS op, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'c' || (o_orderkey % 5 + 1), -1::TINYINT, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 < 4 GROUP BY ALL")
def change_feed(spark, sf_dir):
    """Commits of a repository read as a stream: batches are counted as they come, and the counts are added up."""
    repo, names = _committed(spark, sf_dir)
    counts = f"{repo.root}/counts"

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy("commit", "op").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    changes.sink(changes.change_feed(spark, repo), count, f"{repo.root}/stream").awaitTermination()
    seen = spark.read.parquet(counts).groupBy("commit", "op").agg(F.sum("n").cast("bigint").alias("n"))
    return seen.join(F.broadcast(names), seen["commit"] == names["id"]).select(F.col("name").alias("commit"), "op", "n")


def _repository(spark) -> Repository:
    """An empty repository in the session's shared folder."""
    return Repository(spark, f"{shared_folder(spark)}/repository-{uuid.uuid4().hex}")


def _committed(spark, sf_dir) -> tuple[Repository, DataFrame]:
    """The history as commits of ``main``, and their names."""
    repo, names = _repository(spark), []
    log = history(spark, sf_dir)
    for name in CHAIN:
        id_ = repo.write("main", log.where(F.col("commit") == name).select("op", "s", "p", "o", "g"), message=name)
        names.append((id_, name))
    return repo, spark.createDataFrame(names, "id string, name string")


LIVE = "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 4 OR o_orderstatus <> 'F'"


@query(f"SELECT o_orderkey AS o FROM ({LIVE})")
def repository_head(spark, sf_dir):
    """Five commits, and the branch's quads at the last."""
    repo, _ = _committed(spark, sf_dir)
    return repo.head("main").select(key("s").alias("o"))


@query("SELECT 'c' || i AS message, i AS seq, least(i, 1) AS parents FROM range(5) t(i)")
def repository_log(spark, sf_dir):
    repo, _ = _committed(spark, sf_dir)
    return repo.log("main").select("message", "seq", F.size("parents").cast("bigint").alias("parents"))


def _merged(spark, sf_dir, how: str) -> Repository:
    """A base of even orders; one branch adds multiples of three, the other removes multiples of four and adds multiples of five."""
    repo = _repository(spark)
    delta = lambda op, condition: status(spark, sf_dir, condition).select(F.lit(op).cast("tinyint").alias("op"), "s", "p", "o", "g")
    repo.write("main", delta(1, "o_orderkey % 2 = 0"), message="base")
    repo.branch("side", "main")
    repo.write("main", delta(1, "o_orderkey % 2 = 1 and o_orderkey % 3 = 0"), message="ours")
    repo.write("side", delta(-1, "o_orderkey % 4 = 0").unionByName(delta(1, "o_orderkey % 2 = 1 and o_orderkey % 5 = 0")), message="theirs")
    repo.merge("main", "side", how=how)
    return repo


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 4 = 2 OR o_orderkey % 2 = 1 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)")
def repository_merge(spark, sf_dir):
    return _merged(spark, sf_dir, "three_way").head("main").select(key("s").alias("o"))


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def repository_merge_union(spark, sf_dir):
    return _merged(spark, sf_dir, "union").head("main").select(key("s").alias("o"))


@query("SELECT 'base' AS base, true AS merged, 2::BIGINT AS parents, 4::BIGINT AS commits")
def repository_merge_base(spark, sf_dir):
    repo = _merged(spark, sf_dir, "three_way")
    tip = repo.commit(repo.resolve("main"))
    base = repo.commit(repo.merge_base(tip.parents[0], "side")).message
    return spark.createDataFrame([(base, repo.is_ancestor("side", "main"), len(tip.parents), len(repo.ancestors(tip.id)))], "base string, merged boolean, parents long, commits long")


@query(f"SELECT repo, o_orderkey AS o FROM ({LIVE}), (VALUES ('clone'), ('pushed')) t(repo)")
def repository_sync(spark, sf_dir):
    """A clone's head, and that of an empty repository after a push."""
    repo, _ = _committed(spark, sf_dir)
    copy, other = clone(spark, repo, f"{repo.root}-clone"), _repository(spark)
    repo.push(other, "main")
    return reduce(DataFrame.unionByName, [r.head("main").select(F.lit(name).alias("repo"), key("s").alias("o")) for name, r in (("clone", copy), ("pushed", other))])


@query(f"SELECT o_orderkey AS o, 3::BIGINT AS gone FROM ({LIVE}) WHERE o_orderkey % 5 < 2 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 5 = 1 AND o_orderstatus = 'F'")
def repository_vacuum(spark, sf_dir):
    """After a revert to the second commit, the three later ones go, and nothing of its state does."""
    repo, _ = _committed(spark, sf_dir)
    repo.revert("main", repo.chain("main")[1])
    gone = repo.vacuum(age=0)
    return repo.head("main").select(key("s").alias("o"), F.lit(len(gone)).cast("bigint").alias("gone"))


@query("SELECT 'c' || (o_orderkey % 5) AS commit FROM orders WHERE o_orderkey = 7")
def repository_lookup(spark, sf_dir):
    """Which commit brought one quad; none for a quad that isn't there."""
    repo, names = _committed(spark, sf_dir)
    here = read(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderstatus").collect()
    wanted = I("urn:t:orders/7"), p("orders.o_orderstatus")
    at = repo.chain("main")[2]  # order 7 came with it, and a later commit may remove it
    found = [repo.lookup(at, *wanted, L(r.o_orderstatus)) for r in here] + [repo.lookup(at, *wanted, L("no status"))]
    return reduce(DataFrame.unionByName, found).join(names, F.col("commit") == F.col("id")).select(F.col("name").alias("commit"))


@query("SELECT * FROM (VALUES ('branch', 'main', 'c4'), ('branch', 'old', 'c1'), ('tag', 'v1', 'c2'), ('remote', 'backup', 'c4'), ('namespace', 's', 'urn:s#'), ('namespace', 't', 'urn:t:')) t(kind, name, target)")
def repository_names(spark, sf_dir):
    """Branches, tags, remotes (with the commit that was pushed there) and namespaces; removed ones are gone."""
    repo, names = _committed(spark, sf_dir)
    chain = repo.chain("main")
    repo.branch("old", chain[1])
    repo.branch("gone", chain[0])
    repo.set_ref("gone", None)
    repo.tag("v1", chain[2])
    repo.tag("gone", chain[2])
    repo.delete_tag("gone")
    repo.add_remote("backup", f"{repo.root}-backup")
    repo.add_remote("gone", f"{repo.root}-gone")
    repo.remove_remote("gone")
    repo.push(repo.remote("backup"), "main")
    rows = [("branch", b, repo.ref(b)) for b in repo.branches()] + [("tag", t, i) for t, i in repo.tags().items()] + [("remote", r, repo.remote(r).ref("main")) for r in repo.remotes()]
    repo.set_prefixes("old", {"s": "urn:s#", "t": "urn:old:", "u": "urn:u:"})
    repo.set_prefixes("old", {"t": "urn:t:", "u": None})
    spaces = repo.namespaces("old").select(F.lit("namespace").alias("kind"), F.col("prefix").alias("name"), F.col("name").alias("target"))
    return spark.createDataFrame(rows, "kind string, name string, id string").join(names.withColumnRenamed("name", "target"), "id").select("kind", "name", "target").unionByName(spaces)


@query("SELECT count(*) AS quads, count(DISTINCT n_name) AS names, 0::BIGINT AS again FROM customer JOIN nation ON c_nationkey = n_nationkey")
def repository_canonical(spark, sf_dir):
    """Blank nodes committed with canonical labels: the same content under other labels is no change, and literals stay."""
    repo, q = _repository(spark), bnodes(spark, sf_dir)
    plus = lambda quads: quads.select(F.lit(1).cast("tinyint").alias("op"), "s", "p", "o", "g")
    repo.write_canonical("main", plus(q))
    other = q.withColumn("s", T.bnode(F.reverse(lex("s"))).column())
    again = update.insert_data(repo.head("main"), canon.canonicalize(other))
    head = repo.head("main")
    seen = head.agg(F.count("*").alias("quads"), F.count_distinct(lex("o")).alias("names"))
    return seen.select("*", F.lit(again.count()).cast("bigint").alias("again"))


@query("SELECT o_orderpriority AS prio, sum(DISTINCT o_custkey)::BIGINT AS total, round(avg(DISTINCT o_custkey), 6) AS mean, count(*) AS n FROM orders GROUP BY 1")
def sum_avg_distinct(spark, sf_dir):
    """Of distinct terms, beside an aggregate of all rows."""
    m = _orders(spark, sf_dir).bind("k", T.integer(key("c"))).group("v", t=A.sum_("k", distinct=True), m=A.avg("k", distinct=True), n=A.count())
    return m.df.select(lex("v").alias("prio"), whole("t").alias("total"), num("m", 6).alias("mean"), whole("n").alias("n"))


@query("SELECT n AS terms, n AS ids, n AS first_halves FROM (SELECT 2 * (SELECT count(*) FROM customer) + count(*) + count(DISTINCT n_name) AS n FROM nation)")
def term_ids(spark, sf_dir):
    """No two terms have one id; nor, in these tables, one half of an id."""
    quads = lift(spark, sf_dir, "customer.c_custkey", "nation.n_name").select(F.explode(F.array("s", "o")).alias("t"))
    # dealt by id, so that a task has an id's terms, and few of them; then counts alone go on
    each = quads.select("t.id", F.struct("t.kind", "t.lex", "t.dt", "t.lang").alias("term"))
    ids = dealt(each, "id").distinct().groupBy("id").agg(F.count("*").alias("terms"))
    halves = ids.groupBy("id.a").agg(F.sum("terms").alias("terms"), F.count("*").alias("ids"))
    return halves.agg(*[F.coalesce(f(c), F.lit(0)).cast("bigint").alias(n) for f, c, n in ((F.sum, "terms", "terms"), (F.sum, "ids", "ids"), (F.count, "ids", "first_halves"))])


# canonicalization, RDF-star and formats ----------------------------------------------------------------------------


def bnodes(spark, sf_dir) -> DataFrame:
    """A blank node for each customer, linked to its nation's name; equal ones collide by design."""
    d = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(T.bnode(F.concat(F.lit("b"), F.col("c_custkey").cast("string"))).column().alias("s"), I("urn:nation").column().alias("p"), T.literal(F.col("n_name")).column().alias("o"), DEFAULT.column().alias("g"))


@query("SELECT 'b' || c_custkey AS b, sha256('_:a <urn:nation> \"' || n_name || '\" .' || chr(10)) AS hash FROM customer JOIN nation ON c_nationkey = n_nationkey")
def canon_first_degree(spark, sf_dir):
    return canon.first_degree(bnodes(spark, sf_dir))


def chained(spark, sf_dir, name: Callable[[Column], Column]) -> DataFrame:
    """A blank node for each customer, in chains of ten; ``name`` makes a label of a key's text."""
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    term = lambda x: T.bnode(name(x.cast("string"))).column()
    links = d.where("k % 10 <> 0").select(term(F.col("k")).alias("s"), I("urn:next").column().alias("p"), term(F.col("k") - 1).alias("o"), DEFAULT.column().alias("g"))
    own = d.select(term(F.col("k")).alias("s"), I("urn:is").column().alias("p"), T.L("x").column().alias("o"), DEFAULT.column().alias("g"))
    there = own.select(F.col("s").alias("there"))
    return links.join(there, links.o["id"] == there.there["id"], "left_semi").unionByName(own)


@query("SELECT 'b' || c_custkey AS b, min('b' || c_custkey) OVER (PARTITION BY c_custkey // 10) AS component FROM customer")
def canon_components(spark, sf_dir):
    """Customers in chains of ten."""
    return canon.components(chained(spark, sf_dir, lambda k: F.concat(F.lit("b"), k)))


@query(
    "WITH h AS (SELECT n_nationkey, n_name, substr(sha256('_:a <urn:nation> \"' || n_name || '\" .' || chr(10)), 1, 32) AS local FROM nation), "
    "d AS (SELECT *, sha256('_:' || local || ' <urn:nation> \"' || n_name || '\" ') AS d FROM h), "
    "c AS (SELECT *, substr(sha256(('0x' || substr(d, 1, 15))::BIGINT || ' ' || ('0x' || substr(d, 16, 15))::BIGINT || ' 1'), 1, 24) AS content FROM d) "
    "SELECT 'c14n_' || content || '_' || (row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1) || '_' || local AS s, n_name AS o FROM customer JOIN c ON c_nationkey = n_nationkey"
)
def canon_full(spark, sf_dir):
    return canon.canonicalize(bnodes(spark, sf_dir)).select(lex("s").alias("s"), lex("o").alias("o"))


@query("SELECT count(*) + count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)) AS quads, 0::BIGINT AS differing FROM customer")
def canon_relabelled(spark, sf_dir):
    """Canonical forms of linked blank nodes under two sets of labels: as many quads, and none that differs."""
    # read three and two times
    one, other = (stored(canon.canonicalize(chained(spark, sf_dir, name))) for name in (lambda k: F.concat(F.lit("b"), k), lambda k: F.concat(F.lit("x"), F.reverse(k))))
    rows = one.select(F.lit(1).alias("quads"), F.lit(0).alias("differing")).unionByName(algebra.difference(one, other).select(F.lit(0).alias("quads"), F.lit(1).alias("differing")))
    return rows.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("quads", "differing")])


def nation_nodes(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "nation")
    return d.select(T.bnode(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).column().alias("s"), I("urn:name").column().alias("p"), T.literal(F.col("n_name")).column().alias("o"), DEFAULT.column().alias("g"))


@query(
    "WITH f AS (SELECT n_nationkey, count(s_suppkey) AS n, sha256('_:a <urn:name> \"' || n_name || '\" .' || chr(10) || repeat('_:z <urn:in> _:a .' || chr(10), count(s_suppkey))) AS h "
    "FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name), o AS (SELECT sha256('_:a <urn:in> _:z .' || chr(10)) AS h) "
    "SELECT 's' || s_suppkey AS b, sha256(o.h || f.h) AS hash FROM supplier JOIN f ON s_nationkey = n_nationkey, o UNION ALL SELECT 'n' || n_nationkey, sha256(f.h || repeat(o.h, n)) FROM f, o"
)
def canon_second_degree(spark, sf_dir):
    """Suppliers' blank nodes are alike but for their nations'."""
    node = lambda letter, c: T.bnode(F.concat(F.lit(letter), F.col(c).cast("string"))).column()
    links = read(spark, sf_dir, "supplier").select(node("s", "s_suppkey").alias("s"), I("urn:in").column().alias("p"), node("n", "s_nationkey").alias("o"), DEFAULT.column().alias("g"))
    return canon.second_degree(links.unionByName(nation_nodes(spark, sf_dir)))


@query("SELECT 'first' AS method, 'n' || n_nationkey AS b, 'c14n_' || substr(sha256('_:a <urn:name> \"' || n_name || '\" .' || chr(10)), 1, 32) AS label FROM nation")
def canon_cascade(spark, sf_dir):
    method, labels = canon.cascade(nation_nodes(spark, sf_dir))
    return labels.select(F.lit(method).alias("method"), "b", "label")


@query("SELECT n_nationkey AS n, '<< <urn:t:nation/' || n_nationkey || '> <urn:t:nation#n_regionkey> <urn:t:region/' || n_regionkey || '> >>' AS stated FROM nation")
def rdf_star(spark, sf_dir):
    """Quoted triples as subjects of statements about them."""
    q = lift(spark, sf_dir, "nation.n_regionkey")
    said = q.select(T.quoted(F.col("s"), F.col("p"), F.col("o")).column().alias("s"), I("urn:certainty").column().alias("p"), L(1).column().alias("o"), DEFAULT.column().alias("g"), F.col("s").alias("about"))
    return Graph(said.select("s", "p", "o", "g"), merge=False).bgp((x, I("urn:certainty"), v)).filter(T.is_triple(F.col("x"))).df.select(F.regexp_extract(lex("x"), r"nation/(\d+)", 1).cast("int").alias("n"), lex("x").alias("stated"))


def _said(spark, sf_dir) -> DataFrame:
    """Statements about quoted triples, some of them quoted inside others."""
    q = lift(spark, sf_dir, "nation.n_regionkey", "nation.n_name")
    inner = T.quoted(F.col("s"), F.col("p"), F.col("o"))
    said = lambda t: q.select(t.column().alias("s"), I("urn:certainty").column().alias("p"), L(1).column().alias("o"), DEFAULT.column().alias("g"))
    return said(inner).unionByName(said(T.quoted(inner, I("urn:by"), L("me >> .")))).unionByName(said(inner))


@query("SELECT n_nationkey AS n, 'n_name' AS p, n_name AS o FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', 'urn:t:region/' || n_regionkey FROM nation")
def rdf_star_parts(spark, sf_dir):
    """The innermost subject, predicate and object of triples that are quoted in quoted ones."""
    m = Graph(_said(spark, sf_dir)).bgp((x, I("urn:certainty"), v)).filter(T.is_triple(T.subject(T.Ref("x"))))
    inner = T.subject(T.Ref("x"))
    df = m.df.select(*[part(inner).column().alias(c) for c, part in (("s", T.subject), ("p", T.predicate), ("o", T.object_))])
    return df.select(key("s").cast("int").alias("n"), F.substring_index(lex("p"), "#", -1).alias("p"), lex("o").alias("o"))


@query("SELECT n_nationkey AS n, 'urn:t:region/' || n_regionkey AS o FROM nation")
def rdf_star_enumeration(spark, sf_dir):
    """The distinct quoted triples with a given predicate."""
    return Graph(_said(spark, sf_dir)).quoted_triples(p=p("nation.n_regionkey")).select(key("s").cast("int").alias("n"), lex("o").alias("o"))


@query("SELECT c_custkey AS c, n_name AS nation, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def read_turtle(spark, sf_dir):
    """A Turtle document for each customer: prefixes, property lists, a nested blank node and a number."""
    d = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.format_string("PREFIX s: <urn:s#> # names\n<urn:t:customer/%d> a s:C ; s:in [ s:name '%s' ] ; s:bal %s .", "c_custkey", "n_name", F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    # parsed once for all patterns, and by many tasks, in however few parts the table comes
    documents = dealt(d.select(F.col("c_custkey").cast("string").alias("path"), text.alias("value")), "path", rows=10_000)
    m = Graph(stored(turtle.parse_documents(documents)), merge=False).bgp((c, I(T.RDF + "type"), I("urn:s#C")), (c, I("urn:s#in"), n), (n, I("urn:s#name"), v), (c, I("urn:s#bal"), w))
    return m.df.select(key("c").alias("c"), lex("v").alias("nation"), lex("w").cast("double").alias("bal"))


@query("SELECT '<urn:t:nation/' || n_nationkey || '> <urn:t:nation#n_name> \"' || n_name || '\" .' AS value FROM nation")
def write_nquads(spark, sf_dir):
    return rdf.to_nquads(lift(spark, sf_dir, "nation.n_name"))


@query("SELECT c_custkey AS c, c_name AS name FROM customer")
def ntriples_round_trip(spark, sf_dir):
    """Written as N-Triples, parsed back, and asked again."""
    lines = rdf.to_nquads(lift(spark, sf_dir, "customer.c_name"))
    parsed = rdf.parse_lines(lines)
    return Graph(parsed, merge=False).bgp((c, p("customer.c_name"), v)).df.select(key("c").alias("c"), lex("v").alias("name"))


@query("SELECT n_nationkey || ',' || n_name AS value FROM nation")
def results_csv(spark, sf_dir):
    m = graph(spark, sf_dir, "nation.n_name").bgp((n, p("nation.n_name"), v)).bind("k", T.integer(key("n"))).project("k", "v")
    return rdf.results_csv(m)


@query("""SELECT '{"v":{"type":"literal","value":"' || n_name || '"}}' AS value FROM nation""")
def results_json(spark, sf_dir):
    return rdf.results_json(graph(spark, sf_dir, "nation.n_name").bgp((n, p("nation.n_name"), v)).project("v"))


@query("""SELECT '<urn:t:nation/' || n_nationkey || '>' || chr(9) || '"' || n_name || '"' || chr(9) || n_nationkey AS value FROM nation""")
def results_tsv(spark, sf_dir):
    m = graph(spark, sf_dir, "nation.n_name").bgp((n, p("nation.n_name"), v)).bind("k", T.integer(key("n"))).project("n", "v", "k")
    return rdf.results_tsv(m)


@query("""SELECT '<result><binding name="n"><uri>urn:t:nation/' || n_nationkey || '</uri></binding><binding name="v"><literal>' || n_name || '</literal></binding></result>' AS value FROM nation""")
def results_xml(spark, sf_dir):
    return rdf.results_xml(graph(spark, sf_dir, "nation.n_name").bgp((n, p("nation.n_name"), v)).project("n", "v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bgp_q5(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
