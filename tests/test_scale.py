"""What operators shuffle and hold, by Spark's own counts."""

import random

import pandas as pd
from palimpsest.history import algebra
from palimpsest.functions import terms as T
from palimpsest.functions.terms import I
from palimpsest.operators import aggregates as A
from palimpsest.operators import canon
from palimpsest.operators import paths as P
from palimpsest.plans.graph import DEFAULT, Graph, Var
from palimpsest.queries import STEP, _vertex, bgp_triangle_joins, subject_const
from palimpsest.sources import turtle
from palimpsest.sources.lift import edges
from pyspark.sql import functions as F

x, y = Var("x"), Var("y")


def stages(spark, action):
    """``action``'s result and its stages' data."""
    store, arrays = spark._jsc.sc().statusStore(), spark.sparkContext._gateway

    def all_stages():
        listed = store.stageList(None, False, False, arrays.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {listed.apply(i).stageId(): listed.apply(i) for i in range(listed.size())}

    before = all_stages()
    result = action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return result, [s for i, s in all_stages().items() if i not in before]


def shuffled(spark, action):
    result, found = stages(spark, action)
    return result, sum(s.shuffleWriteBytes() for s in found)


def chains(spark, number, length):
    pairs = spark.range(number * length).selectExpr("id as x", "id + 1 as y").where(f"y % {length} <> 0")
    return Graph(edges(pairs), merge=False)


def test_closure_finds_a_pair_of_a_chain_once(spark):
    found, size = shuffled(spark, lambda: P.match(chains(spark, 100, 32), x, P.Plus(STEP), y).df.select(_vertex("x"), _vertex("y")).distinct().count())
    assert found == 100 * 32 * 31 // 2
    assert size < 200 * found, size / found


def test_closure_of_cycles_and_branches(spark):
    rng = random.Random(3)
    for n, m in ((25, 40), (9, 9)):
        links = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | ({(i, (i + 1) % 9) for i in range(9)} if n == 9 else set())
        want = set(links)
        while more := {(a, d) for a, b in want for c, d in links if b == c} - want:
            want |= more
        q = Graph(edges(spark.createDataFrame(sorted(links), "x long, y long")), merge=False)
        got = [tuple(r) for r in P.match(q, x, P.Plus(STEP), y).df.select(_vertex("x"), _vertex("y")).collect()]
        assert sorted(got) == sorted(want)
        got = [tuple(r) for r in P.match(q, x, P.Star(STEP), y).df.select(_vertex("x"), _vertex("y")).collect()]
        assert sorted(got) == sorted(want | {(v, v) for e in links for v in e})
        got = [r[0] for r in P.match(q, subject_const("v", 1), P.Star(STEP), y).df.select(_vertex("y")).collect()]
        assert sorted(got) == sorted({d for c, d in want if c == 1} | {1})


def test_frontier_does_not_shuffle_the_steps(spark):
    found, size = shuffled(spark, lambda: P.match(chains(spark, 1000, 16), subject_const("v", 16), P.Star(STEP), y).df.count())
    assert found == 16 and size < 100_000, size


def test_small_turtle_documents_share_batches():
    documents = pd.DataFrame({"path": [str(i) for i in range(6000)], "value": [f"<urn:{i}> a <urn:c> ; <urn:p> [] ." for i in range(6000)]})
    out = [len(b) for b in turtle._statements("", "")(iter([documents[:2500], documents[2500:]]))]
    assert out == [10_000, 2_000]


def test_pairs_below_are_counted_without_being_made(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([float(rng.randrange(40)), float("inf"), float("-inf")]), i % 3 > 0, i % 3 == 0) for i in range(300)] + [("c", 1.0, True, False), ("c", 1.0, False, True)]
    df = spark.createDataFrame([(a, b, int(c), int(d)) for a, b, c, d in rows], "x string, v double, low int, high int")
    want = {x: sum(a[0] == b[0] == x and a[2] and b[3] and a[1] < b[1] for a in rows for b in rows) for x in "ab"}
    assert {r.x: r.n for r in A.count_below(df).collect()} == want
    many = spark.range(400_000).selectExpr("'a' as x", "cast(id as double) as v", "cast(id % 2 as int) as low", "cast(1 - id % 2 as int) as high")
    assert A.count_below(many).first().n == 200_000 * 199_999 // 2


def test_open_paths_are_not_sorted_to_close_them(spark):
    e = I("urn:e")
    z = Var("z")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bgp_triangle_joins(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 1
    q = Graph(edges(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (5, 5)], "x long, y long")), merge=False)
    for closing in (None, "shuffle_hash"):
        assert q.bgp((x, e, y), (y, e, z), (z, e, x), closing=closing).df.count() == 4


def test_distinct_sorts_nothing(spark):
    rows = Graph(edges(spark.range(1000).selectExpr("id % 7 as x", "id % 5 as y")), merge=False).bgp((x, I("urn:e"), y)).distinct()
    assert "SortAggregate" not in rows.df._jdf.queryExecution().sparkPlan().toString()
    assert rows.df.count() == 35


def test_snapshot_does_not_sort_what_it_scans(spark):
    quads = edges(spark.range(200).selectExpr("id as x", "id % 5 as y")).select(F.lit("c").alias("commit"), F.lit(1).cast("tinyint").alias("op"), "*")
    live = algebra.snapshot(quads.unionByName(quads.where("false")), ["c"])
    plan = live._jdf.queryExecution().executedPlan().toString()
    # one shuffle, and both steps of the aggregate above it
    assert plan.count("- Exchange ") == 1 and plan.rindex("SortAggregate") < plan.index("- Exchange ")
    assert live.count() == 200


def test_canonical_labels_read_quads_once_and_heap_no_constants(spark):
    """Chains of three with a literal each, all in the default graph: neither that, nor the literal, is a join's key."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    node = lambda c: T.bnode(F.concat(F.lit("b"), F.col(c).cast("string"))).column()
    cells = lambda s, p, o: [node(s).alias("s"), I(p).column().alias("p"), o.alias("o"), DEFAULT.column().alias("g")]
    ids = spark.range(3000).selectExpr("id as k", "id + 1 as after")
    quads = ids.where("k % 3 < 2").select(*cells("k", "urn:next", node("after"))).unionByName(ids.select(*cells("k", "urn:is", T.L("x").column())))
    quads = quads.mapInArrow(counted, quads.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        found, made = stages(spark, lambda: canon.canonicalize(quads).select(F.col("s")["lex"].alias("s"), F.col("o")["lex"].alias("o")).collect())
    finally:
        for name in ("coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.adaptive.{name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(set(found)) == 5000 and len({r.s for r in found}) == 3000
    assert seen.value == 5000
    store = spark._jsc.sc().statusStore()
    for s in made:
        if s.shuffleReadRecords() > 3000:
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            most = max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))
            assert most < 0.4 * s.shuffleReadRecords(), (s.stageId(), most, s.shuffleReadRecords())


def test_nodes_without_neighbours_take_no_rounds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(canon, "cut", lambda df, cut=canon.cut: kept.append(cut(df)) or kept[-1])
    node = T.bnode(F.concat(F.lit("b"), F.col("id").cast("string"))).column()
    quads = spark.range(40).select(node.alias("s"), I("urn:is").column().alias("p"), T.literal((F.col("id") % 4).cast("string")).column().alias("o"), DEFAULT.column().alias("g"))
    assert canon.canonicalize(quads).select(F.col("s")["lex"]).distinct().count() == 40
    # edges, components, mentions, hashes, contents, labels
    assert len(kept) == 6
