"""Blank-node canonicalization: hashes by aggregation, components by label spreading, ties inside a component.

Hashes are refined by joins, each round with those of the neighbours.  A
component (blank nodes that share quads) whose hashes all differ is settled
then, whatever its size; only components that still have ties go to a search over
permutations, a component a task and bounded in size, permutations and time.  Labels
carry the component's content hash, so that they depend on content alone and
need no global numbering.
"""

from __future__ import annotations

import hashlib
import itertools
import time
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.graph import cut, stored

#: Permutations that a component's ties may take before it fails as too symmetric.
BUDGET = 20_000
#: Seconds that a component's search may take.
SECONDS = 60.0
#: Mentions of blank nodes in a component with ties; a larger one fails before any task gets it.
MOST_MENTIONS = 1_000_000
#: Parts in which equal components are numbered.
SALTS = 256


class BudgetExceeded(Exception):
    """A component is too symmetric for the budget; nothing is returned for it."""


def noop(quads: DataFrame) -> DataFrame:
    return quads


def _blank(c: str):
    return F.col(c)["kind"] == T.BNODE


def _mentions(quads: DataFrame) -> DataFrame:
    """A row for each blank node of each quad: its label ``b`` and the quad's N-Triples parts."""
    parts = [F.when(_blank(c), F.concat(F.lit("_:"), F.col(c)["lex"])).when(F.col(c)["lex"] == "", F.lit("")).otherwise(T.ntriples(F.col(c))).alias(f"t{c}") for c in "spog"]
    labels = F.array_distinct(F.filter(F.array(*[F.when(_blank(c), F.col(c)["lex"]) for c in "sog"]), lambda x: x.isNotNull()))
    return quads.select(*parts, F.explode(labels).alias("b"))


def first_degree(quads: DataFrame) -> DataFrame:
    """``b, hash``: SHA-256 of the sorted quads that mention a blank node, it written ``_:a`` and others ``_:z``; also of mentions."""
    own = lambda c: F.when(F.col(c) == F.concat(F.lit("_:"), F.col("b")), F.lit("_:a")).when(F.col(c).startswith("_:"), F.lit("_:z")).otherwise(F.col(c))
    line = F.concat_ws(" ", own("ts"), F.col("tp"), own("to"), F.when(F.col("tg") != "", own("tg")), F.lit("."))
    text = F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n"))
    mentions = quads if "ts" in quads.columns else _mentions(quads)
    return mentions.select("b", line.alias("line")).groupBy("b").agg(F.sha2(text, 256).alias("hash"))


def _neighbours(quads: DataFrame) -> DataFrame:
    """``u, v``: labels of different blank nodes that share a quad, both ways."""
    labels = F.array_distinct(F.filter(F.array(*[F.when(_blank(c), F.col(c)["lex"]) for c in "sog"]), lambda x: x.isNotNull()))
    each = quads.select(labels.alias("l")).where(F.size("l") > 1)
    return each.select(F.explode("l").alias("u"), "l").select("u", F.explode("l").alias("v")).where("u <> v").distinct()


def second_degree(quads: DataFrame) -> DataFrame:
    """``b, hash``: the first-degree hash with the sorted ones of neighbours."""
    first = cut(first_degree(quads))
    near = _neighbours(quads).join(first.select(F.col("b").alias("v"), F.col("hash").alias("h")), "v").groupBy(F.col("u").alias("b")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("near"))
    return first.join(near, "b", "left").select("b", F.sha2(F.concat("hash", F.coalesce("near", F.lit(""))), 256).alias("hash"))


def collisions(hashes: DataFrame) -> DataFrame:
    """Hashes that several blank nodes have; no rows mean that they suffice."""
    return hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


def _linked(quads: DataFrame) -> DataFrame:
    """``b, component`` of the blank nodes that have neighbours."""
    edges = cut(_neighbours(quads))
    labels = cut(edges.groupBy(F.col("u").alias("b")).agg(F.least("u", F.min("v")).alias("component")))
    if labels.isEmpty():
        return labels
    while True:
        near = edges.join(labels.select(F.col("b").alias("v"), "component"), "v").groupBy(F.col("u").alias("b")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "b").select("b", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("b").alias("component"), F.col("component").alias("up"))
        after = cut(spread.join(up, "component").select("b", "old", F.least("component", "up").alias("component")))
        labels = after.select("b", "component")
        if after.where("component <> old").isEmpty():
            return labels


def components(quads: DataFrame) -> DataFrame:
    """``b, component``: the smallest label that a blank node is connected with."""
    return _mentions(quads).select("b").distinct().join(_linked(quads), "b", "left").select("b", F.coalesce("component", "b").alias("component"))


def _others(rows: DataFrame) -> DataFrame:
    """Mentions with the one or two other blank nodes of their quad, ``v`` and ``w``, NULL where there are none."""
    written = F.array_distinct(F.filter(F.array("ts", "to", "tg"), lambda x: x.startswith("_:") & (x != F.concat(F.lit("_:"), F.col("b")))))
    return rows.withColumn("_l", written).select("*", *[F.substring(F.get("_l", F.lit(i)), 3, 2**31 - 1).alias(x) for i, x in enumerate("vw")]).drop("_l")


def _most(rows: DataFrame) -> int:
    """The most other blank nodes that a mention of ``_others`` has."""
    return rows.agg(F.max(F.expr("if(w is not null, 2, if(v is not null, 1, 0))"))).first()[0] or 0


def _named(rows: DataFrame, names: DataFrame, given: str, most: int) -> list[tuple[str, DataFrame]]:
    """Mentions of ``_others`` that have others, by which of ``v, w`` these are, with their ``given`` as ``v_is`` and ``w_is``.

    Each part is joined for the nodes that it has: IRIs, literals and the default graph
    are the same in many rows, and as keys, or as NULLs, they would bring all of these to one task.
    """
    of = lambda x: names.select(F.col("b").alias(x), F.col(given).alias(f"{x}_is"))
    one = lambda: rows.where("v is not null and w is null").join(of("v"), "v")
    two = lambda: rows.where("w is not null").join(of("w"), "w").join(of("v"), "v")
    return [("v", one()), ("vw", two())][:most]


def _written(own, others: str = ""):
    """A mention's quad, with ``own`` for its blank node and the ``_is`` columns for others."""

    def part(c):
        named = lambda x: F.col(c) == F.concat(F.lit("_:"), F.col(x))
        out = F.when(named("b"), own)
        for x in others:
            out = out.when(named(x), F.col(f"{x}_is"))
        return out.otherwise(F.col(c))

    return F.concat_ws(" ", part("ts"), F.col("tp"), part("to"), part("tg"))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Component:
    """The quads of one component, as tuples of N-Triples parts (s, p, o, g)."""

    def __init__(self, quads: list[tuple], budget: int, seconds: float = SECONDS):
        self.quads, self.left, self.end = quads, budget, time.monotonic() + seconds
        self.of: dict[str, list[tuple]] = {}
        for q in quads:
            for x in {x for i, x in enumerate(q) if i != 1 and x.startswith("_:")}:
                self.of.setdefault(x, []).append(q)
        self.hash = {b: self._first(b) for b in self.of}

    @staticmethod
    def line(q, name) -> str:
        parts = [name(x) if i != 1 and x.startswith("_:") else x for i, x in enumerate(q)]
        return " ".join([*parts[:3], *([parts[3]] if parts[3] else []), "."])

    def _first(self, b: str) -> str:
        return _digest("".join(sorted(self.line(q, lambda x: "_:a" if x == b else "_:z") + "\n" for q in self.of[b])))

    def _many(self, b: str, issued: dict, canonical: dict) -> tuple[str, dict]:
        """N-degree hash of a blank node, and the temporary names that give it."""
        related: dict[str, list[str]] = {}
        for q in self.of[b]:
            for place, x in ((0, q[0]), (2, q[2]), (3, q[3])):
                if x.startswith("_:") and x != b:
                    known = canonical.get(x) or issued.get(x) or self.hash[x]
                    key = _digest("spog"[place] + (f"<{q[1]}>" if place != 3 else "") + known)
                    related.setdefault(key, []).append(x)
        data = ""
        for key in sorted(related):
            data += key
            best, names = None, issued
            for order in sorted(set(itertools.permutations(sorted(set(related[key]))))):
                self.left -= 1
                if self.left < 0 or time.monotonic() > self.end:
                    raise BudgetExceeded(f"a component of {len(self.of)} blank nodes")
                copy, path, todo = dict(issued), "", []
                for x in order:
                    if x in canonical:
                        path += canonical[x]
                    else:
                        if x not in copy:
                            todo.append(x)
                            copy[x] = f"_:b{len(copy)}"
                        path += copy[x]
                for x in todo:
                    found, copy = self._many(x, copy, canonical)
                    path += copy[x] + f"<{found}>"
                if best is None or path < best:
                    best, names = path, copy
            data, issued = data + (best or ""), names
        return _digest(data), issued

    def labels(self) -> dict[str, str]:
        canonical: dict[str, str] = {}
        groups: dict[str, list[str]] = {}
        for b, h in self.hash.items():
            groups.setdefault(h, []).append(b)

        def issue(b: str) -> None:
            canonical.setdefault(b, f"_:c{len(canonical)}")

        for h in sorted(h for h, g in groups.items() if len(g) == 1):
            issue(groups[h][0])
        for h in sorted(h for h, g in groups.items() if len(g) > 1):
            results = []
            for b in groups[h]:
                if b not in canonical:
                    found, issued = self._many(b, {b: "_:b0"}, canonical)
                    results.append((found, issued))
            for _, issued in sorted(results, key=lambda r: r[0]):
                for b in issued:
                    issue(b)
        return canonical


def _solve(budget: int, seconds: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Component(list(pdf[["ts", "tp", "to", "tg"]].drop_duplicates().itertuples(index=False, name=None)), budget, seconds)
        names = c.labels()
        content = _digest("\n".join(sorted(c.line(q, lambda x: names[x]) for q in c.quads)))
        return pd.DataFrame({"component": pdf["component"].iloc[0], "b": [b[2:] for b in names], "local": [n[2:] for n in names.values()], "content": content})

    return run


def _settled(hashes: DataFrame) -> DataFrame:
    """``component, settled``: whether all hashes ``component, b, hash`` of a component differ."""
    each = hashes.groupBy("component", "hash").agg(F.count("*").alias("n"))
    return each.groupBy("component").agg((F.max("n") == 1).alias("settled"), F.count("*").alias("kinds"))


def refined(rows: DataFrame) -> DataFrame:
    """``component, b, hash, settled``: first-degree hashes, refined until a component has no ties or a round finds nothing new.

    ``rows`` are mentions with their component.  A round joins each mention of a quad that has other blank nodes with
    the hashes of these; lines of other quads stay with their node.  Only components that the last round made finer take part in the next.
    """
    each, mark = rows if "v" in rows.columns else _others(rows), F.lit("_:a")
    parts = each.groupBy("b").agg(F.first("component").alias("component"), F.collect_list(F.when(F.col("v").isNull(), _written(mark))).alias("alone"))
    hashes = parts.join(first_degree(rows), "b").select("component", "b", "hash", "alone")
    hashes = cut(hashes.join(_settled(hashes), "component").withColumn("before", F.lit(0)))
    # a component settled, or no finer than the round before, is ready
    ready = "settled or kinds <= before"
    done, todo = hashes.where(ready).select("component", "b", "hash", "settled"), hashes.where(f"not ({ready})")
    if todo.isEmpty():
        return done
    links = cut(each.where("v is not null").select("b", "v", "w", "ts", "tp", "to", "tg"))
    most = _most(links)
    while not todo.isEmpty():
        # all nodes of a component take part or none: mentions in one that is ready find no hash
        lines = [near.select("b", _written(mark, others).alias("line")) for others, near in _named(links, todo, "hash", most)]
        about = reduce(DataFrame.unionByName, lines).groupBy("b").agg(F.collect_list("line").alias("lines"))
        text = F.array_join(F.array_sort(F.concat("alone", "lines")), "\n")
        after = todo.join(about, "b").select("component", "b", F.sha2(F.concat_ws("\n", "hash", text), 256).alias("hash"), "alone", F.col("kinds").alias("before"))
        hashes = cut(after.join(_settled(after), "component"))
        done, todo = done.unionByName(hashes.where(ready).select(*done.columns)), hashes.where(f"not ({ready})")
    return done


def _settled_labels(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Labels of settled components: a node's hash, and its component's content as the sum of its lines' hashes.

    ``rows`` are mentions of ``_others``, each there once.
    """
    names = hashes.select("component", "b", F.substring("hash", 1, 32).alias("local"))
    known = names.select("b", F.concat(F.lit("_:"), "local").alias("name"))
    # a quad counts once, where its smallest label is mentioned
    once = rows.where("(v is null or b < v) and (w is null or b < w)").join(known, "b")
    own = F.col("name")
    lines = [once.where("v is null").select("component", _written(own).alias("line"))]
    lines += [near.select("component", _written(own, others).alias("line")) for others, near in _named(once, known, "name", _most(rows))]
    digest = F.sha2("line", 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    content = reduce(DataFrame.unionByName, lines).groupBy("component").agg(F.sha2(F.concat_ws(" ", part(1), part(16), F.count("*").cast("string")), 256).alias("content"))
    return names.join(content, "component")


def _copies(content: DataFrame) -> DataFrame:
    """``component, copy``: components of one content numbered from 0, in parts so that no task gets all of a frequent one."""
    salted = content.withColumn("salt", F.pmod(F.xxhash64("component"), F.lit(SALTS)))
    sizes = salted.groupBy("content", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("content").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("content", "salt").orderBy("component"))
    numbered = salted.withColumn("own", own).join(sizes.select("content", "salt", before.alias("before")), ["content", "salt"])
    return numbered.select("component", (F.col("before") + F.col("own") - 1).alias("copy"))


def labels(quads: DataFrame, budget: int = BUDGET, seconds: float = SECONDS) -> DataFrame:
    """``b, label``: canonical labels; equal components are told apart by a number that their content doesn't depend on.

    Raises ``BudgetExceeded`` for a component with ties of more than ``MOST_MENTIONS`` mentions; one whose search takes more
    than ``budget`` permutations or ``seconds`` fails its task.
    """
    mentions = _others(_mentions(quads).distinct())
    rows = cut(mentions.join(_linked(quads), "b", "left").withColumn("component", F.coalesce("component", "b")))
    hashes = refined(rows)
    solved = _settled_labels(rows, hashes.where("settled")).select("component", "b", "local", "content")
    ties = hashes.where("not settled").select("component").distinct()
    if not ties.isEmpty():
        tied = rows.join(ties, "component", "left_semi")
        large = tied.groupBy("component").count().where(F.col("count") > MOST_MENTIONS).head(1)
        if large:
            raise BudgetExceeded(f"the component of {large[0]['component']} has ties and {large[0]['count']} mentions")
        searched = tied.select("component", "ts", "tp", "to", "tg").distinct().groupBy("component").applyInPandas(_solve(budget, seconds), "component string, b string, local string, content string")
        solved = solved.unionByName(searched)
    solved = cut(solved)
    copies = _copies(solved.select("component", "content").distinct())
    return solved.join(copies, "component").select("b", F.concat_ws("_", F.lit("c14n"), F.substring("content", 1, 24), "copy", "local").alias("label"))


def canonicalize(quads: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Quads with canonical blank-node labels; literals and IRIs stay as they are.

    Different blank nodes get different labels, so quads are made distinct before, which also deals those of few files to many tasks.
    """
    quads = stored(quads.select("s", "p", "o", "g").distinct())
    found = quads.agg(*[F.max(_blank(c)).alias(c) for c in "sog"]).first()
    places = [c for c in "sog" if found[c]]
    if not places:
        return quads
    names = cut(labels(quads, budget))  # the joins read it
    out = quads
    for c in places:
        key = names.select(F.col("b").alias(f"_{c}"), F.col("label").alias(f"_{c}l"))
        # no label has a space: other terms are dealt by their quad, not to one task
        free = F.concat(F.lit(" "), F.hex(F.xxhash64(*[F.col(x)["id"] for x in "spog"])))
        out = out.join(key, F.when(_blank(c), F.col(c)["lex"]).otherwise(free) == F.col(f"_{c}"), "left")
    cell = lambda c: (F.when(_blank(c), T.bnode(F.col(f"_{c}l")).column()).otherwise(F.col(c)) if c in places else F.col(c)).alias(c)
    return out.select(cell("s"), "p", cell("o"), cell("g"))


def cascade(quads: DataFrame) -> tuple[str, DataFrame]:
    """The cheapest method without collisions, and its labels: first degree, second degree, or whole components."""
    for name, method in (("first", first_degree), ("second", second_degree)):
        hashes = cut(method(quads))
        if not collisions(hashes).limit(1).count():
            return name, hashes.select("b", F.concat(F.lit("c14n_"), F.substring("hash", 1, 32)).alias("label"))
    return "full", labels(quads)
