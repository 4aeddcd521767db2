"""Version algebra on DataFrames.

``deltas`` holds ``commit, op, s, p, o, g``; a history is an ordered list of
commit ids, oldest first.  Snapshots, differences, merges, blame and provenance
are each one aggregation or a few joins on ids, whatever the history's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.update import QUAD, signed, subtract
from ..plans.graph import dealt


#: Commits up to which a chain's numbers go to every task; of more, they are joined by a shuffle.
BROADCAST_COMMITS = 50_000


def numbered(deltas: DataFrame, chain: list[str]) -> DataFrame:
    """The deltas of a chain's commits with their place in it, from 0."""
    places = deltas.sparkSession.createDataFrame(list(zip(chain, range(len(chain)))), "commit string, seq int")
    return deltas.join(F.broadcast(places) if len(chain) <= BROADCAST_COMMITS else places, "commit")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col(c)["id"].alias(f"_{c}") for c in QUAD])


_KEYS = [f"_{c}" for c in QUAD]


def _by_quad(df: DataFrame):
    """Groups of one quad's rows of a table that is cheap to count.

    Rows are dealt by quad first, in small parts: sorting a scan's whole part for its few rows a quad takes memory and saves nothing.
    """
    return dealt(_keyed(df), *_KEYS).groupBy(*_KEYS)


def _once(quads: DataFrame) -> DataFrame:
    """Set semantics by term ids; rows are dealt first, but not counted, as they may be dear to make."""
    return _keyed(quads).repartition(*_KEYS).dropDuplicates(_KEYS).select(*QUAD)


def snapshot(deltas: DataFrame, chain: list[str]) -> DataFrame:
    """The state after a chain of commits: each quad's last operation, if that is an insert."""
    own = numbered(deltas, chain)
    last = _by_quad(own).agg(F.max_by("op", "seq").alias("op"), *[F.first(c).alias(c) for c in QUAD])
    return last.where("op = 1").select(*QUAD)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change events ``op, s, p, o, g`` that lead from one state to the other."""
    return signed(subtract(after.select(*QUAD), before), subtract(before.select(*QUAD), after))


def merge_union(target: DataFrame, source: DataFrame) -> DataFrame:
    """Set union: the source's deletions are not applied."""
    return _once(target.select(*QUAD).unionByName(source.select(*QUAD)))


def merge_three_way(base: DataFrame, target: DataFrame, source: DataFrame) -> DataFrame:
    """What the source added and removed since the base, applied to the target."""
    added, removed = subtract(source.select(*QUAD), base), subtract(base.select(*QUAD), source)
    return _once(subtract(target.select(*QUAD), removed).unionByName(added))


def squash(base: DataFrame, target: DataFrame, source: DataFrame) -> DataFrame:
    """The one net delta that takes the target to the three-way merge."""
    return difference(target, merge_three_way(base, target, source))


def blame(deltas: DataFrame, chain: list[str]) -> DataFrame:
    """For each quad ever there, the first commit whose snapshot has it."""
    own = numbered(deltas.where("op = 1"), chain)
    return _by_quad(own).agg(*[F.first(c).alias(c) for c in QUAD], F.min_by("commit", "seq").alias("commit"), F.min("seq").alias("seq")).select(*QUAD, "commit", "seq")


def first_seen(deltas: DataFrame, chain: list[str], live: DataFrame) -> DataFrame:
    """Provenance of the live quads: a quad that was removed and came back keeps its first commit."""
    found = blame(deltas, chain).select(*[F.col(c)["id"].alias(f"_{c}") for c in QUAD], "commit")
    keyed = live.select(*QUAD, *[F.col(c)["id"].alias(f"_{c}") for c in QUAD])
    return keyed.join(found, [f"_{c}" for c in QUAD]).select(*QUAD, "commit")


def merge_provenance(one: DataFrame, other: DataFrame) -> DataFrame:
    """The older entry wins; both have ``s, p, o, g, commit, ts``."""
    both = one.unionByName(other)
    return _by_quad(both).agg(*[F.first(c).alias(c) for c in QUAD], F.min_by("commit", F.struct("ts", "commit")).alias("commit"), F.min("ts").alias("ts")).select(*QUAD, "commit", "ts")


def merge_prefixes(base: dict, target: dict, source: dict) -> tuple[dict, list[str]]:
    """Three-way merge of namespace maps, and the prefixes that both sides changed differently."""
    out, conflicts = dict(target), []
    for prefix in {*base, *target, *source}:
        b, t, s = base.get(prefix), target.get(prefix), source.get(prefix)
        if s != b and t != b and s != t:
            conflicts.append(prefix)
        elif s != b:
            out.pop(prefix, None) if s is None else out.__setitem__(prefix, s)
    return out, sorted(conflicts)


def bisect(chain: list[str], bad) -> str | None:
    """The first commit for which ``bad(commit)`` holds, if it goes on holding; a binary search."""
    low, high = 0, len(chain)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if bad(chain[mid]) else (mid + 1, high)
    return chain[low] if low < len(chain) else None
