"""A versioned set of quads in a folder of any Hadoop file system.

``deltas/commit=<id>`` holds a commit's changes as Parquet, ``commits/<id>`` its
metadata, ``checkpoints/<id>`` a full snapshot of some commits, ``refs/`` and
``tags/`` names.  Data is written first and a ref last, by an exclusive create of the
next version of that ref, so that of two writers one fails and a crash leaves
only garbage for ``vacuum``.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import canon
from ..operators.update import QUAD
from ..plans.graph import DEFAULT, TASK_ROWS, const_filter
from . import algebra

NAME = re.compile(r"[A-Za-z0-9_./-]{1,128}")
#: Commits between full snapshots.
CHECKPOINT_EVERY = 20
#: Seconds for which data without a ref may be a writer's that is still at work.
VACUUM_AGE = 24 * 3600.0
DELTA = f"op tinyint, s {T.TERM}, p {T.TERM}, o {T.TERM}, g {T.TERM}"


class Conflict(Exception):
    """Another writer moved the ref, or a merge can't decide."""


class Files:
    """Small text files through Hadoop's FileSystem, which reaches whatever Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def create(self, p: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            out = self.fs.create(self.path(p), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        data = bytes(stream.readAllBytes())
        stream.close()
        return data.decode()

    def names(self, p: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength() if self.exists(p) else 0


class TooLarge(Exception):
    """What is to be fetched or pushed is beyond the limits; nothing was copied."""


@dataclass(frozen=True)
class SyncLimits:
    """What one fetch or push may copy; None is no limit."""

    commits: int | None = None
    bytes: int | None = None


@dataclass
class Commit:
    id: str
    tree: str
    parents: list[str]
    author: str
    message: str
    ts: float
    prefixes: dict = field(default_factory=dict)
    generation: int = 1  # one more than the parents' largest
    depth: int = 1  # commits of the chain of first parents


def commit_id(tree: str, parents: list[str], author: str, message: str) -> str:
    """The time takes no part; the parents' order does."""
    return hashlib.sha256(json.dumps(["commit", tree, parents, author, message]).encode()).hexdigest()


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root.rstrip("/"))
        self._commits: dict[str, Commit] = {}  # commits never change
        self.listeners: list = []  # called with a commit and its delta once the ref has moved

    # names
    def _check(self, name: str) -> str:
        if not NAME.fullmatch(name) or ".." in name:
            raise ValueError(f"not a ref name: {name!r}")
        return name.replace("/", "%2F")

    def ref(self, branch: str) -> str | None:
        versions = [int(v) for v in self.files.names(f"refs/{self._check(branch)}") if v.isdigit()]
        return (json.loads(self.files.read(f"refs/{self._check(branch)}/{max(versions)}"))["commit"] or None) if versions else None

    def _version(self, branch: str) -> int:
        return max([int(v) for v in self.files.names(f"refs/{self._check(branch)}") if v.isdigit()], default=0)

    def set_ref(self, branch: str, commit: str | None, expected: int | None = None) -> None:
        """Compare and set: fails if the ref has moved on from version ``expected``."""
        version = self._version(branch) if expected is None else expected
        if not self.files.create(f"refs/{self._check(branch)}/{version + 1}", json.dumps({"commit": commit})):
            raise Conflict(f"{branch} has moved")

    def branches(self) -> list[str]:
        return [b for b in (x.replace("%2F", "/") for x in self.files.names("refs")) if self.ref(b)]

    def tag(self, name: str, commit: str, message: str = "") -> None:
        if not self.files.create(f"tags/{self._check(name)}", json.dumps({"commit": commit, "message": message})):
            raise Conflict(f"tag {name} is there already")

    def tags(self) -> dict[str, str]:
        return {n.replace("%2F", "/"): json.loads(self.files.read(f"tags/{n}"))["commit"] for n in self.files.names("tags")}

    def delete_tag(self, name: str) -> None:
        self.files.delete(f"tags/{self._check(name)}")

    # commits
    def commit(self, id_: str) -> Commit:
        if id_ not in self._commits:
            self._commits[id_] = Commit(**json.loads(self.files.read(f"commits/{id_}")))
        return self._commits[id_]

    def resolve(self, at: str | float) -> str:
        """A commit by id, branch, tag, or the latest of ``main`` not after a time in seconds."""
        if isinstance(at, (int, float)):
            old = [c for c in self.history("main") if c.ts <= at]
            if not old:
                raise KeyError(at)
            return old[-1].id
        found = self.ref(at) if NAME.fullmatch(at) else None
        found = found or self.tags().get(at) or (at if self.files.exists(f"commits/{at}") else None)
        if not found:
            raise KeyError(at)
        return found

    def chain(self, at: str) -> list[str]:
        """First parents, oldest first."""
        out, here = [], self.resolve(at)
        while here:
            out.append(here)
            parents = self.commit(here).parents
            here = parents[0] if parents else None
        return out[::-1]

    def history(self, at: str) -> list[Commit]:
        return [self.commit(c) for c in self.chain(at)]

    def log(self, at: str) -> DataFrame:
        rows = [(c.id, c.parents, c.author, c.message, i) for i, c in enumerate(self.history(at))]
        return self.spark.createDataFrame(rows, "id string, parents array<string>, author string, message string, seq long")

    def _old(self, p: str, age: float) -> bool:
        """Whether a file or folder was last changed more than ``age`` seconds ago."""
        return time.time() - self.files.fs.getFileStatus(self.files.path(p)).getModificationTime() / 1000 >= age

    def ancestors(self, id_: str) -> set[str]:
        seen, todo = set(), [id_]
        while todo:
            if (here := todo.pop()) not in seen:
                seen.add(here)
                todo += self.commit(here).parents
        return seen

    def is_ancestor(self, one: str, other: str) -> bool:
        """Commits of a smaller generation than ``one`` can't lead to it and aren't looked at."""
        wanted, least = self.resolve(one), self.commit(self.resolve(one)).generation
        seen, todo = set(), [self.resolve(other)]
        while todo:
            if (here := todo.pop()) == wanted:
                return True
            if here not in seen and self.commit(here).generation > least:
                seen.add(here)
                todo += self.commit(here).parents
        return False

    def merge_base(self, one: str, other: str) -> str | None:
        """The common ancestor that no other one descends from; of several, the latest."""
        common = self.ancestors(self.resolve(one)) & self.ancestors(self.resolve(other))
        below = {p for c in common for p in self.commit(c).parents}  # common ancestors are closed under parents
        return max(common - below, key=lambda c: (self.commit(c).ts, c), default=None)

    # states
    def deltas(self, commits: list[str] | None = None) -> DataFrame:
        """``commit, op, s, p, o, g``; read with a fixed schema, so nothing is inferred."""
        df = self.spark.read.schema(f"{DELTA}, commit string").parquet(f"{self.root}/deltas")
        return df if commits is None else df.where(F.col("commit").isin(commits))

    def at(self, at: str | float) -> DataFrame:
        """The quads at a commit: the nearest full snapshot and the deltas since."""
        chain = self.chain(self.resolve(at))
        full = set(self.files.names("checkpoints"))
        start = max((i for i, c in enumerate(chain) if c in full), default=-1)
        since = chain[start + 1 :]
        if start < 0:
            return algebra.snapshot(self.deltas(since), since)
        base = self.spark.read.parquet(f"{self.root}/checkpoints/{chain[start]}")
        if not since:
            return base
        whole = base.select(F.lit(chain[start]).alias("commit"), F.lit(1).cast("tinyint").alias("op"), *QUAD)
        return algebra.snapshot(whole.unionByName(self.deltas(since).select("commit", "op", *QUAD)), [chain[start], *since])

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], DELTA).select(*QUAD)

    def head(self, branch: str) -> DataFrame:
        return self.at(branch) if self.ref(branch) else self.empty()

    def prefixes(self, at: str) -> dict:
        return self.commit(self.resolve(at)).prefixes

    def namespaces(self, at: str) -> DataFrame:
        """``prefix, name``."""
        return self.spark.createDataFrame(sorted(self.prefixes(at).items()), "prefix string, name string")

    def set_prefixes(self, branch: str, changes: dict[str, str | None], **about) -> str | None:
        """Commits changed namespaces; a prefix with None goes."""
        now = {**(self.prefixes(branch) if self.ref(branch) else {}), **changes}
        return self.write(branch, self.spark.createDataFrame([], DELTA), prefixes={k: v for k, v in now.items() if v is not None}, **about)

    # writes
    def write(self, branch: str, delta: DataFrame, *, author: str = "", message: str = "", extra_parents: list[str] | None = None, prefixes: dict | None = None) -> str | None:
        """Commits a net delta; None if it is empty and nothing else changes (a first commit always counts)."""
        version, parent = self._version(branch), self.ref(branch)
        staged = f"{self.root}/staging/{hashlib.sha256(f'{branch}{version}{time.time_ns()}'.encode()).hexdigest()}"
        delta.select("op", *QUAD).write.parquet(staged)
        written = self.spark.read.schema(DELTA).parquet(staged)
        sums = written.agg(F.count("*").alias("n"), F.sum(F.xxhash64("op", *[F.col(c)["id"] for c in QUAD]).cast("decimal(38,0)")).alias("h")).first()
        old = self.commit(parent).prefixes if parent else {}
        prefixes = old if prefixes is None else prefixes
        if not sums.n and parent and not extra_parents and prefixes == old:
            self.files.delete(staged.removeprefix(f"{self.root}/"))
            return None
        parents = [*([parent] if parent else []), *(extra_parents or [])]
        tree = hashlib.sha256(json.dumps([self.commit(parent).tree if parent else "", sums.n, str(sums.h), sorted(prefixes.items())]).encode()).hexdigest()
        id_ = commit_id(tree, parents, author, message)
        fs, path = self.files.fs, self.files.path
        fs.mkdirs(path("deltas"))
        here = staged.removeprefix(f"{self.root}/")
        if self.files.exists(f"deltas/commit={id_}"):
            self.files.delete(here)
        elif not fs.rename(path(here), path(f"deltas/commit={id_}")) and not self.files.exists(f"deltas/commit={id_}"):
            raise OSError(f"{staged} couldn't be moved to its commit")
        above = [self.commit(p) for p in parents]
        about = Commit(id_, tree, parents, author, message, time.time(), prefixes, 1 + max((c.generation for c in above), default=0), 1 + (above[0].depth if above else 0))
        self.files.create(f"commits/{id_}", json.dumps(asdict(about)))
        self.set_ref(branch, id_, version)
        if about.depth % CHECKPOINT_EVERY == 0:
            self.checkpoint(id_)
        for tell in self.listeners:
            tell(about, self.deltas([id_]).select("op", *QUAD))
        return id_

    def write_canonical(self, branch: str, delta: DataFrame, **about) -> str | None:
        """The same with canonical labels for the blank nodes of added quads; literals stay literals.

        Removed quads name blank nodes as the repository has them.
        """
        added = canon.canonicalize(delta.where("op = 1").select(*QUAD)).select(F.lit(1).cast("tinyint").alias("op"), *QUAD)
        return self.write(branch, added.unionByName(delta.where("op = -1").select("op", *QUAD)), **about)

    def checkpoint(self, at: str) -> None:
        id_ = self.resolve(at)
        if id_ not in self.files.names("checkpoints"):
            self.at(id_).write.mode("overwrite").parquet(f"{self.root}/checkpoints/{id_}")

    def update(self, branch: str, change, **about) -> str | None:
        """Commits ``change(quads)``, a function of ``operators.update``, on the branch's head."""
        return self.write(branch, change(self.head(branch)), **about)

    def branch(self, name: str, at: str) -> None:
        self.set_ref(name, self.resolve(at))

    def revert(self, branch: str, at: str) -> None:
        """Moves the branch to another commit; history stays."""
        self.set_ref(branch, self.resolve(at))

    # merges
    def diff(self, before: str | None, after: str) -> DataFrame:
        """A commit's own delta where ``before`` is its first parent, else the states' difference."""
        id_ = self.resolve(after)
        parents = self.commit(id_).parents
        if (before is None and not parents) or (before and parents and self.resolve(before) == parents[0]):
            return self.deltas([id_]).select("op", *QUAD)
        return algebra.difference(self.at(before) if before else self.empty(), self.at(id_))

    def merge(self, target: str, source: str, *, how: str = "three_way", author: str = "", message: str = "merge") -> str | None:
        """Merges a branch; ``how`` is three_way, union or squash.  None if there is nothing to merge."""
        theirs, mine = self.resolve(source), self.resolve(target)
        if theirs in self.ancestors(mine):
            return None
        base = self.merge_base(mine, theirs)
        start = self.at(base) if base else self.empty()
        prefixes, conflicts = algebra.merge_prefixes(self.commit(base).prefixes if base else {}, self.commit(mine).prefixes, self.commit(theirs).prefixes)
        if conflicts:
            raise Conflict(f"prefixes {', '.join(conflicts)}")
        merged = algebra.merge_union(self.at(mine), self.at(theirs)) if how == "union" else algebra.merge_three_way(start, self.at(mine), self.at(theirs))
        delta = algebra.difference(self.at(mine), merged)
        done = self.write(target, delta, author=author, message=message, extra_parents=[] if how == "squash" else [theirs], prefixes=prefixes)
        if how == "squash" and done:
            self.set_ref(source, done)
        return done

    def bisect(self, branch: str, bad) -> str | None:
        """First commit of the chain whose quads make ``bad`` true, for a predicate that stays true."""
        return algebra.bisect(self.chain(branch), lambda c: bad(self.at(c)))

    def blame(self, at: str) -> DataFrame:
        chain = self.chain(at)
        return algebra.blame(self.deltas(chain), chain)

    def provenance(self, at: str) -> DataFrame:
        chain = self.chain(at)
        return algebra.first_seen(self.deltas(chain), chain, self.at(at))

    def lookup(self, at: str, s: T.Const, p: T.Const, o: T.Const, g: T.Const = DEFAULT) -> DataFrame:
        """Provenance of one quad at a commit: the commit of its first-parent chain that brought it; no row if it isn't there.

        The constants go to the scans of the deltas before anything else.
        """
        chain = self.chain(at)
        own = self.deltas(chain).where(const_filter("s", s) & const_filter("p", p) & const_filter("o", o) & const_filter("g", g))
        return algebra.first_seen(own, chain, algebra.snapshot(own, chain)).select("commit")

    # other repositories
    def add_remote(self, name: str, root: str) -> None:
        if not self.files.create(f"remotes/{self._check(name)}", json.dumps({"root": root})):
            raise Conflict(f"remote {name} is there already")

    def remotes(self) -> dict[str, str]:
        return {n.replace("%2F", "/"): json.loads(self.files.read(f"remotes/{n}"))["root"] for n in self.files.names("remotes")}

    def remove_remote(self, name: str) -> None:
        self.files.delete(f"remotes/{self._check(name)}")

    def remote(self, name: str) -> Repository:
        return Repository(self.spark, self.remotes()[name])

    def _copy_commits(self, other: Repository, wanted: set[str], without: list[T.Const] | None = None, limits: SyncLimits = SyncLimits()) -> None:
        """Copies commits that are missing here; distributed, data before metadata."""
        missing = [c for c in wanted if not self.files.exists(f"commits/{c}")]
        if limits.commits is not None and len(missing) > limits.commits:
            raise TooLarge(f"{len(missing)} commits")
        if limits.bytes is not None:
            size = sum(other.files.size(f"deltas/commit={c}") for c in missing)
            if size > limits.bytes:
                raise TooLarge(f"{size} bytes")
        if missing:
            df = other.deltas(missing)
            if without:
                df = df.where(~F.col("g")["lex"].isin([g.value for g in without]))
            # small tasks of a few commits each: a task sorts its rows by commit before it writes them
            df = df.repartitionByRange(df.count() // TASK_ROWS + 1, "commit", F.col("s")["id"]["a"])
            df.write.mode("append").partitionBy("commit").parquet(f"{self.root}/deltas")
            have = set(self.files.names("deltas"))
            for c in missing:
                if f"commit={c}" not in have:
                    self.spark.createDataFrame([], DELTA).write.parquet(f"{self.root}/deltas/commit={c}")
                self.files.create(f"commits/{c}", other.files.read(f"commits/{c}"))

    def fetch(self, other: Repository, branch: str, remote: str = "origin", limits: SyncLimits = SyncLimits()) -> str:
        tip = other.resolve(branch)
        self._copy_commits(other, other.ancestors(tip), limits=limits)
        self.set_ref(f"{remote}/{branch}", tip)
        return tip

    def push(self, other: Repository, branch: str, *, force: bool = False, without: list[T.Const] | None = None, limits: SyncLimits = SyncLimits()) -> None:
        """Fast-forward only, unless forced; commits first, the ref last."""
        tip, theirs, version = self.resolve(branch), other.ref(branch), other._version(branch)
        if theirs and not force and theirs not in self.ancestors(tip):
            raise Conflict(f"{branch} isn't a fast-forward")
        other._copy_commits(self, self.ancestors(tip), without, limits)
        other.set_ref(branch, tip, version)

    def pull(self, other: Repository, branch: str) -> str | None:
        tip = self.fetch(other, branch)
        if not self.ref(branch):
            self.set_ref(branch, tip)
            return tip
        if self.ref(branch) in self.ancestors(tip):
            self.set_ref(branch, tip)
            return tip
        return self.merge(branch, f"origin/{branch}")

    def vacuum(self, age: float = VACUUM_AGE) -> list[str]:
        """Removes data that no ref or tag leads to and that is at least ``age`` seconds old.

        A writer's data is there before its ref is, so the age has to be more than
        a write takes; younger garbage goes with a later call.
        """
        live = set().union(*[self.ancestors(self.ref(b)) for b in self.branches()], *[self.ancestors(c) for c in self.tags().values()])
        gone = [c for c in self.files.names("commits") if c not in live and self._old(f"commits/{c}", age)]
        for c in gone:
            for p in (f"commits/{c}", f"deltas/commit={c}", f"checkpoints/{c}"):
                self.files.delete(p)
        for d in self.files.names("deltas"):
            if d.startswith("commit=") and d.removeprefix("commit=") not in live and self._old(f"deltas/{d}", age):
                self.files.delete(f"deltas/{d}")
        for s in self.files.names("staging"):
            if self._old(f"staging/{s}", age):
                self.files.delete(f"staging/{s}")
        return gone


def clone(spark: SparkSession, source: Repository, root: str) -> Repository:
    out = Repository(spark, root)
    for b in source.branches():
        tip = out.fetch(source, b)
        out.set_ref(b, tip)
    return out


__all__ = ["Commit", "Conflict", "Repository", "SyncLimits", "TooLarge", "clone", "commit_id"]
