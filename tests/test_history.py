import random

import pytest
from palimpsest.functions.terms import BNODE, Const, I, L
from palimpsest.history import algebra
from palimpsest.history.repository import Conflict, Repository, clone, commit_id
from palimpsest.operators import canon, update
from palimpsest.plans.graph import DEFAULT, Graph, Var
from palimpsest.streaming import changes

from .test_graph import ex, table

A, B, C, ROLE = ex("alice"), ex("bob"), ex("carol"), ex("role")


def content(quads):
    return sorted((r.s.lex.rsplit("/")[-1], r.o.lex, r.g.lex) for r in quads.collect())


@pytest.fixture()
def repo(spark, tmp_path):
    """Three commits: two roles; a promotion and carol; bob leaves."""
    r = Repository(spark, str(tmp_path / "repo"))
    r.first = r.update("main", lambda q: update.insert_data(q, table(spark, [(A, ROLE, L("Engineer")), (B, ROLE, L("Designer"))])), message="one")
    who = Var("o")
    r.second = r.update("main", lambda q: update.modify(q, Graph(q).bgp((A, ROLE, who)), delete=[(A, ROLE, who)], insert=[(A, ROLE, L("Lead")), (C, ROLE, L("Engineer"))]), message="two")
    r.third = r.update("main", lambda q: update.remove(q, s=B), message="three")
    return r


def test_commits_and_time_travel(repo, spark):
    assert content(repo.at(repo.first)) == [("alice", "Engineer", ""), ("bob", "Designer", "")]
    assert content(repo.at(repo.second)) == [("alice", "Lead", ""), ("bob", "Designer", ""), ("carol", "Engineer", "")]
    assert content(repo.head("main")) == [("alice", "Lead", ""), ("carol", "Engineer", "")]
    assert [r.message for r in repo.log("main").orderBy("seq").collect()] == ["one", "two", "three"]
    assert repo.update("main", lambda q: update.insert_data(q, table(spark, [(A, ROLE, L("Lead"))]))) is None
    assert sorted((r.op, r.s.lex[-3:], r.o.lex) for r in repo.diff(repo.first, repo.second).collect()) == [(-1, "ice", "Engineer"), (1, "ice", "Lead"), (1, "rol", "Engineer")]
    assert content(update.apply(repo.at(repo.third), repo.diff(repo.third, repo.first))) == content(repo.at(repo.first))
    repo.tag("v1", repo.first)
    with pytest.raises(Conflict):
        repo.tag("v1", repo.second)
    assert content(repo.at("v1")) == content(repo.at(repo.first)) and repo.resolve(repo.commit(repo.second).ts) == repo.second
    repo.checkpoint(repo.second)
    assert content(repo.at("main")) == [("alice", "Lead", ""), ("carol", "Engineer", "")]
    repo.revert("main", repo.first)
    assert content(repo.head("main")) == content(repo.at(repo.first))
    assert commit_id("t", ["a", "b"], "x", "m") != commit_id("t", ["b", "a"], "x", "m")
    with pytest.raises(ValueError):
        repo.ref("../x")


def test_compare_and_set(repo):
    version = repo._version("main")
    repo.set_ref("main", repo.second, version)
    with pytest.raises(Conflict):
        repo.set_ref("main", repo.first, version)


def test_merge_blame_bisect_provenance(repo, spark):
    repo.branch("side", repo.second)
    repo.update("side", lambda q: update.insert_data(q, table(spark, [(ex("dan"), ROLE, L("Intern"), I("urn:g"))])), message="side", prefixes={"ex": "urn:ex"})
    assert repo.merge_base("main", "side") == repo.second and repo.is_ancestor(repo.first, "side")
    done = repo.merge("main", "side")
    assert repo.commit(done).parents[0] == repo.third and len(repo.commit(done).parents) == 2
    assert content(repo.head("main")) == [("alice", "Lead", ""), ("carol", "Engineer", ""), ("dan", "Intern", "urn:g")]
    assert repo.prefixes("main") == {"ex": "urn:ex"} and repo.merge("main", "side") is None
    chain = repo.chain("main")
    assert {(r.s.lex[-3:], r.o.lex): chain.index(r.commit) for r in repo.blame("main").collect()} == {("ice", "Engineer"): 0, ("bob", "Designer"): 0, ("ice", "Lead"): 1, ("rol", "Engineer"): 1, ("dan", "Intern"): 3}
    assert len(repo.provenance("main").collect()) == 3
    assert repo.bisect("main", lambda q: q.where("s.lex like '%carol'").count() > 0) == repo.second
    repo.branch("old", repo.first)
    repo.update("old", lambda q: update.insert_data(q, table(spark, [(C, ROLE, L("Boss"))])), message="old")
    repo.merge("old", "main", how="squash")
    assert len(repo.commit(repo.ref("old")).parents) == 1 and repo.ref("main") == repo.ref("old")


def test_sync_and_vacuum(repo, spark, tmp_path):
    copy = clone(spark, repo, str(tmp_path / "copy"))
    assert content(copy.head("main")) == content(repo.head("main"))
    copy.update("main", lambda q: update.insert_data(q, table(spark, [(B, ROLE, L("Back"))])), message="back")
    copy.push(repo, "main")
    assert content(repo.head("main")) == content(copy.head("main"))
    repo.revert("main", repo.second)
    repo.update("main", lambda q: update.insert_data(q, table(spark, [(ex("eve"), ROLE, L("New"))])), message="eve")
    with pytest.raises(Conflict):
        copy.push(repo, "main")
    copy.pull(repo, "main")
    assert ("eve", "New", "") in content(copy.head("main"))
    assert len(repo.vacuum(age=0)) == 2 and content(repo.head("main"))


def test_change_feed(repo, spark, tmp_path):
    seen = []
    changes.sink(changes.change_feed(spark, repo), lambda df, _: seen.extend((r.op, r.o.lex) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [(-1, "Designer"), (-1, "Engineer"), (1, "Designer"), (1, "Engineer"), (1, "Engineer"), (1, "Lead")]
    repo.update("main", lambda q: update.remove(q, s=C), message="four")
    del seen[:]
    changes.sink(changes.change_feed(spark, repo), lambda df, _: seen.extend((r.op, r.o.lex) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(-1, "Engineer")]


@pytest.mark.parametrize("seed", range(2))
def test_laws(spark, seed):
    rng = random.Random(seed)
    some = lambda: table(spark, [(ex(f"s{i}"), ROLE, L(i)) for i in rng.sample(range(20), 9)] + [(ex("s0"), ROLE, L(0), I("urn:g"))])
    base, one, two = some(), some(), some()
    assert content(update.apply(one, algebra.difference(one, two))) == content(two)
    assert content(algebra.merge_three_way(base, one, two)) == content(algebra.merge_three_way(base, two, one))
    assert content(algebra.merge_three_way(base, one, base)) == content(one)
    assert algebra.merge_prefixes({"a": "1"}, {"a": "2"}, {"a": "3"})[1] == ["a"]
    assert algebra.merge_prefixes({"a": "1", "b": "1"}, {"a": "1", "b": "2"}, {"b": "1"}) == ({"b": "2"}, [])


def blanks(spark, edges, names):
    b = lambda i: Const(BNODE, names[i])
    return table(spark, [(b(i), ex("p"), b(j)) for i, j in edges] + [(b(0), ex("q"), L("x"))])


@pytest.mark.parametrize("edges", [[(0, 1), (1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (0, 0)], [(0, 1), (0, 2), (1, 3), (2, 3)]])
def test_canonical_labels_do_not_depend_on_names(spark, edges):
    n = 1 + max(max(e) for e in edges)
    rng = random.Random(4)
    forms = set()
    for _ in range(3):
        names = [f"n{i}" for i in rng.sample(range(100), n)]
        got = canon.canonicalize(blanks(spark, edges, names)).collect()
        assert len(got) == len(edges) + 1
        forms.add(tuple(sorted((r.s.lex, r.p.lex, r.o.lex) for r in got)))
    assert len(forms) == 1


def test_canonical_cascade(spark):
    assert canon.cascade(blanks(spark, [(0, 1), (1, 2)], ["a", "b", "c"]))[0] in ("first", "second")
    assert canon.cascade(blanks(spark, [(1, 2), (2, 3), (3, 1)], ["a", "b", "c", "d"]))[0] == "full"
    with pytest.raises(Exception, match="blank nodes"):
        ring = [(i, j) for i in range(1, 8) for j in range(1, 8) if i != j]
        canon.canonicalize(blanks(spark, ring, [f"k{i}" for i in range(8)]), budget=50).collect()
    assert DEFAULT.value == ""
