"""Secret scan: candidate strings, and a random forest that takes out false positives.

Candidates, features and the forest's votes are DataFrame expressions.  The
forest is small and fitted on the driver from labelled findings, whose features
come from the same expressions; it goes into a query as a literal.  One feature
is learned itself: how much likelier a candidate's pairs of neighbouring
characters are in secrets than in other findings.

Candidates are runs of 16 characters or more; shorter passwords, and what keys
in PEM blocks say beyond their base64 lines, are not looked at.
"""

from __future__ import annotations

import json
import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a candidate consists of, and words of its neighbourhood.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
DICTIONARY = "access account address apache application archive array assert author backup bool branch buffer build cache certificate change class client code commit common config connection console content context control copy count create current data database date debug default delete description detail device directory document domain download element email enable engine entity error event example exception export false file filter folder format function general group handler header height hidden history host html http identifier image import index info input instance integer interface internal item java json language layout length library license line linux list local location login main manager memory message method model module name network node null number object option order output package page param parent password path pattern place plugin point policy port prefix private process product profile project property protocol proxy public python query queue read record reference release remote remove report request resource response result return root sample schema script search section secret select server service session setting source space spark start state status storage store stream string style submit success support system table target task template test text thread time title token total trace transfer true type union update upload user util value variable version view visible warning width window write your".split()
SECRET_WORDS = "(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private|access)"
HARMLESS_WORDS = "(?i)(sha|md5|commit|checksum|digest|hash|uuid|guid|revision|isbn|order|example|phone|card|account|version|path|file|see)"

#: Labelled findings and size of the forest.
FINDINGS, TREES, DEPTH, LEAST_LEAF = 3000, 25, 7, 4
#: Share of trees from which a candidate counts as a secret.
VOTES = 0.5
#: Words before and after a candidate that features look at.
BEFORE, AFTER = 3, 2

#: Kinds of characters in pairs: letters in either case, digits, others; findings added to each pair's count.
KINDS, PRIOR = 28, 2.0
NAMES = ("length", "transitions", "pairs", "digits", "uppers", "distinct", "dictionary", "letters_run", "slashes", "path", "assigned", "secret_word", "harmless_word")


def findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates with their neighbourhood: doc_id, line, word (numbers from 0), before, own, after, candidate.

    ``own`` is the whole word that the candidate stands in.  Rows of ``docs``
    without a candidate, or with a null text, give none; repeated rows repeat
    theirs.  Only lines with a candidate are taken apart.
    """
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.cast("long").alias("line"), x.alias("body")))
    hit = docs.where(F.col(text_col).rlike(CANDIDATE)).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.filter(lines, lambda x: x.body.rlike(CANDIDATE))).alias("at"))
    words = hit.select("doc_id", F.col("at.line").alias("line"), F.split(F.trim(F.regexp_replace("at.body", r"\s+", " ")), " ").alias("words"))
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("word"), w.alias("own")))
    each = words.select("doc_id", "line", "words", F.explode(F.filter(numbered, lambda w: w.own.rlike(CANDIDATE))).alias("at"))
    word = F.col("at.word")
    return each.select(
        "doc_id",
        "line",
        word.cast("long").alias("word"),
        F.array_join(F.slice("words", F.greatest(word - BEFORE, F.lit(0)) + 1, F.least(word, F.lit(BEFORE))), " ").alias("before"),
        F.col("at.own").alias("own"),
        F.array_join(F.slice("words", word + 2, AFTER), " ").alias("after"),
        F.explode(F.regexp_extract_all("at.own", F.lit(f"({CANDIDATE})"))).alias("candidate"),
    )


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def fit_pairs(candidates: list[str], labels: list[int]) -> list[float]:
    """Log ratios of secrets' and other findings' shares of each pair of neighbouring characters, row by row."""
    counts = np.full((2, KINDS * KINDS), PRIOR)
    for candidate, label in zip(candidates, labels):
        kind = [ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27 for c in candidate.lower()]
        for a, b in zip(kind, kind[1:]):
            counts[label, a * KINDS + b] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0]).tolist()


def _pairs(candidate: Column, table: list[float]) -> Column:
    """Mean log ratio of a candidate's pairs."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    folded = F.translate(F.lower(candidate), "0123456789+/_=-", "{" * 10 + "|" * 5)
    kinds, n = F.transform(F.split(folded, ""), lambda c: F.ascii(c) - 97), F.length(candidate) - 1
    each = F.zip_with(F.slice(kinds, 1, n), F.slice(kinds, 2, n), lambda a, b: F.get(ratios, a * KINDS + b))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n


def features(pairs: list[float]) -> Column:
    """Array of doubles in the order of NAMES, from before, own, after, candidate; ``pairs`` as ``fit_pairs`` has them."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: 1 - _left(c, pattern) / n
    # a transition is a place where the kind of character changes
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003"), "[^\u0001\u0002\u0003]+", "\u0004")
    covered = share("(?i)(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w))) + ")")
    run = F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), F.length)) / n
    path = F.col("own").rlike(r"(://|www\.|^\.{0,2}/|\.[a-z]{2,4}[)\"',;.]?$)")
    near = F.concat_ws(" ", "before", F.regexp_replace("own", F.lit(CANDIDATE), F.lit(" ")))
    assigned = near.rlike(r"[=:]\s*[\"'`]?\s*$") | near.rlike(r"[=:]\s*[\"'`]")
    number = lambda x: x.cast("double")
    return F.array(
        n,
        number(F.length(kinds) - 1) / n,
        _pairs(c, pairs),
        share("[0-9]"),
        share("[A-Z]"),
        number(F.size(F.array_distinct(F.split(c, "")))) / n,
        covered,
        number(run),
        number(n - _left(c, "/")),
        number(path),
        number(assigned),
        number(F.concat_ws(" ", "before", "own").rlike(SECRET_WORDS)),
        number(F.concat_ws(" ", "before", "after").rlike(HARMLESS_WORDS)),
    )


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[dict]:
    """A bounded set of labelled findings, from rules for what secrets and their look-alikes look like."""
    rng = random.Random(seed)
    pick = rng.choice
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda chars, k: "".join(pick(chars) for _ in range(k))
    syllables = ["er", "th", "an", "ion", "ung", "eit", "que", "eau", "ción", "mente", "in", "re", "on", "en", "st"]
    syllables += ["sch", "pf", "tz", "ge", "be", "ver", "zu", "lich", "keit", "ch", "str", "kl", "gr", "lou", "tre", "ba", "do", "mi", "qua", "ly"]
    prose = lambda: "".join(pick(syllables) for _ in range(rng.randrange(1, 4)))
    around = lambda k: [prose() + pick(["", "", ",", "."]) for _ in range(k)]
    out = []
    for i in range(n):
        before, after = around(rng.randrange(4)), around(rng.randrange(3))
        if i % 2:
            kind = rng.randrange(6)
            own = [text(hexes, pick([32, 40, 64])), text(alnum + "+/", pick([24, 40, 44])), "AKIA" + text(alnum[:26] + "0123456789", 16), "ghp_" + text(alnum, 36), "sk-" + text(alnum, pick([32, 48])), text(alnum + "_-", pick([20, 28, 36]))][kind]
            if kind == 0 and rng.random() < 0.3:
                own = own.upper()
            key = pick(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "TOKEN", "Secret"])
            style = rng.randrange(6)
            if kind in (2, 3) and rng.random() < 0.3:
                candidate = own
            elif style == 0:
                before, candidate, own = before + [key, pick(["=", ":", ":="])], own, pick(['"', "'", ""]) + own
                own += own[0] if own[0] in "\"'" else ""
            elif style == 1:
                candidate, own = own, f'{key}{pick([":", "=\x22", "=\x27"])}{own}'
            elif style == 2:
                before, candidate = before + ["Authorization:", "Bearer"], own
            elif style == 3:
                before, candidate, own = before + [f"{key}:"], own, own + pick(["", ",", ";", "###", "!!"])
            elif style == 4:
                before, candidate, own = before + [key + pick(["###", "!!", "$$$", ""]), "=" + pick(["", "###", "!!"])], own, f'"{own}"' + pick(["", "###", "!!"])
            else:
                before, candidate = before + ["the", key, "is"], own
            label = 1
        else:
            kind = rng.randrange(9)
            label, word = 0, DICTIONARY
            if kind == 0:
                own = candidate = text("0123456789", pick([16, 16, 18, 20]))
            elif kind == 1:
                own = candidate = "".join(pick([s for s in syllables if s.isascii()]) for _ in range(rng.randrange(9, 16)))
                shape = rng.random()
                own = candidate = candidate.upper() if shape < 0.3 else candidate.capitalize() if shape < 0.5 else candidate
            elif kind == 2:
                own = candidate = "-".join(text(hexes, k) for k in (8, 4, 4, 4, 12))
                before += [pick(["id", "uuid", "uuid:", "request"])]
            elif kind == 3:
                own = candidate = text(hexes, pick([40, 64, 32]))
                before += [pick(["commit", "sha256", "checksum:", "md5", "revision", "digest:"])]
            elif kind == 4:
                own = candidate = "/" + "/".join(pick(word) for _ in range(rng.randrange(3, 6)))
                own += pick(["", ".py", ".txt", ".md"])
            elif kind == 5:
                candidate = "com/" + "/".join(pick(word) for _ in range(rng.randrange(3, 5)))
                own = "https://www." + pick(word) + "." + candidate
            elif kind == 6:
                own = candidate = pick(["_", "-", ""]).join(pick(word) if rng.random() < 0.6 else pick(word).capitalize() for _ in range(rng.randrange(3, 6)))
                if rng.random() < 0.4:
                    before += [pick(["token", "password", "secret"]), "="]
            elif kind == 7:
                own = candidate = pick("=-_x0") * rng.randrange(16, 60)
            else:
                own = candidate = pick(["your_token_here_", "example_password_", "insert_secret_key_", "replace-with-token-"]) + pick("x0") * rng.randrange(0, 12)
                before += [pick(["token", "password", "secret"]), pick(["=", ":"])]
            if len(candidate) < 16:
                own, candidate = own + "_" * (16 - len(candidate)), candidate + "_" * (16 - len(candidate))
        out.append({"before": " ".join(before[-BEFORE:]), "own": own, "after": " ".join(after[:AFTER]), "candidate": candidate, "label": label})
    return out


class Tree(NamedTuple):
    feature: list[int]  # -1 at a leaf
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]  # share of secrets


def fit_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Tree:
    """A tree by Gini impurity, with a random subset of features at each split."""
    tree = Tree([], [], [], [], [])

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(tree.feature)
        share = float(y[rows].mean())
        for part, value in zip(tree, (-1, 0.0, at, at, share)):
            part.append(value)
        if level == depth or share in (0.0, 1.0) or len(rows) < 2 * least:
            return at
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            value, ones = x[rows, f][order], np.cumsum(y[rows][order])
            n = np.arange(1, len(rows))
            here = (value[1:] > value[:-1]) & (n >= least) & (len(rows) - n >= least)
            if here.any():
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(rows) - n)
                cost = np.where(here, a * (1 - a) * n + b * (1 - b) * (len(rows) - n), np.inf)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (cost[i], int(f), float((value[i] + value[i + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            tree.feature[at], tree.threshold[at] = best[1], best[2]
            tree.left[at] = grow(rows[low], level + 1)
            tree.right[at] = grow(rows[~low], level + 1)
        return at

    grow(np.arange(len(y)), 0)
    return tree


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_LEAF, seed: int = 5) -> list[Tree]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(fit_tree(x[rows], y[rows], rng, depth, least))
    return out


class Forest(NamedTuple):
    trees: list[Tree]
    pairs: list[float]


def train(spark: SparkSession, labelled: list[dict] | None = None) -> Forest:
    """A forest from at most ``FINDINGS`` labelled findings (before, own, after, candidate, label).

    Pairs of characters are learned from one half, trees from the other, so that
    trees see pairs of findings that these weren't fitted on.
    """
    rows = (labelled or labelled_findings())[:FINDINGS]
    first = [i for i in range(len(rows)) if i // 2 % 2 == 0]
    pairs = fit_pairs([rows[i]["candidate"] for i in first], [rows[i]["label"] for i in first])
    kind = "array<struct<before string, own string, after string, candidate string, label int>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([r for i, r in enumerate(rows) if i // 2 % 2])), kind)))
    got = table.select(features(pairs).alias("x"), "label").collect()
    return Forest(fit_forest(np.array([r.x for r in got]), np.array([r.label for r in got], float)), pairs)


def vote(trees: list[Tree], x: Column, depth: int = DEPTH) -> Column:
    """Mean share of secrets in the leaves that the features lead to."""
    kind = "array<struct<feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>>>"
    all_trees = F.from_json(F.lit(json.dumps([t._asdict() for t in trees])), kind)

    def leaf(t: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            f = F.get(t.feature, at)
            return F.when(f < 0, at).when(F.get(x, f) <= F.get(t.threshold, at), F.get(t.left, at)).otherwise(F.get(t.right, at))

        return F.get(t.value, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))

    return F.aggregate(F.transform(all_trees, leaf), F.lit(0.0), lambda a, v: a + v) / float(len(trees))


def scan(docs: DataFrame, *, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", votes: float = VOTES) -> DataFrame:
    """Every candidate of every row: doc_id, line, word, candidate, score, secret."""
    forest = forest or train(docs.sparkSession)
    found = findings(docs, id_col=id_col, text_col=text_col).withColumn("x", features(forest.pairs))
    score = F.round(vote(forest.trees, F.col("x")), 6)
    return found.select("doc_id", "line", "word", "candidate", score.alias("score")).withColumn("secret", F.col("score") >= votes)
