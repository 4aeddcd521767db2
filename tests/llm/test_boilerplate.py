import random
from collections import Counter

import pytest
from palimpsest.llm.boilerplate import drop_boilerplate

from .helpers import SCHEMA


def brute(rows, ratio, least):
    pages, on = Counter(), Counter()
    for _, text, _, host, _ in rows:
        if host is not None:
            pages[host] += 1
            on.update((host, x) for x in {y.strip(" \t\r") for y in (text or "").split("\n")} if x)
    out = []
    for i, text, _, host, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if host is None or not (on[host, x.strip(" \t\r")] >= least and on[host, x.strip(" \t\r")] > ratio * pages[host])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_dropped_lines_match_brute_force(spark, limit):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        host = rng.choice(["hot", "hot", "hot", "b", None, ""])
        lines = [rng.choice(["menu", " menu\t", "", " ", "footer\r", "é", f"own {i}", f"rare {i % 40}"]) for _ in range(rng.randrange(7))]
        rows.append((rng.choice([i, None]), rng.choice(["\n".join(lines)] * 9 + [None]), None, host, None))
    rows += [rows[0], rows[0], (5, "menu\nfooter", None, "hot", None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as bad", "3 as pages", "4 as line", "5 as row", "6 as n_lines")
    got = drop_boilerplate(docs, ratio=0.2, least_pages=3, broadcast_hashes=limit).select("row.doc_id", "text", "n_lines", "n_dropped")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 0.2, 3)
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []
