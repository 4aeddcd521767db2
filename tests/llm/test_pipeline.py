"""The pipeline's stages against brute force on a small corpus."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from . import test_boilerplate, test_decontaminate, test_jaccard_join
from .helpers import SCHEMA
from .test_language import text

LANGS = ["xx", "yy", "zz"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    rows, passage = [], "the quick brown fox jumps over the lazy dog near the river bank today"
    for i in range(120):
        lang = LANGS[i % 3]
        body = text(rng, lang, rng.randrange(30, 80))
        lines = [body, *(["subscribe to our newsletter now"] if i % 2 else [])]
        if i % 20 == 3:
            lines[0] = f"{body} {passage} {body[:9]}"
        rows.append((i, "\n".join(lines), lang, f"s{i % 2}", 0))
    for i in range(0, 30, 3):  # near copies, exact copies
        words = rows[i][1].split(" ")
        words[-1] = "changed"
        rows += [(200 + i, " ".join(words), rows[i][2], "s0", 0), (300 + i, rows[i][1], rows[i][2], "s1", 0)]
    rows += [(400, None, "xx", "s0", None), (401, "", None, None, 0), (402, "1234 ... 5678", None, "s0", 13), (5, rows[5][1], "zz", "s1", 0), (None, text(rng, "yy", 40), "yy", None, 0)]
    rows = [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage.upper()), (2, "nothing like it anywhere in these documents at all my dear friend")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def kept_rows(rows):
    """Brute force of all stages but the last."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    cleaned = {}
    for i, body, _, dropped in test_boilerplate.brute(rows, 0.02, 5):
        cleaned.setdefault(i, []).append((body, dropped))
    host = {}
    for r in rows:
        host.setdefault(r[0], []).append(r)
    after = []
    for i, found in cleaned.items():
        after += [(i, body, *host[i][0][2:4], len(body)) for body, _ in found]
    component = {}
    for r, label in zip(after, test_jaccard_join.brute_labels(after)):
        component.setdefault(label, []).append(r)
    first = []
    for own in component.values():
        worded = test_jaccard_join.WORD.search(own[0][1] or "")
        first += [min(own, key=lambda r: 2**63 - 1 if r[0] is None else r[0])] if worded else own
    items = [(1, "the quick brown fox jumps over the lazy dog near the river bank today")]
    hit = {x[0] for x in test_decontaminate.brute(first, items) if x[5]}
    return [r for r in first if r[0] not in hit]


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    path, rows = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as _kept", "'x' as score", "2 as row", "3 as n", "4 as marks", "5 as host")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0


def test_run_matches_brute_force(spark, sf_dir):
    path, rows = sf_dir
    want = kept_rows(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for r in want:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 0]
        pieces.append((r[0], 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got), key=str) == sorted(pieces, key=str)
    assert {r[0] for r in want} >= {0, 1, 2} and not {3, 23, 203, 300, 400, 401, 402} & {r[0] for r in want}


def test_copies_are_of_one_id_and_text(spark, sf_dir):
    """Other texts under one id are no copies; texts without an id are; wordless rows all stay."""
    import random

    rng = random.Random(3)
    one, other, third, fourth = (text(rng, "xx", 60) for _ in range(4))
    near = one.rsplit(" ", 1)[0] + " changed"
    rows = [(5, one), (5, other), (5, one), (7, near), (None, third), (None, third), (None, near), (None, fourth), (8, ""), (8, ""), (None, None), (None, None), (9, " ... "), (2, fourth)]
    docs = spark.createDataFrame([(*r, "xx", "s", 0) for r in rows], SCHEMA).selectExpr("*", "map(1, 2) as th", "1 as apart", "2 as place")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir[0])
    assert kept.columns == docs.columns
    want = [(5, one), (5, other), (None, third), (8, ""), (8, ""), (None, None), (None, None), (9, " ... "), (2, fourth)]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted(want, key=str)


def test_texts_of_no_known_language_go(spark, sf_dir):
    import random

    rng = random.Random(4)
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    letters = "bcdfghjlpqrvwxyz"
    junk = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 11))) for _ in range(40)), None, "s0", 0) for i in range(50)]
    mixed = [(2000 + i, " ".join(text(rng, x, 12) for x in LANGS), None, "s0", 0) for i in range(50)]
    short = [(3000, "qqqq", None, "s0", 4)]
    out = corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(junk + mixed + short, SCHEMA)), sf_dir[0])
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(kept & {r[0] for r in junk}) <= 1 and {r[0] for r in mixed + short} <= kept


def test_one_document_of_a_large_copy_group_keeps_its_text(spark, sf_dir):
    """Ten copies on a host of 100 pages are more than the ratio; so is the menu, which goes."""
    page = "\n".join(f"line {j} of the copied page has words of its own {j * 7}" for j in range(6))
    rows = [(i, f"menu of the site\nown words {i} of page {i * 3} and {i * 5} more", "en", "s", 0) for i in range(90)]
    rows += [(200 + i, "menu of the site\n" + page + (" " if i % 2 else ""), "en", "s", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cleaned = corpus_pipeline.drop_site_lines(spark, docs, sf_dir[0]).checkpoint()
    assert {r.text.strip() for r in cleaned.where("doc_id >= 200").collect()} == {page}
    assert not cleaned.where("text like '%menu%'").count()
    kept = corpus_pipeline.drop_near_copies(spark, cleaned, sf_dir[0]).where("doc_id >= 200").collect()
    assert [(r.doc_id, r.text) for r in kept] == [(200, page)]
