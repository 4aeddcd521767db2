"""Keys of spans: no regular pattern makes two agree, and where two agree nevertheless, results are right."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from palimpsest.llm import decontaminate, jaccard_join, language, packing, repetition, tokens, unigram
from palimpsest.llm import wordhash as W
from tokenizers import Tokenizer

from . import test_decontaminate, test_jaccard_join, test_repetition
from .helpers import SCHEMA
from .test_language import text as text_of

TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


PAIR = (thue_morse(1024), thue_morse(1024, "b", "a"))


@pytest.mark.parametrize("seed", range(3))
def test_keys_tell_spans_apart(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abéz") for _ in range(rng.randrange(1, 40))) for _ in range(3000)}
    words |= {thue_morse(n, a, b) for n in (8, 64, 1024, 4096) for a, b in ("ab", "ba", "xy", "yx")} | {"a" * n for n in range(1, 200)}
    words = sorted(words) * 2
    w = W.words(pa.array(words), W.SPACE, lower=False)
    key, check = W.span_pairs(w.raw, w.start, w.end)
    assert len(set(key.tolist())) == len(set(check.tolist())) == len(set(words))
    assert (key == w.key).all() and (key[: len(words) // 2] == key[len(words) // 2 :]).all()
    assert not set(key.tolist()) & set(W.span_keys(w.raw, w.start, w.end, 1).tolist())


def test_windows_of_two_words_in_a_regular_order_differ():
    w = W.words(pa.array([" ".join(thue_morse(128)), " ".join(thue_morse(128, "b", "a"))]), W.SPACE, lower=False)
    for n in (2, 8, 16, 64, 128):
        assert len({W.gram_keys(w.key[i : i + n], n)[0] for i in (0, 128)}) == 2


@pytest.fixture
def clashing(monkeypatch):
    """First keys of few bits for the first two seeds: memories meet clashes and begin anew with another seed."""
    real = W._span_sums

    def few(raw, start, end, seeds):
        return [x & np.uint64(7) if s in (0, 2) else x for s, x in zip(seeds, real(raw, start, end, seeds))]

    monkeypatch.setattr(W, "_span_sums", few)


def test_a_memory_with_clashing_keys_is_right(clashing):
    rng = random.Random(4)
    memory, spelt = W.Memory(50), []
    for _ in range(20):
        w = W.words(pa.array([" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(30)))]), W.SPACE, lower=False)
        own = [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end)]
        at, new, afresh = memory.places(w.raw, w.start, w.end)
        if afresh:
            spelt = []
        spelt += [own[i] for i in new]
        assert [spelt[i] for i in at] == own
    assert memory.seed == 2


def test_numbers_of_clashing_keys(clashing):
    w = W.words(pa.array(["a b c d e f g h i j k a b c"]), W.SPACE, lower=False)
    first, number = W.number(*W.span_pairs(w.raw, w.start, w.end))
    assert len(first) == 11 and (number[:3] == number[11:]).all() and len(set(number.tolist())) == 11


def test_operators_with_clashing_keys(clashing):
    texts = ["the quick brown fox jumps over a lazy dog. it did, then.", "a lazy fox", None, "", "dog dog dog over the quick brown"]
    whole = Tokenizer.from_file(TOKENS)
    ids = tokens.Ids(TOKENS)
    for _ in range(2):
        flat, at = ids.of(*W.text_bytes(pa.array(texts)))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    parts = unigram._Parts(PIECES)
    want = [unigram._Parts(PIECES).of(*W.text_bytes(pa.array([t], pa.string())))[0][0] for t in texts]
    assert parts.of(*W.text_bytes(pa.array(texts)))[0].tolist() == want
    f = repetition.figures(pa.array(texts), 4)
    for i, t in enumerate(texts):
        assert [int(c[i]) for c in f][:6] == test_repetition.brute(t, 4)[:6]


def test_regular_patterns_in_every_operator(spark):
    """Two words of 1,024 letters, and a text of two lines, that keys by a polynomial modulo 2**64 take for one."""
    a, b = PAIR
    lines = f"{thue_morse(2048)}\n{thue_morse(2048, 'b', 'a')}"
    rows = [(1, a, None, None, None), (2, b, None, None, None), (3, lines, None, None, None), (4, f"{a} {b} {a} x y z", None, None, None), (5, f"{a} {a} {a} x y z", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = [(7, a), (8, f"{a} {b}")]
    got = sorted((tuple(r)[:6] for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == test_decontaminate.brute(rows, items)
    dup = {r.doc_id: r.n_dup_lines for r in repetition.repetition_rules(docs).collect()}
    assert dup == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=str) == test_jaccard_join.brute(rows)
    ids = {r[0]: [*Tokenizer.from_file(TOKENS).encode(r[1], add_special_tokens=False).ids, 0] for r in rows}
    crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    plan = {r.doc_id: r.ids_crc32 for r in packing.pack_certified(packing.token_pieces(docs, TOKENS, capacity=1 << 16), capacity=1 << 16).collect()}
    assert plan == crc
    packed = packing.pack_matrices(docs, TOKENS, capacity=1 << 14).collect()
    assert {d: np.frombuffer(r.ids, "<u2")[x:y].tolist() for r in packed for d, x, y in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:])} == ids
    alone = {r[0]: unigram.Counter(unigram.vocabulary(PIECES)).count(unigram.SPACE_MARK + r[1])[0] for r in rows[:2]}
    assert {r.doc_id: r.n_tokens for r in unigram.count_tokens(docs, PIECES).collect() if r.doc_id < 3} == alone


def test_scores_are_remembered_by_a_models_content():
    rng = random.Random(2)
    texts, langs = [text_of(rng, x, 30) for x in "xx yy".split() * 4], "xx yy".split() * 4
    one, same, other = language.fit(texts, langs), language.fit(texts, langs), language.fit(texts, [{"xx": "yy", "yy": "xx"}[x] for x in langs])
    assert one.uid == same.uid != other.uid
    assert language._scores(one) is language._scores(same) is not language._scores(other)
    w = W.words(pa.array([" ".join(PAIR)]), language._SEPARATORS, lower=True)
    apart = [language._Scores(one).of(W.words(pa.array([x]), language._SEPARATORS, lower=True))[0] for x in PAIR]
    np.testing.assert_array_equal(language._scores(one).of(w), apart)
