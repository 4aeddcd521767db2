import random

import public_tokenizers
import pytest
from palimpsest.llm.unigram import SPACE_MARK, Counter, count_tokens, vocabulary
from tokenizers import Tokenizer, models, pre_tokenizers

from .helpers import SCHEMA, awkward

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE_MARK, prepend_scheme="always")
    return t


def test_counts_match_the_tokenizer(spark):
    rng = random.Random(3)
    rows = awkward(rng)
    texts = [" a  b ", "\n", "\na", "a\n b\t\tc\n", " ", "  ", f"x{SPACE_MARK}y {SPACE_MARK}", "一龥 \U0001f600\U0001f600", "the quick brown fox", "<s> <0x41> <unk>", "a\r\nb ", "\x00\x01 \x02"]
    rows += [(900 + i, t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_tokens", "2 as score")
    t = library(vocabulary(PATH))
    want = sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in count_tokens(docs, PATH).collect()), key=str) == want
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_ties_are_the_tokenizers(seed):
    """Small alphabets and few score values make ties frequent."""
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {SPACE_MARK, SPACE_MARK + "a"}
    pieces += [(p, -float(rng.randrange(1, 5))) for p in sorted(names)]
    t, counter = library(pieces), Counter(pieces)
    for _ in range(300):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 15)))
        assert counter.count(SPACE_MARK + text)[0] == len(t.encode(text, add_special_tokens=False).ids), text
