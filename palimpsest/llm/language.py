"""Language of whole texts by a linear-chain conditional random field over words.

Each word is labelled with a language.  Its features are character n-grams,
those at its ends (affixes), and a lexicon class; transitions between the
labels of neighbouring words are learned too, from monolingual runs and runs
spliced from several languages, so that code-switched text is labelled word by
word.  Forward-backward gives each word's marginals; a text's language is the
one with the largest mean marginal.

Long texts are chains like any other: they are cut into blocks whose transfer
matrices are multiplied, so that forward-backward is exact but runs over all
blocks of a slice at once.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

#: Bounds of the labelled sample that a model is fitted on: documents of a language, characters of a document, most frequent languages.
TRAIN_DOCS, TRAIN_CHARS, MOST_LANGS = 240, 4000, 64
#: Hashed n-gram features; lengths in characters, an end of the word counting as one.
FEATURES, GRAMS = 1 << 16, (2, 3, 4)
#: Words of a training run and of an inference block; training steps; L2 penalty.
RUN, BLOCK, STEPS, PENALTY = 40, 64, 45, 2e-5
#: Documents that a lexicon word is in at least; shares of its most frequent language that part its levels.
LEXICON_DOCS, LEVELS = 3, (0.6, 0.9)
#: Share of a word's n-grams that were in training, from which the word is like the learned ones.
KNOWN_GRAMS = 0.75
#: Distinct words whose scores a Python worker remembers; beyond, it starts afresh.
REMEMBER = 1_500_000

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[0x61:0x7B] = _SEPARATORS[0x80:] = False


class Model(NamedTuple):
    uid: str  # hash of all that follows
    langs: list[str]
    weights: np.ndarray  # features and lexicon classes x languages
    trans: np.ndarray
    lexicon: np.ndarray  # sorted word keys
    classes: np.ndarray  # of the lexicon's words


def _model(langs: list[str], *arrays: np.ndarray) -> Model:
    digest = hashlib.sha256(repr(langs).encode())
    for x in arrays:
        digest.update(repr((x.shape, x.dtype)).encode() + np.ascontiguousarray(x).tobytes())
    return Model(digest.hexdigest(), langs, *arrays)


def _features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' numbers and hashed n-grams, and whether each word has a letter."""
    size = end - start + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)
    joined = np.append(raw, np.uint8(10))[np.minimum(at, len(raw))].copy()
    joined[ends - 1] = 10
    text = "\n" + joined.tobytes().decode("utf-8", "replace").lower()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    brk = cp == 10
    owner = np.cumsum(brk) - 1
    kinds, inverse = np.unique(cp, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[inverse]
    has_letter = np.bincount(owner[letter], minlength=len(start)) > 0
    words, grams = [], []
    values = W.mix(cp.astype(np.uint64) + np.uint64(7))
    for n in GRAMS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= brk[i : i + m]
        use = np.flatnonzero(~inner & ~(brk[:m] & brk[n - 1 : n - 1 + m] if n == 2 else np.zeros(m, bool)))
        words.append(owner[use])
        grams.append((W.gram_keys(values, n)[use] >> np.uint64(40)).astype(np.int64) % FEATURES)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter
    return np.concatenate(words), np.concatenate(grams), has_letter


def _sum_rows(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], 1) if values.shape[1] else np.zeros((n, 0))


class _Scores:
    """Scores of distinct words by their number in ``memory``, kept over a worker's tasks."""

    def __init__(self, model: Model):
        self.model, self.memory = model, W.Memory(REMEMBER)
        self.seen = (model.weights[:FEATURES] != 0).any(1)
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros((0, len(self.model.langs) + 2), np.float32)

    def of(self, w: W.Words) -> np.ndarray:
        """Each word's scores; in the last columns whether it is like the learned words, and has a letter."""
        at, new, afresh = self.memory.places(w.raw, w.start, w.end)
        if afresh:
            self.clear()
        if len(new):
            self.table = np.concatenate([self.table, self._score(w.raw, w.start[new], w.end[new], w.key[new])])
        return self.table[at]

    def _score(self, raw, start, end, keys) -> np.ndarray:
        word, gram, letter = _features(raw, start, end)
        out = _sum_rows(word, self.model.weights[gram], len(start))
        out += _lexicon_rows(self.model.weights, self.model.lexicon, self.model.classes, keys)
        met, total = np.bincount(word, self.seen[gram], len(start)), np.bincount(word, minlength=len(start))
        like = (met >= KNOWN_GRAMS * total) | np.isin(keys, self.model.lexicon)
        return np.concatenate([out, like[:, None], letter[:, None]], 1).astype(np.float32)


@lru_cache(1)
def _remembered(uid: str) -> list[_Scores]:
    """The place of one model's scores in this Python worker; another model's takes it over."""
    return []


def _scores(model: Model) -> _Scores:
    place = _remembered(model.uid)
    if not place:
        place.append(_Scores(model))
    return place[0]


def _lexicon_rows(weights, lexicon, classes, keys) -> np.ndarray:
    out = np.zeros((len(keys), weights.shape[1]))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
        use = lexicon[at] == keys
        out[use] = weights[FEATURES + classes[at[use]]]
    return out


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each word's label marginals; ``first`` bounds the chains.  Exact forward-backward in blocks."""
    n, k = scores.shape
    lengths = np.diff(first)
    parts = -(-lengths // BLOCK)
    total = int(parts.sum())
    if not total:
        return np.zeros((0, k))
    chain = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[chain] + number * BLOCK
    size = np.minimum(BLOCK, first[chain + 1] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)  # of each block in the order by size
    active = [int(np.searchsorted(-size, -t)) for t in range(BLOCK)]  # blocks with more than t words
    a = np.exp(trans)
    e = np.exp(scores - scores.max(1, keepdims=True))
    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        step = (transfer[:m] @ a) * e[begin[:m] + t][:, None, :]
        transfer[:m] = step / step.sum((1, 2), keepdims=True)
    into, out = np.empty((total, k)), np.empty((total, k))
    by_parts = np.argsort(-parts, kind="stable")
    head = (np.cumsum(parts) - parts)[by_parts]
    many = parts[by_parts]
    forth, back = np.full((len(lengths), k), 1 / k), np.ones((len(lengths), k))
    for b in range(int(many[0])):
        m = int(np.searchsorted(-many, -b))
        at = place[head[:m] + b]
        into[at] = forth[:m]
        step = np.einsum("ni,nij->nj", forth[:m], transfer[at])
        forth[:m] = step / step.sum(1, keepdims=True)
        at = place[head[:m] + many[:m] - 1 - b]
        out[at] = back[:m]
        step = np.einsum("nij,nj->ni", transfer[at], back[:m])
        back[:m] = step / step.sum(1, keepdims=True)
    result = np.empty((n, k))
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        step = (into[:m] @ a) * e[begin[:m] + t]
        into[:m] = result[begin[:m] + t] = step / step.sum(1, keepdims=True)
    for t in range(BLOCK - 1, -1, -1):
        m, later = active[t], active[t + 1] if t + 1 < BLOCK else 0
        if not m:
            continue
        if later:
            step = (e[begin[:later] + t + 1] * out[:later]) @ a.T
            out[:later] = step / step.sum(1, keepdims=True)
        both = result[begin[:m] + t] * out[:m]
        result[begin[:m] + t] = both / both.sum(1, keepdims=True)
    return result


def fit(texts: list[str], langs: list[str], *, seed: int = 0, steps: int = STEPS) -> Model:
    """A model from labelled texts; a random half of them makes the lexicon, the others the runs."""
    names = sorted(set(langs))
    k = len(names)
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs], np.int64)
    w = W.words(pa.array(texts, pa.large_string()), _SEPARATORS, lower=True)
    lexicon_text = rng.permutation(len(texts)) % 2 == 0 if len(texts) > 2 * k else np.ones(len(texts), bool)
    # lexicon: words of several documents, by language share
    pairs = np.unique(np.stack([w.key[lexicon_text[w.doc]], w.doc[lexicon_text[w.doc]].astype(np.uint64)], 1), axis=0)
    keys, inverse = np.unique(pairs[:, 0], return_inverse=True)
    share = _sum_rows(inverse, np.eye(k)[label[pairs[:, 1].astype(np.int64)]], len(keys))
    df = share.sum(1)
    often = df >= LEXICON_DOCS
    level = np.searchsorted(LEVELS, share[often].max(1, initial=0) / df[often], "right")
    best = share[often].argmax(1) if k else level
    lexicon, classes = keys[often], best * (len(LEVELS) + 1) + level
    # runs of words with labels: half of one language, half spliced
    usable = [d for d in range(len(texts)) if (not lexicon_text[d] or lexicon_text.all()) and w.first[d + 1] > w.first[d]]
    runs, ys = [], []

    def span(d: int, most: int) -> np.ndarray:
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        at = int(rng.integers(lo, max(lo + 1, hi - most + 1)))
        return np.arange(at, min(hi, at + most))

    for d in usable:
        for _ in range(3):
            one = span(d, RUN)
            runs.append(one)
            ys.append(np.full(len(one), label[d]))
            mixed = [span(int(rng.choice(usable)), int(rng.integers(3, 16))) for _ in range(int(rng.integers(2, 5)))]
            runs.append(np.concatenate(mixed)[:RUN])
            ys.append(label[w.doc[runs[-1]]])
    trans = np.zeros((k, k))
    weights = np.zeros((FEATURES + k * (len(LEVELS) + 1), k))
    if not runs or k == 0:
        return _model(names, weights.astype(np.float32), trans, lexicon, classes)
    tokens = np.concatenate(runs)
    distinct, at, inverse = np.unique(w.key[tokens], return_index=True, return_inverse=True)
    word, gram, _ = _features(w.raw, w.start[tokens[at]], w.end[tokens[at]])
    place = np.minimum(np.searchsorted(lexicon, distinct), max(len(lexicon) - 1, 0))
    inside = np.flatnonzero(lexicon[place] == distinct) if len(lexicon) else np.zeros(0, np.int64)
    word, gram = np.concatenate([word, inside]), np.concatenate([gram, FEATURES + classes[place[inside]]])
    y = np.concatenate(ys)
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    starts = np.zeros(len(y), bool)
    starts[first[:-1]] = True
    truth = np.eye(k)[y]
    follow = np.flatnonzero(~starts)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[follow - 1], y[follow]), 1)
    moment = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(trans), np.zeros_like(trans)]]
    for step in range(1, steps + 1):
        scores = _sum_rows(word, weights[gram], len(distinct))[inverse]
        gone = marginals(scores, first, trans)
        wanted = _pair_sums(scores, gone, first, trans)
        diff = _sum_rows(inverse, gone - truth, len(distinct))
        gw = _sum_rows(gram, diff[word], len(weights)) / len(y) + PENALTY * weights
        gt = (wanted - seen) / len(y) + PENALTY * trans
        for value, grad, (m, v), rate in ((weights, gw, moment[0], 0.08), (trans, gt, moment[1], 0.15)):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return _model(names, weights.astype(np.float32), trans, lexicon, classes)


def _pair_sums(scores, gone, first, trans) -> np.ndarray:
    """Expected label pairs of neighbouring words, summed over all chains.

    With marginals g and forward messages f, the pair marginal at (t, t+1) is
    proportional to f_t(i) A(i, j) g_{t+1}(j) / sum_i f_t(i) A(i, j).
    """
    a = np.exp(trans)
    e = np.exp(scores - scores.max(1, keepdims=True))
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    head, size = first[:-1][order], lengths[order]
    f = np.full((len(head), a.shape[0]), 1 / a.shape[0])
    total = np.zeros_like(a)
    for t in range(int(size[0])):
        m = int(np.searchsorted(-size, -t))
        ahead = f[:m] @ a
        if t:
            total += a * (f[:m].T @ (gone[head[:m] + t] / ahead))
        step = ahead * e[head[:m] + t]
        f[:m] = step / step.sum(1, keepdims=True)
    return total


def _predict_map(model, columns: list[str]):
    """Adds lang_pred, score, n_words, n_switches and n_like after the given columns; text is the last of these."""

    def run(batches):
        fitted: Model = model.value
        scores = _scores(fitted)
        names = np.array([*fitted.langs, "und"], object)
        k = len(fitted.langs)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for a, b in W.slices(text):
                w = W.words(text.slice(a, b - a), _SEPARATORS, lower=True)
                n = b - a
                found = scores.of(w)
                letter = found[:, k + 1] > 0
                # words without a letter take no part in a chain
                key = np.flatnonzero(letter)
                doc = w.doc[key]
                first = np.searchsorted(doc, np.arange(n + 1))
                count = np.diff(first)
                if k:
                    post = marginals(found[key, :k].astype(np.float64), first, fitted.trans)
                    mean = _sum_rows(doc, post, n) / np.maximum(count, 1)[:, None]
                    best, score = mean.argmax(1), mean.max(1)
                    label = post.argmax(1)
                    change = np.flatnonzero((label[1:] != label[:-1]) & (doc[1:] == doc[:-1]))
                    switches = np.bincount(doc[change + 1], minlength=n)
                else:
                    best, score, switches = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
                like = np.bincount(doc, found[key, k], n).astype(np.int64)
                none = (count == 0) | (k == 0)
                best[none], score[none] = k, 0.0
                part = batch.slice(a, n)
                new = [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), *(pa.array(x.astype(np.int64)) for x in (count, switches, like))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*columns, "lang_pred", "score", "n_words", "n_switches", "n_like"])

    return run


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable=None) -> Model:
    """A model from a bounded sample of the labelled rows of ``docs`` for which ``usable`` holds.

    Of each of the ``MOST_LANGS`` most frequent languages about ``TRAIN_DOCS``
    documents are taken, by a hash of id and text; of a text longer than
    ``TRAIN_CHARS``, so many characters from a place that the hash tells.  So
    all rows and places may be taken, and equal tables give equal models.  Rows
    with a null id, text or language are left out.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null and text is not null")
    if usable is not None:
        labelled = labelled.where(usable(F.col("id")))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, TRAIN_DOCS / r["count"]))).otherwise(rate)
    hashed = F.xxhash64("id", "text")
    drawn = labelled.where((F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)) < rate)
    place = F.pmod(F.xxhash64(hashed), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1) + 1
    most = 2 * TRAIN_DOCS * max(1, len(counts))
    spans = drawn.select("lang", "id", hashed.alias("h"), F.substring("text", place.cast("int"), F.lit(TRAIN_CHARS)).alias("text")).orderBy("h", "lang", "id").limit(most)
    sample = sorted((r.lang, r.id, r.text) for r in spans.collect())
    return fit([x[2] for x in sample], [x[0] for x in sample])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, the ``extra`` columns, text, lang_pred, score, n_words, n_switches, n_like.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is
    null or has no letter; ``score`` is the mean marginal of that language over
    the text's words; ``n_switches`` counts neighbouring words of different
    languages; ``n_like`` counts words that are in the lexicon or have mostly n-grams
    that the model has learned.  Of languages with equal means the first by name is
    taken.  Rows are independent: repeated rows have equal results.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), *(extra or []), F.col(text_col).alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", lang_pred string, score double, n_words long, n_switches long, n_like long"
    return given.mapInArrow(_predict_map(spark.sparkContext.broadcast(model), given.columns), kind)
