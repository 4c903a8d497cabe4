"""Toxicity: a linear-chain conditional random field tags toxic words.

Training.  Document labels become token labels: in a bounded sample of labelled
documents (:data:`TOXIC_DOCS`, :data:`CLEAN_DOCS`, :data:`SAMPLE_CHARS`; near copies set
aside) the word and prefix features whose documents are toxic far more often than chance
allows mark their tokens.  The field has two labels, hashed features of a word (itself,
prefixes of 4 to 6 letters) and a transition matrix; it is fitted by gradient steps on the
conditional likelihood of whole documents of the sample, :data:`FIT_TOKENS` words at most.
The gradient of the weights comes from the marginals of single tokens and that of the
transitions from the marginals of neighbouring pairs, both by forward-backward.  A
logistic curve over what the marginals of a document add up to is fitted on the same
documents, so scores are probabilities.

Scoring.  All words of a batch of whole texts form one sequence that is reset at each
document.  Forward-backward runs in blocks of it: products of 2 x 2 matrices first,
then the messages, so the cost of a document grows with its words only and long texts
need no cut.  Marginals aggregate to a score; words with a marginal of 0.5 or more are
the offending offsets (code points, end exclusive).

Labels, language, source and doc_id are never inputs of a score.  Edge cases: null and
empty texts get the score of a text without words; labels that are null, missing or
contradictory (the larger counts) are allowed; without toxic or without clean examples
every score is the smoothed share of toxic labels; repeated rows are scored alike; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drawn, give_back, short_batches

WORD = re.compile(r"[^\W_]+")
#: Bounds of the training sample: documents of each label, and code points of a document.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 1500, 3000, 20_000
#: Words that the field is fitted on; documents beyond it serve the curve only.
FIT_TOKENS = 200_000
DIMENSION = 1 << 18
PREFIXES = (4, 5, 6)
#: Words that a worker remembers.
KNOWN = 200_000


def _names(word: str) -> list[int]:
    """A word's features by their hashes: itself and its prefixes."""
    return [zlib.crc32(f"w:{word}".encode()), *(zlib.crc32(f"p:{word[:k]}".encode()) for k in PREFIXES if len(word) >= k)]


def features(word: str) -> list[int]:
    """The slots of a word's features."""
    return [h % DIMENSION for h in _names(word)]


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, as many as the text as it is has, so that offsets hold."""
    low = text.lower()
    # some letters lower to two code points, which may part a word
    return WORD.findall(low) if len(low) == len(text) else list(map(str.lower, WORD.findall(text)))


# Forward-backward ----------------------------------------------------------------------


def marginals(emission: np.ndarray, reset: np.ndarray, transition: np.ndarray, block: int = 256) -> np.ndarray:
    """P(label 1) of every token; ``emission`` is the log-odds of label 1 from the features, ``reset`` marks first tokens of sequences, ``transition`` holds the 2 x 2 log potentials."""
    return _messages(emission, reset, transition, block, False)[0]


def expectations(emission: np.ndarray, reset: np.ndarray, transition: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of every token, and the expected number of each pair of labels (from, to) of neighbours within sequences."""
    return _messages(emission, reset, transition, block, True)


def _messages(emission: np.ndarray, reset: np.ndarray, transition: np.ndarray, block: int, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    n, expected = len(emission), np.zeros((2, 2))
    if not n:
        return np.empty(0), expected
    size = -(-n // block)

    def laid(values: np.ndarray, fill: float) -> np.ndarray:  # step k of all blocks is row k
        out = np.full(size * block, fill)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(size, block).T)

    w1 = 1 / (1 + np.exp(-laid(np.clip(emission, -30, 30), 0.0)))
    w0 = 1 - w1 + 1e-14
    r = laid(reset, 1.0)
    t = np.exp(transition)
    # step matrices M[i][j]: from label i to j; at a reset both rows are the same
    m = [[(t[i, j] + r * (1 - t[i, j])) * (w1 if j else w0) for j in (0, 1)] for i in (0, 1)]
    p = [[np.ones(size), np.zeros(size)], [np.zeros(size), np.ones(size)]]
    for k in range(block):
        q = [[p[i][0] * m[0][j][k] + p[i][1] * m[1][j][k] for j in (0, 1)] for i in (0, 1)]
        if k % 4 == 3 or k == block - 1:  # often enough that nothing runs out of range
            s = 1 / (q[0][0] + q[0][1] + q[1][0] + q[1][1])
            q = [[x * s for x in row] for row in q]
        p = q
    whole = [[x.tolist() for x in row] for row in p]
    a0, a1 = np.empty(size), np.empty(size)
    x0, x1 = 0.5, 0.5
    for k in range(size):
        a0[k], a1[k] = x0, x1
        y0, y1 = x0 * whole[0][0][k] + x1 * whole[1][0][k], x0 * whole[0][1][k] + x1 * whole[1][1][k]
        x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
    b0, b1 = np.empty(size), np.empty(size)
    x0, x1 = 0.5, 0.5
    for k in range(size - 1, -1, -1):
        b0[k], b1[k] = x0, x1
        y0, y1 = whole[0][0][k] * x0 + whole[0][1][k] * x1, whole[1][0][k] * x0 + whole[1][1][k] * x1
        x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
    odds = np.empty((block, size))  # of label 1, from the left
    before = np.empty((block if pairs else 0, size))  # share of label 1 at the token before, from the left
    for k in range(block):
        if pairs:
            before[k] = a1 / (a0 + a1)
        a0, a1 = a0 * m[0][0][k] + a1 * m[1][0][k], a0 * m[0][1][k] + a1 * m[1][1][k]
        s = 1 / (a0 + a1)
        a0, a1 = a0 * s, a1 * s
        odds[k] = a1 / a0
    for k in range(block - 1, -1, -1):
        odds[k] *= b1 / b0
        if pairs:
            both = [[x * m[i][j][k] * y for j, y in enumerate((b0, b1))] for i, x in enumerate((1 - before[k], before[k]))]
            share = (1 - r[k]) / (both[0][0] + both[0][1] + both[1][0] + both[1][1])  # none over a reset
            expected += [[(x * share).sum() for x in row] for row in both]
        b0, b1 = m[0][0][k] * b0 + m[0][1][k] * b1, m[1][0][k] * b0 + m[1][1][k] * b1
        s = 1 / (b0 + b1)
        b0, b1 = b0 * s, b1 * s
    return (odds / (1 + odds)).T.ravel()[:n], expected


@dataclass
class Field:
    """The fitted field, its document curve, and the labels' share for when nothing was learned."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    curve: np.ndarray  # of 1, log expected toxic words, two largest marginals
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emission(self, word: str) -> float:
        if len(self.known) > KNOWN:
            self.known.clear()
        e = self.known[word] = self.bias + float(self.weights[features(word)].sum())
        return e

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        emissions, sizes = [], []
        get = self.known.get
        for t in texts:
            found = words_of(t)
            e = list(map(get, found))
            if None in e:
                e = [self.emission(w) if x is None else x for w, x in zip(found, e, strict=True)]
            emissions.append(np.array(e, dtype=np.float64))
            sizes.append(len(e))
        ends = np.cumsum(sizes)
        flat = np.concatenate(emissions) if emissions else np.empty(0)
        reset = np.zeros(len(flat), dtype=bool)
        first = ends - sizes
        reset[first[first < len(flat)]] = True
        p = marginals(flat, reset, self.transition)
        return [p[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]

    def score(self, tags: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summary(tags) @ self.curve, -30, 30)))


def _summary(tags: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(tags), 4))
    out[:, 0] = 1
    for i, p in enumerate(tags):
        if len(p):
            top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
            out[i, 1:] = np.log1p(p[p > 0.05].sum()), top[1], top[0]
    return out


# Training ------------------------------------------------------------------------------


def _apart(texts: list[list[str]]) -> np.ndarray:
    """Which documents are no near copies of earlier ones: half of the 16 least shingle hashes are new."""
    seen: set[int] = set()
    keep = np.zeros(len(texts), dtype=bool)
    for i, w in enumerate(texts):
        low = sorted({zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))})[:16]
        keep[i] = sum(x in seen for x in low) * 2 < len(low)
        seen.update(low)
    return keep


def toxic_features(words: list[list[str]], labels: np.ndarray) -> set[int]:
    """Features whose documents are toxic so often that chance would bring up none among all features."""
    found = [np.unique(np.fromiter((h for one in set(w) for h in _names(one)), dtype=np.uint32)) for w in words]
    none = np.empty(0, dtype=np.uint32)
    names, total = np.unique(np.concatenate([none, *found]), return_counts=True)
    own, counts = np.unique(np.concatenate([none, *(f for f, x in zip(found, labels, strict=True) if x)]), return_counts=True)
    toxic = np.zeros(len(names), dtype=np.int64)
    toxic[np.searchsorted(names, own)] = counts
    share = (labels.sum() + 1) / (len(labels) + 2)
    # of the features in k documents, a share ** k would be in toxic ones only by chance
    sizes = np.bincount(total)
    need, chance = len(sizes), 0.0
    for k in range(need - 1, 2, -1):
        chance += sizes[k] * share**k
        if chance > 0.5:
            break
        need = k
    return set(names[(toxic >= need) & (total - toxic <= 0.02 * toxic)].tolist())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def gradients(emission: np.ndarray, y: np.ndarray, reset: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative conditional log-likelihood of labels ``y``: by each token's emission, and by the transitions."""
    p, expected = expectations(emission, reset, transition)
    follows = np.flatnonzero(~reset)
    gold = np.bincount((2 * y[follows - 1] + y[follows]).astype(int), minlength=4).reshape(2, 2)
    return p - y, expected - gold


def _fit_chain(sequences: list[list[str]], marks: set[int], steps: int = 40) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions by Adam on the conditional likelihood."""
    flat = [w for s in sequences for w in s]
    index: dict[str, int] = {}
    word = np.array([index.setdefault(w, len(index)) for w in flat], dtype=np.int64)
    listed = [features(w) for w in index]
    gold_of = np.array([any(n in marks for n in _names(w)) for w in index], dtype=np.float64)
    y = gold_of[word]
    rows = np.repeat(np.arange(len(listed)), [len(f) for f in listed])
    cols = np.concatenate([np.array(f) for f in listed])
    reset = np.zeros(len(flat), dtype=bool)
    reset[np.cumsum([0, *(len(s) for s in sequences[:-1])])] = True
    w, bias, t = np.zeros(DIMENSION), -3.0, np.zeros((2, 2))
    mean, var = [np.zeros(DIMENSION), 0.0, np.zeros((2, 2))], [np.zeros(DIMENSION), 0.0, np.zeros((2, 2))]
    for step in range(1, steps + 1):
        e = (bias + np.bincount(rows, w[cols], minlength=len(listed)))[word]
        by_token, by_pair = gradients(e, y, reset, t)
        gap = np.bincount(word, by_token, minlength=len(listed)) / len(flat)
        grads = [np.bincount(cols, gap[rows], minlength=DIMENSION) + 1e-7 * w, gap.sum(), by_pair / len(flat) + 1e-4 * t]
        moved = []
        for k, (value, g) in enumerate(zip((w, bias, t), grads, strict=True)):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            moved.append(value - 0.3 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8))
        w, bias, t = moved
    return w, float(bias), t


def fit(texts: list[str], labels: list[int]) -> Field:
    """Fit field and curve on labelled texts."""
    y = np.array(labels, dtype=np.float64)
    same: dict[str, str] = {}  # equal words as one string
    words = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]
    same.clear()
    share = (y.sum() + 1) / (len(y) + 2)
    nothing = Field(np.zeros(DIMENSION), -6.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    if not 0 < y.sum() < len(y):
        return nothing
    apart = _apart(words)
    marks = toxic_features([w for w, k in zip(words, apart, strict=True) if k], y[apart])
    if not marks:
        return nothing
    # whole documents, toxic and clean ones in turn, as far as the bound of words allows
    sequences, held = [], 0
    turns = [[w for w, x in zip(words, y, strict=True) if w and x == k] for k in (1, 0)]
    for one in (w for pair in zip_longest(*turns) for w in pair if w):
        if held and held + len(one) > FIT_TOKENS:
            break
        sequences.append(one)
        held += len(one)
    if not sequences:
        return nothing
    weights, bias, transition = _fit_chain(sequences, marks)
    model = Field(weights, bias, transition, nothing.curve)
    # a few documents at a time, as all their messages at once would fill the driver
    found = [_summary(model.tag(texts[at : at + 200])) for at in range(0, len(texts), 200)]
    model.curve = _logistic(np.concatenate(found), y)
    return model


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """A bounded training sample: documents whose doc_id has crc32 mod 5 other than 0, drawn by a hash of doc_id."""
    marked = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    found = [drawn(marked.where(F.col("toxic") == k), n, "doc_id").collect() for k, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    toxic = {int(r[0]): int(r[1]) for part in found for r in part}
    if not toxic:
        return [], []
    ids = docs.sparkSession.createDataFrame([(k,) for k in sorted(toxic)], "wanted long")  # at most TOXIC_DOCS + CLEAN_DOCS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), F.col("doc_id") == F.col("wanted")).select("doc_id", "text").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * (TOXIC_DOCS + CLEAN_DOCS)).collect()
    return [r[1] for r in rows], [toxic[r[0]] for r in rows]


def train(docs: DataFrame, labels: DataFrame) -> Field:
    model = fit(*sample(docs, labels))
    give_back()  # the driver serves later stages, too
    return model


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Offsets of words with a marginal of 0.5 or more; ``p`` holds one for each word of the text."""
    if not len(p) or p.max() < 0.5:
        return []
    return [{"start": m.start(), "end": m.end(), "p": round(float(x), 6)} for m, x in zip(WORD.finditer(text), p, strict=True) if x >= 0.5]


def score(docs: DataFrame, model: Field, text: str = "text", to: str = "_toxicity") -> DataFrame:
    """All columns of ``docs``, then ``to``: struct(score double, predicted int, spans); ``docs`` must have no column of that name (see :func:`free_name`)."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("score double, predicted int, spans array<struct<start:int,end:int,p:double>>")
    def tagged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [x or "" for x in part]
            scores, spans = [], []
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) < 1 << 20):
                    held += len(texts[end])
                    end += 1
                tags = model.tag(texts[at:end])
                scores.append(model.score(tags))
                spans += [spans_of(t, p) for t, p in zip(texts[at:end], tags, strict=True)]
                at = end
            s = np.concatenate(scores) if scores else np.empty(0)
            yield pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype("int32"), "spans": spans})
        give_back()

    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {to} already")
    return docs.select("*", tagged(F.col(text)).alias(to))
