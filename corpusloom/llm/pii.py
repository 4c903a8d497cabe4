"""Personal data: base patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers.  The field adds what they miss: its nodes are the candidate tokens of a
document (runs without white space that hold a digit or an at sign); neighbouring
candidates are joined by chain edges, and repeated or similar ones (the same text, or
the same last nine digits) anywhere in the document by skip edges, each to the next one
alike.  Tokens under a base span are observed; each other mention also has an edge to the
last observed one alike before it and to the first after it, however many lie between, so
a token that occurs n times has fewer than 3 * n edges.  Loopy message passing, until the
messages of a document stand still, carries the labels along the edges, so a phone number
without its plus sign or a card written apart is tagged like its other mention.

Weights of nodes (token shapes) and edges are fitted together, on a bounded sample
(:data:`SAMPLE_DOCS`, :data:`SAMPLE_CHARS`), by gradient steps on the likelihood of the
labels that the base spans give, through the same messages: in every second document half
of the tokens under base spans are shown, all others and the tokens of no kind are to be
guessed, and tokens alike to a base mention but under no base span themselves are latent.  The gradient is
what nodes and edges count with all labels given less what they are expected to count,
plus a normal prior (:data:`PRIOR`) by which alike tokens agree.  All documents of a
batch are one graph, in numpy.

Spans are kind:start:end in code points, end exclusive; base spans always stay, and
added ones never overlap them.  Edge cases: null and empty texts have no spans; very
long texts are read whole, every pattern in time linear in the text; repeated rows are
tagged alike; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drawn, give_back, short_batches

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
SHAPES = 1 << 12
#: Messages stand still below this change; looked at every so many rounds, and stopped after ROUNDS where they never do.
STILL, LOOK, ROUNDS = 1e-4, 16, 1600
#: Added spans need this marginal.
SURE = 0.8
#: The prior of edge potentials before any data: means of agreement over chain and skip edges, and the weight of the mean.
PRIOR, PRIOR_WEIGHT = (0.0, 4.0), 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: from within it ends at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_EDGE = " \t.,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k & 1:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; each at sign is tried once, from the start of the local part before it."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", pos)
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(a, 3, b) for a, b in _phones(text)]
    return sorted(out)


def shape(token: str) -> list[int]:
    """Slots of a whole token's features: its outline, and counts of digits and marks."""
    digits = sum(c in "0123456789" for c in token)
    outline = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m.group()), 19)}", token))
    short = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token)))
    marks = "".join(sorted({c for c in token if not c.isalnum()}))
    return [zlib.crc32(f.encode()) % SHAPES for f in (f"o{outline}", f"s{short}", f"d{min(digits, 20)}", f"m{marks}", f"md{min(digits, 20)}{marks}", "bias")]


def _likeness(token: str) -> list[str]:
    digits = "".join(c for c in token if c in "0123456789")
    return [f"t{token.lower()}", *([f"d{digits[-9:]}"] if len(digits) >= 7 else [])]


@dataclass
class Graph:
    """Candidate tokens of documents with their edges; label 0 is none, k + 1 kind k, -1 not observed."""

    doc: np.ndarray
    span: list[tuple[int, int]]
    seen: np.ndarray
    slots: list[list[int]]
    edges: np.ndarray  # (a, b, 0 chain, 1 skip, or 2 skip to an observed one further off)
    open: np.ndarray  # not observed, but alike to an observed one


def _to_observed(group: list[int], seen: list[int]) -> list[tuple[int, int, int]]:
    """Edges of the mentions not observed to the last observed one before and the first one after."""
    out = []
    for back in (False, True):
        at = -1
        for n in reversed(group) if back else group:
            if seen[n] > 0:
                at = n
            elif at >= 0:
                out.append((n, at, 2) if back else (at, n, 2))
    return out


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    doc, span, seen, slots, edges, latent = [], [], [], [], [], set()
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        last_end, last = -9, -1
        alike: dict[str, list[int]] = {}
        starts = [s for s, _, _ in base]
        furthest = list(accumulate((e for _, _, e in base), max))  # end of any span up to this one
        for m in _TOKEN.finditer(text):
            word = m.group().strip(_EDGE)
            if not word:
                continue
            a = m.start() + m.group().index(word)
            b = a + len(word)
            label = -1
            k = bisect_left(starts, b) - 1
            while k >= 0 and furthest[k] > a:
                if base[k][2] > a:
                    label = base[k][1] + 1
                    break
                k -= 1
            n = len(doc)
            if last >= 0 and a - last_end <= 2:
                edges.append((last, n, 0))
            for key in _likeness(word):
                group = alike.setdefault(key, [])
                if group:
                    edges.append((group[-1], n, 1))
                group.append(n)
            doc.append(d)
            span.append((a, b))
            seen.append(label)
            slots.append(shape(word))
            last, last_end = n, b
        if base:
            for group in alike.values():
                edges += _to_observed(group, seen)
                if any(seen[n] > 0 for n in group):
                    latent.update(n for n in group if seen[n] <= 0)
    near = {(a, b) for a, b, kind in edges if kind == 1}
    edges = [e for e in edges if e[2] < 2 or e[:2] not in near]
    is_open = np.zeros(len(doc), dtype=bool)
    is_open[list(latent)] = True
    return Graph(np.array(doc, dtype=np.int64), span, np.array(seen, dtype=np.int64), slots, np.array(sorted(set(edges)), dtype=np.int64).reshape(-1, 3), is_open)


def _summed(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` added up by ``at``."""
    return np.stack([np.bincount(at, c, minlength=n) for c in values.T], 1) if len(at) else np.zeros((n, values.shape[1]))


def _shares(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class Field:
    weights: np.ndarray  # slots x labels
    pairs: np.ndarray  # (chain, skip) x labels x labels, log potentials

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Of each node's labels, given the observed ones."""
        return self.beliefs(g, np.where(g.seen > 0, g.seen, -1), rounds)[0]

    def beliefs(self, g: Graph, given: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Loopy belief propagation: of each node's labels, and of each edge's pairs of labels, where ``given`` (-1: not) fixes labels."""
        n, k = len(g.doc), len(KINDS) + 1
        rows = np.repeat(np.arange(n), [len(s) for s in g.slots])
        cols = np.array([x for s in g.slots for x in s], dtype=np.int64)
        node = _summed(n, rows, self.weights[cols])
        fixed = given >= 0
        node[fixed] = -np.inf
        node[fixed, given[fixed]] = 0.0
        if not len(g.edges):
            return _shares(node) if n else node, np.empty((0, k, k))
        src = np.concatenate([g.edges[:, 0], g.edges[:, 1]])
        dst = np.concatenate([g.edges[:, 1], g.edges[:, 0]])
        kind = np.minimum(g.edges[:, 2], 1)
        pot = self.pairs[np.concatenate([kind, kind])]
        pot[len(g.edges) :] = pot[len(g.edges) :].transpose(0, 2, 1)
        back = np.concatenate([np.arange(len(g.edges)) + len(g.edges), np.arange(len(g.edges))])
        msg, place = np.zeros((len(src), k)), np.empty(len(src), dtype=np.int64)
        live = np.arange(len(src))  # edges of documents whose messages still move
        for at in range(0, rounds, LOOK):
            nodes, ends = np.unique(np.concatenate([src[live], dst[live]]), return_inverse=True)
            a, b = ends[: len(live)], ends[len(live) :]
            place[live] = np.arange(len(live))
            m, opposite, own, potential = msg[live], place[back[live]], node[nodes], pot[live]
            for _ in range(min(LOOK, rounds - at)):
                total = own + _summed(len(nodes), b, m)
                into = (total[a] - m[opposite])[:, :, None] + potential
                top = into.max(1, keepdims=True)
                new = np.log(np.exp(into - top).sum(1)) + top[:, 0]
                step = 0.5 * (new - new.max(1, keepdims=True)) - 0.5 * m
                m = m + step
            msg[live] = m
            moving = np.zeros(g.doc[-1] + 1, dtype=bool)
            moving[g.doc[src[live]][np.abs(step).max(1) > STILL]] = True
            live = live[moving[g.doc[src[live]]]]
            if not len(live):
                break
        node = node + _summed(n, dst, msg)
        half = len(g.edges)
        both = (node[src[:half]] - msg[half:])[:, :, None] + pot[:half] + (node[dst[:half]] - msg[:half])[:, None, :]
        return _shares(node), _shares(both.reshape(half, -1)).reshape(half, k, k)


def gradients(g: Graph, model: Field, gold: np.ndarray, shown: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the labels ``gold`` (-1: latent) given those of the nodes ``shown``: by weights and by potentials."""
    counted = model.beliefs(g, gold, rounds)
    expected = model.beliefs(g, np.where(shown, gold, -1), rounds)
    rows = np.repeat(np.arange(len(g.doc)), [len(s) for s in g.slots])
    cols = np.array([x for s in g.slots for x in s], dtype=np.int64)
    free = ~shown[:, None]  # weights of a node whose label is given have no part
    by_weight = _summed(len(model.weights), cols, ((counted[0] - expected[0]) * free)[rows])
    by_pair = np.zeros_like(model.pairs)
    kind = np.minimum(g.edges[:, 2], 1)
    for k in (0, 1):
        by_pair[k] = (counted[1] - expected[1])[kind == k].sum(0)
    return by_weight, by_pair


def fit(texts: list[str], steps: int = 100, rounds: int = 8) -> Field:
    """Node and edge weights, together, from the labels of base spans; see the module's text."""
    k = len(KINDS) + 1
    g = graph(texts, [base_spans(t) for t in texts])
    prior = np.stack([np.eye(k) * p for p in PRIOR])
    model = Field(np.zeros((SHAPES, k)), prior.copy())
    model.weights[zlib.crc32(b"bias") % SHAPES, 0] = 2.0
    if not len(g.doc):
        return model
    gold = np.where(g.open, -1, np.maximum(g.seen, 0))
    nth = np.arange(len(gold), dtype=np.uint64)
    shown = (g.seen > 0) & (g.doc % 2 == 0) & (nth * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63) == 0)
    mean, var = [np.zeros_like(model.weights), np.zeros_like(prior)], [np.zeros_like(model.weights), np.zeros_like(prior)]
    for step in range(1, steps + 1):
        by_weight, by_pair = gradients(g, model, gold, shown, rounds)
        grads = by_weight / len(gold) - 1e-4 * model.weights, by_pair / len(gold) - PRIOR_WEIGHT * (model.pairs - prior)
        moved = []
        for i, (value, x) in enumerate(zip((model.weights, model.pairs), grads, strict=True)):
            mean[i] = 0.9 * mean[i] + 0.1 * x
            var[i] = 0.99 * var[i] + 0.01 * x * x
            moved.append(value + 0.2 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-6))
        model = Field(*moved)
    return model


def train(docs: DataFrame) -> Field:
    """Fit on a bounded sample: documents with a digit or at sign, drawn by a hash of doc_id and text."""
    known = docs.select("doc_id", "text").where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    rows = drawn(known, SAMPLE_DOCS, "doc_id", "text").select("text").collect()
    return fit([r[0] for r in rows])


def tag(texts: list[str], model: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans, (start, kind, end), of each text."""
    bases = [base_spans(t) for t in texts]
    g = graph(texts, bases)
    whole = [list(b) for b in bases]
    if len(g.doc):
        p = model.marginals(g)
        label = p.argmax(1)
        for n in np.flatnonzero((label > 0) & (p[np.arange(len(label)), label] >= SURE) & (g.seen <= 0)):
            whole[g.doc[n]].append((g.span[n][0], int(label[n]) - 1, g.span[n][1]))
    return [(b, sorted(w)) for b, w in zip(bases, whole, strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _in_parts(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < most):
            held += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def digest(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def tagged(found: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in found:
            out = []
            for texts in _in_parts([x or "" for x in part]):
                for base, whole in tag(texts, model):
                    kinds = [k for _, k, _ in base]
                    out.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(whole)))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        give_back()

    return docs.select("doc_id", tagged(F.col("text")).alias("_t")).select("doc_id", "_t.*")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each maximal stretch of spans becomes <KIND> of its first span."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """The columns of ``docs`` with the spans of ``text`` replaced by their kinds."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(found: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in found:
            out = []
            for texts in _in_parts([x or "" for x in part]):
                out += [redacted(t, whole) for t, (_, whole) in zip(texts, tag(texts, model), strict=True)]
            yield pd.Series([None if x is None else y for x, y in zip(part, out, strict=True)], dtype=object)
        give_back()

    return docs.withColumn("text", clean(F.col("text"))).select(*docs.columns)
