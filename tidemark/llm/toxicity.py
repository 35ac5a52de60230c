"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors.

Fit (bounded labelled sample): each token's log-odds between toxic and clean
documents under an informative Dirichlet prior proportional to its overall
count, divided by its standard deviation; tokens beyond `z_least` keep their
log-odds, every other token costs a constant, so that chance text drifts down.

Score: a linear-time scan finds every maximal scoring segment of the text. A
segment's score S among n tokens has the extreme-value probability
1 - exp(-K n exp(-lambda S)); lambda solves sum p exp(lambda s) = 1 on clean
text and K is fitted to clean documents' best segments. Segments below
`p_segment` are toxic passages. The document's evidence, minus the log of the
product of their probabilities, passes a two-parameter logistic fitted on the
sample, in which the rarer label weighs more by the root of its rarity. All work on scoring text is on whole texts.

Defined results: null and empty texts have no segments and get the score of no
evidence; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .core import Slice, give_back, labelled_sample, map_arrow, slices

#: Rows of the labelled sample that a model is fitted on, at most.
SAMPLE_ROWS = 5000
#: Dirichlet prior of a token: this much for any token, and this share of its count in both classes.
PRIOR_FLAT, PRIOR_SHARE = 1.0, 0.02
TABLE_BITS = 20
#: Byte lengths of the stems that count as tokens beside the word itself.
STEMS = (5, 6, 7, 8)
_STRIP = np.zeros(256, bool)
_STRIP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of scored tokens
    weights: np.ndarray
    cost: float
    lam: float
    k: float
    slope: float
    bias: float
    p_segment: float


def tokens(s: Slice) -> list[np.ndarray]:
    """Hashes of each word, A-Z lower-cased, without ASCII punctuation at its ends, and of its stems.

    A stem is the first STEMS[i] bytes; compounding languages put one offensive stem into many words.
    A word that is no longer than a stem has that stem's hash set to 0, which no model holds.
    """
    if not len(s.start):
        return [np.zeros(0, np.uint64)] * (1 + len(STEMS))
    start, end = s.start.copy(), s.end.copy()
    for _ in range(8):
        go = _STRIP[s.data[start]] & (end - start > 1)
        if not go.any():
            break
        start[go] += 1
    for _ in range(8):
        go = _STRIP[s.data[end - 1]] & (end - start > 1)
        if not go.any():
            break
        end[go] -= 1
    low = Slice(_LOWER[s.data], s.offs, start, end, s.woffs, s.lo, s.hi)
    out = [low.span_hash(start, end)]
    for i, k in enumerate(STEMS):
        h = low.span_hash(start, np.minimum(start + k, end)) ^ np.uint64(0x5851F42D4C957F2D * (i + 1) & (2**64 - 1))
        h[end - start <= k] = 0
        out.append(h)
    return out


def segments(pos: np.ndarray, w: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of one document; pos: indices of scored tokens, others cost `cost`.

    Linear time: only scored tokens are visited, gaps enter as their summed cost, and each segment keeps a link to the
    last one before it that starts at a lower sum, so segments that start higher are passed over at once.
    """
    out: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, link
    cum, prev = 0.0, -1
    for p, x in zip(pos.tolist(), w.tolist(), strict=True):
        cum -= cost * (p - prev - 1)
        left, cum, prev = cum, cum + x, p
        if x <= 0:
            continue
        first, j = p, len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= cum:
                break
            left, _, first, _, link = out[j]
            del out[j:]
            j = link
        out.append((left, cum, first, p, j))
    return [(a, b, r - lo) for lo, r, a, b, _ in out]


def _lookup(model_keys: np.ndarray, weights: np.ndarray, h: np.ndarray) -> np.ndarray:
    small = np.zeros(1 << TABLE_BITS, bool)
    shift = np.uint64(64 - TABLE_BITS)
    small[(model_keys >> shift).astype(np.int64)] = True
    at = np.flatnonzero(small[(h >> shift).astype(np.int64)])
    i = np.minimum(np.searchsorted(model_keys, h[at]), len(model_keys) - 1)
    hit = model_keys[i] == h[at]
    return at[hit], weights[i[hit]]


def scored(s: Slice, toks: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words with a scored token, and the best of their tokens' weights."""
    w = np.full(len(s.start), -np.inf)
    for h in toks:
        at, x = _lookup(m.keys, m.weights, h)
        np.maximum.at(w, at, x)
    at = np.flatnonzero(w > -np.inf)
    return at, w[at]


def document_segments(s: Slice, m: Model) -> list[list[tuple[int, int, float]]]:
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(s.n)]
    if len(m.keys):
        at, w = scored(s, tokens(s), m)
        cut = np.searchsorted(at, s.woffs)
        for d in np.flatnonzero(np.diff(cut)):
            a, b = cut[d], cut[d + 1]
            out[d] = segments(at[a:b] - s.woffs[d], w[a:b], m.cost)
    return out


def p_value(score: float, n: int, m: Model) -> float:
    return -math.expm1(-min(50.0, m.k * max(n, 1) * math.exp(-min(700.0, m.lam * score))))


def evidence(segs: list[tuple[int, int, float]], n: int, m: Model) -> tuple[float, int]:
    """Minus the log of the product of the significant segments' probabilities, and their number."""
    total, count = 0.0, 0
    for _, _, sc in segs:
        p = max(p_value(sc, n, m), 1e-30)
        if p < m.p_segment:
            total -= math.log(p)
            count += 1
    return total, count


def fit(rows: list[tuple[str, int]], z_least: float = 3.0, cost: float = 0.03, p_segment: float = 0.1) -> Model:
    """Fit on (text, label) rows. Without rows of both labels nothing is toxic."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), cost, 1.0, 1.0, 1.0, -5.0, p_segment)
    y = np.array([r[1] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return none
    texts = pa.array([r[0] for r in rows], pa.string())
    toks, tox, all_ = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for s in slices(texts):
        # only sums are kept, so memory follows the vocabulary and not the text
        doc = np.repeat(np.arange(s.n, dtype=np.uint64), s.n_words())
        hs = []
        for h in tokens(s):
            # once per document: a repeated word is no further evidence about the word
            order = np.lexsort((h, doc))
            d, g = doc[order], h[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            new &= g != 0
            hs.append((g[new], y[s.lo + d[new].astype(np.int64)]))
        u, inv = np.unique(np.concatenate([toks, *(g for g, _ in hs)]), return_inverse=True)
        tox = np.bincount(inv, weights=np.concatenate([tox, *(z for _, z in hs)]), minlength=len(u))
        all_ = np.bincount(inv, weights=np.concatenate([all_, *(np.ones(len(g)) for g, _ in hs)]), minlength=len(u))
        toks = u
        del u, inv, hs
    clean = all_ - tox
    prior = PRIOR_FLAT + PRIOR_SHARE * all_
    a, b = tox + prior, clean + prior
    na, nb = tox.sum() + prior.sum(), clean.sum() + prior.sum()
    delta = np.log(a / (na - a)) - np.log(b / (nb - b))
    z = delta / np.sqrt(1 / a + 1 / b)
    keep = z >= z_least
    if not keep.any():
        return none
    m = Model(toks[keep], delta[keep], cost, 1.0, 1.0, 1.0, 0.0, p_segment)
    best, length, segs_of = [], [], []
    levels = np.unique(m.weights)
    freq, total = np.zeros(len(levels)), 0
    for s in slices(texts):
        own = tokens(s)
        nw = s.n_words()
        for d, segs in enumerate(document_segments(s, m)):
            segs_of.append(segs)
            length.append(int(nw[d]))
            best.append(max((x[2] for x in segs), default=0.0))
        cl = np.repeat(y[s.lo : s.hi] == 0, nw)
        at, w = scored(s, own, m)
        total += int(cl.sum())
        got, n = np.unique(np.searchsorted(levels, w[cl[at]]), return_counts=True)
        freq[got] += n
    p = (freq + 0.01) / (total + 1)
    lo, hi = 1e-6, 50.0  # sum p e^(lambda w) + (1 - sum p) e^(-lambda cost) = 1
    for _ in range(80):
        mid = (lo + hi) / 2
        v = float(np.sum(p * np.exp(np.minimum(mid * levels, 500)))) + (1 - p.sum()) * math.exp(-mid * cost)
        lo, hi = (mid, hi) if v < 1 else (lo, mid)
    m.lam = max((lo + hi) / 2, 1e-3)
    best_, length_ = np.array(best), np.array(length)
    neg = y == 0
    with_s = neg & (best_ > 0)
    # expected number of clean segments at least this high, matched in total: sum K n e^(-lambda S) = documents
    m.k = float(max(1e-9, max(int(with_s.sum()), 1) / max(np.sum(length_[neg] * np.exp(-m.lam * np.where(best_[neg] > 0, best_[neg], 0.5 / m.lam))), 1e-9)))
    x = np.array([evidence(sg, n, m)[0] for sg, n in zip(segs_of, length_.tolist(), strict=True)])
    x = np.log1p(x)
    w, c = 1.0, -1.0
    # a label weighs by the root of its rarity, between the sample's own odds and even ones
    share = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    for _ in range(200):  # Newton steps of a ridge logistic
        q = 1 / (1 + np.exp(-np.clip(w * x + c, -30, 30)))
        g = np.array([np.sum(share * (q - y) * x) + 1e-2 * w, np.sum(share * (q - y)) + 1e-2 * c])
        r = share * q * (1 - q) + 1e-9
        hess = np.array([[np.sum(r * x * x) + 1e-2, np.sum(r * x)], [np.sum(r * x), np.sum(r) + 1e-2]])
        step = np.linalg.solve(hess, g)
        w, c = w - step[0], c - step[1]
        if abs(step).max() < 1e-8:
            break
    m.slope, m.bias = float(w), float(c)
    return m


def score_of(total: float, m: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * math.log1p(total) + m.bias))))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, n_segments and the significant segments as word spans `first:last:score`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score, number, spans = [], [], []
        for s in slices(b.column(1)):
            nw = s.n_words().tolist()
            for d, segs in enumerate(document_segments(s, model)):
                total, count = evidence(segs, nw[d], model)
                score.append(score_of(total, model))
                number.append(count)
                spans.append([f"{a}:{z}:{sc:.3f}" for a, z, sc in segs if p_value(sc, nw[d], model) < model.p_segment])
        return pa.record_batch(
            [b.column(0), pa.array(score, pa.float64()), pa.array(number, pa.int32()), pa.array(spans, pa.list_(pa.string()))],
            ["id", "score", "n_segments", "segments"],
        )

    out = map_arrow(docs.select(id_col, text_col), run, f"id {kind}, score double, n_segments int, segments array<string>")
    return out.withColumnRenamed("id", id_col)


def filter_toxic(docs: DataFrame, model: Model, at: float, text_col: str = "text") -> DataFrame:
    """docs without the rows that score `at` or more; columns and row order within partitions as they were."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep: list[bool] = []
        for s in slices(b.column(where)):
            nw = s.n_words().tolist()
            keep += [score_of(evidence(segs, nw[d], model)[0], model) < at for d, segs in enumerate(document_segments(s, model))]
        return b.filter(pa.array(keep, pa.bool_()))

    where = docs.columns.index(text_col)
    return map_arrow(docs, run, docs.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, folds: int = 3, held: int = 1, **kw) -> Model:
    model = fit(labelled_sample(docs, labels, "toxic", folds, held, bound), **kw)
    give_back()
    return model
