"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features are hashes into 2**BITS buckets of word unigrams and bigrams, and of
1- to 3-grams over word shapes (which character classes a word has, its last
byte, whether it repeats the word before), plus one token for the length of the
text. A feature's value is its count over the number of words. Training makes
per-coordinate FTRL-proximal updates on a bounded labelled sample; scoring is a
sparse dot product, computed for a slice of whole documents at once.

Defined results: null and empty texts have the length token only; repeated rows
each give a row; extra columns are ignored. Without labels the score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .core import Slice, give_back, labelled_sample, map_arrow, mix, slices

#: Rows of the labelled sample that a model is fitted on, at most.
SAMPLE_ROWS = 8000
BITS = 18
SCALE = 8.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in "#*$%&<>"]] = 8
_CLASS[ord("|")] = 16
_CLASS[ord("!")] = 32
_CLASS[[ord(c) for c in ".,;:?"]] = 64
_CLASS[128:] = 128


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(s: Slice) -> tuple[list[np.ndarray], np.ndarray]:
    """Per kind of n-gram, a bucket for each word (an n-gram stands at its last word; 0 where it would leave the text), and the length token of each document."""
    nw = s.n_words()
    length = _bucket(np.minimum(np.log2(nw + 1.0) * 2, 40).astype(np.uint64), 99)
    if not len(s.start):
        return [], length
    h = s.word_hash()
    shape = np.bitwise_or.reduceat(_CLASS[s.data], s.start).astype(np.uint64)
    last = s.data[s.end - 1].astype(np.uint64)
    last[last >= 128] = 1
    last[(last >= 97) & (last < 123)] = 2
    same = np.zeros(len(h), np.uint64)
    same[1:] = h[1:] == h[:-1]
    shape = shape << np.uint64(9) | last << np.uint64(1) | same
    pos = np.arange(len(h)) - np.repeat(s.woffs[:-1], nw)

    def gram(x: np.ndarray, n: int, salt: int) -> np.ndarray:
        g = x.copy()
        for k in range(1, n):
            g[k:] = mix(g[k:] * np.uint64(31) + x[:-k] * np.uint64(2 * k + 1))
        b = _bucket(g, salt)
        b[pos < n - 1] = 0
        return b

    return [gram(h, 1, 1), gram(h, 2, 2), gram(shape, 1, 3), gram(shape, 2, 4), gram(shape, 3, 5)], length


def margins(s: Slice, m: Model) -> np.ndarray:
    kinds, length = features(s)
    nw = s.n_words()
    out = np.full(s.n, m.bias) + m.weights[length]
    for b in kinds:
        c = np.zeros(len(b) + 1)
        np.cumsum(m.weights[b], out=c[1:])
        out += (c[s.woffs[1:]] - c[s.woffs[:-1]]) * (SCALE / np.maximum(nw, 1))
    return out


def fit(rows: list[tuple[str, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 0.05, l1: float = 0.002, l2: float = 0.02) -> Model:
    """FTRL-proximal over (text, label) rows, in a fixed shuffled order."""
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    zb = nb = wb = 0.0
    if not rows:
        return Model(w, 0.0)
    xs: list[tuple[np.ndarray, np.ndarray]] = []
    for s in slices(pa.array([r[0] for r in rows], pa.string())):
        kinds, length = features(s)
        for d in range(s.n):
            a, b = s.woffs[d], s.woffs[d + 1]
            idx = np.concatenate([k[a:b] for k in kinds]) if kinds else np.zeros(0, np.int64)
            i, c = np.unique(idx, return_counts=True)
            xs.append((np.append(i, length[d]), np.append(c * (SCALE / max(b - a, 1)), 1.0)))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x = xs[r]
            zi, ni = z[i], n[i]
            w[i] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            wb = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ x) + wb)))) - rows[r][1]
            gi = g * x
            sigma = (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / alpha
            z[i] = zi + gi - sigma * w[i]
            n[i] = ni + gi * gi
            sb = (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha
            zb, nb = zb + g - sb * wb, nb + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    # bucket 0 stands for n-grams that would leave the text
    w[0] = 0.0
    return Model(w, wb)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score in (0, 1), n_words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, nw = [], []
        for s in slices(b.column(1)):
            m.append(margins(s, model))
            nw.append(s.n_words())
        score = 1 / (1 + np.exp(-np.clip(np.concatenate(m), -30, 30)))
        return pa.record_batch([b.column(0), pa.array(score), pa.array(np.concatenate(nw), pa.int64())], ["id", "score", "n_words"])

    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, score double, n_words long").withColumnRenamed("id", id_col)


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, folds: int = 5, held: int = 0, **kw) -> Model:
    model = fit(labelled_sample(docs, labels, "quality", folds, held, bound), **kw)
    give_back()
    return model
