"""Line sequence labelling: a linear-chain conditional random field marks lines content or boilerplate.

A line is a \\n-separated piece of the text. Each line has features from counts
of its bytes' classes and its words; the field scores a document's sequence of
lines by those and by the transitions between neighbours. Parameters are fitted
by gradient steps on the exact log-likelihood (forward-backward) over a bounded
sample of labelled documents, whose quality label is put on each of their lines.
Viterbi decoding labels whole documents; documents of one slice are decoded in
step, one line of each at a time. A document is kept if at least `share` of its
words stand in content lines, unless the base rules reject it.

Defined results: null and empty texts have no words and fail the base rules;
repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .core import Slice, dictionary, give_back, inside, labelled_sample, map_arrow, slices

#: Rows of the labelled sample that a model is fitted on, at most.
SAMPLE_ROWS = 3000
N_FEATURES = 13
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERS = np.zeros(256, bool)
_LOWERS[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True


@dataclass
class Model:
    emit: np.ndarray  # feature weights of state content against boilerplate
    trans: np.ndarray  # 2 x 2
    share: float = 0.5


@dataclass
class Lines:
    """Lines of a slice: byte spans, first word, document offsets, hashes."""

    start: np.ndarray
    end: np.ndarray
    loffs: np.ndarray
    words: np.ndarray  # words up to and including each line, with a leading 0
    dup: np.ndarray
    dup_doc: np.ndarray


def cut_lines(s: Slice) -> Lines:
    nl = np.flatnonzero(s.data == 10)
    start = np.sort(np.concatenate([s.offs[:-1], nl + 1]), kind="stable")
    end = np.sort(np.concatenate([s.offs[1:], nl]), kind="stable")
    loffs = np.searchsorted(nl, s.offs) + np.arange(s.n + 1)
    if len(s.data) == 0:
        start = end = np.zeros(s.n, np.int64)
    first = np.searchsorted(s.start, start)
    last = np.searchsorted(s.start, end)
    doc = np.repeat(np.arange(s.n), np.diff(loffs))
    # equal lines by their bytes; a stable order keeps a document's lines in sequence
    line, _ = dictionary(s.data[s.data != 10], np.maximum(end - start, 0))
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again &= last > first
    return Lines(start, end, loffs, np.stack([first, last]), again, doc)


def base_counts(s: Slice, ln: Lines) -> dict[str, np.ndarray]:
    """The counts that need no model, per document."""
    nw = s.n_words()
    inside = ~(s.data == 32) & ~((s.data >= 9) & (s.data <= 13))
    chars = s.per_doc(inside & ((s.data & 0xC0) != 0x80))
    rep = repeated_words(s)
    return {
        "n_words": nw,
        "word_chars": chars,
        "n_symbols": s.per_doc(_SYMBOL[s.data]),
        "n_dup_lines": np.bincount(ln.dup_doc[ln.dup], minlength=s.n),
        "n_repeat_words": np.bincount(s.doc_of_word()[rep], minlength=s.n),
    }


def repeated_words(s: Slice) -> np.ndarray:
    """Whether each word stands in a 3-word window that the same text has twice or more."""
    flag = np.zeros(len(s.start), bool)
    if len(s.start) < 3:
        return flag
    ids, words = s.word_ids()
    at = inside(s.woffs, 3)
    if len(words) < 1 << 21:
        key = (ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:])[at]
    else:
        pair = np.unique(ids[:-1] << 31 | ids[1:], return_inverse=True)[1]
        key = (pair[:-1] << 31 | ids[2:])[at]
    doc = s.doc_of_word()[at]
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    eq = np.zeros(len(k) + 1, bool)
    eq[1:-1] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    hit = at[order[eq[1:] | eq[:-1]]]
    for j in range(3):
        flag[hit + j] = True
    return flag


def line_features(s: Slice, ln: Lines) -> np.ndarray:
    """Lines x N_FEATURES, all within [0, 1]."""
    size = np.maximum(ln.end - ln.start, 0).astype(float)
    first, last = ln.words
    nw = (last - first).astype(float)

    def share(flags: np.ndarray, by: np.ndarray = size) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return (c[np.maximum(ln.end, ln.start)] - c[ln.start]) / np.maximum(by, 1)

    rep = np.zeros(len(s.start) + 1, np.int64)
    np.cumsum(repeated_words(s), out=rep[1:])
    h = s.word_ids()[0] if len(s.start) else np.zeros(0, np.int64)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h):
        np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]), out=same[1:])
    tail = np.zeros(len(size), bool)
    full = ln.end > ln.start
    tail[full] = _STOP[s.data[ln.end[full] - 1]]
    return np.stack(
        [
            np.ones(len(size)),
            np.minimum(np.log2(nw + 1) / 8, 1),
            nw <= 4,
            np.minimum(4 * share(_SYMBOL[s.data]), 1),
            share(_UPPER[s.data]),
            np.minimum(4 * share(_BANG[s.data]), 1),
            np.minimum(4 * share(_DIGIT[s.data]), 1),
            np.minimum(8 * share(_STOP[s.data]), 1),
            tail,
            ln.dup,
            (rep[last] - rep[first]) / np.maximum(nw, 1),
            (same[last] - same[first]) / np.maximum(nw, 1),
            np.minimum(size / np.maximum(nw, 1) / 16, 1),
        ],
        axis=1,
    ).astype(float)


def _steps(loffs: np.ndarray):
    """For each line number, the documents that have it (longest first) and its place in the lines' order."""
    n = np.diff(loffs)
    order = np.argsort(-n, kind="stable")
    size = n[order]
    for t in range(int(size[0]) if len(size) else 0):
        docs = order[: int(np.searchsorted(-size, -t, side="left"))]
        yield t, docs, loffs[docs] + t


def viterbi(score: np.ndarray, loffs: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best state (1: content) of each line; score: emission of state 1 over state 0."""
    n = len(score)
    back = np.zeros((n, 2), np.int8)
    best = np.zeros((len(loffs) - 1, 2))
    for t, docs, at in _steps(loffs):
        e = np.stack([np.zeros(len(at)), score[at]], axis=1)
        if t == 0:
            best[docs] = e
            continue
        cand = best[docs][:, :, None] + trans[None]
        back[at] = cand.argmax(axis=1)
        best[docs] = cand.max(axis=1) + e
    state = np.zeros(n, np.int8)
    now = best.argmax(axis=1).astype(np.int8)
    for _, docs, at in reversed(list(_steps(loffs))):
        state[at] = now[docs]
        now[docs] = back[at, now[docs]]
    return state


def fit(rows: list[tuple[str, int]], steps: int = 80, rate: float = 0.3, l2: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the mean log-likelihood of the lines' label sequences."""
    theta = np.zeros(N_FEATURES + 4)
    if not rows or len({r[1] for r in rows}) < 2:
        theta[0] = 1.0
        return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
    xs, ys, sizes = [], [], []
    # very long texts are whole here too; the sample's rows bound the work
    for s in slices(pa.array([r[0] for r in rows], pa.string())):
        ln = cut_lines(s)
        xs.append(line_features(s, ln))
        sizes.append(np.diff(ln.loffs))
        ys.append(np.repeat([rows[s.lo + d][1] for d in range(s.n)], np.diff(ln.loffs)))
    x, y = np.concatenate(xs), np.concatenate(ys).astype(int)
    loffs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    plan = list(_steps(loffs))
    prev = np.arange(len(y)) - 1
    chain = np.ones(len(y), bool)
    chain[loffs[:-1]] = False
    observed = np.bincount(2 * y[prev[chain]] + y[chain], minlength=4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for it in range(1, steps + 1):
        emit, trans = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        e = np.stack([np.zeros(len(y)), x @ emit], axis=1)
        alpha, beta = e.copy(), np.zeros_like(e)
        for t, _, at in plan[1:]:
            alpha[at] = e[at] + lse((alpha[at - 1][:, :, None] + trans[None]).swapaxes(1, 2))
        for t, _, at in reversed(plan[1:]):
            beta[at - 1] = lse(trans[None] + (e[at] + beta[at])[:, None, :])
        z = np.repeat(lse((alpha + beta)[loffs[:-1]]), np.diff(loffs))
        p = np.exp((alpha + beta)[:, 1] - z)
        pair = np.exp(alpha[prev[chain]][:, :, None] + trans[None] + (e + beta)[chain][:, None, :] - z[chain][:, None, None]).sum(axis=0)
        g = np.concatenate([(y - p) @ x, (observed - pair.ravel())]) / len(rows) - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.999**it)) + 1e-8) * (0.98**it)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base counts, base_failed, the words in content lines, the lines' states, kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in [*names, "content_words", "states"]}
        for s in slices(b.column(1)):
            ln = cut_lines(s)
            for k, v in base_counts(s, ln).items():
                cols[k].append(v)
            state = viterbi(line_features(s, ln) @ model.emit, ln.loffs, model.trans)
            words = ln.words[1] - ln.words[0]
            c = np.zeros(len(words) + 1, np.int64)
            np.cumsum(words * state, out=c[1:])
            cols["content_words"].append(c[ln.loffs[1:]] - c[ln.loffs[:-1]])
            text = (state + 48).astype(np.uint8).tobytes().decode()
            cols["states"] += [text[x:y] for x, y in zip(ln.loffs[:-1].tolist(), ln.loffs[1:].tolist(), strict=True)]
        v = {k: np.concatenate(cols[k]).astype(np.int64) for k in [*names, "content_words"]}
        failed = (v["n_words"] < 50) | (100 * v["n_repeat_words"] > 50 * v["n_words"])
        kept = ~failed & (v["content_words"] >= model.share * v["n_words"])
        return pa.record_batch(
            [b.column(0), *(pa.array(v[k]) for k in names), pa.array(failed), pa.array(v["content_words"]), pa.array(cols["states"], pa.string()), pa.array(kept)],
            ["id", *names, "base_failed", "content_words", "line_states", "kept"],
        )

    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, content_words long, line_states string, kept boolean"
    return map_arrow(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def fit_lines(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, folds: int = 5, held: int = 0, **kw) -> Model:
    model = fit(labelled_sample(docs, labels, "quality", folds, held, bound), **kw)
    give_back()
    return model
