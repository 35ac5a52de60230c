"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct k-word shingles. Each of `M` registers is
the truncated logarithm, to base `B`, of the least exponential variate over the
set: registers of a union are the elementwise maxima, and two sets agree in a
register about as often as their Jaccard similarity. Bands of `ROWS` registers
are hashed; documents that share a band are candidates. For a candidate pair
the numbers of equal, larger and smaller registers and the two set sizes give
the similarity of greatest likelihood; pairs far below the threshold end there,
all others are confirmed on their full sets with integer arithmetic.

Equal sets are one node. Pairs of a band are not expanded: first the band's
most central set (it shares most bands) is compared with the others, which
joins a group of n near copies by about n comparisons. Only bands whose sets
then are in several components go on: their sets are dealt into chunks of about
CHUNK, and chunks are compared with chunks by their registers in blocks inside
a task. For a band of up to FEW sets, a row leaves it for two sets of different
components whose sizes and registers allow the threshold; full sets are
compared outside. In larger bands such pairs are confirmed on the full sets
inside the block, all at once, and only the links of a spanning forest of the
block's components leave it, so a block of many alike sets gives few rows. No
link between components is lost either way.

Misses: a pair at exactly the threshold of 0.8 shares no band with probability
(1 - 0.8**ROWS)**BANDS = 3e-6, and falls below the estimate's margin of five
standard deviations with probability below 1e-6. Shingles are compared by 64-bit
keys made from 128-bit keys of their words: a set of a million shingles has a
wrong size with probability below 3e-8, one of 300 below 3e-15.

Defined results: null and empty texts have no set and link with nothing; a text
of fewer than k words has its whole sequence as one shingle; rows that repeat a
doc_id are one node; a null doc_id is never linked and has component null and
is kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .core import Slice, free_name, keep, map_arrow, materialize, mix, scratch, sift, slices, windows, with_row_key, without

SHINGLE = 5
#: Similarity threshold in hundredths, so that it is compared exactly.
PERCENT = 80
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register value less one.
B, A, Q = 1.001, 20.0, 65534
MARGIN = 0.16
#: Sets in a chunk, about. A block of two chunks is compared in about a megabyte.
CHUNK = 256
#: Bytes of full sets in a chunk, about, where blocks carry them.
CHUNK_BYTES = 2 << 20
#: Bands of up to FEW sets give their plausible pairs, at most FEW / 2 a set; blocks of larger bands confirm theirs.
FEW = 8
#: Shingles whose incidence is multiplied at once.
TILE = 4096

_rng = np.random.default_rng(90210)
_MUL = _rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, M, dtype=np.uint64)


def shingle_sets(s: Slice, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys (64 bits) of each document, ascending, end to end; and the documents' offsets into them."""
    h = s.word_hash(lower) if len(s.start) else np.zeros(0, np.uint64)
    w, at = windows(h, s.woffs, k)
    d = s.doc_of_word()[at]
    nw = s.n_words()
    short = np.flatnonzero((nw > 0) & (nw < k))
    if len(short):
        acc = np.full(len(short), 0x1F83D9ABFB41BD6B, np.uint64)
        for j in range(k - 1):
            has = nw[short] > j
            acc[has] = mix(acc[has] * np.uint64(31) + h[s.woffs[short[has]] + j])
        w, d = np.concatenate([w, acc]), np.concatenate([d, short])
    order = np.argsort(w, kind="stable")
    order = order[np.argsort(d[order].astype(np.uint16 if s.n <= 1 << 16 else np.int64), kind="stable")]
    w, d = w[order], d[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    return w[new], np.searchsorted(d[new], np.arange(s.n + 1))


def registers(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents x M registers of non-empty sets (rows of empty sets are 0)."""
    n = len(offs) - 1
    out = np.zeros((n, M), np.uint16)
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return out
    starts, v = offs[full], mix(x)
    least = np.empty((M, len(full)), np.uint64)
    buf = np.empty_like(v)
    for j in range(M):
        np.multiply(v, _MUL[j], out=buf)
        np.add(buf, _ADD[j], out=buf)
        np.minimum.reduceat(buf, starts, out=least[j])
    u = (least.T.astype(np.float64) + 0.5) / 2.0**64
    e = -np.log1p(-u) / A
    out[full] = np.clip(np.floor(1 - np.log(e) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def likeliest(eq: np.ndarray, above: np.ndarray, below: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood given register comparisons and set sizes, on a grid of hundredths."""
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (B - 1) / B) / np.log(B)
    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-12)
    like = above[:, None] * np.log(up) + below[:, None] * np.log(down) + eq[:, None] * np.log(same)
    like = np.where((u - v * j < -1e-9) | (v - u * j < -1e-9), -np.inf, like)
    return j[0][like.argmax(axis=1)]


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), k1 and k2 (128 bits that identify the set), regs (M unsigned 16-bit registers)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch):
        for s in slices(b.column(1)):
            x, offs = shingle_sets(s, k)
            regs = registers(x, offs)
            keys = []
            for salt in (3, 5):
                c = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(mix(x * np.uint64(salt) + np.uint64(salt)), out=c[1:])
                keys.append((c[offs[1:]] - c[offs[:-1]]).view(np.int64))
            yield pa.record_batch(
                [b.column(0).slice(s.lo, s.n), pa.array(np.diff(offs), pa.int64()), *map(pa.array, keys), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["id", "n", "k1", "k2", "regs"],
            )

    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, n long, k1 long, k2 long, regs binary")


def band_keys(sets: DataFrame) -> DataFrame:
    """(band, node): a row for each band of each set."""
    kind = sets.schema["node"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), regs.shape[:2]).copy()
        for r in range(ROWS):
            acc = mix(acc * np.uint64(31) + regs[:, :, r])
        who = pa.array(np.repeat(np.arange(len(regs)), BANDS))
        yield pa.record_batch([pa.array(acc.ravel().view(np.int64)), b.column(0).take(who)], ["band", "node"])

    return map_arrow(sets.select("node", "regs"), run, f"band long, node {kind}")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each set of xs with each of ys, as products of incidence matrices, TILE shingles at a time."""
    nx, lens = len(xs), [len(v) for v in (*xs, *ys)]
    row = np.repeat(np.arange(len(lens)), lens)
    _, col = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    n = int(col.max()) + 1 if len(col) else 0
    shared = (np.bincount(col[row < nx], minlength=n) > 0) & (np.bincount(col[row >= nx], minlength=n) > 0)
    rank = np.cumsum(shared) - 1
    row, col = row[shared[col]], rank[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((nx, len(ys)), np.int64)
    for lo in range(0, int(shared.sum()), TILE):
        p, q = np.searchsorted(col, [lo, lo + TILE])
        hit = np.zeros((len(lens), TILE), np.float32)
        hit[row[p:q], col[p:q] - lo] = 1
        out += (hit[:nx] @ hit[nx:].T).astype(np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of links (a, b) between n components that suffice to join all that they join."""
    up, kept = list(range(n)), []
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    for k in first.tolist():
        x, y = int(a[k]), int(b[k])
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[y] = x
            kept.append(k)
    return kept


def _blocks(open_: DataFrame, sets: DataFrame, percent: int, full: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of open_ (band, node, m, c) between components, m members of the band, c the node's component.

    Without full sets, all plausible pairs; with them, confirmed links, a spanning forest of each block's components.
    A node of several rows in sets and full gives each of their combinations.
    """
    kind = sets.schema["node"].dataType.simpleString()
    rows = open_.join(sets.select("node", "n", "regs"), "node")
    parts = F.ceil(F.col("m") / CHUNK)
    cols = ["node", "c", "n", "regs"]
    inside = full is not None
    if inside:
        weight = rows.groupBy("band").agg(F.sum("n").alias("weight"))
        rows = rows.join(weight, "band").join(full, "node")
        parts = F.greatest(parts, F.ceil(F.col("weight") * 8 / CHUNK_BYTES))
        cols.append("shingles")
    rows = rows.withColumn("parts", parts.cast("int"))
    deal = F.pmod(F.xxhash64("node", "band"), F.col("parts")).cast("int")
    chunks = rows.groupBy("band", "parts", deal.alias("i")).agg(*(F.collect_list(c).alias(c) for c in cols))
    left = chunks.select("band", F.explode(F.sequence("i", F.col("parts") - 1)).alias("j"), *(F.col(c).alias("l_" + c) for c in cols))
    right = chunks.select("band", F.col("i").alias("j"), *(F.col(c).alias("r_" + c) for c in cols))

    def run(b: pa.RecordBatch):
        for k in range(b.num_rows):
            sides = [b.column(i)[k].values for i in range(b.num_columns)]
            (a1, c1, n1, r1), (a2, c2, n2, r2) = sides[:4], sides[len(cols) : len(cols) + 4]
            who = pa.concat_arrays([c1, c2]).dictionary_encode().indices.to_numpy()
            c1, c2 = who[: len(c1)], who[len(c1) :]
            n1, n2 = n1.to_numpy(zero_copy_only=False).astype(float), n2.to_numpy(zero_copy_only=False).astype(float)
            may = (c1[:, None] != c2[None]) & (100 * np.minimum(n1[:, None], n2[None]) >= percent * np.maximum(n1[:, None], n2[None]))
            if not may.any():
                continue
            x, y = (np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(-1, M) for r in (r1, r2))
            same = np.zeros(may.shape, np.int16)
            for r in range(M):
                same += x[:, r, None] == y[None, :, r]
            p, q = np.nonzero(may & (same >= (percent / 100 - 2 * MARGIN) * M))
            ok = np.zeros(len(p), bool)
            for lo in range(0, len(p), 4096):
                u, v = p[lo : lo + 4096], q[lo : lo + 4096]
                s, t = x[u], y[v]
                ok[lo : lo + 4096] = likeliest((s == t).sum(axis=1), (s > t).sum(axis=1), (s < t).sum(axis=1), n1[u], n2[v]) >= percent / 100 - MARGIN
            p, q = p[ok], q[ok]
            if inside and len(p):
                (us, pi), (vs, qi) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
                xs = [np.frombuffer(sides[4][int(i)].as_buffer(), np.uint64) for i in us]
                ys = [np.frombuffer(sides[9][int(i)].as_buffer(), np.uint64) for i in vs]
                both = overlaps(xs, ys)[pi, qi]
                union = np.array([len(v) for v in xs])[pi] + np.array([len(v) for v in ys])[qi] - both
                ok = (both > 0) & (100 * both >= percent * union)
                p, q = p[ok], q[ok]
                tree = forest(c1[p], c2[q], int(who.max()) + 1)
                p, q = p[tree], q[tree]
            for lo in range(0, len(p), 4096):
                yield pa.record_batch([a1.take(pa.array(p[lo : lo + 4096])), a2.take(pa.array(q[lo : lo + 4096]))], ["a", "b"])

    both = left.join(right, ["band", "j"]).select(*("l_" + c for c in cols), *("r_" + c for c in cols))
    pairs = map_arrow(both, run, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the threshold and whose likeliest similarity is not far below it."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    kind = sets.schema["node"].dataType.simpleString()
    near = pairs.join(left, "a").join(right, "b").where((100 * F.least("na", "nb")) >= percent * F.greatest("na", "nb"))

    def run(b: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
        n1, n2 = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
        j = likeliest((x == y).sum(axis=1), (x > y).sum(axis=1), (x < y).sum(axis=1), n1, n2)
        ok = pa.array(j >= percent / 100 - MARGIN)
        yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return map_arrow(near.select("a", "b", "na", "nb", "ra", "rb"), run, f"a {kind}, b {kind}")


def _confirm(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets meet 100 * intersection >= percent * union."""
    kind = shingles.schema["node"].dataType.simpleString()
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(b: pa.RecordBatch):
        ok, last, x = [], None, None
        for sa, sb in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
            z = np.concatenate([p, q])
            z.sort(kind="stable")
            both = int((z[1:] == z[:-1]).sum())
            ok.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        ok = pa.array(ok, pa.bool_())
        yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id it reaches), kept (it is that id).

    The result is stored in the shared folder; sketches, sets and links are deleted once it is written.
    """
    with scratch():
        return keep(materialize(_near_duplicates(docs, k, percent, id_col, text_col), "classes"))


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    feats = materialize(sketches(docs, k, id_col, text_col), "sketches")
    known = feats.where("id is not null and n > 0")
    sets = materialize(
        known.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.first("regs").alias("regs"), F.count("*").alias("copies")), "sets"
    )
    bands = band_keys(sets)
    groups = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("m")).where("low < high")
    shared = materialize(bands.join(groups.select("band", "m"), "band"), "shared")
    # full sets of every node that shares a band with another, of few others; a doc_id with several rows has several
    some = materialize(shared.select("node").distinct(), "some")

    def full(b: pa.RecordBatch):
        for s in slices(b.column(1)):
            x, offs = shingle_sets(s, k)
            blobs = [x[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.record_batch([b.column(0).slice(s.lo, s.n), pa.array(blobs, pa.binary())], ["node", "shingles"])

    texts = sift(docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")), "node", some)
    shingles = materialize(map_arrow(texts, full, f"node {kind}, shingles binary"), "shingles")

    copies = known.join(sets.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    # the most central set of each band against the others
    degree = shared.groupBy("node").agg(F.sum("m").alias("degree"))
    pivots = shared.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("p")).select("band", F.col("p.node").alias("pivot"))
    met = shared.join(pivots, "band")
    pairs = met.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    links = materialize(_confirm(_plausible(pairs, sets, percent), shingles, percent).unionByName(copies), "links")
    # bands that still have sets of several components, beyond the two of a band of two
    roots = components(links).select("node", F.col("component").alias("c"))
    named = shared.where("m > 2").join(roots, "node", "left").withColumn("c", F.coalesce("c", "node"))
    several = named.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("band")
    open_ = materialize(named.join(several, "band").select("band", "node", "m", "c"), "open")
    if open_.isEmpty():
        comp = roots.select("node", F.col("c").alias("component"))
    else:
        few, many = open_.where(F.col("m") <= FEW), open_.where(F.col("m") > FEW)
        inside = _blocks(many, sets, percent, shingles).select(F.col("a").alias("u"), F.col("b").alias("v"))
        more = _confirm(_blocks(few, sets, percent), shingles, percent).unionByName(inside)
        comp = components(more.unionByName(roots.where("node <> c").select(F.col("node").alias("u"), F.col("c").alias("v"))))
    nodes = comp.select(F.col("node").alias("id"), F.col("component"))
    out = feats.select("id", F.col("n").alias("n_shingles")).join(nodes, "id", "left")
    linked = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", linked.alias("component_id"), (F.col("id").isNull() | (F.col("id") == linked)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one of least id, null last. Each row is judged by itself: ids may be null or repeated."""
    key = free_name(docs, "_row")
    keyed = with_row_key(docs, key)
    marks = near_duplicates(keyed, k, percent, key, text_col)
    twins = materialize(marks.where(~F.col("kept")).select(F.col(key).alias("_k"), F.col("component_id").alias("_c")), "twins")
    members = twins.unionByName(twins.select(F.col("_c").alias("_k"), "_c").distinct())
    order = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("_k").alias("k"))
    named = members.join(keyed.select(F.col(key).alias("_k"), id_col), "_k")
    best = named.groupBy("_c").agg(F.min(order).alias("_b")).select(F.col("_b.k").alias("_k"))
    gone = members.select("_k").join(best, "_k", "left_anti")
    return without(keyed, key, materialize(gone, "gone")).drop(key)
