"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are dealt into blocks of bounded size; every block is a reference, its
words counted through in order of the rows' keys. An index over all blocks gives
each run of `window` words that another block has too a place there; places
within a block are found in the block itself. A document is parsed greedily: a
factor goes on as long as the next run's place in the reference goes on, and
where it ends the index is asked again for the run across the boundary. The
words that a factor refers to are fetched from their block and compared byte by
byte with the document's; only words of equal stretches of at least `window`
words are removed. So different text is never taken for equal; that equal text
is found rests on 128-bit keys of its words.

The index is built in two rounds so that little is shuffled. Each run of
`window` words is represented by its anchor, the least key among its `k`-word
grams. Round 1 ships the anchors only and keeps those that two blocks have.
Round 2 ships the keys of runs whose anchor was kept. Both send one packed array
per (block, bucket), each value once, so a passage in a third of all documents
costs one value per block. Of the blocks that have a run, each refers to the one
before it, the first to the second: no block is asked by more than two others
for the same words, however many have them.

Defined results: null and empty texts have no words; repeated rows are
duplicates of one another; extra columns are ignored; null ids are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import SPACE, Slice, free_name, inside, map_arrow, partitions, runs, slices, with_row_key

WINDOW = 35
GRAM = 8
#: Bytes of text in a reference block, about; a block is parsed in one task.
BLOCK_BYTES = 8 << 20
#: Anchors in an index bucket, about.
BUCKET_ANCHORS = 1 << 20

KEPT = "block int, values binary"
PARTS = "bucket int, block int, values binary, places binary, again binary"
MARKS = "block int, own binary, refs binary"
ASKS = "block int, asker int, own binary, ref binary, words binary"
SERVED = "block int, own binary, at binary, words binary, text binary"


def anchored(s: Slice, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, the word index of its anchor, the anchor's key)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = inside(s.woffs, window)
    if not len(at):
        return none
    g = runs(s.word_keys()[0], k)
    # leftmost least gram of each stretch of `width` grams, by doubling; stretches that leave a document are not used
    width = window - k + 1
    val, pos, size = g, np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        right = val[step:] < val[:-step]
        val, pos = np.where(right, val[step:], val[:-step]), np.where(right, pos[step:], pos[:-step])
        size += step
    return at, pos[at], val[at]


def window_keys(s: Slice, window: int) -> np.ndarray:
    """128-bit key of the window at each word, as two columns; those that leave a document are not used."""
    a, b = s.word_keys()
    return np.stack([runs(a, window, 0), runs(b, window, 1)], axis=1)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value that occurs and its positions in order; steps depend on the values that occur only."""
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    g = group[order]
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True):
        yield int(g[lo]), order[lo:hi]


def equal_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys (n x 2) that occur twice or more, and for each the occurrence before it (for the first: the second)."""
    order = np.argsort(keys[:, 0], kind="stable")
    v = keys[order, 0]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((order, keys[order, 1], keys[order, 0]))]
    k = keys[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]).all(axis=1)
    at = np.flatnonzero(same[1:] | same[:-1])
    other = np.where(same[at], at - 1, at + 1)
    return order[at], order[other]


def factors(own: np.ndarray, ref: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (first word, first word in the reference, words) of marked windows and their places in references.

    A factor goes on while the next window is marked and its place is the next one; the window across its end starts
    a factor of its own. Windows at consecutive words lie in one document, so no factor leaves one.
    """
    order = np.argsort(own, kind="stable")
    own, ref = own[order], ref[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1] + 1) | (ref[1:] != ref[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(own))) + window - 1
    return own[at], ref[at], size


def _sorted(texts: pa.Table) -> pa.Table:
    """The rows of a block in order of their keys, so that every pass counts its words alike."""
    return texts.take(pa.array(np.argsort(texts.column("key").to_numpy())))


def _based(texts: pa.Table) -> Iterator[tuple[int, Slice]]:
    """Slices of a sorted block with the number of words before each."""
    base = 0
    for s in slices(texts.column("text")):
        yield base, s
        base += len(s.start)
        s.forget()


class Words:
    """All words of a block, joined by single spaces: any stretch of words is a stretch of bytes."""

    def __init__(self, parts: list[Slice]):
        size = np.concatenate([np.zeros(0, np.int64), *(s.end - s.start for s in parts)])
        self.at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=self.at[1:])
        data = np.full(int(self.at[-1]), 32, np.uint8)
        hole = np.ones(len(data), bool)
        hole[self.at[1:] - 1] = False
        data[hole] = np.concatenate([np.zeros(0, np.uint8), *(s.data[~SPACE[s.data]] for s in parts)])
        self.data = data.tobytes()

    def stretch(self, first: int, words: int) -> bytes:
        return self.data[self.at[first] : self.at[first + words] - 1]


def verified(mine: bytes, other: bytes, first: int, window: int) -> list[tuple[int, int]]:
    """(first word, words) of the stretches of at least `window` words that are equal in two texts of as many words."""
    if mine == other:
        return [(first, mine.count(b" ") + 1)]
    same = [a == b for a, b in zip(mine.split(b" "), other.split(b" "), strict=False)]
    out, lo = [], 0
    for i, x in enumerate([*same, False]):
        if not x:
            if i - lo >= window:
                out.append((first + lo, i - lo))
            lo = i + 1
    return out


def _numbers(table: pa.Table, name: str, kind: type = np.uint64) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in table.column(name).to_pylist() if b]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _kept(table: pa.Table) -> pa.Table:
    """Of one bucket, the anchors that two blocks have, sent back to each of them."""
    vals = [np.frombuffer(b, np.uint64) for b in table.column("values").to_pylist()]
    v = np.concatenate(vals)
    block = np.repeat(table.column("block").to_numpy(), [len(x) for x in vals])
    pair = np.lexsort((block, v))
    v, block = v[pair], block[pair]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (block[1:] != block[:-1])
    v, block = v[first], block[first]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    hit = np.flatnonzero(same[1:] | same[:-1])
    out = [(b, v[hit[at]].tobytes()) for b, at in by_group(block[hit])]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "values": pa.array([x for _, x in out], pa.binary())})


def _marks(table: pa.Table) -> pa.Table:
    """Of one bucket, places of runs that another block has too, each with its place there (block << 32 | word)."""
    vals = [np.frombuffer(b, np.uint64).reshape(-1, 2) for b in table.column("values").to_pylist()]
    n = [len(x) for x in vals]
    v = np.concatenate(vals)
    block = np.repeat(table.column("block").to_numpy(), n).astype(np.uint64)
    place = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("places").to_pylist()]).astype(np.uint64)
    again = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=c).astype(bool) for b, c in zip(table.column("again").to_pylist(), n, strict=True)])
    order = np.argsort(block, kind="stable")
    v, block, place, again = v[order], block[order], place[order], again[order]
    at, other = equal_before(v)
    # a run that its own block repeats is found there
    at, other = at[~again[at]], other[~again[at]]
    refs = block[other] << np.uint64(32) | place[other]
    rows = [(b, place[at[i]].astype(np.uint32).tobytes(), refs[i].tobytes()) for b, i in by_group(block[at].astype(np.int64))]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "own": pa.array([r[1] for r in rows], pa.binary()), "refs": pa.array([r[2] for r in rows], pa.binary())})


def remove_substrings(docs: DataFrame, window: int = WINDOW, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, factors as `first:words`, and kept_text (words joined by a space)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(partitions(spark), math.ceil(total / block_bytes))
    buckets = max(partitions(spark), math.ceil(total / 6 / ((window - k + 2) / 2) / BUCKET_ANCHORS))
    kind = docs.schema[id_col].dataType.simpleString()
    key = free_name(docs, "_row")
    keyed = with_row_key(docs, key)
    # every pass reads all these columns, so that all read one shuffle of the texts
    dealt = keyed.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.repartition(blocks, "block")

    def anchors(batch: pa.RecordBatch):
        block = batch.column(3).to_numpy()
        for b in np.unique(block):
            seen = []
            for s in slices(batch.column(2).filter(pa.array(block == b))):
                _, pos, val = anchored(s, window, k)
                new = np.ones(len(pos), bool)
                new[1:] = pos[1:] != pos[:-1]
                seen.append(val[new])
            v = np.unique(np.concatenate(seen))
            rows = [(i, v[at].tobytes()) for i, at in by_group(bucket_of(v, buckets))]
            if rows:
                yield pa.record_batch([pa.array([i for i, _ in rows], pa.int32()), pa.array([int(b)] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "block", "values"])

    kept = map_arrow(dealt, anchors, "bucket int, block int, values binary").groupBy("bucket").applyInArrow(_kept, KEPT)

    def ship(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        have, keys, places = np.sort(_numbers(marks, "values")), [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        if len(have):
            for base, s in _based(_sorted(texts)):
                at, _, val = anchored(s, window, k)
                if len(at):
                    at = at[have[np.minimum(np.searchsorted(have, val), len(have) - 1)] == val]
                    keys.append(window_keys(s, window)[at])
                    places.append(base + at)
        keys, places = np.concatenate(keys), np.concatenate(places)
        twice, other = equal_before(keys)
        again, drop = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        again[twice] = True
        drop[twice[other < twice]] = True
        keys, places, again = keys[~drop], places[~drop], again[~drop]
        rows = [(i, keys[at].tobytes(), places[at].astype(np.uint32).tobytes(), np.packbits(again[at]).tobytes()) for i, at in by_group(bucket_of(keys[:, 0], buckets))]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("values", "places", "again"), 1)},
            }
        )

    shipped = dealt.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(ship, PARTS)
    marks = shipped.groupBy("bucket").applyInArrow(_marks, MARKS)

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        own, ref, size = factors(_numbers(rows, "own", np.uint32).astype(np.int64), _numbers(rows, "refs").astype(np.int64), window)
        out = [(b, *(x[at].astype(np.uint32).tobytes() for x in (own, ref & 0xFFFFFFFF, size))) for b, at in by_group(ref >> 32)]
        return pa.table(
            {
                "block": pa.array([r[0] for r in out], pa.int32()),
                "asker": pa.array([key[0].as_py()] * len(out), pa.int32()),
                **{c: pa.array([r[i] for r in out], pa.binary()) for i, c in enumerate(("own", "ref", "words"), 1)},
            }
        )

    asks = marks.groupBy("block").applyInArrow(ask, ASKS)

    def serve(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """For each asker, the words of its factors' references, overlapping ones once, and where each factor's start."""
        out = []
        words = Words([s for _, s in _based(_sorted(texts))]) if asked.num_rows else None
        for r in asked.to_pylist():
            ref, size = (np.frombuffer(r[c], np.uint32).astype(np.int64) for c in ("ref", "words"))
            order = np.argsort(ref, kind="stable")
            end = np.maximum.accumulate((ref + size)[order])
            new = np.ones(len(ref), bool)
            new[1:] = ref[order][1:] > end[:-1]
            first, last = ref[order][new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            texts_ = [words.stretch(a, z - a) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
            base = np.cumsum([0, *(len(t) + 1 for t in texts_)])[:-1]
            which = np.empty(len(ref), np.int64)
            which[order] = np.cumsum(new) - 1
            at = base[which] + words.at[ref] - words.at[first[which]]
            out.append((r["asker"], r["own"], at.astype(np.uint32).tobytes(), r["words"], b" ".join(texts_)))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int32()), **{c: pa.array([r[i] for r in out], pa.binary()) for i, c in enumerate(("own", "at", "words", "text"), 1)}})

    served = dealt.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(serve, SERVED)

    def cut(texts: pa.Table, served: pa.Table) -> pa.Table:
        texts = _sorted(texts)
        parts = list(_based(texts))
        words = Words([s for _, s in parts])
        found: list[tuple[int, int]] = []
        for r in served.to_pylist():
            own, at, size = (np.frombuffer(r[c], np.uint32).tolist() for c in ("own", "at", "words"))
            for f, a, n in zip(own, at, size, strict=True):
                mine = words.stretch(f, n)
                other = r["text"][a : a + len(mine)]
                found += verified(mine, other, f, window)
        keys, places = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        for base, s in parts:
            at = inside(s.woffs, window)
            if len(at):
                keys.append(window_keys(s, window)[at])
                places.append(base + at)
                s.forget()
        places = np.concatenate(places)
        a, b = equal_before(np.concatenate(keys))
        for f, r, n in zip(*(x.tolist() for x in factors(places[a], places[b], window)), strict=True):
            found += verified(words.stretch(f, n), words.stretch(r, n), f, window)
        cover = np.zeros(len(words.at), np.int64)
        spans = np.array(sorted(found), np.int64).reshape(-1, 2)
        np.add.at(cover, spans[:, 0], 1)
        np.subtract.at(cover, spans.sum(axis=1), 1)
        gone = np.cumsum(cover[:-1]) > 0
        n_words, n_removed, lists, bufs, sizes = [], [], [], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for base, s in parts:
            g = gone[base : base + len(s.start)]
            c = np.concatenate([[0], np.cumsum(g)])
            n_words.append(s.n_words())
            n_removed.append(c[s.woffs[1:]] - c[s.woffs[:-1]])
            edge = np.searchsorted(spans[:, 0], base + s.woffs)
            lists += [[f"{f - base - w}:{n}" for f, n in spans[x:y].tolist()] for x, y, w in zip(edge[:-1].tolist(), edge[1:].tolist(), s.woffs.tolist(), strict=False)]
            data, size = kept_bytes(s, ~g)
            bufs.append(data)
            sizes.append(size)
        offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        kept_text = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(np.concatenate(bufs)))
        numbers = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"id": texts.column("id"), "n_words": numbers(n_words), "n_removed": numbers(n_removed), "factors": pa.array(lists, pa.list_(pa.string())), "kept_text": kept_text.cast(pa.string())})

    out = dealt.groupBy("block").cogroup(served.groupBy("block")).applyInArrow(cut, f"id {kind}, n_words long, n_removed long, factors array<string>, kept_text string")
    return out.withColumnRenamed("id", id_col)


def kept_bytes(s: Slice, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each document's kept words joined by one space, end to end, and each document's number of bytes."""
    n = len(s.data)
    mark = np.zeros(n + 1, np.int8)
    mark[s.start[keep]] += 1
    mark[s.end[keep]] -= 1
    # the two can fall on one byte only between documents, where both must count
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    doc = s.doc_of_word()[keep]
    more = np.zeros(len(doc), bool)
    more[:-1] = doc[1:] == doc[:-1]
    gap = s.end[keep][more]
    data = s.data.copy()
    data[gap] = 32
    inside[gap] = True
    c = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=c[1:])
    return data[inside], np.diff(c[s.offs])
