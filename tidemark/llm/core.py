"""Shared pieces of the training-data operators: vectorised words, their keys and
windows over Arrow string batches, row keys, and the labelled sample.

Words are runs of bytes other than the six ASCII white-space characters. They
are found for a whole slice of documents at once with numpy. A word has 128 bits
of keys: up to 16 bytes one-to-one, longer ones by BLAKE2b of the slice's
distinct words, so that different words have different keys whatever they are
made of. Keys of runs of words are combined by a tree of non-linear steps. Where
only one slice is looked at, words and lines are told apart by their bytes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import keep, materialize, release, scratch, table

#: Text bytes that one vectorised step works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch that goes to a Python worker, about; bounds the worker's and the executor's buffers.
BATCH_BYTES = 8 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: Masks of the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own on each row, the same however often the frame is read.

    A frame that is just files has such a number already: the row's place in its file. Any other
    frame is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")
        return docs
    spark, path, row = docs.sparkSession, F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = sorted(r.p for r in docs.select(path.alias("p")).distinct().collect())  # one row a file
    cols = docs.columns
    numbered = spark.createDataFrame([(p, i) for i, p in enumerate(files)], f"{name}_p string, {name}_f long")
    keyed = docs.select(*cols, path.alias(f"{name}_q"), row.alias(name)).join(F.broadcast(numbered), F.col(f"{name}_q") == F.col(f"{name}_p"))
    return keyed.select(*cols, (F.shiftleft(f"{name}_f", 40) + F.col(name)).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with a number where df has such a column."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


#: Bytes of marks that may be broadcast, about: two a mark, BLOCK_BYTES for each block that has any.
MARKS_BYTES, BLOCK_BYTES = 32 << 20, 128


def _by_marks(rows: DataFrame, marks: DataFrame, block: Column, place: Column, how: str) -> DataFrame | None:
    """rows joined (left_semi or left_anti) with marks (block, place), which are broadcast as one array of places a block.

    Rows stay where they are. None where the marks are too many to broadcast.
    """
    b, at = free_name(rows, "_block"), free_name(rows, "_places")
    packed = materialize(marks.groupBy(F.col("block").alias(b)).agg(F.collect_list("place").alias(at)), "marks")
    if (packed.agg(F.sum(2 * F.size(at) + BLOCK_BYTES)).first()[0] or 0) > MARKS_BYTES:
        release(packed)
        return None
    return rows.join(F.broadcast(packed), (block == F.col(b)) & F.array_contains(at, place), how)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows without those whose number from with_row_key gone (_k) has; shuffled only where these are too many to broadcast."""
    block, place = lambda c: F.shiftright(c, 10), lambda c: F.col(c).bitwiseAND(F.lit(1023)).cast("short")
    out = _by_marks(rows, gone.select(block("_k").alias("block"), place("_k").alias("place")), block(key), place(key), "left_anti")
    return rows.join(gone, rows[key] == gone["_k"], "left_anti") if out is None else out


def sift(rows: DataFrame, col: str, few: DataFrame) -> DataFrame:
    """rows whose col few has, and about one in a thousand of the others; shuffled, and without others, only where few is too large to broadcast."""
    blocks = few.count() // 64 + 1
    h = F.xxhash64(col)
    block, place = F.pmod(h, F.lit(blocks)), F.shiftright(h, 48).cast("short")
    out = _by_marks(rows.where(F.col(col).isNotNull()), few.select(block.alias("block"), place.alias("place")), block, place, "left_semi")
    return rows.join(few, col, "left_semi") if out is None else out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[kind] = np.multiply.accumulate(have)
    return have[:n]


def dictionary(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Byte strings that stand end to end in data: the number of each among the distinct ones, and the distinct ones."""
    offs = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
    enc = all_.dictionary_encode()
    return enc.indices.to_numpy().astype(np.int64), enc.dictionary


@dataclass
class Slice:
    """A run of documents: bytes, document offsets, and word spans in bytes."""

    data: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    woffs: np.ndarray
    lo: int
    hi: int
    _prefix: np.ndarray | None = None
    _ids: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def n_words(self) -> np.ndarray:
        return np.diff(self.woffs)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.woffs))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span, for hashed features: text can be made whose hashes collide."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power("up", _MULT, len(self.data)), out=self._prefix[1:])
        p = self._prefix
        return mix((p[end] - p[start]) * _power("down", _INV, len(self.data) + 1)[start] + (end - start).astype(np.uint64))

    def word_ids(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the slice's distinct words, and these; exact."""
        if lower not in self._ids:
            data = self.data[~SPACE[self.data]]
            self._ids[lower] = dictionary(LOWER[data] if lower else data, self.end - self.start)
        return self._ids[lower]

    def word_keys(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys of each word, equal for equal words in every slice.

        Words of up to 16 bytes of one length map one-to-one onto pairs of keys; longer ones get 128 bits of BLAKE2b.
        """
        if ("keys", lower) not in self._ids:
            data = np.zeros(len(self.data) + 16, np.uint8)
            data[:-16] = LOWER[self.data] if lower else self.data
            size = self.end - self.start
            eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes from any byte on
            low = eight[self.start] & _FIRST[np.minimum(size, 8)]
            high = eight[np.minimum(self.start + 8, len(data) - 8)] & _FIRST[np.clip(size - 8, 0, 8)]
            a = mix(low + size.astype(np.uint64) * np.uint64(_MULT) + mix(high ^ np.uint64(0x8EBC6AF09C88C6E3)))
            b = mix(high + mix(a ^ np.uint64(0x589965CC75374CC3)))
            long = np.flatnonzero(size > 16)
            if len(long):
                mark = np.zeros(len(data), np.int8)
                mark[self.start[long]] = 1
                np.subtract.at(mark, self.end[long], 1)
                ids, words = dictionary(data[np.cumsum(mark, dtype=np.int8) > 0], size[long])
                keys = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in words.to_pylist()), np.uint64).reshape(-1, 2)
                a[long], b[long] = keys[ids, 0], keys[ids, 1]
            self._ids["keys", lower] = a, b
        return self._ids["keys", lower]

    def forget(self) -> None:
        """Drop what was kept of the words' numbers and keys."""
        self._ids.clear()

    def word_hash(self, lower: bool = False) -> np.ndarray:
        return self.word_keys(lower)[0]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document's bytes."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    if col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def make_slice(data: np.ndarray, offs: np.ndarray, lo: int = 0) -> Slice:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Slice(data, offs, z, z, np.zeros(len(offs), np.int64), lo, lo + len(offs) - 1)
    word = ~SPACE[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.logical_not(word[:-1], out=edge[1:])
    edge[offs[offs < n]] = True
    start = np.flatnonzero(word & edge)
    edge[-1] = True
    np.logical_not(word[1:], out=edge[:-1])
    edge[offs[offs > 0] - 1] = True
    end = np.flatnonzero(word & edge) + 1
    return Slice(data, offs, start, end, np.searchsorted(start, offs), lo, lo + len(offs) - 1)


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of whole documents of about `limit` bytes; every document is in one run."""
    data, offs = string_parts(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield make_slice(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


#: Odd multipliers of the left and right part of a run, by lane.
_JOIN = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def runs(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A 64-bit key of each run of k values: runs of powers of two by doubling, joined to k; each step mixes anew."""
    left, right = (np.uint64(x) for x in _JOIN[lane])
    join = lambda a, b: mix(a * left + b * right)
    part, width, out, done = h, 1, None, 0
    while True:
        if k & width:
            out = part if out is None else join(out[: len(part) - done], part[done:])
            done += width
        if done == k:
            return out[: max(0, len(h) - k + 1)]
        part, width = join(part[:-width], part[width:]), 2 * width


def inside(woffs: np.ndarray, k: int) -> np.ndarray:
    """First words of the runs of k words that lie inside one document."""
    n = int(woffs[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.zeros(n + 1, np.int32)
    # starts in the last k-1 words of a document would reach into the next one
    np.add.at(ok, np.clip(np.maximum(woffs[1:] - k + 1, woffs[:-1]), 0, n), 1)
    np.add.at(ok, np.clip(woffs[1:], 0, n), -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) == 0)


def windows(h: np.ndarray, woffs: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Key of each k-word window that lies inside one document, and the index of its first word."""
    at = inside(woffs, k)
    return (runs(h, k, lane)[at], at) if len(at) else (np.zeros(0, np.uint64), at)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch.

    The session's Arrow batches are held to BATCH_BYTES from then on: a frame is planned when it is
    used, so the setting has to outlast this call.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return to the system what a fit has freed: the driver's Python shares its memory limit with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of a text that may be in a labelled sample, and of all its texts, at most.
SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 1 << 20, 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, text_bytes: int = SAMPLE_TEXT_BYTES, all_bytes: int = SAMPLE_BYTES) -> list:
    """At most `bound` labelled (text, label) rows outside the held-out fold, of at most `all_bytes` in all.

    The sample is the only thing a classifier is fitted on, and its bounds are parameters. Labels are
    taken in hash order of doc_id, then their distinct texts in hash order as far as the bytes allow; a
    text of more than `text_bytes` is not used for fitting. Rows whose label or doc_id is null are not
    used; a doc_id with several texts or labels can give each of them. Ids may be of any type.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    few = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (key % folds != held))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(bound)
    )
    few = materialize(few, "labels")
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    size = F.octet_length("text")
    # `few` has at most `bound` rows; what reaches the driver here are numbers, `bound` rows at most
    found = mine.where(size <= text_bytes).join(F.broadcast(few), "doc_id").groupBy("h", "y").agg(F.max(size).alias("size")).orderBy("h", "y").limit(bound).collect()
    total, take = 0, []
    for r in found:
        if total + r["size"] <= all_bytes:
            total += r["size"]
            take.append((r.h, r.y))
    release(few)
    if not take:
        return []
    small = docs.sparkSession.createDataFrame(take, "h long, y int")
    got = mine.join(F.broadcast(small), "h").groupBy("h", "y").agg(F.first("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(got, key=lambda r: (r.h, r.y))]


__all__ = ["keep", "materialize", "release", "scratch", "table"]
