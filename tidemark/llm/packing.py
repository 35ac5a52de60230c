"""Best-fit packing planned on the histogram of lengths.

Texts become token ids; a document longer than `capacity` is cut into pieces of
`capacity`, its first piece taking the remainder. Only the histogram of piece
lengths (at most `capacity` counts) reaches the driver. Best fit runs over
counts: from the longest length down, all pieces of a length at once take the
fullest group of open sequences they fit, a group being any number of sequences
of equal filling. The plan is a list of slot ranges per length; a piece takes
the slot of its rank within its length.

A rank is counted within (length, salt) and shifted by the counts of the smaller
salts. The salt is a running number of the stored pieces, whatever they hold, so
pieces of one length are ranked by many tasks even if they are all alike; a
length has SALTS salts, and more if each would rank over SALT_ROWS pieces.

Defined results: a null or empty text is one piece of the end id; repeated rows
each get slots of their own; null ids are kept; extra columns are ignored. Pieces
of one length take that length's slots in any order: which one takes which may
differ between runs, sequences and their fillings do not.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import map_arrow, materialize

CAPACITY = 2048
END_ID = 0
SALTS = 64
SALT_ROWS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary's strings as bytes: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    return {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t) and not t.startswith("<|")}


@lru_cache(2)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian unsigned 32-bit ids, exactly those that `tokenizers` gives for the file.

    Texts go through a second reader of the same vocabulary, merge order and splitting pattern, which is
    quicker. The two could differ only in what they take for white space where it stands in runs or at an
    end, so texts that have white space there, or any other than spaces and line ends, are encoded by
    `tokenizers` itself.
    """
    import json
    import os
    import re
    from array import array

    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ranks = byte_ranks(json.loads(tok.to_str())["model"]["vocab"])
    quick = tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    other_space = re.compile(r"[^\S \n]")

    def odd(t: str) -> bool:
        return bool("  " in t or "\n\n" in t or "\n " in t or " \n" in t or t[:1].isspace() or t[-1:].isspace() or other_space.search(t))

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if odd(t):
                rest.append(i)
            elif t:
                out[i] = array("I", quick(t)).tobytes()
        for i, b in zip(rest, whole([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = b
        return out

    return encode


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and a running number as salt; to be stored before the salt is used."""
    kind = docs.schema[id_col].dataType.simpleString()
    tail = np.array([end_id], "<u4").tobytes()

    def run(b: pa.RecordBatch):
        encode, number = encoder(vocabulary), 0
        texts = b.column(1).to_pylist()
        for lo in range(0, len(texts), 500):
            row, piece, start, length, crc, salt = [], [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in texts[lo : lo + 500]]), lo):
                ids += tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * z]))
                    salt.append(number & 0x7FFFFFFF)
                    number += 1
            yield pa.record_batch(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(salt, pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    out = map_arrow(docs.select(id_col, text_col), run, f"id {kind}, piece int, start long, length long, ids_crc32 long, salt int")
    return out.withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, decreasing, over counts: (length, first rank, ranks, first sequence, offset) ranges.

    A group is (room left, first sequence, sequences). Pieces of one length go to
    the group with the least room that takes them, as many to a sequence as fit,
    before the next group is opened. Steps depend on lengths and groups, not on counts.
    """
    out: list[tuple[int, int, int, int, int]] = []
    groups: list[tuple[int, int, int]] = []
    sequences = 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(groups, (length, -1, 0))
            if at < len(groups):
                room, first, n = groups.pop(at)
            else:
                room, first = capacity, sequences
                per = capacity // length
                n = max(1, left // per) if left >= per else 1
                sequences += n
            use = min(n, left)
            # whole layers over the group while pieces last
            layers = min(room // length, left // n) if use == n else 1
            for k in range(layers):
                out.append((length, rank, use, first, capacity - room + k * length))
                rank += use
                left -= use
            if use < n:
                insort(groups, (room, first + use, n - use))
            after = room - layers * length
            if after > 0:
                insort(groups, (after, first, use))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and salt given). `pieces` is read twice, so it should be stored."""
    spark = pieces.sparkSession
    # bounded: at most capacity counts
    total = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    salts = F.broadcast(spark.createDataFrame([(k, max(SALTS, -(-n // SALT_ROWS))) for k, n in total.items()], "length long, _s int"))
    pieces = pieces.join(salts, "length").withColumn("salt", F.pmod("salt", "_s")).drop("_s")
    # bounded: at most capacity x SALTS counts, and one for SALT_ROWS pieces
    rows = pieces.groupBy("length", "salt").count().collect()
    before: Counter = Counter()
    shift = []
    for r in sorted(rows, key=lambda r: (r.length, r.salt)):
        shift.append((r.length, r.salt, before[r.length]))
        before[r.length] += r["count"]
    ranges = plan(total, capacity)
    # the plan has a range for each group that a length meets, bounded by capacity, not by counts
    shifts = spark.createDataFrame(shift, "length long, salt int, shift long")
    starts: dict[int, list] = {}
    for length, rank, n, first, offset in ranges:
        starts.setdefault(length, []).append((rank, first, offset))
    slots = spark.createDataFrame(
        [(k, [r for r, _, _ in v], [f for _, f, _ in v], [o for _, _, o in v]) for k, v in starts.items()],
        "length long, ranks array<long>, firsts array<long>, offsets array<long>",
    )
    ranked = pieces.withColumn("_n", F.row_number().over(W.partitionBy("length", "salt").orderBy("ids_crc32", "piece", "start")) - 1)
    joined = ranked.join(F.broadcast(shifts), ["length", "salt"]).join(F.broadcast(slots), "length")
    rank = F.col("_n") + F.col("shift")
    joined = joined.withColumn("_r", rank).withColumn("_k", last_at_most("ranks", "_r"))
    return joined.withColumn("sequence_id", F.get("firsts", F.col("_k")) + F.col("_r") - F.get("ranks", F.col("_k"))).withColumn(
        "offset", F.get("offsets", F.col("_k"))
    ).drop("_n", "_r", "_k", "shift", "ranks", "firsts", "offsets", "salt")


def last_at_most(array: str, value: str):
    """Index of the last element that is at most the value, in an ascending array."""
    return F.size(F.filter(F.col(array), lambda x: x <= F.col(value))) - 1


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
