"""Recorded journals: metadata, offset reads, buffers to record rows, and back for tests.

A recorded journal is a folder of binary buffers (*.usn) and meta.json with its id
and its first, lowest valid and next USN. A buffer starts with the next USN.

A buffer is a run of length-prefixed records. The walk is sequential inside one
buffer and independent between buffers, so buffers are decoded in Arrow batches.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import WATCHED, bits
from ..operators.gate import ENTRY_DELETED, NOT_ACTIVE
from ..runtime import read_text

#: Header size, id bytes and the offset of the parent id, by major version.
LAYOUT = {2: (60, 8, 16), 3: (76, 16, 24)}
RECORD = "frn string, parent_frn string, usn long, reason long, attrs long, name string"


def decode_buffer(buf: bytes) -> Iterator[tuple[str, str, int, int, int, str]]:
    """Records of one buffer; unknown major versions are passed over, a bad length ends the walk."""
    at, size = 0, len(buf)
    while size - at >= 8:
        length, major = struct.unpack_from("<IH", buf, at)
        if length < 8 or length > size - at:
            return
        layout = LAYOUT.get(major)
        if layout and length >= layout[0]:
            head, wide, parent = layout
            usn_at = at + parent + wide
            (usn,) = struct.unpack_from("<q", buf, usn_at)
            (reason,) = struct.unpack_from("<I", buf, usn_at + 16)
            (attrs,) = struct.unpack_from("<I", buf, usn_at + 28)
            n, off = struct.unpack_from("<HH", buf, usn_at + 32)
            name = buf[at + off : at + off + n].decode("utf-16-le", "replace") if off + n <= length else ""
            ids = (int.from_bytes(buf[at + x : at + x + wide], "little") for x in (8, parent))
            yield (*(f"{i:x}" for i in ids), usn, reason, attrs, name)
        at += length


def encode_record(major: int, frn: int, parent: int, usn: int, reason: int, attrs: int, name: str, gap: int = 0) -> bytes:
    """One record, padded to 8 bytes; gap moves the name behind the header."""
    head, wide, _ = LAYOUT[major]
    text = name.encode("utf-16-le")
    length = (head + gap + len(text) + 7) // 8 * 8
    out = struct.pack("<IHH", length, major, 0) + frn.to_bytes(wide, "little") + parent.to_bytes(wide, "little")
    out += struct.pack("<qqIIIIHH", usn, 0, reason, 0, 0, attrs, len(text), head + gap) + bytes(gap) + text
    return out.ljust(length, b"\0")


def decode(buffers: DataFrame, col: str = "buffer", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record, with the named columns of its buffer."""
    cols = ["frn", "parent_frn", "usn", "reason", "attrs", "name"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            rows, src = [], []
            for i, v in enumerate(b.column(len(keep)).to_pylist()):
                got = list(decode_buffer(v or b""))
                rows += got
                src += [i] * len(got)
            cells = list(zip(*rows, strict=True)) if rows else [()] * 6
            kept = [b.column(k).take(pa.array(src, pa.int64())) for k in range(len(keep))]
            yield pa.record_batch(kept + [pa.array(c, t) for c, t in zip(cells, types, strict=True)], [*keep, *cols])

    have = ", ".join(f"{k} {buffers.schema[k].dataType.simpleString()}" for k in keep)
    return buffers.select(*keep, col).mapInArrow(run, (have + ", " if have else "") + RECORD)


def watched(records: DataFrame, since: int | None = None) -> DataFrame:
    """Records from an offset on that have a watched reason bit; the offset bound reaches the scan."""
    out = records if since is None else records.where(F.col("usn") >= since)
    return out.where(bits(F.col("reason"), WATCHED))


class SourceError(RuntimeError):
    """The journal cannot be read; code says why."""

    def __init__(self, code: int, text: str):
        super().__init__(f"{text} (error {code})")
        self.code = code


def journal_meta(spark: SparkSession, folder: str) -> dict:
    """journal_id, first_usn, lowest_valid_usn and next_usn of a recorded journal; raises where there is none."""
    text = read_text(spark, f"{folder}/meta.json")
    if text is None:
        raise SourceError(NOT_ACTIVE, f"no journal in {folder}")
    return {k: int(v) for k, v in json.loads(text).items()}


def _records(buffers: DataFrame) -> DataFrame:
    body = buffers.select(F.expr("substring(content, 9)").alias("buffer"))
    return decode(body)


def read_range(spark: SparkSession, folder: str, since: int, journal_id: int) -> tuple[DataFrame, int]:
    """(watched records from an offset on, the next offset); the journal has to be the one of the cursor and to reach back to it."""
    meta = journal_meta(spark, folder)
    if meta["journal_id"] != journal_id:
        raise SourceError(NOT_ACTIVE, f"journal {journal_id:x} is gone")
    if since < meta["first_usn"]:
        raise SourceError(ENTRY_DELETED, f"records before {meta['first_usn']} are gone")
    buffers = spark.read.format("binaryFile").option("pathGlobFilter", "*.usn").load(folder)
    return watched(_records(buffers), since), max(since, meta["next_usn"])


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a recorded journal as a stream of its buffers, as they are added."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    buffers = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.usn").load(folder)
    return watched(_records(buffers))
