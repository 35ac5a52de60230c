"""Scalar columns: ticks, reasons, event names, readable sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Journal reason bits and attribute bits.
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION = 0x1, 0x2, 0x4
NAMED_OVERWRITE, NAMED_EXTEND, NAMED_TRUNCATION = 0x10, 0x20, 0x40
FILE_CREATE, FILE_DELETE, EA_CHANGE, SECURITY_CHANGE = 0x100, 0x200, 0x400, 0x800
RENAME_OLD, RENAME_NEW, BASIC_INFO, HARD_LINK = 0x1000, 0x2000, 0x8000, 0x10000
COMPRESSION, ENCRYPTION, REPARSE, STREAM, CLOSE = 0x20000, 0x40000, 0x100000, 0x200000, 0x80000000
ATTR_DIRECTORY = 0x10
WATCHED = (
    DATA_OVERWRITE | DATA_EXTEND | DATA_TRUNCATION | FILE_CREATE | FILE_DELETE | RENAME_OLD | RENAME_NEW | BASIC_INFO
    | HARD_LINK | COMPRESSION | ENCRYPTION | REPARSE | NAMED_OVERWRITE | NAMED_EXTEND | NAMED_TRUNCATION | STREAM
)


def bits(reason: Column, mask: int) -> Column:
    """Whether any bit of mask is set; reasons are BIGINT because bit 31 is used."""
    return reason.bitwiseAND(F.lit(mask).cast("long")) != 0


def is_directory(attrs: Column) -> Column:
    return bits(attrs.cast("long"), ATTR_DIRECTORY)


def is_removal(reason: Column) -> Column:
    return bits(reason, FILE_DELETE) | (bits(reason, RENAME_OLD) & ~bits(reason, RENAME_NEW))


def ticks(iso: Column) -> Column:
    """ISO-8601 UTC text with up to 7 fraction digits to 100-ns ticks since the epoch; null if malformed."""
    seconds = F.regexp_extract(iso, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.\d{1,7})?Z?$", 1)
    part = F.regexp_extract(iso, r"\.(\d{1,7})Z?$", 1)
    stamp = F.try_to_timestamp(F.nullif(seconds, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.unix_seconds(stamp) * 10_000_000 + F.rpad(part, 7, "0").cast("long")


def ticks_text(t: Column) -> Column:
    """Ticks since the epoch as ISO-8601 UTC text with 7 fraction digits."""
    second = F.floor(t / 10_000_000).cast("long")
    second = (t - F.pmod(t, F.lit(10_000_000))) / 10_000_000
    return F.concat(
        F.date_format(F.timestamp_seconds(second.cast("long")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(t, F.lit(10_000_000)).cast("string"), 7, "0"), F.lit("Z")
    )


def humanize_bytes(n: Column) -> Column:
    """Whole bytes below 1024, KB and MB with at most one digit, GB with at most two."""

    def short(x: Column, digits: int) -> Column:
        return F.regexp_replace(F.format_string(f"%.{digits}f", F.round(x, digits)), r"\.?0+$", "")

    k, m, g = n / 1024.0, n / 1048576.0, n / 1073741824.0
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(short(k, 1), F.lit(" KB")))
        .when(n < 1073741824, F.concat(short(m, 1), F.lit(" MB")))
        .otherwise(F.concat(short(g, 2), F.lit(" GB")))
    )


def humanize_duration(seconds: Column) -> Column:
    """Below 10 s one or two digits; below a minute whole seconds; then minutes, then hours."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    fine = F.regexp_replace(F.format_string("%.2f", F.round(seconds, 2)), "0$", "")
    return (
        F.when(seconds < 10, F.concat(fine, F.lit("s")))
        .when(seconds < 60, F.concat(F.round(seconds).cast("long").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(F.floor(s % 3600 / 60)), F.lit("m "), two(s % 60), F.lit("s")))
    )


def flatten_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|[\r\n]", " ")
