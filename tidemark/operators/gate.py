"""Gate: whether a cursor can go on reading a journal, or why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Triggers, by cause; errors of the journal source.
NO_STATE, NEW_JOURNAL, BEFORE_FIRST, OUT_OF_RANGE, SOURCE_ERROR = 1, 2, 3, 4, 5
NO_FUNCTION, ACCESS_DENIED, DELETE_IN_PROGRESS, NOT_ACTIVE, ENTRY_DELETED = 1, 5, 1178, 1179, 1181


def gate(cursor_next: Column, cursor_journal: Column, pending: Column, have_state: Column, journal: Column, first: Column, lowest: Column, next_usn: Column, source_ok: Column | None = None) -> Column:
    """0 to go on, else the trigger of the resync that is due; the first rule that holds decides.

    A source that cannot be queried comes first, but a pending cause stays the cause.
    """
    open_ = F.coalesce(pending, F.lit(0))
    failed = F.lit(False) if source_ok is None else ~source_ok
    return (
        F.when(failed, F.when(open_ != 0, open_).otherwise(SOURCE_ERROR))
        .when(cursor_next.isNull() | ~have_state, NO_STATE)
        .when(open_ != 0, open_)
        .when(cursor_journal != journal, NEW_JOURNAL)
        .when(cursor_next < first, BEFORE_FIRST)
        .when((cursor_next < lowest) | (cursor_next > next_usn), OUT_OF_RANGE)
        .otherwise(0)
    )


def gate_check(cursor: dict | None, have_state: bool, journal: dict) -> int:
    """The same decision on the driver, for one root."""
    if cursor is None or not have_state:
        return NO_STATE
    if cursor.get("resync_trigger"):
        return cursor["resync_trigger"]
    if cursor["journal_id"] != journal["journal_id"]:
        return NEW_JOURNAL
    at = cursor["next_usn"]
    if at < journal["first_usn"]:
        return BEFORE_FIRST
    return OUT_OF_RANGE if at < journal["lowest_valid_usn"] or at > journal["next_usn"] else 0


def first_cause(triggers: DataFrame) -> DataFrame:
    """triggers(root, seq, trigger): adds the pending one, the first that is not 0 up to each row."""
    w = W.partitionBy("root").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return triggers.withColumn("pending", F.coalesce(F.first(F.nullif("trigger", F.lit(0)), ignorenulls=True).over(w), F.lit(0)))


def advance(cursor: int, next_usn: int, n_bytes: int) -> tuple[int, bool]:
    """(new cursor, whether to stop): a read that returns data must move on; a caught-up read may not go back."""
    if n_bytes > 8:
        return (next_usn, False) if next_usn > cursor else (cursor, True)
    return max(cursor, next_usn), True


def on_error(code: int, reading: bool) -> tuple[str, int]:
    """(what a root does, the trigger that is stored) after an error of its source: while it was read, or before.

    degraded: poll until the source works again; resync: at the next tick; reopen: drop the handle and poll meanwhile;
    unsupported: poll for good.
    """
    if code in (DELETE_IN_PROGRESS, NOT_ACTIVE):
        return ("resync" if reading else "degraded"), SOURCE_ERROR
    if code == ENTRY_DELETED and reading:
        return "resync", BEFORE_FIRST
    if code == NO_FUNCTION and not reading:
        return "unsupported", 0
    return "reopen", 0


def clamp_tick(seconds: int) -> int:
    return max(1, min(3600, seconds))


def backoff(elapsed: float, interval: float) -> float:
    """Next poll delay: slow polls are spread so that they take a quarter of the time at most."""
    return max(interval, 4 * elapsed) if elapsed > interval / 4 else interval


def jitter(delay: float, draw: float) -> float:
    return delay * (0.9 + 0.2 * draw)
