"""When a root is polled, and what a poll comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gate import backoff, jitter


def poll_action(now: Column, next_due: Column, busy: Column, reachable: Column, listed: Column, have_state: Column) -> Column:
    """wait (busy or not due), skip (root missing or its listing failed: never taken for deletions), baseline or poll; the first that holds."""
    return F.when(busy | (now < next_due), "wait").when(~reachable | ~listed, "skip").when(~have_state, "baseline").otherwise("poll")


def next_due_column(action: Column, now: Column, next_due: Column, elapsed: Column, interval: Column, draw: Column) -> Column:
    """Seconds: a root that waits keeps its time; a slow poll takes a quarter of the time at most; each delay is spread by a tenth."""
    slow = F.when(elapsed > interval / 4, F.greatest(interval, 4 * elapsed)).otherwise(interval)
    delay = F.when(action == "skip", interval).otherwise(slow)
    return F.when(action == "wait", next_due).otherwise(now + delay * (0.9 + 0.2 * draw))


def schedule(roots: DataFrame, now: Column) -> DataFrame:
    """roots(root, next_due, busy, reachable, listed, have_state, elapsed_s, poll_minutes, draw): adds action and due, in seconds."""
    interval = F.greatest(F.lit(1), F.col("poll_minutes")) * 60.0
    out = roots.withColumn("action", poll_action(now, F.col("next_due"), F.col("busy"), F.col("reachable"), F.col("listed"), F.col("have_state")))
    return out.withColumn("due", next_due_column(F.col("action"), now, F.col("next_due"), F.col("elapsed_s"), interval, F.col("draw")))


class Due:
    """One root's polling times on the driver: due() before a poll, done() after it."""

    def __init__(self, poll_minutes: int, draw):
        self.interval, self.draw, self.next = 60.0 * max(1, poll_minutes), draw, 0.0

    def due(self, now: float) -> bool:
        return now >= self.next

    def done(self, now: float, elapsed: float, polled: bool) -> float:
        """The delay until the next poll; a skipped or failed one comes again after the plain interval."""
        delay = jitter(backoff(elapsed, self.interval) if polled else self.interval, self.draw())
        self.next = now + delay
        return delay
