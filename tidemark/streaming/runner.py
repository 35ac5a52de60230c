"""Runners of one root: a journal drained in micro-batches, or a tree that is polled.

Order of a commit: events, then state and map, then the pointer with the cursor.
The stream's offsets are committed by its checkpoint after the batch returns.
Events go to a folder named by the batch id, so a batch that is run again after
a crash replaces its own events instead of adding to them. A batch that raises is
not committed and comes again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import IgnoreRules
from ..operators import diff as D
from ..operators import gate, telemetry
from ..operators.drain import drain
from ..operators.poller import Due
from ..runtime import materialize, scratch
from ..sources.journal import SourceError
from ..sources.stores import process_counters
from .sinks import StateStore, append_ticks, event_line

STATE = "root string, path string, size long, mtime long, attrs int"
MAP = "frn string, path string"


class RootDisplaced(RuntimeError):
    """The root itself was renamed or deleted; the batch is dropped and nothing is committed."""


class Suspended(RuntimeError):
    """The root is missing or cannot be listed: nothing is taken for deleted, nothing is committed."""


class Degraded(RuntimeError):
    """The journal cannot be used now; the root is polled meanwhile and the cursor stays."""


@dataclass
class Live:
    """The tree as it is now: files (root, path, size, mtime, attrs), dirs (frn, path; '' is the root), failed (root, dir)."""

    files: DataFrame
    dirs: DataFrame
    failed: DataFrame


def live_of(scan: DataFrame, root: str) -> Live:
    """The rows of a tree scan, by kind."""
    name = F.lit(root).alias("root")
    return Live(
        scan.where("kind = 'file'").select(name, "path", "size", "mtime", "attrs"),
        scan.where("kind = 'dir'").select("frn", "path"),
        scan.where("kind = 'failed'").select(name, F.col("path").alias("dir")),
    )


class Runner:
    """What both kinds share: stored state, the event log, telemetry and totals."""

    def __init__(self, spark: SparkSession, root: str, state_dir: str, out_dir: str, live: Callable[[], Live], rules: IgnoreRules | None = None, stats_dir: str | None = None, telemetry_level: str = "full", fault=print):
        self.spark, self.root, self.out, self.live = spark, root, out_dir, live
        self.rules, self.stats_dir, self.level, self.fault = rules or IgnoreRules(), stats_dir, telemetry_level, fault
        self.store = StateStore(spark, state_dir)
        self.totals: dict[str, int] = dict.fromkeys(("drain", "poll", "baseline", "resync", "records", "events"), 0)
        self.last_kept: dict[str, float] = {}

    def state(self) -> DataFrame | None:
        """The stored snapshot without what the rules ignore by now; None before the first scan."""
        got = self.store.read("snapshot", STATE)
        return None if got is None else D.purge_ignored(got, self.rules)

    def dirmap(self) -> DataFrame | None:
        got = self.store.read("dirmap", MAP)
        return None if got is None else got.where(~self.rules.path(F.col("path"), True))

    def write(self, events: DataFrame, batch: str) -> int:
        """Events first: they are stored before any state moves. The number of events."""
        event_line(events).write.mode("overwrite").partitionBy("root", "month").text(f"{self.out}/batch={batch}")
        return events.count()

    def compare(self, live: Live, ts, batch: str) -> tuple[int, DataFrame, bool]:
        """(events, new snapshot, whether it is the first) of the live tree against the state; a root that cannot be listed raises."""
        if not live.failed.where("dir = '.'").isEmpty():
            raise Suspended(f"{self.root}: listing failed")
        before = self.state()
        me = self.spark.createDataFrame([(self.root,)], "root string")
        old = before if before is not None else self.spark.createDataFrame([], STATE)
        events, full = D.poll(old, live.files, live.failed, me if before is not None else me.where("false"), ts, me)
        return self.write(materialize(events, "events"), batch), full, before is None

    def tick(self, kind: str, started: float, before: dict, records: int, size: int, events: int, trigger: int) -> None:
        """Totals, and a telemetry line if the level keeps it; a line that cannot be written is reported and passed over."""
        self.totals[kind] += 1
        self.totals["records"] += records
        self.totals["events"] += events
        if self.stats_dir is None or (self.level or "").strip().lower() == "off":
            return
        try:
            shape = "cpuMs double, ws long, priv long, alloc long, gc0 long, gc1 long, gc2 long, ioR long, ioW long, handles long, threads long"
            names = [x.split()[0] for x in shape.split(", ")]
            pick = lambda c: tuple(float(c.get(n, 0)) if n == "cpuMs" else int(c.get(n, 0)) for n in names)
            now = time.time()
            row = (kind, self.root, (now - started) * 1000, records, size, events, trigger, pick(before), pick(process_counters()), now)
            line = self.spark.createDataFrame([row], f"kind string, root string, elapsed_ms double, records long, journal_bytes long, events long, trigger int, before struct<{shape.replace(' ', ':').replace(',:', ',')}>, after struct<{shape.replace(' ', ':').replace(',:', ',')}>, at double")
            kept = self.spark.createDataFrame([(r, t) for r, t in self.last_kept.items()], "root string, at double").select("root", F.timestamp_seconds("at").alias("at"))
            append_ticks(line.withColumn("ts", F.timestamp_seconds("at")), self.stats_dir, self.level, kept)
            quiet = kind == "drain" and not events and now - self.last_kept.get(self.root, 0) < telemetry.HEARTBEAT_S
            if not quiet:
                self.last_kept[self.root] = now
        except Exception as e:  # telemetry must not stop a watcher
            self.fault(f"{self.root}: telemetry not written: {e}")

    def summary(self, ts, uptime_s: float) -> DataFrame:
        """The closing line of this runner's totals."""
        t = self.totals
        kinds = [(k, 0, 0) for k in ("drain", "poll", "baseline", "resync") for _ in range(t[k])]
        ticks = self.spark.createDataFrame([*kinds, ("", t["records"], t["events"])], "kind string, records long, events long")
        c = process_counters()
        return telemetry.summary_line(ticks, ts, F.lit(uptime_s), {k: F.lit(c.get(k, 0)) for k in ("cpuMs", "ws", "priv", "handles", "threads")})


class JournalRunner(Runner):
    """Drains a journal. journal() gives its metadata or raises SourceError; live() scans the tree, and is None where the root is missing."""

    def __init__(self, spark: SparkSession, root: str, state_dir: str, out_dir: str, live: Callable[[], Live | None], journal: Callable[[], dict], **kw):
        super().__init__(spark, root, state_dir, out_dir, live, **kw)
        self.journal = journal

    def cursor(self) -> dict | None:
        cur = self.store.current()
        return cur["cursor"] if cur else None

    def have_state(self) -> bool:
        cur = self.store.current()
        return bool(cur) and {"snapshot", "dirmap"} <= set(cur["parts"])

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """One batch of records (usn, frn, parent_frn, reason, attrs, name): gate, then resync or drain, then commit."""
        cur = self.store.current()
        if cur and cur.get("batch") == f"b{batch_id}":
            return  # committed, only the stream's own commit was lost
        live = self.live()
        if live is None:
            raise Suspended(f"{self.root}: root missing")
        try:
            journal = self.journal()
        except SourceError as e:
            action, trigger = gate.on_error(e.code, reading=False)
            if trigger:
                self.store.persist_trigger(trigger)
            raise Degraded(f"{self.root}: {action}") from e
        with scratch():
            trigger = gate.gate_check(self.cursor(), self.have_state(), journal)
            if trigger:
                self.resync(live, journal, trigger, f"r{batch_id}")
            self.drain(records, live, journal, f"b{batch_id}")

    def drain(self, records: DataFrame, live: Live, journal: dict, batch: str) -> None:
        """Fold the records from the cursor on; the cursor moves behind the last of them."""
        started, before, cursor = time.time(), process_counters(), self.cursor()
        recs = materialize(records.where(F.col("usn") >= cursor["next_usn"]).withColumn("root", F.lit(self.root)), "batch")
        out = drain(recs, live.files, live.dirs, self.state(), self.dirmap(), self.rules)
        if out.displaced:
            raise RootDisplaced(self.root)
        events = out.events.select("*", F.current_timestamp().alias("ts"), F.lit(None).cast("long").alias("files"))
        n = self.write(materialize(events, "events"), batch)
        seen = recs.agg(F.count("*").alias("n"), F.max("usn").alias("top"), F.sum(F.length("name") * 2 + 60).alias("bytes")).first()
        at = cursor["next_usn"] if seen.top is None else gate.advance(cursor["next_usn"], seen.top + 1, 9)[0]
        self.store.commit(batch, {"snapshot": out.state, "dirmap": out.dirmap}, cursor | {"next_usn": at})
        self.tick("drain", started, before, seen.n, seen.bytes or 0, n, 0)

    def resync(self, live: Live, journal: dict, trigger: int, batch: str, ts=None) -> None:
        """Scan against the stored state; the cursor resumes at the offset that the journal had before the scan.

        The obligation is stored before any work and is cleared with the commit, so an interrupted resync runs again.
        """
        started, before = time.time(), process_counters()
        self.store.persist_trigger(trigger)
        n, full, first = self.compare(live, ts if ts is not None else F.current_timestamp(), batch)
        cursor = {"journal_id": journal["journal_id"], "next_usn": journal["next_usn"], "resync_trigger": 0}
        self.store.commit(batch, {"snapshot": full, "dirmap": live.dirs}, cursor)
        self.tick("baseline" if trigger == gate.NO_STATE else "resync", started, before, 0, 0, n, trigger)

    def degraded_poll(self, batch: str, ts=None) -> None:
        """Snapshot poll while the journal cannot be used; cursor and map stay, and with them a pending resync."""
        live = self.live()
        if live is None:
            raise Suspended(f"{self.root}: root missing")
        started, before = time.time(), process_counters()
        with scratch():
            n, full, first = self.compare(live, ts if ts is not None else F.current_timestamp(), batch)
            self.store.commit(batch, {"snapshot": full}, None)
        self.tick("baseline" if first else "poll", started, before, 0, 0, n, int(first))


    def start(self, record_stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return record_stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class PollRunner(Runner):
    """Polls a tree that has no journal: due, compare, commit, next time."""

    def __init__(self, spark: SparkSession, root: str, state_dir: str, out_dir: str, live: Callable[[], Live | None], poll_minutes: int = 30, draw: Callable[[], float] = random.random, **kw):
        super().__init__(spark, root, state_dir, out_dir, live, **kw)
        self.times, self.polls = Due(poll_minutes, draw), 0

    def poll(self, now: float, ts=None, elapsed: float | None = None) -> str:
        """wait, skip, baseline or poll. Spark's own single thread per runner is the guard against overlap."""
        if not self.times.due(now):
            return "wait"
        started, before = time.time(), process_counters()
        kind = "skip"
        try:
            live = self.live()
            if live is None:
                raise Suspended(f"{self.root}: root missing")
            self.polls += 1
            with scratch():
                n, full, first = self.compare(live, ts if ts is not None else F.current_timestamp(), f"p{self.polls}-{int(now)}")
                self.store.commit(f"p{self.polls}", {"snapshot": full}, None)
            kind = "baseline" if first else "poll"
            self.tick(kind, started, before, 0, 0, n, int(first))
        except Suspended as e:
            self.fault(str(e))
        finally:
            took = time.time() - started if elapsed is None else elapsed
            self.times.done(now, took, kind != "skip")
        return kind


