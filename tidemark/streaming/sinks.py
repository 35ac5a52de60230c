"""Change and telemetry logs as month-partitioned JSON lines; versioned state with a pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import flatten_lines, ticks_text
from ..operators.telemetry import keep_level, stats_line
from ..runtime import create_new, delete_path, read_text, replace_text


def month_of(ts: Column) -> Column:
    """UTC month of the event itself."""
    return F.date_format(ts, "yyyy-MM")


def event_line(e: DataFrame) -> DataFrame:
    """(root, month, value): one compact JSON line per event with the fields its type has; nulls are left out."""
    t = F.col("type")
    has = lambda c, *kinds: F.when(t.isin(*kinds), F.col(c))
    stamp = lambda c, *kinds: F.when(t.isin(*kinds), ticks_text(F.col(c)))
    body = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z")).alias("ts"),
        "root",
        "type",
        has("path", "added", "modified", "removed").alias("path"),
        has("size", "added", "modified").alias("size"),
        stamp("mtime", "added", "modified").alias("mtime"),
        has("prev_size", "modified", "removed").alias("prevSize"),
        stamp("prev_mtime", "modified", "removed").alias("prevMtime"),
        has("files", "baseline").alias("files"),
    )
    return e.select("root", month_of(F.col("ts")).alias("month"), F.to_json(body).alias("value"))


def append_events(events: DataFrame, path: str) -> None:
    event_line(events).write.mode("append").partitionBy("root", "month").text(path)


def append_ticks(samples: DataFrame, path: str, level: str = "full", last_kept=None) -> None:
    """Telemetry lines by month; level as in the configuration. A failed write is the caller's to log: it must not stop a watcher."""
    lines = stats_line(keep_level(samples, level, last_kept))
    lines.select("month", "value").write.mode("append").partitionBy("month").text(path)


def append_errors(rows: DataFrame, path: str) -> int:
    """(ts, message) as one line each; the number of lines."""
    lines = rows.select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), flatten_lines(F.col("message"))).alias("value"))
    lines.write.mode("append").text(path)
    return rows.count()


def error_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def union_logs(*events: DataFrame) -> DataFrame:
    """Events of several sources (journal and polls of the same root) as one log."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def write_starter_config(path: str, config: dict) -> bool:
    """Writes once; an existing file stays."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            json.dump(config, f, indent=2, ensure_ascii=False)
        return True
    except FileExistsError:
        return False


class Locked(RuntimeError):
    """Another process works on this state."""


class StateStore:
    """Versions of a root's state under a folder, and a pointer file that is replaced last.

    All files go through Hadoop's file system, so the folder may be on any shared store. A version has a
    name of its own; until the pointer moves, readers see the version before, and a half-written one is
    never read. When it has moved, versions that neither it nor the pointer before names are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def pointer(self) -> str:
        return f"{self.folder}/current.json"

    def current(self) -> dict | None:
        """What the pointer says; missing or malformed gives none, so that the gate asks for a scan."""
        try:
            text = read_text(self.spark, self.pointer)
            return json.loads(text) if text else None
        except ValueError:
            return None

    def read(self, name: str, schema: str) -> DataFrame | None:
        """A part of the current version; None where no version has it (which differs from an empty one)."""
        cur = self.current()
        if not cur or name not in cur["parts"]:
            return None
        return self.spark.read.schema(schema).parquet(cur["parts"][name])

    def commit(self, batch: str, parts: dict[str, DataFrame], cursor: dict | None) -> None:
        cur = self.current() or {"parts": {}, "cursor": None}
        paths = dict(cur["parts"])
        for name, df in parts.items():
            paths[name] = f"{self.folder}/{name}/v={batch}-{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        stale = set(cur.get("stale", [])) - set(paths.values())
        left = [p for p in cur["parts"].values() if p not in paths.values()]
        self._point({"batch": batch, "parts": paths, "cursor": cursor if cursor is not None else cur["cursor"], "stale": left})
        for p in stale:
            delete_path(self.spark, p)

    def persist_trigger(self, trigger: int) -> None:
        """The obligation to rescan, stored before any work; the first cause stays."""
        cur = self.current() or {"batch": None, "parts": {}, "cursor": None}
        c = cur["cursor"] or {"journal_id": 0, "next_usn": 0, "resync_trigger": 0}
        if not c.get("resync_trigger"):
            self._point(cur | {"cursor": c | {"resync_trigger": trigger}})

    def lock(self) -> None:
        """Only one process may work on a folder: raises if its lock file is there already."""
        if not create_new(self.spark, f"{self.folder}/lock"):
            raise Locked(self.folder)

    def unlock(self) -> None:
        delete_path(self.spark, f"{self.folder}/lock")

    def _point(self, value: dict) -> None:
        replace_text(self.spark, self.pointer, json.dumps(value))
