"""Snapshot diff, baseline, last-wins entries and preservation of unreadable subtrees.

Relations: snapshot(root, path, size, mtime, attrs); mtime in ticks. Keys are
(root, upper(path)). Every join is an equi-join on keys, so the optimizer picks
shuffled or broadcast plans from sizes and splits skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import IgnoreRules, ancestors, path_key

EVENT = ("ts", "root", "type", "path", "size", "mtime", "prev_size", "prev_mtime", "files")


def from_entries(entries: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per key: values of the last entry, casing of the first."""
    value = F.max_by(F.struct("size", "mtime", "attrs"), seq).alias("_v")
    out = entries.groupBy("root", path_key("path").alias("path_key")).agg(F.min_by("path", seq).alias("path"), value)
    return out.select("root", "path", "_v.size", "_v.mtime", "_v.attrs")


def changed(p: str, c: str) -> Column:
    """Size, time or attributes differ; attributes alone count."""
    return ~F.struct(f"{p}.size", f"{p}.mtime", f"{p}.attrs").eqNullSafe(F.struct(f"{c}.size", f"{c}.mtime", f"{c}.attrs"))


def diff(prev: DataFrame, curr: DataFrame, ts: Column | None = None) -> DataFrame:
    """Events that lead from prev to curr, all with one timestamp; fields that a type lacks are null."""
    p = prev.withColumn("_k", path_key("path")).alias("p")
    c = curr.withColumn("_k", path_key("path")).alias("c")
    j = p.join(c, (F.col("p.root") == F.col("c.root")) & (F.col("p._k") == F.col("c._k")), "full_outer")
    new, gone = F.col("p._k").isNull(), F.col("c._k").isNull()
    kind = F.when(new, "added").when(gone, "removed").when(changed("p", "c"), "modified")
    return (
        j.select(
            (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"),
            F.coalesce("c.root", "p.root").alias("root"),
            kind.alias("type"),
            F.coalesce("c.path", "p.path").alias("path"),
            F.col("c.size").alias("size"),
            F.col("c.mtime").alias("mtime"),
            F.col("p.size").alias("prev_size"),
            F.col("p.mtime").alias("prev_mtime"),
            F.lit(None).cast("long").alias("files"),
        )
        .where("type is not null")
    )


def baseline(curr: DataFrame, ts: Column | None = None, roots: DataFrame | None = None) -> DataFrame:
    """One event per root with its number of files, for roots that were never scanned.

    roots (root): those that were scanned now; one without files gets files 0. Without it, the roots that curr has.
    """
    n = curr.groupBy("root").agg(F.count("*").alias("files"))
    if roots is not None:
        n = roots.select("root").distinct().join(n, "root", "left").select("root", F.coalesce("files", F.lit(0)).alias("files"))
    null = {"path": "string", "size": "long", "mtime": "long", "prev_size": "long", "prev_mtime": "long"}
    return n.select(
        (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"), "root", F.lit("baseline").alias("type"), *(F.lit(None).cast(t).alias(c) for c, t in null.items()), "files"
    )


def preserve_failed(prev: DataFrame, curr: DataFrame, failed: DataFrame) -> DataFrame:
    """prev rows below a failed directory (root, dir) that curr lacks; they are to be added to curr.

    The prefix test is an equi-join on each path's ancestors, so failed may be of any size.
    """
    bad = failed.select("root", F.upper("dir").alias("_a")).distinct()
    below = (
        prev.withColumn("_k", path_key("path"))
        .where(F.instr("path", "\\") > 0)
        .select("*", F.explode(ancestors(F.col("path"))).alias("_d"))
        .withColumn("_a", F.upper("_d"))
        .join(bad, ["root", "_a"], "left_semi")
        .drop("_a", "_d")
        .dropDuplicates(["root", "_k"])
    )
    have = curr.select("root", path_key("path").alias("_k"))
    return below.join(have, ["root", "_k"], "left_anti").drop("_k")


def preserved_counts(prev: DataFrame, curr: DataFrame, failed: DataFrame) -> DataFrame:
    """Per root, the directories that could not be listed and the earlier rows that are kept for them."""
    bad = failed.where("dir <> '.'")
    kept = preserve_failed(prev, curr, bad).groupBy("root").agg(F.count("*").alias("kept"))
    n = bad.groupBy("root").agg(F.count("*").alias("failed_dirs"))
    return n.join(kept, "root", "left").select("root", "failed_dirs", F.coalesce("kept", F.lit(0)).alias("kept"))


def poll(prev: DataFrame, curr: DataFrame, failed: DataFrame, scanned: DataFrame, ts: Column | None = None, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, new snapshot) of one poll. scanned: roots with an earlier scan, an empty one included; roots: those polled now.

    Roots whose own enumeration failed ('.') give no events and keep their snapshot; other failed
    directories keep their rows; roots without an earlier scan give one baseline event.
    """
    dead = failed.where("dir = '.'").select("root").distinct()
    live = curr.join(dead, "root", "left_anti")
    old = prev.join(dead, "root", "left_anti")
    full = live.unionByName(preserve_failed(old, live, failed.where("dir <> '.'")))
    polled = roots if roots is not None else full.select("root").distinct()
    first = polled.join(scanned, "root", "left_anti").join(dead, "root", "left_anti")
    events = diff(old, full.join(scanned, "root", "left_semi"), ts).unionByName(baseline(full.join(scanned, "root", "left_anti"), ts, first))
    return events, full.unionByName(prev.join(dead, "root", "left_semi"))


def purge_ignored(rows: DataFrame, rules: IgnoreRules, is_dir: bool = False) -> DataFrame:
    return rows.where(~rules.path(F.col("path"), is_dir)) if rules.any else rows
