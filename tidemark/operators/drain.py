"""Drain of one root's journal records: events, new state and new directory map.

File records are folded in bulk: ignored names go first, the parent's path is
joined from the map, the live state of the file (a stat relation) is joined by
path, and the fold is a window over each path. Directory records are few. What
each of them does follows from the paths of the directories that the batch's
directory records themselves name, so these are fetched, at most MAX_DIR_RECORDS
records at a time, and decided in order on the driver; a batch with more is
drained in ranges of USN, one after the other, with the same result. New, moved
in, removed and ignored directories become versions of the map, and one op for
each file strictly below them, so any number of them is folded together with the
file records. Only renames of mapped directories, which move state from key to
key, cut the batch. Rows below directories are found by equi-joins on ancestors.

records: root, usn, frn, parent_frn, reason, attrs, name. files: the live files
(root, path, size, mtime, attrs). live_dirs: the live directories (frn, path).
state: root, path, size, mtime, attrs. dirmap: frn, path ('' for the root).

Defined results: no records give no events and the state and map as they were;
records whose parent is not mapped are passed over; repeated records change
nothing the second time; if the root itself is renamed, moved or deleted, the
whole batch gives nothing and is marked displaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import SEP, IgnoreRules, ancestors, child_path, is_under, path_key
from ..functions.scalars import FILE_CREATE, FILE_DELETE, RENAME_NEW, RENAME_OLD, is_directory
from ..runtime import materialize
from ..sources.journal import watched
from . import dirmap as M
from . import fold

#: Directory records that are decided at a time.
MAX_DIR_RECORDS = 50_000
EVENT = "root string, usn long, type string, path string, size long, mtime long, prev_size long, prev_mtime long"


@dataclass(frozen=True)
class DirOp:
    """map (frn is at new), unmap, remove, rename (old to new), move_in (frn is at new, with all below it)."""

    kind: str
    usn: int
    frn: str
    old: str | None = None
    new: str | None = None


@dataclass
class Drained:
    events: DataFrame
    state: DataFrame
    dirmap: DataFrame
    displaced: bool = False


class Paths:
    """Paths by id, and the ids at or below each path, whatever its case."""

    def __init__(self, paths: dict[str, str]):
        self.of: dict[str, str] = {}
        self.under: dict[str, set[str]] = {}
        for frn, path in paths.items():
            self.put(frn, path)

    @staticmethod
    def _keys(path: str) -> Iterable[str]:
        parts = path.upper().split(SEP)
        return (SEP.join(parts[:i]) for i in range(1, len(parts) + 1))

    def put(self, frn: str, path: str) -> None:
        self.drop(frn)
        self.of[frn] = path
        for k in self._keys(path):
            self.under.setdefault(k, set()).add(frn)

    def drop(self, frn: str) -> None:
        if frn in self.of:
            for k in self._keys(self.of.pop(frn)):
                self.under[k].discard(frn)

    def within(self, path: str) -> list[str]:
        return list(self.under.get(path.upper(), ()))


def plan_directories(rows: Iterable, paths: dict[str, str], live: dict[str, str], rules: IgnoreRules) -> tuple[list[DirOp], bool]:
    """What directory records (usn, frn, parent_frn, reason, name, in order) do, and whether the root was displaced.

    paths: the mapped paths of the ids that the records name. live: their live paths. A record takes time
    in proportion to the ids whose paths it changes.
    """
    out: list[DirOp] = []
    mapped, alive = Paths(paths), Paths(live)
    ignored = lambda name: any(name.upper().startswith(p.upper()) for p in rules.dirs)

    def forget(path: str, frn: str) -> None:
        for f in [*mapped.within(path), frn]:
            mapped.drop(f)

    for r in rows:
        old, parent = mapped.of.get(r.frn), mapped.of.get(r.parent_frn)
        here = None if parent is None else r.name if parent == "" else f"{parent}{SEP}{r.name}"
        has = lambda mask: bool(r.reason & mask)  # noqa: B023, E731
        if old == "" and has(FILE_DELETE | RENAME_OLD | RENAME_NEW):
            return [], True
        if ignored(r.name):
            if old is not None:
                out.append(DirOp("unmap", r.usn, r.frn, old))
                forget(old, r.frn)
        elif has(FILE_DELETE) or (has(RENAME_NEW) and here is None):
            if old is not None:
                out.append(DirOp("remove", r.usn, r.frn, old))
                forget(old, r.frn)
        elif has(RENAME_NEW):
            if old is None:
                out.append(DirOp("move_in", r.usn, r.frn, None, here))
                for f in alive.within(here):
                    if alive.of[f].upper() != here.upper():
                        mapped.put(f, alive.of[f])
                mapped.put(r.frn, here)
            elif here.upper() != old.upper():
                out.append(DirOp("rename", r.usn, r.frn, old, here))
                for f in mapped.within(old):
                    mapped.put(f, here + mapped.of[f][len(old) :])
        elif has(FILE_CREATE) and here is not None and old is None:
            out.append(DirOp("map", r.usn, r.frn, None, here))
            mapped.put(r.frn, here)
    return out, False


def _frame(spark: SparkSession, ops: list[DirOp], *kinds: str) -> DataFrame:
    """Operations of some kinds as rows; at most MAX_DIR_RECORDS, so Spark may broadcast them."""
    return spark.createDataFrame([(o.usn, o.frn, o.old, o.new) for o in ops if o.kind in kinds], "at long, self string, old string, new string")


def _below(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """rows (path, ...) once for each of dirs (_a: upper-case path, ...) that they are strictly below."""
    up = F.array_distinct(F.transform(ancestors(F.col("path")), F.upper))
    return rows.where(F.instr("path", SEP) > 0).withColumn("_a", F.explode(up)).join(dirs, "_a").drop("_a")


def map_versions(dirmap: DataFrame, ops: list[DirOp], live_dirs: DataFrame) -> DataFrame:
    """(frn, path, since, until): where a directory was from one operation on, up to another; until is null for what stays.

    Rows of dirmap are there from the start. A directory ends with the first removal of it or of one above it, or
    where it starts again. ops has no renames.
    """
    spark = dirmap.sparkSession
    rows = dirmap.select("frn", "path", F.lit(-1).cast("long").alias("since"))
    if not ops:
        return rows.withColumn("until", F.lit(None).cast("long"))
    rows = rows.unionByName(_frame(spark, ops, "map", "move_in").select(F.col("self").alias("frn"), F.col("new").alias("path"), F.col("at").alias("since")))
    if any(o.kind == "move_in" for o in ops):
        came = _frame(spark, ops, "move_in").select(F.upper("new").alias("_a"), "at", "self")
        rows = rows.unionByName(_below(live_dirs.select("frn", "path"), came).where("frn <> self").select("frn", "path", F.col("at").alias("since")))
    again = F.lead("since").over(W.partitionBy("frn").orderBy("since"))
    rows = rows.withColumn("_again", again)
    # a path never begins with a separator, so an id behind one is no path
    itself = lambda c: F.concat(F.lit(SEP), c)
    ends = _frame(spark, ops, "unmap", "remove").select("at", F.explode(F.array(F.upper("old"), itself(F.col("self")))).alias("_a"))
    keys = F.array_distinct(F.concat(F.array(F.upper("path"), itself(F.col("frn"))), F.transform(ancestors(F.col("path")), F.upper)))
    gone = rows.select("frn", "since", F.explode(keys).alias("_a")).join(ends, "_a").where("at > since").groupBy("frn", "since").agg(F.min("at").alias("_gone"))
    return rows.join(gone, ["frn", "since"], "left").select("frn", "path", "since", F.least("_again", "_gone").alias("until"))


def file_ops(records: DataFrame, dirmap: DataFrame, files: DataFrame, rules: IgnoreRules) -> DataFrame:
    """File records to ops (root, path, usn, op, size, mtime, attrs).

    dirmap may be versions of a map: a record takes the one of its USN. A removal does not look at the live file.
    """
    dated = "since" in dirmap.columns
    d = dirmap.select(F.col("frn").alias("parent_frn"), F.col("path").alias("_parent"), *(["since", "until"] if dated else []))
    r = records.where(~is_directory(F.col("attrs")) & ~rules.file_name(F.col("name"))).join(d, "parent_frn")
    if dated:
        r = r.where("usn >= since and (until is null or usn < until)")
    r = r.select("root", "usn", "reason", child_path(F.col("_parent"), F.col("name")).alias("path"))
    stat = files.select("root", path_key("path").alias("_k"), "size", "mtime", "attrs")
    r = r.withColumn("_k", path_key("path")).join(stat, ["root", "_k"], "left")
    return fold.to_ops(r).select("root", "path", "usn", "op", "size", "mtime", "attrs")


def move_in(state: DataFrame, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, state) of a directory that came into the tree at path: its live files are added if absent, and overwrite the state."""
    came = files.where(is_under(F.col("path"), F.lit(path))).withColumn("_k", path_key("path"))
    known = state.select("root", path_key("path").alias("_k"), F.lit(True).alias("_had"), F.col("path").alias("_as"))
    came = came.join(known, ["root", "_k"], "left")
    none = F.lit(None).cast("long")
    events = came.where("_had is null").select(
        "root", F.lit("added").alias("type"), "path", F.col("size").cast("long"), F.col("mtime").cast("long"), none.alias("prev_size"), none.alias("prev_mtime")
    )
    cols = ["root", "path", "size", "mtime", "attrs"]
    rest = state.withColumn("_k", path_key("path")).join(came.select("root", "_k"), ["root", "_k"], "left_anti").select(*cols)
    # a row that was there keeps the spelling of its path
    return events, rest.unionByName(came.withColumn("path", F.coalesce("_as", "path")).select(*cols))


def remove_under(state: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, state) of a removed directory: every row strictly below it is removed."""
    below = is_under(F.col("path"), F.lit(path))
    none = F.lit(None).cast("long")
    events = state.where(below).select("root", F.lit("removed").alias("type"), "path", none.alias("size"), none.alias("mtime"), F.col("size").alias("prev_size"), F.col("mtime").alias("prev_mtime"))
    return events, state.where(~below)


def directory_ops(ops: list[DirOp], todo: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """Ops for each file strictly below a directory that came ('M', live files) or went ('D', files of state, of todo or that came)."""
    spark, cols = state.sparkSession, ["root", "path", "usn", "op", "size", "mtime", "attrs"]
    out = None
    known = state.select("root", "path").unionByName(todo.select("root", "path"))
    if any(o.kind == "move_in" for o in ops):
        came = _frame(spark, ops, "move_in").select(F.upper("new").alias("_a"), F.col("at").alias("usn"))
        out = _below(files.select("root", "path", "size", "mtime", "attrs"), came).withColumn("op", F.lit("M")).select(*cols)
        known = known.unionByName(out.select("root", "path"))
    if any(o.kind == "remove" for o in ops):
        went = _frame(spark, ops, "remove").select(F.upper("old").alias("_a"), F.col("at").alias("usn"))
        none = (F.lit(None).cast("long" if c != "attrs" else "int").alias(c) for c in cols[4:])
        below = _below(known, went).groupBy("root", path_key("path").alias("_k"), "usn").agg(F.min("path").alias("path"))
        lost = below.select("root", "path", "usn", F.lit("D").alias("op"), *none)
        out = lost if out is None else out.unionByName(lost)
    return out


def drain(records: DataFrame, files: DataFrame, live_dirs: DataFrame, state: DataFrame, dirmap: DataFrame, rules: IgnoreRules | None = None, most: int = MAX_DIR_RECORDS) -> Drained:
    """Events (EVENT), state and map after the records of one root, in USN order."""
    spark, rules = records.sparkSession, rules or IgnoreRules()
    before = Drained(spark.createDataFrame([], EVENT), state, dirmap)
    recs = materialize(watched(records), "records")
    dirs = recs.where(is_directory(F.col("attrs"))).select("usn", "frn", "parent_frn", "reason", "name")
    parts, low = [], None
    while True:
        rest = dirs if low is None else dirs.where(F.col("usn") >= low)
        rows = rest.orderBy("usn").limit(most + 1).collect()
        high = None
        if len(rows) > most:
            # this range ends before the last of them; records of one USN stay together
            high = rows[-1].usn if rows[0].usn < rows[-1].usn else rows[-1].usn + 1
            rows = rest.where(F.col("usn") < high).orderBy("usn").collect()
        ids = spark.createDataFrame([(x,) for x in {x for r in rows for x in (r.frn, r.parent_frn) if x}], "frn string")
        # at most two ids a record
        mapped = {r.frn: r.path for r in dirmap.join(F.broadcast(ids), "frn").collect()} if rows else {}
        live = {r.frn: r.path for r in live_dirs.join(F.broadcast(ids), "frn").collect()} if rows else {}
        ops, displaced = plan_directories(rows, mapped, live, rules)
        if displaced:
            before.displaced = True
            return before
        run: list[DirOp] = []
        for op in [*ops, None]:
            if op is not None and op.kind != "rename":
                run.append(op)
                continue
            end = op.usn if op is not None else high
            seg = recs
            if low is not None:
                seg = seg.where(F.col("usn") >= low)
            if end is not None:
                seg = seg.where(F.col("usn") < end)
            names = map_versions(dirmap, run, live_dirs)
            todo = file_ops(seg, names, files, rules)
            if any(o.kind in ("remove", "move_in") for o in run):
                todo = materialize(todo, "ops")
                todo = todo.unionByName(directory_ops(run, todo, state, files))
            done = materialize(fold.steps(todo, state), "steps")
            parts.append(fold.steps_events(done))
            state = fold.steps_state(done, state)
            dirmap = names.where("until is null").select("frn", "path")
            run = []
            if op is not None:
                events, state = fold.rename_subtree(state, None, op.old, op.new)
                parts.append(events.withColumn("usn", F.lit(op.usn).cast("long")).select(*parts[0].columns))
                dirmap = M.remap_subtree(dirmap, op.old, op.new)
                low = op.usn
            if op is not None or high is not None:
                state, dirmap = materialize(state, "state"), materialize(dirmap, "dirmap")
        if high is None:
            break
        low = high
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Drained(out, state, dirmap)
