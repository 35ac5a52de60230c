"""Journal fold: records in USN order against stored state, to events and new state.

Per (root, path) the state after a record is null for a removal and the live
file state otherwise, so the state before it is a lag and no sequential code is
needed. Only a directory rename moves state between keys; a batch with such
records is cut at them and the parts are folded one after the other.

ops: root, path, usn, op ('R' removal, 'S' stat, 'M' moved in with its directory,
'D' removed with its directory), size, mtime, attrs (null where no file exists).
'M' and 'D' keep the stored spelling of a path, and come before a file's own
record of the same USN. state: root, path, size, mtime, attrs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestors, is_under, path_key, rewrite_prefix
from ..functions.scalars import FILE_CREATE, FILE_DELETE, RENAME_NEW, RENAME_OLD, bits, is_removal
from ..runtime import materialize

_FIELDS = ("size", "mtime", "attrs")


def to_ops(records: DataFrame) -> DataFrame:
    """Records (reason, and the file's live size, mtime, attrs) to ops."""
    return records.withColumn("op", F.when(is_removal(F.col("reason")), "R").otherwise("S"))


def _posts(ops: DataFrame, state: DataFrame) -> DataFrame:
    s = state.select("root", path_key("path").alias("_k"), F.struct("path", *_FIELDS).alias("_old"))
    post = F.when((F.col("op") != "R") & F.col("size").isNotNull(), F.struct(*_FIELDS))
    w = W.partitionBy("root", "_k").orderBy("usn")
    o = ops.withColumn("_k", path_key("path")).withColumn("_post", post)
    o = o.withColumn("_first", F.row_number().over(w) == 1).withColumn("_lag", F.lag("_post").over(w))
    j = o.join(s, ["root", "_k"], "left")
    pre = F.when(F.col("_first"), F.when(F.col("_old").isNotNull(), F.struct(*(F.col(f"_old.{c}").alias(c) for c in _FIELDS)))).otherwise(F.col("_lag"))
    return j.withColumn("_pre", pre)


def events(ops: DataFrame, state: DataFrame) -> DataFrame:
    """(root, usn, type, path, size, mtime, prev_size, prev_mtime) for each op that changes the state."""
    j = _posts(ops, state)
    pre, post = F.col("_pre"), F.col("_post")
    kind = (
        F.when(post.isNull() & pre.isNotNull(), "removed")
        .when(post.isNotNull() & pre.isNull(), "added")
        .when(post.isNotNull() & ~post.eqNullSafe(pre) & (F.col("op") != "M"), "modified")
    )
    return (
        j.withColumn("type", kind)
        .where("type is not null")
        .select("root", "usn", "type", "path", F.col("_post.size").alias("size"), F.col("_post.mtime").alias("mtime"), F.col("_pre.size").alias("prev_size"), F.col("_pre.mtime").alias("prev_mtime"))
    )


def new_state(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Untouched rows and the last non-null state of each touched key."""
    post = F.when((F.col("op") != "R") & F.col("size").isNotNull(), F.struct(F.lit(True).alias("live"), "path", *_FIELDS)).otherwise(
        F.struct(F.lit(False).alias("live"), "path", *(F.lit(None).cast("long" if c != "attrs" else "int").alias(c) for c in _FIELDS))
    )
    typed = ops.select("root", "path", "usn", "op", F.col("size").cast("long"), F.col("mtime").cast("long"), F.col("attrs").cast("int"))
    last = typed.groupBy("root", path_key("path").alias("_k")).agg(F.max_by(post, "usn").alias("_l"))
    rest = state.withColumn("_k", path_key("path")).join(last.select("root", "_k"), ["root", "_k"], "left_anti").select("root", "path", *_FIELDS)
    return rest.unionByName(last.where("_l.live").select("root", "_l.path", *(f"_l.{c}" for c in _FIELDS)))


def steps(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Each op with its event, if it has one, and the file that is there after it: what steps_events and steps_state read.

    Both read all of it, so it should be stored.
    """
    s = state.select("root", path_key("path").alias("_k"), F.struct("path", *_FIELDS).alias("_old"))
    lost = F.col("op").isin("R", "D") | F.col("size").isNull()
    post = F.struct(*(F.col(c).cast("long" if c != "attrs" else "int").alias(c) for c in _FIELDS))
    w = W.partitionBy("root", "_k").orderBy("usn", "_own")
    o = ops.withColumn("_k", path_key("path")).withColumn("_own", F.col("op").isin("R", "S")).withColumn("_post", F.when(~lost, post))
    j = o.join(s, ["root", "_k"], "left").withColumn("_lag", F.lag(F.struct("_post")).over(w))
    stored = F.when(F.col("_old").isNotNull(), F.struct(*(F.col(f"_old.{c}").cast("long" if c != "attrs" else "int").alias(c) for c in _FIELDS)))
    j = j.withColumn("_pre", F.when(F.col("_lag").isNull(), stored).otherwise(F.col("_lag._post")))
    names = F.when(F.col("_post").isNotNull() & ((F.col("op") != "M") | F.col("_pre").isNull()), F.col("path"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    j = j.withColumn("_names", names).withColumn("_as", F.coalesce(F.last("_names", ignorenulls=True).over(before), "_old.path"))
    pre, post = F.col("_pre"), F.col("_post")
    kind = (
        F.when(post.isNull() & pre.isNotNull(), "removed")
        .when(post.isNotNull() & pre.isNull(), "added")
        .when(post.isNotNull() & ~post.eqNullSafe(pre) & (F.col("op") != "M"), "modified")
    )
    name = F.when(F.col("_own") | pre.isNull(), F.col("path")).otherwise(F.col("_as"))
    return j.select(
        "root", "_k", "usn", "_own", kind.alias("type"), name.alias("path"), F.col("_post").alias("now"), F.col("_pre.size").alias("prev_size"), F.col("_pre.mtime").alias("prev_mtime")
    )


def steps_events(done: DataFrame) -> DataFrame:
    return done.where("type is not null").select("root", "usn", "type", "path", F.col("now.size").alias("size"), F.col("now.mtime").alias("mtime"), "prev_size", "prev_mtime")


def steps_state(done: DataFrame, state: DataFrame) -> DataFrame:
    """state after the steps: untouched rows and what the last step of each key left."""
    last = done.groupBy("root", "_k").agg(F.max_by(F.struct("path", "now"), F.struct("usn", "_own")).alias("_l"))
    rest = state.withColumn("_k", path_key("path")).join(last.select("root", "_k"), ["root", "_k"], "left_anti").select("root", "path", *_FIELDS)
    return rest.unionByName(last.where("_l.now is not null").select("root", "_l.path", *(f"_l.now.{c}" for c in _FIELDS)))


def directory_action(known: str, parent: str, ignored: str, is_root: str = "is_root"):
    """What a directory record does, in the order in which the rules apply.

    Columns: whether the record's id is mapped, its parent is, its name is ignored, it is the root itself.
    """
    r = F.col("reason")
    k, p = F.col(known), F.col(parent)
    gone = bits(r, FILE_DELETE | RENAME_OLD | RENAME_NEW)
    return (
        F.when(F.col(is_root) & gone, "root_displaced")
        .when(F.col(ignored), "unmap")
        .when(bits(r, FILE_DELETE), F.when(k, "remove").otherwise("none"))
        .when(bits(r, RENAME_NEW), F.when(p & k, "rename").when(p, "move_in").when(k, "move_out").otherwise("none"))
        .when(bits(r, FILE_CREATE) & p & ~k, "map")
        .otherwise("none")
    )


def removals_under(state: DataFrame, dirs: DataFrame) -> DataFrame:
    """Synthetic 'R' ops for every state row strictly below a removed directory (root, dir, usn).

    An equi-join on each path's ancestors: dirs may be many.
    """
    d = dirs.select("root", F.upper("dir").alias("_a"), "usn").distinct()
    below = state.where(F.instr("path", "\\") > 0).select("root", "path", F.explode(F.array_distinct(F.transform(ancestors(F.col("path")), F.upper))).alias("_a"))
    none = (F.lit(None).cast("long" if c != "attrs" else "int").alias(c) for c in _FIELDS)
    return below.join(d, ["root", "_a"]).select("root", "path", "usn", F.lit("R").alias("op"), *none)


def rename_subtree(state: DataFrame, root: str | None, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(events, state) of a directory rename: per file strictly below it removed(old) and added(new) with the stored metadata.

    A rename that only changes case does nothing. root None means all rows of state.
    """
    if old.upper() == new.upper():
        return events_none(state), state
    hit = is_under(F.col("path"), F.lit(old))
    if root is not None:
        hit &= F.col("root") == root
    moved = state.where(hit)
    to = rewrite_prefix(F.col("path"), F.lit(old), F.lit(new))
    none = F.lit(None).cast("long")
    out = F.array(
        F.struct(F.lit("removed").alias("type"), F.col("path").alias("path"), none.alias("size"), none.alias("mtime"), F.col("size").alias("prev_size"), F.col("mtime").alias("prev_mtime")),
        F.struct(F.lit("added").alias("type"), to.alias("path"), F.col("size").alias("size"), F.col("mtime").alias("mtime"), none.alias("prev_size"), none.alias("prev_mtime")),
    )
    ev = moved.select("root", F.explode(out).alias("e")).select("root", "e.*")
    # moved rows overwrite rows that are already at their new place
    placed = moved.withColumn("path", to)
    left = state.where(~hit).withColumn("_k", path_key("path")).join(placed.select("root", path_key("path").alias("_k")), ["root", "_k"], "left_anti").drop("_k")
    return ev, left.unionByName(placed)


def events_none(state: DataFrame) -> DataFrame:
    return state.where("false").select(
        "root", F.lit("").alias("type"), "path", "size", "mtime", F.col("size").alias("prev_size"), F.col("mtime").alias("prev_mtime")
    )


def replay(ops: DataFrame, renames: list[tuple[str, str, str, int]], state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold ops with directory renames (root, old, new, usn) between them.

    renames is a driver-side list: such records are rare, and each is a boundary that cuts the batch.
    """
    parts, low = [], None
    for root, old, new, usn in sorted(renames, key=lambda r: r[3]):
        seg = ops.where((F.col("usn") < usn) & (F.lit(True) if low is None else F.col("usn") >= low))
        parts.append(events(seg, state).withColumn("usn", F.col("usn")))
        state = materialize(new_state(seg, state), "state")
        ev, state = rename_subtree(state, root, old, new)
        parts.append(ev.withColumn("usn", F.lit(usn).cast("long")).select(*parts[0].columns))
        state = materialize(state, "state")
        low = usn
    seg = ops if low is None else ops.where(F.col("usn") >= low)
    parts.append(events(seg, state))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, new_state(seg, state)

