"""Directory map: identifiers to paths, subtree operators, parent closure and versions in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import IgnoreRules, child_path, is_under, rewrite_prefix, within
from ..runtime import materialize, release


def resolve_parents(records: DataFrame, dirmap: DataFrame) -> DataFrame:
    """Records with `path`; records whose parent is outside the tree drop out."""
    d = dirmap.select(F.col("frn").alias("parent_frn"), F.col("path").alias("_parent"))
    return records.join(d, "parent_frn").withColumn("path", child_path(F.col("_parent"), F.col("name"))).drop("_parent")


def closure(nodes: DataFrame) -> DataFrame:
    """nodes(frn, parent_frn, name), roots with a null parent and name '', to (frn, path).

    Pointer doubling: every round halves the distance to the root, so depth d takes log2(d) joins
    and no recursion limit applies. Nodes on a cycle or without a root drop out.
    """
    at = nodes.select("frn", F.col("parent_frn").alias("up"), F.col("name").alias("path"))
    at = materialize(at, "closure")
    count = at.count()
    rounds = 0
    while rounds <= max(count, 2).bit_length() and not at.where("up is not null").isEmpty():
        last = at
        above = at.select(F.col("frn").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_p"))
        joined = at.join(above, "up", "left")
        at = materialize(
            joined.where(F.col("up").isNull() | F.col("_p").isNotNull()).select(
                "frn", F.col("_up").alias("up"), F.when(F.col("_p").isNull(), F.col("path")).otherwise(child_path(F.col("_p"), F.col("path"))).alias("path")
            ),
            "closure",
        )
        release(last)
        rounds += 1
    return at.where("up is null").select("frn", "path")


def collect_subtree(dirmap: DataFrame, prefix: str) -> DataFrame:
    return dirmap.where(within(F.col("path"), F.lit(prefix)))


def remap_subtree(dirmap: DataFrame, old: str, new: str) -> DataFrame:
    """The directory itself and everything strictly below it moves to the new prefix."""
    return dirmap.withColumn("path", F.when(within(F.col("path"), F.lit(old)), rewrite_prefix(F.col("path"), F.lit(old), F.lit(new))).otherwise(F.col("path")))


def remove_subtree(dirmap: DataFrame, prefix: str, also_self: bool = True) -> DataFrame:
    gone = within(F.col("path"), F.lit(prefix)) if also_self else is_under(F.col("path"), F.lit(prefix))
    return dirmap.where(~gone)


def upsert(dirmap: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(frn, path, seq): the last one of an identifier wins; a null path removes it."""
    last = changes.groupBy("frn").agg(F.max_by(F.struct("path"), "seq").alias("_c")).select("frn", F.col("_c.path").alias("path"))
    return dirmap.join(last, "frn", "left_anti").unionByName(last.where("path is not null"))


def collect_ignored(dirmap: DataFrame, rules: IgnoreRules) -> DataFrame:
    return dirmap.where(rules.path(F.col("path"), True))


def versions(changes: DataFrame) -> DataFrame:
    """changes(frn, path, usn) to intervals (frn, path, from_usn, to_usn), the last one open."""
    nxt = F.lead("usn").over(W.partitionBy("frn").orderBy("usn"))
    return changes.select("frn", "path", F.col("usn").alias("from_usn"), nxt.alias("to_usn"))


def resolve_as_of(records: DataFrame, intervals: DataFrame) -> DataFrame:
    """Records with the path that their parent had at their USN; an identifier's intervals don't overlap.

    Starts and ends of intervals and records are sorted together by (frn, usn), and a record takes the
    last start or end before it: no record meets more than one version.
    """
    v = intervals.select(F.col("frn").alias("parent_frn"), "path", "from_usn", "to_usn").where("to_usn is null or from_usn < to_usn")
    starts = v.select("parent_frn", F.col("from_usn").alias("_at"), F.lit(1).alias("_kind"), F.struct("path").alias("_v"))
    ends = v.where("to_usn is not null").select("parent_frn", F.col("to_usn").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.lit(None).cast(v.schema["path"].dataType).alias("path")).alias("_v"))
    rows = records.where("parent_frn is not null").select("parent_frn", F.col("usn").alias("_at"), F.lit(2).alias("_kind"), F.struct(*(c for c in records.columns)).alias("_r"))
    both = rows.unionByName(starts.unionByName(ends), allowMissingColumns=True)
    seen = W.partitionBy("parent_frn").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = both.withColumn("_parent", F.last("_v", ignorenulls=True).over(seen)["path"]).where("_kind = 2 and _parent is not null")
    others = [F.col("_r")[c].alias(c) for c in records.columns if c not in ("parent_frn", "path")]
    return last.select("parent_frn", *others, child_path(F.col("_parent"), F.col("_r")["name"]).alias("path"))
