"""Named queries over the driver's tables, and their SQL oracles.

QUERIES maps a name to a function of (spark, sf_dir); ORACLES to DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import IgnoreRules, base_name, hex_id, is_under
from ..functions.scalars import WATCHED, flatten_lines, humanize_bytes, humanize_duration, is_directory, is_removal
from ..operators import diff as D
from ..operators import dirmap as M
from ..operators import drain as R
from ..operators import fold, gate, poller, telemetry
from ..runtime import table
from ..streaming.sinks import event_line
from .inputs import ACT_USN, CURR, DRAIN_ACTS, DRAIN_DIRS, DRAIN_FILES, DRAIN_MAP, DRAIN_RECORDS, DRAIN_STATE, NODES, PREV, RECORDS, URLS, duck, rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


EVENT_COLS = ("type", "path", "size", "mtime", "prev_size", "prev_mtime")
DIFF_SQL = f"""with prev as ({PREV}), curr as ({CURR}),
j as (select p.path as pp, c.path as cp, p.size as ps, c.size as cs, p.mtime as pm, c.mtime as cm, p.attrs as pa, c.attrs as ca
      from prev p full outer join curr c on upper(p.path) = upper(c.path)),
d as (select case when pp is null then 'added' when cp is null then 'removed' when ps <> cs or pm <> cm or pa <> ca then 'modified' end as type,
      coalesce(cp, pp) as path, cs as size, cm as mtime, ps as prev_size, pm as prev_mtime, pa, ca from j)
select type, path, size, mtime, prev_size, prev_mtime from d where type is not null"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return D.diff(rel(spark, sf, PREV), rel(spark, sf, CURR))


@query(DIFF_SQL)
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select(*EVENT_COLS)


@query(DIFF_SQL + " and type = 'added'")
def diff_added(spark, sf):
    return _diff(spark, sf).where("type = 'added'").select(*EVENT_COLS)


@query(DIFF_SQL + " and type = 'removed'")
def diff_removed(spark, sf):
    return _diff(spark, sf).where("type = 'removed'").select(*EVENT_COLS)


@query(DIFF_SQL + " and type = 'modified'")
def diff_modified(spark, sf):
    return _diff(spark, sf).where("type = 'modified'").select(*EVENT_COLS)


@query(DIFF_SQL + " and type = 'modified' and size = prev_size and mtime = prev_mtime")
def diff_attrs_only(spark, sf):
    return _diff(spark, sf).where("type = 'modified' and size = prev_size and mtime = prev_mtime").select(*EVENT_COLS)


@query(f"with curr as ({CURR}) select upper(path) as path, 'modified' as type, size + 1 as size, size as prev_size from curr where size % 3 = 0")
def diff_case_insensitive(spark, sf):
    """A snapshot against its own upper-cased copy, in which every third size grew: only those are events."""
    curr = rel(spark, sf, CURR)
    new = curr.withColumn("path", F.upper("path")).withColumn("size", F.col("size") + F.when(F.col("size") % 3 == 0, 1).otherwise(0))
    return D.diff(curr, new).select("path", "type", "size", "prev_size")


SEQ = "size * 1000 + attrs * 2 + case when path = upper(path) then 1 else 0 end as seq"
LAST = f"with e as (select root, path, size, mtime, attrs, {SEQ} from (({PREV}) union all ({CURR})) x)"


@query(
    LAST
    + """, r as (select *, row_number() over (partition by upper(path) order by seq desc) as l from e), f as (select upper(path) as k, arg_min(path, seq) as path from e group by 1)
select f.path, r.size, r.mtime, r.attrs from r join f on upper(r.path) = f.k where l = 1"""
)
def snapshot_last_wins(spark, sf):
    both = rel(spark, sf, PREV).unionByName(rel(spark, sf, CURR))
    e = both.selectExpr("*", SEQ)
    return D.from_entries(e).select("path", "size", "mtime", "attrs")


FAILED = "select distinct 'r' as root, o_orderstatus || chr(92) || '1' as dir from orders"
KEPT_SQL = f"""with prev as ({PREV}), curr as ({CURR}), failed as ({FAILED}),
kept as (select * from prev p where exists (select 1 from failed f where length(p.path) > length(f.dir) + 1 and starts_with(upper(p.path), upper(f.dir) || chr(92)))
 and not exists (select 1 from curr c where upper(c.path) = upper(p.path)))"""


@query(KEPT_SQL + " select path, size, mtime, attrs from kept")
def preserve_failed_subtrees(spark, sf):
    return D.preserve_failed(rel(spark, sf, PREV), rel(spark, sf, CURR), rel(spark, sf, FAILED)).select("path", "size", "mtime", "attrs")


@query(
    KEPT_SQL
    + """, whole as (select * from curr union all select * from kept), j as (select case when p.path is null then 'added' when c.path is null then 'removed'
 when p.size <> c.size or p.mtime <> c.mtime or p.attrs <> c.attrs then 'modified' end as type from prev p full outer join whole c on upper(p.path) = upper(c.path))
select type, count(*) as n from j where type is not null group by type"""
)
def diff_after_preserve(spark, sf):
    prev = rel(spark, sf, PREV)
    events, _ = D.poll(prev, rel(spark, sf, CURR), rel(spark, sf, FAILED), prev.select("root").distinct())
    return telemetry.events_by_type(events)


@query(f"with curr as ({CURR}) select root, 'baseline' as type, count(*) as files from curr group by root")
def baseline_event(spark, sf):
    return D.baseline(rel(spark, sf, CURR)).select("root", "type", "files")


RULES = IgnoreRules.of(["m.", " blog.", ""], ["1", "2"])
SEGS = f"with u as ({URLS}), s as (select page_id, path, string_split(path, chr(92)) as p from u), t as (select page_id, path, p[len(p)] as last, p[1:len(p)-1] as dirs from s)"
IN_DIRS = "len(list_filter(dirs, lambda x: starts_with(upper(x), 'M.') or starts_with(upper(x), 'BLOG.'))) > 0"
LAST_FILE = "(starts_with(upper(last), '1') or starts_with(upper(last), '2'))"
LAST_DIR = "(starts_with(upper(last), 'M.') or starts_with(upper(last), 'BLOG.'))"


@query(SEGS + f" select page_id, path, ({IN_DIRS} or {LAST_FILE}) as ignored from t")
def ignore_path_filter(spark, sf):
    return rel(spark, sf, URLS).withColumn("ignored", RULES.path(F.col("path")))


@query(SEGS + f" select page_id, path from t where {IN_DIRS} or {LAST_DIR}")
def ignore_dir_only(spark, sf):
    rules = IgnoreRules.of(["m.", "blog."], [])
    return rel(spark, sf, URLS).where(rules.path(F.col("path"), True))


@query(SEGS + f" select page_id, path from t where {LAST_FILE}")
def ignore_file_only(spark, sf):
    return rel(spark, sf, URLS).where(IgnoreRules.of([], ["1", "2"]).path(F.col("path")))


@query(SEGS + f" select page_id, path from t where not ({IN_DIRS} or {LAST_FILE})")
def purge_ignored(spark, sf):
    return D.purge_ignored(rel(spark, sf, URLS), RULES)


PATHS_SQL = f"""with recursive nodes as ({NODES}), w as (select frn, name as path from nodes where parent_frn is null
 union all select n.frn, w.path || chr(92) || n.name from nodes n join w on n.parent_frn = w.frn)"""


def _paths(spark, sf):
    return M.closure(rel(spark, sf, NODES))


@query(PATHS_SQL + " select frn, path from w")
def resolve_paths_recursive(spark, sf):
    return _paths(spark, sf)


@query(f"with nodes as ({NODES}) select c.frn, p.name || chr(92) || c.name as path from nodes c join nodes p on c.parent_frn = p.frn")
def resolve_parent_lookup(spark, sf):
    nodes = rel(spark, sf, NODES)
    return M.resolve_parents(nodes, nodes.select("frn", F.col("name").alias("path"))).select("frn", "path")


@query(PATHS_SQL + " select frn, path from w where length(path) > 5 and starts_with(upper(path), 'ASIA' || chr(92))")
def is_under_subtree(spark, sf):
    return _paths(spark, sf).where(is_under(F.col("path"), F.lit("asia")))


@query(PATHS_SQL + " select frn, path from w where upper(path) = 'ASIA' or starts_with(upper(path), 'ASIA' || chr(92))")
def collect_subtree(spark, sf):
    return M.collect_subtree(_paths(spark, sf), "Asia")


@query(PATHS_SQL + " select frn, case when upper(path) = 'ASIA' or starts_with(upper(path), 'ASIA' || chr(92)) then 'far-east' || substr(path, 5) else path end as path from w")
def remap_subtree(spark, sf):
    return M.remap_subtree(_paths(spark, sf), "ASIA", "far-east")


@query(PATHS_SQL + " select frn, path from w where not (upper(path) = 'ASIA' or starts_with(upper(path), 'ASIA' || chr(92)))")
def remove_subtree(spark, sf):
    return M.remove_subtree(_paths(spark, sf), "ASIA")


@query(PATHS_SQL + " select frn, path from w where len(list_filter(string_split(upper(path), chr(92)), lambda x: starts_with(x, 'AM') or starts_with(x, 'NATION_1'))) > 0")
def collect_ignored(spark, sf):
    return M.collect_ignored(_paths(spark, sf), IgnoreRules.of(["am", "nation_1"], []))


@query(f"with r as ({RECORDS}) select usn, reason from r where reason & {WATCHED} <> 0")
def reason_mask_filter(spark, sf):
    from ..sources.journal import watched

    return watched(rel(spark, sf, RECORDS)).select("usn", "reason")


@query(f"with r as ({RECORDS}) select usn, (reason & 512 <> 0 or (reason & 4096 <> 0 and reason & 8192 = 0)) as removal from r")
def removal_predicate(spark, sf):
    return rel(spark, sf, RECORDS).select("usn", is_removal(F.col("reason")).alias("removal"))


FOLD_SQL = f"""with r as ({RECORDS}), o as (select *, case when reason & 512 <> 0 then null else size end as post from r),
l as (select *, lag(post) over (partition by upper(path) order by usn) as pre from o)"""


@query(
    FOLD_SQL
    + """ select usn, path, case when post is null then 'removed' when pre is null then 'added' else 'modified' end as type, post as size, pre as prev_size
 from l where post is distinct from pre"""
)
def journal_fold_events(spark, sf):
    r = rel(spark, sf, RECORDS)
    none = r.where("false").select("root", "path", "size", "mtime", "attrs")
    return fold.events(fold.to_ops(r), none).select("usn", "path", "type", "size", "prev_size")


@query(FOLD_SQL + ", z as (select *, row_number() over (partition by upper(path) order by usn desc) as k from l) select path, post as size, attrs from z where k = 1 and post is not null")
def journal_fold_snapshot(spark, sf):
    r = rel(spark, sf, RECORDS)
    none = r.where("false").select("root", "path", "size", "mtime", "attrs")
    return fold.new_state(fold.to_ops(r), none).select("path", "size", "attrs")


CHANGES = "select 'f' || cast(user_id % 20 as varchar(20)) as frn, 'd' || cast(event_id as varchar(20)) as path, event_id * 3 as usn from events"
ASOF = "select event_id * 2 as usn, 'f' || cast(user_id % 20 as varchar(20)) as parent_frn, event_type as name from events"


@query(f"with c as ({CHANGES}), r as ({ASOF}) select r.usn, c.path || chr(92) || r.name as path from r asof join c on r.parent_frn = c.frn and r.usn >= c.usn")
def temporal_dir_resolution(spark, sf):
    return M.resolve_as_of(rel(spark, sf, ASOF), M.versions(rel(spark, sf, CHANGES))).select("usn", "path")


GATE_IN = """select c_custkey, cast(c_nationkey as bigint) as cj, c_custkey as cn, cast(case when c_custkey % 17 = 0 then 4 else 0 end as bigint) as pending, c_custkey % 19 <> 0 as have,
 cast(n_nationkey - case when n_nationkey % 9 = 0 then 1 else 0 end as bigint) as j, cast(n_nationkey * 10 as bigint) as f, cast(n_nationkey * 15 as bigint) as l, cast(500 + n_nationkey * 20 as bigint) as nx
 from customer join nation on c_nationkey = n_nationkey"""
GATE_SQL = f"""with g as ({GATE_IN}), t as (select c_custkey, case when not have then 1 when pending <> 0 then pending when cj <> j then 2 when cn < f then 3 when cn < l or cn > nx then 4 else 0 end as trigger from g)"""


def _gate(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    c.createOrReplaceTempView("_tm_customer")
    n.createOrReplaceTempView("_tm_nation")
    g = spark.sql(GATE_IN.replace(" from customer join nation", " from _tm_customer join _tm_nation"))
    x = F.col
    return g.select("c_custkey", gate.gate(x("cn"), x("cj"), x("pending"), x("have"), x("j"), x("f"), x("l"), x("nx")).cast("long").alias("trigger"))


@query(GATE_SQL + " select c_custkey, cast(trigger as bigint) as trigger from t")
def gate_check(spark, sf):
    return _gate(spark, sf)


@query(GATE_SQL + " select cast(trigger as bigint) as trigger, count(*) as n from t group by 1")
def gate_summary(spark, sf):
    return _gate(spark, sf).groupBy("trigger").agg(F.count("*").alias("n"))


TICKS = """select cast(user_id % 5 as varchar(20)) as root, event_id as seq, case event_type when 'signup' then 'baseline' when 'purchase' then 'poll' when 'error' then 'resync' else 'drain' end as kind,
 user_id % 7 as records, case when event_id % 4 = 0 then user_id % 3 else 0 end as events, event_id * 600 as at_s, cast(round(value * 100) as bigint) as counter from events"""


@query(f"with t as ({TICKS}) select root, count(*) as n, cast(sum(records) as bigint) as records, cast(sum(records) * 100 - 8 * count(*) as bigint) as payload, cast(sum(events) as bigint) as events from t group by root")
def drain_totals(spark, sf):
    return telemetry.drain_totals(rel(spark, sf, TICKS), "root")


@query(
    f"""with t as ({TICKS}) select count(*) filter (kind = 'drain') as drains, count(*) filter (kind = 'poll') as polls, count(*) filter (kind = 'baseline') as baselines,
 count(*) filter (kind = 'resync') as resyncs, cast(sum(records) as bigint) as records, cast(sum(events) as bigint) as events from t"""
)
def summary_rollup(spark, sf):
    return telemetry.totals(rel(spark, sf, TICKS))


@query(f"with t as ({TICKS}) select root, seq, greatest(coalesce(counter - lag(counter) over (partition by root order by seq), 0), 0) as d_counter from t")
def counter_delta(spark, sf):
    return telemetry.counter_delta(rel(spark, sf, TICKS).select("root", "seq", "counter"), "root", "seq", ["counter"]).select("root", "seq", "d_counter")


@query(
    f"""with recursive t as ({TICKS}), x as (select root, seq, at_s, kind <> 'drain' or events > 0 as sure, row_number() over (partition by root order by seq) as i from t),
w as (select root, seq, i, at_s as last, true as keep from x where i = 1
 union all select x.root, x.seq, x.i, case when x.sure or x.at_s - w.last >= 3600 then x.at_s else w.last end, x.sure or x.at_s - w.last >= 3600 from w join x on x.root = w.root and x.i = w.i + 1)
select root, seq from w where keep"""
)
def heartbeat_filter(spark, sf):
    return telemetry.heartbeat(rel(spark, sf, TICKS), "summary").select("root", "seq")


@query(f"with t as ({TICKS}) select root, (max(seq) - min(seq)) * 86400.0 / (max(at_s) - min(at_s)) as bytes_per_day, 33554432 * 24.0 / ((max(seq) - min(seq)) * 86400.0 / (max(at_s) - min(at_s))) as ring_hours from t group by root")
def churn_rate(spark, sf):
    s = rel(spark, sf, TICKS).select("root", "at_s", F.col("seq").cast("double").alias("next_usn"))
    return telemetry.churn(s, F.lit(33554432))


@query(
    f"""with t as ({TICKS}), x as (select root, seq, case kind when 'resync' then 4 when 'baseline' then 1 else 0 end as g from t)
select root, seq, cast(coalesce(first_value(nullif(g, 0) ignore nulls) over (partition by root order by seq rows unbounded preceding), 0) as int) as pending from x"""
)
def first_cause(spark, sf):
    t = rel(spark, sf, TICKS).select("root", "seq", F.when(F.col("kind") == "resync", 4).when(F.col("kind") == "baseline", 1).otherwise(0).alias("trigger"))
    return gate.first_cause(t).select("root", "seq", "pending")


LOG = "select ts, 'u' || cast(user_id as varchar(20)) as path, event_type, cast(round(value * 100) as bigint) as size from events"
LOG_TYPE = "case event_type when 'signup' then 'added' when 'error' then 'removed' when 'purchase' then 'baseline' else 'modified' end"


def _log(spark, sf):
    e = rel(spark, sf, LOG).withColumn("type", F.expr(LOG_TYPE)).withColumn("ts", F.col("ts").cast("timestamp"))
    zero = F.lit(0).cast("long")
    return e.select("ts", F.lit("r").alias("root"), "type", "path", "size", zero.alias("mtime"), F.col("size").alias("prev_size"), zero.alias("prev_mtime"), F.col("size").alias("files"))


@query(
    f"""with l as (select *, {LOG_TYPE} as type from ({LOG}) x) select 'r' as root, strftime(ts, '%Y-%m') as month, '{{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z","root":"r","type":"' || type || '"'
 || case when type <> 'baseline' then ',"path":"' || path || '"' else '' end
 || case when type in ('added', 'modified') then ',"size":' || size || ',"mtime":"1970-01-01T00:00:00.0000000Z"' else '' end
 || case when type in ('removed', 'modified') then ',"prevSize":' || size || ',"prevMtime":"1970-01-01T00:00:00.0000000Z"' else '' end
 || case when type = 'baseline' then ',"files":' || size else '' end || '}}' as value from l"""
)
def change_log_json(spark, sf):
    return event_line(_log(spark, sf))


@query(f"select strftime(ts, '%Y-%m') as month, count(*) as n from ({LOG}) x group by 1")
def month_partition_counts(spark, sf):
    return event_line(_log(spark, sf)).groupBy("month").agg(F.count("*").alias("n"))


@query(f"select {LOG_TYPE} as type, count(*) as n from ({LOG}) x group by 1")
def events_by_type(spark, sf):
    return telemetry.events_by_type(_log(spark, sf))


@query(f"with t as ({TICKS}) select root, count(*) filter (kind = 'resync') as resyncs, count(*) filter (kind = 'baseline') as baselines from t group by root")
def resync_trigger_counts(spark, sf):
    return telemetry.totals(rel(spark, sf, TICKS), "root").select("root", "resyncs", "baselines")


@query(
    """with s as (select o_orderkey, cast(o_orderkey * o_orderkey as bigint) as n from orders) select o_orderkey, case when n < 1024 then n || ' B' else
 regexp_replace(printf(case when n < 1073741824 then '%.1f' else '%.2f' end, round(n / case when n < 1048576 then 1024.0 when n < 1073741824 then 1048576.0 else 1073741824.0 end, case when n < 1073741824 then 1 else 2 end)), '\\.?0+$', '')
 || case when n < 1048576 then ' KB' when n < 1073741824 then ' MB' else ' GB' end end as text from s"""
)
def humanize_sizes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey")).alias("n"))
    return o.select("o_orderkey", humanize_bytes(F.col("n")).alias("text"))


DECODED = f"""with r as ({RECORDS}) select usn, path as name, reason, lower(to_hex(usn * 1099511627776 + 7)) as frn, lower(to_hex(usn % 1000 + 5)) as parent_frn,
 cast(case when usn % 9 = 0 then 16 else 32 end as bigint) as attrs from r"""


@query(DECODED)
def usn_decode_v2(spark, sf):
    return _decoded(spark, sf, 2)


@query(DECODED)
def usn_decode_v3(spark, sf):
    return _decoded(spark, sf, 3)


def _decoded(spark, sf, major: int):
    """Records packed into binary buffers by a table function, then decoded."""
    import pyarrow as pa

    from ..sources.journal import decode, encode_record

    def pack(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            packed = [encode_record(major, (usn << 40) + 7, usn % 1000 + 5, usn, reason, 16 if usn % 9 == 0 else 32, path) for usn, path, reason in rows]
            yield pa.record_batch([pa.array([b"".join(packed)], pa.binary())], ["buffer"])

    buffers = rel(spark, sf, RECORDS).select("usn", "path", "reason").mapInArrow(pack, "buffer binary")
    return decode(buffers).select("usn", "name", "reason", "frn", "parent_frn", "attrs")


PRIOR = "select 'r' as root, 'U' || cast(c_custkey as varchar(20)) as path, cast(c_custkey * 10 as bigint) as size, cast(0 as bigint) as mtime, 32 as attrs from customer where c_custkey % 4 <> 0"
FOLD_PRIOR = f"""with r as ({RECORDS}), s as ({PRIOR}), o as (select *, case when reason & 512 <> 0 then null else size end as post from r),
l as (select o.*, case when row_number() over w = 1 then s.size else lag(post) over w end as pre, row_number() over w as k, count(*) over (partition by upper(o.path)) as n
  from o left join s on upper(o.path) = upper(s.path) window w as (partition by upper(o.path) order by usn))"""


@query(FOLD_PRIOR + " select usn, path, case when post is null then 'removed' when pre is null then 'added' else 'modified' end as type, post as size, pre as prev_size from l where post is distinct from pre")
def journal_fold_prior_events(spark, sf):
    """The fold against a state that has three of four users."""
    return fold.events(fold.to_ops(rel(spark, sf, RECORDS)), rel(spark, sf, PRIOR)).select("usn", "path", "type", "size", "prev_size")


@query(
    FOLD_PRIOR
    + """ select path, post as size from l where k = n and post is not null
 union all select path, size from s where upper(path) not in (select upper(path) from r)"""
)
def journal_fold_prior_state(spark, sf):
    return fold.new_state(fold.to_ops(rel(spark, sf, RECORDS)), rel(spark, sf, PRIOR)).select("path", "size")


UNDER = "length(path) > {n} + 1 and starts_with(upper(path), '{p}' || chr(92))"
ASIA = UNDER.format(n=4, p="ASIA")


@query(
    f"""with s as ({DRAIN_STATE}) select 'removed' as type, path, cast(null as bigint) as size, size as prev_size from s where {ASIA}
 union all select 'added', 'AMERICA' || chr(92) || 'EAST' || substr(path, 5), size, null from s where {ASIA}"""
)
def rename_subtree_events(spark, sf):
    return fold.rename_subtree(rel(spark, sf, DRAIN_STATE), "r", "asia", "AMERICA\\EAST")[0].select("type", "path", "size", "prev_size")


@query(f"with s as ({DRAIN_STATE}) select case when {ASIA} then 'AMERICA' || chr(92) || 'EAST' || substr(path, 5) else path end as path, size, mtime, attrs from s")
def rename_subtree_state(spark, sf):
    return fold.rename_subtree(rel(spark, sf, DRAIN_STATE), "r", "asia", "AMERICA\\EAST")[1].select("path", "size", "mtime", "attrs")


@query(f"with s as ({DRAIN_STATE}) select 'removed' as type, path, size as prev_size, mtime as prev_mtime from s where {ASIA}")
def remove_subtree_events(spark, sf):
    return R.remove_under(rel(spark, sf, DRAIN_STATE), "Asia")[0].select("type", "path", "prev_size", "prev_mtime")


@query(f"with s as ({DRAIN_STATE}), d as ({DRAIN_MAP}) select s.path, 7 as usn, 'R' as op from s where exists (select 1 from d where d.path like '%4' and starts_with(upper(s.path), upper(d.path) || chr(92)))")
def removals_under_many(spark, sf):
    """Removal ops below many directories at once, by equi-joins on ancestors."""
    dirs = rel(spark, sf, DRAIN_MAP).where("path like '%4'").select(F.lit("r").alias("root"), F.lower("path").alias("dir"), F.lit(7).alias("usn"))
    return fold.removals_under(rel(spark, sf, DRAIN_STATE), dirs).select("path", "usn", "op")


MOVED = UNDER.format(n=4, p="ASIA")


@query(f"with s as ({DRAIN_STATE}), f as ({DRAIN_FILES}) select 'added' as type, path, size, mtime from f where {MOVED} and upper(path) not in (select upper(path) from s)")
def move_in_subtree_events(spark, sf):
    return R.move_in(rel(spark, sf, DRAIN_STATE), rel(spark, sf, DRAIN_FILES), "Asia")[0].select("type", "path", "size", "mtime")


@query(f"with s as ({DRAIN_STATE}), f as ({DRAIN_FILES}) select path, size from f where {MOVED} union all select path, size from s where upper(path) not in (select upper(path) from f where {MOVED})")
def move_in_subtree_state(spark, sf):
    return R.move_in(rel(spark, sf, DRAIN_STATE), rel(spark, sf, DRAIN_FILES), "Asia")[1].select("path", "size")


RULES_DRAIN = IgnoreRules.of(["."], ["~"])


def _drain_sql(tail: str) -> str:
    """The drain as one step after the other: records up to a directory act, the act, and so on."""
    at = {e: ACT_USN.format(e) for e, *_ in DRAIN_ACTS}
    new = "'ASIA' || chr(92) || 'RENAMED'"
    under = lambda p: f"starts_with(upper(path), '{p}' || chr(92))"
    # (eighth, events, state, map) after the records before it
    acts = [
        (2, f"select {at[2]} as usn, 'removed' as type, path, cast(null as bigint) as size, size as prev_size from t{{0}} where {under('AFRICA' + chr(92) + 'NATION_0')} "
            f"union all select {at[2]}, 'added', {new} || substr(path, 16), size, null from t{{0}} where {under('AFRICA' + chr(92) + 'NATION_0')}",
         f"select case when {under('AFRICA' + chr(92) + 'NATION_0')} then {new} || substr(path, 16) else path end as path, size from t{{0}}",
         f"select frn, case when frn = 'n0' then {new} else path end as path, since from m{{0}}"),
        (3, f"select {at[3]} as usn, 'removed' as type, path, cast(null as bigint) as size, size as prev_size from t{{0}} where {under('AMERICA' + chr(92) + 'NATION_6')}",
         f"select * from t{{0}} where not {under('AMERICA' + chr(92) + 'NATION_6')}", "select * from m{0} where frn <> 'n6'"),
        (4, f"select {at[4]} as usn, 'removed' as type, path, cast(null as bigint) as size, size as prev_size from t{{0}} where {under('EUROPE')}",
         f"select * from t{{0}} where not {under('EUROPE')}", "select * from m{0} where not starts_with(path, 'EUROPE')"),
        (5, "select 0 as usn, '' as type, path, size, size as prev_size from t{0} where false", "select * from t{0}", "select * from m{0} where frn <> 'n12'"),
        (6, f"select {at[6]} as usn, 'added' as type, path, size, cast(null as bigint) as prev_size from f where {under('AMERICA' + chr(92) + 'CAME')} and upper(path) not in (select upper(path) from t{{0}})",
         f"select path, size from f where {under('AMERICA' + chr(92) + 'CAME')} union all select * from t{{0}} where upper(path) not in (select upper(path) from f where {under('AMERICA' + chr(92) + 'CAME')})",
         f"select * from m{{0}} union all select frn, path, -1 from ({DRAIN_DIRS}) d"),
        (None, None, None, None),
    ]
    out = [
        f"f as ({DRAIN_FILES})", f"rec as (select * from ({DRAIN_RECORDS}) x where attrs = 32 and not starts_with(name, '~') and reason & {WATCHED} <> 0)", f"s0 as (select path, size from ({DRAIN_STATE}) x)",
        f"m0 as (select frn, path, -1 as since from ({DRAIN_MAP}) x union all select 'x2', 'MIDDLE EAST' || chr(92) || 'FRESH', {at[1]})",
    ]
    low, logs = "-1", []
    for i, (eighth, events, state, names) in enumerate(acts):
        high = at.get(eighth, "9223372036854775807")
        out += [
            f"q{i} as (select usn, m.path || chr(92) || name as path, reason & 512 <> 0 as gone from rec join m{i} m on parent_frn = m.frn and usn > m.since where usn >= {low} and usn < {high})",
            f"o{i} as (select q.usn, q.path, case when gone then null else f.size end as post from q{i} q left join f on upper(f.path) = upper(q.path))",
            f"l{i} as (select o.usn, o.path, post, case when row_number() over w = 1 then s.size else lag(post) over w end as pre, row_number() over w = count(*) over (partition by upper(o.path)) as last"
            f" from o{i} o left join s{i} s on upper(s.path) = upper(o.path) window w as (partition by upper(o.path) order by usn))",
            f"t{i} as (select path, post as size from l{i} where last and post is not null union all select path, size from s{i} where upper(path) not in (select upper(path) from l{i}))",
        ]
        logs.append(f"select usn, case when post is null then 'removed' when pre is null then 'added' else 'modified' end as type, path, post as size, pre as prev_size from l{i} where post is distinct from pre")
        if events:
            out += [f"e{i} as ({events.format(i)})", f"s{i + 1} as ({state.format(i)})", f"m{i + 1} as ({names.format(i)})"]
            logs.append(f"select * from e{i}")
            low = high
    n = len(acts) - 1
    return "with " + ", ".join(out) + ", log as (" + " union all ".join(logs) + ") " + tail.format(n)


def _drained(spark, sf) -> R.Drained:
    dirs = rel(spark, sf, DRAIN_DIRS)
    return R.drain(rel(spark, sf, DRAIN_RECORDS), rel(spark, sf, DRAIN_FILES), dirs, rel(spark, sf, DRAIN_STATE), rel(spark, sf, DRAIN_MAP), RULES_DRAIN)


@query(_drain_sql("select cast(usn as bigint) as usn, type, path, size, prev_size from log"))
def journal_drain_events(spark, sf):
    """File and directory records drained together: a new directory, a rename, a move out, a removal, an ignored name, a move in."""
    return _drained(spark, sf).events.select("usn", "type", "path", "size", "prev_size")


@query(_drain_sql("select path, size from t{0}"))
def journal_drain_state(spark, sf):
    return _drained(spark, sf).state.select("path", "size")


@query(_drain_sql("select frn, path from m{0}"))
def journal_drain_map(spark, sf):
    return _drained(spark, sf).dirmap.select("frn", "path")


@query(f"with m as ({DRAIN_MAP}), r as ({DRAIN_RECORDS}) select usn, m.path || chr(92) || name as path from r join m on parent_frn = m.frn where attrs = 32 and not starts_with(name, '~') and m.path <> ''")
def ignored_before_resolution(spark, sf):
    """Ignored file names go before their parents are looked up."""
    return R.file_ops(rel(spark, sf, DRAIN_RECORDS), rel(spark, sf, DRAIN_MAP), rel(spark, sf, DRAIN_FILES), RULES_DRAIN).select("usn", "path")


@query(f"with r as ({DRAIN_RECORDS}), m as ({DRAIN_MAP}) select usn, attrs & 16 <> 0 as is_dir, m.path as own from r left join m using (frn)")
def directory_self_resolution(spark, sf):
    r, m = rel(spark, sf, DRAIN_RECORDS), rel(spark, sf, DRAIN_MAP)
    return r.join(m.withColumnRenamed("path", "own"), "frn", "left").select("usn", is_directory(F.col("attrs")).alias("is_dir"), "own")


@query(f"with r as ({DRAIN_RECORDS}), m as ({DRAIN_MAP}), f as ({DRAIN_FILES}) select usn, f.size, f.mtime from r join m on parent_frn = m.frn left join f on upper(f.path) = upper(m.path || chr(92) || name) where r.attrs = 32 and r.reason & 512 = 0 and not starts_with(name, '~')")
def stat_probe(spark, sf):
    ops = R.file_ops(rel(spark, sf, DRAIN_RECORDS), rel(spark, sf, DRAIN_MAP), rel(spark, sf, DRAIN_FILES), RULES_DRAIN)
    return ops.where("op = 'S'").select("usn", "size", "mtime")


@query(
    """with t as (select o_orderkey, o_orderkey * 0.37 as s from orders) select o_orderkey, case
 when s < 10 then regexp_replace(printf('%.2f', s), '0$', '') || 's' when s < 60 then cast(cast(round(s) as bigint) as varchar) || 's'
 when s < 3600 then cast(floor(s / 60) as bigint) || 'm ' || lpad(cast(cast(floor(s) as bigint) % 60 as varchar), 2, '0') || 's'
 else cast(floor(s / 3600) as bigint) || 'h ' || lpad(cast(cast(floor(s / 60) as bigint) % 60 as varchar), 2, '0') || 'm ' || lpad(cast(cast(floor(s) as bigint) % 60 as varchar), 2, '0') || 's' end as text from t"""
)
def humanize_durations(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", humanize_duration((F.col("o_orderkey") * 0.37).cast("double")).alias("text"))


@query(
    """select c_custkey, cast(case when c_custkey % 3 = 0 then (case when c_custkey % 5 = 0 then 4 else 5 end) when c_custkey % 7 = 0 then 1 when c_custkey % 5 = 0 then 4 when c_custkey % 2 = 0 then 2 else 0 end as int) as trigger
 from customer"""
)
def gate_source_error(spark, sf):
    """A source that fails gives 5, a cause that is pending stays."""
    k = F.col("c_custkey")
    cursor = F.when(k % 7 != 0, F.lit(5))
    g = gate.gate(cursor, F.lit(1), F.when(k % 5 == 0, 4).otherwise(0), F.lit(True), F.when(k % 2 == 0, 9).otherwise(1), F.lit(1), F.lit(1), F.lit(10), k % 3 != 0)
    return table(spark, sf, "customer").select("c_custkey", g.cast("int").alias("trigger"))


@query("select 'x' || cast(n_nationkey as varchar) as root, 'baseline' as type, count(c_custkey) as files from nation left join customer on c_nationkey = n_nationkey and c_nationkey % 2 = 0 group by n_nationkey")
def baseline_of_empty_roots(spark, sf):
    """Roots without files get their event too."""
    name = lambda c: F.concat(F.lit("x"), F.col(c).cast("string")).alias("root")
    curr = table(spark, sf, "customer").where("c_nationkey % 2 = 0").select(name("c_nationkey"), F.col("c_name").alias("path"))
    return D.baseline(curr, roots=table(spark, sf, "nation").select(name("n_nationkey"))).select("root", "type", "files")


@query(KEPT_SQL + " select 'r' as root, (select count(*) from failed) as failed_dirs, (select count(*) from kept) as kept")
def preserved_counts(spark, sf):
    return D.preserved_counts(rel(spark, sf, PREV), rel(spark, sf, CURR), rel(spark, sf, FAILED))


POLLS = """select c_custkey as root, cast(c_custkey % 100 as double) as next_due, c_custkey % 11 = 0 as busy, c_custkey % 13 <> 0 as reachable, c_custkey % 17 <> 0 as listed, c_custkey % 3 <> 0 as have_state,
 cast(c_custkey % 50 as double) as elapsed_s, cast(c_custkey % 4 as int) as poll_minutes, (c_custkey % 10) / 10.0 as draw from customer"""


@query(
    f"""with p as ({POLLS}), a as (select *, greatest(1, poll_minutes) * 60.0 as interval_s, case when busy or 60 < next_due then 'wait' when not reachable or not listed then 'skip' when not have_state then 'baseline' else 'poll' end as action from p)
select root, action, cast(case action when 'wait' then next_due when 'skip' then 60 + interval_s * (0.9 + 0.2 * draw)
 else 60 + case when elapsed_s > interval_s / 4 then greatest(interval_s, 4 * elapsed_s) else interval_s end * (0.9 + 0.2 * draw) end * 1000 as bigint) as due_ms from a"""
)
def poll_schedule(spark, sf):
    p = rel(spark, sf, POLLS).withColumn("draw", F.col("draw").cast("double"))
    return poller.schedule(p, F.lit(60.0)).select("root", "action", F.round(F.col("due") * 1000).cast("long").alias("due_ms"))


SAMPLES = """select ts, 'drain' as kind, 'r' as root, user_id + 0.25 as elapsed_ms, event_id as records, event_id * 100 as journal_bytes, user_id % 3 as events, cast(user_id % 2 as int) as trigger, user_id, event_id from events"""


@query(
    f"""select 'r' as root, strftime(ts, '%Y-%m') as month, '{{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z","kind":"drain","root":"r","elapsedMs":' || user_id || '.2,"records":' || records || ',"journalBytes":' || journal_bytes
 || ',"events":' || events || case when trigger <> 0 then ',"trigger":' || trigger else '' end || ',"cpuMs":' || user_id || '.8,"ws":' || event_id || ',"priv":1,"alloc":' || (user_id - 50) || ',"gc0":0,"gc1":1,"gc2":2,"ioR":'
 || greatest(user_id - 50, 0) || ',"ioW":' || greatest(50 - user_id, 0) || ',"handles":3,"threads":4}}' as value from ({SAMPLES}) s"""
)
def stats_lines(spark, sf):
    u, zero = F.col("user_id"), F.lit(0).cast("long")
    counters = lambda cpu, ws, alloc, io_r, io_w, gc: F.struct(
        cpu.alias("cpuMs"), ws.alias("ws"), F.lit(1).alias("priv"), alloc.alias("alloc"), F.lit(gc[0]).alias("gc0"), F.lit(gc[1]).alias("gc1"), F.lit(gc[2]).alias("gc2"),
        io_r.alias("ioR"), io_w.alias("ioW"), F.lit(3).alias("handles"), F.lit(4).alias("threads"),
    )
    s = rel(spark, sf, SAMPLES).withColumn("elapsed_ms", F.col("elapsed_ms").cast("double")).withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withColumn("before", counters(F.lit(0.0), zero, F.lit(50).cast("long"), F.lit(50).cast("long"), u, (5, 5, 5)))
    s = s.withColumn("after", counters(u + F.lit(0.75), F.col("event_id"), u, u, F.lit(50).cast("long"), (5, 6, 7)))
    return telemetry.stats_line(s)


@query(f"with t as ({TICKS}) select root, seq from t where not (kind = 'drain' and events = 0 and seq % 5 < 3)")
def telemetry_level(spark, sf):
    """Of one tick, summary drops quiet drains whose root had a line within the hour."""
    t = rel(spark, sf, TICKS).withColumn("ts", F.timestamp_seconds(F.lit(10_000_000))).withColumn("own", F.col("seq").cast("string"))
    last = t.select(F.col("own").alias("root"), F.timestamp_seconds(10_000_000 - F.when(F.col("seq") % 5 < 3, 3599).otherwise(3600)).alias("at"))
    named = t.withColumnRenamed("root", "group").withColumnRenamed("own", "root")
    return telemetry.keep_level(named, " Summary", last).select(F.col("group").alias("root"), "seq")


@query(f"with t as ({TICKS}) select '2026-01' as month, '{{\"ts\":\"2026-01-02T03:04:05.0000000Z\",\"kind\":\"summary\",\"uptimeSec\":12,\"drains\":' || count(*) filter (kind = 'drain') || ',\"polls\":' || count(*) filter (kind = 'poll') || ',\"baselines\":' || count(*) filter (kind = 'baseline') || ',\"resyncs\":' || count(*) filter (kind = 'resync') || ',\"records\":' || sum(records) || ',\"events\":' || sum(events) || ',\"cpuMs\":1.2,\"ws\":1,\"priv\":2,\"handles\":3,\"threads\":4}}' as value from t")
def summary_line(spark, sf):
    c = {"cpuMs": F.lit(1.25), "ws": F.lit(1), "priv": F.lit(2), "handles": F.lit(3), "threads": F.lit(4)}
    return telemetry.summary_line(rel(spark, sf, TICKS), F.lit("2026-01-02 03:04:05").cast("timestamp"), F.lit(12.4), c)


@query(f"select page_id, regexp_extract(path, '([^\\\\]*)\\\\?$', 1) as name, lower(to_hex(page_id + 4096)) as id, replace(replace(path, chr(92), ' '), '|', '') as line from ({URLS}) u")
def path_text(spark, sf):
    """Base names, identifiers as canonical hex, and text on one line."""
    u = rel(spark, sf, URLS)
    hexed = hex_id(F.concat(F.lit("000"), F.hex(F.col("page_id") + 4096)))
    broken = F.replace(F.replace(F.col("path"), F.lit("\\"), F.lit("\r\n")), F.lit("|"), F.lit(""))
    return u.select("page_id", base_name(F.col("path")).alias("name"), hexed.alias("id"), flatten_lines(broken).alias("line"))


@query(f"select type, count(*) as n from ({DIFF_SQL} union all ({DIFF_SQL})) u group by type")
def union_of_sources(spark, sf):
    """Events of two sources of a root in one log."""
    from ..streaming.sinks import union_logs

    events = _diff(spark, sf)
    return telemetry.events_by_type(union_logs(events, events.select(*EVENT_COLS, "root")))
