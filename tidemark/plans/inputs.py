"""Projections of the driver's tables onto snapshots, journals and maps.

The projections are SQL text that both engines read, so that queries and their
oracles start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table

PATH = "o_orderstatus || chr(92) || substr(o_orderpriority, 1, 1) || chr(92) || cast(o_orderkey as varchar(20)) || '.dat'"
CENTS = "cast(round({0} * 100) as bigint)"
PREV = f"select 'r' as root, {PATH} as path, {CENTS.format('o_totalprice')} as size, {{ticks}} as mtime, 32 as attrs from orders where o_orderkey % 10 <> 0"
CURR = (
    f"select 'r' as root, case when o_orderkey % 13 = 0 then upper({PATH}) else {PATH} end as path, {CENTS.format('o_totalprice')} + case when o_orderkey % 7 = 0 then 1 else 0 end as size, "
    "{ticks} as mtime, case when o_orderkey % 11 = 0 then 33 else 32 end as attrs from orders where o_orderkey % 10 <> 1"
)
REASON = "cast(case event_type when 'signup' then 256 when 'view' then 32768 when 'click' then 2 when 'purchase' then 2147483649 else 512 end as bigint)"
RECORDS = (
    f"select 'r' as root, event_id as usn, 'u' || cast(user_id as varchar(20)) as path, {REASON} as reason, "
    f"case when value < 1 then null else {CENTS.format('value')} end as size, case when value < 1 then null else cast(0 as bigint) end as mtime, "
    "case when value < 1 then null else 32 end as attrs from events"
)
NODES = (
    "select 'r' || cast(r_regionkey as varchar(20)) as frn, cast(null as varchar(20)) as parent_frn, r_name as name from region "
    "union all select 'n' || cast(n_nationkey as varchar(20)), 'r' || cast(n_regionkey as varchar(20)), n_name from nation "
    "union all select 'c' || cast(c_custkey as varchar(20)), 'n' || cast(c_nationkey as varchar(20)), c_name from customer"
)
URLS = "select page_id, replace(substr(url, position('://' in url) + 3), '/', chr(92)) as path from pages"
# One root's drain: map, prior state, live tree, records. Directory records stand at fractions of the journal.
_USERS = "customer join nation on n_nationkey = c_custkey % 25 join region on n_regionkey = r_regionkey"
_HOME = "r_name || chr(92) || n_name || chr(92) || 'u' || cast(c_custkey as varchar(20)) || '.dat'"
_BALANCE = f"{CENTS.format('c_acctbal')} + case when c_custkey % 5 = 0 then 1 else 0 end"
DRAIN_MAP = (
    "select '0' as frn, '' as path union all select 'r' || cast(r_regionkey as varchar(20)), r_name from region "
    "union all select 'n' || cast(n_nationkey as varchar(20)), r_name || chr(92) || n_name from nation join region on n_regionkey = r_regionkey"
)
DRAIN_STATE = f"select 'r' as root, {_HOME} as path, {CENTS.format('c_acctbal')} as size, cast(c_custkey as bigint) as mtime, 32 as attrs from {_USERS} where c_custkey % 3 <> 0"
DRAIN_FILES = (
    f"select 'r' as root, {_HOME} as path, {_BALANCE} as size, cast(c_custkey as bigint) as mtime, 32 as attrs from {_USERS} where c_custkey % 7 <> 0 "
    f"union all select 'r', 'ASIA' || chr(92) || 'RENAMED' || chr(92) || 'u' || cast(c_custkey as varchar(20)) || '.dat', {_BALANCE} + 5, cast(c_custkey as bigint), 32 from {_USERS} where n_nationkey = 0 "
    f"union all select 'r', 'MIDDLE EAST' || chr(92) || 'FRESH' || chr(92) || 'u' || cast(c_custkey as varchar(20)) || '.dat', {_BALANCE}, cast(c_custkey as bigint), 32 from {_USERS} where c_custkey % 50 = 7 "
    f"union all select 'r', 'AMERICA' || chr(92) || 'CAME' || chr(92) || 's' || cast(s_suppkey as varchar(20)) || '.dat', {CENTS.format('s_acctbal')}, cast(s_suppkey as bigint), 32 from supplier "
    f"union all select 'r', 'AMERICA' || chr(92) || 'CAME' || chr(92) || 'DEEP' || chr(92) || 'u' || cast(c_custkey as varchar(20)) || '.dat', {_BALANCE}, cast(c_custkey as bigint), 32 from {_USERS} where c_custkey % 50 = 9"
)
DRAIN_DIRS = "select 'x1' as frn, 'AMERICA' || chr(92) || 'CAME' as path union all select 'x3', 'AMERICA' || chr(92) || 'CAME' || chr(92) || 'DEEP'"
#: (eighth of the journal, id, parent, reason, name): a new directory, a rename, a move out, a removal, an ignored name, a move in.
DRAIN_ACTS = ((1, "x2", "r4", 256, "FRESH"), (2, "n0", "r2", 8192, "RENAMED"), (3, "n6", "zz", 8192, "NATION_6"), (4, "r3", "0", 512, "EUROPE"), (5, "n12", "r2", 8192, ".hidden"), (6, "x1", "r1", 8192, "CAME"))
ACT_USN = "cast(floor((select max(event_id) from events) * {0} / 8.0) as bigint) * 10"
DRAIN_RECORDS = (
    "select 'r' as root, cast(event_id * 10 + 1 as bigint) as usn, 'f' || cast(user_id as varchar(20)) as frn, "
    "case user_id % 50 when 7 then 'x2' when 9 then 'x3' else 'n' || cast(user_id % 25 as varchar(20)) end as parent_frn, "
    f"{REASON} as reason, cast(32 as bigint) as attrs, case when user_id % 50 = 13 then '~' else '' end || 'u' || cast(user_id as varchar(20)) || '.dat' as name from events"
    + "".join(f" union all select 'r', {ACT_USN.format(e)}, '{f}', '{p}', cast({r} as bigint), cast(16 as bigint), '{n}'" for e, f, p, r, n in DRAIN_ACTS)
)
TICKS_DUCK = "epoch_us(o_orderdate) * 10"
TICKS_SPARK = "unix_micros(cast(o_orderdate as timestamp)) * 10"
TABLES = ("orders", "events", "region", "nation", "customer", "pages", "supplier")


def rel(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a projection, read from the tables it names."""
    out = sql.replace("{ticks}", TICKS_SPARK).replace("varchar(20)", "string")
    for t in TABLES:
        if re.search(rf"\b(?:from|join) {t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(f"_tm_{t}")
            out = re.sub(rf"\b(from|join) {t}\b", rf"\1 _tm_{t}", out)
    return spark.sql(out)


def duck(sql: str) -> str:
    return sql.replace("{ticks}", TICKS_DUCK)
