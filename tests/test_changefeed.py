"""Change-feed operators against hand-made cases, plain-Python folds and DuckDB."""

import json
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.paths import IgnoreRules, hex_id, is_under
from tidemark.operators import diff as D
from tidemark.operators import dirmap as M
from tidemark.operators import fold, gate, telemetry
from tidemark.sources import journal, stores, tree
from tidemark.streaming.sinks import event_line

SNAP = "root string, path string, size long, mtime long, attrs int"
M0 = 17734896005358979


def snap(spark, *rows):
    return spark.createDataFrame([("r", *r) for r in rows], SNAP)


KEEP = ("keep.txt", 10, M0, 32)


@pytest.mark.parametrize(
    "prev,curr,want",
    [
        ([KEEP], [KEEP, ("d\\größe.md", 731, M0, 128)], [("added", "d\\größe.md", 731, M0, None, None)]),
        ([KEEP, ("d\\öl.md", 97, M0, 32)], [KEEP], [("removed", "d\\öl.md", None, None, 97, M0)]),
        ([("f", 100, M0, 32)], [("f", 250, M0, 32)], [("modified", "f", 250, M0, 100, M0)]),
        ([("f", 1, M0, 32)], [("f", 1, M0 + 1, 32)], [("modified", "f", 1, M0 + 1, 1, M0)]),
        ([("f", 1, M0, 32)], [("f", 1, M0, 33)], [("modified", "f", 1, M0, 1, M0)]),
        ([KEEP], [KEEP], []),
        ([("Docs\\Report.TXT", 1, M0, 32)], [("docs\\report.txt", 1, M0, 32)], []),
        ([], [KEEP], [("added", "keep.txt", 10, M0, None, None)]),
        ([KEEP], [], [("removed", "keep.txt", None, None, 10, M0)]),
        ([("ΟΔΟΣ", 1, M0, 32)], [("οδος", 1, M0, 32)], []),
    ],
)
def test_diff(spark, prev, curr, want):
    got = D.diff(snap(spark, *prev), snap(spark, *curr)).select("type", "path", "size", "mtime", "prev_size", "prev_mtime").collect()
    assert [tuple(r) for r in got] == want


def test_preserve_and_poll(spark):
    prev = snap(spark, ("bad\\a", 1, M0, 32), ("bad2\\b", 1, M0, 32), ("BAD\\sub\\c", 1, M0, 32), ("x", 1, M0, 32))
    curr = snap(spark, ("bad\\A", 2, M0, 32))
    failed = spark.createDataFrame([("r", "bad"), ("r", "bad\\sub")], "root string, dir string")
    assert [r.path for r in D.preserve_failed(prev, curr, failed).collect()] == ["BAD\\sub\\c"]
    scanned = spark.createDataFrame([("r",)], "root string")
    events, full = D.poll(prev, curr, failed, scanned)
    assert sorted((r.type, r.path) for r in events.collect()) == [("modified", "bad\\A"), ("removed", "bad2\\b"), ("removed", "x")]
    assert full.count() == 2
    root_failed = spark.createDataFrame([("r", ".")], "root string, dir string")
    events, full = D.poll(prev, curr, root_failed, scanned)
    assert events.count() == 0 and full.count() == 4
    events, _ = D.poll(prev.where("false"), curr, failed, scanned.where("false"))
    assert [(r.type, r.files) for r in events.collect()] == [("baseline", 1)]


def test_last_wins(spark):
    e = spark.createDataFrame([("r", "A", 1, M0, 1, 1), ("r", "a", 2, M0, 2, 2)], SNAP + ", seq long")
    assert [(r.path, r.size) for r in D.from_entries(e).collect()] == [("A", 2)]


def test_is_under_and_hex(spark):
    cases = [("docs\\a", True), ("docs\\a\\b", True), ("DOCS\\a", True), ("docs2", False), ("docs2\\x", False), ("docs", False), ("do", False), ("docs\\", False)]
    df = spark.createDataFrame(cases, "p string, want boolean")
    assert all(r.got == r.want for r in df.select("want", is_under(F.col("p"), F.lit("docs")).alias("got")).collect())
    ids = spark.createDataFrame([("80000000000000000000000000000001",), ("00FF",), ("0",), ("xyz",), ("1" * 33,)], "f string")
    assert [r[0] for r in ids.select(hex_id(F.col("f"))).collect()] == ["80000000000000000000000000000001", "ff", "0", None, None]


IGNORED = ["_cache1\\n", "p\\_CACHE\\q\\r.bin", "_cache\\s", "größe\\_cache-x\\t.csv"]
FINE = ["u.csv", "p\\u.csv", "_cache", "p\\_cache.csv", "a_cache\\v", "cache\\v", ""]


def test_ignore_rules(spark):
    rules = IgnoreRules.of([" _cache ", "", None], ["%"])
    assert rules.dirs == ("_cache",) and rules.any and not IgnoreRules.of([" "], None).any
    df = spark.createDataFrame([(p,) for p in [*IGNORED, *FINE]], "p string")
    got = {r.p: r.i for r in df.select("p", rules.path(F.col("p")).alias("i")).collect()}
    assert all(got[p] for p in IGNORED) and not any(got[p] for p in FINE)
    files = {"%a.csv": True, "p\\%B.CSV": True, "per cent\\a%.csv": False, "%dir\\c.csv": False}
    df = spark.createDataFrame([(p,) for p in files], "p string")
    assert {r.p: r.i for r in df.select("p", rules.path(F.col("p")).alias("i")).collect()} == files
    end = spark.createDataFrame([("p\\_cache.d", "p\\%e.csv")], "d string, f string")
    r = end.select(rules.path(F.col("d"), True), rules.path(F.col("d")), rules.path(F.col("f"), True), rules.path(F.col("f"))).first()
    assert tuple(r) == (True, False, False, True)


J = {"journal_id": 7, "first_usn": 1000, "next_usn": 9000, "lowest_valid_usn": 1000}
C = {"journal_id": 7, "next_usn": 5000, "resync_trigger": 0}
GATES = [
    (None, True, {}, 1), (C, False, {}, 1), (C | {"resync_trigger": 4, "journal_id": 1, "next_usn": 10}, True, {"first_usn": 8000, "lowest_valid_usn": 8000}, 4),
    (C | {"journal_id": 1}, True, {}, 2), (C | {"next_usn": 4999}, True, {"first_usn": 5000, "lowest_valid_usn": 5000}, 3), (C | {"next_usn": 2000}, True, {"lowest_valid_usn": 3000}, 4),
    (C, True, {}, 0), (C | {"next_usn": 1000}, True, {}, 0), (C | {"next_usn": 3000}, True, {"lowest_valid_usn": 3000}, 0), (C, True, {"next_usn": 4000}, 4), (C, True, {"next_usn": 5000}, 0),
]


def test_gate(spark):
    rows = []
    for cursor, have, change, want in GATES:
        j = J | change
        assert gate.gate_check(cursor, have, j) == want
        c = cursor or {"next_usn": None, "journal_id": 0, "resync_trigger": 0}
        rows.append((c["next_usn"], c["journal_id"], c["resync_trigger"], have, j["journal_id"], j["first_usn"], j["lowest_valid_usn"], j["next_usn"], want))
    df = spark.createDataFrame(rows, "a long, b long, c int, d boolean, e long, f long, g long, h long, want int")
    got = df.select("want", gate.gate(*(F.col(x) for x in "abcdefgh")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    assert gate.advance(10, 20, 100) == (20, False) and gate.advance(10, 10, 100) == (10, True) and gate.advance(10, 5, 8) == (10, True)
    assert gate.backoff(1, 100) == 100 and gate.backoff(30, 100) == 120


def test_usn_decode(spark):
    e = journal.encode_record
    big = 0x80000000000000000000000000000001
    assert list(journal.decode_buffer(e(2, 5, 6, 77, 0x80000100, 32, "αβ.txt"))) == [("5", "6", 77, 0x80000100, 32, "αβ.txt")]
    two = e(2, 1, 2, 3, 4, 5, "odd") + e(3, big, 2, 9, 1, 16, "dir", gap=2)
    assert [(r[0], r[5]) for r in journal.decode_buffer(two)] == [("1", "odd"), (f"{big:x}", "dir")]
    assert list(journal.decode_buffer(bytes(64))) == []
    assert list(journal.decode_buffer(e(2, 1, 2, 3, 4, 5, "x")[:-8])) == []
    other = bytearray(e(2, 1, 2, 3, 4, 5, "x"))
    other[4] = 4
    assert [r[5] for r in journal.decode_buffer(bytes(other) + e(2, 1, 2, 3, 4, 5, "y"))] == ["y"]
    df = spark.createDataFrame([("v", bytearray(two)), ("w", None)], "volume string, buffer binary")
    assert [(r.volume, r.name) for r in journal.decode(df, keep=("volume",)).collect()] == [("v", "odd"), ("v", "dir")]


def python_fold(ops, state):
    state, out = dict(state), []
    for path, usn, op, size in sorted(ops, key=lambda o: o[1]):
        k = path.upper()
        post = None if op == "R" else size
        pre = state.get(k)
        kind = "removed" if post is None and pre is not None else "added" if post is not None and pre is None else "modified" if post is not None and post != pre and op != "M" else None
        if kind:
            out.append((usn, kind))
        if post is None:
            state.pop(k, None)
        else:
            state[k] = post
    return sorted(out), state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_is_the_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    ops = [(rnd.choice(["a", "A", "b", "c\\d", "e"]), i, rnd.choice("RSSSM"), rnd.choice([None, 1, 2])) for i in range(300)]
    ops = [(p, u, o, 5 if o == "M" and s is None else s) for p, u, o, s in ops]
    state = {"A": 1, "E": 2, "Z": 3}
    df = spark.createDataFrame([("r", p, u, o, s, None if s is None else 0, None if s is None else 32) for p, u, o, s in ops], "root string, path string, usn long, op string, size long, mtime long, attrs int")
    st = spark.createDataFrame([("r", k.lower(), v, 0, 32) for k, v in state.items()], SNAP)
    events, after = python_fold(ops, state)
    assert sorted((r.usn, r.type) for r in fold.events(df, st).collect()) == events
    assert {r.path.upper(): r.size for r in fold.new_state(df, st).collect()} == after


def test_rename_replay(spark):
    st = snap(spark, ("d\\x", 1, 0, 32), ("d2\\y", 2, 0, 32))
    ops = spark.createDataFrame([("r", "d\\x", 1, "S", 9, 0, 32), ("r", "e\\x", 5, "R", None, None, None)], "root string, path string, usn long, op string, size long, mtime long, attrs int")
    ev, after = fold.replay(ops, [("r", "d", "e", 3)], st)
    assert sorted((r.usn, r.type, r.path) for r in ev.collect()) == [(1, "modified", "d\\x"), (3, "added", "e\\x"), (3, "removed", "d\\x"), (5, "removed", "e\\x")]
    assert [r.path for r in after.collect()] == ["d2\\y"]


def test_directory_ladder(spark):
    rows = [(S.FILE_DELETE, True, True, False, True, "root_displaced"), (S.FILE_DELETE, True, True, True, False, "unmap"), (S.FILE_DELETE, True, True, False, False, "remove"), (S.RENAME_NEW, True, True, False, False, "rename"), (S.RENAME_NEW, False, True, False, False, "move_in"), (S.RENAME_NEW, True, False, False, False, "move_out"), (S.FILE_CREATE, False, True, False, False, "map"), (S.RENAME_OLD, True, True, False, False, "none")]
    df = spark.createDataFrame(rows, "reason long, k boolean, p boolean, i boolean, is_root boolean, want string")
    assert all(r.got == r.want for r in df.select("want", fold.directory_action("k", "p", "i").alias("got")).collect())


def test_dirmap(spark):
    d = spark.createDataFrame([("1", "docs"), ("2", "docs\\a\\b"), ("3", "docs2\\x")], "frn string, path string")
    assert sorted(r.path for r in M.remap_subtree(d, "docs", "docs2-new").collect()) == ["docs2-new", "docs2-new\\a\\b", "docs2\\x"]
    up = spark.createDataFrame([("1", None, 1), ("9", "z", 2)], "frn string, path string, seq long")
    assert sorted(r.frn for r in M.upsert(d, up).collect()) == ["2", "3", "9"]
    chain = spark.createDataFrame([("0", None, ""), *((str(i), str(i - 1), f"n{i}") for i in range(1, 40)), ("c1", "c2", "x"), ("c2", "c1", "y")], "frn string, parent_frn string, name string")
    got = {r.frn: r.path for r in M.closure(chain).collect()}
    assert len(got) == 40 and got["0"] == "" and got["39"] == "\\".join(f"n{i}" for i in range(1, 40))


def test_ticks_and_text(spark):
    df = spark.createDataFrame([("2026-03-14T15:09:26.5358979Z",), ("2026-03-14T15:09:26Z",), ("nope",), ("1999-12-31T23:59:59.9999999Z",)], "m string")
    rows = df.select("m", S.ticks(F.col("m")).alias("t"), S.ticks_text(S.ticks(F.col("m"))).alias("b")).collect()
    assert rows[0].t % 10_000_000 == 5358979 and rows[0].b == rows[0].m and rows[2].t is None and rows[3].b == rows[3].m
    sizes = spark.createDataFrame([(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (1048576, "1 MB"), (3 * 2**30 + 2**28, "3.25 GB")], "n long, want string")
    assert all(r.got == r.want for r in sizes.select("want", S.humanize_bytes(F.col("n")).alias("got")).collect())
    spans = spark.createDataFrame([(1.25, "1.25s"), (2.0, "2.0s"), (42.3, "42s"), (61.0, "1m 01s"), (3723.0, "1h 02m 03s")], "s double, want string")
    assert all(r.got == r.want for r in spans.select("want", S.humanize_duration(F.col("s")).alias("got")).collect())


def test_event_lines_by_type(spark):
    e = spark.sql("select timestamp'2025-12-31 23:59:59' ts, 'r' root, t.* from values ('added','φ',1L,0L,null,null,null),('removed','b',null,null,2L,0L,null),('modified','c',1L,0L,2L,0L,null),('baseline',null,null,null,null,null,5L) t(type,path,size,mtime,prev_size,prev_mtime,files)")
    got = {json.loads(r.value)["type"]: json.loads(r.value) for r in event_line(e).collect()}
    assert set(got["added"]) == {"ts", "root", "type", "path", "size", "mtime"} and got["added"]["path"] == "φ"
    assert set(got["removed"]) == {"ts", "root", "type", "path", "prevSize", "prevMtime"}
    assert set(got["modified"]) == set(got["added"]) | set(got["removed"]) and set(got["baseline"]) == {"ts", "root", "type", "files"}
    assert event_line(e).first().month == "2025-12"


def test_snapshot_reader(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"p":"a.txt","s":11,"m":"2026-03-14T15:09:26.5358979Z","a":32}\n{"p":"broken.txt","s":,,,"m":not-json\n{"p":"A.TXT","s":22,"m":"2026-03-14T15:09:26.5358979Z","a":33}\n{"p":"","s":1,"m":"2026-03-14T15:09:26Z","a":1}\n')
    rows, bad = stores.read_snapshot(spark, str(f), "r")
    assert [(r.path, r.size) for r in rows.collect()] == [("a.txt", 22)] and bad.count() == 1
    assert stores.read_snapshot(spark, str(tmp_path / "none"), "r") is None and stores.read_dirmap(spark, str(tmp_path / "none")) is None
    f.write_text('{"f":"00a","p":"x"}\n{"f":"zz","p":"y"}\n{"f":\n')
    rows, bad = stores.read_dirmap(spark, str(f))
    assert [(r.frn, r.path) for r in rows.collect()] == [("a", "x")] and bad.count() == 2


def test_config_and_cursor(tmp_path):
    c = stores.parse_config('{ // x\n"tickSeconds": 5, "roots": [{"id":"A","path":"C:\\\\x"},{"id":"a","path":"C:\\\\y"},{"id":"b","path":"rel"},{"id":"n","path":"\\\\\\\\srv\\\\s//t",},],}')
    assert [(r.id, r.is_network) for r in c.roots] == [("A", False), ("n", True)] and c.tick_seconds == 5 and c.roots[1].path.endswith("//t")
    assert stores.read_cursor(str(tmp_path / "no")) is None
    assert stores.reconcile({"A", "b"}, {"a", "c"}) == ({"b"}, {"c"})


def test_tree_scan(spark, tmp_path):
    for p in ("keep.txt", ".hidden", "sub/notes.txt", ".tmp.up/x", "sub/.tmpx/y", "sub/~$z.docx", "empty/"):
        q = tmp_path / p
        q.mkdir(parents=True) if p.endswith("/") else (q.parent.mkdir(parents=True, exist_ok=True), q.write_text(""))
    (tmp_path / "link").symlink_to(tmp_path / "keep.txt")
    rows = tree.scan(spark, str(tmp_path), [".tmp"], ["~$"]).collect()
    assert sorted(r.path for r in rows if r.kind == "file") == [".hidden", "keep.txt", "sub\\notes.txt"]
    assert sorted(r.path for r in rows if r.kind == "dir") == ["", "empty", "sub"]
    assert [r.path for r in tree.scan(spark, str(tmp_path / "none")).collect()] == ["."]


def test_heartbeat(spark):
    rows = [("r", i, i * 600, "drain", int(i % 13 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "root string, seq long, at_s long, kind string, events long")
    last, want = None, []
    for _, i, at, _, ev in rows:
        if ev or last is None or at - last >= 3600:
            want.append(i)
            last = at
    assert sorted(r.seq for r in telemetry.heartbeat(df, "Summary ").collect()) == want
    assert telemetry.heartbeat(df, "off").count() == 0 and telemetry.heartbeat(df, "odd").count() == 60


def test_queries_match_their_sql(spark):
    from tidemark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("region", "nation", "customer", "orders", "events", "pages", "supplier"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda rows: sorted(repr(tuple(round(float(x), 6) if isinstance(x, (float, Decimal)) else x for x in r)) for r in rows)
    for name, q in catalogue.QUERIES.items():
        df = q(spark, sf)
        cols = sorted(df.columns)
        want = plain(con.sql(f"select {','.join(cols)} from ({catalogue.ORACLES[name]}) z").fetchall())
        assert plain(df.select(*cols).collect()) == want and want, name


def test_resolve_as_of_brute_force(spark):
    """Null paths, gaps, empty intervals and identifiers without versions, against every interval; no join in the plan."""
    rnd = random.Random(4)
    spans = []
    for f in "abc":
        cuts = sorted(rnd.sample(range(200), 40))
        spans += [(f, None if rnd.random() < 0.2 else f"{f}{i}", x, y) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if rnd.random() < 0.8] + [(f, f"{f}z", cuts[-1], None), (f, "never", 5, 5)]
    recs = [(u, rnd.choice([*"abcd", None]), f"n{u}") for u in range(220)]
    want = {(u, f"{p}\\{n}") for u, f, n in recs for g, p, x, y in spans if f == g and p is not None and x <= u and (y is None or u < y)}
    got = M.resolve_as_of(spark.createDataFrame(recs, "usn long, parent_frn string, name string"), spark.createDataFrame(spans, "frn string, path string, from_usn long, to_usn long"))
    assert len(want) > 50 and sorted((r.usn, r.path) for r in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
