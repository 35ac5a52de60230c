"""Drains against a sequential fold in Python; runners over a recorded journal and a real tree; polling; live configuration."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.functions import scalars as S
from tidemark.functions.paths import IgnoreRules
from tidemark.operators import drain as R
from tidemark.operators import gate, poller
from tidemark.sources import journal, stores, tree
from tidemark.streaming import runner as T
from tidemark.streaming import sinks

SNAP = "root string, path string, size long, mtime long, attrs int"
RECORD = "root string, usn long, frn string, parent_frn string, reason long, attrs long, name string"
RULES = IgnoreRules.of(["."], ["~"])
below = lambda p, d: len(p) > len(d) + 1 and p.upper().startswith(d.upper() + "\\")
within = lambda p, d: p.upper() == d.upper() or below(p, d)


class Sequential:
    """One record after the other, over plain dictionaries."""

    def __init__(self, state, names, live, dirs):
        self.state, self.names, self.live, self.dirs, self.log = {k.upper(): (k, v) for k, v in state.items()}, dict(names), {k.upper(): v for k, v in live.items()}, dirs, []

    def emit(self, usn, kind, path, new, old):
        self.log.append((usn, kind, path, new, old))

    def record(self, usn, frn, parent, reason, is_dir, name):
        at = self.names.get(parent)
        here = None if at is None else f"{at}\\{name}" if at else name
        if is_dir:
            return self.directory(usn, frn, here, reason, name)
        if name.startswith("~") or here is None:
            return True
        gone = reason & S.FILE_DELETE or (reason & S.RENAME_OLD and not reason & S.RENAME_NEW)
        had, now = self.state.get(here.upper()), None if gone else self.live.get(here.upper())
        if now is None and had:
            self.emit(usn, "removed", here, None, had[1])
            del self.state[here.upper()]
        elif now is not None and (had is None or had[1] != now):
            self.emit(usn, "modified" if had else "added", here, now, had and had[1])
            self.state[here.upper()] = (here, now)
        return True

    def drop(self, frn, old):
        self.names = {f: p for f, p in self.names.items() if f != frn and not within(p, old)}

    def directory(self, usn, frn, here, reason, name):
        old = self.names.get(frn)
        if old == "" and reason & (S.FILE_DELETE | S.RENAME_OLD | S.RENAME_NEW):
            return False
        if name.startswith("."):
            if old is not None:
                self.drop(frn, old)
        elif reason & S.FILE_DELETE or (reason & S.RENAME_NEW and here is None):
            if old is not None:
                for k, (p, v) in [x for x in self.state.items() if below(x[1][0], old)]:
                    self.emit(usn, "removed", p, None, v)
                    del self.state[k]
                self.drop(frn, old)
        elif reason & S.RENAME_NEW and old is None:
            for p, v in [(p, v) for p, v in self.live.items() if below(p, here)]:
                if p not in self.state:
                    self.emit(usn, "added", p, v, None)
                self.state[p] = (self.state[p][0] if p in self.state else p, v)
            self.names |= {f: p for f, p in self.dirs.items() if below(p, here)} | {frn: here}
        elif reason & S.RENAME_NEW and old.upper() != here.upper():
            for _, (p, v) in [x for x in self.state.items() if below(x[1][0], old)]:
                to = here + p[len(old) :]
                self.emit(usn, "removed", p, None, v)
                self.emit(usn, "added", to, v, None)
                del self.state[p.upper()]
                self.state[to.upper()] = (to, v)
            self.names = {f: here + p[len(old) :] if within(p, old) else p for f, p in self.names.items()}
        elif reason & S.FILE_CREATE and here is not None and old is None:
            self.names[frn] = here
        return True


def inputs(seed):
    rnd = random.Random(seed)
    names = {"0": "", "1": "a", "2": "a\\b", "3": "c", "4": "c\\d"}
    leaves = ["f", "g", "h"]
    folders = [p for p in names.values() if p] + ["a\\e", "c\\e", "e", "e\\b", "a\\b\\e", "e\\x"]
    state = {f"{d}\\{x}": rnd.randint(1, 3) for d in folders[:4] for x in leaves if rnd.random() < 0.7}
    live = {f"{d}\\{x}": rnd.randint(1, 3) for d in folders for x in leaves if rnd.random() < 0.7}
    dirs = {"7": "e\\b", "8": "a\\e", "9": "e\\x"}
    recs = []
    for usn in range(1, 101):
        is_dir = rnd.random() < 0.15
        if is_dir:
            reason = rnd.choice([S.FILE_CREATE, S.FILE_DELETE, S.RENAME_NEW, S.RENAME_NEW, S.RENAME_OLD, S.RENAME_OLD | S.RENAME_NEW])
            recs.append((usn, rnd.choice("1234567"), rnd.choice(["0", "0", "1", "3", "5", "zz"]), reason, True, rnd.choice(["e", "b", "E", "q", ".i"])))
        else:
            reason = rnd.choice([S.FILE_CREATE, S.FILE_DELETE, S.RENAME_OLD, S.RENAME_NEW | S.RENAME_OLD, S.DATA_EXTEND, S.SECURITY_CHANGE])
            recs.append((usn, f"x{usn}", rnd.choice("01234567"), reason, False, rnd.choice([*leaves, "F", "~f"])))
    return state, names, live, dirs, recs


def frames(spark, state, names, live, dirs, recs):
    return (
        spark.createDataFrame([("r", u, f, p, r, 16 if d else 32, n) for u, f, p, r, d, n in recs], RECORD),
        spark.createDataFrame([("r", p, v, 0, 32) for p, v in live.items()], SNAP),
        spark.createDataFrame(list(dirs.items()), "frn string, path string"),
        spark.createDataFrame([("r", p, v, 0, 32) for p, v in state.items()], SNAP),
        spark.createDataFrame(list(names.items()), "frn string, path string"),
    )


@pytest.mark.parametrize("seed,most", [(1, 50_000), (2, 50_000), (3, 4), (4, 1)])
def test_drain_is_the_sequential_fold(spark, seed, most):
    state, names, live, dirs, recs = inputs(seed)
    seq = Sequential(state, names, live, dirs)
    for r in recs:
        if r[3] & S.WATCHED:
            assert seq.record(*r)
    got = R.drain(*frames(spark, state, names, live, dirs, recs), RULES, most)
    up = lambda x: sorted((u, k, p.upper(), n or 0, o or 0) for u, k, p, n, o in x)
    assert up((r.usn, r.type, r.path, r.size, r.prev_size) for r in got.events.collect()) == up(seq.log)
    assert {r.path.upper(): r.size for r in got.state.collect()} == {k: v for k, (_, v) in seq.state.items()}
    assert {r.frn: r.path.upper() for r in got.dirmap.collect()} == {f: p.upper() for f, p in seq.names.items()}
    assert len(seq.log) > 8 and not got.displaced


def test_many_directory_operations_are_folded_at_once(spark, monkeypatch):
    state, names, live, dirs, _ = inputs(6)
    rnd, seq, recs = random.Random(6), Sequential(state, names, live, dirs), []
    for usn in range(1, 201):
        name, parent = rnd.choice(["e", "b", "a", "E", "q", ".i"]), rnd.choice(["0", "0", "1", "3", "5", "zz"])
        if rnd.random() < 0.5:
            rec = (usn, rnd.choice("1234567"), parent, rnd.choice([S.FILE_CREATE, S.FILE_DELETE, S.RENAME_NEW, S.RENAME_NEW]), True, name)
        else:
            rec = (usn, f"x{usn}", rnd.choice("01234567"), rnd.choice([S.FILE_CREATE, S.FILE_DELETE, S.DATA_EXTEND]), False, rnd.choice(["f", "g", "F"]))
        renames = rec[4] and rec[3] & S.RENAME_NEW and rec[1] in seq.names and parent in seq.names and not name.startswith(".")
        if not renames:
            recs.append(rec)
            assert seq.record(*rec)
    stored, keep = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, tag: (stored.append(tag), keep(df, tag))[1])
    got = R.drain(*frames(spark, state, names, live, dirs, recs), RULES)
    up = lambda x: sorted((u, k, p.upper(), n or 0, o or 0) for u, k, p, n, o in x)
    assert up((r.usn, r.type, r.path, r.size, r.prev_size) for r in got.events.collect()) == up(seq.log)
    assert {r.path.upper(): r.size for r in got.state.collect()} == {k: v for k, (_, v) in seq.state.items()}
    assert {r.frn: r.path.upper() for r in got.dirmap.collect()} == {f: p.upper() for f, p in seq.names.items()}
    # no directory operation but a rename stores a state
    assert stored == ["records", "ops", "steps"] and len({u for u, k, *_ in seq.log if k == "removed"}) > 5


def test_directories_keep_the_stored_spelling(spark):
    rec = lambda usn, reason: (usn, "9", "0", reason, True, "e")
    args = frames(spark, {"E\\F": 1}, {"0": ""}, {"e\\f": 2, "e\\g": 3}, {"9": "e"}, [rec(1, S.RENAME_NEW), rec(2, S.FILE_DELETE)])
    came = R.drain(args[0].where("usn = 1"), *args[1:])
    assert {(r.path, r.size) for r in came.state.collect()} == {("E\\F", 2), ("e\\g", 3)}
    both = R.drain(*args)
    assert {(r.usn, r.type, r.path, r.prev_size) for r in both.events.collect()} == {(1, "added", "e\\g", None), (2, "removed", "E\\F", 2), (2, "removed", "e\\g", 3)}
    assert both.state.count() == 0 and [r.path for r in both.dirmap.collect()] == [""]


def test_directory_plans_are_quick():
    """20,000 renames and removals among 20,000 directories: time grows with the paths that change."""
    class Row:
        def __init__(self, usn, frn, reason, name):
            self.usn, self.frn, self.parent_frn, self.reason, self.name = usn, frn, "0", reason, name

    paths = {"0": ""} | {str(i): f"d{i}" for i in range(1, 20_001)}
    rows = [Row(i, str(i), S.RENAME_NEW if i % 2 else S.FILE_DELETE, f"n{i}") for i in range(1, 20_001)]
    started = time.process_time()
    ops, displaced = R.plan_directories(rows, paths, {}, RULES)
    assert not displaced and [o.kind for o in ops[:2]] == ["rename", "remove"] and len(ops) == 20_000
    assert time.process_time() - started < 10


def test_drain_edges(spark):
    state, names, live, dirs, recs = inputs(5)
    args = frames(spark, state, names, live, dirs, recs)
    none = R.drain(args[0].where("false"), *args[1:])
    assert none.events.count() == 0 and none.state.count() == len(state) and none.dirmap.count() == len(names)
    gone = spark.createDataFrame([("r", 30, "0", "zz", S.RENAME_OLD, 16, "root")], RECORD)
    out = R.drain(args[0].unionByName(gone), *args[1:], RULES)
    assert out.displaced and out.events.count() == 0 and out.state.count() == len(state)


def test_gate_errors():
    assert gate.on_error(1178, False) == ("degraded", 5) and gate.on_error(1179, True) == ("resync", 5)
    assert gate.on_error(1181, True) == ("resync", 3) and gate.on_error(1, False) == ("unsupported", 0) and gate.on_error(5, False) == ("reopen", 0)
    assert [gate.clamp_tick(x) for x in (0, 10, 9999)] == [1, 10, 3600]


def buffers(folder, rows, next_usn):
    body = b"".join(journal.encode_record(3, f, p, u, r, a, n) for u, f, p, r, a, n in rows)
    (folder / f"{next_usn}.usn").write_bytes(next_usn.to_bytes(8, "little") + body)
    (folder / "meta.json").write_text(json.dumps({"journal_id": 7, "first_usn": 1, "lowest_valid_usn": 1, "next_usn": next_usn}))


def test_journal_source(spark, tmp_path):
    with pytest.raises(journal.SourceError) as e:
        journal.journal_meta(spark, str(tmp_path))
    assert e.value.code == gate.NOT_ACTIVE
    buffers(tmp_path, [(5, 2, 1, S.FILE_CREATE, 32, "a"), (9, 3, 1, S.SECURITY_CHANGE, 32, "b"), (12, 4, 1, S.FILE_DELETE, 32, "c")], 20)
    rows, at = journal.read_range(spark, str(tmp_path), 6, 7)
    assert [(r.usn, r.name) for r in rows.collect()] == [(12, "c")] and at == 20
    for since, name, code in ((0, 7, gate.ENTRY_DELETED), (6, 8, gate.NOT_ACTIVE)):
        with pytest.raises(journal.SourceError) as e:
            journal.read_range(spark, str(tmp_path), since, name)
        assert e.value.code == code


def events(spark, out):
    return sorted((e["type"], e.get("path")) for e in (json.loads(r.value) for r in spark.read.text(str(out)).collect()))


def test_journal_runner(spark, tmp_path, monkeypatch):
    """Baseline, drain, crash between events and state, replay, displaced root, missing root, failing source, poll meanwhile."""
    tree_, jour, src = tmp_path / "t", tmp_path / "j", tmp_path / "cp"
    (tree_ / "d").mkdir(parents=True)
    jour.mkdir()
    (tree_ / "d" / "one").write_text("1")
    scan = lambda: T.live_of(tree.scan(spark, str(tree_), ["."], ["~"]), "r") if tree_.exists() else None
    meta = lambda: journal.journal_meta(spark, str(jour))
    faults = []
    run = T.JournalRunner(spark, "r", str(tmp_path / "state"), str(tmp_path / "out"), scan, meta, rules=RULES, stats_dir=str(tmp_path / "stats"), telemetry_level="summary", fault=faults.append)
    go = lambda: run.start(journal.stream(spark, str(jour)), str(src)).awaitTermination()
    ids = {r.path: int(r.frn, 16) for r in scan().dirs.collect()}
    buffers(jour, [(5, 77, ids["d"], S.FILE_CREATE, 32, "one")], 10)
    go()
    assert events(spark, tmp_path / "out") == [("baseline", None)] and run.cursor() == {"journal_id": 7, "next_usn": 10, "resync_trigger": 0}
    (tree_ / "d" / "two").write_text("22")
    (tree_ / "d" / "~skip").write_text("22")
    buffers(jour, [(10, 78, ids["d"], S.FILE_CREATE, 32, "two"), (11, 79, ids["d"], S.FILE_CREATE, 32, "~skip"), (12, 80, 99, S.FILE_CREATE, 32, "outside")], 20)
    real = sinks.StateStore.commit
    monkeypatch.setattr(sinks.StateStore, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(Exception):
        go()
    monkeypatch.setattr(sinks.StateStore, "commit", real)
    assert run.cursor()["next_usn"] == 10
    go()
    go()
    assert events(spark, tmp_path / "out") == [("added", "d\\two"), ("baseline", None)] and run.cursor()["next_usn"] == 13
    # renamed directory: its files move, with the metadata that is stored
    (tree_ / "d").rename(tree_ / "e")
    buffers(jour, [(20, ids["d"], ids[""], S.RENAME_OLD | S.RENAME_NEW, 16, "e")], 30)
    go()
    assert events(spark, tmp_path / "out")[:2] == [("added", "d\\two"), ("added", "e\\one")] and sorted(r.path for r in run.state().collect()) == ["e\\one", "e\\two"]
    assert {r.path for r in run.dirmap().collect()} == {"", "e"}
    before = run.store.current()
    buffers(jour, [(30, ids[""], 99, S.RENAME_OLD, 16, "t")], 40)
    with pytest.raises(Exception, match="RootDisplaced"):
        go()
    one = spark.createDataFrame([(41, "f", "0", S.FILE_CREATE, 32, "x")], "usn long, frn string, parent_frn string, reason long, attrs long, name string")
    tree_.rename(tmp_path / "away")
    with pytest.raises(T.Suspended):
        run.apply(one, 99)
    assert run.store.current() == before
    (tmp_path / "away").rename(tree_)
    (jour / "meta.json").unlink()
    with pytest.raises(T.Degraded):
        run.apply(one, 99)
    assert run.cursor()["resync_trigger"] == 5
    run.store.persist_trigger(3)
    assert run.cursor()["resync_trigger"] == 5
    (tree_ / "new").write_text("")
    run.degraded_poll("poll-1")
    assert ("added", "new") in events(spark, tmp_path / "out") and run.cursor()["resync_trigger"] == 5 and run.totals["poll"] == 1
    buffers(jour, [], 50)
    run.apply(one, 100)
    assert run.cursor() == {"journal_id": 7, "next_usn": 50, "resync_trigger": 0} and run.totals["resync"] == 1
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "stats")).collect()]
    assert [x["kind"] for x in sorted(lines, key=lambda x: x["ts"])][:2] == ["baseline", "drain"] and "trigger" in lines[0] | {"trigger": 1} and not faults
    end = json.loads(run.summary(F.lit("2026-01-01").cast("timestamp"), 5.5).first().value)
    assert end["kind"] == "summary" and end["resyncs"] == 1 and end["baselines"] == 1 and end["uptimeSec"] == 6
    # only what the pointer and the one before name is left
    assert len([p for p in (tmp_path / "state" / "snapshot").iterdir() if p.is_dir()]) <= 3


def test_poll_runner(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    faults = []
    scan = lambda: T.live_of(tree.scan(spark, str(root)), "r") if root.exists() else None
    run = T.PollRunner(spark, "r", str(tmp_path / "s"), str(tmp_path / "o"), scan, 1, lambda: 0.5, fault=faults.append)
    assert run.poll(0.0, elapsed=1) == "baseline" and run.times.next == 60 and run.poll(59.0) == "wait"
    (root / "a").write_text("1")
    assert run.poll(60.0, elapsed=30) == "poll" and run.times.next == 180
    root.rename(tmp_path / "u")
    assert run.poll(200.0, elapsed=30) == "skip" and run.times.next == 260 and len(faults) == 1
    (tmp_path / "u").rename(root)
    (root / "a").unlink()
    assert run.poll(300.0, elapsed=1) == "poll"
    assert events(spark, tmp_path / "o") == [("added", "a"), ("baseline", None), ("removed", "a")]
    assert json.loads(spark.read.text(str(tmp_path / "o")).where("value like '%baseline%'").first().value)["files"] == 0
    assert poller.Due(0, lambda: 0.0).done(0.0, 0.0, True) == 54


def test_store_lock_and_scopes(spark, tmp_path, monkeypatch):
    store = sinks.StateStore(spark, str(tmp_path / "s"))
    store.lock()
    with pytest.raises(sinks.Locked):
        sinks.StateStore(spark, str(tmp_path / "s")).lock()
    store.unlock()
    store.lock()
    assert store.current() is None and store.read("snapshot", SNAP) is None
    with runtime.scratch():
        a = runtime.materialize(spark.range(3), "x")
        with runtime.scratch():
            b, c = runtime.materialize(spark.range(4), "y"), runtime.keep(runtime.materialize(spark.range(5), "z"))
        assert not runtime.path_exists(spark, b._tidemark_path) and c.count() == 5
        runtime.release(a)
    assert not any(runtime.path_exists(spark, x._tidemark_path) for x in (a, b, c))

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: {"spark.master": "spark://x"}.get(k, d))

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Cluster)


def test_live_configuration():
    log = []

    class Watcher:
        def __init__(self, root):
            self.id = root.id

        def stop(self):
            log.append(("stop", self.id))

    def build(root, config):
        if root.path.endswith("bad"):
            raise OSError(root.id)
        log.append(("start", root.id))
        return Watcher(root)

    conf = lambda mode="full", **paths: stores.Config(telemetry=mode, roots=tuple(stores.Root(k, v) for k, v in paths.items()))
    faults = []
    w = stores.Watchers(build, lambda r, e: faults.append(r.id))
    w.apply(conf(a="C:\\x", b="D:\\bad"), 0)
    w.apply(conf(A="C:\\x", b="D:\\bad"), 59)
    assert log == [("start", "a")] and faults == ["b"]
    w.apply(conf(a="C:\\x", b="D:\\bad"), 60)
    assert faults == ["b", "b"]
    w.apply(conf(a="C:\\y"), 61)
    w.apply(conf("off", a="C:\\y"), 62)
    w.stop()
    assert log[1:] == [("stop", "a"), ("start", "a"), ("stop", "a"), ("start", "a"), ("stop", "a")]
    assert stores.Root("n", "\\\\s\\x").source == "poll" and stores.Root("c", "c:\\x").volume == "C:"
    with pytest.raises(ValueError):
        stores.Root("c", "/x").volume  # noqa: B018


def test_error_log(spark, tmp_path):
    rows = spark.sql("select timestamp'2026-01-01' ts, 'a\r\nb' message union all select timestamp'2026-01-02', 'c'")
    assert sinks.append_errors(rows, str(tmp_path / "e")) == 2 and sinks.error_count(spark, str(tmp_path / "e")) == 2
