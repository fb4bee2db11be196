"""The write path: reconciles, single changes, and the verification of a change from git."""

import subprocess

import pytest

from lodestone.operators import graph
from lodestone.plans import tools
from lodestone.sources import store, tree
from lodestone.streaming import watch

GLOBS = (["**/*.py", "**/*.json"], ["vendor/**"])
QUEUE = "class Queue:\n    def push(self, x):\n        self.check(x)\n\n    def check(self, x):\n        return x\n\n\ndef limit():\n    return 1\n"
USER = "import queue\n\n\ndef start():\n    queue.limit()\n    q = queue.Queue()\n    q.push(1)\n"


def put(root, **files):
    for p, t in files.items():
        at = root / p.replace("__", "/").replace("_py", ".py")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(t)


def state(snap):
    """All tables as sorted rows, but for times."""
    drop = {"files": ["mtime_ns", "last_indexed_at"]}
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    return {t: rows(getattr(snap, t).drop(*drop.get(t, []))) for t in store.TABLES}


def indexed(snap):
    return {r.path: r.last_indexed_at for r in snap.files.collect()}


def test_reconcile_and_changes(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    put(root, work__queue_py=QUEUE, app__main_py=USER, vendor__x_py=QUEUE)
    with pytest.raises(FileNotFoundError):
        store.read(spark, folder)
    one = store.run_once(spark, str(root), folder, *GLOBS, now=1)
    assert one.last_full_scan_at == 1 and indexed(one) == {"work/queue.py": 1, "app/main.py": 1}
    assert state(one) == state(tree.snapshot(spark, tree.walk(spark, str(root), *GLOBS), 1))
    assert {r.qualified for r in graph.impact_analysis(one, "queue.Queue.check").collect()} >= {"queue.Queue.push"}
    put(root, work__queue_py=QUEUE.replace("check", "test"), app__more_py="def more():\n    start()\n")
    two = store.run_once(spark, str(root), folder, *GLOBS, now=2)
    assert indexed(two) == {"work/queue.py": 2, "app/main.py": 1, "app/more.py": 2}
    assert state(two) == state(tree.snapshot(spark, tree.walk(spark, str(root), *GLOBS), 2))
    # A deleted file, a changed one, one that the globs leave out, and one that vanished before its event was handled.
    (root / "app/more.py").unlink()
    put(root, app__main_py=USER + "\n\ndef stop():\n    start()\n")
    batch = spark.createDataFrame([("delete", "app/more.py"), ("process", "app/main.py"), ("process", "vendor/x.py"), ("process", "gone.py")], "action string, path string")
    three = store.handle_changes(spark, str(root), folder, batch, *GLOBS, now=3)
    assert three.last_full_scan_at == 2 and indexed(three) == {"work/queue.py": 2, "app/main.py": 3}
    full = state(tree.snapshot(spark, tree.walk(spark, str(root), *GLOBS), 3))
    assert state(three) == full
    assert state(store.handle_changes(spark, str(root), folder, batch, *GLOBS, now=4)) == full
    assert state(store.handle_changes(spark, str(root), folder, batch.limit(0), *GLOBS, now=5)) == full
    assert store.newest(spark, folder) == (4, 2) and store.vacuum(spark, folder) == [2, 1]
    rescan = spark.createDataFrame([("rescan", None)], "action string, path string")
    assert store.handle_changes(spark, str(root), folder, rescan, *GLOBS, now=6).last_full_scan_at == 6


def test_stream_into_index(spark, tmp_path):
    root, folder, log = tmp_path / "tree", str(tmp_path / "index"), str(tmp_path / "log")
    put(root, work__queue_py=QUEUE)
    store.run_once(spark, str(root), folder, *GLOBS, now=1)
    put(root, app__main_py=USER)
    events = spark.sql("SELECT 'app/main.py' AS path, current_timestamp() AS ts, 1L AS seq, false AS removed, false AS overflow, 's' AS source")
    events.write.parquet(log)
    run = watch.start_merge(spark.readStream.schema(events.schema).parquet(log), lambda a, i: store.handle_changes(spark, str(root), folder, a, *GLOBS, now=2), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert indexed(store.read(spark, folder)) == {"work/queue.py": 1, "app/main.py": 2}


def test_verify_from_git(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    put(root, work__queue_py=QUEUE, app__main_py=USER)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "x")
    put(root, work__queue_py=QUEUE.replace("push", "put").replace("limit", "bound"))
    snap = store.run_once(spark, str(root), folder, *GLOBS, now=1)
    got, stale = tools.verify_git(snap, str(root), "HEAD")
    assert {r.qualified: r.level for r in got.collect()} == {"queue.Queue.push": "warn", "queue.limit": "fail"} and not stale.collect()
    put(root, work__queue_py=QUEUE)
    got, stale = tools.verify_git(snap, str(root), "HEAD")
    assert not stale.collect() and not got.collect()  # nothing differs from the base any more
    (root / "app/main.py").write_text(USER + "# more\n")
    assert {(r.path, r.state) for r in tools.verify_git(snap, str(root), "HEAD")[1].collect()} == {("app/main.py", "modified")}
