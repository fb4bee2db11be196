"""Operators against plain versions and hand-made cases."""

import collections
import random
import re
import sqlite3
import subprocess

import pytest
from lodestone.functions import expr
from lodestone.operators import graph, lookup, resolve, stats, telemetry, text, verify
from lodestone.plans import tools
from lodestone.sources import extract, tree
from lodestone.sources.model import DOCUMENTS, FILES, LINES, PROJECTS, REFS, SYMBOLS, Snapshot
from lodestone.streaming import coalesce, watch
from pyspark.sql import functions as F


def make(spark, symbols=(), refs=(), files=((1, "a.go"),), lines=()):
    f = [(i, p, "go", 1, 1, "c", "p", 1, None, None) for i, p in files]
    s = [(i, 1, n, q, k, i * 10, 1, i * 10 + 5, 1, "", "", "public", None) for i, n, q, k in symbols]
    r = [(n, 1, a, b, "x", "x", kind, n, 1, b is not None, 1) for n, (a, b, kind) in enumerate(refs)]
    frame = spark.createDataFrame
    return Snapshot(frame([], PROJECTS), frame(f, FILES), frame(s, SYMBOLS), frame(r, REFS), frame([], DOCUMENTS), frame(list(lines), LINES))


def test_like_against_sqlite(spark):
    values = ["abc", "ABC", "a_c", "aXc", "a%c", "ä", "Ä", "a\\c", "", "xabcx"]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pattern in ("abc", "%B%", "a_c", "Ä", "%\\%", "a%"):
        want = [v for v in values if con.execute("SELECT ? LIKE ?", (v, pattern)).fetchone()[0]]
        assert [r.v for r in df.filter(expr.sqlite_like(F.col("v"), pattern)).collect()] == want, pattern


def test_path_expressions(spark):
    tests = {"a_test.go": True, "a.go": False, "testdata/a_test.go": False, "x/b.spec.ts": True, "x/__tests__/b.js": True, "b.ts": False, "tests/c.py": True, "test_c.py": True, "c_test.py": True, "c.py": False, "README": False}
    df = spark.createDataFrame(list(tests.items()), "p string, want boolean")
    assert df.filter(expr.is_test_file(F.col("p")) != F.col("want")).count() == 0
    r = df.limit(1).select(expr.dir_name(F.lit("a/b/c.go")), expr.dir_name(F.lit("c.go")), expr.base_name(F.lit("a/c.go")), expr.short_name(F.lit("a.b.c")), expr.short_name(F.lit("c")), expr.parent_name(F.lit("a.b.c")), expr.parent_name(F.lit("c"))).first()
    assert tuple(r) == ("a/b", ".", "c.go", "c", "c", "a.b", "")


@pytest.mark.parametrize("glob,yes,no", [("**/*.go", ["a.go", "x/y/a.go"], ["a.gox"]), ("src/**", ["src/a", "src/b/c"], ["srcs/a"]), ("*.{ts,tsx}", ["a.ts", "b.tsx"], ["x/a.ts", "a.js"]), ("a?[bc].py", ["axb.py"], ["ax/b.py", "axd.py"])])
def test_globs(glob, yes, no):
    rx = re.compile(expr.glob_to_regex(glob))
    assert all(rx.match(x) for x in yes) and not any(rx.match(x) for x in no)


def test_focus_and_patterns():
    assert expr.focus_tokens("The auth_login of Auth-login!") == ["auth", "login"]
    with pytest.raises(ValueError):
        expr.line_pattern(r"(?=a)b")
    assert expr.line_pattern("(?i)a+b") == "(?i)a+b"


def plain_walk(edges, seeds, depth):
    out, now = {}, set(seeds)
    for d in range(1, depth + 1):
        now = {a for a, b in edges if b in now} - set(out)
        out |= dict.fromkeys(now, d)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walks_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(1, 12), rng.randint(1, 12)) for _ in range(rng.randint(5, 40))]
    snap = make(spark, [(i, f"f{i}", f"p.f{i}", "function") for i in range(1, 13)], [(a, b, "call") for a, b in edges])
    one = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id: r.distance for r in graph.frontier(snap.edges(), one, 4).collect()} == plain_walk(edges, [1, 2], 4)
    out, now = set(), {1}
    for d in (1, 2, 3):
        step = {(a, b, d) for a, b in edges if a in now}
        out |= step
        now = {b for _, b, _ in step}
    got = graph.neighborhood(snap, one.filter("id = 1"), depth=3, direction="out")[0]
    assert {(r.src, r.dst, r.depth) for r in got.collect()} == out
    paths, layer = [], [[1]]
    for _ in range(8):
        layer = [[*p, b] for p in layer for b in sorted({b for a, b in edges if a == p[-1] and b not in p})]
        if paths := sorted((p for p in layer if p[-1] == 7), key=lambda p: p[::-1]):
            break
    assert [r.ids for r in graph.shortest_paths(snap, 1, 7).orderBy("n").collect()] == paths[:5]


def test_seeds_and_errors(spark):
    snap = make(spark, [(1, "f", "a.f", "function"), (2, "f", "b.f", "function"), (3, "g", "a.g", "function")])
    assert graph.resolve_seed(snap, "b.f") == 2 and graph.resolve_seed(snap, "g") == 3
    with pytest.raises(lookup.BadParams):
        graph.resolve_seed(snap, "f")
    with pytest.raises(lookup.NotFound):
        tools.call(snap, "impact_analysis", target="none")
    with pytest.raises(lookup.BadParams):
        tools.call(snap, "find_symbol", wrong=1)
    with pytest.raises(tools.UnknownMethod):
        tools.call(snap, "reindex")
    assert len(tools.TOOLS) == 14
    assert graph.clamp(20, 5, 10) == (10, ["depth 20 was clamped to 10"])
    assert lookup.find_symbol(snap, "f", kind="class").hints() == ["'f' exists as function", "the index was never reconciled in full"]
    assert lookup.find_symbol(snap, "f", limit=1).hints()[0].startswith("more than 1")
    assert lookup.list_files(snap, since=[]).rows.count() == 0 and lookup.get_references(snap, "zz").hints() == ["unknown symbol 'zz'"]
    with pytest.raises(lookup.NotFound, match="a.go"):
        lookup.one_file(snap, "x/a.go")


def test_linking(spark):
    symbols = spark.createDataFrame([(1, "f", "a.f"), (2, "f", "b.f"), (3, "g", "a.g"), (4, "h", "a.h"), (5, "h", "a.h")], "id long, name string, qualified string")
    refs = spark.createDataFrame([(1, "a.f", "f", 1), (2, "f", "f", 0), (3, "g", "g", 0), (4, "g", "g", 1), (5, "a.h", "h", 0), (6, "x.g", "g", 0)], "id long, dst_name string, dst_short string, resolver_version int").withColumn("dst_symbol_id", F.lit(None).cast("long")).withColumn("resolved", F.lit(False))
    assert {r.id: r.dst_symbol_id for r in resolve.resolve_refs(refs, symbols).collect()} == {1: 1, 2: None, 3: 3, 4: None, 5: 4, 6: 3}


def test_projects_by_longest_root(spark):
    projects = spark.createDataFrame([(1, ""), (2, "a"), (3, "a/b")], "id long, root string")
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "path string")
    assert {r.path: r.project_id for r in resolve.assign_projects(paths, projects).collect()} == {"a/b/c": 3, "a/bc": 2, "x": 1}


def test_implements_and_scopes(spark):
    have = spark.createDataFrame([("T", "A"), ("T", "B"), ("U", "A")], "concrete string, method string")
    need = spark.createDataFrame([("I", "A"), ("I", "B"), ("J", "A")], "interface string, method string")
    assert {tuple(r) for r in resolve.implements(have, need).collect()} == {("T", "I"), ("T", "J"), ("U", "J")}
    calls = spark.createDataFrame([("f", "m", "C", "self.go"), ("f", "m", None, "util.run"), ("f", "m", None, "local"), ("f", "m", "C", "other.x")], "file string, module string, enclosing_class string, dst_name string")
    imports = spark.createDataFrame([("f", "util", "lib.util", None)], "file string, local string, module string, remote string")
    methods = spark.createDataFrame([("m", "C", "go")], "module string, class string, method string")
    assert {r.dst_name: r.resolved_name for r in resolve.resolve_imports(calls, imports, methods).collect()} == {"self.go": "m.C.go", "util.run": "lib.util.run", "local": "m.local", "other.x": "other.x"}


def test_classification(spark):
    removed = spark.createDataFrame([("p.A", "A", "type"), ("p.B", "B", "type"), ("p.C", "C", "type"), ("q.C", "C", "type")], "qualified string, name string, kind string")
    danglers = spark.createDataFrame([(1, "p.A", "A", True), (2, "B", "B", False), (3, "x.C", "C", False)], "id long, dst_name string, dst_short string, exact boolean")
    got = {r.qualified: r.level for r in verify.classify(removed, danglers, spark.createDataFrame([("Z",)], "name string")).collect()}
    assert got == {"p.A": "fail", "p.B": "fail", "p.C": "warn", "q.C": "warn"}
    alive = verify.classify(removed, danglers, spark.createDataFrame([("B",)], "name string"))
    assert {r.qualified: r.level for r in alive.collect()}["p.B"] == "warn" and verify.verdict(alive).first().level == "fail"
    assert verify.verdict(alive.limit(0)).first().level == "pass"


def test_collapse(spark):
    lines = spark.createDataFrame([("p", i, f"  line {i}") for i in range(1, 13)], LINES)
    s = spark.createDataFrame([("p", 1, "A", "m.A", "", 1, 6), ("p", 2, "inner", "m.A.inner", "", 2, 3), ("p", 3, "keep", "m.keep", "", 8, 10), ("p", 4, "B", "m.B", "", 11, 12)], "path string, id long, name string, qualified string, docstring string, start_line int, end_line int")
    got = [r.content for r in text.collapse(lines, s, "keep").orderBy("line").collect()]
    assert got == ["  ... m.A (6 lines)", "  line 7", "  line 8", "  line 9", "  line 10", "  ... m.B (2 lines)"]
    assert text.collapse(lines, s, "the").count() == 12


def test_adoption_and_probe(spark):
    t = spark.createDataFrame([("search_lexical", 80), ("find_symbol", 20), ("all", 100)], "tool string, count long")
    f = spark.createDataFrame([("Read", 10), ("Bash/rg", 10)], "tool string, count long")
    n = lambda k: spark.createDataFrame([(k,)], "n long")
    assert {r.mode: r.level for r in stats.adoption(t, f, n(5)).collect()} == {"search_only": "warn", "read_under_used": "warn", "grep_over_tools": "ok"}
    assert [r.mode for r in stats.adoption(t, f, n(1)).collect()] == ["insufficient_data"]
    c = spark.createDataFrame([("a.go", False, 1, 1, 1), ("v/a.go", True, 1, 1, 1), ("a.md", True, 1, 1, 1), ("b.go", True, 99, 1, 1), ("c.go", True, 1, 2, 1)], "path string, on_disk boolean, size_kb long, mtime_ns long, indexed_mtime_ns long")
    assert [r.reason for r in stats.probe(c, [r"\.go$"], ["^v/"], 50).collect()] == ["missing", "excluded", "not_included", "oversize", "stale"]


def test_percentiles_and_costs(spark):
    durations = [3, 9, 1, 7]
    calls = spark.createDataFrame([("read_focused", 10, 100, d, True) for d in durations] + [("ping", 1, 50, 5, False)], "tool string, in_bytes long, out_bytes long, dur_ms long, ok boolean")
    r = {x.tool: x for x in telemetry.tool_rollup(calls).collect()}
    s = sorted(durations)
    assert (r["read_focused"].p50_ms, r["read_focused"].p95_ms, r["all"]["count"], r["read_focused"].mean_ms) == (s[2], s[min(3, 4 * 95 // 100)], 5, 5)
    costs = telemetry.tool_costs(telemetry.tool_rollup(calls), spark.createDataFrame([("Read", "other", 2, 10, 1000)], "tool string, category string, count long, in_bytes long, out_bytes long"))
    assert [(x.tool, x.plain_bytes) for x in costs.collect()] == [("Read", 0), ("read_focused", 1600), ("ping", 0)]
    total = telemetry.session_cost(costs).first()
    assert (total.without_bytes, total.total_bytes, total.saved_bytes) == (2610, 1501, 1109)


def test_transcript_blocks(spark):
    rows = [(1, '{"type":"user","message":{"role":"user","content":"hello"}}'), (2, '{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Read"}]}'), (3, "broken")]
    got = telemetry.blocks(spark.createDataFrame(rows, "n long, raw string")).orderBy("n", "pos").collect()
    assert [(r.n, r.role, r.type, r.text, r.name) for r in got] == [(1, "user", "text", "hello", None), (2, "assistant", "text", "hi", None), (2, "assistant", "tool_use", None, "Read")]


def test_streams_as_replay(spark, tmp_path):
    rows = [("a", 0), ("a", 100), ("b", 150), ("a", 1000), ("c", 1900), ("c", 2600)]
    events = spark.createDataFrame([(p, t / 1000, i, i % 2 == 1, False, "s", None) for i, (p, t) in enumerate(rows)], "path string, s double, seq long, removed boolean, overflow boolean, source string, size long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.path, r.n, r.removed) for r in watch.debounced(events).collect()}
    assert got == {("a", 2, True), ("b", 1, False), ("a", 1, True), ("c", 1, False), ("c", 1, True)}
    assert sorted((r.n, r.overflow) for r in coalesce.coalesced(events, limit=5).collect()) == [(1, False), (5, True)]
    assert [r.action for r in watch.actions(events, limit=3).collect()] == ["rescan"]
    assert sorted((r.action, r.path) for r in watch.actions(events).collect()) == [("delete", "a"), ("delete", "c"), ("process", "b")]
    kept = watch.wanted(events.unionByName(events.limit(1).withColumn("path", F.lit(".git/x"))), [".*"], ["^b$"])
    assert {r.path for r in kept.collect()} == {"a", "c"}
    source, seen = str(tmp_path / "in"), []
    events.drop("s").write.parquet(source)
    stream = spark.readStream.schema(events.drop("s").schema).parquet(source)
    run = watch.start_merge(stream, lambda df, i: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert sorted(seen) == [("delete", "a"), ("delete", "c"), ("process", "b")]
    quiet = watch.debounced_stream(stream).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    quiet.processAllAvailable()
    quiet.stop()
    assert spark.table("quiet").columns == ["path", "first_ts", "n", "removed"]


GO = '''package auth

import (
\t"fmt"
\t"os"
)

// Session is open.
type Session struct{ n int }

type Store interface { Get() }

const Max = 3

// Login opens one.
func Login(name string) *Session {
\tfmt.Println("func no() {")
\treturn &Session{n: helper(1)}
}

func helper(i int) int { return i }

func (s *Session) Close() { helper(2); s.flush() }
'''
PY = '''import os
from lib import util

class Queue(Base):
    """Jobs."""
    def push(self, x):
        self.check(x)
        return util.run(x)
    def check(self, x): pass

def start():
    q = Queue()
    q.push(1)

def _hidden(): start()
'''
TS = '''import { Hash } from './hash';

export interface User { id: string }
export type Id = string;
export enum Color { Red }

export function normalize(s: string): string { return s.trim(); }

export abstract class Service extends Base implements A, B {
  private count = 0;
  constructor(private h: Hash) { super(); }
  issue(u: User): string { return this.print(normalize(u.id)); }
  private print(s: string) { return new Hash(s).hex(); }
}
export const LIMIT = 10;
'''


def kinds(rows, what="symbol"):
    return {(r["qualified"], r["kind"]) for r in rows if r["what"] == what}


def calls(rows):
    return {(r["src"], r["dst"], r["kind"]) for r in rows if r["what"] == "ref"}


def test_parsers():
    go = extract.parse_go("auth/service.go", GO)
    assert kinds(go) == {("auth.Session", "type"), ("auth.Store", "interface"), ("auth.Max", "const"), ("auth.Login", "function"), ("auth.helper", "function"), ("auth.Session.Close", "method")}
    assert {("", "fmt", "import"), ("", "os", "import"), ("auth.Login", "fmt.Println", "call"), ("auth.Login", "helper", "call"), ("auth.Session.Close", "s.flush", "call"), ("auth.Login", "Session", "type_ref")} <= calls(go)
    assert next(r["docstring"] for r in go if r.get("name") == "Login") == "Login opens one."
    py = extract.parse_python("jobs/worker.py", PY)
    assert kinds(py) == {("worker.Queue", "class"), ("worker.Queue.push", "method"), ("worker.Queue.check", "method"), ("worker.start", "function"), ("worker._hidden", "function")}
    assert {("worker.Queue.push", "util.run", "call"), ("worker.Queue", "Base", "inherit"), ("", "os", "import"), ("worker.start", "Queue", "call")} <= calls(py)
    ts = extract.parse_typescript("src/auth.ts", TS)
    assert {("auth.User", "interface"), ("auth.Id", "type"), ("auth.Color", "type"), ("auth.normalize", "function"), ("auth.Service", "class"), ("auth.Service.issue", "method"), ("auth.Service.print", "method"), ("auth.Service.count", "var"), ("auth.LIMIT", "const")} <= kinds(ts)
    assert {("", "./hash", "import"), ("auth.Service", "Base", "inherit"), ("auth.Service", "A", "inherit"), ("auth.Service", "B", "inherit"), ("auth.Service.issue", "normalize", "call"), ("auth.Service.issue", "this.print", "call"), ("auth.Service.print", "Hash", "call")} <= calls(ts)
    assert extract.parse_file("bad.py", "def (")[0]["what"] == "error"


def test_documents():
    keys = lambda p, t: [(r["key"], r["value"], r["line"]) for r in extract.parse_file(p, t)]
    assert keys("locales/en.json", '{\n "b": {"x": "1"},\n "a": ["p", {"q": "r"}],\n "n": 3}') == [("a.0", "p", 3), ("a.1.q", "r", 3), ("b.x", "1", 2)]
    assert keys("package.json", '{\n"dependencies": {"z": "1"},\n"devDependencies": {\n"a": "2", "n": 1}}') == [("a", "2", 4), ("z", "1", 2)]
    assert keys("go.mod", "module m\nrequire (\n\ta/b v1.0.0\n\tc/d v2 // indirect\n)\nreplace a => b v3\nrequire e/f v4\n") == [("a/b", "v1.0.0", 3), ("c/d", "v2  // indirect", 4), ("e/f", "v4", 7)]
    assert extract.document_kind("x/en.json") is None and extract.document_kind("i18n/en.json") == "i18n_json"


def test_tree_snapshot(spark, tmp_path):
    for p, t in {"auth/service.go": GO, "jobs/worker.py": PY, "src/auth.ts": TS, "locales/en.json": '{"k": "v"}', ".git/x.go": GO, "vendor/v.go": GO}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    files = tree.walk(spark, str(tmp_path), ["**/*.go", "**/*.py", "**/*.ts", "locales/*.json"], ["vendor/**"])
    snap = tree.snapshot(spark, files, 1)
    assert {r.path for r in snap.files.collect()} == {"auth/service.go", "jobs/worker.py", "src/auth.ts", "locales/en.json"}
    close = graph.impact_analysis(snap, "auth.helper", depth=3)
    assert {r.qualified: r.distance for r in close.collect()} == {"auth.Login": 1, "auth.Session.Close": 1}
    assert {r.qualified for r in graph.impact_analysis(snap, "auth.Service.print").collect()} == {"auth.Service.issue"}
    # q.push reaches Queue.push as the only symbol of that short name
    assert {r.qualified: r.distance for r in graph.impact_analysis(snap, "worker.Queue.check").collect()} == {"worker.Queue.push": 1, "worker.start": 2, "worker._hidden": 3}
    outline = {r.name: [c.name for c in r.children] for r in lookup.file_outline(snap, "jobs/worker.py").collect()}
    assert outline == {"Queue": ["push", "check"], "start": [], "_hidden": []}
    assert snap.documents.count() == 1 and lookup.find_document_key(snap, "k").rows.count() == 1
    again = resolve.upsert_actions(snap.files, tree.snapshot(spark, files, 2).files)
    assert collections.Counter(r.action for r in again.collect()) == {"touch": 4}
    assert text.search_lexical(snap, "func .*Login").rows.first().line == 16


def test_git(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.go").write_text("one")
    run("add", "."), run("commit", "-qm", "x")
    (tmp_path / "a.go").write_text("two")
    assert tree.changed_paths(str(tmp_path), "HEAD") == ["a.go"] and tree.blob(str(tmp_path), "HEAD", "a.go") == "one" and tree.blob(str(tmp_path), "HEAD", "b") is None
    assert tree.find_root(str(tmp_path)) == str(tmp_path)
