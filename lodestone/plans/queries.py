"""The engine's queries over the star-schema snapshot, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph, lookup, resolve, stats, telemetry, text, verify
from lodestone.plans.oracle import over
from lodestone.sources.adapter import star_snapshot
from lodestone.sources.adapter import telemetry as star_telemetry
from lodestone.sources.adapter import transcript as star_transcript
from lodestone.sources.model import Snapshot
from lodestone.streaming import coalesce, watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def snapshot_query(sql: str | None = None, more: str = "") -> Callable[[Callable[[Snapshot], DataFrame]], Callable]:
    """Registers a query over the snapshot under the function's name; sql: its body over the oracle's tables."""

    def register(f: Callable[[Snapshot], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, d: f(star_snapshot(spark, d))
        if sql:
            _SQL[f.__name__] = over(sql, more)
        return f

    return register


def table_query(sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = over(sql, more)
        return f

    return register


def _seed(snap: Snapshot) -> DataFrame:
    """The symbol with most inbound references."""
    return snap.edges().groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select(F.col("dst").alias("id"))


def _pair_seed(snap: Snapshot) -> DataFrame:
    """The same for a query that walks the snapshot's pairs."""
    return snap.pairs.groupBy("dst").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("id"))


# --- symbols, references, files ---

_FOUND = "s.id, s.name, qualified, s.kind, shown AS path, project"
_RANK = "CASE WHEN s.name = '{0}' THEN 0 WHEN s.name ILIKE '{0}%' THEN 1 ELSE 2 END"


def _found(m: lookup.Matches) -> DataFrame:
    return m.rows.select("id", "name", "qualified", "kind", "path", "project")


@snapshot_query(f"SELECT {_FOUND} FROM symbols s JOIN pf ON pf.id = file_id WHERE s.name ILIKE '%blue_bolt%' OR qualified ILIKE '%blue_bolt%' ORDER BY {_RANK.format('blue_bolt')}, length(qualified), s.id LIMIT 20")
def find_symbol(snap: Snapshot) -> DataFrame:
    return _found(lookup.find_symbol(snap, "blue_bolt"))


@snapshot_query(f"SELECT {_FOUND} FROM symbols s JOIN pf ON pf.id = file_id WHERE (s.name ILIKE '%GEAR%' OR qualified ILIKE '%GEAR%') AND s.kind = 'class' ORDER BY length(qualified), s.id LIMIT 20")
def find_symbol_kind(snap: Snapshot) -> DataFrame:
    return _found(lookup.find_symbol(snap, "GEAR", kind="class"))


@snapshot_query(f"SELECT {_FOUND} FROM symbols s JOIN pf ON pf.id = file_id WHERE (s.name ILIKE '%ring%' OR qualified ILIKE '%ring%') AND project = 'asia' ORDER BY {_RANK.format('ring')}, length(qualified), s.id LIMIT 20")
def find_symbol_project(snap: Snapshot) -> DataFrame:
    return _found(lookup.find_symbol(snap, "ring", project="asia"))


@snapshot_query(f"SELECT {_FOUND} FROM symbols s JOIN pf ON pf.id = file_id WHERE false")
def find_symbol_unknown_project(snap: Snapshot) -> DataFrame:
    return _found(lookup.find_symbol(snap, "ring", project="nowhere"))


@snapshot_query(
    f"""SELECT id, name, qualified, kind, path, project FROM (SELECT {_FOUND}, docstring FROM symbols s JOIN pf ON pf.id = file_id WHERE s.name ILIKE '%hot%' OR qualified ILIKE '%hot%'
    ORDER BY {_RANK.format("hot")}, length(qualified), s.id LIMIT 40) WHERE contains(name, 'widget') OR contains(qualified, 'widget') OR contains(docstring, 'widget') OR contains(name, 'economy') OR contains(qualified, 'economy') OR contains(docstring, 'economy')"""
)
def find_symbol_focus(snap: Snapshot) -> DataFrame:
    return _found(lookup.find_symbol(snap, "hot", limit=40, focus="the widget of Economy"))


_TARGET = "t AS (SELECT id, qualified FROM symbols WHERE qualified = '{0}' OR name = '{0}'), ids AS (SELECT id FROM t UNION SELECT s.id FROM symbols s JOIN t ON s.qualified ILIKE t.qualified || '.%')"
_REFS = """SELECT r.id, b AS branch, shown AS path, r.line, coalesce(ss.qualified, '') AS src, dst_name, r.kind FROM
    (SELECT *, 0 AS b FROM refs WHERE dst_symbol_id IN (SELECT id FROM ids) UNION ALL SELECT *, 1 FROM refs WHERE NOT resolved AND (dst_name = '{0}' OR dst_short = '{0}')) r
    JOIN pf ON pf.id = src_file_id LEFT JOIN symbols ss ON ss.id = src_symbol_id ORDER BY b, shown, r.line, r.id LIMIT {1}"""


def _referred(m: lookup.Matches) -> DataFrame:
    return m.rows.select("id", "branch", "path", "line", "src", "dst_name", "kind")


@snapshot_query(_REFS.format("red_widget_1", 100), _TARGET.format("red_widget_1"))
def refs_resolved(snap: Snapshot) -> DataFrame:
    return _referred(lookup.get_references(snap, "red_widget_1"))


@snapshot_query(_REFS.format("f7", 100), _TARGET.format("f7"))
def refs_textual_fallback(snap: Snapshot) -> DataFrame:
    return _referred(lookup.get_references(snap, "f7"))


@snapshot_query(_REFS.format("small_ring", 500), _TARGET.format("small_ring"))
def refs_with_children(snap: Snapshot) -> DataFrame:
    return _referred(lookup.get_references(snap, "small_ring", limit=500))


_LIST = "SELECT pf.id, shown AS path, project, language, size_bytes, count(s.id) AS symbol_count FROM pf LEFT JOIN symbols s ON s.file_id = pf.id WHERE {} GROUP BY ALL ORDER BY shown, pf.id LIMIT 500"


@snapshot_query(_LIST.format("true"))
def list_files(snap: Snapshot) -> DataFrame:
    return lookup.list_files(snap).rows


@snapshot_query(_LIST.format("language = 'python' AND path ILIKE '%MOD1%'"))
def list_files_language(snap: Snapshot) -> DataFrame:
    return lookup.list_files(snap, language="python", name_contains="MOD1").rows


@snapshot_query(_LIST.format("path IN ('src/mod3.go', 'src/mod4.ts') OR shown IN ('services/asia/src/mod5.py')"))
def list_files_since(snap: Snapshot) -> DataFrame:
    return lookup.list_files(snap, since=["src/mod3.go", "src/mod4.ts", "services/asia/src/mod5.py"]).rows


@snapshot_query("SELECT t.id, t.name, t.kind, t.start_line, coalesce((SELECT string_agg(c.name, ',' ORDER BY c.start_line, c.id) FROM symbols c WHERE c.parent_id = t.id), '') AS children FROM symbols t WHERE t.file_id = 3 AND t.parent_id IS NULL")
def file_outline(snap: Snapshot) -> DataFrame:
    return lookup.file_outline(snap, "src/mod3.go").select("id", "name", "kind", "start_line", F.concat_ws(",", "children.name").alias("children"))


@snapshot_query("SELECT kind, count(*) AS n FROM symbols WHERE file_id = 4 GROUP BY kind")
def file_summary_kinds(snap: Snapshot) -> DataFrame:
    return lookup.file_summary(snap, "src/mod4.ts").select(F.explode("kinds").alias("kind", "n"))


@snapshot_query("SELECT language, (SELECT max(end_line) FROM symbols WHERE file_id = 4) AS loc, (SELECT string_agg(name, ',' ORDER BY name) FROM symbols WHERE file_id = 4 AND visibility = 'public' AND parent_id IS NULL) AS exports FROM files WHERE id = 4")
def file_summary_exports(snap: Snapshot) -> DataFrame:
    return lookup.file_summary(snap, "src/mod4.ts").select("language", "loc", F.concat_ws(",", "exports").alias("exports"))


@snapshot_query("SELECT DISTINCT dst_name AS import FROM refs WHERE kind = 'import' AND src_file_id = 4")
def file_summary_imports(snap: Snapshot) -> DataFrame:
    return lookup.file_summary(snap, "src/mod4.ts").select(F.explode("imports").alias("import"))


_KEY = "SELECT d.id, key, value, d.kind, shown AS path, d.line FROM docs d JOIN pf ON pf.id = file_id WHERE key ILIKE '%{0}%' AND {1} ORDER BY CASE WHEN key = '{0}' THEN 0 WHEN key ILIKE '{0}%' THEN 1 ELSE 2 END, length(key), key, d.id LIMIT 50"


@snapshot_query(_KEY.format("brand#1", "true"))
def document_key(snap: Snapshot) -> DataFrame:
    return lookup.find_document_key(snap, "brand#1").rows.select("id", "key", "value", "kind", "path", "line")


@snapshot_query(_KEY.format("ECONOMY", "d.kind = 'i18n_json'"))
def document_key_kind(snap: Snapshot) -> DataFrame:
    return lookup.find_document_key(snap, "ECONOMY", kind="i18n_json").rows.select("id", "key", "value", "kind", "path", "line")


@snapshot_query(
    """SELECT * FROM (SELECT 'in' AS direction, a AS package, count(*) AS n FROM x WHERE b = 'services/asia/src' AND a <> b GROUP BY a ORDER BY n DESC, a LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'out' AS direction, b AS package, count(*) AS n FROM x WHERE a = 'services/asia/src' AND a <> b GROUP BY b ORDER BY n DESC, b LIMIT 20)""",
    "x AS (SELECT regexp_replace(f.shown, '/[^/]*$', '') AS a, regexp_replace(g.shown, '/[^/]*$', '') AS b FROM refs r JOIN pf f ON f.id = src_file_id JOIN symbols s ON s.id = dst_symbol_id JOIN pf g ON g.id = s.file_id WHERE r.kind <> 'import')",
)
def package_refs(snap: Snapshot) -> DataFrame:
    return lookup.package_refs(snap, "services/asia/src")


# --- graph ---

_IMPACT = "SELECT s.id, qualified, s.kind, shown AS path, d AS distance FROM (SELECT id, min(depth) AS d FROM w WHERE depth > 0 GROUP BY id) r JOIN symbols s USING (id) JOIN pf ON pf.id = file_id"
_WALK = "w AS (SELECT id, 0 AS depth FROM seed UNION SELECT src, depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.dst = w.id WHERE depth < {})"


def _impact(snap: Snapshot, **options) -> DataFrame:
    return graph.impact(snap, _pair_seed(snap), **options).select("id", "qualified", "kind", "path", "distance")


@snapshot_query(_IMPACT, _WALK.format(5))
def impact(snap: Snapshot) -> DataFrame:
    return _impact(snap)


@snapshot_query(_IMPACT + " WHERE s.kind = 'method'", _WALK.format(3))
def impact_kind(snap: Snapshot) -> DataFrame:
    return _impact(snap, kind="method", depth=3)


@snapshot_query(_IMPACT + " WHERE path IN ('src/mod1.ts', 'src/mod2.py')", _WALK.format(4))
def impact_since(snap: Snapshot) -> DataFrame:
    return _impact(snap, depth=4, since=["src/mod1.ts", "src/mod2.py"])


def _walk(direction: str, depth: int, start: str = "seed") -> str:
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    return (
        f"{direction}_w AS (SELECT NULL::BIGINT AS src, NULL::BIGINT AS dst, NULL::VARCHAR AS kind, NULL::BIGINT AS file_id, NULL::INTEGER AS line, id AS at, 0 AS depth FROM {start} "
        f"UNION SELECT e.src, e.dst, e.kind, e.file_id, e.line, e.{far}, depth + 1 FROM {direction}_w w JOIN edges e ON e.{near} = w.at WHERE depth < {depth}), "
        f"{direction}_e AS (SELECT DISTINCT src, dst, kind, file_id, line, CAST(depth AS INTEGER) AS depth, '{direction}' AS direction FROM {direction}_w WHERE depth > 0)"
    )


@snapshot_query("SELECT * FROM out_e", _walk("out", 2))
def neighborhood_out(snap: Snapshot) -> DataFrame:
    return graph.neighborhood(snap, _seed(snap), direction="out")[0]


@snapshot_query("SELECT * FROM in_e", _walk("in", 3))
def neighborhood_in(snap: Snapshot) -> DataFrame:
    return graph.neighborhood(snap, _seed(snap), depth=3, direction="in")[0]


@snapshot_query(
    "SELECT id, qualified, kind, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT id, 0 AS depth FROM seed UNION ALL SELECT dst, depth FROM out_e UNION ALL SELECT src, depth FROM in_e) JOIN symbols USING (id) GROUP BY ALL",
    _walk("out", 2) + ", " + _walk("in", 2),
)
def neighborhood_both(snap: Snapshot) -> DataFrame:
    return graph.neighborhood(snap, _seed(snap))[1].select("id", "qualified", "kind", "depth")


_PAIRS = "ih AS (SELECT DISTINCT a.qualified AS a, b.qualified AS b FROM refs r JOIN symbols a ON a.id = src_symbol_id JOIN symbols b ON b.id = dst_symbol_id WHERE r.kind = 'inherit'), both_ways AS (SELECT a, b FROM ih UNION SELECT b, a FROM ih)"
_TYPE = "me AS (SELECT s.id, name, qualified FROM symbols s WHERE kind IN ('type', 'class', 'interface') AND qualified IN (SELECT a FROM both_ways) ORDER BY s.id LIMIT 1)"
_METHOD = "me AS (SELECT s.id, name, qualified FROM symbols s WHERE kind = 'method' AND parent_id IS NOT NULL AND regexp_replace(qualified, '\\.[^.]*$', '') IN (SELECT a FROM both_ways) ORDER BY s.id LIMIT 1)"


def _first_type(snap: Snapshot) -> int:
    i = snap.refs.filter("kind = 'inherit' AND src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL")
    ends = i.select(F.col("src_symbol_id").alias("id")).unionByName(i.select(F.col("dst_symbol_id").alias("id"))).distinct()
    return snap.symbols.filter(F.col("kind").isin("type", "class", "interface")).join(ends, "id", "left_semi").agg(F.min("id")).first()[0]


@snapshot_query("SELECT s.id, s.qualified FROM symbols s WHERE s.qualified IN (SELECT b FROM both_ways JOIN me ON a = me.qualified) AND s.id <> (SELECT id FROM me)", _PAIRS + ", " + _TYPE)
def inherit_expand_type(snap: Snapshot) -> DataFrame:
    return graph.inherit_expand(snap, _first_type(snap)).join(snap.symbols.select("id", "qualified"), "id")


@snapshot_query("SELECT s.id, s.qualified FROM symbols s WHERE s.qualified IN (SELECT b || '.' || me.name FROM both_ways JOIN me ON a = regexp_replace(me.qualified, '\\.[^.]*$', '')) AND s.id <> (SELECT id FROM me)", _PAIRS + ", " + _METHOD)
def inherit_expand_method(snap: Snapshot) -> DataFrame:
    i = snap.refs.filter("kind = 'inherit' AND src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL")
    ends = i.select(F.col("src_symbol_id").alias("id")).unionByName(i.select(F.col("dst_symbol_id").alias("id"))).distinct()
    owners = snap.symbols.join(ends, "id", "left_semi").select(F.col("qualified").alias("owner")).distinct()
    methods = snap.symbols.filter("kind = 'method' AND parent_id IS NOT NULL").withColumn("owner", F.regexp_replace("qualified", r"\.[^.]*$", ""))
    seed = methods.join(owners, "owner", "left_semi").agg(F.min("id")).first()[0]
    return graph.inherit_expand(snap, seed if seed is not None else -1).join(snap.symbols.select("id", "qualified"), "id")


@snapshot_query(
    "SELECT CAST(row_number() OVER (ORDER BY walk) AS INTEGER) AS n, array_to_string(list_reverse(walk), '>') AS ids FROM back WHERE len(walk) = (SELECT min(depth) FROM w JOIN start ON start.id = w.id) + 1 AND walk[len(walk)] = (SELECT id FROM start) ORDER BY walk LIMIT 5",
    _WALK.format(3)
    + ", start AS (SELECT id FROM w WHERE depth > 0 AND id <> (SELECT id FROM seed) GROUP BY id ORDER BY min(depth) DESC, id LIMIT 1)"
    + ", lay AS (SELECT id, min(depth) AS d FROM w GROUP BY id), back AS (SELECT [id] AS walk FROM seed UNION ALL SELECT list_append(walk, src) FROM back JOIN (SELECT DISTINCT src, dst FROM edges WHERE src <> dst) e ON dst = walk[len(walk)] JOIN lay ON lay.id = src AND lay.d = len(walk) WHERE len(walk) < 4)",
)
def critical_path(snap: Snapshot) -> DataFrame:
    goal = _pair_seed(snap).first()
    far = graph.reach(snap.pairs, _pair_seed(snap), 3).filter(F.col("id") != goal[0]).orderBy(F.desc("distance"), "id").first() if goal else None
    paths = graph.shortest_paths(snap, far[0], goal[0]) if far else snap.symbols.sparkSession.createDataFrame([], "n int, ids array<long>")
    return paths.select("n", F.array_join("ids", ">").alias("ids"))


@snapshot_query("SELECT shown AS path, project, CAST(min(depth) AS INTEGER) AS distance FROM w JOIN symbols s USING (id) JOIN pf ON pf.id = file_id WHERE depth > 0 GROUP BY ALL", _WALK.format(3))
def closure_files(snap: Snapshot) -> DataFrame:
    return graph.closure_files(snap, _pair_seed(snap), 3)


# --- lines ---


@snapshot_query(r"SELECT path, line, regexp_replace(regexp_replace(content, '\r+$', ''), '[ \t]+$', '') AS content FROM lines WHERE regexp_matches(content, '^(The|Le) [a-z]+ing') ORDER BY path, line LIMIT 50")
def lexical_regex(snap: Snapshot) -> DataFrame:
    return text.search_lexical(snap, "^(The|Le) [a-z]+ing").rows


@snapshot_query(r"SELECT path, line, regexp_replace(regexp_replace(content, '\r+$', ''), '[ \t]+$', '') AS content FROM lines WHERE path ILIKE '%doc/1%' AND regexp_matches(content, '[0-9]{3,}') ORDER BY path, line LIMIT 50")
def lexical_path_contains(snap: Snapshot) -> DataFrame:
    return text.search_lexical(snap, "[0-9]{3,}", path_contains="DOC/1").rows


@snapshot_query(r"SELECT path, line, regexp_replace(regexp_replace(content, '\r+$', ''), '[ \t]+$', '') AS content FROM lines WHERE regexp_matches(content, '(?i)license') ORDER BY path, line LIMIT 200")
def lexical_case_insensitive(snap: Snapshot) -> DataFrame:
    return text.search_lexical(snap, "(?i)license", k=200).rows


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.posexplode(F.split("html", "\n")).alias("line", "content"))
    return p.withColumn("line", F.col("line") + 1)


@table_query("SELECT path, line, regexp_replace(regexp_replace(content, '\\r+$', ''), '[ \\t]+$', '') AS content FROM (SELECT 'page/' || page_id AS path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)) WHERE regexp_matches(content, '<h[1-3]') ORDER BY path, line LIMIT 100")
def lexical_pages(spark: SparkSession, d: str) -> DataFrame:
    return text.search_lines(_page_lines(spark, d), "<h[1-3]", k=100).rows


@snapshot_query("SELECT path, line, content FROM lines WHERE line <= 50")
def read_preview(snap: Snapshot) -> DataFrame:
    return text.preview(snap.lines)


@snapshot_query(
    """SELECT path, CAST(line AS INTEGER) AS line, content FROM (
    SELECT path, line, CASE WHEN id IS NULL THEN content ELSE regexp_extract(content, '^[ \t]*') || '... sec' || id || ' (' || (b - a + 1) || ' lines)' END AS content, a FROM
    (SELECT l.path, l.line, l.content, sec.id, sec.a, sec.b, row_number() OVER (PARTITION BY l.path, l.line ORDER BY sec.a, sec.b) AS k FROM lines l LEFT JOIN sec ON sec.path = l.path AND l.line BETWEEN a AND b) WHERE k = 1) WHERE a IS NULL OR line = a""",
    "sec AS (SELECT 'doc/' || doc_id AS path, doc_id * 10 + u AS id, CAST(2 + 4 * u AS INTEGER) AS a, CAST(4 + 4 * u AS INTEGER) AS b FROM documents, unnest([0, 1, 2]) AS z(u) WHERE doc_id % 3 > 0 AND (doc_id + u) % 2 = 0)",
)
def focused_read(snap: Snapshot) -> DataFrame:
    u = F.explode(F.array(*(F.lit(i) for i in range(3))))
    ids = snap.lines.select("path").distinct().withColumn("doc_id", F.substring_index("path", "/", -1).cast("long")).filter("doc_id % 3 > 0").withColumn("u", u)
    i = F.col("doc_id") * 10 + F.col("u")
    name = F.concat(F.lit("sec"), i)
    sections = ids.select("path", i.alias("id"), name.alias("name"), name.alias("qualified"), F.when((F.col("doc_id") + F.col("u")) % 2 == 0, "").otherwise("keep this").alias("docstring"), (2 + 4 * F.col("u")).alias("start_line"), (4 + 4 * F.col("u")).alias("end_line"))
    return text.collapse(snap.lines, sections, "keep")


# --- statistics and checks ---


@snapshot_query(
    """SELECT (SELECT count(*) FROM files) AS files, (SELECT max(last_indexed_at) FROM files) AS last_indexed_at, (SELECT count(*) FROM symbols) AS symbols, count(*) AS refs, count(*) FILTER (resolved) AS resolved,
    count(*) FILTER (src_symbol_id = dst_symbol_id AND resolver_version = 0) AS self_loops, count(*) FILTER (src_symbol_id = dst_symbol_id AND resolver_version >= 1) AS recursion_self_loops, count(*) FILTER (kind <> 'import') AS non_import,
    count(*) FILTER (resolver_version >= 1) AS type_resolved, count(*) FILTER (resolver_version >= 1 AND dst_symbol_id IS NULL) AS external_known, count(*) FILTER (kind <> 'import' AND resolver_version = 0 AND dst_symbol_id IS NULL) AS truly_unresolved,
    count(*) FILTER (kind = 'inherit') AS inherit_refs, count(DISTINCT src_symbol_id) FILTER (kind = 'inherit') AS concrete_types,
    round(count(*) FILTER (kind <> 'import' AND resolver_version = 0 AND dst_symbol_id IS NULL) / count(*) FILTER (kind <> 'import'), 9) AS unresolved_ratio FROM refs"""
)
def stats_totals(snap: Snapshot) -> DataFrame:
    return stats.totals(snap).withColumn("unresolved_ratio", F.round("unresolved_ratio", 9))


@snapshot_query("SELECT language, count(*) AS files FROM files GROUP BY 1")
def stats_by_language(snap: Snapshot) -> DataFrame:
    return stats.by_language(snap)


@snapshot_query("SELECT kind, count(*) AS symbols FROM symbols GROUP BY 1")
def stats_by_kind(snap: Snapshot) -> DataFrame:
    return stats.by_kind(snap)


@snapshot_query("SELECT kind, count(*) AS entries FROM docs GROUP BY 1")
def stats_documents_by_kind(snap: Snapshot) -> DataFrame:
    return stats.documents_by_kind(snap)


_LANG = "SELECT language, count(*) AS total, count(*) FILTER (resolver_version = 0 AND dst_symbol_id IS NULL) AS unresolved, round(count(*) FILTER (resolver_version = 0 AND dst_symbol_id IS NULL) / count(*), 9) AS ratio FROM refs JOIN files ON files.id = src_file_id WHERE kind <> 'import' GROUP BY 1"


@snapshot_query(_LANG)
def stats_unresolved_by_language(snap: Snapshot) -> DataFrame:
    return stats.unresolved_by_language(snap).withColumn("ratio", F.round("ratio", 9))


@snapshot_query("SELECT p.name, p.root, count(f.id) AS files FROM projects p LEFT JOIN files f ON f.project_id = p.id GROUP BY ALL")
def stats_projects(snap: Snapshot) -> DataFrame:
    return stats.files_by_project(snap)


_LEVEL = "CASE WHEN {0} >= {2} THEN 'fail' WHEN {0} >= {1} THEN 'warn' ELSE 'pass' END"


@snapshot_query(
    f"""SELECT 'corpus_present' AS name, 'pass' AS level, (SELECT count(*) FROM files)::DOUBLE AS value
    UNION ALL SELECT 'self_loop_count', {_LEVEL.format("n", 1, 20)}, n::DOUBLE FROM (SELECT count(*) AS n FROM refs WHERE src_symbol_id = dst_symbol_id AND resolver_version = 0)
    UNION ALL SELECT 'unresolved_ref_ratio', {_LEVEL.format("x", 0.25, 0.5)}, round(x, 9) FROM (SELECT sum(unresolved) / sum(total) AS x FROM lang)
    UNION ALL SELECT 'interface_expansion_coverage', 'pass', (SELECT count(*) FROM refs WHERE kind = 'inherit')::DOUBLE
    UNION ALL SELECT 'unresolved_' || language, {_LEVEL.format("ratio", 0.25, 0.5)}, ratio FROM lang
    UNION ALL SELECT 'projects_configured_but_empty', CASE WHEN n < 1 THEN 'fail' WHEN n < 10 THEN 'warn' ELSE 'pass' END, n::DOUBLE FROM (SELECT min(c) AS n FROM (SELECT count(f.id) AS c FROM projects p LEFT JOIN files f ON f.project_id = p.id GROUP BY p.id))
    UNION ALL SELECT 'documents_indexed', 'pass', 0.0::DOUBLE""",
    f"lang AS ({_LANG})",
)
def doctor_checks(snap: Snapshot) -> DataFrame:
    return stats.doctor(snap).withColumn("value", F.round("value", 9))


def _walked(snap: Snapshot) -> DataFrame:
    """A walk of the disk: every seventh file is gone, every fifth has changed, and three new ones are there."""
    seen = snap.files.filter("id % 7 <> 0").select("path", (F.col("mtime_ns") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("mtime_ns"))
    return seen.unionByName(seen.sparkSession.createDataFrame([(f"new/{i}.go", 1) for i in range(3)], "path string, mtime_ns long"))


@snapshot_query("SELECT path, CASE WHEN id % 7 = 0 THEN 'missing' WHEN id % 5 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM files UNION ALL SELECT 'new/' || i || '.go', 'unindexed' FROM range(3) t(i)")
def deep_freshness(snap: Snapshot) -> DataFrame:
    return stats.freshness(snap.files, _walked(snap))


@snapshot_query("SELECT count(*) AS checked, count(*) FILTER (id % 7 = 0 OR id % 5 = 0) AS stale, 'fail' AS level FROM files")
def freshness_level(snap: Snapshot) -> DataFrame:
    return stats.freshness_level(stats.freshness(snap.files, _walked(snap)))


@snapshot_query("SELECT id, path, id * 1000 AS mtime_ns FROM files ORDER BY md5('7/' || id), id LIMIT 200")
def sample_files(snap: Snapshot) -> DataFrame:
    return stats.sample_files(snap)


# --- verification ---


def _old(snap: Snapshot) -> DataFrame:
    """What stood before the change: the symbols of changed files, and names that only references still know."""
    s = snap.symbols.filter("file_id % 7 = 3").select(F.col("id").alias("n"), "qualified", "name", "kind", F.lit("old").alias("old_path"))
    ext = snap.refs.filter("dst_name LIKE 'ext.%'").select("dst_name", "dst_short").distinct().filter("length(dst_short) = 2")
    lost = ext.select((F.lit(-100) + F.substring("dst_short", 2, 2).cast("long")).alias("n"), F.col("dst_name").alias("qualified"), F.col("dst_short").alias("name"), F.lit("function").alias("kind"), F.lit("ext.go").alias("old_path"))
    bare = snap.symbols.sparkSession.createDataFrame([(-500, "gone.f12", "f12", "function", "g.go"), (-499, "gone.f12", "f12", "method", "h.go"), (-498, "gone.zip", "zip", "type", "g.go")], "n long, qualified string, name string, kind string, old_path string")
    return s.unionByName(lost).unionByName(bare)


def _changed(snap: Snapshot) -> DataFrame:
    return snap.files.filter("id % 7 = 3").select("id", "path")


_OLD = """removed AS (SELECT DISTINCT dst_name AS qualified, dst_short AS name, 'function' AS kind, 'ext.go' AS old_path FROM refs WHERE dst_name LIKE 'ext.%' AND length(dst_short) = 2
    UNION ALL SELECT 'gone.f12', 'f12', 'function', 'g.go' UNION ALL SELECT 'gone.zip', 'zip', 'type', 'g.go'),
dang AS (SELECT r.*, dst_name IN (SELECT qualified FROM removed) AS exact FROM refs r WHERE kind <> 'import' AND src_file_id % 7 <> 3 AND (dst_name IN (SELECT qualified FROM removed) OR (dst_short IN (SELECT name FROM removed) AND dst_symbol_id IS NULL)))"""
_DANG = "SELECT r.id, shown AS src_path, coalesce(s.qualified, '') AS src_qualified, dst_name, dst_short, r.kind, r.line, exact FROM dang r JOIN pf ON pf.id = src_file_id LEFT JOIN symbols s ON s.id = src_symbol_id"


@snapshot_query("SELECT * FROM removed", _OLD)
def verify_removed(snap: Snapshot) -> DataFrame:
    return verify.removed_symbols(_old(snap), snap.symbols)


def _dangling(snap: Snapshot) -> DataFrame:
    return verify.dangling_refs(snap, verify.removed_symbols(_old(snap), snap.symbols), _changed(snap))


@snapshot_query(_DANG + " WHERE exact", _OLD)
def verify_danglers_exact(snap: Snapshot) -> DataFrame:
    return _dangling(snap).filter("exact")


@snapshot_query(_DANG + " WHERE NOT exact", _OLD)
def verify_danglers_short(snap: Snapshot) -> DataFrame:
    return _dangling(snap).filter("NOT exact")


@snapshot_query(
    """SELECT qualified, kind, n_exact, n_short, CASE WHEN n_exact > 0 THEN 'fail' WHEN n_short > 0 THEN 'warn' ELSE 'pass' END AS level FROM (
    SELECT m.qualified, m.kind, count(d.id) FILTER (d.exact OR d.dst_name = d.dst_short) AS n_exact, count(d.id) FILTER (NOT d.exact AND d.dst_name <> d.dst_short) AS n_short
    FROM removed m LEFT JOIN dang d ON (d.exact AND d.dst_name = m.qualified) OR (NOT d.exact AND d.dst_short = m.name) GROUP BY ALL)""",
    _OLD,
)
def verify_classify(snap: Snapshot) -> DataFrame:
    return verify.classify(verify.removed_symbols(_old(snap), snap.symbols), _dangling(snap), snap.symbols.select("name"))


@snapshot_query("SELECT path, CASE WHEN id % 7 = 0 THEN 'missing' ELSE 'modified' END AS state FROM files WHERE id % 3 = 0 AND (id % 7 = 0 OR id % 5 = 0) UNION ALL SELECT 'new/1.go', 'unindexed'")
def stale_changed(snap: Snapshot) -> DataFrame:
    changed = snap.files.filter("id % 3 = 0").select("path").unionByName(snap.files.sparkSession.createDataFrame([("new/1.go",), ("new/9.txt",)], "path string"))
    return verify.stale_changed(changed, snap.files, _walked(snap).withColumn("parseable", F.lit(True)))


@snapshot_query(
    """SELECT replace(replace(shown, 'src/mod', 'tests/mod'), '.go', '_test.go') AS path, project, CAST(min(depth) AS INTEGER) AS distance FROM
    (SELECT file_id, depth FROM w JOIN symbols USING (id) WHERE depth > 0 UNION ALL SELECT id, 0 FROM files WHERE id % 7 = 3) JOIN pf ON pf.id = file_id WHERE file_id % 3 <> 1 GROUP BY ALL""",
    "first AS (SELECT id FROM symbols WHERE file_id % 7 = 3), w AS (SELECT id, 0 AS depth FROM first UNION SELECT src, depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.dst = w.id WHERE depth < 2)",
)
def select_tests(snap: Snapshot) -> DataFrame:
    path = F.replace(F.replace("path", F.lit("src/mod"), F.lit("tests/mod")), F.lit(".go"), F.lit("_test.go"))
    return verify.select_tests(snap.with_(files=snap.files.withColumn("path", path)), _changed(snap), depth=2)


# --- write path ---


@snapshot_query("SELECT id, dst_symbol_id, resolved FROM refs")
def resolve_refs(snap: Snapshot) -> DataFrame:
    return resolve.resolve_refs(snap.refs, snap.symbols).select("id", "dst_symbol_id", "resolved")


def _next(snap: Snapshot) -> DataFrame:
    f = snap.files.filter("id % 7 <> 0").select("project_id", "path", F.when(F.col("id") % 5 == 0, F.lit("x")).otherwise(F.col("content_hash")).alias("content_hash"), "parse_hash")
    return f.unionByName(snap.files.filter("id < 3").select("project_id", F.concat(F.lit("new/"), "path").alias("path"), "content_hash", "parse_hash"))


@snapshot_query("SELECT project_id, path, CASE WHEN id % 7 = 0 THEN 'delete' WHEN id % 5 = 0 THEN 'update' ELSE 'touch' END AS action FROM files UNION ALL SELECT project_id, 'new/' || path, 'insert' FROM files WHERE id < 3")
def upsert_actions(snap: Snapshot) -> DataFrame:
    return resolve.upsert_actions(snap.files, _next(snap))


@snapshot_query("SELECT id, path FROM files WHERE id % 7 <> 0")
def prune_files(snap: Snapshot) -> DataFrame:
    return resolve.prune_files(snap.files, _next(snap)).select("id", "path")


@snapshot_query("SELECT id, CASE WHEN dst_symbol_id % 4 <> 1 THEN dst_symbol_id END AS dst_symbol_id, coalesce(dst_symbol_id % 4 <> 1, false) AS resolved FROM refs")
def sync_resolved(snap: Snapshot) -> DataFrame:
    return resolve.sync_resolved(snap.refs, snap.symbols.filter("id % 4 <> 1")).select("id", "dst_symbol_id", "resolved")


# --- telemetry ---


@table_query(
    """SELECT tool, count(*) AS "count", count(*) FILTER (ok) AS ok, CAST(sum(in_bytes) AS BIGINT) AS in_bytes, CAST(sum(out_bytes) AS BIGINT) AS out_bytes, CAST(sum(CASE WHEN ok THEN out_bytes ELSE 0 END) AS BIGINT) AS out_bytes_ok, CAST(sum(dur_ms) // count(*) AS BIGINT) AS mean_ms FROM both_t GROUP BY tool""",
    "both_t AS (SELECT * FROM tele UNION ALL SELECT * REPLACE ('all' AS tool) FROM tele)",
)
def telemetry_rollup(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_rollup(star_telemetry(spark, d)).drop("p50_ms", "p95_ms")


@table_query("SELECT tool, l[len(l) // 2 + 1] AS p50_ms, l[least(len(l) - 1, len(l) * 95 // 100) + 1] AS p95_ms FROM (SELECT tool, list(dur_ms ORDER BY dur_ms) AS l FROM (SELECT tool, dur_ms FROM tele UNION ALL SELECT 'all', dur_ms FROM tele) GROUP BY tool)")
def telemetry_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_rollup(star_telemetry(spark, d)).select("tool", "p50_ms", "p95_ms")


_EXT = "ext AS (SELECT CASE WHEN tool IN ('click', 'purchase') THEN 'Bash' ELSE tool END AS tool, CASE tool WHEN 'click' THEN 'grep' WHEN 'purchase' THEN 'make' END AS detail, CASE tool WHEN 'click' THEN 'exploratory' WHEN 'purchase' THEN 'action' ELSE 'other' END AS category, in_bytes, out_bytes FROM tele)"


def _external(spark: SparkSession, d: str) -> DataFrame:
    t = star_telemetry(spark, d)
    command = F.when(F.col("tool") == "click", "A=1 /usr/bin/grep -r x").when(F.col("tool") == "purchase", "make all")
    t = t.withColumn("command", command).withColumn("tool", F.when(F.col("tool").isin("click", "purchase"), "Bash").otherwise(F.col("tool")))
    detail = F.when(F.col("tool") == "Bash", telemetry.command_word(F.col("command")))
    return t.select("tool", detail.alias("detail"), telemetry.classify_tool(F.col("tool"), F.col("command")).alias("category"), F.col("in_bytes").alias("input_size"), F.col("out_bytes").alias("output_size"))


@table_query("SELECT CASE WHEN detail IS NULL THEN tool ELSE tool || '/' || detail END AS tool, category, count(*) AS \"count\", CAST(sum(in_bytes) AS BIGINT) AS in_bytes, CAST(sum(out_bytes) AS BIGINT) AS out_bytes FROM ext GROUP BY 1, 2", _EXT)
def external_rollup(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.external_rollup(_external(spark, d))


_SESS = """logs AS (SELECT * REPLACE (CASE WHEN kind IS NULL AND n % 3 = 0 THEN NULL ELSE sid END AS sid) FROM tele),
marks AS (SELECT DISTINCT sid FROM logs WHERE kind = 'session_start'),
lasts AS (SELECT *, last_value(CASE WHEN kind = 'session_start' THEN sid END IGNORE NULLS) OVER (ORDER BY n) AS m FROM logs),
sess AS (SELECT *, CASE WHEN sid IS NULL THEN m WHEN sid IN (SELECT sid FROM marks) THEN sid ELSE '<unknown>' END AS session FROM lasts WHERE kind IS NULL AND NOT (sid IS NULL AND m IS NULL))"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    t = star_telemetry(spark, d)
    return t.withColumn("sid", F.when(F.col("kind").isNotNull() | (F.col("n") % 3 != 0), F.col("sid")))


@table_query("SELECT session, count(*) AS calls, count(DISTINCT tool) AS tools, count(*) FILTER (ok) AS ok, CAST(sum(in_bytes) AS BIGINT) AS in_bytes, CAST(sum(out_bytes) AS BIGINT) AS out_bytes, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span_s FROM sess GROUP BY 1", _SESS)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.session_rollup(_records(spark, d))


@table_query("SELECT tool, count(*) FILTER (session = 's1') AS calls_a, count(*) FILTER (session = 's2') AS calls_b, count(*) FILTER (session = 's2') - count(*) FILTER (session = 's1') AS delta FROM sess WHERE session IN ('s1', 's2') GROUP BY 1", _SESS)
def session_compare(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.session_compare(_records(spark, d), "s1", "s2")


_NAMES = {"view": "find_symbol", "click": "read_focused", "signup": "impact_analysis", "error": "ping"}
_TOOL_CASE = "CASE tool " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES.items()) + " END"


def _costs(spark: SparkSession, d: str) -> DataFrame:
    t = star_telemetry(spark, d)
    name = F.when(F.col("tool") == "view", "find_symbol").when(F.col("tool") == "click", "read_focused").when(F.col("tool") == "signup", "impact_analysis").when(F.col("tool") == "error", "ping")
    other = t.filter("tool = 'purchase'").select(F.lit("Read").alias("tool"), F.lit(None).cast("string").alias("detail"), F.lit("exploratory").alias("category"), F.col("in_bytes").alias("input_size"), F.col("out_bytes").alias("output_size"))
    return telemetry.tool_costs(telemetry.tool_rollup(t.withColumn("tool", name).filter("tool IS NOT NULL")), telemetry.external_rollup(other))


_COST = f"""mul(tool, x) AS (VALUES ('find_symbol', 0.8), ('read_focused', 4.0), ('impact_analysis', 1.5)),
own AS (SELECT {_TOOL_CASE} AS t, CAST(sum(in_bytes + out_bytes) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN ok THEN out_bytes ELSE 0 END) AS BIGINT) AS b FROM tele WHERE tool <> 'purchase' GROUP BY 1),
costs AS (SELECT t AS tool, 'own' AS source, total_bytes, CAST(floor(coalesce(CAST(b AS DOUBLE) * CAST(x AS DOUBLE), 0)) AS BIGINT) AS plain_bytes FROM own LEFT JOIN mul ON mul.tool = t
    UNION ALL SELECT 'Read', 'fallback', CAST(sum(in_bytes + out_bytes) AS BIGINT), 0 FROM tele WHERE tool = 'purchase')"""


@table_query("SELECT tool, source, total_bytes, plain_bytes, CAST(floor(total_bytes / 4.0 + 0.5) AS BIGINT) AS tokens FROM costs", _COST)
def tool_costs(spark: SparkSession, d: str) -> DataFrame:
    return _costs(spark, d).select("tool", "source", "total_bytes", "plain_bytes", "tokens")


@table_query("SELECT CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(plain_bytes) + sum(total_bytes) FILTER (source = 'fallback') AS BIGINT) AS without_bytes, CAST(sum(plain_bytes) - sum(total_bytes) FILTER (source = 'own') AS BIGINT) AS saved_bytes FROM costs", _COST)
def session_cost(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.session_cost(_costs(spark, d)).select("total_bytes", "without_bytes", "saved_bytes")


@table_query(
    """SELECT 'search_only' AS mode, CASE WHEN l / (l + f + v) > 0.7 THEN 'warn' ELSE 'ok' END AS level, round(l / (l + f + v), 9) AS metric FROM c
    UNION ALL SELECT 'read_under_used', CASE WHEN f / (f + r) < 0.15 THEN 'warn' ELSE 'ok' END, round(f / (f + r), 9) FROM c UNION ALL SELECT 'grep_over_tools', CASE WHEN (l + f + v) / g < 1.5 THEN 'warn' ELSE 'ok' END, round((l + f + v) / g, 9) FROM c""",
    "c AS (SELECT count(*) FILTER (tool = 'click') AS l, count(*) FILTER (tool = 'view') AS f, count(*) FILTER (tool = 'signup') AS v, count(*) FILTER (tool = 'purchase') AS r, count(*) FILTER (tool = 'error') AS g FROM tele)",
)
def adoption(spark: SparkSession, d: str) -> DataFrame:
    t = star_telemetry(spark, d)
    tools = t.filter("tool IN ('click', 'view', 'signup')").select(F.when(F.col("tool") == "click", "search_lexical").when(F.col("tool") == "view", "read_focused").otherwise("find_symbol").alias("tool")).groupBy("tool").count()
    fallback = t.filter("tool IN ('purchase', 'error')").select(F.when(F.col("tool") == "purchase", "Read").otherwise("Bash/grep").alias("tool")).groupBy("tool").count()
    return stats.adoption(tools, fallback, t.agg(F.count_distinct("sid").alias("n"))).withColumn("metric", F.round("metric", 9))


@table_query(
    """SELECT conv_id, CAST(greatest(count(*) FILTER (role = 'user' AND b = 'assistant'), 1) AS BIGINT) AS turns, arg_min(CASE WHEN length(text) > 300 THEN text[1:300] || '…' ELSE text END, turn) FILTER (role = 'user' AND NOT wrapped) AS first_user
    FROM (SELECT *, t = '' OR coalesce(list_bool_or(list_transform(['ide_opened_file', 'ide_selection', 'ide_diagnostics', 'system-reminder', 'command-name', 'local-command-stdout'],
            lambda g: starts_with(t, '<' || g || '>') AND ends_with(t, '</' || g || '>'))), false) AS wrapped
        FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)) GROUP BY 1"""
)
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.transcript_turns(spark.read.parquet(f"{d}/conversations.parquet"))


_CALLS = """uses AS (SELECT *, CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' WHEN 3 THEN 'mcp__lodestone__find_symbol' ELSE 'ExitPlanMode' END AS tool FROM conversations WHERE role = 'assistant'),
    raw_events AS (
        SELECT conv_id, turn, 0 AS pos, role, text, NULL AS tool, NULL AS result FROM conversations WHERE role <> 'user'
        UNION ALL SELECT conv_id, turn, 1, role, NULL, tool, NULL FROM uses
        UNION ALL SELECT conv_id, turn, 0, role, NULL, NULL, coalesce(text, '') FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 1, role, text, NULL, NULL FROM conversations WHERE role = 'user'),
    events_of AS (SELECT * FROM raw_events WHERE tool IS NOT NULL OR result IS NOT NULL OR coalesce(text, '') <> '')"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.blocks(star_transcript(spark, d))


@table_query("SELECT conv_id, tool, count(*) AS calls FROM uses GROUP BY 1, 2", _CALLS)
def transcript_tools(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.transcript_tools(_blocks(spark, d))


@table_query(
    """SELECT conv_id, count(tool) AS calls, count(*) FILTER (tool = 'Edit') AS edits, CAST(0 AS BIGINT) AS agents, count(*) FILTER (starts_with(tool, 'mcp__lodestone__')) AS own_calls,
    count(*) FILTER (tool = 'Read' OR (tool = 'Bash' AND conv_id % 2 = 0)) AS fallbacks, coalesce(bool_or(tool = 'ExitPlanMode'), false) AS plan_mode FROM raw_events GROUP BY 1""",
    _CALLS,
)
def transcript_calls(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.transcript_calls(_blocks(spark, d))


@table_query(
    """SELECT conv_id, turn AS n, pos, tool, said, after AS result FROM (
        SELECT *, last_value(CASE WHEN text IS NOT NULL AND role = 'assistant' THEN substr(text, 1, 600) || CASE WHEN length(text) > 600 THEN '…' ELSE '' END END IGNORE NULLS) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS said,
        lead(CASE WHEN result <> '' THEN substr(result, 1, 400) || CASE WHEN length(result) > 400 THEN '…' ELSE '' END END) OVER w AS after
        FROM events_of WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)) WHERE tool = 'Read' OR (tool = 'Bash' AND conv_id % 2 = 0)""",
    _CALLS,
)
def fallback_context(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.fallback_context(_blocks(spark, d)).drop("input")


# --- streams ---


def _file_events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("src/"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("removed"), F.lit(False).alias("overflow"), F.lit("all").alias("source"))


@table_query(
    """SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, arg_max(removed, (ts, seq)) AS removed FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, seq) AS b FROM
    (SELECT 'src/' || user_id AS path, ts, event_id AS seq, event_type = 'error' AS removed, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY path, b"""
)
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    return watch.debounced(_file_events(spark, d), quiet_ms=7_200_000).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@table_query(
    """SELECT 'all' AS source, s AS batch_ts, (SELECT count(*) FROM events WHERE ts >= s AND ts < s + INTERVAL 6 HOUR) AS n, (SELECT count(*) FROM events WHERE ts >= s AND ts < s + INTERVAL 6 HOUR) >= 80 AS overflow FROM starts WHERE s IS NOT NULL""",
    "starts AS (SELECT min(ts) AS s FROM events UNION ALL SELECT (SELECT min(ts) FROM events WHERE ts >= starts.s + INTERVAL 6 HOUR) FROM starts WHERE s IS NOT NULL)",
)
def coalesce_overflow(spark: SparkSession, d: str) -> DataFrame:
    return coalesce.coalesced(_file_events(spark, d), window_ms=6 * 3_600_000, limit=80).withColumn("batch_ts", F.col("batch_ts").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact(star_snapshot(spark, sf_dir))

