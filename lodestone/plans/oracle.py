"""The star-schema snapshot once more, in DuckDB's SQL, as common table expressions for the oracles."""

SNAPSHOT = """
projects AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, lower(r_name) AS name, 'services/' || lower(r_name) AS root FROM region WHERE r_regionkey > 0),
k AS (SELECT count(*) AS n FROM supplier),
files AS (SELECT s_suppkey AS id, 'src/mod' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.ts' ELSE '.py' END AS path,
    CASE s_suppkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' ELSE 'python' END AS language, s_suppkey * 37 + 100 AS size_bytes, s_suppkey % 50 + 1000 AS last_indexed_at,
    CASE WHEN n_regionkey > 0 THEN n_regionkey + 1 END AS project_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pf AS (SELECT f.*, coalesce(p.name, '') AS project, CASE WHEN p.root IS NULL THEN path ELSE p.root || '/' || path END AS shown FROM files f LEFT JOIN projects p ON p.id = f.project_id),
named AS (SELECT *, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '_' || p_partkey END AS name, CASE WHEN p_partkey >= n AND p_size % 2 = 0 THEN p_partkey - n END AS parent_id FROM part, k),
symbols AS (SELECT a.p_partkey AS id, a.p_partkey % a.n AS file_id, a.name, concat_ws('.', 'mod' || (a.p_partkey % a.n), b.name, a.name) AS qualified,
    ['function', 'method', 'type', 'interface', 'class', 'var', 'const'][a.p_size % 7 + 1] AS kind, CAST(a.p_partkey // a.n * 10 + 1 AS INTEGER) AS start_line, CAST(a.p_partkey // a.n * 10 + 9 AS INTEGER) AS end_line,
    lower(a.p_type) AS docstring, CASE WHEN a.p_partkey % 5 = 0 THEN 'private' ELSE 'public' END AS visibility, a.parent_id FROM named a LEFT JOIN named b ON a.parent_id = b.p_partkey),
items AS (SELECT *, l_orderkey * 100 + row_number() OVER w AS id, lead(l_partkey) OVER w AS dst FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
raw AS (SELECT i.id, l_partkey % n AS src_file_id, CASE WHEN i.id % 11 <> 0 THEN l_partkey END AS src_symbol_id,
    CASE WHEN i.id % 17 = 0 THEN 'ext.f' || (i.id % 50) WHEN i.id % 3 = 0 THEN s.name ELSE s.qualified END AS dst_name,
    CASE WHEN i.id % 11 = 0 THEN 'import' WHEN l_returnflag = 'A' THEN 'call' WHEN l_returnflag = 'N' THEN 'type_ref' ELSE 'inherit' END AS kind,
    CAST(i.id % 200 + 1 AS INTEGER) AS line, CASE WHEN i.id % 3 = 0 OR i.id % 11 = 0 THEN 0 ELSE 1 END AS resolver_version FROM items i JOIN symbols s ON s.id = i.dst, k),
shorted AS (SELECT *, regexp_extract(dst_name, '[^.]*$') AS dst_short FROM raw),
byq AS (SELECT qualified, min(id) AS q FROM symbols GROUP BY 1), byn AS (SELECT name, min(id) AS s FROM symbols GROUP BY 1 HAVING count(*) = 1),
refs AS (SELECT r.*, coalesce(q, s) AS dst_symbol_id, coalesce(q, s) IS NOT NULL AS resolved FROM shorted r LEFT JOIN byq ON dst_name = qualified LEFT JOIN byn ON dst_short = name AND resolver_version = 0),
docs AS (SELECT p_partkey AS id, p_partkey % n AS file_id, ['i18n_json', 'package_json_deps', 'go_mod_requires'][p_partkey % 3 + 1] AS kind, concat_ws('.', lower(p_brand), lower(p_type), p_partkey) AS key, p_name AS value, CAST(p_partkey // n + 1 AS INTEGER) AS line FROM part, k),
lines AS (SELECT 'doc/' || doc_id AS path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
edges AS (SELECT src_symbol_id AS src, dst_symbol_id AS dst, kind, src_file_id AS file_id, line FROM refs WHERE src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL),
seed AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
tele AS (SELECT event_id AS n, ts, event_type AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS in_bytes, CAST(floor(value * 100) AS BIGINT) AS out_bytes, CAST(floor(value) AS BIGINT) AS dur_ms,
    event_type <> 'error' AS ok, 's' || user_id AS sid, CASE WHEN event_type = 'signup' THEN 'session_start' END AS kind FROM events)
"""


def over(body: str, more: str = "") -> str:
    """A query over the snapshot; more: further table expressions."""
    return f"WITH RECURSIVE {SNAPSHOT}{', ' + more if more else ''} {body}"
