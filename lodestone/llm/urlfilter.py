"""URL filters by temporal list join: dated list entries become validity intervals, and an as-of join evaluates every
capture against the entries that were active when it was fetched.

An entry's pattern is a host or a parent domain, or a host with leading path segments. The last entry of a pattern at
or before a moment is the active one; of the active patterns that fit a capture the longest decides.
Candidates of a capture go down to the list's deepest entry.

Null url or fetch time: no pattern fits, allowed. Entries with a null pattern, action or date are ignored; entries of
one pattern and date: "allow" comes last and so holds. Repeated captures are evaluated each. Without entries all is
allowed; without captures the result is empty. Other columns of captures and entries are not read. The list is broadcast if it has at most ``broadcast_rows`` entries;
a longer one is joined by shuffle, with the captures of a pattern salted over ``salts`` parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the query's list: pattern, action, day listed.
ENTRIES = [
    ("example.org", "block", "2024-03-01"), ("example.org", "allow", "2024-06-15"), ("example.org", "block", "2024-10-01"),
    ("tionsh.example.net", "block", "2024-02-01"), ("tionsh.example.net/en", "allow", "2024-04-01"), ("tionsh.example.net/en", "block", "2024-09-01"),
    ("blog.tionble.example.com", "block", "2024-01-15"), ("blog.tionble.example.com", "allow", "2024-08-01"), ("tiontion.example.com", "block", "2024-05-05"),
    ("example.net", "allow", "2024-01-01"), ("example.com", "block", "2024-12-01"), ("m.thther.example.org/de", "allow", "2024-03-15"),
]
BROADCAST_ROWS, SALTS = 100_000, 16


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, from (inclusive) and until (exclusive, null: open)."""
    known = entries.select(F.lower("pattern").alias("pattern"), "action", F.col("listed_on").cast("date").alias("listed_on")).dropna()
    known = known.groupBy("pattern", "listed_on").agg(F.min("action").alias("action"))  # "allow" before "block"
    order = Window.partitionBy("pattern").orderBy("listed_on")
    return known.select("pattern", "action", F.col("listed_on").alias("from"), F.lead("listed_on").over(order).alias("until"))


def patterns(url: Column, depth: int) -> Column:
    """All patterns that fit the url: its host, the host's parent domains, and the host with up to depth leading path segments."""
    host, path = F.lower(F.regexp_extract(url, _HOST, 1)), F.regexp_extract(url, _PATH, 1)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.slice(F.filter(F.split(F.lower(path), "/"), lambda s: s != ""), 1, depth)
    deeper = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(parents, deeper)).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """captures(page_id, url, fetched_on) with pattern (null: none fits), listed_on and blocked."""
    valid = intervals(entries)
    # no entry has more segments than the deepest of the list, so deeper candidates cannot fit
    depth = entries.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit(""))))).first()[0] or 0
    rows = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on")).withColumn("row", F.monotonically_increasing_id())
    keys = rows.withColumn("pattern", F.explode_outer(patterns(F.col("url"), depth)))
    on = ["pattern"]
    if valid.limit(broadcast_rows + 1).count() <= broadcast_rows:
        valid = F.broadcast(valid)
    else:
        keys = keys.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
        valid, on = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["pattern", "salt"]
    k, v = keys.alias("k"), valid.alias("v")
    fits = [F.col(f"k.{c}") == F.col(f"v.{c}") for c in on]
    joined = k.join(v, [*fits, F.col("v.from") <= F.col("k.fetched_on"), F.col("v.until").isNull() | (F.col("k.fetched_on") < F.col("v.until"))], "left")
    hit = F.when(F.col("v.action").isNotNull(), F.struct(F.length("v.pattern").alias("size"), F.col("v.pattern").alias("pattern"), F.col("v.from").alias("listed_on"), F.col("v.action").alias("action")))
    best = joined.groupBy("k.row", "k.page_id", "k.url", "k.fetched_on").agg(F.max(hit).alias("hit"))
    return best.select("page_id", "url", "fetched_on", F.col("hit.pattern").alias("pattern"), F.col("hit.listed_on").alias("listed_on"), F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"))


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)"


def listed(pages: DataFrame) -> DataFrame:
    """The query's list: the fixed entries, and one for about every eighth page: its host with up to three of its path segments,
    with action and day from a digest of the url."""
    digit = lambda i: F.ascii(F.substring(F.md5("url"), i, 1))
    host, parts = F.lower(F.regexp_extract("url", _HOST, 1)), F.filter(F.split(F.lower(F.regexp_extract("url", _PATH, 1)), "/"), lambda s: s != "")
    own = pages.filter((F.substring(F.md5("url"), 1, 1) < "2") & (host != "")).select(
        F.array_join(F.concat(F.array(host), F.slice(parts, F.lit(1), digit(2) % 4)), "/").alias("pattern"),
        F.when(digit(3) % 2 == 0, "allow").otherwise("block").alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), (digit(4) * 31 + digit(5)) % 365).cast("string").alias("listed_on"),
    )
    return pages.sparkSession.createDataFrame(ENTRIES, "pattern string, action string, listed_on string").unionByName(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time of their own: page_id modulo 365 days after 2024-01-01 stands for it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id, 365) AS int))").alias("fetched_on"))
    out = evaluate(pages, listed(pages))
    return out.select("page_id", "url", F.col("fetched_on").cast("string").alias("fetched_on"), "pattern", F.col("listed_on").cast("string").alias("listed_on"), "blocked")


def sql() -> str:
    rows = ", ".join(f"('{p}', '{a}', DATE '{d}')" for p, a, d in ENTRIES)
    return f"""
WITH fixed(pattern, action, day) AS (VALUES {rows}),
urls AS (SELECT md5(url) AS m, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)), '/'), lambda x: x <> '') AS parts FROM pages WHERE url IS NOT NULL),
own AS (SELECT array_to_string(list_concat([host], parts[1:ascii(m[2]) % 4]), '/') AS pattern, CASE WHEN ascii(m[3]) % 2 = 0 THEN 'allow' ELSE 'block' END AS action,
    DATE '2024-01-01' + (ascii(m[4]) * 31 + ascii(m[5])) % 365 AS day FROM urls WHERE m[1] < '2' AND host <> ''),
e AS (SELECT pattern, min(action) AS action, day FROM (SELECT * FROM fixed UNION ALL SELECT * FROM own) GROUP BY pattern, day),
v AS (SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM e),
p AS (SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS t,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)) AS path FROM pages),
hits AS (SELECT r, v.pattern, day, action, row_number() OVER (PARTITION BY r ORDER BY length(v.pattern) DESC) AS k FROM p JOIN v
    ON day <= t AND (until IS NULL OR t < until)
    AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND (host || '/' || path = pattern OR starts_with(host || '/' || path, pattern || '/')))))
SELECT page_id, url, CAST(t AS VARCHAR) AS fetched_on, pattern, CAST(day AS VARCHAR) AS listed_on, coalesce(action = 'block', false) AS blocked
FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (r)"""
