"""Index statistics, health checks, adoption and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.expr import safe_ratio
from lodestone.sources.model import Snapshot

#: Warn and fail thresholds of the health checks.
UNRESOLVED = (0.25, 0.50)
SELF_LOOPS = (1, 20)
EMPTY_PROJECT = (10, 1)
FRESHNESS = (2, 0.01, 0.10)
#: Adoption thresholds (sessions, search share, read share, ratio to grep) and the tools they look at.
MIN_SESSIONS, SEARCH_SHARE, READ_SHARE, GREP_RATIO = 3, 0.70, 0.15, 1.5
GREPS = ("Bash/grep", "Bash/rg", "Bash/ripgrep")


def totals(snap: Snapshot) -> DataFrame:
    """One row of counters; each table is read once, with conditional counts."""
    n = lambda c: F.count_if(F.expr(c))
    refs = snap.refs.agg(
        F.count("*").alias("refs"), n("resolved").alias("resolved"), n("src_symbol_id = dst_symbol_id AND resolver_version = 0").alias("self_loops"), n("src_symbol_id = dst_symbol_id AND resolver_version >= 1").alias("recursion_self_loops"),
        n("kind <> 'import'").alias("non_import"), n("resolver_version >= 1").alias("type_resolved"), n("resolver_version >= 1 AND dst_symbol_id IS NULL").alias("external_known"),
        n("kind <> 'import' AND resolver_version = 0 AND dst_symbol_id IS NULL").alias("truly_unresolved"), n("kind = 'inherit'").alias("inherit_refs"), F.count_distinct(F.when(F.col("kind") == "inherit", F.col("src_symbol_id"))).alias("concrete_types"),
    )
    files = snap.files.agg(F.count("*").alias("files"), F.max("last_indexed_at").alias("last_indexed_at"))
    symbols = snap.symbols.agg(F.count("*").alias("symbols"))
    out = refs.crossJoin(F.broadcast(files)).crossJoin(F.broadcast(symbols))  # one row each
    return out.withColumn("unresolved_ratio", safe_ratio(F.col("truly_unresolved"), F.col("non_import")))


def by_language(snap: Snapshot) -> DataFrame:
    return snap.files.groupBy("language").agg(F.count("*").alias("files"))


def by_kind(snap: Snapshot) -> DataFrame:
    return snap.symbols.groupBy("kind").agg(F.count("*").alias("symbols"))


def documents_by_kind(snap: Snapshot) -> DataFrame:
    return snap.documents.groupBy("kind").agg(F.count("*").alias("entries"))


def unresolved_by_language(snap: Snapshot) -> DataFrame:
    """language, total non-import references, truly unresolved ones and their ratio."""
    r = snap.refs.filter("kind <> 'import'").join(snap.files.select(F.col("id").alias("src_file_id"), "language"), "src_file_id")
    out = r.groupBy("language").agg(F.count("*").alias("total"), F.count_if(F.expr("resolver_version = 0 AND dst_symbol_id IS NULL")).alias("unresolved"))
    return out.withColumn("ratio", safe_ratio(F.col("unresolved"), F.col("total")))


def files_by_project(snap: Snapshot) -> DataFrame:
    """Every project, also those without files."""
    f = snap.files.groupBy("project_id").agg(F.count("*").alias("n"))
    return snap.projects.join(f, snap.projects["id"] == f["project_id"], "left").select("name", "root", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def files_without_entries(snap: Snapshot) -> DataFrame:
    return snap.files.filter("document_kind IS NOT NULL").join(snap.documents.select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path")


def graded(value, warn: float, fail: float):
    return F.when(value >= fail, "fail").when(value >= warn, "warn").otherwise("pass")


def doctor(snap: Snapshot) -> DataFrame:
    """(name, level, value) of the checks on the data; with no files at all only the first, failed."""
    t = totals(snap)
    row = lambda name, level, value: F.struct(F.lit(name).alias("name"), level.alias("level"), value.cast("double").alias("value"))
    checks = F.array(
        row("corpus_present", F.when(F.col("files") > 0, "pass").otherwise("fail"), F.col("files")),
        row("self_loop_count", graded(F.col("self_loops"), *SELF_LOOPS), F.col("self_loops")),
        row("unresolved_ref_ratio", graded(F.col("unresolved_ratio"), *UNRESOLVED), F.col("unresolved_ratio")),
        row("interface_expansion_coverage", F.lit("pass"), F.col("inherit_refs")),
    )
    out = t.select(F.explode(F.when(F.col("files") > 0, checks).otherwise(F.slice(checks, 1, 1))).alias("c")).select("c.*")
    lang = unresolved_by_language(snap).select(F.concat(F.lit("unresolved_"), "language").alias("name"), graded(F.col("ratio"), *UNRESOLVED).alias("level"), F.col("ratio").alias("value"))
    worst = files_by_project(snap).agg(F.min("files").alias("least")).filter("least IS NOT NULL")
    empty = worst.select(F.lit("projects_configured_but_empty").alias("name"), F.when(F.col("least") < EMPTY_PROJECT[1], "fail").when(F.col("least") < EMPTY_PROJECT[0], "warn").otherwise("pass").alias("level"), F.col("least").cast("double").alias("value"))
    gaps = files_without_entries(snap).agg(F.count("*").alias("n"))
    docs = gaps.select(F.lit("documents_indexed").alias("name"), F.when(F.col("n") > 0, "warn").otherwise("pass").alias("level"), F.col("n").cast("double").alias("value"))
    return out.unionByName(lang).unionByName(empty).unionByName(docs)


def freshness(indexed: DataFrame, walked: DataFrame) -> DataFrame:
    """(path, state) of every path on either side: fresh, stale (times differ), missing on disk, unindexed."""
    i, w = indexed.select("path", F.col("mtime_ns").alias("i_time")), walked.select("path", F.col("mtime_ns").alias("w_time"))
    state = F.when(F.col("w_time").isNull(), "missing").when(F.col("i_time").isNull(), "unindexed").when(F.col("w_time") != F.col("i_time"), "stale").otherwise("fresh")
    return i.join(w, "path", "full_outer").select("path", state.alias("state"))


def freshness_level(states: DataFrame) -> DataFrame:
    """One row: checked, stale, level."""
    s = states.filter("state <> 'unindexed'").agg(F.count("*").alias("checked"), F.count_if(F.col("state") != "fresh").alias("stale"))
    ratio = safe_ratio(F.col("stale"), F.col("checked"))
    return s.withColumn("level", F.when(ratio >= FRESHNESS[2], "fail").when((F.col("stale") >= FRESHNESS[0]) | (ratio >= FRESHNESS[1]), "warn").otherwise("pass"))


def sample_files(snap: Snapshot, n: int = 200, seed: int = 7) -> DataFrame:
    """n files in an order drawn by the seed: by a digest of it and the id, so a repeated task draws the same."""
    return snap.files.select("id", "path", "mtime_ns").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "id")), "id").limit(n)


def probe(candidates: DataFrame, include: list[str], exclude: list[str], max_kb: int) -> DataFrame:
    """(path, reason): why a path is not in the index, the first that fits. candidates: path, on_disk, size_kb, mtime_ns,
    indexed_mtime_ns. include and exclude: regular expressions."""
    hit = lambda rx: F.col("path").rlike("|".join(f"(?:{r})" for r in rx)) if rx else F.lit(False)
    reason = F.when(~F.col("on_disk"), "missing").when(hit(exclude), "excluded").when(~hit(include), "not_included").when(F.col("size_kb") > max_kb, "oversize")
    return candidates.select("path", reason.when(F.col("mtime_ns") != F.col("indexed_mtime_ns"), "stale").alias("reason"))


def adoption(tools: DataFrame, fallback: DataFrame, sessions: DataFrame) -> DataFrame:
    """(mode, level, metric): shares of search and reading and the ratio to grep. tools and fallback: (tool, count);
    sessions: one row n. A mode without calls to divide by gives no row; too few sessions give one row of their own."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    t = tools.filter("tool <> 'all'").agg(total(F.lit(True)).alias("own"), total(F.col("tool") == "search_lexical").alias("lexical"), total(F.col("tool") == "read_focused").alias("focused"))
    f = fallback.agg(total(F.col("tool") == "Read").alias("reads"), total(F.col("tool").isin(*GREPS)).alias("greps"))
    row = lambda mode, n, d, bad: F.struct(F.lit(mode).alias("mode"), F.when(bad, "warn").otherwise("ok").alias("level"), safe_ratio(n, d).alias("metric"), (d > 0).alias("known"))
    own, lexical, focused, reads, greps = (F.col(c) for c in ("own", "lexical", "focused", "reads", "greps"))
    checks = F.array(
        row("search_only", lexical, own, safe_ratio(lexical, own) > SEARCH_SHARE), row("read_under_used", focused, focused + reads, safe_ratio(focused, focused + reads) < READ_SHARE), row("grep_over_tools", own, greps, safe_ratio(own, greps) < GREP_RATIO)
    )
    few = F.array(F.struct(F.lit("insufficient_data").alias("mode"), F.lit("info").alias("level"), F.col("n").cast("double").alias("metric"), F.lit(True).alias("known")))
    all_rows = t.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(sessions.select("n")))  # one row each
    return all_rows.select(F.explode(F.when(F.col("n") < MIN_SESSIONS, few).otherwise(checks)).alias("c")).select("c.*").filter("known").drop("known")


def calibration(measured: DataFrame, model: DataFrame) -> DataFrame:
    """measured: tool, own_bytes, fallback_bytes; model: tool, multiplier, quality. drift is relative to the model's value
    (0.01 at least); beyond a quarter it warns, except at low quality."""
    r = measured.join(model, "tool").withColumn("measured", safe_ratio(F.col("fallback_bytes"), F.col("own_bytes")))
    drift = F.abs(F.col("measured") - F.col("multiplier")) / F.greatest(F.col("multiplier"), F.lit(0.01))
    return r.withColumn("drift", drift).withColumn("level", F.when((F.col("quality") == "low") | (F.col("drift") <= 0.25), "ok").otherwise("warn"))
