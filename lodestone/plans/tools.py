"""The public read operators by name."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph, lookup, stats, text, verify
from lodestone.operators.lookup import BadParams, Matches
from lodestone.sources import tree
from lodestone.sources.extract import language_of
from lodestone.sources.model import Snapshot


class UnknownMethod(LookupError):
    code = "unknown_method"


def _verify_changes(snap: Snapshot, old: DataFrame, changed: DataFrame) -> DataFrame:
    removed = verify.removed_symbols(old, snap.symbols)
    return verify.classify(removed, verify.dangling_refs(snap, removed, changed), snap.symbols.select("name"))


def verify_git(snap: Snapshot, repo: str, since: str) -> tuple[DataFrame, DataFrame]:
    """(classified, stale): the removed symbols since the merge base with a revision, and the changed paths for which the
    index is out of date, as the working tree has them now. Only where stale has no rows is the verdict to be trusted. More
    than 500 changed paths raise ValueError."""
    spark, paths = snap.files.sparkSession, tree.changed_paths(repo, since)
    if len(paths) > 500:
        raise ValueError("too many changed paths")
    changed = spark.createDataFrame([(p,) for p in paths], "path string")
    there = [(p, tree.content_hash(repo, p), bool(language_of(p))) for p in paths]
    walked = spark.createDataFrame([x for x in there if x[1]], "path string, h string, parseable boolean").select("path", F.xxhash64("h").alias("mtime_ns"), "parseable")
    stale = verify.stale_changed(changed, snap.files.select("path", F.xxhash64("content_hash").alias("mtime_ns")), walked)
    files = snap.files.join(changed, "path", "left_semi").select("id")
    return _verify_changes(snap, tree.old_symbols(spark, repo, since, paths), files), stale


TOOLS: dict[str, Callable[..., Any]] = {
    "find_symbol": lookup.find_symbol, "get_references": lookup.get_references, "list_files": lookup.list_files, "get_file_outline": lookup.file_outline, "get_file_summary": lookup.file_summary,
    "get_neighborhood": graph.get_neighborhood, "search_lexical": text.search_lexical, "stats": stats.totals, "impact_analysis": graph.impact_analysis, "critical_path": graph.critical_path,
    "read_focused": text.read_focused, "find_document_key": lookup.find_document_key, "verify_changes": _verify_changes, "select_tests": verify.select_tests,
}


def call(snap: Snapshot, method: str, **params: Any) -> DataFrame | tuple[DataFrame, DataFrame] | Matches:
    if method not in TOOLS:
        raise UnknownMethod(f"no method {method!r}; there are {', '.join(sorted(TOOLS))}")
    known = signature(TOOLS[method]).parameters
    loose = any(p.kind is p.VAR_KEYWORD for p in known.values())
    if bad := [p for p in params if p not in known and not loose]:
        raise BadParams(f"{method} does not take {', '.join(sorted(bad))}")
    return TOOLS[method](snap, **params)
