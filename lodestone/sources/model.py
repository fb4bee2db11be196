"""The relational model: projects, files, symbols, references, document keys."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.expr import display_path
from lodestone.plans.iterate import cut

SYMBOL_KINDS = ("function", "method", "type", "interface", "class", "var", "const")
REF_KINDS = ("call", "import", "type_ref", "inherit")
DOCUMENT_KINDS = ("i18n_json", "package_json_deps", "go_mod_requires")

PROJECTS = "id long, name string, root string, created_at long"
FILES = "id long, path string, language string, size_bytes long, mtime_ns long, content_hash string, parse_hash string, last_indexed_at long, project_id long, document_kind string"
SYMBOLS = "id long, file_id long, name string, qualified string, kind string, start_line int, start_col int, end_line int, end_col int, signature string, docstring string, visibility string, parent_id long"
REFS = "id long, src_file_id long, src_symbol_id long, dst_symbol_id long, dst_name string, dst_short string, kind string, line int, col int, resolved boolean, resolver_version int"
DOCUMENTS = "id long, file_id long, kind string, key string, value string, line int"
LINES = "path string, line int, content string"


@dataclass(frozen=True)
class Snapshot:
    """One consistent state of the index: immutable DataFrames."""

    projects: DataFrame
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    documents: DataFrame
    lines: DataFrame
    last_full_scan_at: int | None = None

    def placed_files(self, project: str | None = None, since: list[str] | None = None) -> DataFrame:
        """files with project (name, '' for none) and shown (display path), narrowed to a scope. project: none means all,
        an unknown name means no rows. since: none means all, an empty list no rows; a path counts as stored or as shown."""
        p = F.broadcast(self.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"), "root"))  # a handful of rows of configuration
        out = self.files.join(p, "project_id", "left").withColumn("shown", display_path(F.col("root"), F.col("path"))).withColumn("project", F.coalesce("project", F.lit("")))
        if project:
            out = out.filter(F.col("project") == project)
        if since is not None:
            if len(since) > 500:
                raise ValueError("too many changed paths")
            out = out.filter(F.col("path").isin(since) | F.col("shown").isin(since)) if since else out.filter(F.lit(False))
        return out

    def edges(self) -> DataFrame:
        """(src, dst, kind, file_id, line) of resolved references that have a source symbol."""
        r = self.refs.filter("src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL")
        return r.select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst"), "kind", F.col("src_file_id").alias("file_id"), "line")

    @cached_property
    def pairs(self) -> DataFrame:
        """(src, dst, n): the edges from one symbol to another as one row, computed once for the snapshot."""
        return cut(self.edges().groupBy("src", "dst").agg(F.count("*").alias("n")))

    def with_(self, **tables: DataFrame) -> Snapshot:
        return replace(self, **tables)
