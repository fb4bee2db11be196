"""Line search and focused reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.expr import focus_score, focus_tokens, line_pattern, right_trimmed, sqlite_like
from lodestone.operators.lookup import Matches, NotFound, one_file
from lodestone.sources.model import Snapshot

PREVIEW_LINES = 50


def search_lines(lines: DataFrame, pattern: str, path_contains: str | None = None, k: int = 50) -> Matches:
    """(path, line, content): lines that the pattern matches anywhere, right-trimmed, in order of path and line."""
    regex = line_pattern(pattern)
    hits = lines.filter(sqlite_like(F.col("path"), f"%{path_contains}%")) if path_contains else lines
    page = hits.filter(F.col("content").rlike(regex)).select("path", "line", right_trimmed(F.col("content")).alias("content"))

    def why() -> list[str]:
        if path_contains and lines.filter(sqlite_like(F.col("path"), f"%{path_contains}%")).isEmpty():
            raise NotFound(f"no indexed file has {path_contains!r} in its path")
        return [f"{pattern!r} looks like an identifier; find_symbol may serve better"] if pattern.replace("_", "a").replace(".", "a").isalnum() else []

    return Matches(page, k, ["path", "line"], why)


def search_lexical(snap: Snapshot, pattern: str, path_contains: str | None = None, project: str | None = None, k: int = 50, since: list[str] | None = None) -> Matches:
    lines = snap.lines
    if project or since is not None:
        lines = lines.join(snap.placed_files(project, since).select("path"), "path", "left_semi")
    return search_lines(lines, pattern, path_contains, k)


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (path, start_line, end_line, ...) that no earlier, wider one of the file holds."""
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("k_end", F.max("end_line").over(w)).filter("k_end IS NULL OR end_line > k_end").drop("k_end")


def collapse(lines: DataFrame, symbols: DataFrame, focus: str) -> DataFrame:
    """(path, line, content): the files with the ranges of symbols that do not fit the focus collapsed to a marker on
    their first line. symbols: path, id, name, qualified, docstring, start_line, end_line. A range that holds a fitting
    symbol stays open. Lines meet ranges by path and range, never by a bare product."""
    tokens = focus_tokens(focus)
    scored = symbols.withColumn("fits", (focus_score(tokens, F.col("name"), F.col("qualified"), F.col("docstring")) > 0) if tokens else F.lit(True))
    fit = scored.filter("fits").select(F.col("path").alias("f_path"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    shut = scored.filter("NOT fits").join(fit, (F.col("path") == F.col("f_path")) & (F.col("start_line") <= F.col("f_end")) & (F.col("f_start") <= F.col("end_line")), "left_anti")
    shut = merge_ranges(shut).select(F.col("path").alias("r_path"), "start_line", "end_line", F.col("qualified").alias("r_name"))
    hit = lines.join(shut, (F.col("path") == F.col("r_path")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")), "left")
    one = hit.groupBy("path", "line", "content").agg(F.min(F.struct("start_line", "end_line", "r_name")).alias("r"))
    marker = F.concat(F.regexp_extract("content", r"^[ \t]*", 0), F.lit("... "), F.col("r.r_name"), F.lit(" ("), (F.col("r.end_line") - F.col("r.start_line") + 1).cast("string"), F.lit(" lines)"))
    return one.filter("r.start_line IS NULL OR line = r.start_line").select("path", "line", F.when(F.col("r.start_line").isNull(), F.col("content")).otherwise(marker).alias("content"))


def preview(lines: DataFrame, n: int = PREVIEW_LINES) -> DataFrame:
    """The first lines of each file."""
    return lines.filter(F.col("line") <= n)


def read_focused(snap: Snapshot, path: str, focus: str = "") -> DataFrame:
    """The lines of one file: without a focus the first ones, else all, collapsed."""
    f = one_file(snap, path).select(F.col("id").alias("file_id"), "path")
    lines = snap.lines.join(f.select("path"), "path", "left_semi")
    if not focus:
        return preview(lines).orderBy("line")
    return collapse(lines, snap.symbols.join(f, "file_id").select("path", "id", "name", "qualified", "docstring", "start_line", "end_line"), focus).orderBy("line")


def byte_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum(F.octet_length("content") + 1), F.lit(0))
    return before.agg(size.alias("full_bytes")).crossJoin(F.broadcast(after.agg(size.alias("shown_bytes"))))  # one row each
