"""Ranked lookups: symbols, references, files, outlines, summaries, document keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.expr import ascii_lower, focus_score, focus_tokens, parent_name, rank_bucket, sqlite_like
from lodestone.sources.model import Snapshot


class NotFound(LookupError):
    code = "not_found"


class BadParams(ValueError):
    code = "bad_params"


@dataclass
class Matches:
    """rows: the capped result in order. hints(): computed only when asked for."""

    page: DataFrame
    limit: int
    order: list
    why_empty: Callable[[], list[str]] = field(default=list)

    @property
    def rows(self) -> DataFrame:
        return self.page.orderBy(*self.order).limit(self.limit)

    def hints(self) -> list[str]:
        n = self.page.orderBy(*self.order).limit(self.limit + 1).count()
        return [f"more than {self.limit} matches; narrow the query or raise the limit"] if n > self.limit else [] if n else self.why_empty()


def find_symbol(snap: Snapshot, name: str, kind: str | None = None, project: str | None = None, limit: int = 20, since: list[str] | None = None, focus: str = "") -> Matches:
    s = snap.symbols.filter(sqlite_like(F.col("name"), f"%{name}%") | sqlite_like(F.col("qualified"), f"%{name}%"))
    if kind:
        s = s.filter(F.col("kind") == kind)
    files = snap.placed_files(project, since).select(F.col("id").alias("file_id"), "shown", "project")
    rank = F.lit(0) if kind else rank_bucket(F.col("name"), name)
    page = s.join(files, "file_id").select(F.col("id"), "name", "qualified", "kind", F.col("shown").alias("path"), "project", "start_line", "end_line", "docstring", rank.alias("rank"))
    order = ["rank", F.length("qualified"), "id"]

    def why() -> list[str]:
        out = []
        if project and snap.projects.filter(F.col("name") == project).isEmpty():
            out.append(f"unknown project {project!r}")
        if kind:
            kinds = sorted(r[0] for r in snap.symbols.filter((F.col("name") == name) | (F.col("qualified") == name)).select("kind").distinct().collect())
            if kinds:
                out.append(f"{name!r} exists as {', '.join(kinds)}")
            elif snap.symbols.filter(F.col("kind") == kind).isEmpty():
                out.append(f"no symbol has kind {kind!r}")
        if snap.last_full_scan_at is None:
            out.append("the index was never reconciled in full")
        return out

    if not focus:
        return Matches(page, limit, order, why)
    # the focus narrows and re-ranks the page, after its limit
    tokens = focus_tokens(focus)
    page = page.orderBy(*order).limit(limit).withColumn("score", focus_score(tokens, F.col("name"), F.col("qualified"), F.col("docstring")))
    return Matches(page.filter("score > 0") if tokens else page, limit, [F.desc("score"), *order], why)


def _above(low: F.Column) -> F.Column:
    """All beginnings of a name that a dot follows."""
    parts = F.split(low, r"\.")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "."))


def below(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of symbols whose qualified name is LIKE root.%, with ASCII case folding and live wildcards: by equality, no root
    is held against all symbols. An underscore stands for any one character, so a beginning of a name is looked up once for
    each pattern of underscores that roots of its length have, with these places blanked. Roots with a percent sign are looked up by
    what stands before the last dot ahead of their first wildcard."""
    low = symbols.select("id", ascii_lower(F.col("qualified")).alias("low"))
    roots = roots.select(ascii_lower(F.col("root")).alias("root")).distinct()
    plain, percent = roots.filter(F.instr("root", "%") == 0), roots.filter(F.instr("root", "%") > 0)
    sizes = F.transform(F.split("root", "_"), lambda part: F.length(part))
    masks = plain.select(F.length("root").alias("size"), sizes.alias("sizes")).distinct()
    starts = F.transform("sizes", lambda n, i: F.aggregate(F.slice("sizes", 1, i), i + 1, lambda a, b: a + b))
    masks = masks.withColumn("spots", F.arrays_zip(starts.alias("at"), F.col("sizes").alias("n"))).drop("sizes")
    names = low.select("id", F.explode(_above(F.col("low"))).alias("name"))
    blanked = names.join(masks, F.length("name") == F.col("size")).select("id", F.array_join(F.transform("spots", lambda s: F.substring(F.col("name"), s["at"], s["n"])), "_").alias("root"))
    head = parent_name(F.regexp_extract("root", "^[^%_]*", 0))
    wild = percent.select(head.alias("head"), F.concat(F.replace("root", F.lit("\\"), F.lit("\\\\")), F.lit(".%")).alias("pattern"))
    heads = low.select("id", "low", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), _above(F.col("low"))))).alias("head"))
    return blanked.join(plain, "root", "left_semi").select("id").unionByName(heads.join(wild, "head").filter(F.like("low", F.col("pattern"))).select("id")).distinct()


def target_ids(snap: Snapshot, target: str) -> DataFrame:
    """Symbols named so, by qualified or short name, and all below those."""
    named = snap.symbols.filter((F.col("qualified") == target) | (F.col("name") == target))
    return named.select("id").unionByName(below(snap.symbols, named.select(F.col("qualified").alias("root")))).distinct()


def get_references(snap: Snapshot, target: str, limit: int = 100, project: str | None = None, since: list[str] | None = None) -> Matches:
    ids = target_ids(snap, target)
    files = snap.placed_files(project, since).select(F.col("id").alias("src_file_id"), F.col("shown").alias("path"), "project")
    # one pass over the references: to a target, by name only, or both
    hit = F.when(F.col("hit"), 0)
    loose = F.when(~F.col("resolved") & ((F.col("dst_name") == target) | (F.col("dst_short") == target)), 1)
    found = snap.refs.join(ids.select(F.col("id").alias("dst_symbol_id"), F.lit(True).alias("hit")), "dst_symbol_id", "left").filter(hit.isNotNull() | loose.isNotNull())
    found = found.withColumn("branch", F.explode(F.array_compact(F.array(hit, loose))))
    names = snap.symbols.select(F.col("id").alias("src_symbol_id"), F.col("qualified").alias("src"))
    page = found.join(files, "src_file_id").join(names, "src_symbol_id", "left")
    page = page.select("id", "branch", "path", "project", "line", F.coalesce("src", F.lit("")).alias("src"), "dst_name", "kind", "resolved")

    def why() -> list[str]:
        if project or since is not None:
            return []
        return [f"{target!r} is in the index, but nothing refers to it"] if not ids.isEmpty() else [f"unknown symbol {target!r}"]

    return Matches(page, limit, ["branch", "path", "line", "id"], why)


def list_files(snap: Snapshot, language: str | None = None, name_contains: str | None = None, project: str | None = None, limit: int = 500, since: list[str] | None = None) -> Matches:
    files = snap.placed_files(project, since)
    if language:
        files = files.filter(F.col("language") == language)
    if name_contains:
        files = files.filter(sqlite_like(F.col("path"), f"%{name_contains}%"))
    count = snap.symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    page = files.join(count, files["id"] == count["file_id"], "left")
    return Matches(page.select("id", F.col("shown").alias("path"), "project", "language", "size_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("symbol_count")), limit, ["path", "id"])


def suggest_paths(snap: Snapshot, path: str) -> DataFrame:
    base = path.rsplit("/", 1)[-1]
    return snap.placed_files().filter((F.col("path") == base) | sqlite_like(F.col("path"), f"%/{base}")).select(F.col("shown").alias("path")).orderBy("path").limit(3)


def one_file(snap: Snapshot, path: str) -> DataFrame:
    """The file stored or shown under the path; NotFound with suggestions otherwise."""
    f = snap.placed_files().filter((F.col("path") == path) | (F.col("shown") == path))
    if f.isEmpty():
        near = [r[0] for r in suggest_paths(snap, path).collect()]
        raise NotFound(f"{path} is not indexed" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return f.orderBy("id").limit(1)


def file_outline(snap: Snapshot, path: str, focus: str = "") -> DataFrame:
    """Symbols without a parent, in order of place, each with its direct children; deeper levels are not shown."""
    f = one_file(snap, path).select(F.col("id").alias("file_id"))
    s = snap.symbols.join(f, "file_id", "left_semi")
    item = F.struct("start_line", "id", "name", "qualified", "kind", "end_line", "docstring")
    kids = s.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_sort(F.collect_list(item)).alias("children"))
    tops = s.filter("parent_id IS NULL").join(kids.withColumnRenamed("parent_id", "p"), F.col("id") == F.col("p"), "left")
    out = tops.select("id", "name", "qualified", "kind", "start_line", "end_line", "docstring", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)).alias("children"))
    if tokens := focus_tokens(focus):
        score = lambda x: focus_score(tokens, x["name"], x["qualified"], x["docstring"])
        out = out.withColumn("kept", F.filter("children", lambda c: score(c) > 0)).filter((F.size("kept") > 0) | (focus_score(tokens, F.col("name"), F.col("qualified"), F.col("docstring")) > 0))
        out = out.withColumn("children", F.col("kept")).drop("kept")
    return out.orderBy("start_line", "id")


def file_summary(snap: Snapshot, path: str) -> DataFrame:
    """One row: language, loc, kinds (map), exports and imports (sorted)."""
    f = one_file(snap, path).select(F.col("id").alias("file_id"), F.col("shown").alias("path"), "language")
    s = snap.symbols.join(f, "file_id", "left_semi")
    kinds = s.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("kinds"))
    whole = s.agg(F.coalesce(F.max("end_line"), F.lit(0)).alias("loc"), F.array_sort(F.collect_list(F.when((F.col("visibility") == "public") & F.col("parent_id").isNull(), F.col("name")))).alias("exports"))
    imports = snap.refs.filter("kind = 'import'").join(f.select(F.col("file_id").alias("src_file_id")), "src_file_id", "left_semi").agg(F.array_sort(F.collect_set("dst_name")).alias("imports"))
    return f.drop("file_id").crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(imports))  # one row each


def find_document_key(snap: Snapshot, key: str, kind: str | None = None, project: str | None = None, limit: int = 50) -> Matches:
    d = snap.documents.filter(sqlite_like(F.col("key"), f"%{key}%"))
    if kind:
        d = d.filter(F.col("kind") == kind)
    files = snap.placed_files(project).select(F.col("id").alias("file_id"), F.col("shown").alias("path"), "project")
    page = d.join(files, "file_id").select("id", "key", "value", "kind", "path", "project", "line", rank_bucket(F.col("key"), key).alias("rank"))
    return Matches(page, limit, ["rank", F.length("key"), "key", "id"])


def package_refs(snap: Snapshot, folder: str, limit: int = 20) -> DataFrame:
    """(direction, package, n): references, but imports, from other folders to symbols right in this one and from its files to
    others, up to limit folders each way. Sub-folders are folders of their own."""
    d = snap.placed_files().select("id", F.when(F.instr("shown", "/") == 0, ".").otherwise(F.regexp_replace("shown", "/[^/]*$", "")).alias("dir"))
    home = snap.symbols.join(d.withColumnRenamed("id", "file_id"), "file_id").select(F.col("id").alias("dst"), F.col("dir").alias("dst_dir"))
    e = snap.refs.filter("kind <> 'import' AND dst_symbol_id IS NOT NULL").select(F.col("src_file_id").alias("id"), F.col("dst_symbol_id").alias("dst")).join(d, "id").join(home, "dst")

    def side(direction: str, here: str, there: str) -> DataFrame:
        rows = e.filter((F.col(here) == folder) & (F.col(there) != folder)).groupBy(F.col(there).alias("package")).agg(F.count("*").alias("n"))
        return rows.select(F.lit(direction).alias("direction"), "package", "n").orderBy(F.desc("n"), "package").limit(limit)

    return side("in", "dst_dir", "dir").unionByName(side("out", "dir", "dst_dir"))
