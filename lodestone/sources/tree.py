"""Source trees: the walk, the snapshot of a tree, and what git says about changes."""

from __future__ import annotations

import hashlib
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.expr import glob_to_regex, short_name
from lodestone.operators.resolve import resolve_imports, resolve_refs, wire_parents
from lodestone.plans.iterate import cut
from lodestone.sources.extract import document_kind, extract, language_of, parse_hash
from lodestone.sources.model import PROJECTS, Snapshot

SKIPPED = (".git", ".lodestone")
BINARY = "path string, modificationTime timestamp, length long, content binary"


def find_root(start: str, marker: str = ".git") -> str | None:
    at = Path(start).resolve()
    return next((str(p) for p in (at, *at.parents) if (p / marker).exists()), None)


def walk(spark: SparkSession, root: str, include: list[str], exclude: list[str], max_kb: int = 1024, only: list[str] | None = None) -> DataFrame:
    """(path, size_bytes, mtime_ns, content, content_hash) of the files below root that the globs let through. only: a few
    paths that exist, read without a walk."""
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    every = reader.load(base) if only is None else reader.load([f"{base}/{p}" for p in only]) if only else spark.createDataFrame([], BINARY)
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    hit = lambda globs: F.col("path").rlike("|".join(glob_to_regex(g) for g in globs)) if globs else F.lit(False)
    out = every.select(path.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    out = out.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in SKIPPED)))).filter(hit(include) & ~hit(exclude) & (F.col("size_bytes") <= max_kb * 1024))
    return out.select("path", "size_bytes", "mtime_ns", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def snapshot(spark: SparkSession, files: DataFrame, now: int) -> Snapshot:
    """The index of walked files, parsed once."""
    return assemble(spark, files.withColumn("last_indexed_at", F.lit(now).cast("long")), cut(extract(files)), lines_of(files), now)


def assemble(spark: SparkSession, files: DataFrame, rows: DataFrame, lines: DataFrame, scanned: int | None) -> Snapshot:
    """The index of files (path, size_bytes, mtime_ns, content_hash, last_indexed_at) from what they yield. Ids are hashes
    of what they name, so they are the same after every rebuild."""
    language, kind = F.udf(language_of, "string"), F.udf(document_kind, "string")
    language, kind = language(F.col("path")), kind(F.col("path"))  # once for each file, beside its parse
    placed = files.join(parse_hash(rows), "path", "left").select(
        F.xxhash64("path").alias("id"), "path", language.alias("language"), "size_bytes", "mtime_ns", "content_hash", "parse_hash", "last_indexed_at", F.lit(None).cast("long").alias("project_id"), F.when(language == "", kind).alias("document_kind")
    )
    s = rows.filter("what = 'symbol'").select(F.xxhash64("path", "qualified", "start_line", "start_col").alias("id"), F.xxhash64("path").alias("file_id"), "name", "qualified", "kind", "start_line", "start_col", "end_line", "end_col", "signature", "docstring", "visibility", F.lit(None).cast("long").alias("parent_id"))
    symbols = wire_parents(s)
    calls = rows.filter("what = 'ref'").withColumn("module", F.regexp_replace(F.substring_index("path", "/", -1), r"(\.d\.ts|\.[^.]*)$", "")).withColumn("enclosing_class", F.when(F.size(F.split("src", r"\.")) > 2, F.get(F.split("src", r"\."), 1)))
    imports = rows.filter("what = 'ref' AND kind = 'import' AND path NOT LIKE '%.go'").select(F.col("path").alias("file"), short_name(F.regexp_replace("dst", "^.*/", "")).alias("local"), short_name(F.regexp_replace("dst", "^.*/", "")).alias("module"), F.lit(None).cast("string").alias("remote"))
    methods = symbols.filter("kind = 'method'").select(F.get(F.split("qualified", r"\."), 0).alias("module"), F.get(F.split("qualified", r"\."), 1).alias("class"), F.col("name").alias("method"))
    scoped = resolve_imports(calls.select(F.col("path").alias("file"), "module", "enclosing_class", F.col("dst").alias("dst_name"), "src", "kind", "line", "col"), imports, methods)
    name = F.when((F.col("kind") == "import") | F.col("file").endswith(".go"), F.col("dst_name")).otherwise(F.col("resolved_name"))
    first = symbols.groupBy("file_id", "qualified").agg(F.max("id").alias("src_symbol_id"))
    r = scoped.select(F.xxhash64("file", "src", "dst_name", "line", "col", "kind").alias("id"), F.xxhash64("file").alias("src_file_id"), "src", name.alias("dst_name"), short_name(name).alias("dst_short"), "kind", "line", "col", F.lit(0).alias("resolver_version"))
    r = r.join(first, (r["src_file_id"] == first["file_id"]) & (r["src"] == first["qualified"]), "left").select("id", "src_file_id", "src_symbol_id", F.lit(None).cast("long").alias("dst_symbol_id"), "dst_name", "dst_short", "kind", "line", "col", F.lit(False).alias("resolved"), "resolver_version")
    documents = rows.filter("what = 'key'").select(F.xxhash64("path", "key").alias("id"), F.xxhash64("path").alias("file_id"), "kind", "key", "value", "line")
    return Snapshot(spark.createDataFrame([], PROJECTS), placed, symbols, resolve_refs(r, symbols), documents, lines, scanned)


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def content_hash(repo: str, path: str) -> str | None:
    """The digest of a file in the working tree, as the walk has it; none if it is not there."""
    at = Path(repo, path)
    return hashlib.sha256(at.read_bytes()).hexdigest() if at.is_file() else None


def merge_base(repo: str, since: str) -> str:
    return _git(repo, "merge-base", since, "HEAD").strip()


def changed_paths(repo: str, since: str) -> list[str]:
    """Paths that differ between the merge base with a revision and the working tree, renames as two paths."""
    return sorted({x for x in _git(repo, "diff", "--name-only", "--no-renames", merge_base(repo, since)).splitlines() if x})


def old_symbols(spark: SparkSession, repo: str, since: str, paths: list[str]) -> DataFrame:
    """(n, qualified, name, kind, old_path): symbols that changed files had at the merge base with a revision."""
    base = merge_base(repo, since)
    texts = [(p, t) for p in paths if language_of(p) and (t := blob(repo, base, p)) is not None]
    rows = extract(spark.createDataFrame(texts, "path string, content string")).filter("what = 'symbol'")
    n = F.struct("path", "start_line", "start_col")
    return rows.select(n.alias("n"), "qualified", "name", "kind", F.col("path").alias("old_path"))


def blob(repo: str, revision: str, path: str) -> str | None:
    """A file's text at a revision; none if it was not there."""
    got = subprocess.run(["git", "-C", repo, "show", f"{revision}:{path}"], capture_output=True)
    return got.stdout.decode(errors="replace") if got.returncode == 0 else None
