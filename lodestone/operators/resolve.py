"""Linking of references, the write path's joins, and the relational resolvers.

References are linked once on the whole snapshot, so the result does not depend on the order of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.expr import parent_name, short_name


def resolve_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """dst_symbol_id and resolved: the least id of the qualified name; else, for textual references only, the symbol of
    that short name if it is the only one. Both lookups are one aggregated row for each name."""
    by_qualified = symbols.groupBy("qualified").agg(F.min("id").alias("q_id"))
    by_name = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("s_id")).filter("n = 1").select("name", "s_id")
    out = refs.drop("dst_symbol_id", "resolved").join(by_qualified, refs["dst_name"] == by_qualified["qualified"], "left")
    out = out.join(by_name, (out["dst_short"] == by_name["name"]) & (out["resolver_version"] == 0), "left")
    out = out.withColumn("dst_symbol_id", F.coalesce("q_id", "s_id")).withColumn("resolved", F.col("dst_symbol_id").isNotNull())
    return out.drop("qualified", "q_id", "name", "s_id")


def sync_resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References to symbols that are gone lose their target; resolved follows the target."""
    alive = symbols.select(F.col("id").alias("alive"))
    out = refs.join(alive, refs["dst_symbol_id"] == alive["alive"], "left").withColumn("dst_symbol_id", F.col("alive"))
    return out.drop("alive").withColumn("resolved", F.col("dst_symbol_id").isNotNull())


def wire_parents(symbols: DataFrame) -> DataFrame:
    """parent_id by qualified name within the file; of several symbols of one name the last id is the parent."""
    own = symbols.groupBy("file_id", "qualified").agg(F.max("id").alias("p_id")).select(F.col("file_id").alias("f"), F.col("qualified").alias("q"), "p_id")
    base = symbols.drop("parent_id").withColumn("up", parent_name(F.col("qualified")))
    return base.join(own, (base["file_id"] == own["f"]) & (base["up"] == own["q"]) & (base["up"] != ""), "left").withColumn("parent_id", F.when(F.col("p_id") != F.col("id"), F.col("p_id"))).drop("f", "q", "p_id", "up")


def upsert_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, path, action): insert, update (content or parse hash differs), touch, delete."""
    key = ["project_id", "path"]
    o = old.select(*key, F.col("content_hash").alias("o_content"), F.col("parse_hash").alias("o_parse"), F.lit(True).alias("was"))
    n = new.select(*key, "content_hash", "parse_hash", F.lit(True).alias("now"))
    o, n = (x.withColumn("project_id", F.coalesce("project_id", F.lit(-1))) for x in (o, n))
    same = F.col("content_hash").eqNullSafe(F.col("o_content")) & F.col("parse_hash").eqNullSafe(F.col("o_parse"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(same, "touch").otherwise("update")
    return o.join(n, key, "full_outer").select(F.when(F.col("project_id") >= 0, F.col("project_id")).alias("project_id"), "path", action.alias("action"))


def replace_rows(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of changed keys replaced by the new ones: delete and insert as an anti-join and a union."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def prune_files(files: DataFrame, walked: DataFrame, complete: bool = True) -> DataFrame:
    """Files that the walk saw, by project and path; all of them if a walk failed."""
    if not complete:
        return files
    w = walked.select(F.coalesce("project_id", F.lit(-1)).alias("w_project"), F.col("path").alias("w_path"))
    return files.join(w, (F.coalesce(files["project_id"], F.lit(-1)) == w["w_project"]) & (files["path"] == w["w_path"]), "left_semi")


def cascade(rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    return rows.join(files.select(F.col("id").alias(key)), key, "left_semi")


def assign_projects(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The project with the longest root that is the path or a folder above it; an empty root fits everything. Paths meet
    roots by equality on their leading folders, so the join has a key."""
    parts = F.split("path", "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    keyed = paths.withColumn("root", F.explode(up))
    hit = keyed.join(F.broadcast(projects.select("root", F.col("id").alias("project_id"))), "root", "left")
    best = F.max_by("project_id", F.when(F.col("project_id").isNotNull(), F.length("root")).otherwise(-1))
    return hit.groupBy("path").agg(best.alias("project_id"))


def implements(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(concrete, interface): types whose set of method names holds all of a non-empty interface's. By names only; an
    approximation where signatures differ. The join is on method names, counted against the interface's size."""
    need = interfaces.select("interface", "method").distinct()
    size = need.groupBy("interface").agg(F.count("*").alias("size"))
    have = methods.select("concrete", "method").distinct()
    return have.join(need, "method").groupBy("concrete", "interface").agg(F.count("*").alias("n")).join(size, "interface").filter("n = size AND concrete <> interface").select("concrete", "interface")


def resolve_imports(calls: DataFrame, imports: DataFrame, class_methods: DataFrame) -> DataFrame:
    """Scope resolution of calls as joins. calls(file, module, enclosing_class, dst_name), imports(file, local, module,
    remote; remote null: the whole module), class_methods(module, class, method). this/self/cls reach the enclosing
    class's methods; an imported head becomes its module's name; a bare name belongs to the module itself."""
    head, rest = F.substring_index("dst_name", ".", 1), F.when(F.instr("dst_name", ".") > 0, F.regexp_replace("dst_name", r"^[^.]*\.", ""))
    c = calls.withColumn("head", head).withColumn("rest", rest)
    i = imports.groupBy("file", "local").agg(F.min(F.struct("module", "remote")).alias("to"))
    out = c.join(i, (c["file"] == i["file"]) & (c["head"] == i["local"]), "left").select(c["*"], "to")
    m = class_methods.select(F.col("module").alias("m_module"), F.col("class").alias("m_class"), F.col("method").alias("m_method")).distinct()
    out = out.join(m, F.col("head").isin("this", "self", "cls") & (out["module"] == m["m_module"]) & (out["enclosing_class"] == m["m_class"]) & (out["rest"] == m["m_method"]), "left")
    dotted = lambda *x: F.concat_ws(".", *x)
    name = F.when(F.col("m_method").isNotNull(), dotted("module", "enclosing_class", "rest")).when(F.col("to").isNotNull(), dotted("to.module", "to.remote", "rest"))
    name = name.when(F.col("rest").isNull(), dotted("module", "head")).otherwise(F.col("dst_name"))
    return out.select(*calls.columns, name.alias("resolved_name"), short_name(name).alias("resolved_short"))


def latest_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert by key: the last row of each."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("k_rank", F.row_number().over(w)).filter("k_rank = 1").drop("k_rank")
