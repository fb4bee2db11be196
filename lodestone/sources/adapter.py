"""A snapshot from tables of a star schema: suppliers as files, parts as symbols, successive line items as references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.expr import short_name
from lodestone.operators.resolve import resolve_refs
from lodestone.sources.model import DOCUMENT_KINDS, SYMBOL_KINDS, Snapshot


def _by_remainder(c, n: int, values) -> F.Column:
    return reduce(lambda w, kv: w.when(c % n == kv[0], kv[1]), list(enumerate(values))[1:], F.when(c % n == 0, values[0]))


def star_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    projects = read("region").filter("r_regionkey > 0").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lower("r_name").alias("name"), F.concat(F.lit("services/"), F.lower("r_name")).alias("root"), F.lit(0).cast("long").alias("created_at"))

    s = F.col("s_suppkey")
    nation = F.broadcast(read("nation"))
    files = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        s.alias("id"), F.concat(F.lit("src/mod"), s, _by_remainder(s, 3, (".go", ".ts", ".py"))).alias("path"), _by_remainder(s, 3, ("go", "typescript", "python")).alias("language"),
        (s * 37 + 100).alias("size_bytes"), (s * 1000).alias("mtime_ns"), F.sha2(s.cast("string"), 256).alias("content_hash"), F.sha2(F.concat(F.lit("p"), s), 256).alias("parse_hash"),
        (s % 50 + 1000).alias("last_indexed_at"), F.when(F.col("n_regionkey") > 0, (F.col("n_regionkey") + 1).cast("long")).alias("project_id"), F.lit(None).cast("string").alias("document_kind"),
    )
    n = read("supplier").count()

    p = F.col("p_partkey")
    named = lambda key, name: F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("_"), key)))
    parts = read("part").withColumn("name", named(p, F.col("p_name")))
    above = parts.select(F.col("p_partkey").alias("u_id"), F.col("name").alias("u_name"))
    parts = parts.withColumn("parent_id", F.when((p >= n) & (F.col("p_size") % 2 == 0), p - n)).join(above, F.col("parent_id") == F.col("u_id"), "left")
    line = (F.floor(p / n) * 10 + 1).cast("int")
    symbols = parts.select(
        p.alias("id"), (p % n).alias("file_id"), "name", F.concat_ws(".", F.concat(F.lit("mod"), p % n), "u_name", "name").alias("qualified"), _by_remainder(F.col("p_size"), 7, SYMBOL_KINDS).alias("kind"),
        line.alias("start_line"), F.lit(1).alias("start_col"), (line + 8).alias("end_line"), F.lit(2).alias("end_col"), F.concat(F.lit("decl "), F.col("name")).alias("signature"), F.lower("p_type").alias("docstring"),
        F.when(p % 5 == 0, "private").otherwise("public").alias("visibility"), "parent_id",
    )

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = read("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.lead("l_partkey").over(order).alias("dst"), F.row_number().over(order).alias("at"))
    items = items.filter(F.col("dst").isNotNull()).withColumn("id", F.col("l_orderkey") * 100 + F.col("at"))
    i = F.col("id")
    target = symbols.select(F.col("id").alias("dst"), F.col("qualified").alias("d_qualified"), F.col("name").alias("d_name"))
    items = items.join(target, "dst")
    kind = F.when(i % 11 == 0, "import").otherwise(F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "type_ref").otherwise("inherit"))
    name = F.when(i % 17 == 0, F.concat(F.lit("ext.f"), i % 50)).when(i % 3 == 0, F.col("d_name")).otherwise(F.col("d_qualified"))
    refs = items.select(
        i.alias("id"), (F.col("l_partkey") % n).alias("src_file_id"), F.when(i % 11 != 0, F.col("l_partkey")).alias("src_symbol_id"), F.lit(None).cast("long").alias("dst_symbol_id"), name.alias("dst_name"), short_name(name).alias("dst_short"),
        kind.alias("kind"), (i % 200 + 1).cast("int").alias("line"), F.lit(1).alias("col"), F.lit(False).alias("resolved"), F.when((i % 3 == 0) | (i % 11 == 0), 0).otherwise(1).alias("resolver_version"),
    )
    refs = resolve_refs(refs, symbols)

    documents = read("part").select(
        p.alias("id"), (p % n).alias("file_id"), _by_remainder(p, 3, DOCUMENT_KINDS).alias("kind"), F.concat_ws(".", F.lower("p_brand"), F.lower("p_type"), p.cast("string")).alias("key"), F.col("p_name").alias("value"), (F.floor(p / n) + 1).cast("int").alias("line")
    )
    docs = read("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = docs.select("path", (F.col("line") + 1).alias("line"), "content")
    return Snapshot(projects, files, symbols, refs, documents, lines, 1_700_000_000)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records from the events: sign-ups are session markers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("n"), "ts", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("in_bytes"), F.floor(F.col("value") * 100).cast("long").alias("out_bytes"),
        F.floor("value").cast("long").alias("dur_ms"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("s"), F.col("user_id")).alias("sid"), F.when(F.col("event_type") == "signup", "session_start").alias("kind"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines (conv_id, n, raw) from the conversations: what an assistant says comes with a call of one of five
    tools, what a user says is a call's result and a text."""
    block = "struct<type: string, text: string, name: string, input: struct<command: string>, content: string>"
    tool = _by_remainder((F.col("conv_id") * 3 + F.col("turn")) % 5, 5, ("Read", "Bash", "Edit", "mcp__lodestone__find_symbol", "ExitPlanMode"))
    command = F.when(tool == "Bash", F.when(F.col("conv_id") % 2 == 0, "cd src && grep -n x a.go").otherwise("make all"))
    none = F.lit(None).cast("string")
    part = lambda kind, text=none, name=none, given=none, content=none: F.struct(F.lit(kind), text, name, F.when(given.isNotNull(), F.struct(given.alias("command"))), content).cast(block)
    said = part("text", F.col("text"))
    content = F.when(F.col("role") == "assistant", F.array(said, part("tool_use", name=tool, given=command))).when(F.col("role") == "user", F.array(part("tool_result", content=F.col("text")), said)).otherwise(F.array(said))
    raw = F.to_json(F.struct("role", content.alias("content")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("n"), raw.alias("raw"))
