"""Roll-ups of call records, sessions, costs and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.expr import bytes_to_tokens, safe_ratio

CHARS_PER_TOKEN = 4.0
#: Tool, bytes of the plain way for each byte of the tool's answer, quality of that estimate.
MULTIPLIERS = [
    ("find_symbol", 0.8, "medium"), ("get_references", 1.8, "medium"), ("read_focused", 4.0, "high"), ("get_file_outline", 2.5, "high"), ("get_file_summary", 3.0, "high"), ("search_lexical", 1.0, "high"), ("search_semantic", 2.5, "low"),
    ("get_neighborhood", 2.5, "low"), ("impact_analysis", 1.5, "low"), ("critical_path", 3.0, "low"), ("find_document_key", 1.2, "medium"), ("list_files", 0.2, "medium"), ("stats", 0.0, "none"), ("ping", 0.0, "none"),
]
#: Commands that explore.
EXPLORING = ("grep", "rg", "ripgrep", "find", "fd", "cat", "head", "tail", "less", "more", "awk", "sed", "wc", "sort", "uniq", "ls", "tree", "ag")
#: Commands that make a shell call a fallback, and the tools that edit.
FALLBACK = ("grep", "rg", "find", "fd", "cat", "head", "tail", "ls", "tree", "ag", "wc")
EDITING = ("Edit", "Write", "NotebookEdit")
#: What names of the engine's own tools begin with in a transcript.
OWN = "mcp__lodestone__"
#: Tags of text that was put in for the user.
WRAPPERS = ("ide_opened_file", "ide_selection", "ide_diagnostics", "system-reminder", "command-name", "local-command-stdout")


def tool_rollup(calls: DataFrame) -> DataFrame:
    """A row for each tool and one for all. Medians and late values come from counts by duration, so no group's calls are
    gathered: the n-th call is where the running count passes n."""
    base = calls.rollup("tool").agg(
        F.count("*").alias("count"), F.count_if("ok").alias("ok"), F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), F.sum(F.when(F.col("ok"), F.col("out_bytes")).otherwise(0)).alias("out_bytes_ok"),
        F.expr("sum(dur_ms) div count(*)").alias("mean_ms"), F.grouping("tool").alias("g"),
    ).select(F.when(F.col("g") == 1, "all").otherwise(F.col("tool")).alias("tool"), "count", "ok", "in_bytes", "out_bytes", "out_bytes_ok", "mean_ms")
    both = calls.select("tool", "dur_ms").unionByName(calls.select(F.lit("all").alias("tool"), "dur_ms"))
    n = both.groupBy("tool", "dur_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tool")
    run = n.withColumn("upto", F.sum("n").over(w.orderBy("dur_ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("dur_ms")))
    q = run.groupBy("tool").agg(at(F.expr("total div 2")).alias("p50_ms"), at(F.least(F.col("total") - 1, F.expr("total * 95 div 100"))).alias("p95_ms"))
    return base.join(q, "tool").orderBy(F.when(F.col("tool") == "all", 1).otherwise(0), F.desc("count"), "tool")


def classify_tool(tool, command):
    """exploratory, action or other, of a tool call outside the engine."""
    word = command_word(command)
    shell = F.when(word.isin(*EXPLORING), "exploratory").otherwise("action")
    return F.when(tool == "Bash", shell).when(tool.isin("Read", "WebFetch", "WebSearch"), "exploratory").when(tool.isin("Edit", "Write", "NotebookEdit"), "action").otherwise("other")


def command_word(command):
    """The base name of a command's first word that is no assignment."""
    return F.substring_index(F.coalesce(F.get(F.filter(F.split(F.trim(command), r"\s+"), lambda x: ~F.contains(x, F.lit("="))), 0), F.lit("")), "/", -1)


def external_rollup(rows: DataFrame) -> DataFrame:
    """rows: tool, detail, category, input_size, output_size; summed by label (tool/detail) and category."""
    label = F.when(F.coalesce("detail", F.lit("")) != "", F.concat_ws("/", "tool", "detail")).otherwise(F.col("tool"))
    return rows.groupBy(label.alias("tool"), "category").agg(F.count("*").alias("count"), F.coalesce(F.sum("input_size"), F.lit(0)).alias("in_bytes"), F.coalesce(F.sum("output_size"), F.lit(0)).alias("out_bytes")).orderBy(F.desc("count"), "tool", "category")


def sessionize(records: DataFrame, order: str = "n", width: int = 100_000) -> DataFrame:
    """Calls with their session: their own sid; else that of the last marker before them in the order of the log; calls
    before any marker go; a sid that has no marker is <unknown>. records: one log, or several told apart by log; order: a
    whole number.

    The last marker is carried in two steps, so no task holds a whole log: within ranges of the order, and over one row for
    each range that has a marker."""
    marks = records.filter("kind = 'session_start'").select(F.col("sid").alias("m_sid")).distinct()
    own = records.filter("kind IS NULL AND sid IS NOT NULL").join(marks, F.col("sid") == F.col("m_sid"), "left").select(*records.columns, F.when(F.col("m_sid").isNotNull(), F.col("sid")).otherwise("<unknown>").alias("session"))
    if "log" not in records.columns:
        records = records.withColumn("log", F.lit(0))
    mark = F.when(F.col("kind") == "session_start", F.col("sid"))
    ranged = records.filter("kind = 'session_start' OR sid IS NULL").withColumn("range", F.floor(F.col(order) / width))
    last = ranged.groupBy("log", "range").agg(F.max_by(mark, F.when(mark.isNotNull(), F.col(order))).alias("last"))
    w = Window.partitionBy("log").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = last.withColumn("carried", F.last("last", ignorenulls=True).over(w)).select("log", "range", "carried")
    inside = F.last(mark, ignorenulls=True).over(Window.partitionBy("log", "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("inside", inside).join(before, ["log", "range"]).withColumn("session", F.coalesce("inside", "carried"))
    return own.unionByName(placed.filter("kind IS NULL AND session IS NOT NULL").select(*own.columns))


def session_rollup(records: DataFrame) -> DataFrame:
    """(session, calls, tools, ok, in_bytes, out_bytes, span_s), longest first."""
    s = sessionize(records)
    return s.groupBy("session").agg(
        F.count("*").alias("calls"), F.count_distinct("tool").alias("tools"), F.count_if("ok").alias("ok"), F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"),
        (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("span_s"),
    ).orderBy(F.desc("span_s"), "session")


def session_compare(records: DataFrame, one: str, two: str) -> DataFrame:
    """(tool, calls_a, calls_b, delta) of two sessions, tools of either."""
    s = sessionize(records)
    side = lambda sid, name: s.filter(F.col("session") == sid).groupBy("tool").agg(F.count("*").alias(name))
    out = side(one, "a").join(side(two, "b"), "tool", "full_outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return out.select("tool", a.alias("calls_a"), b.alias("calls_b"), (b - a).alias("delta")).orderBy(F.desc(F.abs("delta")), "tool")


def multipliers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MULTIPLIERS, "tool string, multiplier double, quality string")


def tool_costs(summary: DataFrame, fallback: DataFrame, per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """(tool, source, count, total_bytes, tokens, plain_bytes, quality), most bytes first. summary: tool, count, ok,
    in_bytes, out_bytes, out_bytes_ok; only successful answers earn credit."""
    m = F.broadcast(multipliers(summary.sparkSession))  # fourteen rows
    s = summary.filter("tool <> 'all'").join(m, "tool", "left").withColumn("quality", F.coalesce("quality", F.lit("none")))
    basis = F.when((F.col("out_bytes_ok") == 0) & (F.col("ok") == F.col("count")), F.col("out_bytes")).otherwise(F.col("out_bytes_ok"))
    own = s.select("tool", F.lit("own").alias("source"), "count", (F.col("in_bytes") + F.col("out_bytes")).alias("total_bytes"), F.coalesce((basis * F.col("multiplier")).cast("long"), F.lit(0)).alias("plain_bytes"), "quality")
    other = fallback.select("tool", F.lit("fallback").alias("source"), "count", (F.col("in_bytes") + F.col("out_bytes")).alias("total_bytes"), F.lit(0).cast("long").alias("plain_bytes"), F.lit("none").alias("quality"))
    every = own.unionByName(other)
    return every.withColumn("tokens", bytes_to_tokens(F.col("total_bytes"), per_token)).orderBy(F.desc("total_bytes"), "tool")


def session_cost(costs: DataFrame, per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """One row of totals, with what the plain way would have cost and the savings."""
    part = lambda c, who: F.coalesce(F.sum(F.when(F.col("source") == who, F.col(c))), F.lit(0))
    t = costs.agg(part("total_bytes", "own").alias("own_bytes"), part("total_bytes", "fallback").alias("fallback_bytes"), F.coalesce(F.sum(F.when(F.col("quality") != "none", F.col("plain_bytes"))), F.lit(0)).alias("plain_bytes"))
    t = t.withColumn("without_bytes", F.col("plain_bytes") + F.col("fallback_bytes")).withColumn("total_bytes", F.col("own_bytes") + F.col("fallback_bytes"))
    t = t.withColumn("saved_bytes", F.col("without_bytes") - F.col("total_bytes"))
    tokens = bytes_to_tokens(F.col("own_bytes"), per_token) + bytes_to_tokens(F.col("fallback_bytes"), per_token)
    return t.withColumn("tokens", tokens).withColumn("saved_tokens", bytes_to_tokens(F.col("without_bytes"), per_token) - F.col("tokens")).withColumn("savings_ratio", safe_ratio(F.col("saved_bytes"), F.col("without_bytes")))


def only_wrapper(text):
    """Whether a text is blank, or begins with a wrapper's tag and ends with the same tag's closing."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    tagged = F.lit(False)
    for tag in WRAPPERS:
        tagged = tagged | (t.startswith(f"<{tag}>") & t.endswith(f"</{tag}>"))
    return (t == "") | tagged


def transcript_turns(talk: DataFrame) -> DataFrame:
    """(conv_id, turns, first_user): a turn begins at a user's row after an assistant's; one at least; first_user: the
    first user text that is more than a wrapper, cut with an ellipsis after 300 characters. talk: conv_id, turn, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = talk.withColumn("before", F.lag("role").over(w))
    short = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("…"))).otherwise(F.col("text"))
    first = F.min_by(short, F.when((F.col("role") == "user") & ~only_wrapper(F.col("text")), F.col("turn")))
    return t.groupBy("conv_id").agg(F.greatest(F.count_if((F.col("role") == "user") & (F.col("before") == "assistant")), F.lit(1)).alias("turns"), first.alias("first_user"))


def fallback_call(name, given):
    """Whether a call explores without the engine. given: its input as JSON text; a shell call counts where a command
    stands behind a quote, between blanks, or first."""
    shell = F.lit(False)
    for word in FALLBACK:
        shell = shell | F.contains(given, F.lit(f'"{word}')) | F.contains(given, F.lit(f" {word} ")) | given.startswith(f"{word} ")
    return name.isin("Read", "WebSearch", "WebFetch") | ((name == "Bash") & shell)


def transcript_tools(found: DataFrame) -> DataFrame:
    """(conv_id, tool, calls) of the tools that a transcript calls. found: blocks with conv_id."""
    return found.filter("type = 'tool_use'").groupBy("conv_id", F.coalesce("name", F.lit("")).alias("tool")).agg(F.count("*").alias("calls"))


def transcript_calls(found: DataFrame, own: str = OWN) -> DataFrame:
    """(conv_id, calls, edits, agents, own_calls, fallbacks, plan_mode) of each transcript, also of one without calls."""
    use, name = F.col("type") == "tool_use", F.coalesce("name", F.lit(""))
    return found.groupBy("conv_id").agg(
        F.count_if(use).alias("calls"), F.count_if(use & name.isin(*EDITING)).alias("edits"), F.count_if(use & (name == "Agent")).alias("agents"), F.count_if(use & name.startswith(own)).alias("own_calls"),
        F.count_if(use & fallback_call(name, F.col("input"))).alias("fallbacks"), F.max(use & (name == "ExitPlanMode")).alias("plan_mode"),
    )


def _clipped(text, n: int):
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def fallback_context(found: DataFrame) -> DataFrame:
    """(conv_id, n, pos, tool, input, said, result) of each call that explores without the engine: the last assistant text
    of the three events before it, 600 characters of it, and the result that follows at once, 400 characters. Blank texts
    are no events. found: blocks with conv_id."""
    events = found.filter("type IN ('tool_use', 'tool_result') OR (type = 'text' AND coalesce(text, '') <> '')")
    w = Window.partitionBy("conv_id").orderBy("n", "pos")
    said = F.last(F.when((F.col("type") == "text") & (F.col("role") == "assistant"), _clipped(F.col("text"), 600)), ignorenulls=True).over(w.rowsBetween(-3, -1))
    result = F.lead(F.when((F.col("type") == "tool_result") & (F.col("result") != ""), _clipped(F.col("result"), 400))).over(w)
    placed = events.withColumn("said", said).withColumn("after", result)
    return placed.filter("type = 'tool_use'").filter(fallback_call(F.col("name"), F.col("input"))).select("conv_id", "n", "pos", F.col("name").alias("tool"), "input", "said", F.col("after").alias("result"))


def blocks(lines: DataFrame) -> DataFrame:
    """Typed blocks of transcript lines (n, raw JSON, and what else tells transcripts apart): content may be text or an
    array of blocks, at the top or in message. input: a call's arguments as JSON; result: a result's text, that of all its
    parts if it has several."""
    keys = [c for c in lines.columns if c != "raw"]
    v = lines.withColumn("v", F.try_parse_json("raw")).filter("v IS NOT NULL")
    at = lambda p, t="string": F.try_variant_get("v", p, t)
    v = v.select(*keys, F.coalesce(at("$.message.role"), at("$.role"), at("$.type")).alias("role"), F.coalesce(F.expr("variant_get(v, '$.message.content', 'variant')"), F.expr("variant_get(v, '$.content', 'variant')")).alias("c"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    text = v.filter("schema_of_variant(c) = 'STRING'").select(*keys, "role", F.lit(0).alias("pos"), F.lit("text").alias("type"), F.expr("cast(c AS string)").alias("text"), none("name"), none("input"), none("result"))
    many = v.filter("schema_of_variant(c) LIKE 'ARRAY%'").select(*keys, "role", F.posexplode(F.expr("cast(c AS array<variant>)")).alias("pos", "b"))
    get = lambda p: F.try_variant_get("b", p, "string")
    kind = F.coalesce(get("$.type"), F.lit("text"))
    parts = F.expr("array_join(transform(try_variant_get(b, '$.content', 'array<variant>'), x -> coalesce(try_variant_get(x, '$.text', 'string'), '')), '')")
    result = F.when(F.expr("schema_of_variant(try_variant_get(b, '$.content', 'variant')) LIKE 'ARRAY%'"), parts).otherwise(F.coalesce(get("$.content"), F.lit("")))
    given = F.coalesce(F.expr("to_json(try_variant_get(b, '$.input', 'variant'))"), F.lit("{}"))
    return text.unionByName(many.select(*keys, "role", "pos", kind.alias("type"), F.coalesce(get("$.text"), get("$.content")).alias("text"), get("$.name").alias("name"), F.when(kind == "tool_use", given).alias("input"), F.when(kind == "tool_result", result).alias("result")))
