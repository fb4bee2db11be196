"""Classification of tools and of texts that were put in for the user; transcripts; sessions."""

import random

from lodestone.operators import telemetry
from pyspark.sql import functions as F


def test_tools(spark):
    rows = [("Bash", "A=1 /usr/bin/ag x"), ("Bash", "sort f"), ("Bash", "make"), ("Bash", ""), ("Read", None), ("Grep", None), ("Glob", None), ("LS", None), ("MultiEdit", None), ("NotebookEdit", None), ("Agent", None)]
    df = spark.createDataFrame(rows, "tool string, command string")
    got = [r[0] for r in df.select(telemetry.classify_tool(F.col("tool"), F.col("command"))).collect()]
    assert got == ["exploratory", "exploratory", "action", "action", "exploratory", "other", "other", "other", "other", "action", "other"]


def test_first_user_message(spark):
    wrapped = [f"  <{t}>a\nb</{t}>\n" for t in telemetry.WRAPPERS]
    talks = [[*wrapped, "", "<b>bold question</b>", "later"], ["<ide_selection>x</ide_selection> and this", "later"], ["y" * 301], wrapped]
    rows = [(c, i, "user", t) for c, talk in enumerate(talks) for i, t in enumerate(talk)]
    got = telemetry.transcript_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("conv_id").collect()
    assert [r.first_user for r in got] == ["<b>bold question</b>", "<ide_selection>x</ide_selection> and this", "y" * 300 + "…", None]


def test_fallback_calls(spark):
    rows = [("Read", "{}", True), ("Bash", '{"command":"grep x"}', True), ("Bash", '{"command":"a | wc -l"}', True), ("Bash", "cat f", True), ("Bash", '{"command":"make"}', False), ("Bash", '{"command":"x;ls"}', False), ("Edit", '"cat', False)]
    df = spark.createDataFrame(rows, "name string, given string, want boolean")
    assert [r[0] for r in df.select(telemetry.fallback_call(F.col("name"), F.col("given"))).collect()] == [r[2] for r in rows]


def test_transcript_results(spark):
    lines = [
        '{"role":"assistant","content":[{"type":"text","text":"why"},{"type":"tool_use","name":"Bash","input":{"command":"rg y"}}]}',
        '{"role":"user","content":[{"type":"tool_result","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}]}',
        "broken",
        '{"role":"assistant","content":[{"type":"text","text":""},{"type":"tool_use","name":"Agent"},{"type":"tool_use","name":"Read"}]}',
        '{"role":"user","content":"plain"}',
        '{"role":"assistant","content":[{"type":"tool_use","name":"Write"},{"type":"tool_use","name":"mcp__lodestone__stats"},{"type":"tool_use","name":"ExitPlanMode"}]}',
    ]
    found = telemetry.blocks(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "conv_id long, n long, raw string"))
    got = telemetry.fallback_context(found).orderBy("n", "pos").collect()
    assert [(r.n, r.tool, r.input, r.said, r.result) for r in got] == [(0, "Bash", '{"command":"rg y"}', "why", "ab"), (3, "Read", "{}", None, None)]
    assert tuple(telemetry.transcript_calls(found).first()) == (1, 6, 1, 1, 1, 2, True)


def test_sessions_across_ranges(spark):
    """Any width of the ranges gives what one pass over each log does."""
    rng = random.Random(5)
    rows = []
    for log in (1, 2):
        for n in range(200):
            start = rng.random() < 0.05
            rows.append((log, n, f"s{rng.randrange(6)}" if start or rng.random() < 0.2 else None, "session_start" if start else None))
    marks, want = {r[2] for r in rows if r[3]}, []
    for log in (1, 2):
        last = None
        for _, n, sid, kind in (r for r in rows if r[0] == log):
            if kind:
                last = sid
            elif sid or last:
                want.append((log, n, last if sid is None else sid if sid in marks else "<unknown>"))
    df = spark.createDataFrame(rows, "log long, n long, sid string, kind string")
    for width in (1, 7, 1000):
        assert sorted((r.log, r.n, r.session) for r in telemetry.sessionize(df, width=width).collect()) == sorted(want)
