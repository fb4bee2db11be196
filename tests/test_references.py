"""Symbols below a target, and the references to them: against SQLite's LIKE and by equality joins only."""

import random
import sqlite3

import pytest
from lodestone.operators import lookup
from lodestone.plans import queries as engine
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_below_is_like(spark, seed):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("aAbB__é𝄞\\") for _ in range(rng.randrange(4)))
    names = [".".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(300)] + ["a_b.c", "aXb.c.d", "a.b.c.d", "x%.y", "xaa.y", "x.y.z", "mod.a%_.b", "mod.a12.b.c"]
    roots = rng.sample(names, 40) + ["a_b.c", "a_b", "x%", "mod.a%_.b", ""]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE symbols (id, qualified)")
    con.executemany("INSERT INTO symbols VALUES (?, ?)", list(enumerate(names)))
    want = sorted({i for r in roots for (i,) in con.execute("SELECT id FROM symbols WHERE qualified LIKE ?", (r + ".%",))})
    symbols = spark.createDataFrame(list(enumerate(names)), "id long, qualified string")
    assert sorted(r.id for r in lookup.below(symbols, spark.createDataFrame([(r,) for r in roots], "root string")).collect()) == want


def test_no_nested_loop_and_one_pass_over_the_references(spark):
    plan = engine.queries()["refs_with_children"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert plan.count("lineitem.parquet") == 1


def test_a_reference_may_be_both(spark):
    snap = engine.star_snapshot(spark, DATA)
    one = snap.refs.filter("resolved").orderBy("id").limit(1).withColumns({"resolved": F.lit(False), "dst_symbol_id": F.lit(1).cast("long")})
    name = snap.symbols.filter("id = 1").first()["name"]
    both = snap.with_(refs=one.withColumn("dst_short", F.lit(name)))
    assert sorted(r.branch for r in lookup.get_references(both, name).rows.collect()) == [0, 1]
