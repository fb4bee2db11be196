"""Walks compute the edges of a snapshot once; no path is no row."""

import pytest
from lodestone.operators import graph
from lodestone.plans import queries as engine
from lodestone.sources.model import Snapshot
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["critical_path", "impact", "closure_files"])
def test_edges_are_computed_once(spark, monkeypatch, name):
    calls, edges = [], Snapshot.edges
    monkeypatch.setattr(Snapshot, "edges", lambda self: calls.append(1) or edges(self))
    assert engine.queries()[name](spark, DATA).count()
    assert len(calls) == 1


def test_large_layers_are_joined_alike(spark, monkeypatch):
    snap = engine.star_snapshot(spark, DATA)
    small = sorted(engine.critical_path(snap).collect())
    monkeypatch.setattr(graph, "SMALL_LAYER", 0)
    assert small and sorted(engine.critical_path(snap).collect()) == small


def test_no_path_is_no_row(spark):
    snap = engine.star_snapshot(spark, DATA)
    assert engine.critical_path(snap.with_(refs=snap.refs.filter("false"))).collect() == []
    loop = snap.refs.filter("resolved AND src_symbol_id IS NOT NULL").limit(1).withColumn("dst_symbol_id", F.col("src_symbol_id"))
    assert engine.critical_path(snap.with_(refs=loop)).collect() == []
