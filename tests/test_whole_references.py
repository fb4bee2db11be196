"""The references of the adapter are all line items that have a successor: against a plain version."""

import collections

import pyarrow.parquet as pq
from lodestone.sources.adapter import star_snapshot

DATA = "/root/testdata/sf0.001"


def test_every_line_item_with_a_successor_is_a_reference(spark):
    orders = collections.defaultdict(list)
    for r in pq.read_table(f"{DATA}/lineitem.parquet").to_pylist():
        orders[r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"]))
    parts = set(pq.read_table(f"{DATA}/part.parquet")["p_partkey"].to_pylist())
    want = [k * 100 + i for k, items in orders.items() for i, (_, dst, *_) in enumerate(sorted(items)[1:], 1) if dst in parts]
    assert sorted(r.id for r in star_snapshot(spark, DATA).refs.select("id").collect()) == sorted(want)
