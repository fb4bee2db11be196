"""Walks over the reference graph: one frontier operator, and the closures, neighbourhoods and paths on top of it.

Every layer is a join of the edges with a set of nodes, so the work of a layer is bounded by the edges whatever the
number of seeds; layers are cut off from the plan by checkpoints and the walk ends at an empty layer. The edges themselves
are computed once for a snapshot (Snapshot.pairs), and stay where they are while a layer is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.expr import focus_score, focus_tokens
from lodestone.operators.lookup import BadParams, NotFound
from lodestone.plans.iterate import cut
from lodestone.sources.model import Snapshot

NEIGHBOR_DEPTH, NEIGHBOR_CAP = 2, 5
IMPACT_DEPTH, IMPACT_CAP = 5, 10
PATH_DEPTH, PATH_COUNT = 8, 5
#: A layer of more nodes is not broadcast.
SMALL_LAYER = 200_000


def clamp(depth: int | None, default: int, cap: int) -> tuple[int, list[str]]:
    depth = depth or default
    return (cap, [f"depth {depth} was clamped to {cap}"]) if depth > cap else (depth, [])


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def frontier(edges: DataFrame, seeds: DataFrame, depth: int, near: str = "dst", far: str = "src") -> DataFrame:
    """(id, distance) of all nodes reached from seeds(id) against (or along) the edges, each once at its least distance.
    The seeds themselves are not visited: one on a cycle is reached like any other node."""
    return reach(cut(edges.select("src", "dst").distinct()), seeds, depth, near, far)


def _hinted(layer: DataFrame, size: int) -> DataFrame:
    return F.broadcast(layer) if size <= SMALL_LAYER else layer


def reach(pairs: DataFrame, seeds: DataFrame, depth: int, near: str = "dst", far: str = "src") -> DataFrame:
    """frontier over edges that are already cut off and distinct, such as Snapshot.pairs."""
    step = pairs.select(F.col(near).alias("a"), F.col(far).alias("b"))
    now, seen = cut(seeds.select("id").distinct()), None
    size = now.count()
    layers = []
    for d in range(1, depth + 1):
        reached = step.join(_hinted(now.select(F.col("id").alias("a")), size), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        layer = cut((reached.join(seen, "id", "left_anti") if seen is not None else reached).withColumn("distance", F.lit(d)))
        size = layer.count()
        if not size:
            break
        layers.append(layer)
        now = layer
        seen = layer.select("id") if seen is None else seen.unionByName(layer.select("id"))
    return reduce(DataFrame.unionByName, layers) if layers else _empty(pairs.sparkSession, "id long, distance int")


def resolve_seed(snap: Snapshot, target: str) -> int:
    """The symbol of that qualified name (the least id), else the only one of that short name."""
    got = snap.symbols.filter(F.col("qualified") == target).orderBy("id").limit(1).select("id").collect()
    got = got or snap.symbols.filter(F.col("name") == target).orderBy("id").limit(2).select("id").collect()
    if not got:
        raise NotFound(f"symbol {target!r} not found")
    if len(got) > 1:
        raise BadParams(f"{target!r} is ambiguous; give a qualified name")
    return got[0]["id"]


def _one(snap: Snapshot, i: int) -> DataFrame:
    return snap.symbols.sparkSession.createDataFrame([(i,)], "id long")


def impact(snap: Snapshot, seeds: DataFrame, kind: str | None = None, depth: int = IMPACT_DEPTH, project: str | None = None, since: list[str] | None = None) -> DataFrame:
    """All that reaches the seeds, with its distance. kind, project and since narrow the report, not the walk."""
    reached = reach(snap.pairs, seeds, clamp(depth, IMPACT_DEPTH, IMPACT_CAP)[0])
    s = snap.symbols.filter(F.col("kind") == kind) if kind else snap.symbols
    files = snap.placed_files(project, since).select(F.col("id").alias("file_id"), F.col("shown").alias("path"), "project")
    return reached.join(s, "id").join(files, "file_id").select("id", "qualified", "kind", "path", "project", "distance").orderBy("distance", "qualified", "id")


def impact_analysis(snap: Snapshot, target: str, **options) -> DataFrame:
    return impact(snap, _one(snap, resolve_seed(snap, target)), **options)


def closure_files(snap: Snapshot, seeds: DataFrame, depth: int = IMPACT_DEPTH, project: str | None = None) -> DataFrame:
    """(path, project, distance): the files of all that reaches the seeds, at their least distance."""
    files = snap.placed_files(project).select(F.col("id").alias("file_id"), F.col("shown").alias("path"), "project")
    return reach(snap.pairs, seeds, depth).join(snap.symbols.select("id", "file_id"), "id").join(files, "file_id").groupBy("path", "project").agg(F.min("distance").alias("distance"))


def inherit_expand(snap: Snapshot, seed: int) -> DataFrame:
    """Symbols that stand beside the seed through inheritance: for a type, class or interface its counterparts in both
    directions; for a method the methods of the same name on its owner's counterparts."""
    s = snap.symbols
    me = s.filter(F.col("id") == seed).select("name", "kind", "qualified")
    pairs = snap.refs.filter("kind = 'inherit' AND src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL").select("src_symbol_id", "dst_symbol_id")
    q = s.select(F.col("id").alias("i"), F.col("qualified").alias("q"))
    named = pairs.join(q.select(F.col("i").alias("src_symbol_id"), F.col("q").alias("a")), "src_symbol_id").join(q.select(F.col("i").alias("dst_symbol_id"), F.col("q").alias("b")), "dst_symbol_id").select("a", "b").distinct()
    both = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    types = me.filter(F.col("kind").isin("type", "class", "interface")).join(both, F.col("qualified") == F.col("a")).select(F.col("b").alias("qualified"))
    owner = F.regexp_replace("qualified", r"\.[^.]*$", "")
    methods = me.filter("kind = 'method'").withColumn("owner", owner).join(both, F.col("owner") == F.col("a")).select(F.concat_ws(".", "b", "name").alias("qualified"))
    return s.join(types.unionByName(methods).distinct(), "qualified", "left_semi").filter(F.col("id") != seed).select("id").distinct()


def neighborhood(snap: Snapshot, seeds: DataFrame, depth: int = NEIGHBOR_DEPTH, direction: str = "both", project: str | None = None, focus: str = "") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) within so many steps. An edge is one row for each depth at which it is walked, for a layer's nodes
    are a set of their own; a node has its least depth. With a focus the seeds and the nodes that fit it stay."""
    way = (direction or "both").lower()
    if way not in ("both", "in", "out"):
        raise BadParams(f"direction {direction!r} is not in, out or both")
    depth = clamp(depth, NEIGHBOR_DEPTH, NEIGHBOR_CAP)[0]
    every = snap.edges()
    if project:
        inside = snap.symbols.join(snap.placed_files(project).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
        every = every.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    every = cut(every.distinct())
    seeds = cut(seeds.select("id").distinct())
    first, parts = seeds.count(), []
    for one in ("out", "in") if way == "both" else (way,):
        near, far = ("src", "dst") if one == "out" else ("dst", "src")
        now, size = seeds, first
        for d in range(1, depth + 1):
            layer = cut(every.join(_hinted(now.select(F.col("id").alias(near)), size), near, "left_semi").select("src", "dst", "kind", "file_id", "line", F.lit(d).alias("depth"), F.lit(one).alias("direction")))
            size = layer.count()  # its nodes are no more than its edges
            if not size:
                break
            parts.append(layer)
            now = layer.select(F.col(far).alias("id")).distinct()
    edges = reduce(DataFrame.unionByName, parts) if parts else _empty(every.sparkSession, "src long, dst long, kind string, file_id long, line int, depth int, direction string")
    far_side = edges.select(F.when(F.col("direction") == "out", F.col("dst")).otherwise(F.col("src")).alias("id"), "depth")
    nodes = seeds.withColumn("depth", F.lit(0)).unionByName(far_side).groupBy("id").agg(F.min("depth").alias("depth")).join(snap.symbols.select("id", "name", "qualified", "kind", "docstring"), "id")
    if tokens := focus_tokens(focus):
        nodes = nodes.filter((F.col("depth") == 0) | (focus_score(tokens, F.col("name"), F.col("qualified"), F.col("docstring")) > 0))
        keep = nodes.select("id")
        edges = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges, nodes.drop("name", "docstring")


def get_neighborhood(snap: Snapshot, target: str, **options) -> tuple[DataFrame, DataFrame]:
    seed = resolve_seed(snap, target)
    return neighborhood(snap, _one(snap, seed).unionByName(inherit_expand(snap, seed)), **options)


def shortest_paths(snap: Snapshot, start: int, goal: int, depth: int = PATH_DEPTH, count: int = PATH_COUNT, project: str | None = None) -> DataFrame:
    """(n, ids): up to count paths of least length along the edges, in the order of a depth-first walk back from the goal
    that takes lower ids first. Each step back keeps the first count beginnings only: all of them can be completed."""
    spark = snap.symbols.sparkSession
    if start == goal:
        return spark.createDataFrame([(1, [start])], "n int, ids array<long>")
    every = snap.pairs.select("src", "dst").filter("src <> dst")
    if project:
        inside = snap.symbols.join(snap.placed_files(project).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
        every = cut(every.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi"))
    seen = cut(spark.createDataFrame([(start,)], "id long"))
    now, size, parents, found = seen, 1, [], False
    for _ in range(depth):
        step = every.join(_hinted(now.select(F.col("id").alias("src")), size), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        step = cut(step.select("src", "dst"))
        parents.append(step)
        now = step.select(F.col("dst").alias("id")).distinct()
        size = now.count()
        if not size:
            break
        if not now.filter(F.col("id") == goal).isEmpty():
            found = True
            break
        seen = cut(seen.unionByName(now))
    if not found:
        return _empty(spark, "n int, ids array<long>")
    back = spark.createDataFrame([([goal],)], "walk array<long>")
    for step in reversed(parents):
        back = back.join(step, F.element_at("walk", -1) == F.col("dst")).select(F.concat("walk", F.array("src")).alias("walk")).orderBy("walk").limit(count)
    rows = [r["walk"] for r in back.orderBy("walk").limit(count).collect()]  # at most count short paths
    return spark.createDataFrame([(i + 1, w[::-1]) for i, w in enumerate(rows)], "n int, ids array<long>")


def critical_path(snap: Snapshot, start: str, goal: str, **options) -> DataFrame:
    """(n, place, id, qualified, path) of each vertex of the paths."""
    paths = shortest_paths(snap, resolve_seed(snap, start), resolve_seed(snap, goal), **options)
    files = snap.placed_files().select(F.col("id").alias("file_id"), F.col("shown").alias("path"))
    v = paths.select("n", F.posexplode("ids").alias("place", "id"))
    return v.join(snap.symbols.select("id", "qualified", "file_id"), "id").join(files, "file_id").select("n", "place", "id", "qualified", "path").orderBy("n", "place")
