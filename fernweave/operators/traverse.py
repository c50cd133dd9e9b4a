"""Breadth-first traversals and shortest paths, a set of nodes at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.text import is_test_file
from fernweave.graph import Graph, weight
from fernweave.storage import stored

DEFAULT_TYPES = ("calls", "imports", "imports_from", "extends", "contains")
STEP = "struct<ord: bigint, id: string, type: string>"


def _steps(g: Graph, direction: str) -> DataFrame:
    """(id, next, type, step): an edge seen from a node, and its place among that node's edges: outgoing ones by (target, type), incoming ones as they came."""
    e = g.edges
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("next"), "type", F.struct(F.lit(None).cast("long").alias("ord"), F.col("dst").alias("id"), "type").alias("step"))
    into = e.select(F.col("dst").alias("id"), F.col("src").alias("next"), "type", F.struct("ord", F.col("src").alias("id"), "type").alias("step"))
    return {"downstream": out, "upstream": into, "both": out.unionAll(into)}[direction]


def _expand(g: Graph, steps: DataFrame, start: DataFrame, max_depth: int, passes: Column, label: str) -> DataFrame | None:
    """Each node within max_depth of start (id): depth, edge_type, via (the node before), path. Nodes for which passes fails are neither reported nor gone through.

    A node is found by the first of its shortest paths, in the order in which a queue would take them: paths compare step by step. A level is one join, one
    anti-join and one aggregation; it is written before the next begins.
    """
    steps = stored(steps, f"{label}-steps")  # every level reads them again
    front = stored(start.select("id", F.array().cast(f"array<{STEP}>").alias("path")), f"{label}-start")
    known = stored(g.nodes.select("id", "label", "type", "source_file", "repo"), f"{label}-nodes")
    seen, out = front.select("id"), None
    for depth in range(1, max_depth + 1):
        met = front.join(steps, "id").select("next", F.concat("path", F.array(F.col("step").cast(STEP))).alias("path"), "type", F.col("id").alias("via"))
        new = met.join(seen.withColumnRenamed("id", "next"), "next", "left_anti").groupBy("next").agg(F.min(F.struct("path", "type", "via")).alias("f"))
        new = new.select(F.col("next").alias("id"), "f.path", F.col("f.type").alias("edge_type"), "f.via")
        new = stored(new.join(known, "id", "left").withColumn("ok", F.col("label").isNotNull() & passes).withColumn("depth", F.lit(depth)), f"{label}-{depth}")
        seen = seen.unionAll(new.select("id"))
        reported = new.where("ok").drop("ok")
        out = reported if out is None else out.unionAll(reported)
        front = reported.select("id", "path")
        if front.isEmpty():
            break
    return out


def impact(g: Graph, start: str, direction: str = "both", max_depth: int = 3, include_tests: bool = False) -> DataFrame:
    """What a node (by id) affects, downstream, and what affects it, upstream: (direction, depth, id, label, type, source_file, repo, edge_type, via).

    Each node is given once a direction, at its least depth, with the type of the first edge that finds it and, from depth 2 on, the label of the node before.
    Tests are not gone through unless asked for.
    """
    spark, out = g.nodes.sparkSession, None
    begin = g.nodes.where(F.col("id") == start).select("id")
    passes = F.lit(True) if include_tests else ~is_test_file(F.col("source_file"))
    labels = g.nodes.select(F.col("id").alias("via"), F.col("label").alias("via_label"))
    for way in ("upstream", "downstream") if direction == "both" else (direction,):
        found = _expand(g, _steps(g, way), begin, max_depth, passes, way)
        if found is None:
            continue
        found = found.join(labels, "via", "left").select(F.lit(way).alias("direction"), "depth", "id", "label", "type", "source_file", "repo", "edge_type", F.when(F.col("depth") > 1, F.col("via_label")).alias("via"))
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "direction string, depth int, id string, label string, type string, source_file string, repo string, edge_type string, via string")


def path_edge_types(path: DataFrame) -> DataFrame:
    """How many of a path's steps are edges of each type."""
    return path.where("edge_type is not null").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def cross_repo_impact(g: Graph, start: str, found: DataFrame) -> DataFrame:
    """Found nodes of other repositories, counted by them; a node in both directions counts twice."""
    own = g.nodes.where(F.col("id") == start).select(F.col("repo").alias("own"))
    return found.crossJoin(F.broadcast(own)).where("repo is not null and repo <> own").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))  # own: one row


def bfs_context(g: Graph, hits: DataFrame, depth: int, top: int = 3) -> DataFrame:
    """Around the first hits (id, rank), edges taken either way: (id, label, depth, edge_type, via) of every node found."""
    start = hits.orderBy("rank").limit(top).select("id")
    found = _expand(g, _steps(g, "both"), start, depth, F.lit(True), "context")
    if found is None:  # a depth of none finds none
        return g.nodes.sparkSession.createDataFrame([], "id string, label string, type string, depth int, edge_type string, via string")
    return found.select("id", "label", "type", "depth", "edge_type", "via")


def dfs_context(g: Graph, hits: DataFrame, depth: int, top: int = 3, most: int = 100_000) -> list[tuple[str, str, str]]:
    """Edges (src, type, dst) in the order a stack visits them around the first hits, the best first. A node's outgoing edges come by (target, type), then its
    incoming ones as they came. The part of the graph within depth is found as in bfs_context(), and the walk itself is the driver's; more than so many edges
    there are refused."""
    best = [r["id"] for r in hits.orderBy("rank").limit(top).collect()]
    found = bfs_context(g, hits, depth, top).select("id").unionAll(hits.orderBy("rank").limit(top).select("id")).distinct()
    e = g.edges.where("src <> dst")
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("next"), "type", F.lit(0).alias("way"), F.lit(0).cast("long").alias("ord"))
    into = e.select(F.col("dst").alias("id"), F.col("src").alias("next"), "type", F.lit(1).alias("way"), "ord")
    ends = g.nodes.select(F.col("id").alias("next"))
    near = out.unionAll(into).join(found, "id", "left_semi").join(ends, "next", "left_semi").limit(most + 1).collect()
    if len(near) > most:
        raise ValueError(f"more than {most} edges lie within depth {depth}")
    edges: dict[str, list] = {}
    for r in sorted(near, key=lambda r: (r["way"], r["ord"] or 0, r["next"], r["type"])):
        edges.setdefault(r["id"], []).append((r["way"], r["type"], r["next"]))
    stack = [(node, 0) for node in reversed(best)]
    seen, walk = set(), []
    while stack:
        node, d = stack.pop()
        if node in seen or d > depth:
            continue
        seen.add(node)
        for way, kind, other in edges.get(node, []):
            if other not in seen:
                walk.append((other, kind, node) if way else (node, kind, other))
                stack.append((other, d + 1))
    return walk


def shortest_path(g: Graph, start: str, goal: str, max_depth: float = 10, edge_types: tuple[str, ...] = DEFAULT_TYPES, weights: dict[str, float] | None = None, rounds: int = 1000) -> DataFrame:
    """The cheapest path along outgoing edges: (step, id, label, source_file, edge_type, cost), empty if there is none. A node that costs max_depth is not left.

    Rounds of relaxing the edges of the nodes that improved; it ends when none did or none can beat the goal. A round is a join and an aggregation; it writes
    the nodes that improved, and what is known so far is all of them together.
    """
    spark: SparkSession = g.nodes.sparkSession
    schema = "step int, id string, label string, source_file string, edge_type string, cost double"
    names = g.nodes.select("id", "label", "source_file")
    edges = g.edges.where(F.col("type").isin(*edge_types)).select("src", "dst", "type", weight(F.col("type"), weights).alias("w"))
    row = "id string, cost double, prev string, edge_type string"
    if g.nodes.where(F.col("id").isin(start, goal)).select("id").distinct().count() < len({start, goal}):
        return spark.createDataFrame([], schema)
    best = front = spark.createDataFrame([(start, 0.0, None, None)], row)
    target = None
    if start != goal:
        edges = stored(edges, "path-edges")  # every round reads them again
    for k in range(rounds if start != goal else 0):
        met = front.where(F.col("cost") < max_depth).join(edges, front["id"] == edges["src"]).groupBy("dst").agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("prev"), "type")).alias("m"))
        met = met.select(F.col("dst").alias("id"), "m.cost", "m.prev", F.col("m.type").alias("edge_type"))
        old = best.groupBy("id").agg(F.min("cost").alias("old"))
        front = stored(met.join(old, "id", "left").where("old is null or cost < old").drop("old"), f"front-{k}")
        best = best.unionAll(front)
        least, at_goal = front.agg(F.min("cost"), F.min(F.when(F.col("id") == goal, F.col("cost")))).first()
        target = target if at_goal is None else at_goal
        if least is None or (target is not None and least >= target):
            break
    else:
        if start != goal:
            raise RuntimeError(f"the costs did not settle in {rounds} rounds")
    path, at = [], goal
    while at is not None:  # at most a row a step
        found = best.where(F.col("id") == at).orderBy("cost").first()
        if found is None:
            return spark.createDataFrame([], schema)
        path.append((found["id"], found["edge_type"], found["cost"]))
        at = found["prev"]
    steps = spark.createDataFrame([(i, *p) for i, p in enumerate(reversed(path))], "step int, id string, edge_type string, cost double")
    return names.join(F.broadcast(steps), "id").select("step", "id", "label", "source_file", "edge_type", "cost").orderBy("step")
