"""A node's surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.graph import Graph


def node_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """The edges of nodes (id), either way: (id, direction, type, neighbour, neighbour_label, is_cross_repo, is_external). An unknown neighbour is called by its id.

    Two equi-joins and a union, since an edge can match at either end.
    """
    own = g.nodes.join(ids.select("id"), "id", "left_semi").select("id", F.col("repo").alias("own_repo"))
    out = g.edges.join(own, g.edges["src"] == own["id"]).select("id", "own_repo", F.lit("outgoing").alias("direction"), "type", F.col("dst").alias("neighbour"))
    into = g.edges.join(own, g.edges["dst"] == own["id"]).select("id", "own_repo", F.lit("incoming").alias("direction"), "type", F.col("src").alias("neighbour"))
    other = g.nodes.select(F.col("id").alias("neighbour"), "label", "repo", "source_file")
    found = out.unionAll(into).join(other, "neighbour", "left")
    cross = F.coalesce(F.col("repo").isNotNull() & F.col("own_repo").isNotNull() & (F.col("repo") != F.col("own_repo")), F.lit(False))
    return found.select("id", "direction", "type", "neighbour", F.coalesce("label", "neighbour").alias("neighbour_label"), cross.alias("is_cross_repo"), F.col("source_file").isNull().alias("is_external"))


def node_detail(g: Graph, name: str) -> DataFrame:
    """One row for the node of this id, else of this label: its columns, degrees, and edges by direction and type; none if unknown."""
    from fernweave.operators.search import resolve

    ids = resolve(g, name, fuzzy=False)
    edges = node_edges(g, ids).groupBy("id", "direction", "type").agg(F.array_sort(F.collect_list(F.struct("neighbour", "neighbour_label", "is_cross_repo", "is_external"))).alias("edges"))
    edges = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("direction", "type", "edges"))).alias("edges"))
    return g.with_degrees().join(ids, "id", "left_semi").join(edges, "id", "left")


def neighbours_of(g: Graph, candidates: DataFrame, per_direction: int = 20) -> DataFrame:
    """At most so many edges of each candidate (id) and direction, with both ends' labels; those between two candidates come first."""
    own = candidates.select("id")
    ends = g.ends("label")
    out = ends.join(own, F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.lit(0).alias("way"), "src", "dst", "type", "src_label", "dst_label")
    into = ends.join(own, F.col("dst") == F.col("id"), "left_semi").select(F.col("dst").alias("id"), F.lit(1).alias("way"), "src", "dst", "type", "src_label", "dst_label")
    place = F.row_number().over(Window.partitionBy("id", "way").orderBy("src", "dst", "type"))
    few = out.unionAll(into).withColumn("place", place).where(F.col("place") <= per_direction)
    inside = few.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type").distinct().withColumn("internal", F.lit(True))
    rows = few.select("src", "dst", "type", "src_label", "dst_label").distinct().join(inside, ["src", "dst", "type"], "left").fillna(False, ["internal"])
    return rows.orderBy(F.desc("internal"), "src", "dst", "type")
