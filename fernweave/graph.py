"""The property graph: two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a step along an edge of each type costs; other types cost 1.
EDGE_WEIGHTS = {"calls": 1.0, "imports": 0.5, "imports_from": 0.5, "extends": 0.8, "contains": 0.3, "references": 0.4}

NODES = (
    "id string, label string, type string, file_type string, source_file string, repo string, community string, start_line int, end_line int, "
    "signature string, docstring string, bases array<string>, decorators array<string>, tags array<string>, properties string, ord long"
)
EDGES = "src string, dst string, type string, confidence double, properties string, ord long"


@dataclass(frozen=True)
class Graph:
    """nodes (id, label, type, source_file, repo, community, ... ord) and edges (src, dst, type, ... ord).

    ord is the place in the input, null for tables without one; order is always by (ord, id), so it is total and does not depend on partitions.
    """

    nodes: DataFrame
    edges: DataFrame

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) of every end of an edge, in one aggregation."""
        ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
        return self.edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))

    def with_degrees(self) -> DataFrame:
        """nodes with in_degree, out_degree and betweenness, the product of both over the number of edges."""
        n = self.edges.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_n"))
        ranked = self.nodes.join(self.degrees(), "id", "left").fillna(0, ["in_degree", "out_degree"]).crossJoin(F.broadcast(n))  # one row
        return ranked.withColumn("betweenness", F.col("in_degree") * F.col("out_degree") / F.col("_n").cast("double")).drop("_n")

    def guarded(self) -> Graph:
        """One node an id, the first, and no edges whose ends are no nodes, that join a node with itself, or repeat (src, dst, type)."""
        ids = self.nodes.select("id")
        edges = self.edges.where("src <> dst").dropDuplicates(["src", "dst", "type"])
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        first = [F.col(c).asc_nulls_last() for c in ("ord", "label", "type", "source_file") if c in self.nodes.columns]
        place = F.row_number().over(Window.partitionBy("id").orderBy(*first))
        return Graph(self.nodes.withColumn("_k", place).where("_k = 1").drop("_k"), edges.select(*self.edges.columns))

    def ends(self, *columns: str) -> DataFrame:
        """edges with the named columns of both ends as src_<name> and dst_<name>; edges without both ends are dropped."""
        side = lambda p: self.nodes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
        return self.edges.join(side("src"), "src").join(side("dst"), "dst")

    def adjacency(self) -> DataFrame:
        """(id, out: the targets and types of a node's edges)."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "type"))).alias("out"))


def weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    """The cost of an edge by its type."""
    out = F.lit(1.0)
    for name, w in (weights or EDGE_WEIGHTS).items():
        out = F.when(kind == name, F.lit(float(w))).otherwise(out)
    return out


def order(*, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}ord").asc_nulls_last(), F.col(f"{prefix}id")]
