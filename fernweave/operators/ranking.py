"""Degrees, hotspots, hubs, reports and what the graph page needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.text import basename, dirname, extension
from fernweave.graph import Graph, order

METRICS = ("degree", "in_degree", "out_degree", "betweenness")
#: Node types from most to least telling for a summary.
TYPE_PRIORITY = {"class": 3, "module": 2, "function": 1}
FILE_TYPES = ("module", "document", "diagram")


def hotspots(g: Graph, top_n: int = 10, metric: str = "degree") -> DataFrame:
    """The nodes with most of a metric; an unknown one counts as degree."""
    metric = metric if metric in METRICS else "degree"
    nodes = g.with_degrees().withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return nodes.orderBy(F.desc(metric), *order()).limit(top_n).select("id", "label", "type", "source_file", "repo", "in_degree", "out_degree", "degree", "betweenness")


def total_degree(g: Graph) -> DataFrame:
    """(id, degree) of every end of an edge."""
    return g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(g: Graph) -> DataFrame:
    """One row: nodes, edges, different repositories, files and communities."""
    n = g.nodes.agg(*[F.count(F.lit(1)).alias("node_count"), *[F.countDistinct(c).alias(a) for c, a in (("repo", "repo_count"), ("source_file", "file_count"), ("community", "community_count"))]])
    return n.crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edge_count")))  # one row each


def edge_types(g: Graph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def cross_repo_flows(g: Graph) -> DataFrame:
    """Edges between repositories, counted by both."""
    flows = g.ends("repo").where(F.col("src_repo") != F.col("dst_repo"))
    return flows.groupBy("src_repo", "dst_repo").agg(F.count(F.lit(1)).alias("n"))


def file_types(g: Graph) -> DataFrame:
    """Different files of file-level nodes, by extension."""
    files = g.nodes.where(F.col("type").isin(*FILE_TYPES)).select("source_file").where("source_file is not null").distinct()
    return files.groupBy(extension(F.col("source_file")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def community_sizes(g: Graph, top: int | None = 20) -> DataFrame:
    sizes = g.nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community")
    return sizes.limit(top) if top else sizes


def community_members(g: Graph, community: str) -> DataFrame:
    """A community's nodes by total degree."""
    own = g.nodes.where(F.col("community") == community)
    return own.join(total_degree(g), "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), *order()).select("id", "label", "type", "source_file", "degree")


def god_nodes(g: Graph, top: int = 15) -> DataFrame:
    """The report's nodes of highest degree; a file-level node is called by its file."""
    name = F.when(F.col("type").isin(*FILE_TYPES), F.coalesce("source_file", "label")).otherwise(F.col("label"))
    return g.nodes.join(total_degree(g), "id").orderBy(F.desc("degree"), name, "id").limit(top).select("id", name.alias("name"), "type", "degree")


def key_members(g: Graph, communities: int = 10, members: int = 5) -> DataFrame:
    """The largest communities with their members of highest degree."""
    largest = F.broadcast(community_sizes(g, communities))  # so many rows
    own = g.nodes.join(largest, "community").join(total_degree(g), "id", "left").fillna(0, ["degree"])
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), *order()))
    return own.withColumn("place", place).where(F.col("place") <= members).select("community", "size", "place", "id", "label", "degree")


def high_degree(g: Graph, threshold: float = 0.8, only_linked: bool = True) -> DataFrame:
    """The top ceil(n * (1 - threshold)) nodes by degree, of those with edges or of all. One aggregated pass finds the cut; no global window is needed."""
    nodes = g.nodes.join(total_degree(g), "id", "inner" if only_linked else "left").fillna(0, ["degree"])
    counts = nodes.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)  # a row a degree
    total = F.sum("n").over(Window.partitionBy())
    cut = counts.select("degree", (F.ceil(total * (F.lit(1.0) - F.lit(float(threshold)))) - F.coalesce(F.sum("n").over(above), F.lit(0))).alias("room"))
    ranked = nodes.join(cut.where("room > 0"), "degree")
    place = F.row_number().over(Window.partitionBy("degree").orderBy(*order()))
    return ranked.withColumn("place", place).where(F.col("place") <= F.col("room")).select("id", "label", "type", "source_file", "degree")


def describe(nodes: DataFrame) -> DataFrame:
    """nodes (with degree) with a sentence each."""
    kind = F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)"))
    where = F.when(F.col("source_file").isNotNull(), F.concat(F.lit(" in "), "source_file")).otherwise(F.lit(""))
    return nodes.withColumn("description", F.concat(kind, F.lit(" with "), F.col("degree").cast("string"), F.lit(" connections"), where, F.lit(".")))


def type_priority(kind: Column) -> Column:
    out = F.lit(0)
    for name, p in TYPE_PRIORITY.items():
        out = F.when(kind == name, p).otherwise(out)
    return out


def hubs(g: Graph, per_community: int = 5) -> DataFrame:
    """Each community's nodes of the most telling types."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(type_priority(F.col("type")).desc(), *order()))
    return g.nodes.where("community is not null").withColumn("place", place).where(F.col("place") <= per_community).select("community", "place", "id", "label", "type")


def primary_path(g: Graph) -> DataFrame:
    """Each community's most frequent directory; the first in order among equals, and the first file's own name if it is the root."""
    files = g.nodes.where("community is not null and source_file is not null").withColumn("dir", dirname(F.col("source_file")))
    counted = files.groupBy("community", "dir").agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("first"))
    best = counted.groupBy("community").agg(F.min(F.struct(-F.col("n"), "first", "dir")).alias("b"))
    return best.select("community", F.when(F.col("b.dir") == "", basename(F.col("b.first"))).otherwise(F.col("b.dir")).alias("primary_path"))


def community_groups(g: Graph, least: int = 3, most: int | None = None) -> DataFrame:
    """Communities of at least so many members."""
    groups = community_sizes(g, None).where(F.col("size") >= least)
    return groups.limit(most) if most else groups


def summaries(g: Graph) -> DataFrame:
    """A sentence a community: size, directory and hubs."""
    top = hubs(g).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), ", ").alias("hubs"))
    rows = community_groups(g).join(primary_path(g), "community", "left").join(top, "community", "left")
    text = F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" nodes"), F.coalesce(F.concat(F.lit(" in "), "primary_path"), F.lit("")), F.coalesce(F.concat(F.lit(": "), "hubs"), F.lit("")), F.lit("."))
    return rows.select("community", "size", text.alias("summary"))


def page_nodes(g: Graph, min_degree: int = 0) -> DataFrame:
    """What the graph page draws: nodes of a least degree with sizes and colours (an index into twenty)."""
    nodes = g.nodes.join(total_degree(g), "id", "left").fillna(0, ["degree"]).where(F.col("degree") >= min_degree)
    size = F.least(F.greatest(F.lit(3.0) + 2 * F.sqrt("degree"), F.lit(3.0)), F.lit(20.0))
    colour = F.coalesce(F.expr("try_cast(community as bigint)"), F.lit(0)) % 20
    return nodes.select("id", "label", "type", "community", "degree", size.alias("size"), colour.alias("colour"))


def page_edges(g: Graph, min_degree: int = 0) -> DataFrame:
    ids = page_nodes(g, min_degree).select("id")
    return g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def meta_edges(g: Graph) -> DataFrame:
    """Directed edges between communities, counted, with their widths."""
    between = g.ends("community").where(F.col("src_community") != F.col("dst_community")).groupBy("src_community", "dst_community").agg(F.count(F.lit(1)).alias("n"))
    return between.withColumn("width", F.least(F.greatest(1 + F.log2(F.col("n") + 1.0), F.lit(1.0)), F.lit(6.0)))


def display_name(community: Column, label: Column) -> Column:
    plain = F.concat(F.lit("Community "), community)
    return F.when(label == plain, label).otherwise(F.concat(label, F.lit(" (community "), community, F.lit(")")))
