"""Search by terms, names and symbols."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.text import contains_like, sanitise, terms
from fernweave.graph import Graph, order

DOC_TYPES = ("document", "diagram", "section")


def _every_term(words: list[str], columns: list[str]) -> Column:
    """Each term is in one of the columns; of properties only the values count, not their names."""
    values = {"properties": F.regexp_replace("properties", r'"[^"]*"\s*:', " ")}
    return reduce(and_, [reduce(or_, [contains_like(values.get(c, F.col(c)), w) for c in columns]) for w in words])


def with_in_degree(g: Graph, nodes: DataFrame) -> DataFrame:
    """nodes with in_degree, counting only edges into them."""
    n = g.edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(n, "id", "left").fillna(0, ["in_degree"])


def search_nodes(g: Graph, query: str, top_k: int = 10, repo: str | None = None, type: str | None = None) -> DataFrame:
    """The nodes in which each of the query's terms is in the label, type, file, community or properties; those with the first term in the label come first,
    then the nodes with most edges into them. rank is negative, the best the smallest."""
    words = terms(query)
    nodes = g.nodes if words else g.nodes.limit(0)
    if repo:
        nodes = nodes.where(F.col("repo") == repo)
    if type and type != "all":
        nodes = nodes.where(F.col("type") == type)
    if words:
        nodes = nodes.where(_every_term(words, ["label", "type", "source_file", "community", "properties"]))
    first = contains_like(F.col("label"), words[0] if words else "")
    hits = with_in_degree(g, nodes).orderBy(F.when(first, 0).otherwise(1), F.desc("in_degree"), *order()).limit(top_k)
    place = Window.orderBy(F.when(first, 0).otherwise(1), F.desc("in_degree"), *order())  # top_k rows
    ranked = hits.withColumn("rank", F.row_number().over(place) - 1 - F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.select("id", "label", "type", "source_file", "repo", "community", "in_degree", F.col("rank").cast("long").alias("rank"))


def fuzzy_match(g: Graph, name: str, top_k: int = 3) -> DataFrame:
    """The nodes whose label holds every part of a name, parted at white space and underscores; most edges into them first. No parts match nothing."""
    parts = [p for w in sanitise(name).lower().split() for p in w.split("_") if p]
    nodes = g.nodes.where(_every_term(parts, ["label"])) if parts else g.nodes.limit(0)
    return with_in_degree(g, nodes).orderBy(F.desc("in_degree"), *order()).limit(top_k).select("id", "label", "type", "source_file", "in_degree")


def resolve(g: Graph, symbol: str, fuzzy: bool = True) -> DataFrame:
    """At most one row (id): the node with this id, else this label, else the best fuzzy match."""
    exact = g.nodes.where((F.col("id") == symbol) | (F.col("label") == symbol))
    exact = exact.select("id", "ord", F.when(F.col("id") == symbol, 0).otherwise(1).alias("p")).orderBy("p", *order()).limit(1).select("id", "p")
    if not fuzzy:
        return exact.select("id")
    return exact.union(fuzzy_match(g, symbol, 1).select("id", F.lit(2).alias("p"))).orderBy("p").limit(1).select("id")


def search_docs(g: Graph, query: str, top_k: int = 10, repo: str | None = None) -> DataFrame:
    """Documents, diagrams and sections in which each term, taken as it is, is in the label, file or properties; by label."""
    words = query.lower().split()
    nodes = g.nodes.where(F.col("type").isin(*DOC_TYPES))
    if repo:
        nodes = nodes.where(F.col("repo") == repo)
    nodes = nodes.where(_every_term(words, ["label", "source_file", "properties"])) if words else nodes.limit(0)
    return nodes.orderBy("label", *order()).limit(top_k).select("id", "label", "type", "source_file", "repo")


def linked_code(g: Graph, docs: DataFrame, limit: int = 10, not_types: tuple[str, ...] = ("document", "section")) -> DataFrame:
    """The different nodes that edges from docs (id) lead to, but for documents and sections; a diagram counts as code."""
    targets = g.edges.join(docs.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    found = g.nodes.join(targets, "id", "left_semi").where(~F.col("type").isin(*not_types))
    return found.orderBy("label", *order()).limit(limit).select("id", "label", "type", "source_file")


def suggestions(g: Graph, name: str) -> DataFrame:
    """What a name may have meant: 'label (type, file)'."""
    return fuzzy_match(g, name).select(F.format_string("%s (%s, %s)", "label", "type", F.coalesce("source_file", F.lit("unknown"))).alias("suggestion"))
