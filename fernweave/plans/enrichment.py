"""Enrichment as a whole: metrics, descriptions, profiles, moves, merges and splits, new profiles, summaries. Each step's table is written, and one that is there is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.text import parse_answer
from fernweave.graph import Graph
from fernweave.operators import enrich, ranking

PROFILE = "struct<label: string, profile: string>"
MOVES = "array<struct<id: string, to: string>>"
CHANGES = "struct<merges: array<struct<community: string, target: string>>, splits: array<struct<id: string, community: string, new_community: string>>>"
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")  # nothing was written, or a write broke off before its commit


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table in path; where there is none, make()'s rows are written there first."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - any other failure is raised
        if not any(m in str(e) for m in MISSING):
            raise
    rows = make()
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _ask(rows: DataFrame, key: F.Column, answer: Callable[[str], str], schema: str) -> DataFrame:
    """(id, got): a row's answer, the row itself in JSON being the prompt; rows without an answer that parses are left out."""
    prompts = rows.select(key.alias("id"), F.to_json(F.struct(*rows.columns)).alias("prompt"))
    return enrich.ask(prompts, answer).select("id", parse_answer(F.col("answer"), schema).alias("got")).where("got is not null")


def _profiles(inputs: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    return _ask(inputs, F.col("community"), answer, PROFILE).select(F.col("id").alias("community"), "got.label", "got.profile")


def _moves(g: Graph, answer: Callable[[str], str]) -> DataFrame:
    """A chunk of candidates a question; only moves of nodes to communities that there are count."""
    nobody = g.nodes.select("id").limit(0)
    chunks = enrich.routing_inputs(g, nobody).groupBy("community", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "label", "type", "adjacent"))).alias("nodes"))  # CHUNK nodes
    asked = _ask(chunks, F.concat_ws("#", F.coalesce("community", F.lit(enrich.NONE)), F.col("chunk").cast("string")), answer, MOVES)
    rows = asked.select(F.posexplode("got").alias("ord", "m")).select("m.id", "m.to", "ord")
    there = g.nodes.where("community is not null").select(F.col("community").alias("to")).distinct()
    return rows.join(there, "to", "left_semi").join(g.nodes.select("id"), "id", "left_semi").select("id", "to", "ord")


def _changes(g: Graph, moves: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """One question on the whole: the pairs with most edges between them, what communities gain, the ones that are too large."""
    parts = enrich.restructure_inputs(g, moves)
    one = [p.agg(F.array_sort(F.collect_list(F.struct(*p.columns))).alias(n)) for p, n in zip(parts, ("pairs", "gained", "large"), strict=True)]  # a row a community at most
    return _ask(one[0].crossJoin(F.broadcast(one[1])).crossJoin(F.broadcast(one[2])), F.lit("all"), answer, CHANGES).select("got.*")  # one row each


def enrich_graph(g: Graph, path: str, answer: dict[str, Callable[[str], str]] | None = None, threshold: float = enrich.THRESHOLD) -> dict[str, DataFrame]:
    """All steps over a graph, each a table under path, by name; a table that is there already is not made again, so a run goes on where one broke off.

    answer has callables, prompt to JSON, for profiles, moves and changes (merges and splits); a step without one is done by rule: profiles are sentences on size,
    directory and hubs, nothing moves, and communities stay as they are.
    """
    spark, answer = g.nodes.sparkSession, answer or {}
    out: dict[str, DataFrame] = {}

    def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        out[name] = kept(spark, f"{path}/{name}", make)
        return out[name]

    def plain(h: Graph) -> DataFrame:
        return ranking.summaries(h).select("community", F.concat(F.lit("Community "), "community").alias("label"), F.col("summary").alias("profile"))

    step("metrics", lambda: enrich.boundary_metrics(g, threshold))
    step("density", lambda: enrich.community_density(g))
    described = g.nodes.join(ranking.total_degree(g), "id", "left").fillna(0, ["degree"])
    step("descriptions", lambda: ranking.describe(described).select("id", "description"))
    profiles = step("profiles", lambda: _profiles(enrich.profile_inputs(g), answer["profiles"]) if "profiles" in answer else plain(g))
    moves = step("moves", lambda: _moves(g, answer["moves"]) if "moves" in answer else spark.createDataFrame([], "id string, to string, ord int"))
    changes = step("changes", lambda: _changes(g, moves, answer["changes"]) if "changes" in answer else spark.createDataFrame([], CHANGES))
    merges = changes.select(F.posexplode("merges").alias("ord", "m")).select("m.*", "ord")
    splits = changes.select(F.posexplode("splits").alias("ord", "s")).select("s.*", "ord")
    routed = step("routed", lambda: enrich.apply_routing(g, moves, merges, splits))
    after = Graph(g.nodes.drop("community").join(routed.select("id", "community"), "id"), g.edges)

    def again() -> DataFrame:
        inputs = enrich.reprofile_inputs(g, routed)
        return _profiles(inputs, answer["profiles"]) if "profiles" in answer else plain(after).join(inputs.select("community"), "community", "left_semi")

    updated = step("updated_profiles", again)
    step("summaries", lambda: enrich.finalize(after, profiles, updated))
    return out
