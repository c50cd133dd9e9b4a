"""Graphs in JSON and as tables."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.graph import EDGES, NODES, Graph
from fernweave.operators.diff import content_hash

RAW_NODE = (
    "struct<id: string, label: string, type: string, file_type: string, source_file: string, repo: string, community: string, start_line: int, end_line: int, "
    "source_location: string, signature: string, docstring: string, bases: array<string>, decorators: array<string>, tags: array<string>, "
    "properties: struct<signature: string, docstring: string, bases: array<string>, decorators: array<string>, tags: array<string>, methods: array<string>, calls: array<string>>>"
)
RAW_EDGE = "struct<source: string, _src: string, `from`: string, target: string, _tgt: string, `to`: string, type: string, relation: string, confidence: double, confidence_score: double, confidence_value: double>"
RAW = f"nodes array<{RAW_NODE}>, edges array<{RAW_EDGE}>, links array<{RAW_EDGE}>"


def read_graph(spark: SparkSession, path: str, guarded: bool = False) -> Graph:
    """A graph from a JSON file in any of its dialects: edges or links; source, _src or from; target, _tgt or to; type or relation; lines as numbers or as L3-L9."""
    raw = spark.read.schema(RAW).option("multiLine", True).json(path)
    n = raw.select(F.posexplode("nodes").alias("ord", "n"))
    line = lambda k: F.expr(f"try_cast(nullif(regexp_extract(n.source_location, 'L(\\\\d+)(?:-L(\\\\d+))?', {k}), '') as int)")
    pick = lambda c: F.coalesce(f"n.{c}", f"n.properties.{c}").alias(c)
    nodes = n.select(
        "n.id", F.coalesce("n.label", "n.id").alias("label"), F.coalesce("n.type", F.lit("unknown")).alias("type"), "n.file_type", "n.source_file", "n.repo", "n.community",
        F.coalesce("n.start_line", line(1)).alias("start_line"), F.coalesce("n.end_line", line(2), line(1)).alias("end_line"), pick("signature"), pick("docstring"), pick("bases"), pick("decorators"), pick("tags"),
        F.when(F.col("n.properties").isNotNull(), F.to_json("n.properties")).alias("properties"), F.col("ord").cast("long").alias("ord"),
    )
    e = raw.select(F.posexplode(F.coalesce("edges", "links")).alias("ord", "e"))
    edges = e.select(
        F.coalesce("e.source", "e._src", "e.from").alias("src"), F.coalesce("e.target", "e._tgt", "e.to").alias("dst"), F.coalesce("e.type", "e.relation").alias("type"),
        F.coalesce("e.confidence_score", "e.confidence_value", "e.confidence").alias("confidence"), F.lit(None).cast("string").alias("properties"), F.col("ord").cast("long").alias("ord"),
    )
    g = Graph(nodes, edges)
    return g.guarded() if guarded else g


def write_tables(g: Graph, path: str, skip_same: bool = True) -> bool:
    """nodes, edges and meta as Parquet under path; False, and nothing written, if they hold the same rows already."""
    spark = g.nodes.sparkSession
    prints = [tuple(map(str, content_hash(df).first())) for df in (g.nodes, g.edges)]
    if skip_same:
        try:
            old = spark.read.parquet(f"{path}/meta").where("key = 'fingerprint'").first()
            if old and old["value"] == json.dumps(prints):
                return False
        except Exception as e:  # noqa: BLE001 - no table there yet is the one failure expected
            if "PATH_NOT_FOUND" not in str(e):
                raise
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    built = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    meta = [("fingerprint", json.dumps(prints)), ("node_count", prints[0][0]), ("edge_count", prints[1][0]), ("built_at", built)]
    spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return True


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def read_table_metadata(spark: SparkSession, path: str) -> dict:
    """What write_tables() noted beside the tables; empty where it noted nothing."""
    try:
        return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").parquet(f"{path}/meta").collect()}  # a few rows
    except Exception as e:  # noqa: BLE001 - no table there is the one failure expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}


def as_views(g: Graph) -> None:
    """nodes and edges as temporary views, for spark.sql."""
    g.with_degrees().createOrReplaceTempView("nodes")
    g.edges.createOrReplaceTempView("edges")


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def write_atomically(path: str, text: str) -> None:
    """A small file on the driver: written beside its place, then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(temporary, path)


def write_json(g: Graph, path: str, metadata: dict | None = None) -> bool:
    """The graph as one JSON document on the driver's disk, for tools that read such: metadata in its first line, then a node or an edge a line. False, and nothing
    written, if the document there has the same rows and the same metadata but for built_at.

    Rows pass through the driver a partition at a time. A graph too large for one document is kept by write_tables().
    """
    nodes = g.nodes.select("id", *[c for c in ("label", "type", "file_type", "source_file", "repo", "community", "start_line", "end_line", "signature", "docstring", "bases") if c in g.nodes.columns], F.lower(F.coalesce("label", "id")).alias("norm_label"), *[c for c in ("ord",) if c in g.nodes.columns])
    edges = g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("type", F.lit("unknown")).alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence_score"), *[c for c in ("ord",) if c in g.edges.columns])
    about = {**(metadata or {}), "fingerprint": [list(map(str, content_hash(df).first())) for df in (nodes, edges)]}
    before = read_metadata(path)
    if before is not None and {k: v for k, v in before.items() if k != "built_at"} == json.loads(json.dumps(about)):
        return False
    about["built_at"] = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as f:
        f.write(f'{{"metadata": {json.dumps(about)},\n')
        for name, rows, by in (("nodes", nodes, ["id"]), ("edges", edges, ["source", "target", "relation"])):
            first = [F.col("ord").asc_nulls_last()] if "ord" in rows.columns else []
            lines = rows.orderBy(*first, *by).select(F.to_json(F.struct(*[c for c in rows.columns if c != "ord"])).alias("line"))
            f.write(f'"{name}": [')
            for k, r in enumerate(lines.toLocalIterator()):
                f.write(",\n" if k else "\n")
                f.write(r["line"])
            f.write("]" + ("}\n" if name == "edges" else ",\n"))
    os.replace(temporary, path)
    return True


def read_metadata(path: str) -> dict | None:
    """The metadata of a JSON graph on the driver's disk; None where there is no such file. Of a document of write_json() only the first line is read."""
    try:
        with open(path.removeprefix("file://")) as f:
            first = f.readline()
            try:
                return json.loads(first.rstrip().removesuffix(",") + "}")["metadata"]
            except (json.JSONDecodeError, KeyError, TypeError):
                f.seek(0)
                return json.load(f).get("metadata") or {}
    except (FileNotFoundError, json.JSONDecodeError):
        return None


def to_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges as JSON lines, for files that other tools read."""
    return nodes.select(F.to_json(F.struct("*")).alias("value")), edges.select(F.to_json(F.struct("*")).alias("value"))
