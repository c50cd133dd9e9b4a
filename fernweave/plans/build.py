"""A build: files of repositories to a graph, its outlines and its report, doing again only what changed files need."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.graph import Graph
from fernweave.operators import diff, outline
from fernweave.operators.extract import Extractors
from fernweave.operators.resolve import build_graph
from fernweave.sources import files, graph_json, repos
from fernweave.sources.graph_json import write_atomically
from fernweave.storage import stored


def _state(path: str) -> dict:
    try:
        with open(path) as f:
            return json.load(f)
    except (FileNotFoundError, json.JSONDecodeError):  # no build yet, or half a file: all files are new
        return {}


def extract_changed(read: DataFrame, old_hashes: DataFrame, old: DataFrame | None, extractors: Extractors) -> DataFrame:
    """Extractions of files (path, text, hash): new ones of files that are new or changed, those of an earlier build for the rest."""
    change = stored(diff.file_diff(old_hashes, read.select("path", "hash")), "changes") if old is not None else None
    todo = read if change is None else read.join(change.where("change in ('added', 'changed')").select("path"), "path", "left_semi")
    new = extractors.run(todo)
    if change is None:
        return new
    same = change.where("change = 'unchanged'").select(F.col("path").alias("file_path"))
    return old.join(same, "file_path", "left_semi").unionByName(new)


def build(spark: SparkSession, roots: dict[str, str], out: str, types: dict[str, dict], extractors: Extractors | None = None, max_kb: int | None = 1024, force: bool = False) -> tuple[Graph, dict[str, int]]:
    """The graph of repositories (name to folder), written under out with extractions, outlines and hashes; and how many files were extracted and kept.

    out is a folder that driver and executors share. The extractions of each build are a table of their own, and a small file, written last, names the one that
    counts; so a build that breaks off leaves the one before as it was. Files without an extractor have no extraction and are not counted.
    """
    pointer = os.path.join(out, "build.json")
    state = {} if force else _state(pointer)
    listed = repos.list_repos(spark, roots)
    wanted = files.select_files(listed.select("path", "size"), types, max_kb=max_kb).select("path").distinct()
    read = stored(repos.read_repos(listed.join(wanted, "path", "left_semi"), roots).select("path", "text", "hash"), "sources")
    old = spark.read.parquet(f"{out}/{state['extractions']}") if state else None
    found = extract_changed(read, files.read_hashes(spark, f"{out}/{state['hashes']}") if state else read.limit(0), old, extractors or Extractors())
    name = uuid.uuid4().hex
    found.write.parquet(f"{out}/extractions-{name}")
    found = spark.read.schema(found.schema).parquet(f"{out}/extractions-{name}")
    files.write_hashes(read, f"{out}/hashes-{name}")
    g = build_graph(found, next(iter(roots)) if len(roots) == 1 else None)
    graph_json.write_tables(Graph(stored(g.nodes, "nodes"), stored(g.edges, "edges")), out)  # they are hashed, then written
    outline.write_outlines(found, f"{out}/outlines")
    kept = 0 if old is None else old.join(files.read_hashes(spark, f"{out}/{state['hashes']}").join(read, ["path", "hash"], "left_semi").select(F.col("path").alias("file_path")), "file_path", "left_semi").count()
    write_atomically(pointer, json.dumps({"extractions": f"extractions-{name}", "hashes": f"hashes-{name}"}))
    return graph_json.read_tables(spark, out), {"extracted": found.count() - kept, "kept": kept}
