"""The tools: one call a question, over a graph, its vectors and its files. Each returns a DataFrame but for texts."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fernweave.graph import Graph
from fernweave.functions.text import grouped_number
from fernweave.operators import detail, extract, outline, ranking, search, traverse, vectors
from fernweave.sources import graph_json, repos

TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "number"}, {"type": "boolean"}


def _tool(method: str, about: str, needs: tuple[str, ...] = (), **arguments: dict) -> dict:
    return {"method": method, "description": about, "schema": {"type": "object", "properties": arguments, "required": list(needs)}}


#: The tools' names and the names of their arguments.
TOOLS = {
    "graph_search": _tool("search", "Nodes by words", ("query",), query=TEXT, top_k=NUMBER, repo=TEXT, type=TEXT, context_depth=NUMBER, context_mode=TEXT),
    "graph_impact": _tool("impact", "What a symbol affects and is affected by", ("symbol",), symbol=TEXT, direction=TEXT, max_depth=NUMBER, include_tests=FLAG),
    "graph_outline": _tool("outline", "A file's symbols", ("file_path",), file_path=TEXT, format=TEXT),
    "graph_path": _tool("path", "The cheapest path between two symbols", ("from", "to"), **{"from": TEXT, "to": TEXT}, max_depth=NUMBER, edge_types={"type": "array", "items": TEXT}),
    "graph_explain": _tool("explain", "A symbol and its edges", ("symbol",), symbol=TEXT, include_code=FLAG),
    "graph_community": _tool("community", "A community's members", ("community_id",), community_id=TEXT),
    "graph_hotspots": _tool("hotspots", "The nodes with most edges", top_n=NUMBER, metric=TEXT),
    "graph_similar": _tool("similar", "The nodes nearest to a text by their vectors", ("query",), query=TEXT, top_k=NUMBER, type=TEXT, repo=TEXT),
    "graph_context": _tool("context", "What a question needs, within a budget of tokens", ("query",), query=TEXT, max_tokens=NUMBER, scope=TEXT, include_source=FLAG, format=TEXT),
    "graph_docs": _tool("docs", "Documents and the code they name", ("query",), query=TEXT, top_k=NUMBER, repo=TEXT),
    "graph_status": _tool("status_text", "What the graph holds"),
}
RENAMED = {"from": "start", "to": "goal", "community_id": "community"}
KINDS = {"string": str, "number": (int, float), "boolean": bool, "array": list}
OUTLINES_HELD = 100


@dataclass
class Workspace:
    """A graph with what else was built for it: vectors (id, type, repo, vector), extractions or a table for outlines, a query encoder, the repositories' folders, metadata."""

    graph: Graph
    vectors: DataFrame | None = None
    extractions: DataFrame | None = None
    encode: object = None
    outlines_path: str | None = None
    repos: dict[str, str] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    _held: OrderedDict = field(default_factory=OrderedDict, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Workspace:
        """From a JSON graph or from tables."""
        if path.endswith(".json"):
            return cls(graph_json.read_graph(spark, path, guarded=True), metadata=graph_json.read_metadata(path) or {})
        return cls(graph_json.read_tables(spark, path), metadata=graph_json.read_table_metadata(spark, path))

    def call(self, tool: str, arguments: dict | None = None) -> dict:
        """A tool by name, as servers get it: {"rows": a table, or what the method gives} or {"error": why not}."""
        known, given = TOOLS.get(tool), arguments or {}
        if known is None:
            return {"error": f"unknown tool: {tool}"}
        properties = known["schema"]["properties"]
        wrong = [f"{n} is needed" for n in known["schema"]["required"] if given.get(n) in (None, "")]
        wrong += [f"{n} is no argument" for n in given if n not in properties]
        for n, v in given.items():
            kind = KINDS.get(properties.get(n, {}).get("type"))
            if kind and v is not None and (not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool)):
                wrong.append(f"{n} is a {properties[n]['type']}")
        if wrong:
            return {"error": "; ".join(wrong)}
        try:
            return {"rows": getattr(self, known["method"])(**{RENAMED.get(n, n): v for n, v in given.items() if v is not None})}
        except Exception as e:  # noqa: BLE001 - a server answers with the cause
            return {"error": f"{type(e).__name__}: {e}"}

    def search(self, query: str, top_k: int = 10, repo: str | None = None, type: str | None = None, context_depth: int = 0, context_mode: str = "bfs"):
        """Hits; with a depth, a pair: hits and what lies around the first three, nodes by breadth or edges in depth-first order."""
        if not query.strip():
            raise ValueError("a query is needed")
        hits = search.search_nodes(self.graph, query, top_k, repo, type)
        if not context_depth:
            return hits
        return hits, (traverse.dfs_context if context_mode == "dfs" else traverse.bfs_context)(self.graph, hits, context_depth)

    def _resolve(self, symbol: str, fuzzy: bool = True) -> str | None:
        row = search.resolve(self.graph, symbol, fuzzy).first()
        return row["id"] if row else None

    def impact(self, symbol: str, direction: str = "both", max_depth: int = 3, include_tests: bool = False) -> DataFrame:
        """What a symbol affects and what affects it; for an unknown one, suggestions."""
        found = self._resolve(symbol)
        return traverse.impact(self.graph, found, direction, max_depth, include_tests) if found else search.suggestions(self.graph, symbol)

    def path(self, start: str, goal: str, max_depth: float = 10, edge_types: tuple[str, ...] = traverse.DEFAULT_TYPES) -> DataFrame:
        """The cheapest path between two symbols; empty if one is unknown or there is none."""
        return traverse.shortest_path(self.graph, self._resolve(start) or "", self._resolve(goal) or "", max_depth, edge_types)

    def explain(self, symbol: str, include_code: bool = False) -> DataFrame:
        """A node with its edges and, if asked for, its file's outline (null without one); for an unknown one, suggestions."""
        rows = detail.node_detail(self.graph, symbol)
        found = rows.select("source_file").first()
        if found is None:
            return search.suggestions(self.graph, symbol)
        return rows.withColumn("outline", F.lit(self.outline(found["source_file"])).cast("string")) if include_code else rows

    def community(self, community: str) -> DataFrame:
        """A community's members; for an unknown one, the largest communities."""
        rows = ranking.community_members(self.graph, community)
        return ranking.community_sizes(self.graph) if rows.isEmpty() else rows

    def hotspots(self, top_n: int = 10, metric: str = "degree") -> DataFrame:
        return ranking.hotspots(self.graph, top_n, metric)

    def similar(self, query: str | list[float], top_k: int = 10, type: str | None = None, repo: str | None = None) -> DataFrame:
        """The nearest nodes to a vector, or to a text by the workspace's encoder."""
        if self.vectors is None:
            raise ValueError("there are no vectors")
        rows = self.vectors
        for column, value in (("type", type), ("repo", repo)):
            if value:
                rows = rows.where(F.col(column) == value)
        return vectors.similar(rows, query if isinstance(query, list) else self.encode(query), top_k)

    def context(self, query: str, max_tokens: int = 4096, scope: str | None = None, include_source: bool = False, format: str = "rows") -> DataFrame | str | dict[str, DataFrame]:
        """The sections of a context within a budget of tokens; scope is a repository. format: rows, narrative (one text) or structured (a table a section)."""
        if format not in ("rows", "narrative", "structured"):
            raise ValueError("format is one of rows, narrative, structured")
        near = self.similar(query, 30, repo=scope).select("id", "score") if self.vectors is not None and self.encode else None
        entries = None
        if include_source and self.extractions is not None:
            entries = self.extractions.select("file_path", F.explode("symbols").alias("s")).select("file_path", *[f"s.{c}" for c in ("name", "start_line", "signature")])
        if format == "structured":
            parts = vectors.context_parts(self.graph, query, near, scope, entries)
            parts["candidates"] = parts["candidates"].where("place <= 20")
            return parts if include_source else {k: v for k, v in parts.items() if k != "source"}
        rows = vectors.build_context(self.graph, query, max_tokens, near, scope, include_source, entries)
        return rows if format == "rows" else vectors.context_text(rows)

    def docs(self, query: str, top_k: int = 10, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Documents and sections, and the code that they link to."""
        hits = search.search_docs(self.graph, query, top_k, repo)
        return hits, search.linked_code(self.graph, hits)

    def status(self) -> DataFrame:
        return ranking.graph_stats(self.graph)

    def status_text(self) -> str:
        """The status in words: when it was built, counts, repositories, what else there is."""
        row = self.status().select("repo_count", *[grouped_number(F.col(c)).alias(c) for c in ("node_count", "edge_count")]).first()
        names = sorted(r["name"] if isinstance(r, dict) else r for r in self.metadata.get("repos") or self.repos)
        out = ["## Graph status", ""]
        out += [f"Built: {self.metadata['built_at']}"] if self.metadata.get("built_at") else []
        out += [f"Nodes: {row['node_count']} | Edges: {row['edge_count']}"]
        out += [f"Repositories: {len(names) or row['repo_count']}" + (f" ({', '.join(names)})" if names else "")]
        out += ["Outlines: written"] if self.outlines_path else []
        out += [f"Vectors: {self.metadata.get('embeddings') or ('there' if self.vectors is not None else 'none')}"]
        return "\n".join(out)

    def _outline_row(self, file_path: str) -> Row | None:
        """A file's outline: of the last ones asked for, from the table, from the extractions, or from the file itself."""
        if self.outlines_path and (row := outline.read_outline(self.graph.nodes.sparkSession, self.outlines_path, file_path)):
            return row
        if self.extractions is not None and (row := outline.outlines(self.extractions.where(F.col("file_path") == file_path)).first()):
            return row
        there = repos.located(file_path, self.repos, ".")["absolute"]
        if there is None:
            return None
        with open(there, encoding="utf-8", errors="replace") as f:
            text = f.read()
        known = extract.Extractors()
        known.register([".py"], outline.with_fallback(extract.extract_python))
        return outline.outlines(known.run(self.graph.nodes.sparkSession.createDataFrame([(file_path, text)], "path string, text string"))).first()

    def outline(self, file_path: str | None, format: str = "markdown") -> str | None:
        """A file's outline as text or JSON; None for a file that is not known."""
        if not file_path:
            return None
        row = self._held.pop(file_path, None) or self._outline_row(file_path)
        if row is None:
            return None
        self._held[file_path] = row
        while len(self._held) > OUTLINES_HELD:
            self._held.popitem(last=False)
        return outline.as_json(row) if format == "json" else outline.as_markdown(row)

    def sql(self, text: str) -> DataFrame:
        """Any SQL over the views nodes and edges."""
        graph_json.as_views(self.graph)
        return self.graph.nodes.sparkSession.sql(text)
