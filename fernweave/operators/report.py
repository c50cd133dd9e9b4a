"""The report: small aggregates, put into words on the driver."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.graph import Graph
from fernweave.operators import ranking


def _table(head: list[str], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(str(x) for x in r) + " |" for r in rows], ""]


def markdown(g: Graph, title: str = "Graph report") -> str:
    """Counts, file types, edge types, flows between repositories, nodes of highest degree and the largest communities."""
    stats = ranking.graph_stats(g).first()
    out = [f"# {title}", "", *_table(["what", "number"], [(k.replace("_count", "s").replace("repositorys", "repositories"), stats[k]) for k in ("node_count", "edge_count", "file_count", "repo_count", "community_count")])]
    out += ["## Edges", "", *_table(["type", "edges"], [(r["type"], r["n"]) for r in ranking.edge_types(g).orderBy("n", ascending=False).collect()])]
    kinds = ranking.file_types(g).orderBy("n", ascending=False).limit(30).collect()
    if kinds:
        out += ["## Files", "", *_table(["ending", "files"], [(r["extension"] or "none", r["n"]) for r in kinds])]
    flows = ranking.cross_repo_flows(g).orderBy("n", ascending=False).limit(50).collect()
    if flows:
        out += ["## Between repositories", "", *_table(["from", "to", "edges"], [tuple(r) for r in flows])]
    out += ["## Nodes of highest degree", "", *_table(["name", "type", "degree"], [(r["name"], r["type"], r["degree"]) for r in ranking.god_nodes(g).collect()])]
    members: dict = {}
    for r in ranking.key_members(g).orderBy("size", "community", "place", ascending=[False, True, True]).collect():
        members.setdefault((r["community"], r["size"]), []).append(r["label"])
    if members:
        out += ["## Largest communities", "", *_table(["community", "nodes", "key members"], [(c, n, ", ".join(m)) for (c, n), m in members.items()])]
    return "\n".join(out)


PAGE = """<!doctype html><meta charset="utf-8"><title>%s</title>
<style>body{margin:0;font:14px sans-serif}#q{position:fixed;left:1em;top:1em}#n{position:fixed;left:1em;bottom:1em;background:#fffc}</style>
<canvas id="c"></canvas><input id="q" placeholder="find"><div id="n"></div>
"""
SCRIPT = """<script>
const at = new Map(nodes.map((n, i) => [n.id, i])), c = document.getElementById("c"), g = c.getContext("2d"), q = document.getElementById("q"), note = document.getElementById("n");
nodes.sort((a, b) => (a.colour - b.colour) || (a.id < b.id ? -1 : 1)); nodes.forEach((n, i) => at.set(n.id, i));
function draw() {
  const w = c.width = innerWidth, h = c.height = innerHeight, r = Math.min(w, h) * 0.45, want = q.value.toLowerCase();
  nodes.forEach((n, i) => { const a = 2 * Math.PI * i / nodes.length; n.x = w / 2 + r * Math.cos(a); n.y = h / 2 + r * Math.sin(a); n.on = !want || n.label.toLowerCase().includes(want); });
  g.strokeStyle = "#8884"; edges.forEach(e => { const a = nodes[at.get(e.src)], b = nodes[at.get(e.dst)]; if (a && b && (a.on || b.on)) { g.beginPath(); g.moveTo(a.x, a.y); g.lineTo(b.x, b.y); g.stroke(); } });
  nodes.forEach(n => { g.globalAlpha = n.on ? 1 : 0.15; g.fillStyle = `hsl(${n.colour * 18} 60%% 50%%)`; g.beginPath(); g.arc(n.x, n.y, n.size, 0, 7); g.fill(); }); g.globalAlpha = 1;
}
c.onmousemove = e => { const n = nodes.find(n => (n.x - e.x) ** 2 + (n.y - e.y) ** 2 <= n.size ** 2); note.textContent = n ? `${n.label} (${n.type}, ${n.degree} edges)` : ""; };
q.oninput = onresize = draw; draw();
</script>
""".replace("%%", "%")


def _lines(rows: DataFrame, *by: str) -> Iterator[str]:
    """Rows as JSON that can stand in a script."""
    for r in rows.orderBy(*by).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield r["j"].replace("<", "\\u003c")


def write_page(g: Graph, path: str, min_degree: int = 1, title: str = "Graph") -> None:
    """The graph as one page on the driver's disk: its nodes of a least degree in a ring, by community, with their edges, and a field to find them.

    Rows pass through the driver a partition at a time; what a browser can draw bounds min_degree from below.
    """
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(PAGE % escape(title))
        for name, lines in (("nodes", _lines(ranking.page_nodes(g, min_degree), "id")), ("edges", _lines(ranking.page_edges(g, min_degree), "src", "dst", "type"))):
            f.write(f"<script>const {name} = [\n")
            for line in lines:
                f.write(line + ",\n")
            f.write("];</script>\n")
        f.write(SCRIPT)
    os.replace(temporary, path)
