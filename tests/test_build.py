import json
import os

import pytest
from pyspark.sql import functions as F

from fernweave import Workspace
from fernweave.api import TOOLS
from fernweave.functions import text as tx
from fernweave.graph import Graph
from fernweave.operators import embed, enrich, extract, outline, report, resolve
from fernweave.plans.build import build
from fernweave.plans.config import load_config, plugin_settings
from fernweave.plans.dag import Dag, Manifest, Phase, execute
from fernweave.plans.enrichment import enrich_graph
from fernweave.sources import files, graph_json, repos
from fernweave.streaming import changes

from . import fixtures

TYPES = {"code": {"endings": [".py"]}, "docs": {"endings": [".md"]}}


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def tree(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_build_again(spark, tmp_path):
    a = tree(tmp_path / "a", src__base_dot_py="class Base:\n    pass\n", src__use_dot_py="from .base import Base\n\n\nclass Own(Base):\n    pass\n", node_modules__x_dot_py="y = 1\n")
    b = tree(tmp_path / "b", guide_dot_md="# Guide\n\nSee `Own`.\n")
    roots, out = {"a": a, "b": b}, str(tmp_path / "out")
    g, counts = build(spark, roots, out, TYPES)
    assert counts == {"extracted": 3, "kept": 0}
    ids = {r["id"]: r["repo"] for r in g.nodes.collect()}
    assert ids["a/src/use.py"] == "a" and ids["b/guide.md"] == "b" and "a.src.use.Own" in ids and not any("node_modules" in i for i in ids)
    assert ("a.src.use.Own", "a.src.base.Base", "extends") in {(r["src"], r["dst"], r["type"]) for r in g.edges.collect()}
    (tmp_path / "a/src/use.py").write_text("from .base import Base\n\n\nclass Other(Base):\n    pass\n")
    os.remove(tmp_path / "b/guide.md")
    tree(tmp_path / "b", more_dot_md="# More\n")
    g, counts = build(spark, roots, out, TYPES)
    assert counts == {"extracted": 2, "kept": 1}
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"a.src.use.Other", "b/more.md", "a.src.base.Base"} <= ids and not {"a.src.use.Own", "b/guide.md"} & ids
    assert build(spark, roots, out, TYPES)[1] == {"extracted": 0, "kept": 3}
    assert build(spark, roots, out, TYPES, force=True)[1] == {"extracted": 3, "kept": 0}
    w = Workspace(g, outlines_path=f"{out}/outlines", repos=roots)
    assert "## class Other(Base) (lines 4-5)" in w.outline("a/src/use.py") and w.outline("a/none.py") is None
    assert "class Other" in w.explain("a.src.use.Other", include_code=True).first()["outline"]
    one_only = build(spark, {"a": a}, str(tmp_path / "single"), TYPES)[0]
    assert "src/use.py" in {r["id"] for r in one_only.nodes.collect()} and {r["repo"] for r in one_only.nodes.collect()} == {"a"}


def test_outline_without_a_parse(spark, tmp_path):
    text = "import os\n\nclass A(B, C):\n    def one(self):\n        pass\n\n    async def two(self, x):\n        return x\n\ndef three(:\n    pass\n"
    root = tree(tmp_path, bad_dot_py=text)
    w = Workspace(graph_json.empty_graph(spark), repos={"only": root})
    got = w.outline("bad.py")
    assert "## class A(B, C) (lines 3-8)" in got and "- def one(self) (lines 4-5)" in got and "- async def two(self, x) (lines 7-8)" in got and "- def three( (lines 10-11)" in got
    os.remove(tmp_path / "bad.py")
    assert w.outline("bad.py") == got  # held
    plain = outline.python_by_lines("a.py", "class A:\n    def m(self):\n        pass\n\n\ndef f():\n    def g():\n        pass\n")
    assert [(s["qualified_name"], s["kind"], s["start_line"], s["end_line"]) for s in plain["symbols"]] == [("a.A", "class", 1, 3), ("a.A.m", "method", 2, 3), ("a.f", "function", 6, 8), ("a.g", "function", 7, 8)]


def test_census_of_roots(spark, tmp_path):
    a, b = tree(tmp_path / "a", x_dot_py="", y_dot_md="", LICENSE="", gen__z_dot_py=""), tree(tmp_path / "b", w_dot_PY="")
    c = files.census_of(spark, [a, str(tmp_path / "gone"), b], exclude=["gen/**"])
    assert {r["extension"]: r["n"] for r in c.counts.collect()} == {".py": 2, ".md": 1} and (c.total, c.truncated) == (3, False) and c.missing == [str(tmp_path / "gone")]
    c = files.census_of(spark, [a, b], most=2)
    assert c.truncated and c.total == 2 and sum(r["n"] for r in c.counts.collect()) == 2
    assert files.census_of(spark, []).counts.count() == 0


def test_paths(spark, tmp_path):
    at = {"api": "/w/api", "core": "/w/core/"}
    f = lambda p, r=at: repos.source_file(F.lit(p), r, "/w")
    assert one(spark, f("/w/api/a.py"), f("/w/core/x/b.py"), f("/w/apix/c.py"), f("/else/d.py"), f("C:\\r\\a.py", {"r": "C:\\r"})) == ["api/a.py", "core/x/b.py", "apix/c.py", None, "a.py"]
    assert one(spark, repos.repo_name(F.lit("core/x.py"), at), repos.repo_name(F.lit("z/x.py"), at), repos.repo_name(F.lit("z/x.py"), {"r": "/r"})) == ["core", None, "r"]
    assert one(spark, repos.absolute_file(F.lit("core/x.py"), at), repos.absolute_file(F.lit("z/x.py"), at), repos.absolute_file(F.lit("x\\y.py"), {"r": "/r"})) == ["/w/core/x.py", None, "/r/x/y.py"]
    root = tree(tmp_path / "api", a_dot_py="")
    assert repos.located("api/a.py", {"api": root, "core": "/none"}, str(tmp_path / "graph")) == {"absolute": f"{root}/a.py", "from_graph": "../api/a.py"}
    assert repos.located("core/a.py", {"api": root, "core": "/none"}, "/")["absolute"] is None and repos.located(None, {}, "/")["absolute"] is None
    (tmp_path / "beside/graph").mkdir(parents=True)
    assert repos.find_graph(cwd=root, variable="NOT_SET") == str(tmp_path / "beside/graph") and repos.find_graph(str(tmp_path / "no")) is None
    with pytest.raises(ValueError):
        repos.list_repos(spark, {})


def test_text_and_answers(spark):
    assert one(spark, tx.posix(F.lit("a\\b/c")), tx.grouped_number(F.lit(1234567)), tx.grouped_number(F.lit(12))) == ["a/b/c", "1,234,567", "12"]
    got = one(spark, *[tx.parse_answer(F.lit(a), "struct<label: string>") for a in ('```json\n{"label": "x"}\n```', '{"label": "y"}', None)])
    assert got[0]["label"] == "x" and got[1]["label"] == "y" and got[2] is None
    assert one(spark, tx.parse_answer(F.lit("sorry"), "array<string>"))[0] is None


def test_encoders(spark):
    tokens = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((3.0, 0.0), (9.0, 9.0), (0.0, 3.0))])
    pooled, none = one(spark, embed.mean_pool(tokens, F.array(F.lit(1), F.lit(0), F.lit(1))), embed.mean_pool(tokens, F.array(F.lit(0), F.lit(0), F.lit(0))))
    assert pooled == pytest.approx([0.5**0.5] * 2) and none == [0.0, 0.0]
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(7)], "id long, text string").coalesce(1)
    answers = embed.encode_texts(rows, lambda texts: [{"index": k, "vector": [len(t)]} for k, t in reversed(list(enumerate(texts)))], batch=3)
    assert {r["id"]: r["vector"] for r in answers.collect()} == {i: [float(i)] for i in range(7)}
    calls = []

    def once(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise embed.Throttled("later")
        return [[1.0] for _ in texts]

    assert embed._call(once, ["a"], 3, 0.0) == ([[1.0]], None) and len(calls) == 3
    calls.clear()
    assert embed._call(once, ["a"], 1, 0.0) == ([None], "Throttled: later") and len(calls) == 2
    assert embed._call(lambda t: [[1.0]], ["a", "b"], 3, 0.0) == ([None, None], "ValueError: 1 vectors for 2 texts")
    failed = embed.encode_texts(rows, lambda texts: 1 / 0).collect()
    assert len(failed) == 7 and all(r["vector"] is None and "ZeroDivisionError" in r["error"] for r in failed)


def test_manifest(tmp_path):
    path = str(tmp_path / "seals.json")
    dag = Dag([Phase("a", lambda got: 1), Phase("b", lambda got: 1 / 0, ("a",))])
    execute(dag, Manifest(path))
    assert set(Manifest(path).held) == {"a"}
    assert execute(dag.only(["a"]), Manifest(path)).skipped == ["a"]
    (tmp_path / "seals.json").write_text("{")
    assert Manifest(path).held == {}


def test_services(tmp_path):
    path = tmp_path / "c.json"
    good = {"services": {"far": {"kind": "http", "url": "u", "model": "m"}, "near": {"kind": "local", "model": "m"}}, "embed": {"provider": "far"}, "enrich": {"mode": "near"}}
    path.write_text(json.dumps(good))
    assert load_config(str(path)).embed.provider == "far"
    for bad in ({"services": {"x": {"kind": "odd"}}}, {"services": {"x": {"kind": "http", "model": "m"}}}, {"embed": {"provider": "x"}}, {"services": good["services"], "embed": {"provider": "near"}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load_config(str(path))
    assert plugin_settings({"a": 1, "b": 2}, {"b": 3, "enabled": True}) == {"a": 1, "b": 3}


def test_json_document(spark, tmp_path):
    g = graph_json.read_graph(spark, fixtures.as_json(tmp_path / "g.json"), guarded=True)
    path = str(tmp_path / "out/graph.json")
    assert graph_json.write_json(g, path, {"repos": ["a", "b"]}) and not graph_json.write_json(g, path, {"repos": ["a", "b"]})
    assert graph_json.write_json(g, path, {"repos": ["a"]}) and json.loads(open(path).read())["metadata"]["repos"] == ["a"]
    again = graph_json.read_graph(spark, path, guarded=True)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.nodes.select("id", "label", "type", "source_file", "community", "start_line", "signature")) == key(g.nodes.select("id", "label", "type", "source_file", "community", "start_line", "signature"))
    assert key(again.edges.select("src", "dst", "type", "confidence")) == key(g.edges.select("src", "dst", "type", "confidence"))
    assert graph_json.read_metadata(str(tmp_path / "none.json")) is None and graph_json.read_metadata(str(tmp_path / "g.json"))["repos"]
    empty = str(tmp_path / "empty.json")
    graph_json.write_json(graph_json.empty_graph(spark), empty)
    assert json.loads(open(empty).read())["nodes"] == [] and graph_json.read_graph(spark, empty).edges.count() == 0
    text = Workspace.open(spark, path).status_text()
    assert "Built: 20" in text and f"Nodes: {len(fixtures.NODES)} | Edges: {len(fixtures.EDGES)}" in text and "Repositories: 1 (a)" in text and "Vectors: none" in text


def test_calls(spark, tmp_path):
    w = Workspace.open(spark, fixtures.as_json(tmp_path / "g.json"))
    assert w.call("graph_search", {"query": "user", "top_k": 2})["rows"].count() == 2
    assert [r["id"] for r in w.call("graph_path", {"from": "Users.get", "to": "db_url"})["rows"].collect()][-1] == "fn:db_url"
    assert w.call("graph_community", {"community_id": "0"})["rows"].count() == 2 and "Nodes:" in w.call("graph_status")["rows"]
    for tool, given in (("graph_none", {}), ("graph_search", {}), ("graph_search", {"query": 3}), ("graph_search", {"query": "x", "odd": 1}), ("graph_hotspots", {"top_n": True}), ("graph_similar", {"query": "x"})):
        assert set(w.call(tool, given)) == {"error"}
    assert all(hasattr(w, t["method"]) for t in TOOLS.values()) and len(TOOLS) == 11


def test_enrichment(spark, tmp_path):
    g = graph_json.read_graph(spark, fixtures.as_json(tmp_path / "g.json"), guarded=True)
    plain = enrich_graph(g, str(tmp_path / "plain"))
    assert {r["moved"] for r in plain["routed"].collect()} == {False} and plain["descriptions"].count() == len(fixtures.NODES)

    def moves(prompt):
        ids = [n["id"] for n in json.loads(prompt)["nodes"]]
        return "```json\n" + json.dumps([{"id": i, "to": "1"} for i in ids if i == "fn:place_order"] + [{"id": "fn:nobody", "to": "1"}, {"id": "fn:open_db", "to": "none"}]) + "\n```"

    profiles = lambda prompt: json.dumps({"label": "L" + json.loads(prompt)["community"], "profile": str(json.loads(prompt)["size"])})
    changes = lambda prompt: json.dumps({"merges": [{"community": "3", "target": "2"}], "splits": [{"id": "cls:Users", "community": "2", "new_community": "9"}]})
    got = enrich_graph(g, str(tmp_path / "asked"), {"moves": moves, "profiles": profiles, "changes": changes})
    now = {r["id"]: r["community"] for r in got["routed"].collect()}
    assert now["fn:place_order"] == "1" and now["cls:Auth"] == "2" and now["cls:Users"] == "9" and now["fn:open_db"] == "0"
    assert {r["community"]: (r["label"], r["node_count"], r["summary"]) for r in got["summaries"].collect()} == {"1": ("L1", 3, "3"), "2": ("L2", 3, "3")}
    again = enrich_graph(g, str(tmp_path / "asked"), {"moves": lambda p: 1 / 0})
    assert {r["id"]: r["community"] for r in again["routed"].collect()} == now
    profiles_ = spark.createDataFrame([("0", "a", "p"), ("77", "b", "q")], "community string, label string, profile string")
    newer = spark.createDataFrame([("0", "c", "r")], "community string, label string, profile string")
    assert {r["community"]: (r["label"], r["node_count"], r["summary"]) for r in enrich.finalize(g, profiles_, newer).collect()} == {"0": ("c", 2, "r"), "77": ("b", 0, "q")}


def test_build_stats(spark):
    sources = [
        ("p/a.py", "import os\nfrom .b import f, g\nfrom .b import f\nimport p.b\n\n\ndef run():\n    f()\n    f()\n    own()\n\n\ndef own():\n    pass\n"),
        ("p/b.py", "def f():\n    return g()\n\n\ndef g():\n    pass\n"),
        ("p/c.py", "from p.b import *\n"),
        ("bad.py", "def ("),
    ]
    row = resolve.build_stats(extract.Extractors().run(spark.createDataFrame(sources, "path string, text string"))).first()
    # names: f, g, f; the module; two by the wildcard; and one call into another file
    assert row.asDict() == {"node_count": 7, "edge_count": 4 + 2 + 1 + 2 + 3, "file_count": 3, "cross_file_edges": 3 + 1 + 2 + 1, "unresolved_imports": 1}


def test_listing_by_rounds(spark, tmp_path):
    root = tree(tmp_path / "r", a_dot_py="x = 1\n", d__e__b_dot_py="\xe9", d__e__f__c_dot_md="", node_modules__z_dot_py="", LICENSE="l")
    tree(tmp_path / "r", **{"d__.hidden__q_dot_py": "h"})
    (tmp_path / "r/d/__init__.py").write_text("i")
    (tmp_path / "r/old.py.gz").write_bytes(b"not packed")
    (tmp_path / "r/empty").mkdir()
    plain, rounds = files.list_files(spark, root), files.list_files(spark, f"file://{root}")
    rows = lambda df: sorted((r["path"], r["size"], round(r["modified"], 3)) for r in df.collect())
    assert rows(plain) == rows(rounds) and "d/__init__.py" in {r["path"] for r in rounds.collect()}
    read = [sorted((r["path"], r["text"], r["hash"]) for r in files.read_files(rounds, u).collect()) for u in (root, f"file://{root}")]
    assert read[0] == read[1] and ("old.py.gz", "not packed") in {(p, t) for p, t, _ in read[0]}
    gone = files.read_files(spark.createDataFrame([("nowhere.py",)], "path string"), root).first()
    assert gone["text"] is None and gone["hash"] is None


def test_change_stream_in_parts(spark, tmp_path):
    schema = "path string, hash string, ts timestamp, seq long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        spark.sql(f"select 'k{k % 2}' path, '{k}' hash, timestamp'2024-01-01' ts, {k}L seq union all select 'own{k}', '{k}', timestamp'2024-01-01', {k}L").coalesce(1).write.mode("append").parquet(source)
        changes.keep_latest(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"), whole_every=3).awaitTermination(60)
        want = {f"own{j}": str(j) for j in range(k + 1)} | {f"k{j % 2}": str(j) for j in range(k + 1)}
        assert {r["path"]: r["hash"] for r in changes.read_latest(spark, out, whole_every=3).collect()} == want
    assert [spark.read.schema(schema).parquet(f"{out}/v={k}").count() for k in range(5)] == [2, 2, 2, 6, 2]


def test_page(spark, tmp_path):
    g = graph_json.read_graph(spark, fixtures.as_json(tmp_path / "g.json"), guarded=True)
    g = Graph(g.nodes.withColumn("label", F.when(F.col("id") == "fn:open_db", F.lit("</script><b>")).otherwise(F.col("label"))), g.edges)
    path = tmp_path / "out/page.html"
    report.write_page(g, str(path), min_degree=2, title="A & B")
    text = path.read_text()
    assert "<title>A &amp; B</title>" in text and text.count("</script>") == 3 and "<b>" not in text
    held = [json.loads("[" + part.split("];")[0].rstrip().rstrip(",") + "]") for part in text.split(" = [\n")[1:3]]
    degree = {i: sum(i in e[:2] for e in fixtures.EDGES) for i, *_ in fixtures.NODES}
    assert {n["id"] for n in held[0]} == {i for i, d in degree.items() if d >= 2}
    assert {(e["src"], e["dst"], e["type"]) for e in held[1]} == {e for e in fixtures.EDGES if degree[e[0]] >= 2 and degree[e[1]] >= 2}


def test_pages_of_any_markup(spark):
    html = "<h1 class='x'>One <b>two</b></h1><p><a class='k' href='u'>go <i>on</i></a></p><H2>no</H2><h3>\nThree</h3><header>no</header><abbr href='n'>no</abbr><a href=\"v\"></a>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in extract.page_links(pages).orderBy("place").collect()] == [(1, 1, "u", "go on"), (1, 2, "v", "")]
    assert [tuple(r) for r in extract.page_sections(pages).orderBy("place").collect()] == [(1, 1, 1, "One two"), (1, 2, 3, "\nThree")]


def test_own_import_rule(spark):
    rows = extract.Extractors().run(spark.createDataFrame([("lib/x.py", "y = 1\n"), ("a.py", "import x\n")], "path string, text string"))
    own = resolve.resolve_imports(rows, lambda module, file: F.array(F.concat(F.lit("lib/"), module, F.lit(".py"))))
    assert own.first()["target"] == "lib/x.py"
    assert enrich.ask(spark.createDataFrame([(str(k), "p") for k in range(9)], "id string, prompt string"), lambda p: "a", at_once=2).rdd.getNumPartitions() <= 2
