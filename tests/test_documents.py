import math

import pytest
from pyspark.sql import functions as F

from fernweave.functions import text as tx
from fernweave.operators import diff, enrich, extract, resolve, vectors
from fernweave.plans.dag import Dag, Phase, execute
from fernweave.sources import files
from fernweave.streaming import changes

DOC = """---
# Guide to the shop

The shop sells `things` and
more.

## Parts

- `PartList` keeps parts, see `src/parts/list.py`
- `if` and `x` are no symbols

## Parts

Uses `load_part` and `load_part` again.

Deep part
---------

Text (see lib/util.go) and `a.b_c`.
"""


def test_sections(spark):
    docs = spark.createDataFrame([("docs/guide.md", DOC), ("empty.md", ""), ("none.md", None)], "path string, text string")
    rows = extract.sections(docs).orderBy("start_line").collect()
    assert [(r["name"], r["qualified_name"], r["level"], r["start_line"], r["end_line"]) for r in rows] == [
        ("Guide to the shop", "docs.guide.Guide_to_the_shop", 1, 2, 6), ("Parts", "docs.guide.Parts", 2, 7, 11), ("Parts", "docs.guide.Parts_2", 2, 12, 16), ("Deep part", "docs.guide.Deep_part", 2, 17, 20),
    ]
    refs = {(r["name"], r["from_symbol"], r["line"]) for r in extract.code_references(docs).collect()}
    assert refs == {
        ("things", "docs.guide.Guide_to_the_shop", 4), ("PartList", "docs.guide.Parts", 9), ("src/parts/list.py", "docs.guide.Parts", 9), ("load_part", "docs.guide.Parts_2", 14),
        ("lib/util.go", "docs.guide.Deep_part", 19), ("a.b_c", "docs.guide.Deep_part", 19),
    }
    assert extract.first_paragraph(docs).collect()[0]["docstring"] == "The shop sells `things` and more."
    plain = extract.extract_markdown("docs/guide.md", DOC)
    assert {(x["name"], x["from_symbol"], x["line"]) for x in plain["refs"]} == refs
    assert [(x["qualified_name"], x["start_line"], x["end_line"]) for x in plain["symbols"]] == [(r["qualified_name"], r["start_line"], r["end_line"]) for r in rows]


SOURCES = [
    ("shop/__init__.py", "from .store import Store\n"),
    ("shop/store.py", '"""Stores."""\nLIMIT = 3\n__all__ = ["Store", "make"]\n\n\nclass Base:\n    def ping(self):\n        return 1\n\n\nclass Store(Base):\n    """A store."""\n\n    @property\n    def size(self) -> int:\n        return self.ping()\n\n    def ping(self):\n        return helper()\n\n\ndef make(n: int = 1) -> Store:\n    return Store()\n\n\ndef helper():\n    return LIMIT\n'),
    ("app/main.py", "import os\nfrom shop import Store\nfrom shop.store import make as build, helper\nfrom shop.missing import gone\n\n\ndef run():\n    s = Store()\n    make()\n    return helper()\n\n\nclass Big(Store):\n    pass\n"),
    ("app/all.py", "from shop.store import *\n\n\ndef go():\n    return make()\n"),
    ("broken.py", "def ("),
    ("notes.md", "# Notes\n\nSee `shop.store.Store` and shop/store.py here.\n"),
    ("data.bin", "x"),
]


@pytest.fixture(scope="module")
def extracted(spark):
    return extract.Extractors().run(spark.createDataFrame(SOURCES, "path string, text string")).cache()


def test_extraction(extracted):
    rows = {r["file_path"]: r for r in extracted.collect()}
    assert set(rows) == {p for p, _ in SOURCES if not p.endswith(".bin")}
    assert rows["broken.py"]["error"] and not rows["broken.py"]["symbols"]
    store = {s["qualified_name"]: s for s in rows["shop/store.py"]["symbols"]}
    assert {k: s["kind"] for k, s in store.items()} == {
        "shop.store.LIMIT": "constant", "shop.store.Base": "class", "shop.store.Base.ping": "method", "shop.store.Store": "class", "shop.store.Store.size": "method", "shop.store.Store.ping": "method",
        "shop.store.make": "function", "shop.store.helper": "function",
    }
    assert store["shop.store.make"]["signature"] == "def make(n: int=1) -> Store"
    assert store["shop.store.Store.size"]["decorators"] == ["property"] and store["shop.store.Store"]["bases"] == ["Base"]
    assert rows["shop/store.py"]["exports"] == ["Store", "make"] and rows["shop/store.py"]["file_node"]["docstring"] == "Stores."


def test_graph_of_sources(extracted):
    g = resolve.build_graph(extracted, "demo")
    edges = {(r["src"], r["dst"], r["type"]) for r in g.edges.collect()}
    assert {
        ("shop/store.py", "shop.store.Store", "contains"), ("shop.store.Store", "shop.store.Store.ping", "contains"), ("app/main.py", "shop.store.Store", "imports_from"), ("app/main.py", "shop.store.make", "imports_from"),
        ("app/all.py", "shop.store.make", "imports_from"), ("app.all.go", "shop.store.make", "calls"), ("app.main.run", "shop.store.Store", "calls"), ("app.main.run", "shop.store.helper", "calls"),
        ("app.main.Big", "shop.store.Store", "extends"), ("shop.store.Store", "shop.store.Base", "extends"), ("shop.store.Store.ping", "shop.store.helper", "calls"), ("shop.store.Store.size", "shop.store.Store.ping", "calls"),
        ("notes.Notes", "shop.store.Store", "references"), ("notes.Notes", "shop/store.py", "references"),
    } <= edges
    assert not any(a == b for a, b, _ in edges) and not any("missing" in b or b == "os" for _, b, _ in edges)
    again = resolve.build_graph(extracted.repartition(7).orderBy(F.desc("file_path")), "demo")
    assert {(r["src"], r["dst"], r["type"]) for r in again.edges.collect()} == edges


def term_hash(term):
    h = 0x811C9DC5
    for c in term:
        x = (h ^ ord(c)) & 0xFFFFFFFF
        x = x - (1 << 32) if x >> 31 else x
        h = int(float(x) * 16777619.0) & 0xFFFFFFFF
    return h


def test_text_functions(spark):
    words = ["user", "database", "a1", "zz_sign", "x" * 30]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.term_hash(F.col("w")).alias("h")).collect()
    assert {r["w"]: r["h"] for r in got} == {w: term_hash(w) for w in words} and term_hash("user") == 1618501360
    row = spark.range(1).select(tx.tokens(F.lit("getUser_by ID, x 42!")).alias("t"), tx.extension(F.lit("a/b.Tar.GZ")).alias("e"), tx.extension(F.lit("a/.env")).alias("d"), tx.dirname(F.lit("a/b/c.py")).alias("p"), tx.ellipsis(F.lit("abcdef"), 3).alias("s"), tx.token_count(F.lit("abcde")).alias("n")).first()
    assert list(row) == [["getuser", "by", "id", "42"], ".gz", "", "a/b", "abc...", 2]
    paths = spark.createDataFrame([("x/test_a.py",), ("x/tests/b.py",), ("tests/b.py",), ("x/spec/c.js",), ("x/contest.py",)], "p string")
    assert [r[0] for r in paths.select(tx.is_test_file(F.col("p"))).collect()] == [True, True, False, True, False]


@pytest.mark.parametrize("glob,hits", [("**/*.py", {"a.py", "x/b.py", "x/.h/c.py"}), ("x/*", {"x/b.py", "x/d.ts"}), ("*.{py,ts}", {"a.py"}), ("x/[a-c].py", {"x/b.py"}), ("x/**", {"x/b.py", "x/d.ts", "x/.h/c.py"}), ("?.py", {"a.py"})])
def test_globs(spark, glob, hits):
    paths = spark.createDataFrame([(p,) for p in ("a.py", "x/b.py", "x/d.ts", "x/.h/c.py")], "p string")
    assert {r["p"] for r in paths.where(tx.matches_any(F.col("p"), [glob])).collect()} == hits
    assert paths.where(tx.matches_any(F.col("p"), [])).count() == 0


def test_files(spark, tmp_path):
    for name, body in (("src/__init__.py", "x"), ("src/a.py", "y" * 3000), ("node_modules/b.py", "z"), (".hidden/c.md", "# c"), ("d.txt", "d"), ("LICENSE", "l")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.list_files(spark, str(tmp_path))
    assert {r["path"] for r in found.collect()} == {"src/__init__.py", "src/a.py", ".hidden/c.md", "d.txt", "LICENSE"}
    types = {"code": {"endings": [".py"]}, "docs": {"endings": [".md", ".txt"], "exclude": ["d.*"]}}
    assert [tuple(r)[:2] for r in files.select_files(found, types, max_kb=2).collect()] == [("code", "src/__init__.py"), ("docs", ".hidden/c.md")]
    read = {r["path"]: r for r in files.read_files(found, str(tmp_path)).collect()}
    assert read["d.txt"]["text"] == "d" and len(read["d.txt"]["hash"]) == 64
    assert {r["extension"]: r["n"] for r in files.census(found).collect()} == {".py": 2, ".md": 1, ".txt": 1}


def test_diff(spark):
    schema = "path string, hash string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", "1")], schema), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")], schema)
    assert {r["path"]: r["change"] for r in diff.file_diff(old, new, spark.createDataFrame([("a",), ("b",)], "path string")).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added", "e": "changed"}
    assert diff.content_hash(old).first() == diff.content_hash(old.repartition(3)).first() != diff.content_hash(new).first()


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in vectors.embed_texts(docs).collect()}
    assert set(got) == {1, 2} and all(len(v) == 384 and math.isclose(sum(x * x for x in v), 1, abs_tol=1e-6) for v in got.values())
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [1.0])], "id long, vector array<float>")
    assert [(r["id"], round(r["score"], 6)) for r in vectors.similar(rows, [1.0, 0.0], 4).collect()] == [(1, 1.0), (4, 1.0), (2, 0.6), (3, 0.0)]
    text = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank long")
    near = spark.createDataFrame([("b", 0.5), ("c", 0.9)], "id string, score double")
    degrees = spark.createDataFrame([("a", 100), ("c", 25)], "id string, degree long")
    fused = {r["id"]: r["score"] for r in vectors.fuse(text, near, degrees).collect()}
    assert fused == pytest.approx({"a": 0.35 + 0.2, "b": 0.175 + 0.225, "c": 0.405 + 0.1})
    assert vectors.budget(4096, False) == {"candidates": 2048, "relationships": 1228, "communities": 614, "source": 0, "overhead": 204}
    change = vectors.changed_texts(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "id string, text string"), spark.createDataFrame([("a", "x"), ("c", "z"), ("d", "w")], "id string, text string"))
    assert {r["id"]: r["change"] for r in change.collect()} == {"b": "removed", "c": "changed", "d": "changed"}


def test_next_fit(spark):
    rows = [("g", i, f"i{i}", t) for i, t in enumerate([10, 10, 5, 30, 1, 25])] + [("h", 0, "h0", 3)]
    got = {r["id"]: r["batch"] for r in enrich.next_fit(spark.createDataFrame(rows, "group string, ord int, id string, tokens int"), 80 + 25).collect()}
    assert got == {"i0": 1, "i1": 1, "i2": 1, "i3": 2, "i4": 3, "i5": 4, "h0": 1}
    answers = enrich.ask(spark.createDataFrame([("1", "x"), ("2", "bad")], "id string, prompt string"), lambda p: {"x": "yes"}[p])
    assert {r["id"]: (r["answer"], r["error"]) for r in answers.collect()} == {"1": ("yes", None), "2": (None, "KeyError: 'bad'")}
    assert spark.range(1).select(enrich.strip_fences(F.lit("```json\n[1]\n```"))).first()[0] == "[1]"


def test_dag():
    log = []
    step = lambda n, *needs, fail=False: Phase(n, lambda got: log.append(n) or (1 / 0 if fail else n), tuple(needs))
    dag = Dag([step("a"), step("b", "a"), step("c", "a", fail=True), step("d", "b", "c"), step("e", "b")])
    assert dag.errors() == [] and dag.levels() == [["a"], ["b", "c"], ["d", "e"]]
    assert dag.ancestors("d") == {"a", "b", "c"} and dag.descendants("b") == {"d", "e"}
    seals: dict = {}
    run = execute(dag, seals)
    assert set(run.results) == {"a", "b", "e"} and set(run.failed) == {"c", "d"} and set(seals) == {"a", "b", "e"}
    assert "ZeroDivisionError" in run.failed["c"]
    again = execute(dag.target("e"), seals)
    assert sorted(again.skipped) == ["a", "b", "e"] and not again.results
    assert "cycle" in Dag([step("x", "y"), step("y", "x")]).errors()[0] and "no phase" in Dag([step("x", "z")]).errors()[0]
    with pytest.raises(ValueError):
        execute(Dag([step("x", "x")]))


def test_change_stream(spark, tmp_path):
    schema = "path string, hash string, ts timestamp, seq long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.sql("select 'a' path, '1' hash, timestamp'2024-01-01' ts, 1L seq union all select 'b', '1', timestamp'2024-01-01', 2L")
    second = spark.sql("select 'a' path, '2' hash, timestamp'2024-01-02' ts, 3L seq union all select 'b', '0', timestamp'2023-01-01', 4L")
    version = 0
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(source)
        q = changes.keep_latest(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"))
        q.awaitTermination(60)
        state = {r["path"]: r["hash"] for r in spark.read.schema(schema).parquet(f"{out}/v={version}").collect()}
        version += 1
    assert state == {"a": "2", "b": "1"}
    events = spark.sql("select timestamp'2024-01-01 00:10' ts, 'click' event_type, 1.0D value union all select timestamp'2024-01-01 00:50', 'click', 2.0D union all select timestamp'2024-01-01 01:00', 'click', 4.0D")
    assert sorted((r["n"], r["total"]) for r in changes.windowed_counts(events).collect()) == [(1, 4.0), (2, 3.0)]
