import json

import pytest
from pyspark.sql import functions as F

from fernweave import Workspace
from fernweave.operators import extract, report, vectors
from fernweave.plans.config import load_config
from fernweave.sources import vector_tables

from . import fixtures


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    w = Workspace.open(spark, fixtures.as_json(tmp_path_factory.mktemp("w") / "g.json", 1))
    w.extractions = extract.Extractors().run(spark.createDataFrame([("a.py", 'class A(B):\n    def m(self):\n        "doc"\n\n\ndef f(x):\n    pass\n'), ("d.md", "# One\n\n## Two\n")], "path string, text string"))
    w.vectors = spark.createDataFrame([("fn:open_db", "function", "shop-core", [1.0, 0.0]), ("fn:load_user", "function", "shop-api", [0.0, 1.0])], "id string, type string, repo string, vector array<float>")
    w.encode = lambda text: [1.0, 0.1]
    return w


def test_tools(shop):
    assert shop.search("user", 3).count() == 3
    hits, around = shop.search("open_db", context_depth=1)
    assert hits.count() == 1 and around.count() == 4
    assert shop.search("open_db", context_depth=1, context_mode="dfs")[1]
    with pytest.raises(ValueError):
        shop.search(" ")
    assert shop.impact("open_db", "upstream", 1).count() == 3
    assert [r[0] for r in shop.impact("nothing at all").collect()] == []
    assert [r["id"] for r in shop.path("Users.get", "db_url").collect()] == ["fn:Users.get", "fn:load_user", "fn:open_db", "fn:db_url"]
    assert shop.path("Users.get", "nobody").count() == 0
    assert shop.explain("settings").first()["in_degree"] == 1
    assert shop.explain("sett").columns == ["suggestion"]
    assert shop.community("0").count() == 2 and "size" in shop.community("77").columns
    assert shop.hotspots(2).count() == 2 and shop.status().first()["edge_count"] == 12
    assert [r["id"] for r in shop.similar("db", 1).collect()] == ["fn:open_db"] and [r["id"] for r in shop.similar([1.0, 0.0], repo="shop-api").collect()] == ["fn:load_user"]
    docs, code = shop.docs("guide")
    assert docs.count() == 0 and code.count() == 0
    assert shop.sql("select count(*) n from nodes where type = 'class'").first()["n"] == 2


SECTIONS = ["candidates", "relationships", "communities", "source", "metadata"]


def test_context(shop):
    rows = shop.context("user", 512).collect()
    assert {r["section"] for r in rows} == set(SECTIONS) - {"source"}
    assert sum(-(-len(r["text"]) // 4) for r in rows) <= 512
    assert rows == sorted(rows, key=lambda r: (SECTIONS.index(r["section"]), r["place"]))


def test_context_with_source(shop):
    entries = shop.extractions.sparkSession.createDataFrame([("shop-api/src/services/users.py", "load_user", 3, "def load_user(key)")], "file_path string, name string, start_line int, signature string")
    near = shop.vectors.select("id", F.lit(0.5).alias("score"))
    rows = vectors.build_context(shop.graph, "load_user", 4096, near, None, True, entries).collect()
    source = [r["text"] for r in rows if r["section"] == "source"]
    assert source and "shop-api/src/services/users.py:4-10\ndef load_user(key)" in source
    assert any(t.endswith("open_db (lines 3-9)") for t in source)
    text = shop.context("load_user", include_source=True, format="narrative")
    n = shop.context("load_user", include_source=True, format="structured")
    assert set(n) == set(SECTIONS) - {"metadata"} and n["candidates"].count() > 0
    assert text.startswith(f"> {n['candidates'].count()} candidates, {n['relationships'].count()} relationships")
    assert [x[3:] for x in text.splitlines() if x.startswith("## ")] == ["Candidates", "Relationships", "Communities", "Source"]
    with pytest.raises(ValueError):
        shop.context("user", format="poem")


def test_vector_tables(spark, tmp_path):
    path, asked = str(tmp_path / "vectors"), []

    def embed(rows):
        asked.append(sorted(r["id"] for r in rows.collect()))
        return rows.select("id", F.array(F.length("text").cast("float"), F.lit(float(len(asked))).cast("float")).alias("vector"))

    texts = lambda *rows: spark.createDataFrame(rows, "id string, text string")
    assert vector_tables.read_vectors(spark, path) is None and vector_tables.read_meta(spark, path) is None
    assert vector_tables.refresh_vectors(texts(("a", "one"), ("b", "three"), ("c", None)), path, embed, "own") == {"embedded": 3, "kept": 0, "removed": 0}
    meta = vector_tables.read_meta(spark, path)
    assert (meta["record_count"], meta["dimensions"], meta["provider"], meta["number"]) == (3, 2, "own", 1)
    assert vector_tables.refresh_vectors(texts(("a", "one"), ("b", "three"), ("c", None)), path, embed) == {"embedded": 0, "kept": 3, "removed": 0}
    assert vector_tables.read_meta(spark, path) == meta
    assert vector_tables.refresh_vectors(texts(("a", "one"), ("b", "four"), ("d", "x")), path, embed) == {"embedded": 2, "kept": 1, "removed": 1}
    got = {r["id"]: r["vector"] for r in vector_tables.read_vectors(spark, path).collect()}
    assert asked[0] == ["a", "b", "c"] and asked[-1] == ["b", "d"]
    assert {k: v[0] for k, v in got.items()} == {"a": 3.0, "b": 4.0, "d": 1.0} and got["a"][1] == 1.0 and got["b"][1] > 1.0
    assert vector_tables.refresh_vectors(texts(("a", "one")), path, embed) == {"embedded": 0, "kept": 1, "removed": 2}
    vector_tables.write_vectors(vector_tables.read_vectors(spark, path).limit(0), path)
    assert vector_tables.read_vectors(spark, path) is None and vector_tables.read_meta(spark, path)["record_count"] == 0


def test_saved_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma")], "doc_id long, text string")
    counts = vectors.document_tokens(docs)
    vector_tables.write_vocabulary(vectors.inverse_frequencies(counts, docs), str(tmp_path))
    saved = vector_tables.read_vocabulary(spark, str(tmp_path))
    assert {r["term"]: r["df"] for r in saved.collect()} == {"alpha": 1, "beta": 2, "gamma": 1}
    again = {r["doc_id"]: r["vector"] for r in vectors.embed_texts(docs, vocabulary=saved).collect()}
    assert again == {r["doc_id"]: r["vector"] for r in vectors.embed_texts(docs).collect()}
    new = vectors.known_frequencies(vectors.document_tokens(spark.createDataFrame([(3, "beta unseen")], "doc_id long, text string")), saved)
    assert {r["term"]: (r["df"], r["idf"]) for r in new.collect()} == {"beta": (2, 1.0), "unseen": (None, 1.0)}


def test_outlines(shop):
    text = shop.outline("a.py")
    assert "## class A(B) (lines 1-3)" in text and "- def m(self) (lines 2-3)" in text and "- def f(x) (lines 6-7)" in text
    assert [s["name"] for s in json.loads(shop.outline("d.md", "json"))["sections"]] == ["One", "Two"]
    assert shop.outline("gone.py") is None


def test_report(shop):
    text = report.markdown(shop.graph)
    assert "| load_user | function | 7 |" in text and "| shop-web | shop-core | 1 |" in text


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"build": {"root": "x"}, "enrich": {"threshold": 1}}))
    c = load_config(str(path))
    assert c.root == "x" and c.enrich.threshold == 1.0 and c.embed.dimensions == 384
    for bad in ({"nope": 1}, {"scan": {"max_kb": "x"}}, {"enrich": {"mode": "magic"}}, {"enrich": {"threshold": 2.0}}, {"embed": 3}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load_config(str(path))
