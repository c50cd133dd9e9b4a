import random

import corpus_pipeline
from fernweave.llm import simhash


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda: " ".join(sentence(12) for _ in range(9))
    passage = " ".join(sentence(13) for _ in range(5))
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(120)]
    for i in range(60, 80):
        rows[i] = (i, rows[i][1] + " vileword nastyword", "en", rows[i][3], 0)
    rows += [(200 + i, rows[i][1], "en", "s1", 0) for i in range(5)] + [(300 + i, rows[10 + i][1] + "\n" + passage, "en", "s2", 0) for i in range(2)]
    for i in (20, 30, 40):
        rows[i] = (i, rows[i][1] + "\n" + passage, "en", rows[i][3], 0)
    rows += [(400, None, None, None, None), (None, "text without an id", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(60 <= i < 80)) for i in range(0, 120) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{k}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    ids = {name: {r["doc_id"] for r in d.select("doc_id").collect()} for name, d in seen.items()}
    assert not ids["toxicity"] & set(range(60, 80)) and {200, 300, 400, None} <= ids["toxicity"]
    assert not ids["simhash_near_dedup"] & {200, 201, 202, 203, 204} and ids["simhash_near_dedup"] >= set(range(60))
    texts = {r["doc_id"]: r["text"] or "" for r in seen["substring_dedup"].collect()}
    assert passage in texts[20] and passage not in texts[30] and passage not in texts[40] and texts[5] == rows[5][1]
    assert ids["mixing"] <= ids["substring_dedup"] and seen["mixing"].count() != seen["substring_dedup"].count()
    assert ids["packing"] == ids["mixing"]
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, total.groupBy("doc_id").sum("length").collect())) == sorted(map(str, seen["packing"].groupBy("doc_id").sum("length").collect()))


def test_stages_take_awkward_and_empty_tables(spark, docs, empty, tmp_path):
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        if name != "packing":
            assert got.columns == docs.columns and none.columns == empty.columns, name
        assert got.count() > 0, name


def test_near_dedup_links_by_fingerprints_and_by_sets(spark):
    """A pair that fingerprints alone link (they ignore how often a frequent shingle stands), one that sets alone link, and one of neither."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    base, few = [word() for _ in range(7)], [[word() for _ in range(12)] for _ in range(2)]
    rows = [(1, " ".join(base * 60 + few[0])), (2, " ".join(base * 60 + few[1]))]
    words = [word() for _ in range(150)]
    rows += [(3, " ".join(words)), (4, " ".join(["x1" if i in (40, 80, 120) else w for i, w in enumerate(words)])), (5, " ".join(word() for _ in range(150)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    root = lambda found: {r["doc_id"]: r["root"] for r in found.collect()}
    prints, sets = root(simhash.near_duplicates(docs)), root(simhash.near_copies(docs))
    assert prints[1] == prints[2] and prints[3] != prints[4] and sets[1] != sets[2] and sets[3] == sets[4]
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3, 5}
