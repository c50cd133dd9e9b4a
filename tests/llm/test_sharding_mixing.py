import re
from collections import Counter

import duckdb
import pytest

from fernweave.llm import mixing, sharding

from .conftest import ROWS


def test_points_of_a_shard_stay():
    few, more = sharding.ring(8), sharding.ring(9)
    moved = [(a, b) for a, b in zip(few, more, strict=True) if a != b]
    assert all(b == 8 for _, b in moved)
    assert 0 < len(moved) < len(few) / 5


def test_bounded_loads():
    counts = {p: 3 for p in range(0, 1 << sharding.RING_BITS, 7)} | {11: 9000}
    out = sharding.bounded(counts, 8)
    load, placed, slots = Counter(), Counter(), {k: [] for k in range(8)}
    for place, a, b, shard, slot in out:
        load[shard] += b - a
        placed[place] += b - a
        slots[shard].append((slot, b - a))
    assert placed == Counter(counts)
    assert max(load.values()) - min(load.values()) <= 1
    for parts in slots.values():
        end = 0
        for slot, n in sorted(parts):
            assert slot == end
            end += n
    own = sharding.ring(8)
    stay = sum(b - a for place, a, b, shard, _ in out if own[place] == shard and place != 11)
    assert stay > 0.85 * (sum(counts.values()) - 9000)


def test_shard_rows(docs, empty):
    rows = sharding.shard_rows(docs, 3).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len((t or "").encode()) + 1) for d, t, *_ in ROWS)
    for k in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) == 4
    assert sharding.shard_rows(empty, 3).count() == 0


def filled(sizes, weights, epochs=3):
    """Water-filling by repetition: clamp, share what is left by weight, until none is above."""
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        goal = {s: epochs * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        above = {s for s in sizes if s not in full and goal[s] >= epochs * sizes[s]}
        if not above:
            return goal
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 5, "d": 0, None: 7}, {"x": 3}, {"a": 1, "b": 1000}, {"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 0}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)})
    assert got == pytest.approx(want)


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, size(t)) for d, t, *_ in ROWS)
    by: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == round(own[0]["target"])
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def test_copies(docs, empty):
    kept = mixing.copies(docs)
    assert kept.columns == docs.columns
    assert kept.where("size(split(coalesce(text, ''), ' ')) > 3").count() > 0
    assert mixing.copies(empty).count() == 0


def test_sql_agrees(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 17)), None if i % 11 == 0 else f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(mixing.OP6_SQL).fetchall()}
    for r in mixing.op6_mixing(spark, str(tmp_path)).collect():
        w = want[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (w[1], w[2], w[4]) and r["target"] == pytest.approx(w[3])
