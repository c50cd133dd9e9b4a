import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, top, asks=lambda i: i % 20 == 0):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero([asks(i) for i in ids]):
        score = x @ x[q]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[q]][:top]
        out[int(ids[q])] = [int(ids[k]) for k in order]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x = x if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    got: dict = {}
    for r in neighbours.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
        assert r["score"] == pytest.approx(float(np.dot(rows[r["query_id"]][1], rows[r["vec_id"]][1])), abs=1e-12)
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len({r["vec_id"] for r in got[q]} & set(w)) for q, w in want.items())
    assert hits >= 0.95 * 20 * len(want)
    for found in got.values():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)


def test_graph_round_trip_and_search():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    g = neighbours.Graph.loads(neighbours.Graph.build(x, np.arange(1500)[:, None]).dumps())
    assert len(g.nodes) >= 2 and all(len(a) > len(b) for a, b in zip(g.nodes, g.nodes[1:], strict=False))
    q = rng.normal(size=(100, 16))
    want = np.argsort(-(q @ x.T), 1)[:, :10]
    got = g.search(q)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(want, got, strict=True)]) > 0.95


def test_awkward_vectors(spark):
    copies = [(i, [1.0, 0.0], 0) for i in range(100, 180)]  # many equal vectors: the smallest ids win
    odd = [(200, None, 0), (201, [0.0, 0.0], 0), (202, [None, 1.0], 0), (203, [math.nan, 1.0], 0), (204, [math.inf, 1.0], 0), (206, [], 0), (None, [1.0, 1.0], 0)]
    few = [(0, [1.0, 0.5], None), (0, [1.0, 0.5], None), (20, [-1.0, 0.0], None)]
    df = spark.createDataFrame(copies + odd + few, SCHEMA).withColumns({c: F.lit(1) for c in ("rank", "score", "ids", "shard")})
    got: dict = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    rows = [(i, v) for i, v, _ in copies] + [(0, [1.0, 0.5]), (20, [-1.0, 0.0])]
    assert got == brute(rows, 20)
    longer = [(240, [1.0, 2.0, 3.0], 0), (241, [1.0, 0.0, 0.0], 0), (260, [7.0], 0)]  # each length is searched apart
    both = neighbours.nearest(df.select("vec_id", "embedding", "label").union(spark.createDataFrame(longer, SCHEMA)), F.col("vec_id") % 20 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in both if r["query_id"] == 240] == [(241, 1.0)] and not [r for r in both if r["query_id"] == 260]
    assert len(both) == sum(map(len, got.values())) + 1
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)
    assert neighbours.nearest(alone, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n,clusters,spread", [(6000, 15, 0.1), (3000, 8, 0.003)])
def test_recall_on_tight_clusters(n, clusters, spread):
    rng = np.random.default_rng(1)
    x = 3 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, 24))  # some 400 vectors each
    g, q = neighbours.Graph.build(x, np.arange(n)[:, None]), x[:200]
    want, got = np.argsort(-(q @ x.T), 1)[:, :20], g.search(q)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want, got, strict=True)]) > 0.95


def test_every_node_can_be_reached():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 8)) * 100, 60, 0) + 1e-4 * rng.normal(size=(2400, 8))
    g = neighbours.Graph.build(x, np.arange(2400)[:, None])
    assert len(g.nodes) > 1 and g.links[0].shape[1] < 64  # a graph, not a list of all pairs
    for at, (nodes, links) in enumerate(zip(g.nodes, g.links, strict=True)):
        front = set(g.nodes[at + 1].tolist() if at + 1 < len(g.nodes) else nodes[:1].tolist())
        assert front <= set(nodes.tolist())
        found = set()
        while front:
            found |= front
            front = {int(t) for f in front for t in links[g.places[at][f]] if t >= 0} - found
        assert found == set(nodes.tolist())


def plain_beam(x, place, links, q, rows, scores, beam):
    """beam_search() by wide tables: every row that a step meets has a place in them, whether it is new or good enough or not."""
    n, m = len(x), len(q)
    width = max(beam, rows.shape[1])
    ids, best = np.full((m, width), -1), np.full((m, width), -np.inf, np.float32)
    ids[:, : rows.shape[1]], best[:, : rows.shape[1]] = rows, scores
    seen = np.zeros((m, n), bool)
    seen[np.arange(m)[:, None], rows] = True
    done = ids < 0
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live], -np.inf, best[live])
        pick = np.argpartition(-open_, neighbours.EXPAND - 1, 1)[:, : neighbours.EXPAND]
        valid = np.isfinite(np.take_along_axis(open_, pick, 1))
        some = valid.any(1)
        live, pick, valid = live[some], pick[some], valid[some]
        if not len(live):
            break
        chosen = np.where(valid, ids[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        near = np.where((chosen >= 0)[:, :, None], links[place[np.maximum(chosen, 0)]], -1).reshape(len(live), -1).astype(np.int64)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], np.maximum(near, 0)]] = -1
        r, c = np.nonzero(near >= 0)
        seen[live[r], near[r, c]] = True
        score = np.full(near.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("ij,ij->i", x[near[r, c]], q[live[r]])
        every = [np.concatenate(z, 1) for z in ((ids[live], near), (best[live], score), (done[live], near < 0))]
        keep = np.argpartition(-every[1], width - 1, 1)[:, :width]
        ids[live], best[live], done[live] = (np.take_along_axis(z, keep, 1) for z in every)
    return ids, best


def test_beam_search_is_the_plain_one_at_less_cost():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neighbours.Graph.build(x, np.arange(3000)[:, None])
    q = rng.normal(size=(256, 64)).astype(np.float32)
    rows = np.repeat(g.nodes[1][:3][None], 256, 0)
    given = (g.x, g.places[0], g.links[0], q, rows, np.einsum("ijk,ik->ij", g.x[rows], q), 256)
    spent = {}
    for _ in range(3):
        for f in (plain_beam, neighbours.beam_search):
            start = time.process_time()
            found = f(*given)
            took = time.process_time() - start
            spent[f] = (min(took, spent[f][0]) if f in spent else took, *found)
    (plain_s, plain_ids, plain_best), (s, ids, best) = spent[plain_beam], spent[neighbours.beam_search]
    assert (np.diff(best, axis=1) <= 0).all()  # best first
    assert np.allclose(best, -np.sort(-plain_best, 1), atol=1e-5)
    assert np.mean([len(set(a) & set(b)) / 256 for a, b in zip(ids, plain_ids, strict=True)]) > 0.9999
    assert np.allclose(best, np.einsum("ijk,ik->ij", g.x[ids], q), atol=1e-5)
    assert s < 0.75 * plain_s  # 0.47 to 0.48 where it was written


def test_packed_rows_sort_and_come_back():
    score = np.array([[3.5, -0.0, -2.0, 0.0, 1e-40, -1e30, -np.inf, 1e30]], np.float32)
    rows = np.array([[5, 0, 99_999, 7, 1, 2, 3, 2**31 - 1]])
    keys = neighbours.packed(rows, score)
    got, back = neighbours.unpacked(np.sort(np.append(keys, [[neighbours.NONE] * 2], 1), 1))
    assert got[0].tolist() == [2**31 - 1, 5, 1, 7, 0, 99_999, 2, 3, -1, -1]
    assert (back[0, :8] == -np.sort(-score[0])).all() and (back[0, 8:] == -np.inf).all()
    assert (keys & 1).all() and not neighbours.NONE & 1


@pytest.mark.parametrize("n", [0, 1, 700])
def test_prune_takes_what_a_loop_takes(n):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    block = rng.permutation(900)[:n]
    near = np.argsort(((x[block][:, None] - x[None]) ** 2).sum(2), 1)[:, 1:41] if n else np.zeros((0, 40), int)
    near[::3, 30:] = -1
    got = neighbours.prune(block, near, x, 8)
    assert got.shape == (n, 8)
    for b, own, kept in zip(block, near, got, strict=True):
        want: list = []
        own = own[own >= 0]
        for c in own:
            if len(want) < 8 and all(((x[c] - x[b]) ** 2).sum() <= ((x[c] - x[w]) ** 2).sum() + 1e-5 for w in want):
                want.append(c)
        rest = [c for c in own if c not in want][: 8 - len(want)]
        assert len(set(kept.tolist()) & set(want + rest)) >= 7  # a rounding may turn one
