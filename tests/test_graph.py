import heapq
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fernweave.graph import EDGE_WEIGHTS, Graph
from fernweave.operators import communities, detail, enrich, ranking, search, traverse
from fernweave.sources import graph_json

from . import fixtures


@pytest.fixture(scope="module", params=[0, 1, 2])
def any_dialect(spark, tmp_path_factory, request):
    return graph_json.read_graph(spark, fixtures.as_json(tmp_path_factory.mktemp("g") / "g.json", request.param))


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    return graph_json.read_graph(spark, fixtures.as_json(tmp_path_factory.mktemp("g") / "g.json"))


def test_dialects(any_dialect):
    assert any_dialect.nodes.count() == 13 and any_dialect.edges.count() == 12
    first = any_dialect.nodes.where("ord = 0").first()
    assert (first["start_line"], first["end_line"], first["signature"], first["repo"]) == (3, 9, "open_db()", "shop-core")
    assert {tuple(r) for r in any_dialect.edges.select("src", "dst", "type", "confidence").collect()} == {(*e, 0.5) for e in fixtures.EDGES}


def test_degrees(g):
    got = {r["id"]: (r["in_degree"], r["out_degree"], round(r["betweenness"], 4)) for r in g.with_degrees().collect()}
    assert got["fn:load_user"] == (4, 3, 1.0)
    assert got["fn:open_db"] == (3, 1, 0.25)
    assert got["fn:Users.get"] == (1, 1, 0.0833)
    assert got["fn:place_order"] == (0, 2, 0) and got["mod:settings"] == (1, 0, 0)


def test_guards(spark):
    nodes = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "again")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("a", "a", "calls"), ("a", "gone", "calls"), ("a", "b", "imports")], "src string, dst string, type string")
    kept = Graph(nodes, edges).guarded()
    assert kept.nodes.count() == 2 and {tuple(r) for r in kept.edges.collect()} == {("a", "b", "calls"), ("a", "b", "imports")}


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search(g):
    assert ids(search.search_nodes(g, "user"))[0] == "fn:load_user"
    assert set(ids(search.search_nodes(g, "USER services"))) == {"fn:load_user", "fn:change_user"}
    assert ids(search.search_nodes(g, "load_user(){}")) == ["fn:load_user", "fn:test_load_user"]
    assert ids(search.search_nodes(g, "loadXuser")) == [] and "fn:load_user" in ids(search.search_nodes(g, "load%user"))
    assert ids(search.search_nodes(g, "db", repo="shop-web")) == ["fn:db_health"]
    assert set(ids(search.search_nodes(g, "users", type="class"))) == {"cls:Users"}
    assert search.search_nodes(g, '""').count() == 0
    assert [r["rank"] for r in search.search_nodes(g, "db", top_k=2).collect()] == [-2, -1]
    assert set(ids(search.fuzzy_match(g, "user_load"))) == {"fn:load_user", "fn:test_load_user"}
    assert search.fuzzy_match(g, "_").count() == 0
    assert ids(search.resolve(g, "cls:Auth")) == ["cls:Auth"] == ids(search.resolve(g, "Auth"))
    assert ids(search.resolve(g, "sign")) == ["fn:sign_in"] and ids(search.resolve(g, "sign", fuzzy=False)) == []
    assert search.suggestions(g, "sign").first()[0] == "sign_in (function, shop-api/src/auth/service.py)"


def levels(df, way):
    out = defaultdict(dict)
    for r in df.where(F.col("direction") == way).collect():
        out[r["depth"]][r["label"]] = (r["edge_type"], r["via"])
    return dict(out)


def test_impact(g):
    up = levels(traverse.impact(g, "fn:open_db"), "upstream")
    assert set(up[1]) == {"load_user", "place_order", "db_health"} and all(v == ("calls", None) for v in up[1].values())
    assert up[2] == {"change_user": ("calls", "load_user"), "Users.get": ("calls", "load_user")}
    assert up[3] == {"Users": ("contains", "Users.get")}
    assert "test_load_user" in levels(traverse.impact(g, "fn:open_db", include_tests=True), "upstream")[2]
    down = levels(traverse.impact(g, "fn:Users.get", "downstream"), "downstream")
    assert set(down[2]) == {"open_db", "valid_user", "settings"} and down[2]["settings"] == ("imports", "load_user") and set(down[3]) == {"db_url"}
    assert traverse.impact(g, "unknown").count() == 0
    across = {r["repo"]: r["n"] for r in traverse.cross_repo_impact(g, "fn:open_db", traverse.impact(g, "fn:open_db")).collect()}
    assert across == {"shop-api": 5, "shop-web": 1}


@pytest.mark.parametrize("start,goal,depth,cost,hops", [("fn:load_user", "fn:open_db", 10, 1.0, 1), ("fn:Users.get", "fn:open_db", 10, 2.0, 2), ("fn:Users.get", "fn:db_url", 10, 3.0, 3), ("fn:Users.get", "fn:db_url", 1, None, 0), ("cls:Users", "mod:settings", 10, 1.8, 3), ("fn:open_db", "mod:settings", 10, None, 0), ("cls:Auth", "cls:Auth", 10, 0.0, 0), ("x", "cls:Auth", 10, None, 0)])
def test_shortest_path(g, start, goal, depth, cost, hops):
    rows = traverse.shortest_path(g, start, goal, depth).collect()
    if cost is None:
        assert rows == []
    else:
        assert rows[-1]["cost"] == pytest.approx(cost) and len(rows) == hops + 1 and (rows[0]["id"], rows[-1]["id"]) == (start, goal)


def random_graph(spark, seed, n=25, m=60):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(list(EDGE_WEIGHTS))) for _ in range(m)}
    edges = [e for e in sorted(edges) if e[0] != e[1]]
    nodes = [(f"n{i}", f"n{i}", "function", f"r/f{i}.py", "r", str(i % 4), None, None) for i in range(n)]
    return Graph(spark.createDataFrame(nodes, "id string, label string, type string, source_file string, repo string, community string, properties string, ord long"), spark.createDataFrame([(*e, None, None) for e in edges], "src string, dst string, type string, confidence double, ord long")), edges, [x[0] for x in nodes]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_walks(spark, seed):
    g, edges, names = random_graph(spark, seed)
    out = defaultdict(list)
    for a, b, t in edges:
        out[a].append((b, t))
    depth = {"n0": 0}
    queue = ["n0"]
    for a in queue:
        for b, _ in out[a]:
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    got = {r["id"]: r["depth"] for r in traverse.impact(g, "n0", "downstream", 4).collect()}
    assert got == {k: d for k, d in depth.items() if 0 < d <= 4}
    dist, heap = {}, [(0.0, "n0")]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in dist:
            dist[a] = d
            for b, t in out[a]:
                if t != "references":
                    heapq.heappush(heap, (d + EDGE_WEIGHTS[t], b))
    for goal in ("n7", "n19"):
        rows = traverse.shortest_path(g, "n0", goal).collect()
        assert (rows[-1]["cost"] if rows else None) == (pytest.approx(dist[goal]) if goal in dist else None)
    root = {n: n for n in names}
    for _ in names:
        for a, b, _t in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["component"] for r in communities.connected_components(g).collect()} == root


def plain_louvain(names, pairs, levels=4, passes=6):
    """Moves of a half at a time, over dictionaries."""
    links = Counter({p: 1 for a, b in pairs if a != b for p in ((a, b), (b, a))})
    two_m, member = sum(links.values()), {n: n for n in names}
    for level in range(levels):
        strength = Counter()
        for (a, _), w in links.items():
            strength[a] += w
        turn = {a: xxhash.xxh64_intdigest(struct.pack("<i", level), xxhash.xxh64_intdigest(a, 42)) % 2 for a in strength}
        own, moved = {a: a for a in strength}, False
        for k in range(passes):
            total, inside = Counter(), {a: Counter({own[a]: 0}) for a in strength}
            for a, c in own.items():
                total[c] += strength[a]
            for (a, b), w in links.items():
                if a != b:
                    inside[a][own[b]] += w
            gain = lambda a, c: round(inside[a][c] - strength[a] * (total[c] - strength[a] * (c == own[a])) / two_m, 9)  # noqa: B023, E731
            new = {a: c if turn[a] != k % 2 else min(inside[a], key=lambda x: (-gain(a, x), x != own[a], x)) for a, c in own.items()}  # noqa: B023
            n, own = sum(new[a] != own[a] for a in own), new
            moved = moved or n > 0
            if not n and k % 2:
                break
        if not moved:
            break
        member = {n: own.get(c, c) for n, c in member.items()}
        coarse = Counter()
        for (a, b), w in links.items():
            coarse[own[a], own[b]] += w
        links = coarse
    smallest = {}
    for n in sorted(names, reverse=True):
        smallest[member[n]] = n
    return {n: smallest[c] for n, c in member.items()}


def test_louvain_equals_a_plain_version_and_its_passes_carry_numbers(spark, monkeypatch):
    from fernweave.storage import stored

    steps = []

    def noted(df, label):
        steps.append((label, {t for _, t in df.dtypes}, df._jdf.queryExecution().sparkPlan().toString()))
        return stored(df, label)

    monkeypatch.setattr(communities, "stored", noted)
    rng = random.Random(3)
    names = [f"n:{i}" for i in range(70)]
    pairs = {tuple(sorted(rng.sample(names[10 * c : 10 * c + 10], 2))) for c in range(6) for _ in range(22)} | {tuple(sorted(rng.sample(names[:60], 2))) for _ in range(25)}
    g = Graph(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(*p, "calls") for p in sorted(pairs)], "src string, dst string, type string"))
    want = plain_louvain(names, pairs)
    assert {r["id"]: r["community"] for r in communities.louvain(g).collect()} == want
    assert 10 < len(set(want.values())) < 30  # 10 of them without edges
    moves = [(kinds, plan) for label, kinds, plan in steps if label == "louvain-moves"]
    assert len(moves) > 3 and all("string" not in kinds and plan.count("Join") <= 2 and "Broadcast" not in plan for kinds, plan in moves)


def test_louvain_writes_letters_between_parts_without_joins(spark, monkeypatch):
    """Many parts, ends that are no nodes, repeated edges; a pass is three exchanges of packed arrays."""
    from fernweave.storage import stored

    plans = []

    def noted(df, label):
        if label == "louvain-moves":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(communities, "stored", noted)
    monkeypatch.setattr(communities, "NODES", 20)
    rng = random.Random(5)
    names = [f"m:{i}" for i in range(64)]
    pairs = sorted({tuple(rng.sample(names[8 * c : 8 * c + 8], 2)) for c in range(8) for _ in range(18)} | {tuple(rng.sample(names, 2)) for _ in range(15)})
    known = {n for n in names if rng.random() < 0.8} | {"alone"}
    g = Graph(spark.createDataFrame([(n,) for n in sorted(known)], "id string"), spark.createDataFrame([(*p, "calls") for p in pairs + pairs[:9]], "src string, dst string, type string"))
    groups = defaultdict(list)
    for n, c in plain_louvain(names, {tuple(sorted(p)) for p in pairs}).items():
        if n in known:
            groups[c].append(n)
    want = {n: min(members) for members in groups.values() for n in members} | {"alone": "alone"}
    assert {r["id"]: r["community"] for r in communities.louvain(g).collect()} == want
    assert len(plans) > 3 and all("Join" not in plan and plan.count("RepartitionById") + plan.count("REPARTITION_BY") <= 3 for plan in plans)


def test_letters_come_back_whole_and_in_order(monkeypatch):
    from fernweave.operators import letters as post

    monkeypatch.setattr(post, "LONGEST", 7)
    rng = np.random.default_rng(1)
    a, b, key = rng.integers(-9, 1 << 40, 50), rng.random(50), rng.integers(0, 9, 50) << 50
    mail = post.Mail()
    for _, kind, src, at, data in sorted([*post.letters(0, post.C, 3, a, b), *post.runs(0, post.EDGE, 3, key, a)], key=lambda x: -x[3]):
        mail.box.setdefault(kind, []).append((src, at, data))
    x, y = mail.read(post.C, np.int64, np.float64)
    assert np.array_equal(x, a) and np.array_equal(y, b)
    keys, counts, rows = mail.runs(post.EDGE, np.int64)
    assert sorted(zip(np.repeat(keys, counts).tolist(), rows.tolist())) == sorted(zip(key.tolist(), a.tolist()))
    h = [xxhash.xxh64_intdigest(n, 42) for n in ("a:1", "b:22", "", "\u00e9")]
    for level in (0, 1, 3):
        assert post.turns(np.array(h, np.uint64).view(np.int64), level).tolist() == [xxhash.xxh64_intdigest(struct.pack("<i", level), x) % 2 for x in h]
    assert post.rounded(np.array([1.25e-8, -1.25e-8, 2.4e-9, 5e6])).tolist() == [1.3e-8, -1.3e-8, 2e-9, 5e6]


def test_louvain_finds_cliques(spark):
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(6) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    names = sorted({x for p in pairs for x in p}) + ["alone"]
    g = Graph(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, type string"))
    found = communities.louvain(g)
    got = {r["id"]: r["community"] for r in found.collect()}
    assert got == {n: ("alone" if n == "alone" else f"{n[0]}0") for n in names}
    value = communities.modularity(g, found).first()[0]
    m = len(pairs)
    degrees = [2 * 15 + 1, 2 * 15 + 2, 2 * 15 + 1]
    assert value == pytest.approx(45 / m - sum(d * d for d in degrees) / (4 * m * m))
    assert communities.louvain(Graph(g.nodes, g.edges.limit(0))).count() == len(names)


def test_detail_and_context(g):
    row = detail.node_detail(g, "load_user").first()
    groups = {(e["direction"], e["type"]): [x["neighbour_label"] for x in e["edges"]] for e in row["edges"]}
    assert groups[("outgoing", "calls")] == ["open_db", "valid_user"] and groups[("outgoing", "imports")] == ["settings"]
    assert detail.node_detail(g, "nothing").count() == 0
    hits = search.search_nodes(g, "open_db")
    assert set(ids(traverse.bfs_context(g, hits, 1))) == {"fn:load_user", "fn:place_order", "fn:db_health", "fn:db_url"}
    assert "fn:Users.get" in {r["src"] for r in detail.neighbours_of(g, search.fuzzy_match(g, "load_user", 1)).collect()}


def plain_walk(starts, depth):
    """A stack's walk over the fixture's edges, by recursion on what lies above it."""
    of = defaultdict(list)
    for a, b, kind in sorted(fixtures.EDGES, key=lambda e: (e[1], e[2])):
        of[a].append((b, (a, kind, b)))
    for a, b, kind in fixtures.EDGES:
        of[b].append((a, (a, kind, b)))
    seen, out = set(), []

    def visit(pending):
        if not pending:
            return
        (node, d), *rest = pending
        if node in seen or d > depth:
            return visit(rest)
        seen.add(node)
        new = [x for x in of[node] if x[0] not in seen]
        out.extend(edge for _, edge in new)
        visit([(other, d + 1) for other, _ in reversed(new)] + rest)

    visit([(s, 0) for s in starts])
    return out


@pytest.mark.parametrize("starts,depth", [(["fn:open_db"], 1), (["fn:open_db"], 3), (["fn:sign_in", "fn:db_url", "fn:Users.get"], 2), (["cls:Auth", "fn:load_user"], 0)])
def test_depth_first_equals_a_plain_walk(g, starts, depth):
    hits = g.nodes.sparkSession.createDataFrame([(s, k) for k, s in enumerate(starts)], "id string, rank int")
    assert traverse.dfs_context(g, hits, depth) == plain_walk(starts, depth)


def test_boundary_metrics(spark):
    nodes = [(n, n, "function", c) for n, c in zip("ABCDE", "00110", strict=True)]
    base = [("A", "B"), ("A", "C"), ("C", "D")]
    for edges, want, between in (
        (base, {"A": (1, 1, 0.5), "B": (1, 0, 0), "C": (1, 1, 0.5), "D": (1, 0, 0), "E": (0, 0, 0)}, 1),
        ([*base, ("B", "C"), ("B", "D"), ("E", "C"), ("E", "D")], {"A": (1, 1, 0.5), "B": (1, 2, 0.667), "C": (1, 3, 0.75), "D": (1, 2, 0.667), "E": (0, 2, 1)}, 5),
    ):
        g = Graph(spark.createDataFrame(nodes, "id string, label string, type string, community string"), spark.createDataFrame([(*e, "calls") for e in [*edges, ("A", "gone")]], "src string, dst string, type string"))
        got = {r["id"]: (r["internal_degree"], r["external_degree"], round(r["boundary_ratio"], 3)) for r in enrich.boundary_metrics(g).collect()}
        assert got == want
        density = {(r["community_a"], r["community_b"]): r["edge_count"] for r in enrich.community_density(g).collect()}
        assert density == {("0", "1"): between, ("0", "unclustered"): 1}


def test_routing(spark, g):
    nodes = spark.createDataFrame([(n, c) for n, c in zip("abcd", "1123", strict=True)], "id string, community string")
    own = Graph(nodes, g.edges)
    moves = spark.createDataFrame([("a", "2", 1), ("a", "3", 2)], "id string, to string, ord int")
    merges = spark.createDataFrame([("3", "2", 1), ("2", "9", 1)], "community string, target string, ord int")
    splits = spark.createDataFrame([("d", "9", "9_x", 1)], "id string, community string, new_community string, ord int")
    got = {r["id"]: (r["community"], r["moved"]) for r in enrich.apply_routing(own, moves, merges, splits).collect()}
    assert got == {"a": ("9", True), "b": ("1", False), "c": ("9", True), "d": ("9_x", True)}


def test_reports(g):
    assert ranking.hotspots(g, 1, "nonsense").first()["id"] == "fn:load_user"
    assert ranking.graph_stats(g).first()["repo_count"] == 3
    assert {r["id"] for r in ranking.high_degree(g).collect()} == {"fn:load_user", "fn:open_db", "fn:Users.get"}
    text = {r["id"]: r["description"] for r in ranking.describe(g.nodes.join(ranking.total_degree(g), "id")).collect()}
    assert text["fn:load_user"] == "Function with 7 connections in shop-api/src/services/users.py."
    assert {r["src_repo"]: r["dst_repo"] for r in ranking.cross_repo_flows(g).collect()}["shop-web"] == "shop-core"
    assert {r["community"]: r["primary_path"] for r in ranking.primary_path(g).collect()}["1"] == "shop-api/src/services"
    assert ranking.page_edges(g, 2).count() == 4


def test_tables_round_trip(spark, g, tmp_path):
    path = str(tmp_path / "tables")
    assert graph_json.write_tables(g, path) and not graph_json.write_tables(g, path)
    again = graph_json.read_tables(spark, path)
    assert again.nodes.count() == 13 and ids(search.search_nodes(again, "sign")) == ["fn:sign_in"]
    changed = Graph(g.nodes.where("id <> 'cls:Auth'"), g.edges)
    assert graph_json.write_tables(changed, path)
    graph_json.as_views(g)
    assert spark.sql("select count(*) from edges e join nodes n on e.dst = n.id where n.label = 'load_user'").first()[0] == 4


def test_enrichment_inputs(spark, g, tmp_path):
    for k, body in enumerate(('[{"id": "a", "description": "first"}]', '{"id": "a", "description": "second"}', '[{"id": "b", "description": null}]')):
        (tmp_path / f"batch-{k}.json").write_text(body)
    got = enrich.merge_answers(spark, f"{tmp_path}/batch-*.json", "id string, description string").collect()
    assert {r["id"]: r["description"] for r in got} == {"a": "second", "b": None}
    moves = spark.createDataFrame([("fn:sign_in", "1", 1), ("cls:Auth", "1", 1)], "id string, to string, ord int")
    routed = enrich.apply_routing(g, moves)
    again = enrich.reprofile_inputs(g, routed).collect()
    assert [(r["community"], r["size"]) for r in again] == [("1", 4)] and len(again[0]["members"]) == 4
    pairs, more, large = enrich.restructure_inputs(g, moves)
    assert {r["community"]: r["gained"] for r in more.collect()} == {"1": 2} and pairs.count() > 0 and large.count() == 0
    rows = enrich.routing_inputs(g, spark.createDataFrame([("fn:db_url",)], "id string")).collect()
    assert "fn:db_url" in {r["id"] for r in rows} and all(r["chunk"] == 1 for r in rows)
    assert enrich.profile_inputs(g, least=2).where("community = '2'").first()["edges"][0]["dst"] == "fn:Users.get"
