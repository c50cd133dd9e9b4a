"""The registered queries of the graph engine and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernweave.functions import text as tx
from fernweave.operators import communities, detail, diff, enrich, extract, ranking, search, traverse, vectors
from fernweave.sources import vector_tables
from fernweave.sources.star import STAR_SQL, key, load, star_graph, star_graph_with_repeats
from fernweave.storage import shared_dir
from fernweave.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DEPTH = 4


def query(sql: str | None = None, graph: bool = True):
    """Registers a query by its function's name, with its SQL; with graph, the SQL follows the tables nodes, edges, degrees and full_nodes."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {STAR_SQL}{sql}" if graph else sql
        return f

    return add


def like(column: str, term: str) -> str:
    return f"coalesce({LOWER.format(column)} LIKE '%{term}%', false)"


def terms_sql(words: list[str], columns: list[str]) -> str:
    return " AND ".join("(" + " OR ".join(like(c, w) for c in columns) + ")" for w in words)


def hotspots_sql(metric: str) -> str:
    return f"SELECT id, label, type, source_file, repo, in_degree, out_degree, in_degree + out_degree AS degree, round(betweenness, 9) AS betweenness FROM full_nodes ORDER BY {metric} DESC, id LIMIT 20"


@query(hotspots_sql("degree"))
def hotspots_degree(spark, sf_dir):
    return ranking.hotspots(star_graph(spark, sf_dir), 20).withColumn("betweenness", F.round("betweenness", 9))


@query(hotspots_sql("in_degree"))
def hotspots_in_degree(spark, sf_dir):
    return ranking.hotspots(star_graph(spark, sf_dir), 20, "in_degree").withColumn("betweenness", F.round("betweenness", 9))


@query(hotspots_sql("full_nodes.betweenness"))
def hotspots_betweenness(spark, sf_dir):
    return ranking.hotspots(star_graph(spark, sf_dir), 20, "betweenness").withColumn("betweenness", F.round("betweenness", 9))


@query("SELECT id, in_degree, out_degree FROM full_nodes")
def node_degrees(spark, sf_dir):
    return star_graph(spark, sf_dir).with_degrees().select("id", "in_degree", "out_degree")


@query("SELECT count(*) AS node_count, count(DISTINCT repo) AS repo_count, count(DISTINCT source_file) AS file_count, count(DISTINCT community) AS community_count, (SELECT count(*) FROM edges) AS edge_count FROM nodes")
def graph_stats(spark, sf_dir):
    return ranking.graph_stats(star_graph(spark, sf_dir))


@query("SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_type_distribution(spark, sf_dir):
    return ranking.edge_types(star_graph(spark, sf_dir))


@query("SELECT a.repo AS src_repo, b.repo AS dst_repo, count(*) AS n FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.repo <> b.repo GROUP BY 1, 2")
def cross_repo_flows(spark, sf_dir):
    return ranking.cross_repo_flows(star_graph(spark, sf_dir))


@query("SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def community_sizes(spark, sf_dir):
    return ranking.community_sizes(star_graph(spark, sf_dir))


@query("SELECT id, label, type, source_file, in_degree + out_degree AS degree FROM full_nodes WHERE community = '3'")
def community_members(spark, sf_dir):
    return ranking.community_members(star_graph(spark, sf_dir), "3")


@query("SELECT id, label AS name, type, in_degree + out_degree AS degree FROM full_nodes WHERE in_degree + out_degree > 0 ORDER BY 4 DESC, 2, 1 LIMIT 15")
def report_god_nodes(spark, sf_dir):
    return ranking.god_nodes(star_graph(spark, sf_dir))


TOP_COMMUNITIES = "top AS (SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"


@query(f", {TOP_COMMUNITIES} SELECT community, size, place, id, label, degree FROM (SELECT f.community, size, id, label, in_degree + out_degree AS degree, row_number() OVER (PARTITION BY f.community ORDER BY in_degree + out_degree DESC, id) AS place FROM full_nodes f JOIN top USING (community)) WHERE place <= 5")
def report_key_members(spark, sf_dir):
    return ranking.key_members(star_graph(spark, sf_dir))


@query("SELECT '.' || lower(lang) AS extension, count(DISTINCT source || '/' || doc_id) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1", graph=False)
def file_type_distribution(spark, sf_dir):
    """Documents as files: the source is the folder, the language the ending."""
    from fernweave.graph import Graph

    docs = load(spark, sf_dir, "documents").where("lang is not null and source is not null")
    nodes = docs.select(F.lit("document").alias("type"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("source_file"))
    return ranking.file_types(Graph(nodes, nodes))


@query("SELECT id, label, type, source_file, degree FROM (SELECT *, in_degree + out_degree AS degree, row_number() OVER (ORDER BY in_degree + out_degree DESC, id) AS k, count(*) OVER () AS n FROM full_nodes WHERE in_degree + out_degree > 0) WHERE k <= ceil(n * (1.0::DOUBLE - 0.8::DOUBLE))")
def high_degree_selection(spark, sf_dir):
    return ranking.high_degree(star_graph(spark, sf_dir))


@query("SELECT id, upper(type[1]) || type[2:] || ' with ' || (in_degree + out_degree) || ' connections' || coalesce(' in ' || source_file, '') || '.' AS description FROM full_nodes WHERE in_degree + out_degree > 0")
def descriptions(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return ranking.describe(g.nodes.join(ranking.total_degree(g), "id")).select("id", "description")


@query("SELECT community, place, id, label, type FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY CASE type WHEN 'class' THEN 3 WHEN 'module' THEN 2 WHEN 'function' THEN 1 ELSE 0 END DESC, id) AS place FROM nodes WHERE community IS NOT NULL) WHERE place <= 5")
def hubs(spark, sf_dir):
    return ranking.hubs(star_graph(spark, sf_dir))


DIRS = ", d AS (SELECT community, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir, source_file FROM nodes WHERE community IS NOT NULL), c AS (SELECT community, dir, count(*) AS n, min(source_file) AS f FROM d GROUP BY 1, 2)"


@query(f"{DIRS} SELECT community, CASE WHEN dir = '' THEN regexp_extract(f, '[^/]*$') ELSE dir END AS primary_path FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, f) AS k FROM c) WHERE k = 1")
def primary_path(spark, sf_dir):
    return ranking.primary_path(star_graph(spark, sf_dir))


@query(f"{DIRS}, h AS (SELECT community, string_agg(label, ', ' ORDER BY place) AS hubs FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS place FROM nodes WHERE community IS NOT NULL) WHERE place <= 5 GROUP BY 1), p AS (SELECT community, CASE WHEN dir = '' THEN regexp_extract(f, '[^/]*$') ELSE dir END AS path FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, f) AS k FROM c) WHERE k = 1), z AS (SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY 1) SELECT community, size, 'Community of ' || size || ' nodes in ' || path || ': ' || hubs || '.' AS summary FROM z JOIN p USING (community) JOIN h USING (community) WHERE size >= 3")
def community_summaries(spark, sf_dir):
    return ranking.summaries(star_graph(spark, sf_dir))


@query("SELECT a.community AS src_community, b.community AS dst_community, count(*) AS n, round(least(greatest(1 + log2(count(*) + 1.0), 1.0), 6.0), 6) AS width FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.community <> b.community GROUP BY 1, 2")
def meta_edges(spark, sf_dir):
    return ranking.meta_edges(star_graph(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query("SELECT id, label, type, community, in_degree + out_degree AS degree, round(least(greatest(3 + 2 * sqrt(in_degree + out_degree), 3.0), 20.0), 6) AS size, coalesce(community::BIGINT, 0) % 20 AS colour FROM full_nodes WHERE in_degree + out_degree >= 40")
def page_nodes(spark, sf_dir):
    return ranking.page_nodes(star_graph(spark, sf_dir), 40).withColumn("size", F.round("size", 6))


@query(", k AS (SELECT id FROM full_nodes WHERE in_degree + out_degree >= 40) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def page_edges(spark, sf_dir):
    return ranking.page_edges(star_graph(spark, sf_dir), 40)


FIELDS = ["label", "type", "source_file", "community"]


def search_sql(words: list[str], where: str = "true", k: int = 25) -> str:
    return f"SELECT id, label, type, source_file, repo, community, in_degree, (row_number() OVER (ORDER BY first, in_degree DESC, id) - 1 - count(*) OVER ())::BIGINT AS rank FROM (SELECT *, CASE WHEN {like('label', words[0])} THEN 0 ELSE 1 END AS first FROM full_nodes WHERE {terms_sql(words, FIELDS)} AND {where} ORDER BY first, in_degree DESC, id LIMIT {k})"


@query(search_sql(["customer", "asia"]))
def search_nodes(spark, sf_dir):
    return search.search_nodes(star_graph(spark, sf_dir), '"customer" (ASIA)', 25)


@query(search_sql(["1_"], "repo = 'EUROPE' AND type = 'supplier'"))
def search_nodes_filtered(spark, sf_dir):
    return search.search_nodes(star_graph(spark, sf_dir), "1_", 25, repo="EUROPE", type="supplier")


@query(f"SELECT id, label, type, source_file, in_degree FROM full_nodes WHERE {terms_sql(['supplier', '01'], ['label'])} ORDER BY in_degree DESC, id LIMIT 10")
def fuzzy_match(spark, sf_dir):
    return search.fuzzy_match(star_graph(spark, sf_dir), "Supplier_01", 10)


def docs_graph(spark, sf_dir):
    """Documents with the parts that they are about: document k and part k, as far as there are parts. Whole texts are searched; 40 characters are shown as label."""
    from fernweave.graph import Graph

    g, docs = star_graph(spark, sf_dir), load(spark, sf_dir, "documents")
    nodes = docs.select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("id"), F.substring("text", 1, 40).alias("label"), F.lit("document").alias("type"), "source", F.lit(None).cast("string").alias("repo"), F.col("lang").alias("community"), F.col("text").alias("properties"), F.lit(None).cast("long").alias("ord"))
    nodes = nodes.select("id", "label", "type", F.col("source").alias("source_file"), "repo", "community", "properties", "ord")
    edges = docs.select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("doc_id").cast("string")).alias("dst"), F.lit("references").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("ord"))
    return Graph(g.nodes.unionByName(nodes), g.edges.unionByName(edges))


DOCS = ", docs AS (SELECT 'document:' || doc_id AS id, substring(text, 1, 40) AS label, 'document' AS type, source AS source_file, NULL::VARCHAR AS repo, doc_id, text FROM documents)"


@query(f"{DOCS} SELECT id, label, type, source_file, repo FROM docs WHERE {terms_sql(['the', 'src1'], ['label', 'source_file', 'text'])} ORDER BY label, id LIMIT 30")
def docs_search(spark, sf_dir):
    return search.search_docs(docs_graph(spark, sf_dir), "THE src1", 30)


@query(f"{DOCS}, h AS (SELECT id, doc_id FROM docs WHERE {terms_sql(['the', 'src1'], ['label', 'source_file', 'text'])} ORDER BY label, id LIMIT 30) SELECT n.id, n.label, n.type, n.source_file FROM nodes n JOIN h ON n.id = 'part:' || h.doc_id ORDER BY n.label, n.id LIMIT 10")
def docs_linked_code(spark, sf_dir):
    g = docs_graph(spark, sf_dir)
    return search.linked_code(g, search.search_docs(g, "THE src1", 30))


@query("SELECT e.src AS id, 'outgoing' AS direction, type, dst AS neighbour, (SELECT label FROM nodes n WHERE n.id = dst) AS neighbour_label, coalesce((SELECT n.repo <> m.repo FROM nodes n, nodes m WHERE n.id = dst AND m.id = src), false) AS is_cross_repo, false AS is_external FROM edges e WHERE src = 'nation:5' UNION ALL SELECT dst, 'incoming', type, src, (SELECT label FROM nodes n WHERE n.id = src), coalesce((SELECT n.repo <> m.repo FROM nodes n, nodes m WHERE n.id = src AND m.id = dst), false), false FROM edges WHERE dst = 'nation:5'")
def node_detail_edges(spark, sf_dir):
    return detail.node_edges(star_graph(spark, sf_dir), spark.createDataFrame([("nation:5",)], "id string"))


@query("SELECT id FROM nodes WHERE id = 'nation:7'")
def resolve_symbol(spark, sf_dir):
    return search.resolve(star_graph(spark, sf_dir), "nation:7")


WALK = """
, walk(id, depth, path, edge_type, via) AS (
  SELECT '{start}', 0, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR
  UNION ALL
  SELECT e.{to}, w.depth + 1, list_append(w.path, e.{to} || chr(1) || e.type), e.type, w.id FROM walk w JOIN edges e ON e.{at} = w.id WHERE w.depth < {depth}
), found AS (
  SELECT id, depth, edge_type, via FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS k FROM walk) WHERE k = 1 AND depth > 0 AND id <> '{start}'
)
SELECT '{way}' AS direction, depth, f.id, n.label, n.type, n.source_file, n.repo, f.edge_type, CASE WHEN depth > 1 THEN v.label END AS via
FROM found f JOIN nodes n ON n.id = f.id LEFT JOIN nodes v ON v.id = f.via
"""


@query(WALK.format(start="region:0", to="dst", at="src", depth=DEPTH, way="downstream"))
def impact_downstream(spark, sf_dir):
    return traverse.impact(star_graph(spark, sf_dir), "region:0", "downstream", DEPTH)


@query(WALK.format(start="part:7", to="src", at="dst", depth=3, way="upstream"))
def impact_upstream(spark, sf_dir):
    return traverse.impact(star_graph(spark, sf_dir), "part:7", "upstream", 3)


@query(WALK.format(start="customer:11", to="dst", at="src", depth=3, way="downstream").replace("SELECT 'downstream'", ", r AS (SELECT 'downstream'") + ") SELECT repo, count(*) AS n FROM r WHERE repo IS NOT NULL AND repo <> (SELECT repo FROM nodes WHERE id = 'customer:11') GROUP BY 1")
def impact_cross_repo(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return traverse.cross_repo_impact(g, "customer:11", traverse.impact(g, "customer:11", "downstream", 3))


@query(", u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), one AS (SELECT DISTINCT b AS id FROM u WHERE a = 'supplier:3' AND b <> 'supplier:3'), two AS (SELECT DISTINCT b AS id FROM u WHERE a IN (SELECT id FROM one) AND b <> 'supplier:3' AND b NOT IN (SELECT id FROM one)) SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two")
def bfs_context(spark, sf_dir):
    hits = spark.createDataFrame([("supplier:3", 1)], "id string, rank int")
    return traverse.bfs_context(star_graph(spark, sf_dir), hits, 2).select("id", "depth")


@query(", walk(id, hops, cost) AS (SELECT 'region:1', 0, 0 UNION ALL SELECT dst, hops + 1, cost + CASE type WHEN 'calls' THEN 10 WHEN 'imports' THEN 5 WHEN 'imports_from' THEN 5 WHEN 'contains' THEN 3 END FROM walk JOIN edges ON src = id WHERE type <> 'references' AND cost < 100 AND hops < 6) SELECT min(cost) / 10 AS cost FROM walk WHERE id = 'part:42'")
def shortest_path_cost(spark, sf_dir):
    path = traverse.shortest_path(star_graph(spark, sf_dir), "region:1", "part:42")
    return path.where("id = 'part:42'").select(F.round("cost", 6).alias("cost"))


WEIGHTS = "CASE type WHEN 'calls' THEN 10 WHEN 'imports' THEN 5 WHEN 'imports_from' THEN 5 WHEN 'contains' THEN 3 END"


STEPS = f", walk(id, hops, cost) AS (SELECT 'region:1', 0, 0 UNION SELECT dst, hops + 1, cost + {WEIGHTS} FROM walk JOIN edges ON src = id WHERE type <> 'references' AND cost < 100 AND hops < 6), best AS (SELECT id, min(cost) AS cost FROM walk GROUP BY id), prevs AS (SELECT e.dst AS id, min(struct_pack(src := e.src, type := e.type)) AS p FROM edges e JOIN best a ON a.id = e.src JOIN best b ON b.id = e.dst WHERE type <> 'references' AND a.cost + {WEIGHTS} = b.cost GROUP BY 1), back(id, k) AS (SELECT id, 0 FROM best WHERE id = 'part:42' UNION ALL SELECT p.src, k + 1 FROM back JOIN prevs ON prevs.id = back.id WHERE back.id <> 'region:1') SELECT (max(k) OVER () - k)::INT AS step, n.id, n.label, n.source_file, CASE WHEN n.id <> 'region:1' THEN prevs.p.type END AS edge_type, best.cost / 10 AS cost FROM back JOIN nodes n ON n.id = back.id JOIN best ON best.id = back.id LEFT JOIN prevs ON prevs.id = back.id"


@query(STEPS)
def shortest_path_steps(spark, sf_dir):
    return traverse.shortest_path(star_graph(spark, sf_dir), "region:1", "part:42").withColumn("cost", F.round("cost", 6))


@query(STEPS.replace("SELECT (max(k)", ", steps AS (SELECT (max(k)") + ") SELECT edge_type, count(*) AS n FROM steps WHERE edge_type IS NOT NULL GROUP BY 1")
def path_edge_types(spark, sf_dir):
    return traverse.path_edge_types(traverse.shortest_path(star_graph(spark, sf_dir), "region:1", "part:42"))


BOUNDARY = ", m AS (SELECT id, coalesce(community, 'unclustered') AS c FROM nodes), x AS (SELECT src, dst, a.c = b.c AS same FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id), y AS (SELECT src AS id, same FROM x UNION ALL SELECT dst, same FROM x), z AS (SELECT n.id, count(*) FILTER (WHERE same) AS i, count(*) FILTER (WHERE NOT same) AS e FROM nodes n LEFT JOIN y USING (id) GROUP BY 1)"


@query(f"{BOUNDARY} SELECT id, i AS internal_degree, e AS external_degree, round(CASE WHEN i + e > 0 THEN e / (i + e)::DOUBLE ELSE 0 END, 9) AS boundary_ratio, CASE WHEN i + e > 0 AND e / (i + e)::DOUBLE >= 0.3 THEN 'candidate' ELSE 'stable' END AS status FROM z")
def boundary_metrics(spark, sf_dir):
    return enrich.boundary_metrics(star_graph(spark, sf_dir)).withColumn("boundary_ratio", F.round("boundary_ratio", 9))


@query(", m AS (SELECT id, coalesce(community, 'unclustered') AS c FROM nodes) SELECT least(a.c, b.c) AS community_a, greatest(a.c, b.c) AS community_b, count(*) AS edge_count FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id WHERE a.c <> b.c GROUP BY 1, 2")
def community_density(spark, sf_dir):
    return enrich.community_density(star_graph(spark, sf_dir))


@query(", m AS (SELECT id, type, coalesce(community, 'unclustered') AS c FROM nodes), u AS (SELECT src AS id, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges), n AS (SELECT u.id, b.c AS community, count(*) AS n FROM u JOIN m a ON a.id = u.id AND a.type = 'supplier' JOIN m b ON b.id = u.o WHERE a.c <> b.c GROUP BY 1, 2) SELECT id, community, n, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, community) AS place FROM n) WHERE place <= 5")
def adjacent_communities(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return enrich.adjacent_communities(g, g.nodes.where("type = 'supplier'").select("id"))


@query(", z AS (SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY 1), k AS (SELECT size, row_number() OVER (ORDER BY size) AS r, count(*) OVER () AS n FROM z), md AS (SELECT min(size) AS median FROM k WHERE r >= floor(n / 2) + 1) SELECT community, size, median FROM z, md WHERE size > median * 1.05")
def size_outliers(spark, sf_dir):
    return enrich.size_outliers(star_graph(spark, sf_dir), factor=1.05)


@query("SELECT id, CASE WHEN type = 'supplier' THEN '0' ELSE community END AS community, coalesce(type = 'supplier' AND community <> '0', false) AS moved FROM nodes")
def apply_routing(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return enrich.apply_routing(g, g.nodes.where("type = 'supplier'").select("id", F.lit("0").alias("to"), F.lit(1).alias("ord")))


# Components in SQL over numbers in the order of the ids: labels spread round by round until no smaller one meets a node.
NUMBERED = ", num AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM nodes), u AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM edges JOIN num a ON a.id = src JOIN num b ON b.id = dst UNION SELECT b.k, a.k FROM edges JOIN num a ON a.id = src JOIN num b ON b.id = dst)"
SPREAD = ", cc(k, c) USING KEY (k) AS (SELECT num.k, least(num.k, coalesce(min(u.b), num.k)) FROM num LEFT JOIN u ON u.a = num.k GROUP BY num.k UNION SELECT x.b, x.c FROM (SELECT u.b, min(cc.c) AS c FROM cc JOIN u ON u.a = cc.k GROUP BY u.b) x JOIN recurring.cc AS r ON r.k = x.b WHERE x.c < r.c)"


@query(f"{NUMBERED}{SPREAD} SELECT n.id, m.id AS component FROM cc JOIN num n ON n.k = cc.k JOIN num m ON m.k = cc.c")
def connected_components(spark, sf_dir):
    """Over every node and edge: parts of which nothing is sold are components of their own."""
    return communities.connected_components(star_graph(spark, sf_dir))


@query("SELECT id, min(id) OVER (PARTITION BY community) AS component FROM nodes WHERE type IN ('nation', 'customer', 'supplier', 'order')")
def connected_components_by_nation(spark, sf_dir):
    """Without regions and parts, each nation with its customers, their orders and its suppliers is a component."""
    from fernweave.graph import Graph

    g = star_graph(spark, sf_dir)
    inner = g.edges.where("src not like 'region:%' and src not like 'part:%' and dst not like 'part:%' and type <> 'references'")
    return communities.connected_components(Graph(g.nodes.where("type not in ('region', 'part')"), inner))


@query()
def louvain_communities(spark, sf_dir):
    """Over every node and edge."""
    return communities.louvain(star_graph_with_repeats(spark, sf_dir))


@query(", m AS (SELECT id, coalesce(community, 'none') AS c FROM nodes), s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), x AS (SELECT p.c AS ca, q.c AS cb FROM s JOIN m p ON p.id = a JOIN m q ON q.id = b), d AS (SELECT c, count(*)::DOUBLE AS d FROM (SELECT ca AS c FROM x UNION ALL SELECT cb FROM x) GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (WHERE ca = cb)::DOUBLE AS i FROM x) SELECT round(i / m - (SELECT sum(d * d) FROM d) / (4 * m * m), 9) AS modularity FROM t")
def modularity(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return communities.modularity(g, g.nodes.select("id", F.coalesce("community", F.lit("none")).alias("community"))).select(F.round("modularity", 9).alias("modularity"))


TOKENS = "WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), '_', ' '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)::DOUBLE) + 1 AS idf FROM c GROUP BY 1)"
#: The hash of a term, folded over its characters in double precision.
HASH = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)), lambda h, x: ((((xor(h, x) + 2147483648) & 4294967295) - 2147483648)::DOUBLE * 16777619.0::DOUBLE)::BIGINT & 4294967295)"


@query(f"{TOKENS} SELECT term, df FROM f", graph=False)
def token_frequencies(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return vectors.inverse_frequencies(vectors.document_tokens(docs), docs).select("term", "df")


@query(f"{TOKENS} SELECT term, round(idf, 9) AS idf FROM f", graph=False)
def tfidf_idf(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return vectors.inverse_frequencies(vectors.document_tokens(docs), docs).select("term", F.round("idf", 9).alias("idf"))


@query(f"{TOKENS}, h AS (SELECT term, idf, {HASH.format('term')} % 384 AS bucket, CASE WHEN {HASH.format(chr(40) + 'term || ' + chr(39) + '_sign' + chr(39) + chr(41))} % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM f), w AS (SELECT doc_id, bucket, sum(n / total * idf * s) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS total FROM c) JOIN h USING (term) GROUP BY 1, 2) SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) + 0.0 AS weight FROM w", graph=False)
def tfidf_hashed_buckets(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    counts = vectors.document_tokens(docs)
    rows = vectors.hashed_weights(counts, vectors.inverse_frequencies(counts, docs))
    return rows.withColumn("weight", F.round("weight", 6) + F.lit(0.0))


VOCABULARY = TOKENS.replace("FROM documents), c AS", "FROM documents), bt AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), '_', ' '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)) AS term FROM benchmark), bc AS (SELECT item_id, term, count(*) AS n FROM bt GROUP BY 1, 2), c AS")


@query(f"{VOCABULARY}, h AS (SELECT term, coalesce(idf, 1.0) AS idf, {HASH.format('term')} % 384 AS bucket, CASE WHEN {HASH.format(chr(40) + 'term || ' + chr(39) + '_sign' + chr(39) + chr(41))} % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM (SELECT DISTINCT term FROM bc) LEFT JOIN f USING (term)), w AS (SELECT item_id, bucket, sum(n / total * idf * s) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY item_id)::DOUBLE AS total FROM bc) JOIN h USING (term) GROUP BY 1, 2) SELECT item_id, bucket, round(w / CASE WHEN norm = 0 THEN 1.0 ELSE norm END, 6) + 0.0 AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS norm FROM w)", graph=False)
def vocabulary_weights(spark, sf_dir):
    """The texts of benchmark, weighed by the saved frequencies of documents."""
    docs, path = load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/fernweave/vocabulary-{uuid.uuid4().hex}"
    vector_tables.write_vocabulary(vectors.inverse_frequencies(vectors.document_tokens(docs), docs), path)
    counts = vectors.document_tokens(load(spark, sf_dir, "benchmark"), "item_id")
    rows = vectors.hashed_weights(counts, vectors.known_frequencies(counts, vector_tables.read_vocabulary(spark, path)), "item_id")
    return rows.withColumn("weight", F.round("weight", 6) + F.lit(0.0))


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN p_size > 25 AND p_type <> p_name THEN 2 ELSE 1 END AS round, length(p_name) AS size FROM part", graph=False)
def vector_refresh(spark, sf_dir):
    """Vectors of parts by type or name and of suppliers, brought up to those of all parts by name: which round made each."""
    part, supplier = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    path = f"{shared_dir(spark)}/fernweave/vectors-{uuid.uuid4().hex}"
    made = lambda k: lambda rows: rows.select("id", F.array(F.lit(float(k)), F.length("text").cast("double")).alias("vector"))
    before = part.select(key("part", "p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name")).alias("text"))
    vector_tables.refresh_vectors(before.unionAll(supplier.select(key("supplier", "s_suppkey"), "s_name")), path, made(1))
    vector_tables.refresh_vectors(part.select(key("part", "p_partkey").alias("id"), F.col("p_name").alias("text")), path, made(2))
    return vector_tables.read_vectors(spark, path).select("id", F.col("vector")[0].cast("int").alias("round"), F.col("vector")[1].cast("long").alias("size"))


PROBE = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 9) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}) DESC, vec_id LIMIT 25", graph=False)
def vector_topk_cosine(spark, sf_dir):
    return vectors.similar(load(spark, sf_dir, "embeddings"), PROBE, 25, key="vec_id", vector="embedding").select("vec_id", "label", F.round("score", 9).alias("score"))


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 9) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}) DESC, vec_id LIMIT 10", graph=False)
def vector_topk_filtered(spark, sf_dir):
    return vectors.similar(load(spark, sf_dir, "embeddings"), PROBE, 10, F.col("label") == 3, "vec_id", "embedding").select("vec_id", "label", F.round("score", 9).alias("score"))


@query(f"SELECT id, round(text_rank, 6) AS text_rank, round(vector_score, 6) AS vector_score, round(c, 6) AS centrality, round(score, 6) AS score FROM (SELECT *, 0.35 * text_rank + 0.45 * vector_score + 0.20 * c AS score FROM (SELECT coalesce(t.id, v.id) AS id, coalesce(text_rank, 0) AS text_rank, coalesce(v.score, 0) AS vector_score, least(coalesce(d.in_degree + d.out_degree, 0) / 50.0, 1.0) AS c FROM (SELECT id, 1 - (row_number() OVER (ORDER BY in_degree DESC, id) - 1) / (count(*) OVER ())::DOUBLE AS text_rank FROM (SELECT * FROM full_nodes WHERE {like('label', 'supplier')} ORDER BY in_degree DESC, id LIMIT 30)) t FULL JOIN (SELECT 'supplier:' || vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}) AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 30) v ON t.id = v.id LEFT JOIN degrees d ON d.id = coalesce(t.id, v.id))) ORDER BY score DESC, id LIMIT 50")
def hybrid_fusion(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    text = search.search_nodes(g, "supplier", 30, type="supplier")
    text = text.select("id", (F.col("rank") + 1 + F.count(F.lit(1)).over(Window.partitionBy())).alias("rank"))
    near = vectors.similar(load(spark, sf_dir, "embeddings"), PROBE, 30, key="vec_id", vector="embedding").select(F.concat(F.lit("supplier:"), F.col("vec_id").cast("string")).alias("id"), "score")
    rows = vectors.fuse(text, near, ranking.total_degree(g))
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("text_rank", "vector_score", "centrality", "score")])


@query("SELECT conv_id, turn, tokens, used FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM (SELECT conv_id, turn, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM conversations)) WHERE used <= 300", graph=False)
def token_budget_prefix(spark, sf_dir):
    return vectors.within_budget(load(spark, sf_dir, "conversations"), 300, "turn", by=["conv_id"]).select("conv_id", "turn", "tokens", "used")


@query("WITH RECURSIVE i AS (SELECT source AS g, doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), r(g, k, doc_id, t, held, batch) AS (SELECT g, k, doc_id, t, t, 1 FROM i WHERE k = 1 UNION ALL SELECT i.g, i.k, i.doc_id, i.t, CASE WHEN r.held > 0 AND r.held + i.t > 4016 THEN i.t ELSE r.held + i.t END, CASE WHEN r.held > 0 AND r.held + i.t > 4016 THEN r.batch + 1 ELSE r.batch END FROM r JOIN i ON i.g = r.g AND i.k = r.k + 1) SELECT g AS \"group\", doc_id::VARCHAR AS id, t AS tokens, batch::BIGINT AS batch FROM r", graph=False)
def next_fit_batches(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), tx.token_count(F.col("text")).alias("tokens"))
    return enrich.next_fit(docs, 4096)


@query("WITH o AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'old/' ELSE 'd' END || doc_id AS path, md5(text) AS h FROM documents), n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'new/' ELSE 'd' END || doc_id AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents) SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (path)", graph=False)
def file_diff(spark, sf_dir):
    """Two snapshots of all documents, some under other paths in one of them, some with other texts."""
    docs, id_ = load(spark, sf_dir, "documents"), F.col("doc_id")
    path = lambda k, folder: F.concat(F.when(id_ % k == 0, F.lit(folder)).otherwise(F.lit("d")), id_.cast("string")).alias("path")
    old = docs.select(path(7, "old/"), F.md5("text").alias("hash"))
    new = docs.select(path(11, "new/"), F.md5(F.when(id_ % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return diff.file_diff(old, new)


LINKS, HEADINGS = [x.replace("'", "''") for x in (extract.LINK, extract.HEADING)]


@query(f"SELECT page_id, place, href, regexp_replace(label, '<[^>]*>', '', 'g') AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '{LINKS}', 1)) AS href, unnest(regexp_extract_all(html, '{LINKS}', 2)) AS label, generate_subscripts(regexp_extract_all(html, '{LINKS}', 1), 1) AS place FROM pages)", graph=False)
def page_links(spark, sf_dir):
    return extract.page_links(load(spark, sf_dir, "pages"))


@query(f"SELECT page_id, place, level::INT AS level, regexp_replace(heading, '<[^>]*>', '', 'g') AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '{HEADINGS}', 1)) AS level, unnest(regexp_extract_all(html, '{HEADINGS}', 2)) AS heading, generate_subscripts(regexp_extract_all(html, '{HEADINGS}', 1), 1) AS place FROM pages)", graph=False)
def page_sections(spark, sf_dir):
    return extract.page_sections(load(spark, sf_dir, "pages"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", graph=False)
def event_windows(spark, sf_dir):
    return changes.windowed_counts(load(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", graph=False)
def latest_events(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return changes.latest(rows, "user_id", "ts", "event_id")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL", graph=False)
def unlabelled_documents(spark, sf_dir):
    """Documents that still need a label: an anti-join as for stale vectors."""
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query()
def context_sections(spark, sf_dir):
    return vectors.build_context(star_graph(spark, sf_dir), "supplier europe", 2048)


# From one node, to a depth of one: its neighbours are visited in the opposite order of their last place among its edges, and an edge to a node visited before is left out.
WALK = ", s AS (SELECT src AS id, dst AS nxt, 0 AS way, * FROM edges UNION ALL SELECT dst, src, 1, * FROM edges), p AS (SELECT *, row_number() OVER (ORDER BY way, nxt, type) AS k FROM s WHERE id = 'supplier:3'), t AS (SELECT nxt AS id, row_number() OVER (ORDER BY max(k) DESC) AS t FROM p GROUP BY nxt)"


@query(f"{WALK} SELECT src, type, dst FROM p UNION ALL SELECT s.src, s.type, s.dst FROM s JOIN t ON t.id = s.id LEFT JOIN t AS m ON m.id = s.nxt WHERE s.nxt <> 'supplier:3' AND coalesce(m.t > t.t, true)")
def dfs_context(spark, sf_dir):
    hits = spark.createDataFrame([("supplier:3", 1)], "id string, rank int")
    return spark.createDataFrame(traverse.dfs_context(star_graph(spark, sf_dir), hits, 1), "src string, type string, dst string")
