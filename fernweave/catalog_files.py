"""Registered queries over generated source files and documents, and over the inputs of enrichment, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.catalog import BOUNDARY, query
from fernweave.functions.text import grouped_number, parse_answer
from fernweave.operators import detail, embed, enrich, extract, outline, ranking, resolve, search, vectors
from fernweave.operators.enrich import CHUNK
from fernweave.sources import files, repos
from fernweave.sources.modules import document_files, module_files
from fernweave.sources.star import load, star_graph
from fernweave.storage import stored

# The generated modules in SQL: s (suppliers) and n (nations) with the path and the dotted name of each file, and all symbols.
CODE = """WITH n AS (SELECT n_nationkey AS n, n_name, 'src/n' || n_nationkey || '/base.py' AS path, 'src.n' || n_nationkey || '.base' AS module FROM nation),
s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'src/n' || s_nationkey || '/supplier_' || s_suppkey || '.py' AS path, 'src.n' || s_nationkey || '.supplier_' || s_suppkey AS module, 'Supplier' || s_suppkey AS class FROM supplier),
init AS (SELECT n_nationkey AS n, 'src/n' || n_nationkey || '/__init__.py' AS path FROM nation),
symbols AS (
  SELECT path AS file_path, 'LIMIT' AS name, module || '.LIMIT' AS qualified_name, 'constant' AS kind, 6 AS start_line, 6 AS end_line, NULL::VARCHAR AS parent FROM s
  UNION ALL SELECT path, class, module || '.' || class, 'class', 8, 14, NULL FROM s
  UNION ALL SELECT path, 'load', module || '.' || class || '.load', 'method', 10, 11, class FROM s
  UNION ALL SELECT path, 'total', module || '.' || class || '.total', 'method', 13, 14, class FROM s
  UNION ALL SELECT path, 'compute', module || '.compute', 'function', 16, 17, NULL FROM s
  UNION ALL SELECT path, 'Nation', module || '.Nation', 'class', 1, 3, NULL FROM n
  UNION ALL SELECT path, 'name', module || '.Nation.name', 'method', 2, 3, 'Nation' FROM n
  UNION ALL SELECT path, 'helper', module || '.helper', 'function', 5, 6, NULL FROM n
), known AS (
  SELECT path AS file_path, 'Nation' AS name, 'src.n' || n || '.base.Nation' AS symbol FROM s
  UNION ALL SELECT path, 'helper', 'src.n0.base.helper' FROM s
  UNION ALL SELECT path, 'Nation', 'src.n' || n || '.base.Nation' FROM init
  UNION ALL SELECT path, 'helper', 'src.n' || n || '.base.helper' FROM init
)
"""


def extractions(spark, sf_dir) -> DataFrame:
    """The generated modules' extractions, written, since several joins read them."""
    return stored(extract.Extractors().run(module_files(spark, sf_dir)), "extractions")


@query(f"{CODE} SELECT file_path, name, qualified_name, kind, start_line, end_line, parent FROM symbols", graph=False)
def code_symbols(spark, sf_dir):
    rows = extract.Extractors().run(module_files(spark, sf_dir))
    return resolve.symbols_of(rows).select("file_path", "name", "qualified_name", "kind", "start_line", "end_line", "parent")


@query("SELECT 'src/r' || r_regionkey || '/broken.py' AS file_path, 0::BIGINT AS symbols FROM region", graph=False)
def code_failures(spark, sf_dir):
    """Files that can't be parsed: they stay in the result, without symbols."""
    rows = extract.Extractors().run(module_files(spark, sf_dir))
    return rows.where("error is not null").select("file_path", F.size("symbols").cast("long").alias("symbols"))


@query(f"{CODE} SELECT path AS file_path, 'module' AS kind, regexp_extract(path, '[^/]*$') AS label, CASE WHEN k IS NOT NULL THEN 'Supplier ' || (SELECT s_name FROM supplier WHERE s_suppkey = k) || '.' END AS docstring FROM (SELECT path, k FROM s UNION ALL SELECT path, NULL FROM n UNION ALL SELECT path, NULL FROM init)", graph=False)
def code_files(spark, sf_dir):
    rows = extract.Extractors().run(module_files(spark, sf_dir)).where("error is null")
    return rows.select("file_path", "file_node.kind", "file_node.label", "file_node.docstring")


@query(f"{CODE} SELECT path AS file_path, 0 AS ord, '.base' AS module, 'src/n' || n || '/base.py' AS target FROM s UNION ALL SELECT path, 1, 'n0.base', 'src/n0/base.py' FROM s UNION ALL SELECT path, 2, 'os', NULL FROM s UNION ALL SELECT path, 0, '.base', 'src/n' || n || '/base.py' FROM init", graph=False)
def code_imports(spark, sf_dir):
    """Relative imports, imports found by the end of a path, and imports from outside."""
    return resolve.resolve_imports(extractions(spark, sf_dir)).select("file_path", "ord", "module", "target")


@query(f"{CODE} SELECT file_path, name, symbol FROM known", graph=False)
def code_imported_symbols(spark, sf_dir):
    rows = extractions(spark, sf_dir)
    return resolve.imported_symbols(rows, resolve.resolve_imports(rows))


EDGES = """
, edges AS (
  SELECT file_path AS src, qualified_name AS dst, 'contains' AS type FROM symbols
  UNION ALL SELECT regexp_replace(qualified_name, '\\.[^.]*$', ''), qualified_name, 'contains' FROM symbols WHERE parent IS NOT NULL
  UNION ALL SELECT file_path, symbol, 'imports_from' FROM known
  UNION ALL SELECT module || '.' || class, 'src.n' || n || '.base.Nation', 'extends' FROM s
  UNION ALL SELECT module || '.' || class || '.load', module || '.' || class || '.total', 'calls' FROM s
  UNION ALL SELECT module || '.' || class || '.total', module || '.compute', 'calls' FROM s
  UNION ALL SELECT module || '.compute', 'src.n0.base.helper', 'calls' FROM s
)
"""


@query(f"{CODE}{EDGES} SELECT src, dst, type FROM edges", graph=False)
def code_graph_edges(spark, sf_dir):
    """Containment, imports, and references resolved by self, by import and within a file."""
    return resolve.build_graph(extractions(spark, sf_dir)).edges.select("src", "dst", "type")


@query(f"{CODE} SELECT qualified_name AS id, name AS label, kind AS type, 'code' AS file_type, file_path AS source_file, 'src' AS repo, start_line, end_line FROM symbols UNION ALL SELECT path, regexp_extract(path, '[^/]*$'), 'module', 'code', path, 'src', NULL, NULL FROM (SELECT path FROM s UNION ALL SELECT path FROM n UNION ALL SELECT path FROM init)", graph=False)
def code_graph_nodes(spark, sf_dir):
    return resolve.build_graph(extractions(spark, sf_dir)).nodes.select("id", "label", "type", "file_type", "source_file", "repo", "start_line", "end_line")


# The generated documents in SQL: path, dotted name and title.
DOCS = "WITH d AS (SELECT 'docs/c' || c_custkey || '.md' AS path, 'docs.c' || c_custkey AS module, c_name AS title, regexp_replace(c_name, '[^a-zA-Z0-9_ -]', '', 'g') AS clean, c_nationkey AS n FROM customer)"


@query(f"{DOCS} SELECT path, clean AS name, module || '.' || clean AS qualified_name, 1 AS level, title AS docstring, 1 AS start_line, 5 AS end_line FROM d UNION ALL SELECT path, 'Orders', module || '.Orders', 2, 'Orders', 6, 9 FROM d UNION ALL SELECT path, 'Notes here', module || '.Notes_here', 2, 'Notes *here*', 10, 11 FROM d UNION ALL SELECT path, 'Orders', module || '.Orders_2', 2, 'Orders', 12, 13 FROM d", graph=False)
def doc_sections(spark, sf_dir):
    """Headings of both kinds, repeated names numbered, and where sections end."""
    return extract.sections(document_files(spark, sf_dir))


@query(f"{DOCS} SELECT path, 'compute' AS name, module || '.Orders' AS from_symbol, 7 AS line FROM d UNION ALL SELECT path, 'src/n' || n || '/base.py', module || '.Orders', 7 FROM d UNION ALL SELECT path, 'Nation.name', module || '.Notes_here', 11 FROM d UNION ALL SELECT path, 'compute', module || '.Notes_here', 11 FROM d", graph=False)
def doc_references(spark, sf_dir):
    return extract.code_references(document_files(spark, sf_dir))


@query(f"{DOCS} SELECT path, 'First line of ' || title || '. Second line.' AS docstring FROM d", graph=False)
def doc_first_paragraph(spark, sf_dir):
    return extract.first_paragraph(document_files(spark, sf_dir))


def document_tree(spark, sf_dir) -> DataFrame:
    """Documents as a listing of files: the source is the folder, the language the ending."""
    docs = load(spark, sf_dir, "documents").where("lang is not null and source is not null")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"))


TREE = "WITH f AS (SELECT source || '/' || doc_id || '.' || lang AS path, coalesce(n_chars, 0) AS size, source, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"


@query(f"{TREE} SELECT 'text' AS type, path, size FROM f WHERE lang IN ('en', 'fr') AND source <> 'src1' AND size <= 2048 UNION ALL SELECT 'other', path, size FROM f WHERE lang = 'de' AND source = 'src2' AND size <= 2048", graph=False)
def selected_files(spark, sf_dir):
    """Files by type: a type's own excludes and includes come before the common ones."""
    types = {"text": {"endings": [".en", ".fr"], "exclude": ["src1/**"]}, "other": {"endings": [".de"], "include": ["src2/*.de"]}}
    return files.select_files(document_tree(spark, sf_dir), types, include=["**/*"], max_kb=2)


@query(f"{TREE} SELECT '.' || lower(lang) AS extension, count(*) AS n FROM f GROUP BY 1", graph=False)
def extension_census(spark, sf_dir):
    return files.census(document_tree(spark, sf_dir), most=None)


ROUTED = ", c1 AS (SELECT id, type, community AS old, CASE WHEN type = 'supplier' THEN '0' ELSE community END AS community FROM nodes), c2 AS (SELECT id, type, old, CASE WHEN community IN ('1', '2') THEN '3' ELSE community END AS community FROM c1), c3 AS (SELECT id, old, CASE WHEN community = '4' AND type = 'customer' THEN '4b' ELSE community END AS community FROM c2)"


def routed(g) -> DataFrame:
    """Suppliers move to 0, 1 is merged into 2 and that into 3, and customers are split from 4."""
    spark = g.nodes.sparkSession
    moves = g.nodes.where("type = 'supplier'").select("id", F.lit("0").alias("to"), F.lit(1).alias("ord"))
    merges = spark.createDataFrame([("1", "2", 1), ("2", "3", 2)], "community string, target string, ord int")
    splits = g.nodes.where("type = 'customer'").select("id", F.lit("4").alias("community"), F.lit("4b").alias("new_community"), F.lit(1).alias("ord"))
    return enrich.apply_routing(g, moves, merges, splits)


@query(f"{ROUTED} SELECT id, community, old IS DISTINCT FROM community AS moved FROM c3")
def apply_restructuring(spark, sf_dir):
    return routed(star_graph(spark, sf_dir))


@query("SELECT (s_suppkey % 25)::VARCHAR AS community, count(*) AS gained FROM supplier GROUP BY 1", graph=False)
def nodes_gained(spark, sf_dir):
    moves = load(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") % 25).cast("string").alias("to"))
    return enrich.gained(star_graph(spark, sf_dir), moves)


MEMBERS = "SELECT community, size, place, id FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY in_degree + out_degree DESC, id) AS place, count(*) OVER (PARTITION BY community) AS size FROM full_nodes WHERE community IS NOT NULL) WHERE place <= 80 AND size >= 3"


@query(MEMBERS)
def profile_members(spark, sf_dir):
    """The members that describe a community, as many as a prompt takes."""
    rows = enrich.profile_inputs(star_graph(spark, sf_dir))
    return rows.select("community", "size", F.posexplode("members").alias("at", "m")).select("community", "size", (F.col("at") + 1).alias("place"), "m.id")


@query("SELECT community, src, type, dst FROM (SELECT a.community, src, e.type, dst, row_number() OVER (PARTITION BY a.community ORDER BY src, dst, e.type) AS place FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.community = b.community) WHERE place <= 50 AND community IN (SELECT community FROM nodes GROUP BY 1 HAVING count(*) >= 3)")
def profile_edges(spark, sf_dir):
    rows = enrich.profile_inputs(star_graph(spark, sf_dir))
    return rows.select("community", F.explode("edges").alias("e")).select("community", "e.src", "e.type", "e.dst")


@query(f"{BOUNDARY}, k AS (SELECT id FROM z WHERE i + e > 0 AND e / (i + e)::DOUBLE >= 0.3 UNION SELECT id FROM nodes WHERE type = 'supplier'), u AS (SELECT src AS id, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges), near AS (SELECT u.id, count(DISTINCT b.c) AS n FROM u JOIN m a ON a.id = u.id JOIN m b ON b.id = u.o WHERE a.c <> b.c GROUP BY 1) SELECT id, community, (least(coalesce(near.n, 0), 5))::INT AS adjacent, floor((row_number() OVER (PARTITION BY coalesce(community, 'unclustered') ORDER BY id) - 1) / {CHUNK})::BIGINT + 1 AS chunk FROM nodes JOIN k USING (id) LEFT JOIN near USING (id)")
def routing_chunks(spark, sf_dir):
    """Candidates by their boundary and misfits, with the number of communities next to them, in chunks."""
    g = star_graph(spark, sf_dir)
    rows = enrich.routing_inputs(g, g.nodes.where("type = 'supplier'").select("id"))
    return rows.select("id", "community", F.greatest(F.coalesce(F.size("adjacent"), F.lit(0)), F.lit(0)).alias("adjacent"), F.col("chunk").cast("long").alias("chunk"))


CANDIDATES = ["nation:5", "supplier:3", "customer:11", "region:1"]
CHOSEN = ", ".join(f"('{c}')" for c in CANDIDATES)


@query(f", c(id) AS (VALUES {CHOSEN}), x AS (SELECT c.id, 0 AS way, src, dst, e.type FROM edges e JOIN c ON c.id = src UNION ALL SELECT c.id, 1, src, dst, e.type FROM edges e JOIN c ON c.id = dst), y AS (SELECT DISTINCT src, dst, x.type FROM (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY src, dst, type) AS k FROM x) x WHERE k <= 20) SELECT src, dst, y.type, a.label AS src_label, b.label AS dst_label, src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c) AS internal FROM y JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst")
def candidate_relations(spark, sf_dir):
    """At most 20 edges of each candidate and direction; those between candidates are marked."""
    return detail.neighbours_of(star_graph(spark, sf_dir), spark.createDataFrame([(c,) for c in CANDIDATES], "id string"))


@query("SELECT id FROM nodes WHERE label = (SELECT s_name FROM supplier WHERE s_suppkey = 3) ORDER BY id LIMIT 1")
def resolve_symbol_label(spark, sf_dir):
    name = load(spark, sf_dir, "supplier").where("s_suppkey = 3").first()["s_name"]  # one row
    return search.resolve(star_graph(spark, sf_dir), name)


@query("SELECT id FROM full_nodes WHERE lower(label) LIKE '%supplier%' AND lower(label) LIKE '%07%' ORDER BY in_degree DESC, id LIMIT 1")
def resolve_symbol_fuzzy(spark, sf_dir):
    return search.resolve(star_graph(spark, sf_dir), "supplier_07")


@query("SELECT label || ' (' || type || ', ' || coalesce(source_file, 'unknown') || ')' AS suggestion FROM (SELECT * FROM full_nodes WHERE lower(label) LIKE '%supplier%' AND lower(label) LIKE '%07%' ORDER BY in_degree DESC, id LIMIT 3)")
def name_suggestions(spark, sf_dir):
    return search.suggestions(star_graph(spark, sf_dir), "supplier_07")


@query(f"{CODE}{EDGES} SELECT (SELECT count(*) FROM symbols) + (SELECT count(*) FROM s) + 2 * (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM edges)) AS edge_count, (SELECT count(*) FROM s) + 2 * (SELECT count(*) FROM n) AS file_count, 4 * (SELECT count(*) FROM s) + 2 * (SELECT count(*) FROM n) AS cross_file_edges, (SELECT count(*) FROM s) AS unresolved_imports", graph=False)
def build_statistics(spark, sf_dir):
    """Counts of a build: of a supplier's module two imported names, its base class and one call lead into other files."""
    return resolve.build_stats(extractions(spark, sf_dir))


@query(f"{CODE}, o AS (SELECT file_path, 'class' AS kind, name, NULL::VARCHAR AS owner, start_line, end_line FROM symbols WHERE kind = 'class' UNION ALL SELECT file_path, 'method', name, parent, start_line, end_line FROM symbols WHERE kind = 'method' UNION ALL SELECT file_path, 'function', name, NULL, start_line, end_line FROM symbols WHERE kind = 'function') SELECT * FROM o", graph=False)
def code_outlines(spark, sf_dir):
    """What the outlines of all modules hold, an entry a row."""
    rows = outline.outlines(extractions(spark, sf_dir))
    classes = rows.select("file_path", F.explode("classes").alias("c"))
    entry = lambda df, kind, e, owner: df.select("file_path", F.lit(kind).alias("kind"), f"{e}.name", owner.alias("owner"), f"{e}.start_line", f"{e}.end_line")
    none = F.lit(None).cast("string")
    methods = classes.select("file_path", F.col("c.name").alias("of"), F.explode("c.methods").alias("m"))
    functions = rows.select("file_path", F.explode("functions").alias("f"))
    return entry(classes, "class", "c", none).unionAll(entry(methods, "method", "m", F.col("of"))).unionAll(entry(functions, "function", "f", none))


@query("SELECT 'src/r' || r_regionkey || '/broken.py' AS file_path, 'broken' AS name, 1 AS start_line FROM region", graph=False)
def outlines_by_lines(spark, sf_dir):
    """Files that can't be parsed have outlines too, read line by line."""
    known = extract.Extractors()
    known.register([".py"], outline.with_fallback(extract.extract_python))
    broken = module_files(spark, sf_dir).where("path like '%/broken.py'")
    return outline.outlines(known.run(broken)).select("file_path", F.explode("functions").alias("f")).select("file_path", "f.name", "f.start_line")


@query(f"{CODE} SELECT module || '.LIMIT' AS id, 'LIMIT' AS text FROM s UNION ALL SELECT module || '.' || class, class || ' bases:Nation A supplier.' FROM s UNION ALL SELECT module || '.' || class || '.load', 'load def load(self)' FROM s UNION ALL SELECT module || '.' || class || '.total', 'total def total(self)' FROM s UNION ALL SELECT module || '.compute', 'compute def compute(x)' FROM s UNION ALL SELECT module || '.Nation', 'Nation bases:' FROM n UNION ALL SELECT module || '.Nation.name', 'name def name(self)' FROM n UNION ALL SELECT module || '.helper', 'helper def helper(x)' FROM n UNION ALL SELECT path, path || ' Supplier ' || s_name || '.' FROM s JOIN supplier ON s_suppkey = k UNION ALL SELECT path, path FROM n UNION ALL SELECT path, path FROM init", graph=False)
def node_texts(spark, sf_dir):
    """The texts that nodes' vectors are made from."""
    return resolve.build_graph(extractions(spark, sf_dir)).nodes.select("id", vectors.node_text().alias("text"))


@query("SELECT 'repo' || (s_suppkey % 3) || '/n' || s_nationkey || '/s' || s_suppkey || '.py' AS file, 'repo' || (s_suppkey % 3) AS repo, '/work/r' || (s_suppkey % 3) || '/n' || s_nationkey || '/s' || s_suppkey || '.py' AS absolute FROM supplier", graph=False)
def source_paths(spark, sf_dir):
    """Absolute paths as the graph names them, their repositories, and back."""
    where = {f"repo{k}": f"/work/r{k}" for k in range(3)}
    paths = load(spark, sf_dir, "supplier").select(F.concat(F.lit("\\work\\r"), (F.col("s_suppkey") % 3).cast("string"), F.lit("\\n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"))
    rows = paths.select(repos.source_file(F.col("path"), where).alias("file"))
    return rows.select("file", repos.repo_name(F.col("file"), where).alias("repo"), repos.absolute_file(F.col("file"), where).alias("absolute"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS label, CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey END AS nation FROM supplier", graph=False)
def parsed_answers(spark, sf_dir):
    """Answers in JSON, some fenced; one in seven is none."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("label"), F.col("s_nationkey").alias("nation"))).alias("j"))
    answer = F.when(F.col("s_suppkey") % 7 == 0, F.lit("I can't say")).when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.col("j"))
    return rows.select("s_suppkey", parse_answer(answer, "struct<label: string, nation: int>").alias("a")).select("s_suppkey", "a.label", "a.nation")


@query(", z AS (SELECT community, count(*) AS n FROM nodes GROUP BY 1) SELECT n_nationkey::VARCHAR AS community, CASE WHEN n_nationkey % 5 = 0 THEN 'New ' ELSE '' END || n_name AS label, coalesce(z.n, 0) AS node_count, r_name AS summary FROM place LEFT JOIN z ON z.community = n_nationkey::VARCHAR")
def final_summaries(spark, sf_dir):
    """Profiles with newer ones in their place and the nodes of the final graph."""
    t = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    profiles = t.select(F.col("n_nationkey").cast("string").alias("community"), F.col("n_name").alias("label"), F.col("r_name").alias("profile"))
    newer = profiles.where("cast(community as int) % 5 = 0").withColumn("label", F.concat(F.lit("New "), "label"))
    return enrich.finalize(star_graph(spark, sf_dir), profiles, newer)


@query("SELECT id, CASE WHEN type = 'supplier' THEN 'Sells from ' || source_file END AS description FROM nodes")
def node_descriptions(spark, sf_dir):
    """Nodes with the descriptions that some of them were given."""
    g = star_graph(spark, sf_dir)
    given = g.nodes.where("type = 'supplier'").select("id", F.concat(F.lit("Sells from "), "source_file").alias("description"))
    return enrich.described(g, given).select("id", "description")


@query("SELECT DISTINCT community, 'Nation ' || n_name || ' (community ' || community || ')' AS name FROM nodes JOIN nation ON n_nationkey::VARCHAR = community")
def community_names(spark, sf_dir):
    rows = star_graph(spark, sf_dir).nodes.where("type = 'nation'").select("community", "label")
    return rows.select("community", ranking.display_name(F.col("community"), F.concat(F.lit("Nation "), "label")).alias("name"))


@query("SELECT type, format('{:,}', count(*)) AS n FROM edges GROUP BY 1")
def grouped_counts(spark, sf_dir):
    """Counts as the status prints them."""
    return ranking.edge_types(star_graph(spark, sf_dir)).select("type", grouped_number(F.col("n")).alias("n"))


POOLED = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) // 4 AS d FROM embeddings WHERE len(embedding) >= 4), p AS (SELECT vec_id, list_transform(range(1, d + 1), lambda i: (v[i] + v[i + d] + v[i + 3 * d]) / 3) AS m FROM e) SELECT vec_id, round(list_sum(m) / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS total, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first FROM p"


@query(POOLED, graph=False)
def mean_pooled(spark, sf_dir):
    """Each vector as four token vectors, the third masked, pooled to one of length 1."""
    rows = load(spark, sf_dir, "embeddings").where("size(embedding) >= 4").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.floor(F.size("embedding") / 4).cast("int").alias("d"))
    tokens = F.array(*[F.slice("v", F.lit(k) * F.col("d") + 1, F.col("d")) for k in range(4)])
    pooled = rows.select("vec_id", embed.mean_pool(tokens, F.array(*[F.lit(m) for m in (1, 1, 0, 1)])).alias("p"))
    return pooled.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("p", 1), 6).alias("first"))


@query("SELECT doc_id AS id, length(coalesce(text, ''))::FLOAT AS size FROM documents", graph=False)
def encoded_texts(spark, sf_dir):
    """Vectors from a callable that answers a batch out of order."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = embed.encode_texts(docs, lambda texts: [{"index": k, "vector": [len(texts[k])]} for k in reversed(range(len(texts)))])
    return found.select("id", F.element_at("vector", 1).alias("size"))
