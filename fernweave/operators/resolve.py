"""From extractions to a graph: imports and references resolved by joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.graph import Graph
from fernweave.storage import stored

HOPS = 2


def symbols_of(extractions: DataFrame) -> DataFrame:
    rows = extractions.select("file_path", F.posexplode("symbols").alias("ord", "s"))
    return rows.select("file_path", "ord", "s.*")


def imports_of(extractions: DataFrame) -> DataFrame:
    rows = extractions.select("file_path", F.posexplode("imports").alias("ord", "i"))
    return rows.select("file_path", "ord", "i.*")


def import_candidates(module: Column, file: Column) -> Column:
    """The paths that a module may be, best first: of its own package if it is relative, else from the root; as a file or as a package."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    folders = F.slice(F.split(file, "/"), F.lit(1), F.greatest(F.size(F.split(file, "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    base = F.when(dots > 0, F.array_join(folders, "/")).otherwise(F.lit(""))
    joined = F.when(base == "", rest).when(rest == "", base).otherwise(F.concat_ws("/", base, rest))
    return F.array(F.concat(joined, F.lit(".py")), F.concat(joined, F.lit("/__init__.py")))


def resolve_imports(extractions: DataFrame, candidates: Callable[[Column, Column], Column] = import_candidates) -> DataFrame:
    """Imports with the file they mean: (file_path, ord, module, names, is_wildcard, is_export, target), target null for what lies outside.

    The candidates are joined with the files as they are, and those without a match with every ending of the files' paths, whole segments at a time, so that a
    package under src/ is found; the first candidate and the first file count. candidates(module, file) is a language's own rule: an array of paths, best first.
    """
    files = extractions.select(F.col("file_path").alias("target"))
    parts = F.split("target", "/")
    endings = files.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("candidate")).withColumn("exact", (F.col("candidate") != F.col("target")).cast("int"))
    rows = imports_of(extractions)
    wanted = rows.select("file_path", "ord", F.posexplode(candidates(F.col("module"), F.col("file_path"))).alias("p", "candidate"))
    best = wanted.join(endings, "candidate").groupBy("file_path", "ord").agg(F.min(F.struct("exact", "p", "target")).alias("b"))
    return rows.join(best, ["file_path", "ord"], "left").withColumn("target", F.col("b.target")).drop("b")


def exported(extractions: DataFrame) -> DataFrame:
    """(file_path, name): what a wildcard import of a file brings, its exports or else all its top symbols."""
    names = F.coalesce("exports", F.transform(F.filter("symbols", lambda s: s["parent"].isNull()), lambda s: s["name"]))
    return extractions.select("file_path", F.explode(F.array_distinct(names)).alias("name"))


def imported_symbols(extractions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file_path, name, symbol): the symbols that names of a file mean by its imports; re-exports are followed over two files."""
    symbols = symbols_of(extractions).groupBy("file_path", "name").agg(F.max_by("qualified_name", "ord").alias("symbol"))
    wild = resolved.where("is_wildcard and target is not null").join(exported(extractions).withColumnRenamed("file_path", "target"), "target").select("file_path", "ord", "target", F.col("name"), F.col("name").alias("original"))
    named = resolved.where("target is not null").select("file_path", "ord", "target", F.explode("names").alias("n"))
    named = named.select("file_path", "ord", "target", F.regexp_replace("n", r"\s+as\s+.*$", "").alias("name")).withColumn("original", F.col("name"))
    wanted, found = named.unionByName(wild), None
    hops = named.unionByName(wild).select(F.col("file_path").alias("target"), F.col("original"), F.col("target").alias("further"))
    for hop in range(HOPS + 1):
        met = wanted.join(symbols.select(F.col("file_path").alias("target"), F.col("name").alias("original"), "symbol"), ["target", "original"]).select("file_path", "name", "symbol", F.lit(hop).alias("hop"), "ord")
        found = met if found is None else found.unionAll(met)
        wanted = wanted.join(hops, ["target", "original"]).select("file_path", "ord", F.col("further").alias("target"), "name", "original")
    best = F.row_number().over(Window.partitionBy("file_path", "name").orderBy("hop", F.desc("ord"), "symbol"))
    return found.withColumn("k", best).where("k = 1").select("file_path", "name", "symbol")


def build_graph(extractions: DataFrame, repo: str | None = None, resolved: DataFrame | None = None, known: DataFrame | None = None) -> Graph:
    """Nodes of files and symbols, and containment, import and reference edges; a first symbol of an id counts, and edges are guarded. resolved and known are what
    resolve_imports() and imported_symbols() give for these extractions, if a caller has them already."""
    ok = extractions.where("error is null")
    top = F.substring_index("file_path", "/", 1) if repo is None else F.lit(repo)
    none = lambda t: F.lit(None).cast(t)
    kind = F.col("file_node.kind")
    files = ok.select(
        F.col("file_path").alias("id"), F.coalesce("file_node.label", F.substring_index("file_path", "/", -1)).alias("label"), kind.alias("type"), F.when(kind == "module", "code").otherwise("doc").alias("file_type"),
        F.col("file_path").alias("source_file"), top.alias("repo"), none("string").alias("community"), none("int").alias("start_line"), none("int").alias("end_line"), none("string").alias("signature"),
        F.col("file_node.docstring").alias("docstring"), none("array<string>").alias("bases"), none("array<string>").alias("decorators"), F.col("file_node.tags").alias("tags"), none("string").alias("properties"), none("long").alias("ord"),
    )
    symbols = symbols_of(ok)
    owner = ok.select("file_path", F.when(kind == "module", "code").otherwise("doc").alias("file_type"), top.alias("repo"))
    first = symbols.join(owner, "file_path").withColumn("k", F.row_number().over(Window.partitionBy("qualified_name").orderBy("file_path", "ord"))).where("k = 1")
    own = first.select(
        F.col("qualified_name").alias("id"), F.col("name").alias("label"), F.col("kind").alias("type"), "file_type", F.col("file_path").alias("source_file"), "repo", none("string").alias("community"), "start_line", "end_line",
        "signature", "docstring", "bases", "decorators", none("array<string>").alias("tags"), none("string").alias("properties"), none("long").alias("ord"),
    )
    edge = lambda df, a, b, t: df.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    c = F.col
    parents = symbols.groupBy("file_path", "name").agg(F.min_by("qualified_name", "ord").alias("up"))
    inner = symbols.where("parent is not null").join(parents.select("file_path", c("name").alias("parent"), "up"), ["file_path", "parent"])
    resolved = stored(resolve_imports(ok), "resolved") if resolved is None else resolved  # each is read several times below
    known = stored(imported_symbols(ok, resolved), "known") if known is None else known
    edges = edge(symbols, c("file_path"), c("qualified_name"), "contains").unionAll(edge(inner, c("up"), c("qualified_name"), "contains"))
    edges = edges.unionAll(edge(known, c("file_path"), c("symbol"), "imports_from"))
    names = resolved.where("target is not null").select("file_path", "target", F.explode_outer("names").alias("n"), "is_wildcard").withColumn("name", F.regexp_replace("n", r"\s+as\s+.*$", ""))
    unknown = names.join(known, ["file_path", "name"], "left").where("symbol is null and not is_wildcard")
    edges = edges.unionAll(edge(unknown, c("file_path"), c("target"), "imports"))
    edges = edges.unionAll(resolve_references(ok, symbols, known).select("src", "dst", "type"))
    edges = edges.withColumns({"confidence": none("double"), "properties": none("string"), "ord": none("long")})
    return Graph(files.unionByName(own), edges).guarded()


def resolve_references(extractions: DataFrame, symbols: DataFrame, known: DataFrame) -> DataFrame:
    """References as edges (src, dst, type). The first that fits: a node's id; a file's path (and then nothing else, if it looks like one); a method of self;
    a member of an imported class or module; an imported name; a function, class or method of the same file."""
    refs = extractions.select("file_path", F.explode("refs").alias("r")).select("file_path", "r.name", F.col("r.from_symbol").alias("src"), F.col("r.kind").alias("type")).distinct()
    ids = symbols.select(F.col("qualified_name").alias("name"), F.col("qualified_name").alias("r0")).unionAll(extractions.select("file_path", "file_path")).groupBy("name").agg(F.min("r0").alias("r0"))
    parts = F.split("file_path", "/")
    endings = extractions.select(F.col("file_path").alias("r1"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("name")).groupBy("name").agg(F.min("r1").alias("r1"))
    by_parent = symbols.where("parent is not null").groupBy("file_path", "parent", F.col("name").alias("member")).agg(F.min_by("qualified_name", "ord").alias("method"))
    classes = symbols.where("parent is not null").select("file_path", F.col("qualified_name").alias("src"), "parent").dropDuplicates(["file_path", "src"])
    local = symbols.where(F.col("kind").isin("function", "class", "method")).groupBy("file_path", "name").agg(F.min_by("qualified_name", "ord").alias("r5"))
    base, member = F.substring_index("name", ".", 1), F.regexp_extract("name", r"\.([^.]+)$", 1)
    out = refs.withColumn("base", base).withColumn("member", member).join(ids, "name", "left").join(endings, "name", "left").join(classes, ["file_path", "src"], "left")
    out = out.join(by_parent.withColumnRenamed("method", "m2"), ["file_path", "parent", "member"], "left").withColumn("r2", F.when(F.col("base").isin("self", "cls"), F.col("m2")))
    out = out.join(known.select("file_path", F.col("name").alias("base"), F.col("symbol").alias("imported")), ["file_path", "base"], "left")
    owner = symbols.groupBy(F.col("qualified_name").alias("imported")).agg(F.min("file_path").alias("there"), F.min("name").alias("class_name"))
    members = by_parent.select(F.col("file_path").alias("there"), F.col("parent").alias("class_name"), "member", F.col("method").alias("r3"))
    out = out.join(owner, "imported", "left").join(members, ["there", "class_name", "member"], "left")
    out = out.withColumn("r4", F.when(F.col("member") == "", F.col("imported"))).join(local, ["file_path", "name"], "left")
    is_path = F.col("name").contains("/")
    dst = F.coalesce("r0", F.when(is_path, F.col("r1")), *[F.when(~is_path, F.col(r)) for r in ("r2", "r3", "r4", "r5")])
    return out.withColumn("dst", dst).where("dst is not null").select("src", "dst", "type")


def build_stats(extractions: DataFrame) -> DataFrame:
    """One row on a build: node_count, edge_count, file_count, cross_file_edges, unresolved_imports.

    cross_file_edges counts what was tried, so an edge found twice counts twice: each name that an import of a known file brings, a bare import of one, and each
    reference that leads into another file. unresolved_imports are those of modules from outside.
    """
    ok = extractions.where("error is null")
    symbols, resolved = symbols_of(ok), stored(resolve_imports(ok), "resolved")
    known = stored(imported_symbols(ok, resolved), "known")
    g = build_graph(extractions, resolved=resolved, known=known)
    one = F.count(F.lit(1))
    inside = resolved.where("target is not null")
    wild = inside.where("is_wildcard").join(exported(ok).withColumnRenamed("file_path", "target"), "target").agg(one.alias("n"))
    named = inside.agg(F.coalesce(F.sum(F.size(F.coalesce("names", F.array().cast("array<string>"))) + F.when(~F.col("is_wildcard") & (F.size("names") == 0), 1).otherwise(0)), F.lit(0)).alias("n"))
    files = symbols.groupBy(F.col("qualified_name").alias("id")).agg(F.min("file_path").alias("file")).unionAll(ok.select(F.col("file_path").alias("id"), F.col("file_path").alias("file")))
    files = files.groupBy("id").agg(F.min("file").alias("file"))
    refs = resolve_references(ok, symbols, known)
    ends = refs.join(files.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    across = wild.unionAll(named).unionAll(ends.where("a <> b").agg(one.alias("n"))).agg(F.sum("n").cast("long").alias("cross_file_edges"))
    counts = [g.nodes.agg(one.alias("node_count")), g.edges.agg(one.alias("edge_count")), ok.agg(one.alias("file_count")), across, resolved.where("target is null").agg(one.alias("unresolved_imports"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts)  # one row each
