"""From files to extractions: sections and code references of documents, symbols of Python modules."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.text import basename, ellipsis, module_name

SYMBOL = "struct<name: string, qualified_name: string, kind: string, signature: string, decorators: array<string>, docstring: string, start_line: int, end_line: int, parent: string, bases: array<string>>"
IMPORT = "struct<module: string, names: array<string>, is_wildcard: boolean, is_export: boolean, line: int>"
REFERENCE = "struct<name: string, from_symbol: string, kind: string, line: int>"
EXTRACTION = (
    f"file_path string, language string, file_node struct<kind: string, label: string, docstring: string, tags: array<string>>, symbols array<{SYMBOL}>, "
    f"imports array<{IMPORT}>, refs array<{REFERENCE}>, exports array<string>, error string"
)
# Words in backticks that are no symbols, the endings of source files, and what a symbol in backticks looks like.
NO_SYMBOLS = "true|false|null|none|if|else|for|while|return|import|from|class|def"
CODE_ENDINGS = "py|ts|tsx|js|jsx|java|go|rs|rb|c|cpp|h|hpp"
TICKED = r"`([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)`"


def document_lines(docs: DataFrame) -> DataFrame:
    """docs (path, text) a line a row: (path, line from 1, text)."""
    return docs.select("path", F.posexplode(F.split(F.col("text"), r"\r?\n", -1)).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def sections(docs: DataFrame) -> DataFrame:
    """The sections of documents: (path, name, qualified_name, level, docstring, start_line, end_line).

    A heading is a line of one to six # with a text, or the line above three or more of one of = - ~ ^ alone. A section ends before the next one starts. Equal
    names in a document are numbered from the second on.
    """
    by_line = Window.partitionBy("path").orderBy("line")
    rows = document_lines(docs).withColumn("before", F.trim(F.lag("text").over(by_line))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("path")))
    hashes, title = F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 1), F.trim(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 2))
    underline = F.trim("text").rlike(r"^[=\-~^]{3,}$") & F.col("before").isNotNull()
    rows = rows.withColumn("heading", F.when(hashes != "", title).when(underline, F.col("before")))
    rows = rows.withColumn("level", F.when(hashes != "", F.length(hashes)).otherwise(2)).where("heading is not null and heading <> ''")
    bare = F.regexp_replace("heading", r"[*_~`\[\]()]", "")
    name = F.substring(F.trim(F.regexp_replace(bare, r"[^a-zA-Z0-9_ -]", "")), 1, 80)
    clean = F.substring(F.regexp_replace(F.regexp_replace(bare, r"\s+", "_"), r"[^a-zA-Z0-9_-]", ""), 1, 80)
    rows = rows.withColumn("name", name).withColumn("clean", clean)
    nth = F.row_number().over(Window.partitionBy("path", "clean").orderBy("line"))
    rows = rows.withColumn("nth", nth).withColumn("end_line", F.coalesce(F.lead("line").over(by_line) - 1, F.col("total")))
    unique = F.when(F.col("nth") == 1, F.col("clean")).otherwise(F.concat_ws("_", "clean", F.col("nth").cast("string")))
    return rows.select("path", "name", F.concat_ws(".", module_name(F.col("path")), unique).alias("qualified_name"), "level", F.col("heading").alias("docstring"), F.col("line").alias("start_line"), "end_line")


def code_references(docs: DataFrame) -> DataFrame:
    """Symbols in backticks and paths of source files in documents, once a section: (path, name, from_symbol, line); outside sections the document refers."""
    heads = sections(docs).select("path", F.col("start_line").alias("line"), F.col("qualified_name").alias("section"))
    rows = document_lines(docs).join(heads, ["path", "line"], "left")
    rows = rows.withColumn("from_symbol", F.coalesce(F.last("section", ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), F.col("path")))
    ticked = F.filter(F.regexp_extract_all("text", F.lit(TICKED), F.lit(1)), lambda x: (F.length(x) >= 2) & ~F.lower(x).rlike(f"^({NO_SYMBOLS})$"))
    found_path = F.regexp_extract_all("text", F.lit(r"(?:^|[\s(\"`'])([a-zA-Z0-9_./-]+\.[a-z]{1,4})(?=[\s)\"`']|$)"), F.lit(1))
    files = F.filter(found_path, lambda x: x.contains("/") & x.rlike(rf"\.({CODE_ENDINGS})$"))
    names = rows.select("path", "from_symbol", "line", F.explode(F.concat(ticked, files)).alias("name"))
    return names.groupBy("path", "from_symbol", "name").agg(F.min("line").alias("line")).select("path", "name", "from_symbol", "line")


def first_paragraph(docs: DataFrame) -> DataFrame:
    """(path, docstring): the first run of lines that are neither blank nor headings, 200 characters of it."""
    rows = document_lines(docs).withColumn("t", F.trim("text"))
    by_line = Window.partitionBy("path").orderBy("line")
    body = (F.col("t") != "") & ~F.col("t").startswith("#") & (F.col("t") != "---")
    rows = rows.withColumn("body", body).withColumn("start", F.min(F.when(body, F.col("line"))).over(Window.partitionBy("path")))
    rows = rows.withColumn("breaks", F.sum(F.when(~F.col("body") & (F.col("line") > F.col("start")), 1).otherwise(0)).over(by_line)).where("body and breaks = 0")
    held = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("p"))
    return held.select("path", ellipsis(F.col("p"), 200).alias("docstring"))


def extract_markdown(path: str, text: str) -> dict:
    """One document's extraction in Python, for the extractor registry; sections and references are as in sections() and code_references()."""
    lines = re.split(r"\r?\n", text)
    module, symbols, refs, counts, seen = re.sub(r"\.[^./]+$", "", path).replace("/", "."), [], [], {}, set()
    for i, line in enumerate(lines):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        under = i > 0 and re.match(r"^[=\-~^]{3,}$", line.strip()) and lines[i - 1].strip()
        title, level = (m[2].strip(), len(m[1])) if m else (under, 2)
        if title:
            if symbols:
                symbols[-1]["end_line"] = i
            bare = re.sub(r"[*_~`\[\]()]", "", title)
            clean = re.sub(r"[^a-zA-Z0-9_-]", "", re.sub(r"\s+", "_", bare))[:80]
            counts[clean] = counts.get(clean, 0) + 1
            unique = clean if counts[clean] == 1 else f"{clean}_{counts[clean]}"
            name = re.sub(r"[^a-zA-Z0-9_ -]", "", bare).strip()[:80]
            symbols.append({"name": name, "qualified_name": f"{module}.{unique}", "kind": "section", "decorators": [f"h{level}"], "docstring": title, "start_line": i + 1, "end_line": len(lines), "parent": path.rsplit("/", 1)[-1]})
        at = symbols[-1]["qualified_name"] if symbols else path
        names = [x for x in re.findall(TICKED, line) if len(x) >= 2 and not re.fullmatch(NO_SYMBOLS, x, re.I)]
        names += [x for x in re.findall(r"(?:^|[\s(\"`'])([a-zA-Z0-9_./-]+\.[a-z]{1,4})(?=[\s)\"`']|$)", line) if "/" in x and re.search(rf"\.({CODE_ENDINGS})$", x)]
        for x in names:
            if (at, x) not in seen:
                seen.add((at, x))
                refs.append({"name": x, "from_symbol": at, "kind": "references", "line": i + 1})
    return {"language": "markdown", "file_node": {"kind": "document", "label": path.rsplit("/", 1)[-1]}, "symbols": symbols, "refs": refs}


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)}){returns}"


class _Python(ast.NodeVisitor):
    def __init__(self, path: str):
        self.module = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
        self.path, self.scope, self.symbols, self.imports, self.refs, self.exports = path, [], [], [], [], None

    def qualified(self, name: str) -> str:
        return ".".join([self.module, *[s for s, _ in self.scope], name])

    def add(self, node: ast.AST, name: str, kind: str, **more) -> None:
        self.symbols.append({"name": name, "qualified_name": self.qualified(name), "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "parent": self.scope[-1][0] if self.scope else None, **more})

    def owner(self) -> str:
        return ".".join([self.module, *[s for s, _ in self.scope]]) if self.scope else self.path

    def inside(self, name: str, kind: str, node: ast.AST) -> None:
        self.scope.append((name, kind))
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        kind = "method" if self.scope and self.scope[-1][1] == "class" else "function"
        self.add(node, node.name, kind, signature=_signature(node), decorators=[ast.unparse(d) for d in node.decorator_list], docstring=ast.get_docstring(node))
        self.inside(node.name, "function", node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        bases = [ast.unparse(b) for b in node.bases]
        self.add(node, node.name, "class", signature=f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}", decorators=[ast.unparse(d) for d in node.decorator_list], docstring=ast.get_docstring(node), bases=bases)
        own = self.qualified(node.name)
        self.refs += [{"name": b, "from_symbol": own, "kind": "extends", "line": node.lineno} for b in bases]
        self.inside(node.name, "class", node)

    def visit_Import(self, node) -> None:
        self.imports += [{"module": a.name, "names": [], "is_wildcard": False, "is_export": False, "line": node.lineno} for a in node.names]

    def visit_ImportFrom(self, node) -> None:
        names = [a.name + (f" as {a.asname}" if a.asname else "") for a in node.names if a.name != "*"]
        self.imports.append({"module": "." * node.level + (node.module or ""), "names": names, "is_wildcard": any(a.name == "*" for a in node.names), "is_export": self.path.endswith("__init__.py"), "line": node.lineno})

    def visit_Assign(self, node) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name) and not self.scope:
                if t.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                    self.exports = [e.value for e in node.value.elts if isinstance(e, ast.Constant)]
                elif t.id.isupper():
                    self.add(node, t.id, "constant")
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            name = ast.unparse(node.func)
            if re.fullmatch(r"[\w.]+", name):
                self.refs.append({"name": name, "from_symbol": self.owner(), "kind": "calls", "line": node.lineno})
        self.generic_visit(node)


def extract_python(path: str, text: str) -> dict:
    """A module's functions, classes, methods, constants, imports, calls and bases."""
    tree, visitor = ast.parse(text), _Python(path)
    for child in tree.body:
        visitor.visit(child)
    return {"language": "python", "file_node": {"kind": "module", "label": path.rsplit("/", 1)[-1], "docstring": ast.get_docstring(tree)}, "symbols": visitor.symbols, "imports": visitor.imports, "refs": visitor.refs, "exports": visitor.exports}


@dataclass
class Extractors:
    """Extractors by lower-case file ending; a later one takes an ending over. An extractor is extract(path, text) -> dict with the fields of EXTRACTION."""

    by_ending: dict[str, Callable[[str, str], dict]] = field(default_factory=lambda: {".md": extract_markdown, ".txt": extract_markdown, ".rst": extract_markdown, ".py": extract_python})

    def register(self, endings: list[str], extract: Callable[[str, str], dict]) -> None:
        self.by_ending.update((e.lower(), extract) for e in endings)

    def run(self, files: DataFrame) -> DataFrame:
        """files (path, text) as extractions. Files of unknown endings are left out; one that can't be read has its error and nothing else."""
        known = self.by_ending
        names = [x.split()[0] for x in ("file_path", "language", "file_node", "symbols", "imports", "refs", "exports", "error")]

        def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fields = {"symbols": ("name", "qualified_name", "kind", "signature", "decorators", "docstring", "start_line", "end_line", "parent", "bases"), "imports": ("module", "names", "is_wildcard", "is_export", "line"), "refs": ("name", "from_symbol", "kind", "line")}
            for rows in batches:
                out = []
                for path, text in zip(rows["path"], rows["text"], strict=True):
                    f = known.get(re.sub(r"^.*(\.[^./]+)$", r"\1", path).lower())
                    if f is None:
                        continue
                    got: dict = {"file_path": path}
                    try:
                        if text is None or "\0" in text:
                            raise ValueError("no text")
                        got |= f(path, text)
                    except (SyntaxError, ValueError, RecursionError) as e:
                        got["error"] = str(e)
                    for k, keys in fields.items():
                        got[k] = [{c: x.get(c) for c in keys} for x in got.get(k) or []]
                    if got.get("file_node"):
                        got["file_node"] = {c: got["file_node"].get(c) for c in ("kind", "label", "docstring", "tags")}
                    out.append([got.get(c) for c in names])
                yield pd.DataFrame(out, columns=names)

        return files.select("path", "text").mapInPandas(extract, EXTRACTION)


LINK = r"""(?s)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
HEADING = r"(?s)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]>"


def _inner(html: F.Column) -> F.Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def page_links(pages: DataFrame) -> DataFrame:
    """The links of web pages: (page_id, place from 1, href, label without markup)."""
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(LINK), F.lit(k)).alias(n) for k, n in ((1, "href"), (2, "label"))])
    return pages.select("page_id", F.posexplode(found).alias("at", "l")).select("page_id", (F.col("at") + 1).alias("place"), F.col("l.href").alias("href"), _inner(F.col("l.label")).alias("label"))


def page_sections(pages: DataFrame) -> DataFrame:
    """The headings of web pages, of all levels: (page_id, place from 1, level, heading without markup)."""
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(HEADING), F.lit(k)).alias(n) for k, n in ((1, "level"), (2, "heading"))])
    return pages.select("page_id", F.posexplode(found).alias("at", "h")).select("page_id", (F.col("at") + 1).alias("place"), F.col("h.level").cast("int").alias("level"), _inner(F.col("h.heading")).alias("heading"))


def file_label(path: str = "path") -> F.Column:
    return basename(F.col(path))
