"""Outlines of files, and snippets of source."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def outlines(extractions: DataFrame) -> DataFrame:
    """One row a file: (file_path, language, functions, classes, sections), each with lines and signatures, methods inside their classes."""
    s = extractions.select("file_path", "language", F.explode("symbols").alias("s")).select("file_path", "language", "s.*")
    entry = F.struct("start_line", "end_line", "name", "signature", "docstring")
    methods = s.where("kind = 'method'").groupBy("file_path", F.col("parent").alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("methods"))
    rows = s.join(methods, ["file_path", "name"], "left")
    of = lambda kind, e: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, e)))
    held = rows.groupBy("file_path", "language").agg(of("function", entry).alias("functions"), of("class", F.struct("start_line", "end_line", "name", "signature", "docstring", "bases", "methods")).alias("classes"), of("section", entry).alias("sections"))
    return extractions.select("file_path", "language").join(held, ["file_path", "language"], "left")


def python_by_lines(path: str, text: str) -> dict:
    """What a Python file that does not parse shows line by line: an extraction of the classes, functions and methods whose heads stand in one line each.

    A definition is a method of the class above that is indented less, and ends before the next line that is indented no more than itself.
    """
    lines, symbols, classes = re.split(r"\r?\n", text), [], []
    module = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
    depth = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    for i, line in enumerate(lines):
        head = re.match(r"\s*(class|def|async def)\s+(\w+)", line)
        if not head:
            continue
        classes = [(d, n) for d, n in classes if d < depth[i]]
        end = next((k for k in range(i + 1, len(lines)) if depth[k] is not None and depth[k] <= depth[i]), len(lines))
        while end > i + 1 and depth[end - 1] is None:
            end -= 1
        owner = classes[-1][1] if classes else None
        kind = "class" if head[1] == "class" else "method" if owner else "function"
        name = ".".join([module, *[n for _, n in classes], head[2]])
        bases = re.match(r"\s*class\s+\w+\(([^)]*)\)", line)
        symbols.append({"name": head[2], "qualified_name": name, "kind": kind, "signature": line.strip().removesuffix(":"), "start_line": i + 1, "end_line": end, "parent": owner, "bases": [b.strip() for b in bases[1].split(",") if b.strip()] if bases else None})
        if kind == "class":
            classes.append((depth[i], head[2]))
    return {"language": "python", "file_node": {"kind": "module", "label": path.rsplit("/", 1)[-1]}, "symbols": symbols}


def with_fallback(extract: Callable[[str, str], dict], by_lines: Callable[[str, str], dict] = python_by_lines) -> Callable[[str, str], dict]:
    """An extractor that reads line by line what the first one can't parse."""

    def both(path: str, text: str) -> dict:
        try:
            return extract(path, text)
        except (SyntaxError, ValueError, RecursionError):
            return by_lines(path, text)

    return both


def write_outlines(extractions: DataFrame, path: str) -> None:
    """All outlines as a table by file."""
    outlines(extractions).write.mode("overwrite").parquet(path)


def read_outline(spark: SparkSession, path: str, file_path: str) -> Row | None:
    """A file's outline from the table; None where it has none. The filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("file_path") == file_path).first()


def as_markdown(row) -> str:
    """An outline row as text."""
    out = [f"# {row['file_path']}", ""]
    for c in row["classes"] or []:
        out.append(f"## class {c['name']}" + (f"({', '.join(c['bases'])})" if c["bases"] else "") + f" (lines {c['start_line']}-{c['end_line']})")
        out += [f"- {m['signature'] or m['name']} (lines {m['start_line']}-{m['end_line']})" for m in c["methods"] or []] + [""]
    for title, rows in (("Functions", row["functions"]), ("Sections", row["sections"])):
        if rows:
            out += [f"## {title}", *[f"- {x['signature'] or x['name']} (lines {x['start_line']}-{x['end_line']})" for x in rows], ""]
    return "\n".join(out).rstrip() + "\n"


def as_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), sort_keys=True)


def snippets(candidates: DataFrame, entries: DataFrame, top: int = 5) -> DataFrame:
    """For the first candidates (place, label, source_file, start_line, end_line) the first outline entry (file_path, name, start_line, signature) whose name is in
    the label, else the lines: (place, text)."""
    few = candidates.where(F.col("place") <= top).withColumnRenamed("start_line", "from").withColumnRenamed("end_line", "to")
    hit = few.join(entries, (F.col("source_file") == F.col("file_path")) & F.col("label").contains(F.col("name")), "left")
    first = F.row_number().over(Window.partitionBy("place").orderBy(F.col("start_line").asc_nulls_last()))
    lines = F.format_string("%s (lines %d-%d)", "label", F.coalesce("from", F.lit(0)), F.coalesce("to", F.lit(0)))
    return hit.withColumn("k", first).where("k = 1").select("place", F.coalesce("signature", "name", lines).alias("text"))
