"""Several repositories as one tree: a path's first folder is its repository's name; with one repository, paths have no such folder."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.text import posix, relative_to
from fernweave.sources.files import SKIP_DIRS, list_files, read_files

FOLDER = "graph"


def list_repos(spark: SparkSession, repos: dict[str, str], skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(repo, path, local, size, modified) of the files of repositories (name to folder): path names the file in the whole, local in its repository."""
    one = len(repos) == 1
    parts = []
    for name, root in repos.items():
        rows = list_files(spark, root, skip_dirs)
        parts.append(rows.select(F.lit(name).alias("repo"), (F.col("path") if one else F.concat(F.lit(name + "/"), "path")).alias("path"), F.col("path").alias("local"), "size", "modified"))
    if not parts:
        raise ValueError("no repositories are named")
    return reduce(DataFrame.unionAll, parts)


def read_repos(files: DataFrame, repos: dict[str, str]) -> DataFrame:
    """files of list_repos() with text and hash: (repo, path, text, hash)."""
    one = len(repos) == 1
    parts = []
    for name, root in repos.items():
        rows = read_files(files.where(F.col("repo") == name).select(F.col("local").alias("path")), root)
        parts.append(rows.select(F.lit(name).alias("repo"), (F.col("path") if one else F.concat(F.lit(name + "/"), "path")).alias("path"), "text", "hash"))
    return reduce(DataFrame.unionAll, parts)


def source_file(path: Column, repos: dict[str, str], workspace: str | None = None) -> Column:
    """An absolute path as the graph names it: below its repository, after the repository's name if there are several; else below the workspace, else null."""
    named = [(F.lit(""), relative_to(path, next(iter(repos.values()))))] if len(repos) == 1 else [(F.lit(name + "/"), relative_to(path, root)) for name, root in repos.items()]
    found = [F.concat(prefix, below) for prefix, below in named]
    return F.coalesce(*found, relative_to(path, workspace) if workspace else F.lit(None).cast("string"))


def repo_name(file: Column, repos: dict[str, str]) -> Column:
    """The repository of a source file; null for one of none of them."""
    if len(repos) == 1:
        return F.lit(next(iter(repos)))
    first = F.substring_index(file, "/", 1)
    return F.when(first.isin(*repos), first)


def absolute_file(file: Column, repos: dict[str, str]) -> Column:
    """Where a source file lies; null for a repository that is not known. Whether it is there is not looked at."""
    if len(repos) == 1:
        return F.concat(F.lit(next(iter(repos.values())).rstrip("/") + "/"), posix(file))
    out = F.lit(None).cast("string")
    for name, root in repos.items():
        out = F.when(posix(file).startswith(name + "/"), F.concat(F.lit(root.rstrip("/") + "/"), F.substring(posix(file), len(name) + 2, 1 << 30))).otherwise(out)
    return out


def located(file: str | None, repos: dict[str, str], graph_dir: str) -> dict[str, str | None]:
    """For an answer's one file, on the driver: its absolute path and its path from the graph's folder, both null if it is not there."""
    nowhere: dict[str, str | None] = {"absolute": None, "from_graph": None}
    if not file or not repos:
        return nowhere
    name, _, rest = file.partition("/")
    root, below = (next(iter(repos.values())), file) if len(repos) == 1 else (repos.get(name), rest)
    full = os.path.abspath(os.path.join(root, below)) if root and below else None
    if not full or not os.path.exists(full):
        return nowhere
    return {"absolute": full, "from_graph": os.path.relpath(full, graph_dir).replace(os.sep, "/")}


def find_graph(explicit: str | None = None, variable: str = "FERNWEAVE_GRAPH", cwd: str | None = None, folder: str = FOLDER) -> str | None:
    """The graph's folder: the one named, and no other then; the variable's, if it is there; the one in the working folder; the first in a folder beside it."""
    if explicit:
        return os.path.abspath(explicit) if os.path.exists(explicit) else None
    here = os.path.abspath(cwd or os.getcwd())
    up = os.path.dirname(here)
    beside = sorted(e.name for e in os.scandir(up) if e.is_dir()) if os.access(up, os.R_OK) else []
    places = [os.environ.get(variable), os.path.join(here, folder), *[os.path.join(up, n, folder) for n in beside]]
    return next((os.path.abspath(p) for p in places if p and os.path.exists(p)), None)
