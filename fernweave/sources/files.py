"""File trees as DataFrames: paths, contents, hashes, a census of endings."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.text import extension, matches_any
from fernweave.storage import stored

# Names of folders that hold no sources.
SKIP_DIRS = (
    "node_modules", "__pycache__", ".git", ".svn", ".hg", "venv", ".venv", "env", ".env", ".tox", "site-packages", "dist", "build", ".eggs",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "bin", "obj",
)
MOST_FILES = 200_000


def list_files(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(path, size, modified) of all files under root, links to folders followed, folders of these names left out.

    The walk is the driver's, since Spark's own listing leaves out names that start with _ or a dot; contents are read by the executors. A URI goes to list_store().
    """
    if "://" in root:
        return list_store(spark, root, skip_dirs)
    rows, seen = [], set()
    for folder, dirs, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            dirs[:] = []
            continue
        seen.add(real)
        dirs[:] = sorted(d for d in dirs if d not in skip_dirs)
        for name in sorted(names):
            full = os.path.join(folder, name)
            try:
                stat = os.stat(full)
            except OSError:  # a link to nothing
                continue
            rows.append((os.path.relpath(full, root).replace(os.sep, "/"), stat.st_size, stat.st_mtime))
    return spark.createDataFrame(rows, "path string, size long, modified double")


def list_store(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(path, size, modified) of all files under a URI of any store that pyarrow opens, folders of these names left out.

    A round lists the folders of one depth on the executors, so neither the walk nor its result is the driver's; each round is written before the next.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pa_fs.FileSystem.from_uri(root)
        for rows in batches:
            for folder in rows["path"]:
                found = store.get_file_info(pa_fs.FileSelector(f"{base}/{folder}" if folder else base))
                yield pd.DataFrame(
                    [(i.path[len(base) :].lstrip("/"), i.type == pa_fs.FileType.Directory, i.size or 0, i.mtime.timestamp() if i.mtime else None) for i in found if i.type in (pa_fs.FileType.File, pa_fs.FileType.Directory)],
                    columns=["path", "folder", "size", "modified"],
                )

    out, todo = None, spark.createDataFrame([("",)], "path string")
    while True:
        got = stored(todo.mapInPandas(listed, "path string, folder boolean, size long, modified double"), "listing")
        rows = got.where("not folder").select("path", "size", "modified")
        out = rows if out is None else out.unionAll(rows)
        todo = got.where(F.col("folder") & ~F.substring_index("path", "/", -1).isin(*skip_dirs)).select("path")
        if todo.isEmpty():
            return out
        todo = todo.repartition(spark.sparkContext.defaultParallelism)


def select_files(files: DataFrame, types: dict[str, dict], include: list[str] | None = None, exclude: list[str] | None = None, max_kb: int | None = None) -> DataFrame:
    """(type, path, size) by type of file, sorted.

    A type has endings, and may have include and exclude globs of its own: its includes come before the common ones, which come before its endings; its excludes
    take the place of the common ones. Files over max_kb are left out.
    """
    out = None
    for name, t in types.items():
        patterns = t.get("include") or include or [f"**/*{e}" for e in t["endings"]]
        drop = t.get("exclude") if t.get("exclude") is not None else exclude or []
        rows = files.where(extension(F.col("path")).isin(*[e.lower() for e in t["endings"]]) & matches_any(F.col("path"), patterns) & ~matches_any(F.col("path"), drop))
        if max_kb is not None:
            rows = rows.where(F.col("size") <= max_kb * 1024)
        rows = rows.select(F.lit(name).alias("type"), "path", "size")
        out = rows if out is None else out.unionAll(rows)
    return out.orderBy("type", "path")


def read_files(files: DataFrame, root: str) -> DataFrame:
    """files (path) with text and hash (SHA-256 of the bytes); undecodable bytes are replaced, and a file that can't be read has nulls. For a root that all executors see:
    a folder, or a URI of any store that pyarrow opens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        store, base = pa_fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
        for rows in batches:
            text, digest = [], []
            for path in rows["path"]:
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        data = f.read()
                except OSError:
                    text.append(None)
                    digest.append(None)
                    continue
                text.append(data.decode("utf-8", "replace"))
                digest.append(hashlib.sha256(data).hexdigest())
            yield pd.DataFrame({"path": rows["path"], "text": text, "hash": digest})

    return files.select("path").mapInPandas(read, "path string, text string, hash string")


def census(files: DataFrame, most: int | None = MOST_FILES) -> DataFrame:
    """(extension, n) over at most so many files (None: all); names without an ending and dotfiles are left out."""
    return (files if most is None else files.limit(most)).select(extension(F.col("path")).alias("extension")).where("extension <> ''").groupBy("extension").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension")


@dataclass(frozen=True)
class Census:
    """counts (extension, n), how many files they count, the roots that are no folders, and whether the limit left files out."""

    counts: DataFrame
    total: int
    missing: list[str]
    truncated: bool


def census_of(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, skip_dirs: tuple[str, ...] = SKIP_DIRS, most: int = MOST_FILES) -> Census:
    """The census of several folders. Excluded paths, files without an ending and dotfiles do not count toward the limit; of more files the first by root and path count."""
    there = [r for r in roots if os.path.isdir(r)]
    found = None
    for k, root in enumerate(there):
        rows = list_files(spark, root, skip_dirs).select(F.lit(k).alias("root"), "path")
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        found = spark.createDataFrame([], "root int, path string")
    found = found.where(~matches_any(F.col("path"), exclude or []) & (extension(F.col("path")) != ""))
    n = found.count()
    counted = found.orderBy("root", "path").limit(most) if n > most else found
    return Census(census(counted, most=None), min(n, most), [r for r in roots if r not in there], n >= most)


def write_hashes(read: DataFrame, path: str) -> None:
    """The hashes of files (path, hash) as a table, which the next build holds its files against."""
    read.select("path", "hash").write.mode("overwrite").parquet(path)


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """The hashes that a build left; none where there was none."""
    try:
        return spark.read.schema("path string, hash string").parquet(path)
    except Exception as e:  # noqa: BLE001 - no table there yet is the one failure expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, hash string")
