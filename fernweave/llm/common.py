"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernweave.storage import shared_dir, stored

__all__ = ["WORD", "binary", "buffers", "free", "map_arrow", "ranked", "shared_dir", "slices", "spread", "stored", "table"]

#: The words of the contracts: runs of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: At most this many bytes of text are worked on at once in a Python worker.
SLICE_BYTES = 8 << 20
#: Rows in a batch that the JVM hands to a Python worker; long texts make a larger number costly.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow with batches small enough for long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(f, schema)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, salts: int | Column, salt: str | None = None) -> DataFrame:
    """df with a gapless rank from 0 within keys, under name. df must be written already, so that both readings agree.

    A key may hold a third of all rows, so no task gets a whole key: rows are dealt out by key and a salt, numbered there, and moved up by the counts of the
    key's smaller salts (a table of at most salts rows a key). The salt is made from the order columns, or from the column salt where one is given: a stored
    value that tells even equal rows apart, so that copies of one row are dealt out too. The order is that of (salt, order columns); rows equal in all order
    columns take their numbers in any order. Nulls are a key like any other.
    """
    made = F.pmod(F.xxhash64(*([salt] if salt else order)), F.lit(salts) if isinstance(salts, int) else salts).cast("int")
    df = df.withColumn("_salt", made).withColumns({f"_k{i}": F.coalesce(F.xxhash64(k), F.lit(0)) for i, k in enumerate(keys)})
    ks = [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*ks, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*ks).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1) if ks else Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*ks, "_salt").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = df.withColumn("_rn", F.row_number().over(inner) - 1)
    out = numbered.join(base, [*ks, "_salt"])
    return out.withColumn(name, F.col("_rn").cast("long") + F.col("_base")).drop("_rn", "_base", "_salt", *ks)


def free(name: str, taken: Sequence[str]) -> str:
    """name, with as many underscores before it as it takes to be none of taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def binary(column: pa.Array) -> pa.Array:
    """A string or binary column as binary, without nulls (they become empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the n + 1 offsets of its values in them; nothing is copied."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a binary column, in parts of about most bytes; a value is never cut."""
    _, at = buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, column.slice(row, end - row)
        row = end


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ...: the indices of many ranges one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
