"""Snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_diff(old: DataFrame, new: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(path, change) for snapshots (path, hash): added, changed, removed, or unchanged; a path without a cached extraction (path) is changed."""
    rows = old.select("path", F.col("hash").alias("was"), F.lit(True).alias("before")).join(new.select("path", F.col("hash").alias("now"), F.lit(True).alias("after")), "path", "full_outer")
    change = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("unchanged")
    rows = rows.select("path", change.alias("change"))
    if cached is not None:
        rows = rows.join(cached.select("path", F.lit(True).alias("cached")), "path", "left")
        rows = rows.select("path", F.when(F.col("cached").isNull() & (F.col("change") == "unchanged"), "changed").otherwise(F.col("change")).alias("change"))
    return rows


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a table's fingerprint that neither the order nor the split of its rows changes."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("fingerprint"))
