"""Vectors and vocabularies as tables. Each write is a version of its own, and a log of versions names the one that counts, so readers never see half of one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fernweave.storage import stored

LOG = "version string, provider string, dimensions int, record_count long, created_at timestamp, number long"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The log of a folder: a row a write; empty where nothing was written."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except Exception as e:  # noqa: BLE001 - no table there yet is the one failure expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def read_meta(spark: SparkSession, path: str) -> Row | None:
    """The last write's row of the log: version, provider, dimensions, record_count, created_at."""
    return versions(spark, path).orderBy(F.desc("number"), "version").first()


def write_vectors(records: DataFrame, path: str, provider: str | None = None, vector: str = "vector") -> Row:
    """records (id, vector and any others) in place of all that path held; none at all clear it. Gives the log's new row. One writer at a time."""
    spark, version = records.sparkSession, uuid.uuid4().hex
    records.write.parquet(f"{path}/{version}")
    found = spark.read.schema(records.schema).parquet(f"{path}/{version}").agg(F.count(F.lit(1)).alias("record_count"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimensions"))
    last = read_meta(spark, path)
    row = found.select(F.lit(version).alias("version"), F.lit(provider).cast("string").alias("provider"), "dimensions", "record_count", F.current_timestamp().alias("created_at"), F.lit(last["number"] + 1 if last else 1).cast("long").alias("number"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return read_meta(spark, path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The records that the last write left; None where nothing was written, or all was cleared."""
    last = read_meta(spark, path)
    return spark.read.parquet(f"{path}/{last['version']}") if last and last["record_count"] else None


def refresh_vectors(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], provider: str | None = None) -> dict[str, int]:
    """Brings the vectors in path up to texts (id, text; an id once), and counts what was embedded, kept and removed.

    embed takes the rows of texts that are new or changed and gives (id, vector). Vectors of unchanged texts are kept, those of ids that are gone are removed;
    where nothing changed, nothing is written. Whether a text changed is told by its SHA-256, stored beside its vector.
    """
    spark = texts.sparkSession
    now = stored(texts.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), "texts")
    old = read_vectors(spark, path)
    if old is None:
        kept, before = None, 0
        changed = now
    else:
        kept = old.join(now.select("id", "text_sha256"), ["id", "text_sha256"], "left_semi")
        changed = now.join(old, ["id", "text_sha256"], "left_anti")
        before = old.count()
    n, same = changed.count(), 0 if kept is None else kept.count()
    gone = 0 if old is None else old.join(now, "id", "left_anti").count()
    if n or gone or (before and same < before):
        new = embed(changed.select("id", "text")).select("id", "vector").join(changed.select("id", "text_sha256"), "id").select("id", "vector", "text_sha256")
        write_vectors(new if kept is None else new.unionAll(kept.select("id", "vector", "text_sha256")), path, provider)
    return {"embedded": n, "kept": same, "removed": gone}


def write_vocabulary(idf: DataFrame, path: str) -> None:
    """(term, df, idf) of a corpus, so that later texts are weighed as it was."""
    idf.select("term", "df", "idf").write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df long, idf double").parquet(f"{path}/vocabulary")
