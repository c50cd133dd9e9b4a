"""Change feeds: the newest state of each key, kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str = "path", at: str = "ts", tie: str = "seq") -> DataFrame:
    """The newest row of each key of a change log, in one aggregation."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(key, "r.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window and type; on a stream, rows later than the watermark are left out."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "path", at: str = "ts", tie: str = "seq", whole_every: int = 1):
    """Starts a query that keeps under path the newest state of each key: a version a batch, named by the batch, so a batch that is run again writes the same.

    Each whole_every-th version is whole, merged from those before; the others hold only what their batch brought, so a large state is not written anew for every
    small batch. read_latest() puts them together.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch, key, at, tie)
        if number and number % whole_every == 0:
            old = batch.sparkSession.read.schema(new.schema).parquet(*[f"{path}/v={k}" for k in range(number - whole_every, number)])
            new = latest(old.unionByName(new), key, at, tie)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str = "path", at: str = "ts", tie: str = "seq", whole_every: int = 1) -> DataFrame:
    """The state that keep_latest() left with the same whole_every."""
    last = spark.read.parquet(path).agg(F.max("v")).first()[0]  # v is a partition, so no rows are read
    return latest(spark.read.parquet(*[f"{path}/v={k}" for k in range(last - last % whole_every, last + 1)]), key, at, tie)
