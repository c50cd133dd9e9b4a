"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir); where it is unset, a new temporary one is made and set, on a local master only: executors elsewhere do not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fernweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/fernweave/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go only when the driver's JVM collects its garbage; so it is asked to."""
    spark.sparkContext._jvm.System.gc()
