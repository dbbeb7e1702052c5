"""Cut lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own where that is unset, in local mode only: executors on other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='graphfold-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Spark then deletes a plan's shuffle files when the plan has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` and read it back; survives the loss of executors, unlike a local checkpoint. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialise() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if not files:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
