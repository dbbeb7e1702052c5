"""Sinks: summaries as text or Parquet, and CSV files that only grow under the same header."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.operators.encode import Encoding

#: Columns of the commit audit file (fixed values).
AUDIT_COLUMNS = ("dataset", "commit_policy", "batch_id", "batch_size", "partition_exact_cost", "cumulative_realized_gain", "rejected_pair_count")


def write_summary(e: Encoding, path: str, form: str = "text") -> None:
    """G, P, Cp and Cm under ``path``: tab-separated text, sorted, or Parquet with an array of members."""
    parts = {"G": e.G, "P": e.P, "Cp": e.Cp, "Cm": e.Cm}
    for name, df in parts.items():
        if form == "parquet":
            df.write.parquet(f"{path}/{name}.parquet")
        elif name == "G":
            line = F.concat_ws("\t", F.col("sid").cast("string"), F.array_join("members", "\t"))
            df.orderBy("sid").select(line.alias("value")).write.text(f"{path}/G.txt")
        else:
            df.orderBy(*df.columns).write.csv(f"{path}/{name}.txt", sep="\t")


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows; a header other than the one on file is refused."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        have = spark.read.csv(path, header=True).columns
        if have != df.columns:
            raise ValueError(f"the header of {path} differs: {have}")
    df.write.mode("append").csv(path, header=True)


def dataset_label(path: str) -> str:
    """Name of the parent folder, else the file's stem."""
    p = PurePosixPath(path)
    return p.parent.name or p.stem
