"""Edge sources: text edge lists with validation, and graphs derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 2**31 - 2


def read_edge_list(spark: SparkSession, path: str, duplicates: str = "raise") -> DataFrame:
    """Whitespace-separated ``u v`` lines -> canonical edges(u < v).

    Blank lines and lines that start with # are skipped, further tokens are ignored. A malformed line, a negative or too large id, a
    self-loop, an empty graph, and (unless ``duplicates="drop"``) an edge given twice, in either direction, raise ValueError.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^[ \t\r]*(#|$)"))
    parts = F.split(F.trim(F.regexp_replace("value", r"[ \t\r]+", " ")), " ")
    ids = lines.select("value", F.try_element_at(parts, F.lit(1)).try_cast("long").alias("x"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("y"))
    wrong = F.col("x").isNull() | F.col("y").isNull() | (F.least("x", "y") < 0) | (F.greatest("x", "y") > MAX_ID) | (F.col("x") == F.col("y"))
    n, bad = ids.agg(F.count("*"), F.min(F.when(wrong, F.col("value")))).first()  # one pass for both
    if bad is not None:
        raise ValueError(f"invalid edge line: {bad!r}")
    if not n:
        raise ValueError("the graph has no edges")
    edges = ids.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    if duplicates == "drop":
        return edges.distinct()
    twice = edges.groupBy("u", "v").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"edge given twice: {twice[0]['u']} {twice[0]['v']}")
    return edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def co_occurrence(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct pairs of items that share a key, as canonical edges. The self-join runs inside a key, whose items are few in an order."""
    one = rows.select(F.col(key).alias("k"), F.col(item).cast("long").alias("i")).distinct()
    pairs = one.select("k", F.col("i").alias("u")).join(one.select("k", F.col("i").alias("v")), "k").where("u < v")
    return pairs.select("u", "v").distinct()


def bipartite(rows: DataFrame, left: str, right: str, offset: int) -> DataFrame:
    """Distinct (left, right) pairs; right ids are moved up by ``offset``."""
    return rows.select(F.col(left).cast("long").alias("u"), (F.col(right) + F.lit(offset)).cast("long").alias("v")).distinct()


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def strong_pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """co_occurrence() edges whose items share at least as many keys as the average pair does: a graph of medium density."""
    one = rows.select(F.col(key).alias("k"), F.col(item).cast("long").alias("i")).distinct()
    pairs = one.select("k", F.col("i").alias("u")).join(one.select("k", F.col("i").alias("v")), "k").where("u < v").groupBy("u", "v").agg(F.count("*").alias("c"))
    total = pairs.agg(F.sum("c").alias("total"), F.count("*").alias("n"))
    return pairs.crossJoin(F.broadcast(total)).where("c * n >= total").select("u", "v")  # one row of totals


def supp_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def supp_cooccur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def _offset(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.max(key), F.lit(-1))).first()[0] + 1


def supp_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", _offset(table(spark, sf_dir, "supplier"), "s_suppkey"))


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders, "l_orderkey")


def cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(_customer_lines(spark, sf_dir), "o_custkey", "l_partkey", _offset(table(spark, sf_dir, "customer"), "c_custkey"))


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(_customer_lines(spark, sf_dir), "o_custkey", "l_suppkey", _offset(table(spark, sf_dir, "customer"), "c_custkey"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def node_domain(edges: DataFrame) -> DataFrame:
    """Every id from 0 to the greatest one; ids that no edge names are isolated nodes."""
    top = edges.agg(F.max(F.greatest("u", "v"))).first()[0]
    return edges.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def has_arcs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are arcs."""
    return pairs.join(arcs(edges), ["u", "v"], "left_semi")


def check_arc_count(edges: DataFrame) -> int:
    """Number of arcs; raises unless it is twice the number of distinct edges."""
    n, d = edges.agg(F.count("*"), F.count_distinct(F.least("u", "v"), F.greatest("u", "v"))).first()
    if n != d:
        raise ValueError("arcs are not twice the edges")
    return 2 * n
