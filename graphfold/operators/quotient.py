"""Partition, quotient graph and exact costs.

Tables: ``partition(node, rep)``, ``sizes(rep, size)``, ``blocks(a, b, edges)`` with a <= b, where a = b counts a supernode's internal edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.functions.cost import block_cost, capacity, checked_block_cost


def singletons(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.col("node").alias("rep"))


def modulo_partition(nodes: DataFrame, k: int) -> DataFrame:
    """rep = node mod k; every rep is a member of its own supernode."""
    return nodes.select("node", (F.col("node") % k).alias("rep"))


def supernode_sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("rep").agg(F.count("*").alias("size"))


def relabel(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges with the reps of both ends. Small partitions are broadcast by size, large ones shuffled."""
    ru = partition.select(F.col("node").alias("u"), F.col("rep").alias("ru"))
    rv = partition.select(F.col("node").alias("v"), F.col("rep").alias("rv"))
    return edges.join(ru, "u").join(rv, "v").select("u", "v", "ru", "rv")


def quotient(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edge counts of all non-empty blocks; counts are combined before the shuffle."""
    r = relabel(edges, partition)
    return r.groupBy(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b")).agg(F.count("*").alias("edges"))


def with_sizes(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    sa = sizes.select(F.col("rep").alias("a"), F.col("size").alias("sa"))
    sb = sizes.select(F.col("rep").alias("b"), F.col("size").alias("sb"))
    return blocks.join(sa, "a").join(sb, "b").select("a", "b", "edges", "sa", "sb")


def block_costs(blocks: DataFrame, sizes: DataFrame, checked: bool = False) -> DataFrame:
    """blocks with sizes, capacity and cost."""
    inside = F.col("a") == F.col("b")
    cost = (checked_block_cost if checked else block_cost)(F.col("sa"), F.col("sb"), F.col("edges"), inside)
    return with_sizes(blocks, sizes).withColumn("capacity", capacity(F.col("sa"), F.col("sb"), inside)).withColumn("cost", cost)


def partition_cost(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    return block_costs(blocks, sizes, checked=True).agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("cost"))


def incident_costs(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per rep: the cost of its internal block and of all its blocks."""
    c = block_costs(blocks, sizes).select("a", "b", "cost")
    ends = c.select(F.col("a").alias("rep"), "cost").unionByName(c.where("a <> b").select(F.col("b").alias("rep"), "cost"))
    total = ends.groupBy("rep").agg(F.sum("cost").alias("incident"))
    return sizes.select("rep").join(total, "rep", "left").select("rep", F.coalesce("incident", F.lit(0)).cast("long").alias("incident"))


def rows(blocks: DataFrame) -> DataFrame:
    """Symmetric view without self entries: (rep, nbr, edges)."""
    x = blocks.where("a <> b")
    return x.select(F.col("a").alias("rep"), F.col("b").alias("nbr"), "edges").unionByName(x.select(F.col("b").alias("rep"), F.col("a").alias("nbr"), "edges"))


def arc_rows(blocks: DataFrame) -> DataFrame:
    """rows() plus self entries that count internal arcs."""
    return rows(blocks).unionByName(blocks.where("a = b and edges > 0").select(F.col("a").alias("rep"), F.col("b").alias("nbr"), (F.col("edges") * 2).alias("edges")))


def internal_edges(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    inner = blocks.where("a = b").select(F.col("a").alias("rep"), "edges")
    return sizes.join(inner, "rep", "left").select("rep", "size", F.coalesce("edges", F.lit(0)).cast("long").alias("internal_edges"))


def shape(blocks: DataFrame) -> DataFrame:
    """Non-zero entries of the symmetric rows and the greatest row length."""
    n = rows(blocks).groupBy("rep").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nnz"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_row_degree"))


def edge_count(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with the edges of their block; a missing block has none."""
    key = blocks.select(F.col("a").alias("_x"), F.col("b").alias("_y"), "edges")
    cond = (F.least("a", "b") == F.col("_x")) & (F.greatest("a", "b") == F.col("_y"))
    return pairs.join(key, cond, "left").select(*pairs.columns, F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def merge_labels(partition: DataFrame, merges: DataFrame) -> DataFrame:
    """Apply merges(keep, remove) to the labels; the pairs are disjoint."""
    m = merges.select(F.col("remove").alias("rep"), "keep")
    return partition.join(m, "rep", "left").select("node", F.coalesce("keep", "rep").alias("rep"))


def merge_blocks(blocks: DataFrame, merges: DataFrame) -> DataFrame:
    """Re-aggregate the quotient graph after merges, from its own rows; base edges are not read again."""
    ma = merges.select(F.col("remove").alias("a"), F.col("keep").alias("ka"))
    mb = merges.select(F.col("remove").alias("b"), F.col("keep").alias("kb"))
    moved = blocks.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"), "edges")
    return moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("edges").alias("edges"))


def merge_sizes(sizes: DataFrame, merges: DataFrame) -> DataFrame:
    m = merges.select(F.col("remove").alias("rep"), "keep")
    return sizes.join(m, "rep", "left").groupBy(F.coalesce("keep", "rep").alias("rep")).agg(F.sum("size").alias("size"))


def difference(blocks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows in one of two quotient graphs only; empty if they are equal."""
    a, b = blocks.select("a", "b", "edges"), rebuilt.select("a", "b", "edges")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def is_valid(partition: DataFrame) -> bool:
    """Every rep labels itself."""
    return partition.join(partition.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").where("node <> rep").isEmpty()


def digest(partition: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint of the labels, and their number. Combined before the shuffle, unlike the fingerprint in node order."""
    x = (F.lit(48271) * (F.col("rep") + 1) + F.lit(69621) * (F.col("node") + 1)) % F.lit(2147483647)
    return partition.agg(F.coalesce(F.bit_xor(x), F.lit(0)).cast("long").alias("digest"), F.count("*").alias("nodes"))
