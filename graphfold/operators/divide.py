"""Divide: groups of supernodes that look alike, by min-hashes of closed neighbourhoods in the input graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfold.checkpoint import materialise
from graphfold.functions.hashing import dim_order, fallback_rank, hash_rank, overflow_rank, unsigned_order
from graphfold.sources.graphs import arcs


def node_shingle(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """(node, shingle): least rank over the node and its neighbours. ``ranked(node, r)``: ranks are computed once per node, then travel along arcs."""
    far = arcs(edges).join(ranked.select(F.col("node").alias("v"), "r"), "v").select(F.col("u").alias("node"), "r")
    return far.unionByName(ranked.select("node", "r")).groupBy("node").agg(F.min("r").alias("shingle"))


def supernode_minhash(edges: DataFrame, partition: DataFrame, ranked: DataFrame) -> DataFrame:
    """(rep, minhash): least shingle of the members."""
    return node_shingle(edges, ranked).join(partition, "node").groupBy("rep").agg(F.min("shingle").alias("minhash"))


def ordered_chunks(groups: DataFrame, order: Column, size: int) -> DataFrame:
    """(rep, group, idx, chunk): place of each rep in its group by (order, rep), and place div size.

    Places come from counts of 256 order ranges and places inside a range, so a large group is never sorted in one task.
    """
    g = groups.select("rep", "group", order.alias("_o")).withColumn("_r", F.shiftright("_o", 56))
    sub = g.groupBy("group", "_r").agg(F.count("*").alias("_n"))
    base = sub.select("group", "_r", (F.sum("_n").over(Window.partitionBy("group").orderBy("_r")) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("group", "_r").orderBy("_o", "rep")) - 1 + F.col("_base")
    return g.join(base, ["group", "_r"]).select("rep", "group", place.cast("long").alias("idx"), F.floor(place / size).cast("long").alias("chunk"))


def split_by_hash(groups: DataFrame, hashes: DataFrame) -> DataFrame:
    """Split (rep, group) by minhash: the new group names the old one and the hash."""
    return groups.join(hashes, "rep").select("rep", F.concat_ws(":", "group", F.col("minhash").cast("string")).alias("group"))


def oversized(groups: DataFrame, limit: int) -> DataFrame:
    n = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return groups.join(n.select("group"), "group", "left_semi")


def fallback_chunks(groups: DataFrame, limit: int, iteration: int, seed: int) -> DataFrame:
    """Cut groups by a fresh random order into chunks of ``limit``; idx is the place in that order."""
    ranked = materialise(fallback_rank(groups, "rep", "_f", iteration, seed), "ranked")
    c = ordered_chunks(ranked, unsigned_order(F.col("_f")), limit)
    return c.select("rep", F.concat_ws("#", "group", F.col("chunk").cast("string")).alias("group"), "idx")


def rep_chunks(groups: DataFrame, limit: int) -> DataFrame:
    """Cut groups in rep order into chunks of ``limit``."""
    n = groups.agg(F.coalesce(F.max("rep"), F.lit(0))).first()[0] + 1
    c = ordered_chunks(groups, F.shiftleft((F.col("rep") * 256 / n).cast("long") - 128, 56), limit)  # 256 ranges, signed
    return c.select("rep", F.concat_ws("/", "group", F.col("chunk").cast("string")).alias("group"), "idx")


def divide(edges: DataFrame, partition: DataFrame, iteration: int, dims: int = 16, limit: int = 512, seed: int = 1) -> DataFrame:
    """(rep, group, idx). Only groups above ``limit`` are hashed again; idx orders a group's members (by rep, or by the fallback's order)."""
    live = materialise(partition.select("rep").distinct().select("rep", F.lit("").alias("group")), "reps")
    done: list[DataFrame] = []
    for d in dim_order(dims, iteration, seed):
        big = materialise(oversized(live, limit), "big")
        if big.isEmpty():
            break
        done.append(live.join(big.select("rep"), "rep", "left_anti"))
        members = partition.join(big.select("rep"), "rep", "left_semi")
        # written, so that the planner sees a column and not the mixer's chain of expressions
        ranked = materialise(hash_rank(partition.select("node"), "node", "r", d, iteration, seed), "ranked")
        order = ranked.select("node", unsigned_order(F.col("r")).alias("r"))
        # only arcs that leave a member of a big group count
        far = arcs(edges).join(members.select(F.col("node").alias("u"), "rep"), "u").join(order.withColumnRenamed("node", "v"), "v").select("rep", "r")
        hashes = far.unionByName(members.join(order, "node").select("rep", "r")).groupBy("rep").agg(F.min("r").alias("minhash"))
        live = materialise(split_by_hash(big, hashes), "live")
    big = oversized(live, limit)
    plain = live.join(big.select("rep"), "rep", "left_anti")
    for x in done:
        plain = plain.unionByName(x)
    return plain.select("rep", "group", F.col("rep").alias("idx")).unionByName(fallback_chunks(big, limit, iteration, seed))


def refine_overflow(edges: DataFrame, partition: DataFrame, groups: DataFrame, gmax: int, rounds: int, seed: int) -> DataFrame:
    """Groups above ``gmax`` are split up to ``rounds`` times by the least node of least rank near any member, then cut in rep order."""
    groups = groups.select("rep", "group")
    if gmax <= 0:
        return groups.select("rep", "group", F.col("rep").alias("idx"))
    done: list[DataFrame] = []
    for r in range(rounds):
        big = materialise(oversized(groups, gmax), "over")
        done.append(groups.join(big.select("rep"), "rep", "left_anti"))
        if big.isEmpty():
            groups = big
            break
        ranked = materialise(overflow_rank(partition.select("node"), "node", "r", seed + r + 1), "ranked").select(F.col("node").alias("v"), F.struct(unsigned_order(F.col("r")).alias("r"), F.col("node").alias("v")).alias("x"))
        closed = arcs(edges).unionByName(partition.select(F.col("node").alias("u"), F.col("node").alias("v")))
        key = closed.join(ranked, "v").groupBy(F.col("u").alias("node")).agg(F.min("x").alias("x"))
        least = key.join(partition, "node").groupBy("rep").agg(F.min("x.v").alias("minhash"))
        groups = materialise(split_by_hash(big, least), "refined")
    big = oversized(groups, gmax)
    out = groups.join(big.select("rep"), "rep", "left_anti")
    for x in done:
        out = out.unionByName(x)
    return out.select("rep", "group", F.col("rep").alias("idx")).unionByName(rep_chunks(big, gmax))
