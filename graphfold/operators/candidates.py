"""Candidate pairs: the in-group proxy with top-k, and two proposal indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphfold.checkpoint import materialise
from graphfold.functions.cost import block_cost, log2_floor
from graphfold.functions.hashing import overflow_rank
from graphfold.operators.gain import joint_cost
from graphfold.operators.quotient import arc_rows, edge_count, rows


def old_costs(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Approximate cost per rep over its row, self entry with arc count included."""
    s = sizes.select("rep", F.col("size").alias("s"))
    n = sizes.select(F.col("rep").alias("nbr"), F.col("size").alias("sn"))
    inside = F.col("rep") == F.col("nbr")
    got = arc_rows(blocks).join(s, "rep").join(n, "nbr").groupBy("rep").agg(F.sum(block_cost(F.col("s"), F.col("sn"), F.col("edges"), inside)).alias("old_cost"))
    return sizes.select("rep").join(got, "rep", "left").select("rep", F.coalesce("old_cost", F.lit(0)).cast("long").alias("old_cost"))


def shared_neighbours(blocks: DataFrame, sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, a, b, shared, joint) of members of a group that share a neighbour: the saving on shared neighbours (0: none), and the joint cost that exact_gain() needs.

    Pairs meet inside (group, neighbour), whose rows are bounded by the group limit.
    """
    s = sizes.select("rep", F.col("size").alias("s"))
    n = sizes.select(F.col("rep").alias("nbr"), F.col("size").alias("sn"))
    row = rows(blocks).join(groups.select("rep", "group", "idx"), "rep").join(s, "rep")
    pick = lambda k: row.select("group", "nbr", F.col("rep").alias(k), F.col("idx").alias(f"i{k}"), F.col("s").alias(f"s{k}"), F.col("edges").alias(f"e{k}"))
    pair = pick("a").join(pick("b"), ["group", "nbr"]).where("ia < ib").join(n, "nbr")  # rows have no self entries, so a shared neighbour is neither a nor b
    delta = block_cost(F.col("sa"), F.col("sn"), F.col("ea")) + block_cost(F.col("sb"), F.col("sn"), F.col("eb")) - block_cost(F.col("sa") + F.col("sb"), F.col("sn"), F.col("ea") + F.col("eb"))
    joint = joint_cost(F.col("sa") + F.col("sb"), F.col("sn"), F.col("ea"), F.col("eb"))
    return pair.groupBy("group", "a", "b").agg(F.sum(F.greatest(delta, F.lit(0))).alias("shared"), F.sum(joint).alias("joint"))


def proxy_shared(blocks: DataFrame, sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, a, b, shared): positive savings on neighbours that two members of a group share."""
    return shared_neighbours(blocks, sizes, groups).where("shared > 0").select("group", "a", "b", "shared")


def proxy_direct(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, a, b, direct): edges between members of one group."""
    g = groups.select("rep", "group", "idx")
    ga = g.select(F.col("rep").alias("a"), F.col("group"), F.col("idx").alias("ia"))
    gb = g.select(F.col("rep").alias("b"), F.col("group").alias("gb"), F.col("idx").alias("ib"))
    x = blocks.where("a <> b").join(ga, "a").join(gb, "b").where(F.col("group") == F.col("gb"))
    swap = F.col("ia") > F.col("ib")
    return x.select("group", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.col("edges").alias("direct"))


def proxy(blocks: DataFrame, sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, a, b, proxy_gain, proxy_ratio, joint) with a positive gain."""
    both = shared_neighbours(blocks, sizes, groups).withColumnRenamed("shared", "g").unionByName(proxy_direct(blocks, groups).withColumnRenamed("direct", "g").withColumn("joint", F.lit(None).cast("long")))
    gain = both.groupBy("group", "a", "b").agg(F.sum("g").alias("proxy_gain"), F.sum("joint").alias("joint")).where("proxy_gain > 0")
    old = old_costs(blocks, sizes)
    oa, ob = old.select(F.col("rep").alias("a"), F.col("old_cost").alias("oa")), old.select(F.col("rep").alias("b"), F.col("old_cost").alias("ob"))
    ratio = F.col("proxy_gain") / F.greatest(F.lit(1), F.col("oa") + F.col("ob"))
    return gain.join(oa, "a").join(ob, "b").select("group", "a", "b", "proxy_gain", ratio.alias("proxy_ratio"), "joint")


def top_k(pairs: DataFrame, groups: DataFrame, k: int = 16) -> DataFrame:
    """A pair survives if it is among the first k of either end, by ratio, gain, lower rep, higher rep; k is at most the group's size less one."""
    n = groups.groupBy("group").agg(F.greatest(F.lit(1), F.least(F.lit(k), F.count("*") - 1)).alias("k"))
    ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
    order = Window.partitionBy("group", "end").orderBy(F.desc("proxy_ratio"), F.desc("proxy_gain"), F.least("a", "b"), F.greatest("a", "b"))
    ranked = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return ranked.join(n, "group").where("r <= k").select(*pairs.columns).distinct()


#: Precedence of proposal sources on equal scores (fixed values).
DIRECT, SHARED, EXPLORATION, RESIDUAL = 0, 1, 2, 3


def _best(df: DataFrame, n: int, by: str = "source") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), "source_type", "target")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def direct_proposals(blocks: DataFrame, budget: int) -> DataFrame:
    """(source, target, source_type, score): the neighbours with most edges."""
    return _best(rows(blocks).select(F.col("rep").alias("source"), F.col("nbr").alias("target"), F.lit(DIRECT).alias("source_type"), F.col("edges").alias("score")), budget)


def two_hop_proposals(blocks: DataFrame, budget: int, pivots: int = 2) -> DataFrame:
    """Neighbours of the strongest neighbours; score is the weaker of both edges."""
    near = direct_proposals(blocks, max(budget, pivots))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    pivot = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pivots).select("source", F.col("target").alias("pivot"), F.col("score").alias("e1"))
    far = direct_proposals(blocks, budget).select(F.col("source").alias("pivot"), "target", F.col("score").alias("e2"))
    return pivot.join(far, "pivot").where("target <> source").select("source", "target", F.lit(SHARED).alias("source_type"), F.least("e1", "e2").alias("score"))


def exploration_proposals(sizes: DataFrame, seed: int) -> DataFrame:
    """One other active rep for each, by hash. The reps are numbered by ranges, so no task orders them all."""
    from graphfold.operators.encode import dense_ids

    ids = materialise(dense_ids(sizes.select("rep")), "ids")
    n = ids.count()
    if n < 2:
        return sizes.sparkSession.createDataFrame([], "source long, target long, source_type int, score long")
    at = F.pmod("h", F.lit(n))
    pick = materialise(overflow_rank(ids, "rep", "h", seed), "ranked").select(F.col("rep").alias("source"), F.when(at == F.col("id"), (at + 1) % n).otherwise(at).alias("id"))
    return pick.join(ids.select("id", F.col("rep").alias("target")), "id").select("source", "target", F.lit(EXPLORATION).alias("source_type"), F.lit(0).cast("long").alias("score"))


def neighbour_proposals(blocks: DataFrame, sizes: DataFrame, budget: int = 8, seed: int = 1) -> DataFrame:
    """Direct, two-hop and exploration proposals, one per target, the best ``budget``."""
    every = direct_proposals(blocks, budget).unionByName(two_hop_proposals(blocks, budget)).unionByName(exploration_proposals(sizes, seed))
    w = Window.partitionBy("source", "target").orderBy(F.desc("score"), "source_type")
    return _best(every.withColumn("_t", F.row_number().over(w)).where("_t = 1").drop("_t"), budget)


def residual_features(blocks: DataFrame, sizes: DataFrame, limit: int = 8) -> DataFrame:
    """(rep, nbr, sign, bin, norm): the neighbours where a rep's block is most decided."""
    s = sizes.select("rep", F.col("size").alias("s"))
    n = sizes.select(F.col("rep").alias("nbr"), F.col("size").alias("sn"))
    x = rows(blocks).join(s, "rep").join(n, "nbr").withColumn("cap", F.col("s") * F.col("sn")).withColumn("res", 2 * F.col("edges") - F.col("cap"))
    x = x.withColumn("mag", F.abs("res")).withColumn("norm", F.floor(F.col("mag") * 1024 / F.col("cap")).cast("long"))
    w = Window.partitionBy("rep").orderBy(F.desc("norm"), F.desc("mag"), "nbr")
    top = x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return top.select("rep", "nbr", (F.col("res") >= 0).alias("sign"), F.least(F.lit(15), log2_floor(F.col("norm"))).cast("int").alias("bin"), "norm")


def residual_buckets(features: DataFrame, fanout: int = 8) -> DataFrame:
    """The first ``fanout`` members of every (nbr, sign, bin) bucket."""
    w = Window.partitionBy("nbr", "sign", "bin").orderBy(F.desc("norm"), "rep")
    return features.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fanout).drop("r")


def residual_scores(features: DataFrame, blocks: DataFrame, sizes: DataFrame, fanout: int = 8) -> DataFrame:
    """(source, target, score) of reps that meet in a bucket: agreement less conflict, alike sizes and an edge add."""
    met = features.select(F.col("rep").alias("source"), "nbr", "sign", "bin").join(residual_buckets(features, fanout).select(F.col("rep").alias("target"), "nbr", "sign", "bin"), ["nbr", "sign", "bin"]).where("source <> target").select("source", "target").distinct()
    fs = features.select(F.col("rep").alias("source"), "nbr", F.col("sign").alias("s1"), F.col("norm").alias("n1"))
    ft = features.select(F.col("rep").alias("target"), "nbr", F.col("sign").alias("s2"), F.col("norm").alias("n2"))
    low = F.least("n1", "n2")
    agree = met.join(fs, "source").join(ft, ["target", "nbr"]).groupBy("source", "target").agg(F.sum(F.when(F.col("s1") == F.col("s2"), low).otherwise(0)).alias("align"), F.sum(F.when(F.col("s1") != F.col("s2"), low).otherwise(0)).alias("conflict"))
    size = lambda k: sizes.select(F.col("rep").alias(k), log2_floor(F.col("size")).alias(f"l{k}"))
    pairs = edge_count(blocks, agree.select(F.col("source").alias("a"), F.col("target").alias("b"), "align", "conflict")).select(F.col("a").alias("source"), F.col("b").alias("target"), "align", "conflict", "edges")
    alike = F.floor(F.lit(128) / (1 + F.abs(F.col("lsource") - F.col("ltarget")))).cast("long")
    score = 4 * F.col("align") - 3 * F.col("conflict") + alike + F.when(F.col("edges") > 0, 128).otherwise(0)
    return pairs.join(size("source"), "source").join(size("target"), "target").select("source", "target", score.cast("long").alias("score"))


def residual_proposals(blocks: DataFrame, sizes: DataFrame, budget: int = 8, seed: int = 1) -> DataFrame:
    """Residual, direct, two-hop (one pivot) and exploration proposals within their quotas."""
    r, d, s = (4, 2, 1) if budget >= 8 else (2, 1, 0)
    res = residual_scores(residual_features(blocks, sizes), blocks, sizes).withColumn("source_type", F.lit(RESIDUAL))
    every = _best(res, r).unionByName(_best(direct_proposals(blocks, budget), d)).unionByName(exploration_proposals(sizes, seed))
    if s:
        every = every.unionByName(_best(two_hop_proposals(blocks, budget, 1), s))
    w = Window.partitionBy("source", "target").orderBy(F.desc("score"), "source_type")
    return _best(every.withColumn("_t", F.row_number().over(w)).where("_t = 1").drop("_t"), budget)
