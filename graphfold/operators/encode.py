"""Encode a partition as G, P, Cp, Cm; drop within an error bound; rebuild the edges; measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphfold.checkpoint import materialise
from graphfold.functions.cost import capacity
from graphfold.operators.quotient import quotient, relabel, supernode_sizes, with_sizes
from graphfold.sources.graphs import degrees

STEP = 1 << 16


@dataclass
class Encoding:
    """members(sid, node), P(a, b), Cp(u, v), Cm(u, v); P names supernodes by sid, a <= b."""

    members: DataFrame
    P: DataFrame
    Cp: DataFrame
    Cm: DataFrame
    objective: str = "mags"

    @property
    def G(self) -> DataFrame:  # noqa: N802
        """(sid, members): members in ascending order."""
        return self.members.groupBy("sid").agg(F.sort_array(F.collect_list("node")).alias("members"))


def dense_ids(reps: DataFrame) -> DataFrame:
    """(rep, id): 0..n-1 in ascending rep order, from counts of ranges of 65536 reps (at most 32768 ranges) and places inside them."""
    r = reps.select("rep").distinct().withColumn("_b", F.floor(F.col("rep") / STEP))
    base = r.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_b").orderBy("rep")) - 1
    return r.withColumn("_p", place).join(base, "_b").select("rep", (F.col("_p") + F.col("_base")).cast("long").alias("id"))


def dense_blocks(blocks: DataFrame, sizes: DataFrame, objective: str = "mags") -> DataFrame:
    """Blocks that are cheaper as a superedge; a tie lists the edges."""
    x = with_sizes(blocks, sizes)
    inside = F.col("a") == F.col("b")
    if objective == "mags":
        dense = F.col("edges") > 1 + capacity(F.col("sa"), F.col("sb"), inside) - F.col("edges")
    else:  # internal blocks count arcs against a quarter of s(s-1)
        dense = F.when(inside, F.col("edges") * 8 > F.col("sa") * (F.col("sa") - 1)).otherwise(F.col("edges") * 2 > F.col("sa") * F.col("sb"))
    return x.where(dense).select("a", "b")


def block_pairs(superedges: DataFrame, members: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """(a, b, u, v): all node pairs of blocks (a, b). Their number is under twice the edges, as only dense blocks are expanded."""
    ma = members.select(F.col(key).alias("a"), F.col("node").alias("u"))
    mb = members.select(F.col(key).alias("b"), F.col("node").alias("v"))
    inside = F.col("u") != F.col("v") if ordered else F.col("u") < F.col("v")
    return superedges.join(ma, "a").join(mb, "b").where((F.col("a") != F.col("b")) | inside)


def encode(edges: DataFrame, partition: DataFrame, objective: str = "mags") -> Encoding:
    r = relabel(edges, partition)
    swap = F.col("ru") > F.col("rv")
    placed = r.select(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"))
    blocks, sizes = quotient(edges, partition), supernode_sizes(partition)
    dense = materialise(dense_blocks(blocks, sizes, objective), "dense")
    cp = placed.join(dense, ["a", "b"], "left_anti")
    have = placed.join(dense, ["a", "b"], "left_semi")
    legacy = objective != "mags"
    if legacy:  # internal pairs are listed in both directions
        both = lambda d: d.unionByName(d.where("a = b").select("a", "b", F.col("v").alias("u"), F.col("u").alias("v")))
        cp, have = both(cp), both(have)
    cm = block_pairs(dense, partition, "rep", legacy).join(have, ["a", "b", "u", "v"], "left_anti")
    sid = dense_ids(partition)
    sa, sb = sid.select(F.col("rep").alias("a"), F.col("id").alias("x")), sid.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    return Encoding(partition.join(sid, "rep").select(F.col("id").alias("sid"), "node"), dense.join(sa, "a").join(sb, "b").select(F.col("x").alias("a"), F.col("y").alias("b")), cp.select("u", "v"), cm.select("u", "v"), objective)


def reconstruct(e: Encoding) -> DataFrame:
    """Canonical edges (u < v) that the encoding stands for: expand P, take out Cm, add Cp."""
    canon = lambda d: d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    full = canon(block_pairs(e.P, e.members, "sid"))
    return full.join(canon(e.Cm).distinct(), ["u", "v"], "left_anti").unionByName(canon(e.Cp)).distinct()


def difference(edges: DataFrame, e: Encoding) -> DataFrame:
    """Edges in one of input and reconstruction only; empty if lossless."""
    back = reconstruct(e)
    return edges.select("u", "v").exceptAll(back).unionByName(back.exceptAll(edges.select("u", "v")))


def metrics(e: Encoding, n_edges: int) -> DataFrame:
    """One row: counts, the standard cost, the doubled cost and their ratios to the edges."""
    kinds = e.P.select(F.when(F.col("a") == F.col("b"), "superedges_loop").otherwise("superedges_nonloop").alias("k")).unionByName(e.Cp.select(F.lit("cp").alias("k"))).unionByName(e.Cm.select(F.lit("cm").alias("k")))
    x = kinds.agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("superedges_loop", "superedges_nonloop", "cp", "cm")))
    cost = F.col("superedges_loop") + F.col("superedges_nonloop") + F.col("cp") + F.col("cm")
    double = cost * 2 if e.objective == "mags" else cost * 2 - F.col("superedges_loop")
    x = x.withColumn("cost_standard", cost).withColumn("cost_x2", double)
    m = F.lit(n_edges)
    ratio = lambda c, d: F.when(m > 0, F.col(c) / (m * d)).otherwise(0.0)
    return x.withColumn("ratio_standard", ratio("cost_standard", 1)).withColumn("ratio_x2", ratio("cost_x2", 2)).withColumn("compression_gain", 1 - F.col("ratio_standard"))


def _drop_list(items: DataFrame, budget: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan a correction list in order, dropping an entry while both nodes have budget; in parallel rounds.

    In a round an entry goes if its rank among undecided entries is within the budget at both nodes; it stays if a node has no budget. Both
    are what the sequential scan does. ``budget(node, left)`` is integral.
    """
    live, kept = materialise(items.select("u", "v"), "live"), []
    while not live.isEmpty():
        bu, bv = budget.select(F.col("node").alias("u"), F.col("left").alias("lu")), budget.select(F.col("node").alias("v"), F.col("left").alias("lv"))
        x = live.join(bu, "u").join(bv, "v")
        kept.append(x.where("lu < 1 or lv < 1").select("u", "v"))
        open_ = x.where("lu >= 1 and lv >= 1")
        ends = open_.select(F.col("u").alias("n"), "u", "v").unionByName(open_.select(F.col("v").alias("n"), "u", "v"))
        rank = F.row_number().over(Window.partitionBy("n").orderBy("u", "v"))
        last = ends.withColumn("r", rank).groupBy("u", "v").agg(F.max(F.when(F.col("n") == F.col("u"), F.col("r"))).alias("r1"), F.max(F.when(F.col("n") == F.col("v"), F.col("r"))).alias("r2"))
        state = materialise(open_.join(last, ["u", "v"]).withColumn("goes", (F.col("r1") <= F.col("lu")) & (F.col("r2") <= F.col("lv"))), "round")
        gone = state.where("goes")
        used = gone.select(F.col("u").alias("node")).unionByName(gone.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("used"))
        budget = materialise(budget.join(used, "node", "left").select("node", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")), "budget")
        live = state.where("not goes").select("u", "v")
    out = items.select("u", "v").limit(0)
    for k in kept:
        out = out.unionByName(k)
    return out, budget


def _drop_superedges(p: DataFrame, size: DataFrame, budget: DataFrame) -> DataFrame:
    """Scan superedges by size product: drop one if every member of either end can lose the other end's size. All members of
    a supernode lose alike, so its least budget is enough; an entry is decided once it is first at both ends."""
    sa, sb = size.select(F.col("sid").alias("a"), F.col("size").alias("sa")), size.select(F.col("sid").alias("b"), F.col("size").alias("sb"))
    loops, live, kept = p.where("a = b"), materialise(p.where("a <> b").join(sa, "a").join(sb, "b"), "live"), []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("n"), "*").unionByName(live.select(F.col("b").alias("n"), "*"))
        order = F.struct((F.col("sa") * F.col("sb")).alias("o"), "a", "b")
        first = ends.groupBy("n").agg(F.min(order).alias("f")).select("n", "f.a", "f.b").groupBy("a", "b").count().where("count = 2").select("a", "b")
        la, lb = budget.select(F.col("sid").alias("a"), F.col("left").alias("la")), budget.select(F.col("sid").alias("b"), F.col("left").alias("lb"))
        now = materialise(live.join(first, ["a", "b"]).join(la, "a").join(lb, "b").withColumn("goes", (F.col("la") >= F.col("sb")) & (F.col("lb") >= F.col("sa"))), "decided")
        gone = now.where("goes")
        used = gone.select(F.col("a").alias("sid"), F.col("sb").alias("x")).unionByName(gone.select(F.col("b").alias("sid"), F.col("sa").alias("x"))).groupBy("sid").agg(F.sum("x").alias("x"))
        budget = materialise(budget.join(used, "sid", "left").select("sid", (F.col("left") - F.coalesce("x", F.lit(0))).alias("left")), "budget")
        kept.append(now.where("not goes").select("a", "b"))
        live = materialise(live.join(now.select("a", "b"), ["a", "b"], "left_anti"), "live")
    out = loops.select("a", "b")
    for k in kept:
        out = out.unionByName(k)
    return out


def drop(e: Encoding, edges: DataFrame, error_bound: float) -> Encoding:
    """Give up corrections, then superedges, while no node loses more than ``error_bound`` times its degree."""
    if error_bound <= 0:
        return e
    nodes = e.members.select("node")
    left = F.floor(F.coalesce("degree", F.lit(0)) * F.lit(float(error_bound))).cast("long")
    budget = materialise(nodes.join(degrees(edges), "node", "left").select("node", left.alias("left")), "budget")
    cp, budget = _drop_list(e.Cp, budget)
    cm, budget = _drop_list(e.Cm, budget)
    size = e.members.groupBy("sid").agg(F.count("*").alias("size"))
    least = e.members.join(budget, "node").groupBy("sid").agg(F.min("left").alias("left"))
    return Encoding(e.members, _drop_superedges(e.P, size, least), cp, cm, e.objective)
