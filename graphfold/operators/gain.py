"""Exact merge gains, upper bounds and what merging would cost.

``pairs(a, b)`` are candidates; results add ``gain`` and ``before_cost``. Rows of a pair are never gathered in memory: sums over them are joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.functions.cost import block_cost
from graphfold.operators.quotient import arc_rows, edge_count, incident_costs, internal_edges, rows, quotient, supernode_sizes


def _ends(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs with sizes, internal edges, incident costs of both ends and the edges between them."""
    of = internal_edges(blocks, sizes).join(incident_costs(blocks, sizes), "rep")
    a = of.select(F.col("rep").alias("a"), F.col("size").alias("sa"), F.col("internal_edges").alias("ia"), F.col("incident").alias("ca"))
    b = of.select(F.col("rep").alias("b"), F.col("size").alias("sb"), F.col("internal_edges").alias("ib"), F.col("incident").alias("cb"))
    return edge_count(blocks, pairs.select("a", "b").distinct()).join(a, "a").join(b, "b")


def _merged_rows(pairs: DataFrame, row: DataFrame) -> DataFrame:
    """(a, b, x, ea, eb): edges of both ends to every neighbour of either."""
    ra = row.select(F.col("rep").alias("a"), F.col("nbr").alias("x"), F.col("edges").alias("ea"))
    rb = row.select(F.col("rep").alias("b"), F.col("nbr").alias("x"), F.col("edges").alias("eb"))
    zero = F.lit(0).cast("long")
    left = pairs.join(ra, "a").select("a", "b", "x", "ea", zero.alias("eb"))
    right = pairs.join(rb, "b").select("a", "b", "x", zero.alias("ea"), "eb")
    return left.unionByName(right).groupBy("a", "b", "x").agg(F.sum("ea").alias("ea"), F.sum("eb").alias("eb"))


def upper_bound(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """before_cost and upper_bound = before - cost of the merged internal block; gains never exceed it."""
    e = _ends(pairs, blocks, sizes)
    before = F.col("ca") + F.col("cb") - block_cost(F.col("sa"), F.col("sb"), F.col("edges"))
    s = F.col("sa") + F.col("sb")
    merged = block_cost(s, s, F.col("ia") + F.col("ib") + F.col("edges"), True)
    return e.select("a", "b", before.alias("before_cost"), (before - merged).alias("upper_bound"))


def certified(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs that the upper bound can't rule out."""
    ub = upper_bound(pairs, blocks, sizes)
    keep = F.col("upper_bound") > 0
    if threshold > 0:
        keep &= (F.col("before_cost") > 0) & (F.col("upper_bound") / F.col("before_cost") >= threshold)
    return ub.where(keep)


def joint_cost(s: Column, sn: Column, ea: Column, eb: Column) -> Column:
    """What a shared neighbour costs a merged supernode, less what both ends' edges to it would cost the merged supernode one by one."""
    return block_cost(s, sn, ea + eb) - block_cost(s, sn, ea) - block_cost(s, sn, eb)


def joint_costs(pairs: DataFrame, row: DataFrame) -> DataFrame:
    """(a, b, joint) of pairs(a, b, s) that share a neighbour; ``row`` is rows() with the neighbour's size ``sn``."""
    near = pairs.select("a", "b", "s").join(row.select(F.col("rep").alias("a"), "nbr", "sn", F.col("edges").alias("ea")), "a")
    both = near.join(row.select(F.col("rep").alias("b"), "nbr", F.col("edges").alias("eb")), ["b", "nbr"])
    return both.groupBy("a", "b").agg(F.sum(joint_cost(F.col("s"), F.col("sn"), F.col("ea"), F.col("eb"))).alias("joint"))


def exact_gain(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Gain in exact partition cost if a and b merge.

    The cost of a merged row is what each end's own row costs at the merged size, corrected where both have the same neighbour. The former is one sum per
    end and merged size, shared by all pairs that have them; only the latter needs pairs to meet neighbours. ``pairs`` may bring that correction
    as ``joint``, if candidate search has met the shared neighbours already (null: none); else it is joined here.
    """
    e = _ends(pairs, blocks, sizes)
    s = F.col("sa") + F.col("sb")
    before = F.col("ca") + F.col("cb") - block_cost(F.col("sa"), F.col("sb"), F.col("edges"))
    inner = block_cost(s, s, F.col("ia") + F.col("ib") + F.col("edges"), True)
    between = block_cost(s, F.col("sa"), F.col("edges")) + block_cost(s, F.col("sb"), F.col("edges"))
    head = e.select("a", "b", before.alias("before_cost"), (inner - between).alias("inside"), s.alias("s"))
    row = rows(blocks).join(sizes.select(F.col("rep").alias("nbr"), F.col("size").alias("sn")), "nbr")
    ends = head.select(F.explode(F.array("a", "b")).alias("rep"), "s").distinct()
    own = ends.join(row, "rep").groupBy("rep", "s").agg(F.sum(block_cost(F.col("s"), F.col("sn"), F.col("edges"))).alias("own"))
    joint = pairs.select("a", "b", "joint").distinct() if "joint" in pairs.columns else joint_costs(head, row)
    at = lambda k: own.select(F.col("rep").alias(k), "s", F.col("own").alias(f"o{k}"))
    x = head.join(at("a"), ["a", "s"], "left").join(at("b"), ["b", "s"], "left").join(joint, ["a", "b"], "left")
    after = sum((F.coalesce(c, F.lit(0)) for c in ("oa", "ob", "joint")), F.col("inside"))
    return x.select("a", "b", (F.col("before_cost") - after).cast("long").alias("gain"), F.col("before_cost").cast("long").alias("before_cost"))


def legacy_gain(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The older objective: self entries count arcs, and the block between a and b counts on both sides before the merge."""
    p = pairs.select("a", "b").distinct()
    size = lambda k, s: sizes.select(F.col("rep").alias(k), F.col("size").alias(s))
    m = _merged_rows(p, arc_rows(blocks)).join(size("x", "sx"), "x").join(size("a", "sa"), "a").join(size("b", "sb"), "b")
    x, a, b, s = F.col("x"), F.col("a"), F.col("b"), F.col("sa") + F.col("sb")
    before = block_cost(F.col("sa"), F.col("sx"), F.col("ea"), x == a) + block_cost(F.col("sb"), F.col("sx"), F.col("eb"), x == b)
    inside = (x == a) | (x == b)
    after = block_cost(s, F.when(inside, s).otherwise(F.col("sx")), F.col("ea") + F.col("eb"), inside)
    got = m.groupBy("a", "b").agg(F.sum(before - after).alias("gain"), F.sum(before).alias("before_cost"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return p.join(got, ["a", "b"], "left").select("a", "b", zero("gain"), zero("before_cost"))


def what_if(edges: DataFrame, partition: DataFrame, pairs: DataFrame) -> DataFrame:
    """exact_gain() straight from edges and labels, without engine state."""
    return exact_gain(pairs, quotient(edges, partition), supernode_sizes(partition))
