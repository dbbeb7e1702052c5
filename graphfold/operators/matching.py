"""Filters on scored pairs and node-disjoint selection.

Scored pairs: (group, a_idx, b_idx, a, b, gain, before_cost). The order inside a group is gain descending, a_idx, b_idx.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfold.checkpoint import materialise


def threshold_filter(scored: DataFrame, theta: float | None = None) -> DataFrame:
    """Positive gains; with a threshold, savings of at least ``theta`` of a positive cost."""
    keep = F.col("gain") > 0
    if theta is not None:
        keep &= (F.col("before_cost") > 0) & (F.col("gain") / F.col("before_cost") >= F.lit(theta))
    return scored.where(keep)


def saving_samples(scored: DataFrame, limit: int = 4096) -> list[float]:
    """Positive savings of tested pairs: all of them up to ``limit``, else those with the least hash."""
    s = scored.where("before_cost > 0 and gain > 0").select((F.col("gain") / F.col("before_cost")).alias("r"), F.xxhash64("a", "b").alias("h"))
    return [r.r for r in s.orderBy("h").limit(limit).collect()]


def lower_quantile(scored: DataFrame, q: float) -> DataFrame:
    """One row: element floor(q (n-1)) of the ordered positive savings. For bounded samples."""
    s = scored.where("before_cost > 0 and gain > 0").agg(F.sort_array(F.collect_list(F.col("gain") / F.col("before_cost"))).alias("s"))
    return s.select(F.get("s", F.floor(F.lit(q) * (F.size("s") - 1)).cast("int")).alias("quantile"))  # null without positive savings


def _rank() -> Column:
    return F.struct((-F.col("gain")).alias("g"), "a_idx", "b_idx", "a", "b")


def best_partners(scored: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Pairs that are the best of both of their ends."""
    within = ["group"] if within is None else within
    ends = scored.withColumn("_o", _rank()).withColumn("end", F.explode(F.array("a", "b")))
    best = ends.groupBy(*within, "end").agg(F.min("_o").alias("_o"))
    twice = best.groupBy(*within, F.col("_o.a").alias("a"), F.col("_o.b").alias("b")).count().where("count = 2")
    return scored.join(twice.drop("count"), [*within, "a", "b"], "left_semi")


def locally_dominant(scored: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Greedy matching by rounds: take pairs that are best at both ends, remove what they touch, repeat. The order is total, so this is the greedy
    result, with or without taking mutual best pairs first; it also works across groups (``within=[]``), however large."""
    within = ["group"] if within is None else within
    live, taken = materialise(scored, "pairs"), []
    while not live.isEmpty():
        now = materialise(best_partners(live, within), "taken")
        taken.append(now)
        used = now.select(*within, F.explode(F.array("a", "b")).alias("n")).distinct()
        key = lambda c: used.withColumnRenamed("n", c)
        live = materialise(live.join(key("a"), [*within, "a"], "left_anti").join(key("b"), [*within, "b"], "left_anti"), "pairs")
    out = scored.limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def greedy(scored: DataFrame) -> DataFrame:
    """Greedy matching of every group in one shuffle: a group streams by in order, and only its used nodes are kept."""
    cols = scored.columns

    def run(frames):
        group, used = None, set()
        for f in frames:
            keep = []
            for g, a, b in zip(f["group"], f["a"], f["b"], strict=True):
                if g != group:
                    group, used = g, set()
                fresh = a not in used and b not in used
                keep.append(fresh)
                if fresh:
                    used.update((a, b))
            yield f[pd.Series(keep, index=f.index, dtype=bool)]

    return scored.repartition("group").sortWithinPartitions("group", F.desc("gain"), "a_idx", "b_idx").select(*cols).mapInPandas(run, scored.schema)


def to_merges(selected: DataFrame) -> DataFrame:
    """(keep, remove, gain): the end with the smaller index stays."""
    first = F.col("a_idx") <= F.col("b_idx")
    return selected.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("remove"), "gain")
