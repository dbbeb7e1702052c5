"""Golden values of costs, hashes and thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from graphfold.functions import hashing as H
from graphfold.functions.cost import block_cost, capacity, checked_block_cost, log2_floor, safe_ratio
from graphfold.functions.thresholds import ThresholdState, geometric, lower_quantile, reciprocal


def test_mixer_and_ranks_match_golden_vectors(spark):
    assert H.splitmix64(0) == 16294208416658607535 and H.splitmix64(1) == 10451216379200822465
    assert H.dim_rank(0, 1, 1) == 14432292093571011715
    assert H.dim_order(16, 1, 1) == [9, 8, 4, 11, 6, 12, 10, 5, 15, 2, 7, 14, 13, 1, 0, 3]
    assert H.partition_hash([0, 1, 2, 3]) == 2932290448510678823 and H.partition_hash([0, 1, 0, 1]) == 2930379497301226555
    two = spark.createDataFrame([(0,), (5,)], "id long")
    ranks = H.fallback_rank(H.hash_rank(H.hash_rank(two, "id", "a", 0, 1, 1), "id", "b", 3, 2, 1), "id", "c", 1, 1)
    got = {r.id: r for r in ranks.collect()}
    assert [got[0].a & H.MASK, got[5].b & H.MASK, got[0].c & H.MASK] == [3735029863289203146, 14181888046786011921, 10348703185552901534]
    assert ranks.columns == ["id", "a", "b", "c"]


def test_mixer_on_random_numbers(spark):
    random.seed(3)
    xs = [0, -1, 1, 2**63 - 1, -(2**63), *(random.randrange(-(2**63), 2**63) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", F.col("x").alias("h"), H.unsigned_order(F.col("x")).alias("o"))
    got = H.splitmix(df, "h").collect()
    assert all(r.h & H.MASK == H.splitmix64(r.x & H.MASK) for r in got)
    assert [r.x & H.MASK for r in sorted(got, key=lambda r: r.o)] == sorted(x & H.MASK for x in xs)


def test_block_costs(spark):
    df = spark.createDataFrame([(3, 3, 3, True), (4, 4, 5, True), (2, 3, 1, False), (2, 2, 4, False)], "sa long, sb long, e long, i boolean")
    assert [r[0] for r in df.select(block_cost(F.col("sa"), F.col("sb"), F.col("e"), F.col("i"))).collect()] == [1, 2, 1, 1]
    assert [r[0] for r in df.select(capacity(F.col("sa"), F.col("sb"), F.col("i"))).collect()] == [3, 6, 6, 4]
    with pytest.raises(Exception, match="exceeds block capacity"):
        df.select(checked_block_cost(F.col("sa"), F.col("sb"), F.col("e") + 9, F.col("i"))).collect()
    logs = spark.createDataFrame([(0,), (1,), (7,), (8,), (2**52,), (-3,)], "x long").select(log2_floor(F.col("x"))).collect()
    assert [r[0] for r in logs] == [0, 0, 2, 3, 52, 0]
    assert spark.range(1).select(safe_ratio(F.lit(1.0), F.lit(0.0)), safe_ratio(F.lit(1.0), F.lit(2.0))).first()[:] == (0.0, 0.5)


def test_thresholds():
    assert [reciprocal(t) for t in (1, 2, 3)] == [1 / 2, 1 / 3, 1 / 4]
    assert [round(geometric(t, 20, 0.5, 0.005), 6) for t in (1, 2, 10, 20)] == [0.5, 0.39238, 0.056442, 0.005]
    assert lower_quantile([4, 1, 3, 2], 0.85) == 3
    s = ThresholdState("adaptive")
    assert s.at(1, 20) == 0.5
    s.end([0.1, 0.2, 0.3], 100, 1)
    assert s.scale == 0.85 and s.at(2, 20) == pytest.approx(0.2 * 0.85)
    s.end([], 10, 9)
    assert s.scale == pytest.approx(0.85 * 1.05)
