"""Helpers that the training-data operators share: tables, checkpoints, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphfold.checkpoint import discard, materialise, scratch_dir  # noqa: F401

#: Words of the contracts: runs of anything but ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Sieve:
    """Tells which 64-bit hashes may be among given ones: two bits of a bitmap each. It lets all of these pass and few others, so an exact join comes after it."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap, self.low = bitmap, np.int64(8 * len(bitmap) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b = x & self.low, x >> np.int64(32) & self.low
        return (self.bitmap[a >> 3] >> (a & 7).astype(np.uint8) & self.bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def sieve(ids: DataFrame, column: str, most_bits: int = 1 << 27) -> Broadcast:
    """A Sieve of a materialised column of 64-bit hashes: 16 to 32 bits for each, ``most_bits`` in all (a fuller one lets more pass, and loses none)."""
    spark = ids.sparkSession
    bits = min(most_bits, max(1 << 18, 1 << (16 * ids.count()).bit_length()))
    place = F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftright(column, 32).bitwiseAND(bits - 1)))
    parts = ids.select(place.alias("x")).select(F.shiftright("x", 12).alias("part"), F.col("x").bitwiseAND(4095).alias("bit"))
    bitmap = np.zeros(bits // 8, np.uint8)
    # one job: an iterator would run one for each partition, and these one after another
    for r in parts.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("b")).select("part", F.substring("b", 1, 512).alias("b")).collect():
        bitmap[512 * r.part : 512 * (r.part + 1)] = np.frombuffer(r.b, np.uint8)
    return spark.sparkContext.broadcast(Sieve(bitmap))


def sieved(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be in the materialised ``ids``: what a join on it would drop is not shuffled."""
    passes = sieve(ids, column)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(passes.value(b.column(column).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _settle(edges: DataFrame) -> DataFrame:
    """(node, component) of the few ``edges(a, b)`` of one task."""

    def run(batches):
        got = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not got:
            return
        ends = [np.concatenate(x) for x in zip(*got, strict=True)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = at[: len(ends[0])], at[len(ends[0]) :]
        label = np.arange(len(nodes))
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[label], kind)], ["node", "component"])

    kind = to_arrow_type(edges.schema["a"].dataType)
    name = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {name}, component {name}")


def components(edges: DataFrame, max_rounds: int = 40, few: int = 1 << 16) -> DataFrame:
    """Connected components of ``edges(a, b)`` (any orientable type) as ``(node, component)``; component is the least node.

    Alternating large-star and small-star rounds, each written to the shared folder, so the
    work per round is linear in the edges and a hub costs one aggregated minimum plus a join that
    AQE may split. Ends when nothing but stars is left: every node with a lesser neighbour has no other neighbour. No more
    than ``few`` edges (1 MB of numbers) are settled by one task, at the start or after a round: a round costs five shuffles, however little
    they hold. Isolated nodes are not returned; self edges are ignored.
    """
    cur = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    n = cur.count()
    for _ in range(max_rounds):
        if n <= few:
            return materialise(_settle(cur), "cc")
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined: a hub is then one row on one side, and the join can split its rows on the other
        tangled, edges_left = Observation(), Observation()
        met = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("less"), F.count("*").alias("n"))
        low = materialise(met.observe(tangled, F.count_if((F.col("less") > 0) & (F.col("n") > 1)).alias("n")).select("a", F.least("a", "m").alias("m")), "cc")
        if not tangled.get["n"]:
            discard(low)
            break
        # one row for each edge of cur, so no need for distinct()
        big = materialise(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "cc")
        least = materialise(big.groupBy("a").agg(F.min("b").alias("m")), "cc")
        small = big.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = materialise(small.observe(edges_left, F.count(F.lit(1)).alias("n")), "cc")
        discard(big, cur, low, least)
        cur, n = new, edges_left.get["n"]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
