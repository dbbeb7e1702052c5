"""Word shingles, MinHash sketches and the exact check that near-duplicate operators share.

A supercluster is a set of texts that candidate search could not tell apart. It holds every similar
pair among its members, so pairs are verified inside it: texts travel once to their supercluster, which is cut into blocks of
bounded size; each pair of blocks is one group, and a group returns links per text and local classes, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.llm.common import components, materialise

_C = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word -> 64-bit hash, kept while small."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 250_000:
            self.clear()
        self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multiplications)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], known: WordHash, size: int = 5) -> np.ndarray:
    """One hash per window of ``size`` words; a shorter text is one shingle of all its words; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    return roll(np.fromiter(map(known.__getitem__, words), np.uint64, n), min(size, n))


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """One hash per window of ``k`` of the words' hashes."""
    n = len(h)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * _C + h[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def shingles(text: bytes | None, known: WordHash, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes((text or b"").split(), known, size))


class MinHash:
    """``t`` coordinates of 32 bits, the same for every process."""

    def __init__(self, t: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, t, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(s), 512):
            part = ((s[at : at + 512, None] * self.a + self.b) >> np.uint64(32)).min(0)
            low = part if low is None else np.minimum(low, part)
        return low.astype(np.uint32)


def local_classes(adjacent: np.ndarray) -> np.ndarray:
    """Least member index of every member's component."""
    label = np.arange(len(adjacent), dtype=np.int32)
    while True:
        new = np.minimum(np.where(adjacent, label[None, :], np.int32(len(label))).min(1), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(batches, key: list[str]):
    """Whole groups of a stream that is sorted by ``key``, as lists of (frame, first rows of its groups)."""
    rest = None
    for b in batches:
        f = b.to_pandas()
        if rest is not None and len(rest):
            f = pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        k = f[key].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if not len(cut):
            rest = f
            continue
        yield f.iloc[: cut[-1]], np.concatenate([[0], cut])
        rest = f.iloc[cut[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def similar_matrix(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Exact Jaccard >= threshold for all pairs of a bounded group."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n <= 6:
        inter = np.zeros((n, n), np.float32)
        for i in range(n):
            for j in range(i):
                lo, hi = sorted((len(sets[i]), len(sets[j])))
                if lo >= threshold * hi:
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        who = np.repeat(np.arange(n), size)
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        col = (np.cumsum(shared) - 1)[inverse]
        use = shared[inverse]
        who, col = who[use], col[use]
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        acc = np.zeros((n, n), np.float32)
        total, step = int(shared.sum()), 4096
        for at in range(0, total, step):
            lo, hi = np.searchsorted(col, (at, at + step))
            m = np.zeros((n, min(step, total - at)), np.float32)
            m[who[lo:hi], col[lo:hi] - at] = 1
            acc += m @ m.T
        inter = acc
    # whole numbers below 2**24, which float32 holds exactly; they are compared in float64, row by row
    out = np.stack([(x > 0) & (x >= threshold * (s + size - x) - 1e-9) for x, s in zip(map(np.float64, inter), size, strict=True)])
    np.fill_diagonal(out, False)
    return out


def bands(threshold: float) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Upper edges of bands of Jaccard distance to a leader, and the ordered band pairs whose members are all similar, and that must be compared.

    The distance is a metric: two texts at distances p and q from a leader are at most p + q and at least |p - q| apart. The pairs in neither list hold no similar texts.
    """
    reach = 1 - threshold
    edges = np.array([x for x in (0, reach / 4, reach / 2, 3 * reach / 4, reach, 2 * reach, 3.5 * reach) if x < 1] + [1.0])
    low = np.concatenate([[0.0], edges[:-1]])
    pairs = [(i, j) for i in range(len(edges)) for j in range(len(edges))]
    sure = [(i, j) for i, j in pairs if edges[i] + edges[j] <= reach + 1e-12]
    apart = {(i, j) for i, j in pairs if low[max(i, j)] - edges[min(i, j)] >= reach - 1e-12}
    return edges, sure, [p for p in pairs if p not in sure and p not in apart]


def _by_leader(units: DataFrame, clusters: DataFrame, n: DataFrame, threshold: float, size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Superclusters of more than ``block`` texts: (id, cluster, own, o) with the blocks that a text must be compared with, and
    (id, class, links) of the links that its band alone proves, by the members' distances to the supercluster's least id."""
    edges, sure, compare = bands(threshold)
    leaders = materialise(units.join(n.where(F.col("n") > block).select(F.col("leader").alias("id"), "cluster"), "id").select("cluster", F.col("id").alias("leader"), F.col("text").alias("leader_text")), "leaders")
    members = units.join(clusters, "id").join(leaders, "cluster")

    def run(batches):
        known, last, lead = WordHash(), None, None
        for b in batches:
            got = []
            for c, t, l in zip(b.column("cluster").to_pylist(), b.column("text").to_pylist(), b.column("leader_text").to_pylist(), strict=True):
                if c != last:
                    last, lead = c, shingles(l, known, size)
                own = shingles(t, known, size)
                shared = len(np.intersect1d(own, lead, assume_unique=True))
                got.append(1 - shared / max(1, len(own) + len(lead) - shared))
            yield pa.RecordBatch.from_pydict({**{k: b.column(k) for k in ("id", "copies", "cluster", "leader")}, "band": pa.array(np.searchsorted(edges, np.array(got) - 1e-12), pa.int32())})

    placed = materialise(members.select("id", F.col("copies").cast("long").alias("copies"), "cluster", "leader", "text", "leader_text").mapInArrow(run, f"id {dict(units.dtypes)['id']}, copies long, cluster {dict(clusters.dtypes)['cluster']}, leader {dict(units.dtypes)['id']}, band int"), "bands")
    # one row for each band of a supercluster
    count = materialise(placed.groupBy("cluster", "band").agg(F.count("*").alias("n"), F.sum("copies").alias("c")).withColumn("nb", F.ceil(F.col("n") / block).cast("long")), "bands")
    other = count.select("cluster", F.col("band").alias("band2"), F.col("nb").alias("nb2"), F.col("c").alias("c2"))
    pair = lambda these: F.array(*(F.lit(i * len(edges) + j) for i, j in these))
    met = count.select("cluster", "band", "nb").join(other, "cluster").withColumn("p", F.col("band") * len(edges) + F.col("band2"))
    name = lambda band, k: F.shiftleft(F.col(band).cast("long"), 40) + k
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb2") - 1), lambda k: name("band2", k))
    band = met.groupBy("cluster", "band").agg(
        F.first("nb").alias("nb"),
        F.flatten(F.collect_list(F.when(F.array_contains(pair(compare), F.col("p")), blocks))).alias("o"),
        F.coalesce(F.sum(F.when(F.array_contains(pair(sure), F.col("p")), F.col("c2"))), F.lit(0)).alias("c"),
        F.max(F.array_contains(pair(sure), F.col("p")) & (F.col("band") == F.col("band2"))).alias("self"),
    )
    rows = placed.join(materialise(band, "bands"), ["cluster", "band"])
    proved = rows.select("id", F.col("leader").alias("class"), (F.col("c") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("links")).where("links > 0")
    return rows.select("id", "cluster", name("band", F.pmod(F.xxhash64("id"), F.col("nb"))).alias("own"), "o"), proved


def exact_classes(units: DataFrame, clusters: DataFrame, threshold: float = 0.8, size: int = 5, block: int = 300) -> DataFrame:
    """Verify inside superclusters.

    ``units(id, copies, text)``: distinct texts; ``clusters(id, cluster)``: superclusters of two texts or more (a text in none
    has no links). Returns (id, class, links): the least id of the text's class, and the copies of other texts that are similar. Only texts
    with a link are returned.
    """
    # written once: up to three plans read the texts, and of all units only those in a supercluster
    units = materialise(units.withColumn("text", F.col("text").cast("binary")).join(clusters.select("id"), "id", "left_semi"), "members")
    n = materialise(clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("leader")), "sizes")
    sized = clusters.join(n.where(F.col("n") <= block), "cluster").select("id", "cluster", F.lit(0).cast("long").alias("own"), F.array(F.lit(0).cast("long")).alias("o"), F.lit(True).alias("whole"))
    proved = None
    if not n.where(F.col("n") > block).isEmpty():
        compared, proved = _by_leader(units, clusters, n, threshold, size, block)
        sized = sized.unionByName(compared.withColumn("whole", F.lit(False)))
    placed = units.join(sized, "id").select("id", "copies", "text", "cluster", "whole", "own", F.explode("o").alias("o"))
    keyed = placed.select("id", "copies", "text", "whole", "own", F.xxhash64("cluster", F.least("own", "o"), F.greatest("own", "o")).alias("g"), (F.col("own") == F.col("o")).alias("diagonal"))

    def run(batches):
        known = WordHash()
        for f, cuts in groups(batches, ["g"]):
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = f.iloc[a:b]
                if len(part) < 2:
                    continue
                ids, copies, own = part["id"].to_numpy(), part["copies"].to_numpy(), part["own"].to_numpy()
                sets = [shingles(t, known, size) for t in part["text"]]
                near = similar_matrix(sets, threshold)
                if not part["diagonal"].all():
                    near &= own[:, None] != own[None, :]  # links inside a block belong to the block's own group, or are proved
                label = local_classes(near)
                links = (near * copies[None, :]).sum(1)
                linked = near.any(1)
                least = np.full(len(part), ids.max())
                np.minimum.at(least, label, ids)
                out.append(pd.DataFrame({"id": ids, "class": least[label], "links": links, "alone": part["whole"].to_numpy()})[linked])
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)

    schema = "id long, class long, links long, alone boolean"
    got = materialise(keyed.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema), "verified")
    alone = got.where("alone").select("id", "class", "links")
    if proved is None:
        return alone
    across = materialise(got.where("not alone").select("id", "class", "links").unionByName(proved), "verified")
    joined = components(across.select(F.col("id").alias("a"), F.col("class").alias("b")))
    links = across.groupBy("id").agg(F.sum("links").alias("links"))
    return alone.unionByName(links.join(joined, links["id"] == joined["node"]).select("id", F.col("component").alias("class"), "links"))
