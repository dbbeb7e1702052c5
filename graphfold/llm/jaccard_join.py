"""N-gram Jaccard join by chosen paths.

Distinct texts become MinHash sketches, whose coordinates stand for sampled tokens. Each run picks coordinates at the
root; texts that agree on a picked coordinate share a bucket, and a large bucket is split again on coordinates drawn from its own path.
Small buckets are brute-forced on sketches. In a large bucket every text is compared with one leader first: texts that
resemble it are tied to it and, when clearly alike, leave the bucket, so a group of thousands of near copies costs one pass
instead of all pairs. A bucket whose texts all resemble its leader can't be split and is brute-forced block by block. Runs repeat until the miss rate of a pair at the
threshold is below ``1 - recall``. The ties make superclusters, inside which jaccard.exact_classes() verifies every pair of texts exactly.

A text is known by its 64-bit hash. Defined cases: a text without words (null, empty, blank) is similar to nothing, not even to its
copies; fewer than five words make one shingle; repeated rows are copies; an empty table gives an empty result; rows with a null doc_id take part but
never name a class unless a class has no other id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import components, materialise, sieved, table
from graphfold.llm.jaccard import MinHash, WordHash, exact_classes, groups, local_classes, shingles

COORDINATES = 64


def sketch_texts(docs: DataFrame, size: int = 5) -> DataFrame:
    """(id, copies, least_doc, sketch) of every distinct text with a word; materialised."""

    def run(batches):
        known, minhash = WordHash(), MinHash(COORDINATES)
        for b in batches:
            ids, docs_, out = b.column("id").to_pylist(), b.column("doc_id").to_pylist(), []
            for i, d, t in zip(ids, docs_, b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(t, known, size)
                if len(s):
                    out.append((i, d, minhash(s).tobytes()))
            if out:
                i, d, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"id": pa.array(i, pa.int64()), "doc_id": pa.array(d, pa.int64()), "sketch": pa.array(s, pa.binary())})

    got = docs.select(F.xxhash64("text").alias("id"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, doc_id long, sketch binary")
    return materialise(got.groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_doc"), F.first("sketch").alias("sketch")), "sketches")


def _at(i) -> F.Column:
    """The 4 bytes of a coordinate (a number or a column) of ``sketch``."""
    return F.substring("sketch", 4 * i + 1, 4) if isinstance(i, int) else F.substr(F.col("sketch"), i * 4 + 1, F.lit(4))


def _agreement(rows: pd.Series, other: pd.Series) -> np.ndarray:
    a = np.frombuffer(b"".join(rows), np.uint32).reshape(-1, COORDINATES)
    b = np.frombuffer(b"".join(other), np.uint32).reshape(-1, COORDINATES)
    return (a == b).mean(1)


def _to_leader(rows: DataFrame, sure: float) -> DataFrame:
    """Rows (path, id, sketch, leader, leader_sketch) -> (path, id, leader, same, sketch): the share of coordinates that agree, and the sketch where that is below ``sure``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                same = _agreement(pd.Series(b.column("sketch").to_pylist()), pd.Series(b.column("leader_sketch").to_pylist()))
                sketch = pc.if_else(pa.array(same < sure), b.column("sketch"), pa.scalar(None, b.column("sketch").type))
                yield pa.RecordBatch.from_pydict({"path": b.column("path"), "id": b.column("id"), "leader": b.column("leader"), "same": same, "sketch": sketch})

    return rows.mapInArrow(run, "path long, id long, leader long, same double, sketch binary")


def _brute_force(rows: DataFrame, tie: float) -> DataFrame:
    """Bounded buckets (path, id, sketch) -> ties (a, b) to the least id of what a bucket holds together."""

    def run(batches):
        for f, cuts in groups(batches, ["path"]):
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = f.iloc[a:b]
                if b - a < 2:
                    continue
                ids = part["id"].to_numpy()
                s = np.frombuffer(b"".join(part["sketch"]), np.uint32).reshape(-1, COORDINATES)
                same = np.stack([(s == x).sum(1) >= tie * COORDINATES for x in s])
                label = local_classes(same)
                far = label != np.arange(len(label))
                out.append(np.stack([ids[far], ids[label[far]]]))
            if out:
                e = np.concatenate(out, 1)
                yield pa.RecordBatch.from_pydict({"a": e[0], "b": e[1]})

    return rows.repartition("path").sortWithinPartitions("path", "id").mapInArrow(run, "a long, b long")


def chosen_paths(sketches: DataFrame, threshold: float = 0.8, recall: float = 0.999999, fan: int = 2, small: int = 1024, depth: int = 4) -> DataFrame:
    """Ties (a, b) between texts that may be similar; every pair at the threshold is tied, directly or through others, with probability ``recall``.

    A bucket is brute-forced if it is small, if splitting can't take it apart because its texts resemble its leader on average, or at the
    last level; one that is not small is then cut into blocks, and every pair of blocks is compared.
    """
    hit = 1 - (1 - threshold) ** fan
    runs = min(COORDINATES // fan, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit**2))))  # most pairs need one split, two are allowed for
    picked = np.random.default_rng(7).permutation(COORDINATES)[: runs * fan].tolist()
    root = F.array(*(F.xxhash64(F.lit(c), _at(c)) for c in picked))
    level = sketches.select("id", F.explode(root).alias("path"))
    tie, sure = threshold - 0.3, threshold - 0.1
    ties, force = [], []
    for d in range(depth + 1):
        # written before the join, which can thus split the rows of a frequent bucket
        n = materialise(level.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1"), "buckets")
        if d == 0:
            level = sieved(level, n, "path")  # most texts are alone in most buckets; later levels hold few rows
        # below the root, the rows of large buckets bring their sketches along
        rows = level.join(n, "path").select("path", "id", "n", "leader", *([F.when(F.col("n") > small, F.col("sketch")).alias("sketch")] if d else []))
        rows = materialise(rows, "buckets")
        force.append(rows.where(F.col("n") <= small).select("path", "id"))
        large = rows.where(F.col("n") > small).drop("n")
        # one row for each large bucket; so few that joins with it need no shuffle
        leaders = materialise(large.where("id = leader").drop("leader"), "leaders")
        if leaders.isEmpty():
            break
        if d == 0:
            large = large.join(sketches.select("id", "sketch"), "id")
            leaders = materialise(sketches.select("id", "sketch").join(leaders, "id"), "leaders")
        split = materialise(_to_leader(large.join(leaders.select("path", F.col("sketch").alias("leader_sketch")), "path"), sure), "led")
        ties.append(split.where((F.col("same") >= tie / 2) & (F.col("id") != F.col("leader"))).select(F.col("id").alias("a"), F.col("leader").alias("b")))
        left = split.where(F.col("same") < sure).select("path", "id", "same", "sketch")
        count = materialise(left.groupBy("path").agg(F.count("*").alias("n"), F.avg("same").alias("mean")), "left")
        left = left.select("path", "id", "sketch").join(count, "path")
        alike = (F.col("n") <= small) | (F.col("mean") >= threshold - 0.4) | F.lit(d == depth)
        blocks = left.where(alike).withColumn("nb", F.ceil(F.col("n") / small).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "nb").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        force.append(blocks.select(F.xxhash64("path", F.lit("blocks"), F.least("own", "o"), F.greatest("own", "o")).alias("path"), "id"))
        coordinate = lambda j: F.pmod(F.xxhash64("path", F.lit(j)), F.lit(COORDINATES)).cast("int")
        down = F.array(*(F.xxhash64("path", F.lit(j), _at(coordinate(j))) for j in range(fan)))
        level = left.where(~alike).select("id", "sketch", F.explode(down).alias("path"))
    every = force[0]
    for f in force[1:]:
        every = every.unionByName(f)
    out = _brute_force(every.join(sketches.select("id", "sketch"), "id").select("path", "id", "sketch"), tie)
    for t in ties:
        out = out.unionByName(t)
    return out


def text_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(id, class_id, class_text, links) of every distinct text with a word. ``class_id`` is the least doc_id of the class,
    ``class_text`` the class's own number, ``links`` the other documents that are similar, copies included."""
    sketches = sketch_texts(docs, size)
    superclusters = components(chosen_paths(sketches, threshold))
    clusters = materialise(superclusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    texts = sieved(docs.select(F.xxhash64("text").alias("id"), F.col("text")), clusters, "id").join(clusters.select("id"), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    units = texts.join(sketches.select("id", "copies"), "id")
    found = exact_classes(units, clusters, threshold, size)
    # every member of a class of two texts or more has a link; any other text is a class of its own
    linked = materialise(found.join(sketches.select("id", "least_doc"), "id"), "linked")
    named = linked.join(linked.groupBy("class").agg(F.min("least_doc").alias("class_id")), "class").select("id", "class", "class_id", "links")
    every = sketches.select("id", "copies", "least_doc").join(named, "id", "left")
    return every.select("id", F.coalesce("class_id", "least_doc").alias("class_id"), F.coalesce("class", "id").alias("class_text"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))


def join_documents(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class) and n_links."""
    classes = text_classes(docs, threshold, size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("id"))
    return rows.join(classes, "id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The documents, all columns whatever their names, with one row of each class (the one with the least doc_id; of equal rows any); texts without words all stay."""
    classes = materialise(text_classes(docs, threshold, size).select("id", "class_id", "class_text"), "classes")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64("text").alias("id")).join(classes, "id", "left")
    free = rows.where("class_text is null").select("doc.*")
    named = rows.where("class_text is not null and (doc.doc_id <=> class_id)").dropDuplicates(["class_text"]).select("doc.*")
    return free.unionByName(named)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT text, min(doc_id) AS d, count(*) AS m,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS (
  SELECT d, m, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM t WHERE len(w) > 0),
e AS (SELECT d, m, len(g) AS n, unnest(g) AS x FROM s),
j AS (
  SELECT a.d AS a, b.d AS b, any_value(b.m) AS bm
  FROM e a JOIN e b ON a.x = b.x AND a.d <> b.d
  GROUP BY a.d, b.d, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
c(node, root) AS (SELECT d, d FROM s UNION SELECT j.b, c.root FROM c JOIN j ON j.a = c.node),
k AS (SELECT node, min(root) AS class_id FROM c GROUP BY node),
l AS (SELECT s.d, s.m - 1 + coalesce((SELECT sum(bm) FROM j WHERE j.a = s.d), 0) AS n_links FROM s)
SELECT o.doc_id, coalesce(k.class_id, o.doc_id) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM documents o LEFT JOIN t ON t.text = o.text AND len(t.w) > 0
LEFT JOIN k ON k.node = t.d LEFT JOIN l ON l.d = t.d
"""
