"""Best-fit packing by minimum bin slack.

Every text is tokenised once; texts longer than the capacity are cut into full pieces and one rest. Packing
needs only the number of pieces of each length, at most ``capacity`` numbers, so the driver plans on that histogram: the
longest remaining piece opens a bin, a bitset subset-sum dynamic program over the lengths still available
finds the fullest feasible filling, and that combination is removed as many times as the counts allow. The plan (patterns with
multiplicities) is bounded by the capacity, not by the corpus. Pieces then find their place by their rank among pieces of equal length;
ranks are taken in salted sub-groups, so no length is ever gathered in one task.

Defined cases: null text is empty; an empty text is one piece that holds the end token; repeated rows are packed each; an
empty table gives an empty result; doc_id may be null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphfold.llm.common import materialise, table
from graphfold.llm.word_tokenizer import WordTokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies per bin}), minimum bin slack on a histogram of lengths."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("lengths must be in 1..capacity")
    lengths = sorted(left, reverse=True)
    out = []
    top = 0
    while True:
        while top < len(lengths) and not left[lengths[top]]:
            top += 1
        if top == len(lengths):
            return out
        seed = lengths[top]
        room = capacity - seed
        use = {seed: 1}
        reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
        steps: list[tuple[int, int, int]] = []
        for n in lengths[top:]:
            if reach & goal:
                break
            most = min(left[n] - (n == seed), room // n) if n <= room else 0
            k = 1
            while most > 0 and not reach & goal:
                k = min(k, most)
                grown = (reach | reach << (n * k)) & mask
                if grown != reach:
                    steps.append((n, k, reach))
                    reach = grown
                most -= k
                k *= 2
        at = reach.bit_length() - 1
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                use[n] = use.get(n, 0) + k
                at -= n * k
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= times * k
        out.append((times, use))


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, copies per bin, offset of the first copy, first sequence of each pattern that uses it."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, use in patterns:
        offset = 0
        for n, k in sorted(use.items(), reverse=True):
            rows.setdefault(n, []).append((used.get(n, 0), k, offset, sequence))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def cut(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids_crc32) of every whole text."""

    def run(batches):
        tok = WordTokenizer.get(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), tok.encode(b.column("text").cast(pa.binary()).to_pylist()), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((d, i, i * capacity, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64", "piece": "int32"}), preserve_index=False)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_rank: int = 2_000) -> DataFrame:
    """Add sequence_id and offset to a *materialised* table of pieces; any further columns stay. A column that is named like one of the plan's raises ValueError."""
    spark = pieces.sparkSession
    clash = {"sequence_id", "offset", "_salt", "_n", "_r", "_base", "_rank"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    by_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = {r["length"]: r["count"] for r in by_length}
    table_ = spark.sparkContext.broadcast(slots(plan(counts, capacity)))  # bounded by the capacity
    salts = max(1, sum(counts.values()) // rows_per_rank)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    sub = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    base = sub.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("_r", rank).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_base")).drop("_salt", "_r", "_base")
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        where = table_.value
        for b in batches:
            if not b.num_rows:
                continue
            n, r = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for v in np.unique(n):
                m = n == v
                first, copies, offset, sequence = where[int(v)]
                at = np.searchsorted(first, r[m], side="right") - 1
                k = r[m] - first[at]
                seq[m], off[m] = sequence[at] + k // copies[at], offset[at] + k % copies[at] * v
            cols = {c: b.column(c) for c in out.names[:-2]}
            yield pa.RecordBatch.from_pydict({**cols, "sequence_id": seq, "offset": off})

    return ranked.select(*out.names[:-2], "_rank").mapInArrow(place, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096) -> DataFrame:
    return pack(materialise(cut(docs, vocabulary, capacity), "pieces"), capacity)
