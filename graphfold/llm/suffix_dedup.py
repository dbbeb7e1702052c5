"""Suffix-array dedup by prefix-free parsing: remove every byte covered by a 200-byte string that starts twice or more.

Triggers are local minima of a rolling hash over 64 bytes: among the 137 such strings of a 200-byte window the one with the least hash
(the first of equals) is the window's trigger, so equal windows have their trigger at the same place, phrases are bounded, and a trigger's
place depends on content alone. A phrase is the stretch of all windows of one trigger; phrases overlap as prefix-free
parsing demands. The parse of a text is its phrases in order, the dictionary the distinct phrases, known by a 128-bit hash.

A phrase that occurs twice is repeated as a whole. What remains are phrases that share a trigger string but differ around it. These are put
into two suffix orders: that of the dictionary (trigger string, then the bytes before it, read backwards) and that of the parse (trigger string,
then the bytes after it). Both are sorted by range over the whole corpus, so a trigger string or a context of any frequency is spread over tasks, and each row's
common prefix with its neighbours in the order says how far any other phrase agrees with it: l bytes to the left, r to the right. A window that reaches t bytes
to the left and 136 - t to the right of the trigger can be repeated only if t <= l and 136 - t <= r, so combining both orders leaves one interval of
windows per phrase, empty for most. For two phrases it is exact; with more, the partner to the left may not be the one to the right, and the windows of the interval
are compared by a 128-bit name, with partial counts. All steps yield rows in
proportion to the phrases' lengths, whatever the size of a group.

Texts are deduplicated first by a 128-bit key (a copied text is removed as a whole), into a table that is bucketed by text, so that later joins move
no text. Defined cases: null text is empty; texts shorter than 200 bytes lose nothing; repeated rows are copies; texts of any length are parsed in
stretches that overlap by a window; an empty table gives an empty result; doc_id may be null; only doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import discard, materialise, scratch_dir, table
from graphfold.llm.jaccard import mix

PHRASE = "core long, f1 long, f2 long, k binary, pos long, starts int, left int"


class Trigger:
    """Rolling hash of ``gram`` bytes by prefix sums modulo 2**64, and its minimum in every window."""

    def __init__(self, length: int = 200, gram: int = 64, stretch: int = 1 << 18):
        self.length, self.gram, self.stretch = length, gram, stretch
        rng = np.random.default_rng(11)
        self.letter = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        n = stretch + length
        base = 0x9E3779B97F4A7C15
        self.power = np.full(n, base, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power)
        self.inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        self.inverse = np.cumprod(self.inverse)

    def phrases(self, text: bytes):
        """(first start, number of starts, trigger) of every phrase; positions in the text."""
        for base in range(0, len(text) - self.length + 1, self.stretch):
            part = np.frombuffer(text, np.uint8)[base : base + self.stretch + self.length - 1]
            n, w = len(part), self.gram
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(self.letter[part] * self.power[:n], out=h[1:])
            key = mix((h[w:] - h[:-w]) * self.inverse[: n - w + 1])
            low = np.uint64((1 << 20) - 1)
            key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
            span, want = 1, self.length - w + 1
            while span * 2 <= want:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < want:
                key = np.minimum(key[: len(key) - (want - span)], key[want - span :])
            at = (key & low).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            count = np.diff(np.append(first, len(at)))
            yield from zip((first + base).tolist(), count.tolist(), (at[first] + base).tolist(), strict=True)


def text_key(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """(k, text, copies), a table bucketed by k in the shared folder, and its name in the catalog."""
    spark = docs.sparkSession
    one = docs.select(text_key(F.col("text")).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"graphfold_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one.write.bucketBy(n, "k").option("path", f"{scratch_dir(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name), name


def parse(texts: DataFrame, length: int = 200, gram: int = 64, stretch: int = 1 << 18) -> DataFrame:
    """All phrases: trigger string, 128-bit name, and where they stand."""

    def run(batches):
        trigger = Trigger(length, gram, stretch)
        for b in batches:
            core, name, k, pos, starts, left = [], [], [], [], [], []
            for key, t in zip(b.column("k").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if len(t) < length:
                    continue
                for s, n, a in trigger.phrases(t):
                    core.append(xxhash.xxh3_64_intdigest(t[a : a + gram]))
                    name.append(xxhash.xxh3_128_digest(t[s : s + n - 1 + length]))
                    k.append(key), pos.append(s), starts.append(n), left.append(a - s)
                if len(core) > 50_000:
                    yield _phrases(core, name, k, pos, starts, left)
                    core, name, k, pos, starts, left = [], [], [], [], [], []
            yield _phrases(core, name, k, pos, starts, left)

    return texts.select("k", "text").mapInArrow(run, PHRASE)


def _phrases(core: list, name: list, k: list, pos: list, starts: list, left: list) -> pa.RecordBatch:
    f = np.frombuffer(b"".join(name), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"core": np.array(core, np.uint64).view(np.int64), "f1": f[:, 0].copy(), "f2": f[:, 1].copy(), "k": pa.array(k, pa.binary()), "pos": np.array(pos, np.int64), "starts": np.array(starts, np.int32), "left": np.array(left, np.int32)})


def common_prefix(core: list[int], context: list[bytes], reach: int) -> np.ndarray:
    """Bytes that each row has in common with the next one; -1 if their trigger strings differ."""
    rows = np.frombuffer(b"".join(c.ljust(reach, b"\0") for c in context), np.uint8).reshape(len(core), max(reach, 1))
    size, own = np.array([len(c) for c in context], np.int64), np.array(core, np.int64)
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), reach)
    return np.where(own[1:] == own[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), -1)


def agreement(contexts: DataFrame, reach: int) -> DataFrame:
    """(id, far): the longest prefix that another row of the same trigger string shares, or -1, for rows (id, core, context).

    The rows are sorted by range, ties by id, so equal contexts may fill many tasks. A row's best partner stands next to it; neighbours in two tasks are
    compared on the driver, which gets the first and the last row of every task and nothing else.
    """

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True

        def rows(ids, far, edges, places):
            return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "far": pa.array(far, pa.int32()), "part": pa.array([part] * len(ids), pa.int32()), "place": pa.array(places, pa.int32()), "core": pa.array([e and e[0] for e in edges], pa.int64()), "context": pa.array([e and e[1] for e in edges], pa.binary())})

        for b in batches:
            ids, core, context = (b.column(c).to_pylist() for c in ("id", "core", "context"))
            if not ids:
                continue
            before = -1
            if held:
                ids, core, context, before = [held[0], *ids], [held[1], *core], [held[2], *context], held[3]
            near = common_prefix(core, context, reach)
            both = np.concatenate([[before], near])
            if len(ids) > 1:
                far, edges, places = np.maximum(both[:-1], near), [None] * (len(ids) - 1), [None] * (len(ids) - 1)
                if first:
                    edges[0], places[0], first = (core[0], context[0]), 0, False
                yield rows(ids[:-1], far, edges, places)
            held = ids[-1], core[-1], context[-1], int(both[-1])
        if held:
            yield rows([held[0]], [held[3]], [(held[1], held[2])], [0 if first else 1])

    ordered = contexts.repartitionByRange("core", "context", "id").sortWithinPartitions("core", "context", "id")
    got = materialise(ordered.mapInArrow(run, "id long, far int, part int, place int, core long, context binary"), "order")
    ends = sorted(got.where("place is not null").collect(), key=lambda r: (r.part, r.place))  # two rows a task at most
    fixes = []
    for x, y in zip(ends, ends[1:], strict=False):
        if x.part != y.part and x.core == y.core:
            n = int(common_prefix([x.core, y.core], [bytes(x.context), bytes(y.context)], reach)[0])
            fixes += [(x.id, n), (y.id, n)]
    plain = got.select("id", "far")
    return plain.unionByName(got.sparkSession.createDataFrame(fixes, "id long, far int")) if fixes else plain


def covered(texts: DataFrame, length: int = 200, gram: int = 64, stretch: int = 1 << 18) -> tuple[DataFrame, list[DataFrame]]:
    """(k, start, end): stretches of bytes that repeated windows cover, apart from copies of whole texts; and the tables that hold the steps."""
    reach = length - gram
    # counts are written before they meet the phrases, so that the join can split a frequent trigger string
    often = materialise(parse(texts, length, gram, stretch).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "often")
    seen = materialise(parse(texts, length, gram, stretch).join(often, "core", "left_semi"), "phrases")
    names = materialise(seen.groupBy("core", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos", "starts", "left")).alias("at")), "dictionary")
    twice = materialise(names.where("n > 1").select("core", "f1", "f2"), "twice")
    whole = seen.join(twice, ["f1", "f2", "core"], "left_semi").select("k", F.col("pos").alias("start"), (F.col("pos") + F.col("starts") + length - 1).alias("end"))
    kinds = materialise(names.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    lists = names.join(kinds, "core").select("core", "n", "kinds", "at.*").groupBy("k").agg(F.collect_list(F.struct("core", "n", "kinds", "pos", "starts", "left")).alias("p"))

    def cut(batches):
        for b in batches:
            rows = []
            for k, t, ps in zip(b.column("k").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("p").to_pylist(), strict=True):
                for p in ps:
                    a, end = p["pos"] + p["left"], p["pos"] + p["starts"] - 1 + length
                    rows.append((p["core"], p["n"] == 1, p["kinds"] == 2, k, a, t[p["pos"] : a][::-1], t[a : a + gram], t[a + gram : end]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["core", "once", "pair", "k", "at", "back", "trigger", "ahead"])

    mixed = texts.select("k", "text").join(lists, "k").select("k", "text", "p").mapInArrow(cut, "core long, once boolean, pair boolean, k binary, at long, back binary, trigger binary, ahead binary")
    mixed = materialise(mixed.withColumn("id", F.monotonically_increasing_id()), "mixed")
    left = agreement(mixed.select("id", "core", F.col("back").alias("context")), reach)
    right = agreement(mixed.select("id", "core", F.col("ahead").alias("context")), reach)
    none = F.lit(-1)
    both = left.select("id", F.col("far").alias("l"), none.alias("r")).unionByName(right.select("id", none.alias("l"), F.col("far").alias("r")))
    interval = both.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r")).where(F.col("l") + F.col("r") >= reach).where("l >= 0 and r >= 0")

    def windows(batches):
        for b in batches:
            for once, k, at, back, trigger, ahead, l, r in zip(*(b.column(c).to_pylist() for c in ("once", "k", "at", "back", "trigger", "ahead", "l", "r")), strict=True):
                t, p = back[::-1] + trigger + ahead, at - len(back)
                first, last = len(back) - l, len(back) - (reach - r)
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[i : i + length]) for i in range(first, last + 1)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"w1": d[:, 0].copy(), "w2": d[:, 1].copy(), "k": pa.array([k] * len(d), pa.binary()), "start": np.arange(p + first, p + last + 1), "once": np.full(len(d), once)})

    met = mixed.join(materialise(interval, "intervals"), "id")
    # of two phrases each is the other's partner on both sides, so their intervals are exact
    pairs = met.where("pair and once").select("k", (F.col("at") - F.col("l")).alias("start"), (F.col("at") - reach + F.col("r") + length).alias("end"))
    every = materialise(met.where("not pair").select("once", "k", "at", "back", "trigger", "ahead", "l", "r").mapInArrow(windows, "w1 long, w2 long, k binary, start long, once boolean"), "windows")
    again = materialise(every.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"), "again")
    warm = every.where("once").join(again, ["w1", "w2"], "left_semi").select("k", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(pairs).unionByName(warm), [often, seen, names, twice, kinds, mixed, left, right, every, again]


def _spans(pairs: list, copies: int, n: int, length: int) -> list[tuple[int, int]]:
    if copies > 1 and n >= length:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for p in sorted((p["start"], p["end"]) for p in pairs or []):
        if out and p[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], p[1]))
        else:
            out.append(p)
    return out


def removals(docs: DataFrame, length: int = 200, gram: int = 64, stretch: int = 1 << 18) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed bytes, end exclusive)."""
    texts, name = distinct_texts(docs)
    found, steps = covered(texts, length, gram, stretch)
    lists = found.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("p"))
    rows = "k binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def run(batches):
        for b in batches:
            out = []
            for k, t, c, p in zip(b.column("k").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("copies").to_pylist(), b.column("p").to_pylist(), strict=True):
                spans = _spans(p, c, len(t), length)
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(t[at:s])
                    at = e
                kept.update(t[at:])
                out.append((k, len(t), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = materialise(texts.join(lists, "k", "left").select("k", "text", "copies", "p").mapInArrow(run, rows), "removed")
    discard(texts, *steps)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k"))
    return ids.join(done, "k").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
