"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Words are lower-cased and stripped of surrounding punctuation. Every benchmark item gets a 64-bit SimHash of its weighted five-word
shingles. A window of a document is compared with items of its own size; its SimHash comes from prefix sums of signed weights, so moving
the window costs one subtraction. The 64 bits are cut into ``blocks`` parts; by the pigeonhole principle a fingerprint within ``radius`` of an
item agrees with it in at least one part up to ``radius // blocks`` bits, so a table of those balls per part finds every item
within the radius. Candidates are verified by exact weighted Jaccard similarity of shingle multisets (weights: inverse item frequency).

Windows that hold no shingle of any item have similarity 0 with all of them and are not formed. This is lossless: what is left are the stretches around shared shingles.

The index of the items is sent to all tasks while the benchmark has at most ``max_items`` items; beyond, the
items are dealt into parts of that size and the documents are read once for each part; a part's result is written and its index dropped before the
next one is sent, so at most one part's index is held anywhere. Item frequencies and the number of items are those of the
whole benchmark in every part, so the parts change no weight, fingerprint or result. Defined cases: null text matches nothing; an item of fewer than five words is one shingle of all its
words; an item without words is ignored; equal items are reported each; repeated rows are reported each; empty tables give an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import discard, materialise, table
from graphfold.llm.jaccard import WordHash, mix, shingle_hashes

STRIP = b".,;:!?\"'()[]{}<>|*#-_`"
MATCH = "doc_id long, item_id long, start long, n_words long, hamming int, similarity double"


class NormalHash(WordHash):
    """Hash of a word in lower case without surrounding punctuation; a word of punctuation alone stays as it is."""

    def __missing__(self, word: bytes) -> int:
        low = word.decode(errors="replace").lower().encode().strip(STRIP) or word
        h = WordHash.__missing__(self, low) if low != word else super().__missing__(word)
        self[word] = h
        return h


def simhash(sums: np.ndarray) -> np.ndarray:
    """Signs of 64 sums per row, packed into uint64."""
    return np.packbits(sums > 0, axis=-1).view(">u8").astype(np.uint64)[..., 0]


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1/-1 per bit of a remixed hash."""
    bits = np.unpackbits(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).astype(">u8")[:, None].view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def shared_weights(counts, n: int) -> tuple[dict[int, float], float]:
    """Weights of the shingles of several items by (shingle, items), and of all others: a shingle of no item weighs like one of a single item."""
    return {h: 1 + float(np.log(n / c)) for h, c in counts if c > 1}, 1 + float(np.log(max(n, 1)))


class ItemIndex:
    """Fingerprints of the items and the block tables; bounded by the number of items."""

    def __init__(self, items: list[tuple[int, bytes]], size: int = 5, radius: int = 19, blocks: int = 4, weights: tuple[dict[int, float], float] | None = None):
        """``weights``: weights of the shingles that several items share, and of all others; counted from ``items`` if not given."""
        self.size, self.radius, self.blocks, self.bits = size, radius, blocks, 64 // blocks
        known = NormalHash()
        sets = [(i, len(w), shingle_hashes(w, known, size)) for i, w in ((i, t.split()) for i, t in items) if w]
        df = Counter(h for _, _, s in sets for h in set(s.tolist()))
        self.ids = np.array([i for i, _, _ in sets], np.int64)
        self.length = np.array([n for _, n, _ in sets], np.int64)
        self.weight, self.default = weights or shared_weights(df.items(), len(sets))
        self.bags = [Counter(s.tolist()) for _, _, s in sets]
        self.total = [sum(self.weight.get(h, self.default) * c for h, c in b.items()) for b in self.bags]
        self.known = np.array(sorted(df), np.uint64)
        self.of = {h: [] for h in df}
        for k, b in enumerate(self.bags):
            for h in b:
                self.of[h].append(k)
        self.prints = np.array([simhash((signs(s) * self.weigh(s)[:, None]).sum(0)) for _, _, s in sets], np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        ball = np.array([sum(1 << b for b in c) for r in range(radius // blocks + 1) for c in itertools.combinations(range(self.bits), r)], np.int64)
        self.tables = []  # per block: first place of each value, items by value
        for j in range(blocks):
            value = (self.block(self.prints, j)[:, None] ^ ball).ravel()
            item = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(ball))
            first = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.bits))]).astype(np.int64)
            self.tables.append((first, item[np.argsort(value, kind="stable")]))

    def block(self, prints: np.ndarray, j: int) -> np.ndarray:
        return ((prints >> np.uint64(j * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def weigh(self, s: np.ndarray) -> np.ndarray:
        """Weights in 1/1024, as integers: sums that cancel are exactly 0 wherever a window stands."""
        return np.array([round(1024 * self.weight.get(h, self.default)) for h in s.tolist()], np.int64)

    def near(self, print_: int) -> np.ndarray:
        """All items within the radius of a fingerprint."""
        p = np.uint64(print_)
        found = []
        for j, (first, item) in enumerate(self.tables):
            v = (int(print_) >> j * self.bits) & ((1 << self.bits) - 1)
            found.append(item[first[v] : first[v + 1]])
        k = np.unique(np.concatenate(found))
        return k[np.bitwise_count(self.prints[k] ^ p) <= self.radius]

    def similarity(self, k: int, s: np.ndarray) -> float:
        bag = self.bags[k]
        window = Counter(s.tolist())
        shared = sum(self.weight.get(h, self.default) * min(c, bag[h]) for h, c in window.items() if h in bag)
        whole = self.total[k] + sum(self.weight.get(h, self.default) * c for h, c in window.items()) - shared
        return shared / whole if whole else 0.0

    def matches(self, words: list[bytes], known: NormalHash, threshold: float) -> list[tuple]:
        """(item, start word, words, hamming, similarity): the best window of every item with a similarity of ``threshold`` or more."""
        n, best = len(words), {}
        if not n:
            return []
        s = shingle_hashes(words, known, self.size)
        at = np.flatnonzero(self.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = [a for a in at.tolist() if int(s[a]) in self.of] if len(at) else []
        short = [k for k in range(len(self.ids)) if self.length[k] < self.size] if self.has_short else []
        spans: dict[int, list] = {}
        for a in at:  # starts of windows of each size that hold a shared shingle
            for size in {int(self.length[k]) for k in self.of[int(s[a])] if self.length[k] >= self.size}:
                spans.setdefault(size, []).append((max(0, a - size + self.size), a))
        for size, ranges in spans.items():
            last = n - size
            starts: set[int] = set()
            for lo, hi in ranges:
                starts.update(range(min(lo, max(last, 0)), min(hi, max(last, 0)) + 1))
            start = np.array(sorted(starts), np.int64)
            lo, hi = int(start[0]), min(int(start[-1]) + size, n)
            part = s[lo : hi - self.size + 1]
            sums = np.zeros((len(part) + 1, 64), np.int64)
            np.cumsum(signs(part) * self.weigh(part)[:, None], axis=0, out=sums[1:])
            end = np.minimum(start + size - self.size + 1, len(s)) - lo
            prints = simhash(sums[end] - sums[start - lo])
            for x, p in zip(start.tolist(), prints.tolist(), strict=True):
                for k in self.near(p).tolist():
                    if self.length[k] != size:
                        continue
                    sim = self.similarity(k, s[x : x + size - self.size + 1])
                    if sim >= threshold and (k not in best or (-sim, x) < (-best[k][3], best[k][0])):
                        best[k] = (x, min(size, n - x), int(np.bitwise_count(self.prints[k] ^ np.uint64(p))), sim)
        for k in short:  # items shorter than a shingle: the whole item, word for word
            m = int(self.length[k])
            t = shingle_hashes_of(words, known, m)
            hit = np.flatnonzero(t == np.uint64(next(iter(self.bags[k]))))
            if len(hit):
                best[k] = (int(hit[0]), m, 0, 1.0)
        return [(int(self.ids[k]), *v) for k, v in sorted(best.items())]

    @property
    def has_short(self) -> bool:
        return bool(len(self.length)) and int(self.length.min()) < self.size


def shingle_hashes_of(words: list[bytes], known: WordHash, size: int) -> np.ndarray:
    return shingle_hashes(words, known, size) if len(words) >= size else np.empty(0, np.uint64)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, max_items: int = 1_000) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): one row per document and item that it holds."""
    out = None
    for index, more in _indexes(docs.sparkSession, benchmark, max_items):
        got = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_finder(index, threshold), MATCH)
        if more:  # written, so that the next part's index can take this one's place
            got = materialise(got, "matches")
            index[0].destroy()
        out = got if out is None else out.unionByName(got)
    return out


def item_frequencies(items: DataFrame, size: int = 5) -> tuple[list[tuple[int, int]], int]:
    """(shingle, items that hold it) for the shingles of several items, and the number of items with words."""

    def run(batches):
        known = NormalHash()
        for b in batches:
            sets = [np.unique(shingle_hashes(w, known, size)) for w in (t.split() for t in b.column("text").cast(pa.binary()).to_pylist()) if w]
            if sets:
                yield pa.RecordBatch.from_pydict({"h": pa.array([None] * len(sets) + np.concatenate(sets).view(np.int64).tolist(), pa.int64())})

    rows = items.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("h is null or c > 1").collect()
    return [(r.h % (1 << 64), r.c) for r in rows if r.h is not None], sum(r.c for r in rows if r.h is None)


def _indexes(spark: SparkSession, benchmark: DataFrame, max_items: int) -> Iterator:
    """The items' index, sent to all tasks, in parts of about ``max_items`` items, each with the weights of the whole benchmark (sent once); one
    part at a time, with whether there are several."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-items.count() // max_items))
    weights = shared_weights(*item_frequencies(items)) if parts > 1 else None
    sent = spark.sparkContext.broadcast(weights)  # bounded by the shingles that several items share
    for p in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else items
        index = ItemIndex([(r.item_id, r.text.encode()) for r in mine.orderBy("item_id", "text").collect()], weights=weights)
        if weights:
            index.weight = None
        yield (spark.sparkContext.broadcast(index), sent), parts > 1


def _received(index) -> ItemIndex:
    own, weights = index[0].value, index[1].value
    if weights:
        own.weight = weights[0]
    return own


def _finder(index, threshold: float):
    def run(batches):
        own, known = _received(index), NormalHash()
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                rows.extend((d, *m) for m in own.matches((t or b"").split(), known, threshold))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "start", "n_words", "hamming", "similarity"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, max_items: int = 1_000) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    schema = docs.schema

    def without(index):
        def run(batches):
            own, known = _received(index), NormalHash()
            for b in batches:
                keep = [not own.matches((t or b"").split(), known, threshold) for t in b.column("text").cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    written = None
    for index, more in _indexes(docs.sparkSession, benchmark, max_items):
        docs = docs.mapInArrow(without(index), schema)
        if more:
            docs = materialise(docs, "clean")
            index[0].destroy()
            if written is not None:
                discard(written)
            written = docs
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
