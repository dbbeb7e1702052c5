"""Quality rules: gradient-boosted trees over document statistics.

Statistics of a whole text are taken from its UTF-8 bytes (one ``bincount`` gives every character
class; words are ``bytes.split()``, whose white space is exactly ``\\x20\\x09-\\x0D``). A small booster is trained on the
driver from at most ``max_labelled`` labelled rows (the documented bound; those with the least hash of
doc_id), flattened into heap-ordered numpy node arrays and applied to Arrow batches of the whole table.

Defined cases: null text counts as empty; an empty text has all statistics 0 and fails the base rule; repeated
rows are scored each by themselves; an empty table gives an empty result; null or missing labels leave only the base rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features with the sign of their monotonic constraint (+1: more is never worse, -1: more is never better, 0: free).
FEATURES = {
    "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1, "shout_ratio": -1, "digit_ratio": -1,
    "punct_ratio": 0, "mean_word": 0, "distinct_ratio": 1, "log_words": 0, "words_per_line": 0, "nonascii_ratio": 0, "short_ratio": 0, "period_ratio": 0,
}
_SYM = np.frombuffer(SYMBOLS, np.uint8)
_SPC = np.frombuffer(SPACE, np.uint8)
_PUN = np.frombuffer(b".,;:!?'\"()[]{}-", np.uint8)


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in three-word windows found twice or more, first included; and the number of distinct words."""
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n, v = len(words), len(ids)
    if n < 4:
        return 0, v
    if v < 2_000_000:
        key = (seq[:-2] * v + seq[1:-1]) * v + seq[2:]
    else:
        pair = np.unique(seq[:-1] * v + seq[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * v + seq[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum()), v


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(hist[128:192].sum())
    chars = points - int(hist[_SPC].sum())
    symbols = int(hist[_SYM].sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct = repeat_words(words)
    c, w = max(chars, 1), max(n, 1)
    upper = int(hist[65:91].sum())
    return [n, chars, symbols, dup, repeat], [
        symbols / c, dup / max(lines, 1), repeat / w, upper / c, int(hist[33]) / w, int(hist[48:58].sum()) / c,
        int(hist[_PUN].sum()) / c, chars / w, distinct / w, float(np.log1p(n)), n / max(lines, 1), int(hist[192:].sum()) / c, sum(len(x) < 4 for x in words) / w, int(hist[46]) / w,
    ]


class Booster:
    """Logistic gradient boosting on histograms; every tree is a complete heap of ``depth`` levels in flat arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.prior = 0.0
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.cut = np.zeros((0, 2**depth - 1))
        self.leaf = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray, signs: list[int]) -> Booster:
        n, k = x.shape
        inner, total = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > b  <=>  x > edges[b]
        score = np.full(n, self.prior)
        feature, cut, leaf = [], [], []
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            f, t = np.zeros(inner, np.int32), np.full(inner, np.inf)
            low, high, value = np.full(total, -np.inf), np.full(total, np.inf), np.zeros(total)
            for level in range(self.depth):
                first, wide = 2**level - 1, 2**level
                best = np.full(wide, 1e-9)
                pick: list[tuple | None] = [None] * wide
                for j in range(k):
                    m = len(edges[j]) + 1
                    key = (node - first) * m + binned[:, j]
                    sums = [np.bincount(key, weights=w, minlength=wide * m).reshape(wide, m) for w in (g, h, np.ones(n))]
                    left = [s.cumsum(1)[:, :-1] for s in sums]
                    both = [s.sum(1, keepdims=True) for s in sums]
                    right = [b - a for a, b in zip(left, both, strict=True)]
                    lo, hi = low[first : first + wide, None], high[first : first + wide, None]
                    wl, wr = (np.clip(s[0] / (s[1] + self.ridge), lo, hi) for s in (left, right))
                    gain = sum(s[0] * w - 0.5 * (s[1] + self.ridge) * w * w for s, w in ((left, wl), (right, wr)))
                    wb = np.clip(both[0] / (both[1] + self.ridge), lo, hi)
                    gain = gain - (both[0] * wb - 0.5 * (both[1] + self.ridge) * wb * wb)
                    bad = (left[2] < self.least) | (right[2] < self.least) | (signs[j] * (wr - wl) < 0)
                    gain = np.where(bad, -1.0, gain)
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(1)
                    for i in range(wide):
                        if gain[i, at[i]] > best[i]:
                            best[i], pick[i] = gain[i, at[i]], (j, at[i], wl[i, at[i]], wr[i, at[i]])
                go = np.zeros(n, bool)
                for i in range(wide):
                    a = first + i
                    l, r = 2 * a + 1, 2 * a + 2
                    low[l] = low[r] = low[a]
                    high[l] = high[r] = high[a]
                    value[l] = value[r] = value[a]
                    if pick[i] is None:
                        continue
                    j, b, vl, vr = pick[i]
                    f[a], t[a], value[l], value[r] = j, edges[j][b], vl, vr
                    mid = (vl + vr) / 2
                    if signs[j] > 0:
                        high[l], low[r] = mid, mid
                    elif signs[j] < 0:
                        low[l], high[r] = mid, mid
                    go |= (node == a) & (x[:, j] > edges[j][b])
                node = 2 * node + 1 + go
            feature.append(f), cut.append(t), leaf.append(self.rate * value[inner:])
            score += leaf[-1][node - inner]
        self.feature, self.cut, self.leaf = np.array(feature), np.array(cut), np.array(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows walk one level of one tree at a time."""
        score = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            score += v[node - len(f)]
        return 1 / (1 + np.exp(-score))


def _binary(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Booster | None:
    """Train on at most ``max_labelled`` labelled rows, those with the least hash of doc_id; None without two classes."""
    picked = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by max_labelled

    def features(batches):
        for b in batches:
            rows = [statistics(t)[1] for t in _binary(b)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "y": b.column("quality").cast(pa.float64()), "d": b.column("doc_id")})

    got = joined.mapInArrow(features, "x array<double>, y double, d long").toPandas()
    if got.y.nunique() < 2:
        return None
    got["x"] = got.x.map(tuple)
    got = got.sort_values(["d", "y", "x"])  # the same model for any order of arrival
    return Booster().fit(np.array(got.x.tolist()), (got.y.to_numpy() > 0).astype(float), list(FEATURES.values()))


def judge(texts: list[bytes | None], model: Booster | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, whether the base rule fails, and the probability of a good text (1 without a model); a probability at the threshold is kept."""
    got = [statistics(t) for t in texts]
    base = np.array([g[0] for g in got], np.int64)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    return base, failed, model.predict(np.array([g[1] for g in got])) if model is not None else np.ones(len(got))


def apply_rules(docs: DataFrame, model: Booster | None, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept and the score; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            base, failed, p = judge(_binary(b), model)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{k: base[:, i] for i, k in enumerate(BASE)}, "base_failed": failed, "kept": ~failed & (p >= threshold), "score": p})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def filter_documents(docs: DataFrame, model: Booster | None, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            base, failed, p = judge(_binary(b), model)
            yield b.filter(pa.array(~failed & (p >= threshold)))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
