"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, with exact corpus counts.

Texts are tokenised once into blocks of bounded size: a row with the block's own vocabulary and the token stream as local
numbers. Counting sends one row per block and distinct token through the shuffle, not one per occurrence, and each count returns to the
blocks that hold the token. The same counts give the base score, the model's units and its open vocabulary.

The model is class-factored: the most frequent training tokens are units of their own, and every other token belongs to the class of its last bytes; the
classes with most of the remaining training tokens are units, and what is left is unit 0. Two context units with diagonal position weights
predict the next unit; training is NCE in numpy on every training text: each task starts from the same
parameters, walks its blocks with AdaGrad, and the results are averaged by token counts in a tree of partial sums. At scoring, a matrix product over all units
gives the normaliser of every distinct context, so unit probabilities are exact; a token of a class is then told by its smoothed share
of the class, so that the model is a distribution over all tokens of the corpus, however many: in each class one entry stands for all its unseen tokens.

Defined cases: null text is empty and consists of the end token; repeated rows are scored (and learned from) each; an empty table gives an empty
result; without training texts all counts are 0 and base_score is 0 per token; a null doc_id counts as the text '' when the fold is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphfold.llm.common import materialise, table

BLOCK_BYTES = 16 << 20
SUFFIX = 3  # bytes of a token's end that name its class
BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, vocab array<binary>, train array<long>, stream binary"


class Numbers(dict):
    """token -> its number, in the order of first appearance."""

    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self)
        return n


def blocks_of(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents; materialised, so that block numbers stay what they are. Local token 0 is the end (as b'')."""

    def run(batches):
        task, seq, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)

        def flush():
            data = np.concatenate(streams).astype("<i4")
            # one count over the block: one for each text would walk the whole vocabulary each time
            learned = np.repeat(~np.array(held, bool), [len(s) for s in streams])
            train = np.bincount(data[learned], minlength=len(local)).astype(np.int64)
            row = {"block": [task << 32 | seq], "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": [held], "lengths": pa.array([[len(s) for s in streams]], pa.list_(pa.int32())), "vocab": pa.array([list(local)], pa.list_(pa.binary())), "train": pa.array([train], pa.list_(pa.int64())), "stream": pa.array([pack.compress(data.tobytes())], pa.binary())}
            return pa.RecordBatch.from_pydict(row)

        local, ids, held, streams, size = Numbers({b"": 0}), [], [], [], 0
        for b in batches:
            for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = (t or b"").lower().split()
                s = np.zeros(len(words) + 1, np.int32)
                s[:-1] = np.fromiter(map(local.__getitem__, words), np.int32, len(words))
                ids.append(d), held.append(h), streams.append(s)
                size += len(t or b"")
                if size >= block_bytes:
                    yield flush()
                    seq += 1
                    local, ids, held, streams, size = Numbers({b"": 0}), [], [], [], 0
        if ids:
            yield flush()

    return materialise(docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), "text").mapInArrow(run, BLOCK), "blocks")


def token_counts(blocks: DataFrame) -> DataFrame:
    """(block, local, c, token): every block's tokens with their corpus-wide training counts; ``token`` is set on one row of each. Materialised."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                vocab, train = b.column("vocab")[i].values, b.column("train")[i].values
                n, block = len(vocab), b.column("block")[i].as_py()
                for at in range(0, n, 20_000):
                    k = min(20_000, n - at)
                    yield pa.RecordBatch.from_pydict({"block": np.full(k, block), "local": np.arange(at, at + k, dtype=np.int32), "token": vocab.slice(at, k), "n": train.slice(at, k)})

    rows = blocks.select("block", "vocab", "train").mapInArrow(run, "block long, local int, token binary, n long")
    by = Window.partitionBy("token")
    total = rows.withColumn("c", F.sum("n").over(by)).withColumn("first", F.row_number().over(by.orderBy("block")) == 1)
    return materialise(total.select("block", "local", "c", F.when(F.col("first"), F.col("token")).alias("token")), "counts")


class LogBilinear:
    """p(w | h1, h2) proportional to exp(sum((C0 R[h1] + C1 R[h2]) * Q[w]) + b[w])."""

    def __init__(self, unigram: np.ndarray, dim: int = 32, seed: int = 5):
        v = len(unigram)
        self.v, self.dim, self.unigram = v, dim, unigram
        rng = np.random.default_rng(seed)
        self.size = 2 * v * dim + 2 * dim + v
        theta = np.zeros(self.size, np.float32)
        self.theta = theta
        self.use(theta)
        self.R[:] = rng.normal(0, 0.3, (v, dim))
        self.C[:] = 0.7
        self.b[:] = np.log(unigram)

    def use(self, theta: np.ndarray) -> None:
        v, d = self.v, self.dim
        self.theta = theta
        self.R, self.Q = theta[: v * d].reshape(v, d), theta[v * d : 2 * v * d].reshape(v, d)
        self.C, self.b = theta[2 * v * d : 2 * v * d + 2 * d].reshape(2, d), theta[2 * v * d + 2 * d :]

    def train(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, squares: np.ndarray, noise: np.random.Generator, k: int = 64, batch: int = 2048, rate: float = 0.1) -> None:
        """One pass of noise-contrastive estimation; ``squares`` is AdaGrad's state."""
        v, d = self.v, self.dim
        shift = np.log(k * self.unigram).astype(np.float32)
        cdf = np.cumsum(self.unigram)
        grad = np.zeros(self.size, np.float32)
        lanes = np.arange(d)

        def scatter(index, values):
            return np.bincount((index[:, None] * d + lanes).ravel(), weights=values.ravel(), minlength=v * d).astype(np.float32)

        for at in range(0, len(w), batch):
            x1, x2, y = h1[at : at + batch], h2[at : at + batch], w[at : at + batch]
            n = np.minimum(np.searchsorted(cdf, noise.random(k) * cdf[-1]), v - 1)
            r1, r2 = self.R[x1], self.R[x2]
            q = r1 * self.C[0] + r2 * self.C[1]
            qy, qn = self.Q[y], self.Q[n]
            pos = 1 - 1 / (1 + np.exp(shift[y] - (q * qy).sum(1) - self.b[y]))
            neg = -1 / (1 + np.exp(shift[n] - q @ qn.T - self.b[n]))
            dq = pos[:, None] * qy + neg @ qn
            grad[: v * d] = scatter(np.concatenate([x1, x2]), np.concatenate([dq * self.C[0], dq * self.C[1]]))
            grad[v * d : 2 * v * d] = scatter(np.concatenate([y, n]), np.concatenate([pos[:, None] * q, neg.T @ q]))
            grad[2 * v * d : 2 * v * d + 2 * d] = np.concatenate([(dq * r1).sum(0), (dq * r2).sum(0)])
            grad[2 * v * d + 2 * d :] = np.bincount(np.concatenate([y, n]), weights=np.concatenate([pos, neg.sum(0)]), minlength=v)
            grad /= len(y)
            squares += grad * grad
            self.theta += rate * grad / np.sqrt(squares + 1e-8)

    def log_probs(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities; one row of a matrix product per distinct context."""
        v = self.v
        key = h2.astype(np.int64) * v + h1
        used = np.zeros(v * v, bool)
        used[key] = True
        contexts = np.flatnonzero(used)
        log_z = np.zeros(v * v, np.float32)
        for at in range(0, len(contexts), 2048):
            c = contexts[at : at + 2048]
            q = self.R[c % v] * self.C[0] + self.R[c // v] * self.C[1]
            logits = q @ self.Q.T + self.b
            top = logits.max(1)
            log_z[c] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        out = np.empty(len(w))
        for at in range(0, len(w), 1 << 16):
            s = slice(at, at + (1 << 16))
            q = self.R[h1[s]] * self.C[0] + self.R[h2[s]] * self.C[1]
            out[s] = (q * self.Q[w[s]]).sum(1) + self.b[w[s]] - log_z[key[s]]
        return out


def _unstream(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Local tokens of a block and the lengths of its documents."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("stream")[i].as_py()), "<i4"), b.column("lengths")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)


def _contexts(unit: np.ndarray, lengths: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before and the one before that; ``edge`` in front of a text."""
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h1, h2 = np.empty_like(unit), np.empty_like(unit)
    h1[1:], h2[2:] = unit[:-1], unit[:-2]
    h1[start] = h2[start] = edge
    h2[start[lengths > 1] + 1] = edge
    return h1, h2


def _units(b: pa.RecordBatch, i: int, names: tuple[pa.Array, pa.Array]) -> np.ndarray:
    """Unit of every local token of a block: its own, or its class's, or 0."""
    words, classes = names
    place = lambda x, of: pc.fill_null(pc.index_in(x, value_set=of), -1).to_numpy(zero_copy_only=False)
    vocab = b.column("vocab")[i].values
    word, cls = place(vocab, words), place(pc.binary_slice(vocab, -SUFFIX), classes)
    return np.where(word >= 0, word + 1, np.where(cls >= 0, cls + 1 + len(words), 0)).astype(np.int32)


def _names(names: tuple[list[bytes], list[bytes]]) -> tuple[pa.Array, pa.Array]:
    return pa.array(names[0], pa.binary()), pa.array(names[1], pa.binary())


def train(blocks: DataFrame, top: tuple[list[bytes], list[bytes]], start: LogBilinear, edge: int) -> LogBilinear:
    """Every task trains on all its training texts from the same start; the mean, weighted by tokens, is the model."""
    spark = blocks.sparkSession
    begin = spark.sparkContext.broadcast((top, start))  # bounded by the number of units

    def local(batches):
        names, first = begin.value
        names = _names(names)
        model = LogBilinear(first.unigram, first.dim)
        model.use(first.theta.copy())
        squares, tokens = np.full(model.size, 1e-6, np.float32), 0
        for b in batches:
            for i in range(b.num_rows):
                stream, lengths = _unstream(b, i)
                unit = _units(b, i, names)[stream]
                h1, h2 = _contexts(unit, lengths, edge)
                mine = np.repeat(~b.column("held")[i].values.to_numpy(zero_copy_only=False), lengths)
                order = np.flatnonzero(mine)
                seed = np.random.default_rng([b.column("block")[i].as_py(), 3])
                order = order[seed.permutation(len(order))]
                model.train(h1[order], h2[order], unit[order], squares, seed)
                tokens += len(order)
        if tokens:
            yield pa.RecordBatch.from_pydict({"tokens": [tokens], "theta": [(model.theta.astype(np.float64) * tokens).tobytes()]})

    def add(batches):
        tokens, total = 0, None
        for b in batches:
            for n, t in zip(b.column("tokens").to_pylist(), b.column("theta").to_pylist(), strict=True):
                x = np.frombuffer(t)
                tokens, total = tokens + n, x.copy() if total is None else total + x
        if tokens:
            yield pa.RecordBatch.from_pydict({"tokens": [tokens], "theta": [total.tobytes()]})

    schema = "tokens long, theta binary"
    sums = materialise(blocks.select("block", "held", "lengths", "vocab", "stream").mapInArrow(local, schema), "theta")
    n = sums.count()
    while n > 32:  # a tree of partial sums: no task holds more than one vector and a batch
        n = -(-n // 32)
        sums = materialise(sums.repartition(n).mapInArrow(add, schema), "theta")
    rows = sums.collect()  # 32 vectors at most
    if rows:
        start.use((sum(np.frombuffer(r.theta) for r in sorted(rows, key=lambda r: bytes(r.theta))) / sum(r.tokens for r in rows)).astype(np.float32))
    return start


def choose_units(once: DataFrame, units: int, words: int) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """(words, classes, training tokens, distinct training tokens) of the units, from ``once(token, c)``; unit 0 comes first in both arrays.

    All training tokens are in one unit each. At most ``units`` rows reach the driver.
    """
    spark, seen = once.sparkSession, once.where("c > 0").select("token", "c")
    n, v = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    best = seen.orderBy(F.desc("c"), "token").limit(words).collect()
    own = spark.createDataFrame([(bytes(r.token),) for r in best], "token binary")  # at most ``words`` rows
    other = seen.join(F.broadcast(own), "token", "left_anti")
    of = other.groupBy(F.substring("token", -SUFFIX, SUFFIX).alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    classes = of.orderBy(F.desc("c"), "ending").limit(units - 1 - words).collect()
    c, k = np.array([0] + [r.c for r in best + classes], np.int64), np.array([0] + [1] * len(best) + [r.v for r in classes], np.int64)
    c[0], k[0] = n - c.sum(), v - k.sum()
    return [bytes(r.token) for r in best], [bytes(r.ending) for r in classes], c, k


def score(docs: DataFrame, held_out, units: int = 1024, words: int | None = None, dim: int = 32) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10). ``words`` of the units are tokens, a sixteenth if not given."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, held_out)
    counts = token_counts(blocks)
    once = counts.where("token is not null")
    top, classes, mass, distinct = choose_units(once, units, max(1, units // 16) if words is None else words)
    n, v = int(mass.sum()), int(distinct.sum())
    single = np.zeros(len(mass), bool)
    single[1 : len(top) + 1] = True
    z_base, z = n + 0.1 * (v + 1), mass + 0.1 * (distinct + ~single)
    unigram = z
    edge = top.index(b"") + 1 if b"" in top else 0
    names = top, classes
    model = train(blocks, names, LogBilinear(unigram / unigram.sum(), dim), edge)
    shared = spark.sparkContext.broadcast((names, model))

    def by_model(batches):
        names, m = shared.value
        names = _names(names)
        for b in batches:
            for i in range(b.num_rows):
                stream, lengths = _unstream(b, i)
                of = _units(b, i, names)
                unit = of[stream]
                lp = m.log_probs(*_contexts(unit, lengths, edge), unit) / np.log(10)
                start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                yield pa.RecordBatch.from_pydict({"block": [b.column("block")[i].as_py()], "doc_ids": b.column("doc_ids").slice(i, 1), "held": b.column("held").slice(i, 1), "lengths": b.column("lengths").slice(i, 1), "stream": b.column("stream").slice(i, 1), "unit": [zstandard.compress(of.astype("<i2" if units < 1 << 15 else "<i4").tobytes(), 1)], "model": pa.array([np.add.reduceat(lp, start)], pa.list_(pa.float64()))})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in left.combine_chunks().to_batches():
            for i in range(b.num_rows):
                stream, lengths = _unstream(b, i)
                local = right.column("local").to_numpy()
                c = np.zeros(len(local), np.int64)
                c[local] = right.column("c").to_numpy()
                unit = np.frombuffer(zstandard.decompress(b.column("unit")[i].as_py()), "<i2" if units < 1 << 15 else "<i4")
                start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                total = lambda x: np.add.reduceat(x[stream], start)  # noqa: B023, E731
                spelled = np.where(single[unit], 0.0, np.log10((c + 0.1) / z[unit]))
                k = len(lengths)
                out.append(pa.table({"doc_id": b.column("doc_ids")[i].values, "held_out": b.column("held")[i].values, "n_tokens": lengths, "n_known": total((c > 0).astype(np.int64)), "train_tokens": np.full(k, n, np.int64), "base_score": total(np.log10((c + 0.1) / z_base)), "score": b.column("model")[i].values.to_numpy(zero_copy_only=False) + total(spelled)}))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    left = blocks.mapInArrow(by_model, "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, stream binary, unit binary, model array<double>")
    return left.groupBy("block").cogroup(counts.select("block", "local", "c").groupBy("block")).applyInArrow(join, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10) == 0
    return score(table(spark, sf_dir, "documents"), held)
