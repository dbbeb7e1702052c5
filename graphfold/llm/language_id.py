"""Language ID by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, which a forward algorithm takes in one sweep; a text's is the product over
its words. Piece probabilities are learned by expectation maximisation with the backward algorithm over word counts of at most
``docs_per_lang`` labelled texts for each language (the documented bound; those whose doc_id hashes below the language's share). No id
enters a prediction, and held-out texts never enter the counts.

Words are in lower case, start with the vocabulary's word mark and are taken whole, however long. All distinct words of a batch are scored together: a
dense trie over the learned pieces is walked from every start position of all words at once. The forward table is a ring that holds as many positions as the longest
piece has characters; it is rescaled on the way and the scales are kept as logarithms, so no length underflows and memory is bounded.

Defined cases: a text that is null or has no letter is ``und`` with score 0; equally probable languages go to the first by name; repeated rows are scored each; an empty table
gives an empty result; without any learned language every text is ``und``; a null doc_id counts as the text '' when the fold is taken; columns other than doc_id, text and
lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import WORD, table

MARK = "▁"


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class PieceTrie:
    """Transitions of all pieces as one table: state x character -> state (0: none); characters that no piece has are column 0."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.letter = {ord(c): i + 1 for i, c in enumerate(letters)}
        self.top = max(self.letter, default=0)
        self.code = np.zeros(self.top + 2, np.int32)
        for c, i in self.letter.items():
            self.code[c] = i
        nodes: list[dict[int, int]] = [{}, {}]  # 0: none, 1: root
        piece = [-1, -1]
        for k, p in enumerate(pieces):
            at = 1
            for c in p:
                i = self.letter[ord(c)]
                if i not in nodes[at]:
                    nodes[at][i] = len(nodes)
                    nodes.append({})
                    piece.append(-1)
                at = nodes[at][i]
            piece[at] = k
        self.next = np.zeros((len(nodes), len(letters) + 1), np.int32)
        for a, n in enumerate(nodes):
            for i, b in n.items():
                self.next[a, i] = b
        self.piece = np.array(piece, np.int32)
        self.deepest = max((len(p) for p in pieces), default=1)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of marked words, padded by -1, and their lengths."""
        words = [MARK + w for w in words]
        n = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        flat = self.code[np.minimum(flat, self.top + 1)]
        out = np.full((len(words), int(n.max(initial=1))), -1, np.int32)
        out[np.arange(out.shape[1]) < n[:, None]] = flat
        return out, n

    def walk(self, codes: np.ndarray, s: int):
        """All (end, rows, pieces) with a piece on codes[rows, s:end]."""
        rows, state = np.arange(len(codes)), np.ones(len(codes), np.int32)
        for e in range(s, min(codes.shape[1], s + self.deepest)):
            c = codes[rows, e]
            go = c > 0
            rows, state = rows[go], self.next[state[go], c[go]]
            go = state > 0
            rows, state = rows[go], state[go]
            if not len(rows):
                return
            p = self.piece[state]
            m = p >= 0
            if m.any():
                yield e + 1, rows[m], p[m]

    def edges(self, codes: np.ndarray):
        """All (start, end, rows, pieces), by start."""
        for s in range(codes.shape[1]):
            for e, rows, p in self.walk(codes, s):
                yield s, e, rows, p


def batches_of(words: list[str], most: int, cells: int = 1 << 22):
    """Places of words of about the same length, shortest first: at most ``most`` words and about ``cells`` characters at a time."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        k = min(most, len(order) - at)
        while k > 1 and k * size[order[at + k - 1]] > cells:
            k = max(1, k // 2)
        yield order[at : at + k]
        at += k


class Segmenter:
    """Unigram piece models of several languages over one trie."""

    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray, unknown: float = 1e-9):
        self.trie, self.langs, self.prob, self.unknown = PieceTrie(pieces), langs, prob, unknown

    def forward(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P of each row's first n characters per language, over all segmentations; rows are sorted by n."""
        trie, langs = self.trie, self.prob.shape[1]
        ring = trie.deepest + 2
        alpha, scale, out = np.zeros((len(codes), ring, langs)), np.zeros((len(codes), langs)), np.zeros((len(codes), langs))
        alpha[:, 0] = 1
        for s in range(codes.shape[1] + 1):
            here = s % ring
            if s:  # all edges into s have been added: let an unknown character pass as well
                last = (s - 1) % ring
                alpha[:, here] += alpha[:, last] * self.unknown
                alpha[:, last] = 0
            lo, hi = np.searchsorted(n, (s, s + 1))
            if hi > lo:
                out[lo:hi] = np.log(alpha[lo:hi, here]) + scale[lo:hi]
            if s % 8 == 7:  # eight unknown characters cost 1e-72
                top = alpha.max(1)
                alpha /= top[:, None]
                scale += np.log(top)
            for e, rows, p in trie.walk(codes, s):
                alpha[rows, e % ring] += alpha[rows, here] * self.prob[p]
        return out

    def log_prob(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations of the whole word."""
        out = np.zeros((len(words), self.prob.shape[1]))
        for pick in batches_of(words, max(128, 32_768 // max(1, self.prob.shape[1]))):  # bounds the forward table for any number of languages
            out[pick] = self.forward(*self.trie.codes([words[i] for i in pick]))
        return out


def expectations(seg: Segmenter, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one language's words (seg holds that language alone): forward times backward, in logarithms."""
    out = np.zeros(len(seg.prob))
    with np.errstate(divide="ignore"):
        log_p, log_u = np.log(seg.prob[:, 0]), np.log(seg.unknown)
    for pick in batches_of(words, 2048, 1 << 18):
        codes, n = seg.trie.codes([words[i] for i in pick])
        wide = codes.shape[1]
        alpha = np.full((len(pick), wide + 1), -np.inf)
        alpha[:, 0] = 0
        by_start = []
        for s in range(wide):
            if s:
                alpha[:, s] = np.logaddexp(alpha[:, s], alpha[:, s - 1] + log_u)
            edges = list(seg.trie.walk(codes, s))
            by_start.append(edges)
            for e, rows, p in edges:
                alpha[rows, e] = np.logaddexp(alpha[rows, e], alpha[rows, s] + log_p[p])
        alpha[:, wide] = np.logaddexp(alpha[:, wide], alpha[:, wide - 1] + log_u)
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(pick)), n] = 0
        whole = alpha[np.arange(len(pick)), n]
        for s in range(wide - 1, -1, -1):
            beta[:, s] = np.logaddexp(beta[:, s], beta[:, s + 1] + log_u)
            for e, rows, p in by_start[s]:
                beta[rows, s] = np.logaddexp(beta[rows, s], beta[rows, e] + log_p[p])
        for s, edges in enumerate(by_start):
            for e, rows, p in edges:
                np.add.at(out, p, counts[pick[rows]] * np.exp(alpha[rows, s] + log_p[p] + beta[rows, e] - whole[rows]))
    return out


def fit(docs: DataFrame, vocabulary: list[str], docs_per_lang: int = 300, rounds: int = 3, smooth: float = 0.1) -> Segmenter | None:
    """Learn from rows with a text and a language that are not held out. About ``docs_per_lang`` texts per language, whole."""
    known = docs.where("text is not null and lang is not null").where(bucket(F.col("doc_id"), 3) != 1)
    langs = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}  # a row per language
    if not langs:
        return None
    # a hash share per language: about docs_per_lang rows each, without ordering or gathering a language
    share = F.create_map(*(F.lit(x) for k, n in langs.items() for x in (k, min(1.0, docs_per_lang / n))))
    u = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    words = known.where(u <= share[F.col("lang")]).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w"))
    got = words.groupBy("lang", "w").count().toPandas()  # bounded by the number of texts learned from
    text = {k: (g["w"].tolist(), g["count"].to_numpy(float)) for k, g in got.sort_values(["lang", "w"]).groupby("lang")}
    names = [k for k in langs if k in text]
    if not names:
        return None
    # pieces that occur at all, in any language
    base = PieceTrie(vocabulary)
    seen = np.zeros(len(vocabulary), bool)
    for w, _ in text.values():
        for pick in batches_of(w, 8192):
            for _, _, _, p in base.edges(base.codes([w[i] for i in pick])[0]):
                seen[p] = True
    pieces = [p for p, s in zip(vocabulary, seen, strict=True) if s]
    prob = np.empty((len(pieces), len(names)))
    for k, lang in enumerate(names):
        q = np.full((len(pieces), 1), 1 / max(len(pieces), 1))
        for _ in range(rounds):
            e = expectations(Segmenter(pieces, [lang], q), *text[lang]) + smooth
            q = (e / e.sum())[:, None]
        prob[:, k] = q[:, 0]
    return Segmenter(pieces, names, prob)


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a public sentencepiece model, in lower case, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return sorted({sp.id_to_piece(i).lower() for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


def identify(docs: DataFrame, model: Segmenter | None, keep: int = 200_000) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score (posterior under equal priors, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the number of languages

    def run(batches):
        seg = shared.value
        langs = len(seg.langs) if seg else 0
        known: dict[bytes, int] = {}
        rows = np.zeros((0, langs))
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            decoded = [(t or b"").decode().lower() for t in texts]
            lists = [d.encode().split() if seg and any(map(str.isalpha, d)) else [] for d in decoded]
            if len(known) > keep:
                known, rows = {}, np.zeros((0, langs))
            new: dict[bytes, int] = {}
            for words in lists:
                for w in words:
                    if w not in known and w not in new:
                        new[w] = len(known) + len(new)
            if new:
                rows = np.concatenate([rows, seg.log_prob([w.decode() for w in new])])
                known.update(new)
            pred, score = [], []
            for words in lists:
                if not words:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                k = int(total.argmax())
                p = np.exp(total - total[k])
                pred.append(seg.langs[k])
                score.append(float(1 / p.sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, vocabulary_pieces(path("piece_bpe_32k.model"))))

