"""op1, op3, op4, op7, op9, op10 and the pipeline against plain Python, with edge cases."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphfold.llm import decontamination, jaccard, jaccard_join, language_id, lm_scoring, substring_dedup, suffix_dedup
from graphfold.llm.common import components, materialise, sieve, sieved
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefgéß") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    """Texts with copies, near copies, chains of near copies, shared passages and edge cases."""
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(3, 120)) for _ in range(60)]
    passage = sentence(rng, 60)
    for i in range(10, 18):
        texts[i] = f"{texts[i]} {passage} {sentence(rng, 20)}"
    texts += texts[:4] + [texts[0]] * 3
    base = sentence(rng, 100).split()
    for _ in range(70):  # a large group of near copies, a chain as it drifts
        base = list(base)
        base[rng.randrange(100)] = rng.choice(VOCAB)
        texts.append(" ".join(base))
    texts += ["", " ", "one two", "one two", "a\x00b " * 80, "a\x00b " * 80 + "c", "ab" * 700, "é" * 301, f"{passage}\n{passage}"]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (None, texts[3], "en", "s", 1), (5, texts[5], "en", "s", 1)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, x) for x in range(401, 440)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = (text or "").split()
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingle_set(r[1]) for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12:
            near[i].add(j)
            near[j].add(i)
    label = {}
    for i in range(len(rows)):
        if i in label:
            continue
        todo, seen = [i], {i}
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        for x in seen:
            label[x] = min(ids) if ids else None
    return Counter((r[0], label[i], len(near[i])) for i, r in enumerate(rows))


def test_jaccard_join_finds_every_link(docs, empty):
    got = Counter(tuple(r) for r in jaccard_join.join_documents(docs).collect())
    assert got == brute_classes(ROWS)
    assert jaccard_join.join_documents(empty).count() == 0


def test_keep_one_of_each_class(docs, empty):
    got = jaccard_join.keep_one(docs.withColumn("extra", F.lit(1))).collect()
    classes = {c for (d, c, n) in brute_classes(ROWS) if c is not None}
    wordless = [r for r in ROWS if not shingle_set(r[1])]
    assert sorted(r.doc_id for r in got if shingle_set(r.text)) == sorted(c for c in classes if any(r[0] == c and shingle_set(r[1]) for r in ROWS))
    assert sum(not shingle_set(r.text) for r in got) == len(wordless)
    assert jaccard_join.keep_one(empty).count() == 0


def test_paths_and_blocks_equal_brute_force(docs):
    """Small buckets, so that splitting, leaders, blocks and the last level all run."""
    sketches = jaccard_join.sketch_texts(docs)
    ids = {r.text: r.id for r in docs.where("text is not null").select("text", F.xxhash64("text").alias("id")).distinct().collect()}
    texts = sorted({r[1] for r in ROWS if shingle_set(r[1])})
    sets = {t: shingle_set(t) for t in texts}
    pairs = [(a, b) for a, b in itertools.combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 60
    for small, depth in ((4, 2), (2, 4), (4, 0)):
        tied = {r.node: r.component for r in components(jaccard_join.chosen_paths(sketches, small=small, depth=depth)).collect()}
        hit = sum(ids[a] in tied and tied[ids[a]] == tied.get(ids[b]) for a, b in pairs)
        assert hit == len(pairs)


def test_clashing_columns_stay(spark, docs):
    odd = docs.where("doc_id < 5").withColumns({c: F.lit(c) for c in ("_class_id", "class_id", "class_text", "id", "doc", "copies")})
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({d for d, *_ in ROWS if d is not None and d < 5})
    assert set(kept.select("class_id").distinct().toPandas()["class_id"]) == {"class_id"}


@pytest.mark.parametrize("changes", [1, 2, 6])
def test_blocks_of_large_groups_lose_no_link(spark, changes):
    """Every text in the leader's core, pairs about the threshold, and bands from 0 to 1; copies of shingle sets and texts apart from all."""
    rng = random.Random(changes)
    base = [sentence(rng, 60).split() for _ in range(2)]
    texts = []
    for i in range(40):
        w = list(base[i % 2])
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(60)] = rng.choice(VOCAB)
        texts.append(" ".join(w) + "\n" * i)
    texts += [sentence(rng, 60) for _ in range(3)]
    m = len(texts)
    units = spark.createDataFrame([(i, 1 + i % 3, t) for i, t in enumerate(texts)], "id long, copies long, text string")
    clusters = spark.createDataFrame([(i, 7) for i in range(m)], "id long, cluster long")
    small = {r.id: (r["class"], r.links) for r in jaccard.exact_classes(units, clusters, block=6).collect()}
    large = {r.id: (r["class"], r.links) for r in jaccard.exact_classes(units, clusters).collect()}
    sets = [shingle_set(t) for t in texts]
    want = {i: sum(1 + j % 3 for j in range(m) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(m)}
    assert small == large and {i: n for i, (_, n) in small.items()} == {i: n for i, n in want.items() if n}


def test_bands_of_distances_hold_what_they_say():
    rng = random.Random(6)
    for threshold in (0.5, 0.8, 0.9):
        edges, sure, compare = jaccard.bands(threshold)
        for _ in range(3000):
            x, y, lead = (frozenset(k for k in range(12) if rng.random() < 0.85) | {12} for _ in range(3))
            far = lambda a, b: 1 - len(a & b) / len(a | b)
            pair = tuple(int(np.searchsorted(edges, far(a, lead) - 1e-12)) for a in (x, y))
            similar = len(x & y) >= threshold * len(x | y) - 1e-9
            assert pair in compare or similar == (pair in sure)


def brute_windows(rows, length=200):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = Counter()
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup_equals_all_windows(docs, empty):
    got = Counter(tuple(r) for r in suffix_dedup.removals(docs).drop("spans").collect())
    assert got == brute_windows(ROWS)
    assert suffix_dedup.removals(empty).count() == 0


def test_suffix_dedup_of_long_texts_and_a_frequent_line(spark):
    rng = random.Random(31)
    line = "this line of seventy bytes or more stands in very many of the texts here, again"
    rows = [(i, f"{sentence(rng, 25)} {line} {sentence(rng, 25)}") for i in range(600)]
    long = sentence(rng, 16_000)  # about 90 kB: many stretches
    rows += [(1000, long), (1001, f"{sentence(rng, 40)} {long[20_000:60_000]} {sentence(rng, 40)}"), (1002, long[:30_000] + "x" + long[30_001:]), (1003, None), (1004, rows[0][1])]
    rows += [(2000 + i, f"{long[100 : 100 + 150 + 13 * i]} {sentence(rng, 30)}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "start": F.lit("x"), "copies": F.lit(2)}).repartition(3)
    got = Counter(tuple(r) for r in suffix_dedup.removals(df, stretch=1 << 12).drop("spans").collect())
    assert got == brute_windows(rows)


def test_agreement_is_the_best_common_prefix(spark):
    rng = random.Random(13)
    rows = [(i, rng.randrange(3), bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6)))) for i in range(300)] + [(300 + i, 9, b"same") for i in range(200)] + [(900, 77, b"")]
    df = spark.createDataFrame([(i, c, bytearray(x)) for i, c, x in rows], "id long, core long, context binary")

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    want = {i: max([-1, *(common(x, y) for j, d, y in rows if j != i and d == c)]) for i, c, x in rows}
    got = {r.id: r.far for r in suffix_dedup.agreement(df.repartition(4), 6).groupBy("id").agg(F.max("far").alias("far")).collect()}
    assert got == want


def test_phrases_tile_the_starts_and_follow_content():
    t = suffix_dedup.Trigger(stretch=1 << 12)
    rng = np.random.default_rng(0)
    text = rng.integers(97, 103, 20_000, dtype=np.uint8).tobytes()
    phrases = list(t.phrases(text))
    assert [s for s, n, _ in phrases] == [0, *itertools.accumulate(n for _, n, _ in phrases)][:-1] and sum(n for _, n, _ in phrases) == len(text) - 199
    assert all(s + n - 1 <= a <= s + 200 - 64 for s, n, a in phrases)
    where = {x: a - x for s, n, a in phrases for x in range(s, s + n)}
    moved = {x: a - x for s, n, a in t.phrases(b"zzz" + text) for x in range(s, s + n)}
    assert all(moved[x + 3] == w for x, w in where.items())


def test_substring_dedup_removes_all_but_the_first(spark, empty):
    rng = random.Random(3)
    p, q = sentence(rng, 40), sentence(rng, 30)
    near = " ".join([*q.split()[:-1], "changed"])
    run = ". ".join(" ".join(rng.choice(VOCAB) for _ in range(10)).capitalize() for _ in range(6)) + "."
    rows = [
        (1, f"{sentence(rng, 20)}\n{p}"), (2, f"{p}\n{sentence(rng, 20)}"), (3, f"{q}\nshort line"), (4, f"x\n{near}\nshort line"), (5, sentence(rng, 50)), (6, None), (7, ""), (8, f"{sentence(rng, 60)}. {run} {sentence(rng, 9)}"), (9, f"{sentence(rng, 55)}. {run} {sentence(rng, 30)}"),
        (10, p.replace(" ", "  ")), (None, sentence(rng, 30)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.removals(df).collect()}
    assert {d for d, r in got.items() if r.n_removed} == {2, 4, 9, 10}
    assert {d for d, r in got.items() if r.n_repeated} == {1, 2, 3, 4, 8, 9, 10}
    s = got[2].spans[0]
    assert rows[1][1].encode()[s.start : s.end].decode() == p and s.kept_doc_id == 1
    assert got[9].n_removed >= 0.5 * len(run.encode())
    assert len(got) == len(rows) and got[6].n_bytes == 0
    assert substring_dedup.removals(empty).count() == 0
    same = spark.createDataFrame([(1, p), (1, p)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.removals(same).collect()) == [0, len(p.encode())]


def test_short_units_that_differ_by_a_word_at_an_end(spark):
    rng = random.Random(21)
    a, b, c = sentence(rng, 8), sentence(rng, 12), sentence(rng, 10)
    rows = [(1, a), (2, f"{a} more"), (3, f"{b}\nshort line"), (4, f"x\nmore {b}"), (5, f"more {c}"), (6, c), (7, " ".join([*sentence(rng, 7).split(), "alone"]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, n in got.items() if n} == {2, 4, 6}


def test_passages_pasted_inside_sentences_are_found(spark):
    rng = random.Random(17)
    rows = []
    for i in range(60):  # one line each, no sentence ends; half of the pairs share 50 words at any place
        shared = sentence(rng, 50)
        for j in range(2):
            words = [sentence(rng, rng.randint(0, 40)), shared if i % 2 else sentence(rng, 50), sentence(rng, rng.randint(0, 40))]
            rows.append((2 * i + j, "\n".join(words) if i % 4 == 1 else " ".join(words)))
    got = {r.doc_id: r for r in substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "unit": F.lit("u")})).collect()}
    for i in range(60):
        assert (got[2 * i].n_repeated > 0) == (got[2 * i + 1].n_removed > 0) == bool(i % 2)
        assert got[2 * i].n_removed == 0
    text = rows[3][1].encode()
    assert all(text[s.start : s.end] in rows[2][1].encode() for s in got[3].spans)


def test_passages_depend_on_content_alone():
    rng = random.Random(18)
    known = jaccard.WordHash()
    shared = sentence(rng, 39)
    for _ in range(50):
        texts = [f"{sentence(rng, rng.randint(0, 30))}  {shared}\t{sentence(rng, rng.randint(0, 30))}".encode() for _ in range(2)]
        units = [dict(zip(u.tolist(), zip(a.tolist(), e.tolist(), strict=True), strict=True)) for a, e, u in (substring_dedup.scan([t], known)[1][1:] for t in texts)]
        both = units[0].keys() & units[1].keys()
        assert both
        for u in both:
            a, b = (t[slice(*x[u])].split() for t, x in zip(texts, units, strict=True))
            assert a == b and len(a) == 20


def test_scan_of_several_texts_is_that_of_each():
    rng = random.Random(19)
    known = jaccard.WordHash()
    texts = [f"{sentence(rng, rng.randint(0, 90))}\n \t{sentence(rng, rng.randint(0, 90))}\n".encode() for _ in range(40)] + [b"", b" \n\n", b"one", ("w " * 300).encode()]
    for kind in (0, 1):
        whole = substring_dedup.scan(texts, known)[kind]
        for k, t in enumerate(texts):
            alone = substring_dedup.scan([t], known)[kind]
            mine = whole[0] == k
            assert all((x[mine] == y).all() for x, y in zip(whole[1:], alone[1:], strict=True))
            if kind == 0:
                assert [t[a:e].split() for a, e in zip(*(x.tolist() for x in alone[1:3]), strict=True)] == [x.split() for x in t.split(b"\n") if len(x.split()) >= 8]


def test_near_units_equal_brute_force(spark):
    """Random paragraphs of 8 to 30 words, with words added, dropped and changed: classes against all pairs."""
    rng = random.Random(23)
    lines = []
    for _ in range(70):
        w = sentence(rng, rng.randint(8, 30)).split()  # too short for a passage
        lines.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            k = rng.choice(["add", "drop", "change", "edge"])
            at = rng.randrange(len(v)) if k != "edge" else 0
            v[at : at + (k in ("drop", "change"))] = [] if k == "drop" and len(v) > 8 else [rng.choice(VOCAB)]
            lines.append(" ".join(v))
    rows = [(i, t) for i, t in enumerate(lines)]
    want = {d: c for d, c, n in brute_classes([(d, t) for d, t in rows])}
    linked = {d for d, c, n in brute_classes([(d, t) for d, t in rows]) if n}
    got = {r.doc_id: r for r in substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {d for d, r in got.items() if r.n_repeated}
    assert found <= linked and len(found) >= 0.98 * len(linked) and len(linked) > 60
    for d, r in got.items():
        assert all(want[s.kept_doc_id] == want[d] for s in r.spans)


def test_bands_have_the_recall_of_their_formula():
    rng = random.Random(6)
    hit = n = 0
    known, minhash = jaccard.WordHash(), jaccard.MinHash(12)
    for _ in range(300):
        a = sentence(rng, 90).encode().split()
        b = list(a)
        b[rng.randrange(20, 70)] = b"zz"
        b[rng.randrange(20, 70)] = b"yy"
        x, y = set(jaccard.shingle_hashes(a, known).tolist()), set(jaccard.shingle_hashes(b, known).tolist())
        if len(x & y) < 0.8 * len(x | y):
            continue
        ka, kb = substring_dedup.band_keys([a, b], known, minhash, 2, 5)
        n += 1
        hit += bool((ka == kb).any())
    assert n > 50 and hit >= 0.98 * n


def brute_matches(docs, items, threshold=0.8):
    known = decontamination.NormalHash()
    index = decontamination.ItemIndex(items)
    out = set()
    for d, t in docs:
        s = jaccard.shingle_hashes((t or "").encode().split(), known)
        for k in range(len(index.ids)):
            n = int(index.length[k])
            if n < 5:
                continue
            for x in range(max(1, len(s) - (n - 5))):
                if index.similarity(k, s[x : x + n - 4]) >= threshold:
                    out.add((d, int(index.ids[k])))
    return out


def test_decontamination_equals_all_windows(spark, empty):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randint(12, 40))) for i in range(12)] + [(12, "tiny item"), (13, "  "), (14, None)]
    docs = []
    for i in range(60):
        t = sentence(rng, 80).split()
        if i % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            if i % 2:
                w[rng.randrange(len(w))] = "changed"
            if i % 4 == 0:
                w = [f"“{x.upper()}," if j == 2 else x for j, x in enumerate(w)]
            t[30:30] = w
        docs.append((i, " ".join(t)))
    docs += [(60, None), (61, ""), (62, "a tiny, ITEM here"), (63, items[1][1]), (64, items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find(d, b).collect()}
    want = brute_matches(docs, [(i, t.encode()) for i, t in items if t]) | {(62, 12)}
    assert got == want and {(63, 1), (64, 1)} <= got
    assert {(r.doc_id, r.item_id) for r in decontamination.find(d, b, max_items=4).collect()} == got
    clean = {r.doc_id for r in decontamination.clean(d, b).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in got}
    assert decontamination.find(empty, b).count() == 0 and decontamination.find(d, b.limit(0)).count() == 0


def test_parts_of_the_benchmark_change_no_row(spark):
    rng = random.Random(12)
    shared = sentence(rng, 14)
    items = [(i, f"{sentence(rng, 10)} {shared if i % 2 else sentence(rng, 14)}") for i in range(24)] + [(24, "tiny item"), (25, " "), (26, None)]
    docs = []
    for i in range(120):
        w = items[rng.randrange(24)][1].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(2)] = "changed"
        docs.append((i, f"{sentence(rng, 20)} {' '.join(w)} {sentence(rng, 20)} tiny item"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in decontamination.find(d, b).collect())
    assert {(x, k) for x, k, *_ in whole} == brute_matches(docs, [(i, t.encode()) for i, t in items if t]) | {(x, 24) for x, _ in docs}
    for n in (1, 5, 13):
        assert sorted(tuple(r) for r in decontamination.find(d, b, max_items=n).collect()) == whole
    assert sorted(r.doc_id for r in decontamination.clean(d, b.where("item_id < 24"), max_items=5).collect()) == sorted({x for x, _ in docs} - {x for x, k, *_ in whole if k < 24})


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = random.Random(0)
    index = decontamination.ItemIndex([(i, sentence(rng, 20).encode()) for i in range(50)])
    for _ in range(200):
        k = rng.randrange(50)
        p = int(index.prints[k])
        for b in rng.sample(range(64), rng.randint(0, 19)):
            p ^= 1 << b
        assert k in index.near(p)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    prob = np.array([[0.1], [0.2], [0.1], [0.15], [0.2], [0.05], [0.1], [0.1]])
    seg = language_id.Segmenter(pieces, ["x"], prob)

    def total(s):
        return 1.0 if not s else sum(prob[i, 0] * total(s[len(p) :]) for i, p in enumerate(pieces) if s.startswith(p)) + 1e-9 * total(s[1:])

    words = ["ab", "aba", "abab", "b", "aq", "abbaabab", "ab", "qqqqqqqqqqqqab"]
    assert np.allclose(seg.log_prob(words)[:, 0], [math.log(total("▁" + w)) for w in words], rtol=1e-6)

    def log_total(w):  # the same sum in logarithms, for words of any length
        at = [0.0]
        for e in range(1, len(w) + 1):
            ways = [at[e - 1] + math.log(1e-9), *(at[e - len(p)] + math.log(prob[i, 0]) for i, p in enumerate(pieces) if e >= len(p) and w[e - len(p) : e] == p)]
            top = max(ways)
            at.append(top + math.log(sum(math.exp(x - top) for x in ways)))
        return at[-1]

    rng = random.Random(4)
    long = ["".join(rng.choice("ab" * 9 + "q") for _ in range(n)) for n in (47, 48, 49, 200, 200, 3000)] + ["q" * 34, "ab" + "q" * 400]
    assert np.allclose(seg.log_prob(long)[:, 0], [log_total("▁" + w) for w in long], rtol=1e-9)
    assert np.isfinite(language_id.expectations(seg, long, np.ones(len(long)))).all()
    e = language_id.expectations(seg, ["ab"], np.array([2.0]))
    ways = {("▁", "a", "b"): 0.1 * 0.1 * 0.15, ("▁", "ab"): 0.1 * 0.2, ("▁a", "b"): 0.2 * 0.15, ("▁ab",): 0.1}
    z = sum(ways.values())
    want = [2 * sum(v for k, v in ways.items() if p in k) / z for p in pieces]
    assert np.allclose(e, want, atol=1e-6)


def test_language_id(spark, empty):
    rng = random.Random(1)
    langs = {"xx": "lo mi ta ne sar kul".split(), "yy": "zu wrr chee ist onk".split()}
    rows = [(i, " ".join("".join(rng.choice(langs[k]) for _ in range(rng.randint(1, 3))) for _ in range(30)), k, "s", 1) for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx", "s", 1), (901, "12 -- !", "xx", "s", 1), (902, "", None, "s", 1), (None, "lomita nesar", None, "s", 1), (903, "lomi " * 9000, None, "s", 1), (904, "x" * 5000, None, "s", 1)]
    from public_tokenizers import path

    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(df, language_id.vocabulary_pieces(path("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    for d, t, k, *_ in rows[:120]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert got[d].lang_pred == k and 0 <= got[d].score <= 1
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == got[903].lang_pred == "xx"
    assert language_id.fit(empty, ["▁"]) is None and {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_language_without_spaces_is_learned(spark):
    rng = random.Random(5)
    langs = {"xx": "lo mi ta ne sar kul".split(), "zz": "zu wrr chee ist onk".split()}
    texts = {k: ["".join(rng.choice(langs[k]) + " " * (k == "xx") for _ in range(90)) for _ in range(40)] for k in langs}
    df = spark.createDataFrame([(i, t, k, "s", 1) for i, (k, t) in enumerate((k, t) for k in langs for t in texts[k])], SCHEMA)
    from public_tokenizers import path

    model = language_id.fit(df, language_id.vocabulary_pieces(path("piece_bpe_32k.model")))
    assert model.langs == ["xx", "zz"]
    known, odd = ["".join(rng.choice(langs[k]) for _ in range(3)) for k in langs], "語" * 60  # unknown letters tell nothing, known ones still decide
    assert [int(x.argmax()) for x in model.log_prob([f"{k}{odd}" for k in known])] == [0, 1]
    assert all(r.lang_pred == ("xx" if r.doc_id < 40 else "zz") for r in language_id.identify(df, model).collect())


def held():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10) == 0


def test_lm_scores(spark, docs, empty):
    got = lm_scoring.score(docs.withColumn("text", F.upper("text")), held(), units=50, dim=4).collect()
    toks = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (r[1] or "").upper())) + [None]) for r in ROWS]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in toks if not out(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in toks:
        want[d, out(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)] += 1
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    rng = random.Random(2)
    chain = [VOCAB[i : i + 2] for i in range(0, 80, 2)]  # each word has two followers
    rows = []
    for i in range(400):
        at, words = rng.randrange(40), []
        for _ in range(60):
            words.append(chain[at][0])
            at = (at * 7 + rng.randrange(2)) % 40
        rows.append((i, " ".join(words)))
    told = [r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("b")), held(), units=64, dim=16).collect() if r.held_out]
    assert len(told) > 20 and sum(r.score for r in told) > sum(r.base_score for r in told) + 5 * len(told)
    assert lm_scoring.score(empty, held()).count() == 0
    nothing = lm_scoring.score(docs, F.lit(True), units=8).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.base_score == 0 for r in nothing)


@pytest.mark.parametrize("units, words", [(40, 6), (40, 39), (5, 1), (400, None)])
def test_lm_score_is_a_distribution_over_all_tokens(spark, docs, monkeypatch, units, words):
    """Every score again in plain Python from the trained parameters; all tokens and the classes' unseen entries sum to 1."""
    kept, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda blocks, names, start, edge: kept.append((names, edge, train(blocks, names, start, edge))) or kept[0][2])
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm_scoring.score(docs, held(), units=units, words=words, dim=4).collect())
    (names, edge, m), out = kept[0], lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    toks = [(d, [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [b""]) for d, t, *_ in ROWS]
    c = Counter(w for d, t in toks if not out(d) for w in t)
    unit = lambda w: names[0].index(w) + 1 if w in names[0] else names[1].index(w[-3:]) + 1 + len(names[0]) if w[-3:] in names[1] else 0
    of = {w: unit(w) for _, t in toks for w in t}
    z = np.array([0.0 if 1 <= u <= len(names[0]) else 0.1 for u in range(m.v)])
    for w, n in c.items():
        z[of[w]] += n + 0.1
    R, Q, C, b = (x.astype(float) for x in (m.R, m.Q, m.C, m.b))

    def units_given(h1, h2):
        x = Q @ (R[h1] * C[0] + R[h2] * C[1]) + b
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    known = {}
    want = Counter()
    for d, t in toks:
        h, total = [edge, edge] + [of[w] for w in t], 0.0
        for i, w in enumerate(t):
            key = h[i + 1], h[i]
            if key not in known:
                known[key] = units_given(*key)
            u = of[w]
            total += math.log10(known[key][u] * (1 if 1 <= u <= len(names[0]) else (c[w] + 0.1) / z[u]))
        want[d, round(total, 2)] += 1
    off = lambda x: sorted(((str(d), s) for (d, s), n in x.items() for _ in range(n)))
    assert [d for d, _ in off(got)] == [d for d, _ in off(want)] and np.allclose([s for _, s in off(got)], [s for _, s in off(want)], rtol=1e-4, atol=0.05)
    p = next(iter(known.values()))
    seen = sum(p[of[w]] * (1 if 1 <= of[w] <= len(names[0]) else (n + 0.1) / z[of[w]]) for w, n in c.items())
    unseen = sum(p[u] * 0.1 / z[u] for u in range(m.v) if not 1 <= u <= len(names[0]))
    assert abs(seen + unseen - 1) < 1e-6


def test_log_bilinear_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    v = 12
    w = [0]
    for _ in range(40_000):
        w.append((w[-1] + 1) % v if rng.random() < 0.8 else int(rng.integers(v)))
    w = np.array(w, np.int32)
    u = np.bincount(w, minlength=v) / len(w)
    m = lm_scoring.LogBilinear(u, 8)
    h1, h2 = np.roll(w, 1), np.roll(w, 2)
    before = m.log_probs(h1, h2, w).mean()
    for _ in range(3):
        m.train(h1, h2, w, np.full(m.size, 1e-6, np.float32), rng)
    assert m.log_probs(h1, h2, w).mean() > before + 0.8
    one = np.zeros(v, np.int32)
    assert np.isclose(np.exp(m.log_probs(one + 3, one + 2, np.arange(v, dtype=np.int32))).sum(), 1, atol=1e-4)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    item = sentence(rng, 20)
    good = [sentence(rng, 80) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(20, good[0], "en", "s", 1), (21, f"{good[3]} {item} {sentence(rng, 60)}", "en", "s", 1), (22, f"{sentence(rng, 70)} password = hunter22", "en", "s", 1), (23, "too short", "en", "s", 1), (None, None, None, None, None)]
    tables = {"documents": (rows, SCHEMA), "labels": ([(0, 1, 0)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, item)], "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left.append({r.doc_id for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secret_scans":
            assert docs.where("doc_id = 22").first().text.endswith("[secret]")
    every = set(range(12)) | {20, 21, 22}
    assert left == [every, every - {20}, every - {20, 21}, every - {20, 21}, every - {20, 21}]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 13


def test_a_sieve_loses_nothing_and_lets_few_pass(spark):
    rng = np.random.default_rng(3)
    given, other = (rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64) for _ in range(2))
    ids = spark.createDataFrame([(int(x),) for x in given], "id long")
    for most, share in ((1 << 27, 0.02), (1 << 18, 0.05)):
        passes = sieve(ids, "id", most).value
        assert passes(given).all() and passes(other).mean() < share
    rows = spark.createDataFrame([(int(x), "t") for x in np.concatenate([given[:500], other[:500]])], "id long, text string")
    kept = {r.id for r in sieved(rows, ids, "id").collect()}
    assert kept >= set(given[:500].tolist()) and len(kept) < 530
    assert not sieve(ids.where("false"), "id").value(other).any()


def jobs(spark, run):
    """What ``run`` returns, and the number of Spark jobs that it takes."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_steps_take_few_jobs_whatever_the_partitions(spark):
    """A sieve is collected at once, and few edges are settled without rounds; rounds, one task after a round and one task at once agree."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    ids = spark.range(2_000).select(F.xxhash64("id").alias("id"))
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(i, i + 1) for i in range(400, 420)] + [(500, x) for x in range(501, 540)]
    frame = spark.createDataFrame(edges, "a long, b long")
    named = frame.select(F.format_string("n%03d", "a").alias("a"), F.format_string("n%03d", "b").alias("b"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, n = jobs(spark, lambda: sieve(ids, "id").value)
        assert got(ids.toPandas()["id"].to_numpy()).all() and n < 10
        once, n = jobs(spark, lambda: {(r.node, r.component) for r in components(frame).collect()})
        assert n < 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for few in (0, 250):
        assert {(r.node, r.component) for r in components(frame, few=few).collect()} == once
    assert {(r.node, r.component) for r in components(named).collect()} == {(f"n{a:03d}", f"n{b:03d}") for a, b in once}


def shuffle_files(spark):
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    table = materialise(spark.range(5_000).groupBy((F.col("id") % 997).alias("k")).count(), "counts")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and table.count() == 997


def test_only_texts_of_superclusters_are_shuffled(spark):
    """Of 300 paragraphs two are alike; a few others may pass the sieve."""
    rng = random.Random(31)
    lines = [sentence(rng, 30) for _ in range(300)]
    lines.append(lines[7].replace(" ", " x ", 1))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = substring_dedup.occurrences(docs)
    tied = substring_dedup.ties(rows)
    assert tied.count() == 1
    wanted = materialise(components(tied).select(F.col("node").alias("id")), "wanted")
    got = [bytes(r.text).decode() for r in substring_dedup.paragraph_texts(docs, rows, wanted).collect()]
    assert {lines[7], lines[300]} <= set(got) and len(got) < 10
    # keys are taken from the words' hashes of whole stretches: those of each paragraph alone
    minhash, known = jaccard.MinHash(12), jaccard.WordHash()
    alone = {substring_dedup.scan([t.encode()], known)[0][3][0].item(): substring_dedup.band_keys([t.encode().split()], known, minhash, 2, 5)[0].view(np.int64).tolist() for t in lines}
    keys = {}
    for r in substring_dedup.bands(rows).collect():
        keys.setdefault(r.unit, []).append(r.key)
    assert keys == alone


def test_numbers_of_tokens_and_training_counts_of_a_block(spark, monkeypatch):
    """One count over a block, whatever the number of its texts."""
    seen = []
    count = np.bincount
    monkeypatch.setattr(lm_scoring.np, "bincount", lambda *a, **b: seen.append(1) or count(*a, **b))
    numbers = lm_scoring.Numbers({b"": 0})
    assert [numbers[w] for w in (b"a", b"b", b"a", b"")] == [1, 2, 1, 0] and list(numbers) == [b"", b"a", b"b"]

    class Frame:  # runs blocks_of's function here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.rows = list(run([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "held": [False, True, False], "text": ["a b A", "b c", None]})]))
            return self

    monkeypatch.setattr(lm_scoring, "materialise", lambda df, _: df)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    (block,) = lm_scoring.blocks_of(Frame(), F.lit(False)).rows
    assert dict(zip(block.column("vocab")[0].as_py(), block.column("train")[0].as_py(), strict=True)) == {b"": 2, b"a": 2, b"b": 1, b"c": 0}
    assert len(seen) == 1
