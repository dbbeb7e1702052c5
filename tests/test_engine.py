"""Operators against golden values, against plain Python, and against each other."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphfold.operators import candidates, commit, divide, encode, gain, matching, quotient
from graphfold.plans.engine import SummarizeConfig, summarize
from graphfold.sources import graphs, sinks

K2 = [(0, 1)]
P3 = [(0, 1), (1, 2)]
K3 = [(0, 1), (0, 2), (1, 2)]
C4 = [(0, 1), (1, 2), (2, 3), (0, 3)]
S4 = [(0, i) for i in range(1, 5)]
K4 = list(itertools.combinations(range(4), 2))
K4E = [e for e in K4 if e != (2, 3)]
TWO = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long").repartition(2)


def state(spark, edges, labels=None):
    e = frame(spark, edges)
    n = 1 + max(v for _, v in edges)
    p = spark.createDataFrame(list(enumerate(labels or range(n))), "node long, rep long")
    return e, commit.State(p, quotient.quotient(e, p), quotient.supernode_sizes(p))


def bc(sa, sb, e, inside=False):
    return min(e, 1 + (sa * (sa - 1) // 2 if inside else sa * sb) - e)


def py_cost(edges, labels):
    size, count = {}, {}
    for r in labels:
        size[r] = size.get(r, 0) + 1
    for u, v in edges:
        k = tuple(sorted((labels[u], labels[v])))
        count[k] = count.get(k, 0) + 1
    return sum(bc(size[a], size[b], e, a == b) for (a, b), e in count.items())


@pytest.mark.parametrize(("edges", "labels", "cost"), [(C4, None, 4), (TWO, None, 7), (C4, [0, 1, 0, 1], 1), (K3, [0] * 3, 1), (K4, [0] * 4, 1), (K4E, [0] * 4, 2), (S4, [0, 1, 1, 1, 1], 1), (TWO, [0, 0, 0, 3, 3, 3], 3)])
def test_partition_cost(spark, edges, labels, cost):
    _, s = state(spark, edges, labels)
    assert s.cost() == cost


MAGS = [(K2, None, (0, 1), 0, 1, 0), (P3, None, (0, 2), 1, 2, 2), (P3, None, (0, 1), 0, 2, 1), (K3, None, (0, 1), 1, 3, 2), (C4, None, (0, 2), 2, 4, 4), (C4, None, (0, 1), 0, 3, 2), (C4, [0, 1, 0, 3], (1, 3), 1, 2, 2), (TWO, [0, 0, 0, 3, 3, 3], (0, 3), -4, 3, -4)]
LEGACY = [(0, 2), (1, 2), (0, 3), (1, 4), (2, 4), (0, 4), (1, 2), (-16, -2)]


@pytest.mark.parametrize("case", range(len(MAGS)))
def test_gains(spark, case):
    edges, labels, (a, b), g, before, ub = MAGS[case]
    _, s = state(spark, edges, labels)
    pair = spark.createDataFrame([(a, b)], "a long, b long")
    assert gain.exact_gain(pair, s.blocks, s.sizes).select("gain", "before_cost").first()[:] == (g, before)
    assert gain.upper_bound(pair, s.blocks, s.sizes).select("before_cost", "upper_bound").first()[:] == (before, ub)
    assert gain.legacy_gain(pair, s.blocks, s.sizes).select("gain", "before_cost").first()[:] == LEGACY[case]


def random_graph(seed, n=24, p=0.25):
    rng = random.Random(seed)
    edges = [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p] or [(0, n - 1)]
    if max(v for _, v in edges) < n - 1:
        edges.append((0, n - 1))
    reps = sorted({0, *rng.sample(range(n), 9)})
    labels = [i if i in reps else rng.choice([r for r in reps]) for i in range(n)]
    return sorted(set(edges)), labels


@pytest.mark.parametrize("seed", range(3))
def test_gain_is_the_change_of_the_global_cost(spark, seed):
    edges, labels = random_graph(seed)
    _, s = state(spark, edges, labels)
    pairs = [(a, b) for a, b in itertools.combinations(sorted(set(labels)), 2)]
    got = {(r.a, r.b): r.gain for r in gain.exact_gain(spark.createDataFrame(pairs, "a long, b long"), s.blocks, s.sizes).collect()}
    bound = {(r.a, r.b): r.upper_bound for r in gain.upper_bound(spark.createDataFrame(pairs, "a long, b long"), s.blocks, s.sizes).collect()}
    base = py_cost(edges, labels)
    assert len(got) == len(pairs)
    for a, b in pairs:
        want = base - py_cost(edges, [a if r == b else r for r in labels])
        assert got[a, b] == want <= bound[a, b]


def test_proxy_on_a_square(spark):
    _, s = state(spark, C4)
    g = s.sizes.select("rep", F.lit("g").alias("group"), F.col("rep").alias("idx"))
    got = {(r.a, r.b): (r.proxy_gain, r.proxy_ratio) for r in candidates.proxy(s.blocks, s.sizes, g).collect()}
    assert got == {(0, 2): (2, 0.5), (1, 3): (2, 0.5), (0, 1): (1, 0.25), (1, 2): (1, 0.25), (2, 3): (1, 0.25), (0, 3): (1, 0.25)}
    assert {(r.a, r.b) for r in candidates.top_k(candidates.proxy(s.blocks, s.sizes, g), g, 1).collect()} == {(0, 2), (1, 3)}
    _, s = state(spark, TWO, [0, 0, 0, 3, 3, 3])
    assert {r.rep: r.old_cost for r in candidates.old_costs(s.blocks, s.sizes).collect()} == {0: -1, 3: -1}


def test_merging_equals_rebuilding(spark):
    edges, labels = random_graph(7)
    e, s = state(spark, edges, labels)
    reps = sorted(set(labels))
    merges = spark.createDataFrame([(reps[0], reps[1]), (reps[2], reps[5])], "keep long, remove long")
    new = commit.apply_merges(s, merges)
    assert quotient.difference(new.blocks, quotient.quotient(e, new.partition)).isEmpty()
    assert sorted(new.sizes.collect()) == sorted(quotient.supernode_sizes(new.partition).collect())
    assert quotient.is_valid(new.partition) == quotient.is_valid(s.partition)


def scored(spark, seed, n=30, groups=3):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.2:
                rows.append((f"g{g}", a, b, 1000 * g + a, 1000 * g + b, rng.randint(1, 6), 10))
    return rows, spark.createDataFrame(rows, "group string, a_idx long, b_idx long, a long, b long, gain long, before_cost long")


@pytest.mark.parametrize("seed", range(2))
def test_matchings_are_greedy(spark, seed):
    rows, df = scored(spark, seed)
    want, used = set(), set()
    for _, _, _, a, b, _, _ in sorted(rows, key=lambda r: (r[0], -r[5], r[1], r[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in matching.greedy(df.repartition(3)).collect()} == want
    assert {(r.a, r.b) for r in matching.locally_dominant(df).collect()} == want
    assert {(r.a, r.b) for r in matching.best_partners(df).collect()} <= want


def test_transactional_commits_realise_what_they_claim(spark):
    edges, _ = random_graph(5, 18, 0.4)
    _, s = state(spark, edges)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 18, 2)], "keep long, remove long")
    for policy in ("s1", "t4"):
        done, audit = commit.transactional(s, pairs, policy)
        merges = spark.createDataFrame(done or [(0, 0)], "keep long, remove long").where("keep <> remove")
        assert s.cost() - commit.apply_merges(s, merges).cost() == audit[-1]["cumulative_realized_gain"]
        assert len(done) + sum(a["rejected_pair_count"] for a in audit) == 9
    with pytest.raises(ValueError, match="policy g0"):
        commit.transactional(s, pairs, "s1", max_pairs=3)


@pytest.mark.parametrize("objective", ["mags", "legacy"])
@pytest.mark.parametrize("seed", range(2))
def test_encoding_is_lossless(spark, objective, seed):
    edges, labels = random_graph(seed + 20, 20, 0.6)
    e, s = state(spark, edges, labels)
    x = encode.encode(e, s.partition, objective)
    assert encode.difference(e, x).isEmpty()
    m = encode.metrics(x, len(edges)).first()
    if objective == "mags":
        assert m.cost_standard == py_cost(edges, labels) and m.cost_x2 == 2 * m.cost_standard
    else:
        assert m.cost_x2 == 2 * m.cost_standard - m.superedges_loop
    ids = sorted({r.sid for r in x.members.collect()})
    assert ids == list(range(len(set(labels))))


def py_drop(cp, cm, p, members, degree, eps):
    left = {n: int(eps * degree.get(n, 0)) for ns in members.values() for n in ns}
    out = []
    for part in (sorted(cp), sorted(cm)):
        keep = []
        for u, v in part:
            if left[u] >= 1 and left[v] >= 1:
                left[u] -= 1
                left[v] -= 1
            else:
                keep.append((u, v))
        out.append(set(keep))
    keep = set()
    for a, b in sorted(p, key=lambda x: (len(members[x[0]]) * len(members[x[1]]), *x)):
        A, B = members[a], members[b]
        if a != b and all(left[n] >= len(B) for n in A) and all(left[n] >= len(A) for n in B):
            for n in A:
                left[n] -= len(B)
            for n in B:
                left[n] -= len(A)
        else:
            keep.add((a, b))
    return [*out, keep]


def test_drop_equals_the_sequential_scan(spark):
    edges, labels = random_graph(33, 20, 0.55)
    e, s = state(spark, edges, labels)
    x = encode.encode(e, s.partition)
    x = encode.Encoding(x.members.cache(), x.P.cache(), x.Cp.cache(), x.Cm.cache())
    members, degree = {}, {}
    for r in x.members.collect():
        members.setdefault(r.sid, []).append(r.node)
    for u, v in edges:
        degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
    rows = lambda d: {tuple(r) for r in d.collect()}
    for eps in (0.25, 0.4):
        y = encode.drop(x, e, eps)
        want = py_drop(rows(x.Cp), rows(x.Cm), rows(x.P), members, degree, eps)
        assert [rows(y.Cp), rows(y.Cm), rows(y.P)] == want
    assert encode.drop(x, e, 0) is x


def test_divide_respects_the_limit_and_loses_no_one(spark):
    edges, _ = random_graph(11, 40, 0.1)
    e, s = state(spark, edges)
    g = divide.divide(e, s.partition, 1, dims=2, limit=5).collect()
    assert sorted(r.rep for r in g) == list(range(40))
    sizes = {}
    for r in g:
        sizes[r.group] = sizes.get(r.group, 0) + 1
    assert max(sizes.values()) <= 5
    one = spark.createDataFrame([(i, "x") for i in range(23)], "rep long, group string")
    r = divide.refine_overflow(e, s.partition, one, 4, 1, 9).collect()
    assert sorted(x.rep for x in r) == list(range(23))
    c = divide.rep_chunks(one, 4).collect()
    assert all(x.group == f"x/{x.rep // 4}" and x.idx == x.rep for x in c)


@pytest.mark.parametrize("settings", [{}, {"cost_objective": "legacy"}, {"certification": "safe", "use_threshold": True, "threshold_policy": "adaptive"}, {"candidate_index": "quotient-neighbor"}, {"candidate_index": "residual-signature", "commit_policy": "t2"}, {"error_bound": 0.4, "commit_audit": True, "validate_quotient": True}])
def test_summaries_are_lossless_within_the_bound(spark, settings):
    cliques = [c for k in range(0, 12, 4) for c in itertools.combinations(range(k, k + 4), 2)] + [(3, 4), (7, 8)]
    e = frame(spark, cliques)
    turns = 1 if settings.keys() & {"candidate_index", "cost_objective"} else 2  # an adaptive threshold lets no pair pass in the first one
    s = summarize(e, SummarizeConfig(iterations=turns, **settings))
    lost = encode.difference(e, s.encoding).count()
    if settings.get("error_bound"):
        assert lost <= 0.4 * len(cliques) and s.audit
    else:
        assert lost == 0
        assert s.metrics["cost_standard"] < len(cliques)
    assert s.metrics["edges"] == len(cliques) and s.profile_frame().count() == turns


def test_config_rejects_what_can_not_go_together():
    for bad in ({"commit_policy": "s1", "cost_objective": "legacy"}, {"certification": "safe", "candidate_index": "quotient-neighbor"}, {"scoring_backend": "cuda"}, {"threshold_policy": "x"}, {"candidate_budget": 0}, {"validate_quotient": True, "state_backend": "legacy"}):
        with pytest.raises(ValueError):
            SummarizeConfig(**bad)


def test_edge_list_source(spark, tmp_path):
    def write(text):
        p = tmp_path / f"{abs(hash(text))}.txt"
        p.write_text(text)
        return str(p)

    good = graphs.read_edge_list(spark, write("# c\n\n 3 1 extra\n\t0\t5\r\n"))
    assert sorted(good.collect()) == [(0, 5), (1, 3)]
    assert graphs.node_domain(good).count() == 6 and graphs.check_arc_count(good) == 4
    assert graphs.has_arcs(good, spark.createDataFrame([(3, 1), (2, 1)], "u long, v long")).count() == 1
    for bad in ("", "a b\n", "1\n", "-1 2\n", "3 3\n", "1 2147483648\n", "0 1\n1 0\n"):
        with pytest.raises(ValueError):
            graphs.read_edge_list(spark, write(bad + "# x\n"))
    assert graphs.read_edge_list(spark, write("0 1\n1 0\n"), duplicates="drop").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from graphfold.__main__ import run

    g = tmp_path / "squares" / "g.txt"
    g.parent.mkdir()
    g.write_text("".join(f"{u} {v}\n" for k in (0, 4) for u, v in itertools.combinations(range(k, k + 4), 2)) + "3 4\n")
    paths = [f"--{n}={tmp_path / n}" for n in ("out", "results", "profile", "audit")]
    for turn in (1, 2):
        m = run(spark, [str(g), "--iterations", "2", "--commit-policy", "t2", *(paths if turn == 1 else paths[1:])])
    assert f"metric.cost_standard={m['cost_standard']}" in capsys.readouterr().out and m["cost_standard"] < 13
    results = spark.read.csv(str(tmp_path / "results"), header=True)
    assert results.count() == 2 and {r.dataset for r in results.collect()} == {"squares"}
    assert spark.read.csv(str(tmp_path / "profile"), header=True).count() == 4
    audit = spark.read.csv(str(tmp_path / "audit"), header=True)
    assert audit.columns == list(sinks.AUDIT_COLUMNS) and audit.count() >= 2
    assert spark.read.text(str(tmp_path / "out" / "G.txt")).count() == m["supernodes"]
    with pytest.raises(ValueError):
        run(spark, [str(g), "--commit-policy", "s1", "--cost-objective", "legacy"])


def test_sinks(spark, tmp_path):
    e, s = state(spark, TWO, [0, 0, 0, 3, 3, 3])
    x = encode.encode(e, s.partition)
    sinks.write_summary(x, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/G.txt")).collect()) == ["0\t0\t1\t2", "1\t3\t4\t5"]
    assert spark.read.csv(str(tmp_path / "out/Cp.txt"), sep="\t").count() == 1
    sinks.write_summary(x, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq/G.parquet")).count() == 2
    m = encode.metrics(x, 7)
    sinks.append_csv(m, str(tmp_path / "m.csv"))
    sinks.append_csv(m, str(tmp_path / "m.csv"))
    assert spark.read.csv(str(tmp_path / "m.csv"), header=True).count() == 2
    with pytest.raises(ValueError, match="header"):
        sinks.append_csv(m.drop("cp"), str(tmp_path / "m.csv"))
    assert sinks.dataset_label("/a/b/c.txt") == "b" and sinks.dataset_label("c.txt") == "c"
