"""The summarizer: divide, propose, score, match, commit, again and again; then encode."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphfold.checkpoint import discard, materialise
from graphfold.functions.hashing import partition_hash
from graphfold.functions.thresholds import ThresholdState
from graphfold.operators import candidates, commit, divide, encode, gain, matching, quotient
from graphfold.sources.graphs import node_domain
from graphfold.sources.sinks import AUDIT_COLUMNS


@dataclass(frozen=True)
class SummarizeConfig:
    """All settings; values that can't go together raise ValueError."""

    iterations: int = 20
    seed: int = 1
    cost_objective: str = "mags"  # or legacy
    state_backend: str = "persistent"  # or legacy: the same results, as tables are immutable here
    merge_mode: str = "batch-ea-blocked"  # or batch-ea; both run as one block per iteration
    scoring_backend: str = "cpu"
    candidate_index: str = "legacy"  # or quotient-neighbor, residual-signature
    candidate_budget: int = 8
    certification: str = "off"  # or safe
    commit_policy: str = "g0"  # or s1 t2 t4 t8 m4
    commit_audit: bool = False
    quotient_update: str = "auto"  # incremental and bulk_rebuild mean the same here
    validate_quotient: bool = False
    top_k: int = 16
    use_threshold: bool = False
    threshold_policy: str = "reciprocal"  # or mags-geom, adaptive
    threshold_high: float = 0.5
    threshold_low: float = 0.005
    threshold_min_low: float = 0.005
    adaptive_q_high: float = 0.85
    adaptive_q_low: float = 0.15
    adaptive_sample_limit: int = 4096
    acceptance_target: float = 0.15
    divide_hash_dims: int = 16
    divide_max_group: int = 512
    overflow_group_gmax: int = 0
    overflow_refine_rounds: int = 0
    error_bound: float = 0.0

    def __post_init__(self):
        choices = {
            "cost_objective": ("mags", "legacy"), "state_backend": ("persistent", "legacy"), "merge_mode": ("batch-ea", "batch-ea-blocked"), "scoring_backend": ("cpu",), "candidate_index": ("legacy", "quotient-neighbor", "residual-signature"),
            "certification": ("off", "safe"), "commit_policy": ("g0", *commit.MICRO_BATCH), "quotient_update": ("auto", "incremental", "bulk_rebuild"), "threshold_policy": ("reciprocal", "mags-geom", "adaptive"),
        }
        for k, allowed in choices.items():
            if getattr(self, k) not in allowed:
                raise ValueError(f"{k} must be one of {allowed}, not {getattr(self, k)!r}")
        rules = [
            (self.iterations < 0 or self.candidate_budget < 1 or self.top_k < 1 or self.divide_max_group < 1 or self.divide_hash_dims < 1, "counts must be positive"),
            (self.commit_policy != "g0" and (self.cost_objective != "mags" or self.state_backend != "persistent"), "commit policies need the mags objective and the persistent state"),
            (self.candidate_index != "legacy" and self.state_backend != "persistent", "candidate indexes need the persistent state"),
            (self.certification == "safe" and (self.cost_objective != "mags" or self.state_backend != "persistent" or self.candidate_index != "legacy"), "certification needs the persistent state, the mags objective and the legacy index"),
            (self.validate_quotient and self.state_backend != "persistent", "validation needs the persistent state"),
        ]
        for wrong, why in rules:
            if wrong:
                raise ValueError(why)


@dataclass
class Summary:
    partition: DataFrame
    encoding: encode.Encoding
    metrics: dict
    profile: list[dict] = field(default_factory=list)
    audit: list[dict] = field(default_factory=list)

    def profile_frame(self) -> DataFrame:
        return self.partition.sparkSession.createDataFrame([Row(**p) for p in self.profile])

    def audit_frame(self, dataset: str, policy: str) -> DataFrame:
        """One row per commit batch, in the columns of the audit file."""
        rows = [[{"dataset": dataset, "commit_policy": policy, **a}[c] for c in AUDIT_COLUMNS] for a in self.audit]
        return self.partition.sparkSession.createDataFrame(rows, "dataset string, commit_policy string, batch_id long, batch_size long, partition_exact_cost long, cumulative_realized_gain long, rejected_pair_count long")

    def result_frame(self, dataset: str, cfg: SummarizeConfig) -> DataFrame:
        """One row: the data set, all settings and all metrics."""
        return self.partition.sparkSession.createDataFrame([Row(dataset=dataset, **asdict(cfg), **self.metrics, seconds=sum(p["seconds"] for p in self.profile))])


def propose(edges: DataFrame, state: commit.State, cfg: SummarizeConfig, t: int) -> DataFrame:
    """(group, a_idx, b_idx, a, b) of one iteration; in-group search adds the joint costs that it has met."""
    if cfg.candidate_index == "legacy":
        groups = divide.divide(edges, state.partition, t, cfg.divide_hash_dims, cfg.divide_max_group, cfg.seed)
        groups = materialise(divide.refine_overflow(edges, state.partition, groups, cfg.overflow_group_gmax, cfg.overflow_refine_rounds, cfg.seed * 1000 + t) if cfg.overflow_group_gmax else groups, "groups")
        # groups of one can't merge
        several = groups.groupBy("group").count().where("count > 1").select("group")
        groups = groups.join(several, "group", "left_semi")
        pairs = candidates.top_k(candidates.proxy(state.blocks, state.sizes, groups), groups, cfg.top_k)
        ia, ib = groups.select(F.col("rep").alias("a"), F.col("idx").alias("a_idx")), groups.select(F.col("rep").alias("b"), F.col("idx").alias("b_idx"))
        return pairs.join(ia, "a").join(ib, "b").select("group", "a_idx", "b_idx", "a", "b", "joint")
    make = candidates.neighbour_proposals if cfg.candidate_index == "quotient-neighbor" else candidates.residual_proposals
    p = make(state.blocks, state.sizes, cfg.candidate_budget, cfg.seed ^ t)
    low, high = F.least("source", "target"), F.greatest("source", "target")
    return p.select(F.lit("").alias("group"), low.alias("a_idx"), high.alias("b_idx"), low.alias("a"), high.alias("b")).distinct()


def score(pairs: DataFrame, state: commit.State, cfg: SummarizeConfig, theta: float | None) -> DataFrame:
    """pairs with gain and before_cost under the objective; certification drops pairs that can't gain."""
    ab = pairs.drop("group", "a_idx", "b_idx").distinct()
    if cfg.cost_objective == "legacy":
        got = gain.legacy_gain(ab, state.blocks, state.sizes)
    else:
        if cfg.certification == "safe":
            ab = ab.join(gain.certified(ab, state.blocks, state.sizes, theta or 0.0).select("a", "b"), ["a", "b"], "left_semi")
        got = gain.exact_gain(ab, state.blocks, state.sizes)
    return pairs.join(got, ["a", "b"]).select("group", "a_idx", "b_idx", "a", "b", "gain", "before_cost")


def summarize(edges: DataFrame, cfg: SummarizeConfig | None = None) -> Summary:
    """Summarize one undirected graph. Each iteration is one bulk-synchronous block; all state between iterations is in written tables."""
    cfg = cfg or SummarizeConfig()
    spark = edges.sparkSession
    edges = materialise(edges.select("u", "v"), "edges")
    m = edges.count()
    part = materialise(quotient.singletons(node_domain(edges)), "partition")
    state = commit.State(part, materialise(quotient.quotient(edges, part), "blocks"), materialise(quotient.supernode_sizes(part), "sizes"))
    limits = ThresholdState(cfg.threshold_policy, cfg.threshold_high, cfg.threshold_low, cfg.threshold_min_low, cfg.adaptive_q_high, cfg.adaptive_q_low, cfg.acceptance_target)
    profile, audit = [], []
    cost = state.cost()
    for t in range(1, cfg.iterations + 1):
        began = time.time()
        theta = limits.at(t, cfg.iterations)
        pairs = materialise(propose(edges, state, cfg, t), "pairs")  # scoring reads them more than once
        scored = materialise(score(pairs, state, cfg, theta if cfg.use_threshold else None), "scored")
        passed = matching.threshold_filter(scored, theta if cfg.use_threshold else None)
        # proposals of an index may cross groups, so pairs must be disjoint as a whole
        selected = materialise(matching.greedy(passed) if cfg.candidate_index == "legacy" else matching.locally_dominant(passed, []), "selected")
        merges = matching.to_merges(selected)
        tested, positive = scored.agg(F.count("*"), F.count_if(F.col("gain") > 0)).first()
        n = selected.count()
        accepted = passed.count() if cfg.use_threshold or cfg.threshold_policy == "adaptive" else positive
        limits.end(matching.saving_samples(scored, cfg.adaptive_sample_limit) if cfg.threshold_policy == "adaptive" else [], tested, accepted)
        merged = n
        if n:
            if cfg.commit_policy != "g0":
                done, log = commit.transactional(state, merges, cfg.commit_policy)
                audit.extend({"iteration": t, **x, "partition_exact_cost": cost - x["cumulative_realized_gain"]} for x in log)
                merged = len(done)
                merges = spark.createDataFrame(done, "keep long, remove long") if done else merges.limit(0)
            state = commit.apply_merges(state, merges)
            if cfg.validate_quotient and not quotient.difference(state.blocks, quotient.quotient(edges, state.partition)).isEmpty():
                raise RuntimeError("the maintained quotient graph differs from a rebuilt one")
        new = state.cost()
        if n and cfg.commit_policy != "g0" and log[-1]["cumulative_realized_gain"] != cost - new:
            raise RuntimeError(f"merges claim {log[-1]['cumulative_realized_gain']}, the cost fell by {cost - new}")
        if cfg.commit_audit and cfg.commit_policy == "g0":
            audit.append({"iteration": t, "batch_id": 0, "batch_size": n, "cumulative_realized_gain": cost - new, "rejected_pair_count": 0, "partition_exact_cost": new})
        discard(pairs, scored, selected)
        profile.append({"iteration": t, "threshold": theta, "candidate_pairs": tested, "positive_pairs": positive, "accepted_pairs": accepted, "selected_pairs": n, "committed_pairs": merged, "partition_exact_cost": new, "cost_reduction": cost - new, "relative_size": new / m if m else 0.0, "seconds": time.time() - began})
        cost = new
    e = encode.encode(edges, state.partition, cfg.cost_objective)
    e = encode.Encoding(*(materialise(x, "encoding") for x in (e.members, e.P, e.Cp, e.Cm)), e.objective)
    e = encode.drop(e, edges, cfg.error_bound)
    out = encode.metrics(e, m).first().asDict()
    if cfg.cost_objective == "mags" and cfg.error_bound <= 0 and out["cost_standard"] != cost:
        raise RuntimeError(f"the encoding costs {out['cost_standard']}, the partition {cost}")
    return Summary(state.partition, e, out | {"edges": m, "partition_exact_cost": cost, "supernodes": state.sizes.count()}, profile, audit)


def fingerprint(partition: DataFrame) -> int:
    """partition_hash() over labels in node order; streams to the driver."""
    return partition_hash(r.rep for r in partition.orderBy("node").toLocalIterator())
