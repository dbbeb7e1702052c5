"""Registry of the engine's queries, each with the same question in SQL.

Graphs come from the tables: parts that share an order, suppliers that share an order (once, or more often than the average pair), and bipartite ones. Queries on a partition use
rep = node mod k; queries on groups use min-hashes under the portable hash, which any SQL engine can repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.checkpoint import materialise, scratch_dir
from graphfold.functions import hashing
from graphfold.functions.hashing import portable_hash
from graphfold.functions.thresholds import ThresholdState
from graphfold.operators import candidates, commit, divide, encode, gain, matching, quotient
from graphfold.plans.engine import SummarizeConfig, fingerprint, summarize
from graphfold.sources import graphs, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Graph -> supernodes of its fixed partition (rep = node mod k).
SUPERNODES = {"copurchase": 250, "supp_cooccur": 50, "supp_strong": 7}
#: Supernodes and groups of the finer partition of the dense graph, on which members of a group share neighbours in dense blocks.
FINE, FINE_GROUPS = 60, 3


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["partition_cost"](spark, sf_dir)


# --- inputs -------------------------------------------------------------------------------------------------------------


class Setup:
    """A graph under its fixed partition."""

    def __init__(self, spark: SparkSession, sf_dir: str, which: str = "copurchase", k: int | None = None):
        self.edges = materialise(getattr(graphs, which)(spark, sf_dir), "edges")  # read several times below
        self.nodes = graphs.node_domain(self.edges)
        self.partition = quotient.modulo_partition(self.nodes, k or SUPERNODES[which])
        self.blocks = materialise(quotient.quotient(self.edges, self.partition), "blocks")
        self.sizes = quotient.supernode_sizes(self.partition)

    def ranked(self, *constants: int) -> DataFrame:
        return self.nodes.select("node", portable_hash(F.col("node"), *constants).alias("r"))

    def groups(self) -> DataFrame:
        """Reps with equal min-hash of their members' neighbourhoods, modulo 8 so that groups have several members."""
        h = divide.supernode_minhash(self.edges, self.partition, self.ranked())
        return h.select("rep", (F.col("minhash") % 8).cast("string").alias("group"), F.col("rep").alias("idx"))

    def few(self) -> DataFrame:
        """A few groups by the reps' own hash: in a dense graph all min-hashes are alike."""
        return self.sizes.select("rep", (portable_hash(F.col("rep")) % FINE_GROUPS).cast("string").alias("group"), F.col("rep").alias("idx"))

    def pairs(self) -> DataFrame:
        """All pairs of supernodes with an edge between them."""
        return self.blocks.where("a <> b").select("a", "b")


def _edges_sql(item: str) -> str:
    return f"it AS (SELECT DISTINCT l_orderkey AS k, {item} AS i FROM lineitem), edges AS (SELECT DISTINCT x.i AS u, y.i AS v FROM it x JOIN it y ON x.k = y.k AND x.i < y.i)"


PARTS, SUPP = _edges_sql("l_partkey"), _edges_sql("l_suppkey")
STRONG = "it AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), co AS (SELECT x.i AS u, y.i AS v, count(*) AS c FROM it x JOIN it y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2), edges AS (SELECT u, v FROM co WHERE c * (SELECT count(*) FROM co) >= (SELECT sum(c) FROM co))"
ARCS = "arcs AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges)"
NODES = "nodes AS (SELECT unnest(range((SELECT max(v) + 1 FROM edges))) AS node)"


def _state_sql(edges: str, k: int) -> str:
    return (
        f"{edges}, {ARCS}, {NODES}, lab AS (SELECT node, node % {k} AS rep FROM nodes), sizes AS (SELECT rep, count(*) AS size FROM lab GROUP BY rep), "
        "blocks AS (SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, count(*) AS edges FROM edges e JOIN lab x ON x.node = e.u JOIN lab y ON y.node = e.v GROUP BY 1, 2), "
        f"costs AS (SELECT k.a, k.b, k.edges, x.size AS sa, y.size AS sb, {_bc('x.size', 'y.size', 'k.edges', 'k.a = k.b')} AS cost FROM blocks k JOIN sizes x ON x.rep = k.a JOIN sizes y ON y.rep = k.b), "
        "nrow AS (SELECT a AS rep, b AS nbr, edges FROM blocks WHERE a <> b UNION ALL SELECT b, a, edges FROM blocks WHERE a <> b), "
        "arow AS (SELECT * FROM nrow UNION ALL SELECT a, b, edges * 2 FROM blocks WHERE a = b)"
    )


def _cap(sa: str, sb: str, inside: str) -> str:
    return f"CASE WHEN {inside} THEN ({sa}) * (({sa}) - 1) // 2 ELSE ({sa}) * ({sb}) END"


def _bc(sa: str, sb: str, e: str, inside: str = "false") -> str:
    return f"least({e}, 1 + {_cap(sa, sb, inside)} - ({e}))"


P, C, S = (f"WITH {_state_sql(e, SUPERNODES[k])}" for e, k in ((PARTS, "copurchase"), (SUPP, "supp_cooccur"), (STRONG, "supp_strong")))
HASH = "(48271 * ({x} + 1) + 12345) % 2147483647"
SHINGLE = f"closed AS (SELECT u AS node, v AS w FROM arcs UNION ALL SELECT node, node FROM nodes), shingle AS (SELECT node, min({HASH.format(x='w')}) AS shingle FROM closed GROUP BY node)"
MINHASH = f"{SHINGLE}, mh AS (SELECT rep, min(shingle) AS minhash FROM shingle JOIN lab USING (node) GROUP BY rep)"
GROUPS = f"{MINHASH}, grp AS (SELECT rep, CAST(minhash % 8 AS VARCHAR) AS g FROM mh)"
D = f"WITH {_state_sql(STRONG, FINE)}"
FEW = f"grp AS (SELECT rep, CAST({HASH.format(x='rep')} % {FINE_GROUPS} AS VARCHAR) AS g FROM sizes)"
PAIRS = "pairs AS (SELECT a, b FROM blocks WHERE a <> b)"
#: The 64-bit mixer and the ranks in 128-bit arithmetic; the multipliers are those of functions.hashing.
_MASK = "18446744073709551616::HUGEINT"


def _mix_sql(x: str) -> str:
    a = f"(({x} + {hashing.C1}::HUGEINT) % {_MASK})"
    low = lambda v, n: f"xor({v}, {v} >> {n})"
    # one level per step, so that the text stays short
    return f"(SELECT {low('z3', 31)} FROM (SELECT {_times('y2', hashing.C3)} AS z3 FROM (SELECT {low('z2', 27)} AS y2 FROM (SELECT {_times('y1', hashing.C2)} AS z2 FROM (SELECT {low('z1', 30)} AS y1 FROM (SELECT {a} AS z1))))))"


def _times(x: str, c: int) -> str:
    """x * c modulo 2**64 without leaving 128 bits: the halves of c one by one."""
    return f"((({x} * {c >> 32}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT + ({x} * {c & 0xFFFFFFFF}::HUGEINT) % {_MASK}) % {_MASK}"


def _rank_sql(node: str, rest: int) -> str:
    return _mix_sql(f"xor({_times(f'({node} + 1)::HUGEINT', hashing.C1)}, {rest}::HUGEINT)")


_SIGN = "CASE WHEN {x} >= 9223372036854775808::HUGEINT THEN ({x} - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


# --- sources ------------------------------------------------------------------------------------------------------------


@query(f"WITH {PARTS} SELECT u, v FROM edges")
def edges_copurchase(spark, sf_dir):
    return graphs.copurchase(spark, sf_dir)


@query(f"WITH {STRONG} SELECT u, v FROM edges")
def edges_supp_strong(spark, sf_dir):
    return graphs.supp_strong(spark, sf_dir)


@query(f"WITH {SUPP} SELECT u, v FROM edges")
def edges_supp_cooccur(spark, sf_dir):
    return graphs.supp_cooccur(spark, sf_dir)


@query("SELECT DISTINCT l_suppkey AS u, l_partkey + (SELECT max(s_suppkey) + 1 FROM supplier) AS v FROM lineitem")
def edges_supp_part(spark, sf_dir):
    return graphs.supp_part(spark, sf_dir)


@query("SELECT DISTINCT o_custkey AS u, l_partkey + (SELECT max(c_custkey) + 1 FROM customer) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def edges_cust_part(spark, sf_dir):
    return graphs.cust_part(spark, sf_dir)


@query("SELECT DISTINCT o_custkey AS u, l_suppkey + (SELECT max(c_custkey) + 1 FROM customer) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def edges_cust_supp(spark, sf_dir):
    return graphs.cust_supp(spark, sf_dir)


@query(f"WITH {SUPP}, {ARCS} SELECT u, v FROM arcs")
def arcs(spark, sf_dir):
    return graphs.arcs(graphs.supp_cooccur(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT o_custkey AS u, l_partkey + (SELECT max(c_custkey) + 1 FROM customer) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT unnest(range((SELECT max(v) + 1 FROM e))) AS node), d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node) SELECT n.node, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (node)")
def node_domain_degree(spark, sf_dir):
    e = graphs.cust_part(spark, sf_dir)
    return graphs.node_domain(e).join(graphs.degrees(e), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


@query(f"WITH {PARTS}, {ARCS} SELECT u AS node, count(*) AS degree FROM arcs GROUP BY u ORDER BY degree DESC, node LIMIT 10")
def degree_top10(spark, sf_dir):
    return graphs.degrees(graphs.copurchase(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(10)


@query(f"WITH {SUPP}, {ARCS} SELECT node AS u, node + 1 AS v FROM (SELECT unnest(range((SELECT max(v) + 1 FROM edges))) AS node) WHERE EXISTS (SELECT 1 FROM arcs WHERE u = node AND v = node + 1)")
def arc_probe(spark, sf_dir):
    e = materialise(graphs.supp_cooccur(spark, sf_dir), "edges")
    return graphs.has_arcs(e, graphs.node_domain(e).select(F.col("node").alias("u"), (F.col("node") + 1).alias("v")))


@query(f"WITH {PARTS} SELECT 2 * count(*) AS arcs FROM edges")
def arc_count(spark, sf_dir):
    return spark.createDataFrame([(graphs.check_arc_count(graphs.copurchase(spark, sf_dir)),)], "arcs long")


@query(f"WITH {SUPP} SELECT u, v FROM edges")
def edge_list_text(spark, sf_dir):
    """The graph as a text file with comments, blank lines, turned ends and further tokens, read back."""
    path = f"{scratch_dir(spark)}/edges-{uuid.uuid4().hex}.txt"
    line = F.when(F.col("u") % 3 == 0, F.concat_ws("\t", "v", "u", F.lit("x"))).otherwise(F.concat(F.lit("  "), F.col("u"), F.lit(" "), F.col("v"), F.lit(" \r")))
    text = graphs.supp_cooccur(spark, sf_dir).select(line.alias("value")).unionByName(spark.createDataFrame([("# comment",), ("",), ("  \t",)], "value string"))
    text.write.text(path)
    return graphs.read_edge_list(spark, path)


@query(f"WITH {PARTS}, {NODES} SELECT node, {_SIGN.format(x='r')} AS r FROM (SELECT node, {_rank_sql('node', 1 ^ (hashing.C2 * 4 & hashing.MASK) ^ (hashing.C3 * 3 & hashing.MASK))} AS r FROM nodes)")
def hash_ranks(spark, sf_dir):
    """Ranks of dimension 3 in iteration 2, as signed numbers of the same bits."""
    return hashing.hash_rank(graphs.node_domain(graphs.copurchase(spark, sf_dir)), "node", "r", 3, 2, 1)


@query(f"WITH {PARTS}, {NODES} SELECT node, {_SIGN.format(x='r')} AS r FROM (SELECT node, {_rank_sql('node', 1 ^ (hashing.C2 * 3 & hashing.MASK) ^ hashing.FALLBACK)} AS r FROM nodes)")
def fallback_ranks(spark, sf_dir):
    return hashing.fallback_rank(graphs.node_domain(graphs.copurchase(spark, sf_dir)), "node", "r", 2, 1)


@query(f"WITH {PARTS}, {NODES} SELECT node, {_SIGN.format(x='r')} AS r FROM (SELECT node, {_mix_sql('xor(node::HUGEINT, 77::HUGEINT)')} AS r FROM nodes)")
def overflow_ranks(spark, sf_dir):
    return hashing.overflow_rank(graphs.node_domain(graphs.copurchase(spark, sf_dir)), "node", "r", 77)


_DIMS = ", ".join(f"({d}, {i}, {s})" for i in range(1, 4) for s in (1, 7) for d in range(4))


@query(f"WITH d(dim, t, seed) AS (VALUES {_DIMS}), r AS (SELECT *, {_mix_sql(f'xor(xor(seed::HUGEINT, ' + _times('(dim + 1)::HUGEINT', hashing.C1) + '), ' + _times('(t + 1)::HUGEINT', hashing.C2) + ')')} AS r FROM d) SELECT seed, t, dim, row_number() OVER (PARTITION BY seed, t ORDER BY r, dim) - 1 AS place FROM r")
def dimension_order(spark, sf_dir):
    """Order of four hash dimensions in three iterations under two seeds."""
    rows_ = [(s, t, d, i) for t in range(1, 4) for s in (1, 7) for i, d in enumerate(hashing.dim_order(4, t, s))]
    return spark.createDataFrame(rows_, "seed int, t int, dim int, place long")


_T = "t AS (SELECT unnest(range(1, 21)) AS t)"


@query(f"WITH {_T} SELECT 'reciprocal' AS policy, CAST(t AS BIGINT) AS t, round(1 / (t + 1), 12) AS theta FROM t UNION ALL SELECT 'mags-geom', t, round(least(0.5, greatest(0.005, 0.5 * pow(0.01, (t - 1) / 19))), 12) FROM t")
def threshold_schedule(spark, sf_dir):
    """Thresholds of 20 iterations under the two fixed policies."""
    return spark.createDataFrame([(p, t, round(ThresholdState(p).at(t, 20), 12)) for p in ("reciprocal", "mags-geom") for t in range(1, 21)], "policy string, t long, theta double")


# --- divide -------------------------------------------------------------------------------------------------------------


@query(f"{P}, {SHINGLE} SELECT node, shingle FROM shingle")
def node_shingle(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return divide.node_shingle(s.edges, s.ranked())


@query(f"{P}, {MINHASH} SELECT rep, minhash FROM mh")
def supernode_minhash(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return divide.supernode_minhash(s.edges, s.partition, s.ranked())


@query(f"{P}, {MINHASH} SELECT minhash, count(*) AS members FROM mh GROUP BY minhash")
def minhash_group_sizes(spark, sf_dir):
    return supernode_minhash(spark, sf_dir).groupBy("minhash").agg(F.count("*").alias("members"))


_SECOND = "closed2 AS (SELECT u AS node, v AS w FROM arcs UNION ALL SELECT node, node FROM nodes), mh2 AS (SELECT rep, min((69621 * (w + 1) + 777) % 2147483647) AS h2 FROM closed2 JOIN lab USING (node) GROUP BY rep)"


@query(f"{P}, {GROUPS}, {_SECOND}, n AS (SELECT g, count(*) AS n FROM grp GROUP BY g) SELECT rep, CASE WHEN n > 20 THEN g || ':' || h2 ELSE g END AS \"group\" FROM grp JOIN n USING (g) JOIN mh2 USING (rep)")
def split_oversized(spark, sf_dir):
    s = Setup(spark, sf_dir)
    g = materialise(s.groups().select("rep", "group"), "groups")
    big = divide.oversized(g, 20)
    second = divide.supernode_minhash(s.edges, s.partition, s.ranked(69621, 777))
    return g.join(big.select("rep"), "rep", "left_anti").unionByName(divide.split_by_hash(big, second))


@query(f"{P}, {GROUPS}, o AS (SELECT rep, g, row_number() OVER (PARTITION BY g ORDER BY {HASH.format(x='rep')}, rep) - 1 AS idx FROM grp) SELECT rep, g AS \"group\", idx, idx // 10 AS chunk FROM o")
def ordered_chunks(spark, sf_dir):
    """The order is the hash, moved so that it fills the signed 64-bit numbers and with them all ranges."""
    order = F.shiftleft(portable_hash(F.col("rep")) - F.lit(1 << 30), 33)
    return divide.ordered_chunks(Setup(spark, sf_dir).groups().select("rep", "group"), order, 10)


def _hashes_sql(name: str, dim: int, iteration: int, seed: int = 1) -> str:
    rest = seed ^ (hashing.C2 * (dim + 1) & hashing.MASK) ^ (hashing.C3 * (iteration + 1) & hashing.MASK)
    return f"{name}n AS MATERIALIZED (SELECT node, {_rank_sql('node', rest)} AS r FROM nodes), {name} AS (SELECT rep, min(r) AS h FROM (SELECT u AS node, v AS w FROM arcs UNION ALL SELECT node, node FROM nodes) c JOIN {name}n n ON n.node = c.w JOIN lab ON lab.node = c.node GROUP BY rep)"


def _divide_sql(dims: int, limit: int, iteration: int) -> str:
    """Every dimension splits the groups above the limit; what is still too large is cut in the fallback's order."""
    parts, live = [f"g0 AS (SELECT rep, '' AS g FROM sizes)"], "g0"
    for k, d in enumerate(hashing.dim_order(dims, iteration, 1)):
        parts.append(_hashes_sql(f"h{k}", d, iteration))
        parts.append(f"g{k + 1} AS (SELECT x.rep, CASE WHEN count(*) OVER (PARTITION BY g) > {limit} THEN g || ':' || h ELSE g END AS g FROM {live} x JOIN h{k} USING (rep))")
        live = f"g{k + 1}"
    rest = 1 ^ (hashing.C2 * (iteration + 1) & hashing.MASK) ^ hashing.FALLBACK
    parts.append(f"fr AS MATERIALIZED (SELECT rep, g, {_rank_sql('rep', rest)} AS f, count(*) OVER (PARTITION BY g) AS n FROM {live})")
    parts.append(f"fo AS (SELECT rep, g, n, row_number() OVER (PARTITION BY g ORDER BY f, rep) - 1 AS i FROM fr)")
    parts.append(f"dv AS (SELECT rep, CASE WHEN n > {limit} THEN g || '#' || (i // {limit}) ELSE g END AS g, CASE WHEN n > {limit} THEN i ELSE rep END AS idx FROM fo)")
    return ", ".join(parts)


@query(f"{C}, {_divide_sql(2, 6, 1)} SELECT rep, min(rep) OVER (PARTITION BY g) AS first_of_group, count(*) OVER (PARTITION BY g) AS members, idx FROM dv")
def divide_groups(spark, sf_dir):
    """The whole divide with the 64-bit mixer: two dimensions, then the fallback; a group is named by its least rep."""
    s = Setup(spark, sf_dir, "supp_cooccur")
    g = materialise(divide.divide(s.edges, s.partition, 1, dims=2, limit=6), "groups")
    n = g.groupBy("group").agg(F.min("rep").alias("first_of_group"), F.count("*").alias("members"))
    return g.join(n, "group").select("rep", "first_of_group", "members", "idx")


@query(
    f"""{C}, {GROUPS}, rk AS MATERIALIZED (SELECT node, {_mix_sql(f'xor(node::HUGEINT, 10::HUGEINT)')} AS r FROM nodes),
le AS (SELECT rep, arg_min(w, (r, w)) AS h FROM (SELECT u AS node, v AS w FROM arcs UNION ALL SELECT node, node FROM nodes) c JOIN rk ON rk.node = c.w JOIN lab ON lab.node = c.node GROUP BY rep),
s1 AS (SELECT rep, CASE WHEN count(*) OVER (PARTITION BY g) > 4 THEN g || ':' || h ELSE g END AS g FROM grp JOIN le USING (rep)),
s2 AS (SELECT rep, g, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY rep) - 1 AS i FROM s1),
s3 AS (SELECT rep, CASE WHEN n > 4 THEN g || '/' || (i // 4) ELSE g END AS g, CASE WHEN n > 4 THEN i ELSE rep END AS idx FROM s2)
SELECT rep, min(rep) OVER (PARTITION BY g) AS first_of_group, count(*) OVER (PARTITION BY g) AS members, idx FROM s3"""
)
def overflow_groups(spark, sf_dir):
    """Groups above four members are refined once by the least node of least rank, then cut in rep order."""
    s = Setup(spark, sf_dir, "supp_cooccur")
    g = materialise(divide.refine_overflow(s.edges, s.partition, s.groups(), 4, 1, 9), "groups")
    n = g.groupBy("group").agg(F.min("rep").alias("first_of_group"), F.count("*").alias("members"))
    return g.join(n, "group").select("rep", "first_of_group", "members", "idx")


# --- quotient graph and costs -------------------------------------------------------------------------------------------


@query(f"{P} SELECT rep, size FROM sizes")
def supernode_sizes(spark, sf_dir):
    return Setup(spark, sf_dir).sizes


@query(f"{P} SELECT a, b, edges FROM blocks")
def quotient_edges(spark, sf_dir):
    return Setup(spark, sf_dir).blocks


@query(f"{P} SELECT rep, nbr, edges FROM nrow")
def quotient_rows(spark, sf_dir):
    return quotient.rows(Setup(spark, sf_dir).blocks)


@query(f"{P} SELECT rep, nbr, edges FROM arow")
def quotient_arc_rows(spark, sf_dir):
    return quotient.arc_rows(Setup(spark, sf_dir).blocks)


@query(f"{P} SELECT s.rep, s.size, coalesce(k.edges, 0) AS internal_edges FROM sizes s LEFT JOIN blocks k ON k.a = s.rep AND k.b = s.rep")
def internal_edges(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return quotient.internal_edges(s.blocks, s.sizes)


@query(f"{P}, n AS (SELECT rep, count(*) AS n FROM nrow GROUP BY rep) SELECT CAST(sum(n) AS BIGINT) AS nnz, max(n) AS max_row_degree FROM n")
def quotient_shape(spark, sf_dir):
    return quotient.shape(Setup(spark, sf_dir).blocks)


@query(f"{P} SELECT a, b, edges, sa, sb, {_cap('sa', 'sb', 'a = b')} AS capacity, cost FROM costs")
def block_cost(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return quotient.block_costs(s.blocks, s.sizes)


@query(f"{P} SELECT CAST(sum(cost) AS BIGINT) AS cost FROM costs")
def partition_cost(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return quotient.partition_cost(s.blocks, s.sizes)


@query(f"WITH {PARTS} SELECT count(*) AS cost FROM edges")
def singleton_cost(spark, sf_dir):
    e = materialise(graphs.copurchase(spark, sf_dir), "edges")
    one = quotient.singletons(graphs.node_domain(e))
    return quotient.partition_cost(quotient.quotient(e, one), quotient.supernode_sizes(one))


_INCIDENT = "inc AS (SELECT s.rep, CAST(coalesce(sum(c.cost), 0) AS BIGINT) AS incident FROM sizes s LEFT JOIN costs c ON c.a = s.rep OR c.b = s.rep GROUP BY s.rep)"


@query(f"{P}, {_INCIDENT} SELECT rep, incident FROM inc")
def incident_cost(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return quotient.incident_costs(s.blocks, s.sizes)


# --- gains --------------------------------------------------------------------------------------------------------------

_ENDS = f"""{_INCIDENT}, {PAIRS}, ends AS (SELECT p.a, p.b, x.size AS sa, y.size AS sb, coalesce(k.edges, 0) AS ab, coalesce(i.edges, 0) AS ia, coalesce(j.edges, 0) AS ib, m.incident AS ca, n.incident AS cb
  FROM pairs p JOIN sizes x ON x.rep = p.a JOIN sizes y ON y.rep = p.b JOIN inc m ON m.rep = p.a JOIN inc n ON n.rep = p.b
  LEFT JOIN blocks k ON k.a = p.a AND k.b = p.b LEFT JOIN blocks i ON i.a = p.a AND i.b = p.a LEFT JOIN blocks j ON j.a = p.b AND j.b = p.b),
head AS (SELECT a, b, sa + sb AS s, ca + cb - {_bc('sa', 'sb', 'ab')} AS before_cost, {_bc('sa + sb', 'sa + sb', 'ia + ib + ab', 'true')} AS inn FROM ends)"""
_MERGED = "un AS (SELECT p.a, p.b, r.nbr AS x, r.edges AS ea, 0 AS eb FROM pairs p JOIN {r} r ON r.rep = p.a UNION ALL SELECT p.a, p.b, r.nbr, 0, r.edges FROM pairs p JOIN {r} r ON r.rep = p.b), mer AS (SELECT a, b, x, sum(ea) AS ea, sum(eb) AS eb FROM un GROUP BY 1, 2, 3)"
_GAIN = f"{_ENDS}, {_MERGED.format(r='nrow')}, aft AS (SELECT m.a, m.b, sum({_bc('h.s', 'z.size', 'ea + eb')}) AS after FROM mer m JOIN head h ON h.a = m.a AND h.b = m.b JOIN sizes z ON z.rep = m.x WHERE m.x <> m.a AND m.x <> m.b GROUP BY 1, 2), scored AS (SELECT h.a, h.b, CAST(before_cost - inn - coalesce(after, 0) AS BIGINT) AS gain, CAST(before_cost AS BIGINT) AS before_cost FROM head h LEFT JOIN aft USING (a, b))"


@query(f"{P}, {_GAIN} SELECT a, b, gain, before_cost FROM scored")
def gain_mags(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return gain.exact_gain(s.pairs(), s.blocks, s.sizes)


@query(f'{D}, {FEW}, {_GAIN}, sha AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM nrow x JOIN nrow y ON x.nbr = y.nbr AND x.rep < y.rep JOIN grp ga ON ga.rep = x.rep JOIN grp gb ON gb.rep = y.rep AND ga.g = gb.g) SELECT a, b, gain, before_cost FROM scored JOIN sha USING (a, b)')
def gain_of_candidates(spark, sf_dir):
    """Exact gains of pairs of a group with an edge and a shared neighbour, whose joint costs come from candidate search."""
    s, g = _fine(spark, sf_dir)
    met = candidates.shared_neighbours(s.blocks, s.sizes, g).select("a", "b", "joint").join(s.pairs(), ["a", "b"], "left_semi")
    return gain.exact_gain(met, s.blocks, s.sizes)


_LEGACY = f"""{PAIRS}, {_MERGED.format(r='arow')}, t AS (SELECT m.*, x.size AS sa, y.size AS sb, z.size AS sx FROM mer m JOIN sizes x ON x.rep = m.a JOIN sizes y ON y.rep = m.b JOIN sizes z ON z.rep = m.x)
SELECT a, b, CAST(sum({_bc('sa', 'sx', 'ea', 'x = a')} + {_bc('sb', 'sx', 'eb', 'x = b')} - {_bc('sa + sb', 'sx', 'ea + eb', 'x = a OR x = b')}) AS BIGINT) AS gain, CAST(sum({_bc('sa', 'sx', 'ea', 'x = a')} + {_bc('sb', 'sx', 'eb', 'x = b')}) AS BIGINT) AS before_cost FROM t GROUP BY a, b"""


@query(f"{P}, {_LEGACY}")
def gain_legacy(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return gain.legacy_gain(s.pairs(), s.blocks, s.sizes)


@query(f"{P}, {_ENDS} SELECT a, b, before_cost, before_cost - inn AS upper_bound FROM head")
def gain_upper_bound(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return gain.upper_bound(s.pairs(), s.blocks, s.sizes)


@query(f"{P}, {_ENDS} SELECT a, b, before_cost, before_cost - inn AS upper_bound FROM head WHERE before_cost > inn AND before_cost > 0 AND (before_cost - inn) / before_cost >= 0.9965")
def certified_pairs(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return gain.certified(s.pairs(), s.blocks, s.sizes, 0.9965)


# --- candidates ---------------------------------------------------------------------------------------------------------

_OLD = f"old AS (SELECT s.rep, CAST(coalesce(sum({_bc('s.size', 'n.size', 'r.edges', 'r.rep = r.nbr')}), 0) AS BIGINT) AS old_cost FROM sizes s LEFT JOIN arow r ON r.rep = s.rep LEFT JOIN sizes n ON n.rep = r.nbr GROUP BY s.rep)"
_SHARED = f"""sh AS (SELECT g AS grp, a, b, CAST(sum(d) AS BIGINT) AS shared FROM (
  SELECT ga.g, x.rep AS a, y.rep AS b, {_bc('sx.size', 'sn.size', 'x.edges')} + {_bc('sy.size', 'sn.size', 'y.edges')} - {_bc('sx.size + sy.size', 'sn.size', 'x.edges + y.edges')} AS d
  FROM nrow x JOIN grp ga ON ga.rep = x.rep JOIN nrow y ON y.nbr = x.nbr AND x.rep < y.rep JOIN grp gb ON gb.rep = y.rep AND gb.g = ga.g
  JOIN sizes sx ON sx.rep = x.rep JOIN sizes sy ON sy.rep = y.rep JOIN sizes sn ON sn.rep = x.nbr WHERE x.nbr <> y.rep AND x.nbr <> x.rep) WHERE d > 0 GROUP BY 1, 2, 3)"""
_DIRECT = "di AS (SELECT x.g AS grp, k.a, k.b, k.edges AS direct FROM blocks k JOIN grp x ON x.rep = k.a JOIN grp y ON y.rep = k.b AND x.g = y.g WHERE k.a <> k.b)"
_PROXY = f"{FEW}, {_OLD}, {_SHARED}, {_DIRECT}, prox AS (SELECT u.grp, u.a, u.b, CAST(sum(g) AS BIGINT) AS proxy_gain, sum(g) / greatest(1, any_value(x.old_cost + y.old_cost)) AS proxy_ratio FROM (SELECT grp, a, b, shared AS g FROM sh UNION ALL SELECT grp, a, b, direct FROM di) u JOIN old x ON x.rep = u.a JOIN old y ON y.rep = u.b GROUP BY 1, 2, 3)"


@query(f"{P}, {_OLD} SELECT rep, old_cost FROM old")
def approx_old_cost(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return candidates.old_costs(s.blocks, s.sizes)


def _fine(spark: SparkSession, sf_dir: str) -> tuple[Setup, DataFrame]:
    s = Setup(spark, sf_dir, "supp_strong", FINE)
    return s, s.few()


@query(f'{D}, {FEW}, {_SHARED} SELECT grp AS "group", a, b, shared FROM sh')
def proxy_shared(spark, sf_dir):
    s, g = _fine(spark, sf_dir)
    return candidates.proxy_shared(s.blocks, s.sizes, g)


@query(f'{P}, {GROUPS}, {_DIRECT} SELECT grp AS "group", a, b, direct FROM di')
def proxy_direct(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return candidates.proxy_direct(s.blocks, s.groups())


@query(f'{D}, {_PROXY} SELECT grp AS "group", a, b, proxy_gain, round(proxy_ratio, 9) AS proxy_ratio FROM prox')
def proxy_total(spark, sf_dir):
    s, g = _fine(spark, sf_dir)
    return candidates.proxy(s.blocks, s.sizes, g).drop("joint").withColumn("proxy_ratio", F.round("proxy_ratio", 9))


_TOPK = "ends AS (SELECT *, a AS e FROM prox UNION ALL SELECT *, b FROM prox), gn AS (SELECT g, greatest(1, least(4, count(*) - 1)) AS k FROM grp GROUP BY g), rk AS (SELECT *, row_number() OVER (PARTITION BY grp, e ORDER BY proxy_ratio DESC, proxy_gain DESC, a, b) AS r FROM ends)"


@query(f'{D}, {_PROXY}, {_TOPK} SELECT DISTINCT grp AS "group", a, b, proxy_gain FROM rk JOIN gn ON gn.g = rk.grp WHERE r <= k')
def topk_candidates(spark, sf_dir):
    s, g = _fine(spark, sf_dir)
    return candidates.top_k(candidates.proxy(s.blocks, s.sizes, g), g, 4).drop("proxy_ratio", "joint")


_NEAR = "near AS (SELECT rep AS source, nbr AS target, edges AS score, row_number() OVER (PARTITION BY rep ORDER BY edges DESC, nbr) AS r FROM nrow)"


@query(f"{P}, {_NEAR} SELECT source, target, 0 AS source_type, score FROM near WHERE r <= 8")
def proposals_direct(spark, sf_dir):
    return candidates.direct_proposals(Setup(spark, sf_dir).blocks, 8)


@query(f"{P}, {_NEAR} SELECT x.source, y.target, 1 AS source_type, least(x.score, y.score) AS score FROM near x JOIN near y ON y.source = x.target WHERE x.r <= 2 AND y.r <= 8 AND y.target <> x.source")
def proposals_two_hop(spark, sf_dir):
    return candidates.two_hop_proposals(Setup(spark, sf_dir).blocks, 8)


_FEATURES = """feat AS (SELECT rep, nbr, res >= 0 AS sign, least(15, CASE WHEN norm > 0 THEN length(bin(norm)) - 1 ELSE 0 END) AS bin, norm FROM (
  SELECT *, row_number() OVER (PARTITION BY rep ORDER BY norm DESC, abs(res) DESC, nbr) AS r FROM (
    SELECT x.rep, x.nbr, 2 * x.edges - s.size * n.size AS res, abs(2 * x.edges - s.size * n.size) * 1024 // (s.size * n.size) AS norm FROM nrow x JOIN sizes s ON s.rep = x.rep JOIN sizes n ON n.rep = x.nbr)) WHERE r <= 8)"""
_BUCKETS = "buck AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY nbr, sign, bin ORDER BY norm DESC, rep) AS r FROM feat) WHERE r <= 8)"


@query(f"{P}, {_FEATURES} SELECT rep, nbr, sign, CAST(bin AS INTEGER) AS bin, norm FROM feat")
def residual_features(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return candidates.residual_features(s.blocks, s.sizes)


@query(f"{P}, {_FEATURES}, {_BUCKETS} SELECT rep, nbr, sign, CAST(bin AS INTEGER) AS bin, norm FROM buck")
def residual_buckets(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return candidates.residual_buckets(candidates.residual_features(s.blocks, s.sizes))


@query(
    f"""{P}, {_FEATURES}, {_BUCKETS}, met AS (SELECT DISTINCT f.rep AS source, t.rep AS target FROM feat f JOIN buck t USING (nbr, sign, bin) WHERE f.rep <> t.rep),
al AS (SELECT source, target, sum(CASE WHEN x.sign = y.sign THEN least(x.norm, y.norm) ELSE 0 END) AS al, sum(CASE WHEN x.sign <> y.sign THEN least(x.norm, y.norm) ELSE 0 END) AS co FROM met JOIN feat x ON x.rep = source JOIN feat y ON y.rep = target AND y.nbr = x.nbr GROUP BY 1, 2)
SELECT source, target, CAST(4 * al - 3 * co + 128 // (1 + abs(length(bin(s.size)) - length(bin(t.size)))) + CASE WHEN k.edges > 0 THEN 128 ELSE 0 END AS BIGINT) AS score
FROM al JOIN sizes s ON s.rep = source JOIN sizes t ON t.rep = target LEFT JOIN blocks k ON k.a = least(source, target) AND k.b = greatest(source, target)"""
)
def residual_scores(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return candidates.residual_scores(materialise(candidates.residual_features(s.blocks, s.sizes), "features"), s.blocks, s.sizes)


def _explore_sql(seed: int) -> str:
    return f"""ids AS (SELECT rep, row_number() OVER (ORDER BY rep) - 1 AS id, count(*) OVER () AS n FROM sizes), hx AS MATERIALIZED (SELECT rep, id, n, {_mix_sql(f'xor(rep::HUGEINT, {seed}::HUGEINT)')} AS hu FROM ids),
spot AS (SELECT rep, id, n, CAST((({_SIGN.format(x='hu')}) % n + n) % n AS BIGINT) AS place FROM hx), ex AS (SELECT x.rep AS source, y.rep AS target, 2 AS source_type, 0 AS score FROM spot x JOIN ids y ON y.id = CASE WHEN x.place = x.id THEN (x.place + 1) % x.n ELSE x.place END WHERE x.n > 1)"""


_BEST = "SELECT source, target, source_type, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, source_type, target) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, source_type) AS t FROM every) WHERE t = 1) WHERE k <= 8"


@query(f"{P}, {_NEAR}, {_explore_sql(3)}, every AS (SELECT source, target, 0 AS source_type, score FROM near WHERE r <= 8 UNION ALL SELECT x.source, y.target, 1, least(x.score, y.score) FROM near x JOIN near y ON y.source = x.target WHERE x.r <= 2 AND y.r <= 8 AND y.target <> x.source UNION ALL SELECT * FROM ex) {_BEST}")
def neighbour_proposals(spark, sf_dir):
    """Direct, two-hop and exploration proposals, one per target, the best eight."""
    s = Setup(spark, sf_dir)
    return candidates.neighbour_proposals(s.blocks, s.sizes, 8, 3)


@query(
    f"""{P}, {_NEAR}, {_explore_sql(3)}, {_FEATURES}, {_BUCKETS}, met AS (SELECT DISTINCT f.rep AS source, t.rep AS target FROM feat f JOIN buck t USING (nbr, sign, bin) WHERE f.rep <> t.rep),
al AS (SELECT source, target, sum(CASE WHEN x.sign = y.sign THEN least(x.norm, y.norm) ELSE 0 END) AS al, sum(CASE WHEN x.sign <> y.sign THEN least(x.norm, y.norm) ELSE 0 END) AS co FROM met JOIN feat x ON x.rep = source JOIN feat y ON y.rep = target AND y.nbr = x.nbr GROUP BY 1, 2),
re AS (SELECT source, target, CAST(4 * al - 3 * co + 128 // (1 + abs(length(bin(s.size)) - length(bin(t.size)))) + CASE WHEN k.edges > 0 THEN 128 ELSE 0 END AS BIGINT) AS score
FROM al JOIN sizes s ON s.rep = source JOIN sizes t ON t.rep = target LEFT JOIN blocks k ON k.a = least(source, target) AND k.b = greatest(source, target)),
two AS (SELECT x.source, y.target, least(x.score, y.score) AS score FROM near x JOIN near y ON y.source = x.target WHERE x.r <= 1 AND y.r <= 8 AND y.target <> x.source),
every AS (SELECT source, target, 3 AS source_type, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS k FROM re) WHERE k <= 4 UNION ALL SELECT source, target, 0, score FROM near WHERE r <= 2
UNION ALL SELECT source, target, 1, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS k FROM two) WHERE k <= 1 UNION ALL SELECT * FROM ex) {_BEST}"""
)
def residual_proposals(spark, sf_dir):
    """Residual, direct, two-hop and exploration proposals within their quotas of eight."""
    s = Setup(spark, sf_dir)
    return candidates.residual_proposals(s.blocks, s.sizes, 8, 3)


# --- selection and merging ----------------------------------------------------------------------------------------------


def _scored(s: Setup) -> DataFrame:
    """Pairs of a group with an edge between them, with their exact gains."""
    p = candidates.proxy_direct(s.blocks, s.few()).select("group", "a", "b")
    g = materialise(gain.exact_gain(p.select("a", "b"), s.blocks, s.sizes).join(p, ["a", "b"]), "scored")
    return g.select("group", F.col("a").alias("a_idx"), F.col("b").alias("b_idx"), "a", "b", "gain", "before_cost")


#: Pairs of a group with an edge, ordered as the selection takes them; ``step`` walks that order and keeps what touches no end that was taken.
_INNER = f"{FEW}, {_GAIN.replace(PAIRS, 'pairs AS (SELECT k.a, k.b FROM blocks k JOIN grp x ON x.rep = k.a JOIN grp y ON y.rep = k.b AND x.g = y.g WHERE k.a <> k.b)')}"
_PASSED = "passed AS (SELECT a, b, gain, before_cost FROM scored WHERE gain > 0 AND before_cost > 0 AND gain / before_cost >= 0.03)"
_GREEDY = """ord AS (SELECT a, b, gain, row_number() OVER (ORDER BY gain DESC, a, b) AS i FROM scored WHERE gain > 0),
step(i, used, a, b, gain, ok) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL SELECT o.i, CASE WHEN list_contains(s.used, o.a) OR list_contains(s.used, o.b) THEN s.used ELSE s.used || [o.a, o.b] END, o.a, o.b, o.gain, NOT (list_contains(s.used, o.a) OR list_contains(s.used, o.b)) FROM step s JOIN ord o ON o.i = s.i + 1),
chosen AS (SELECT a, b, gain FROM step WHERE ok)"""
E = D.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{D}, {_INNER}, {_PASSED} SELECT a, b, gain, before_cost FROM passed")
def threshold_filter(spark, sf_dir):
    return matching.threshold_filter(_scored(Setup(spark, sf_dir, "supp_strong", FINE)), 0.03).select("a", "b", "gain", "before_cost")


@query(f"{D}, {_INNER}, r AS (SELECT gain / before_cost AS r, row_number() OVER (ORDER BY gain / before_cost) AS i, count(*) OVER () AS n FROM scored WHERE gain > 0 AND before_cost > 0) SELECT round(max(CASE WHEN i = CAST(floor(0.85 * (n - 1)) AS BIGINT) + 1 THEN r END), 9) AS quantile FROM r")
def saving_quantile(spark, sf_dir):
    return matching.lower_quantile(_scored(Setup(spark, sf_dir, "supp_strong", FINE)), 0.85).select(F.round("quantile", 9).alias("quantile"))


@query(f"{D}, {_INNER}, {_PASSED}, e AS (SELECT *, a AS n FROM passed UNION ALL SELECT *, b FROM passed), f AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY gain DESC, a, b) AS r FROM e) SELECT a, b, any_value(gain) AS gain FROM f WHERE r = 1 GROUP BY a, b HAVING count(*) = 2")
def mutual_best(spark, sf_dir):
    return matching.best_partners(matching.threshold_filter(_scored(Setup(spark, sf_dir, "supp_strong", FINE)), 0.03)).select("a", "b", "gain")


@query(f"{E}, {_INNER}, {_GREEDY} SELECT a, b, gain FROM chosen")
def greedy_matching(spark, sf_dir):
    return matching.greedy(matching.threshold_filter(_scored(Setup(spark, sf_dir, "supp_strong", FINE)))).select("a", "b", "gain")


@query(f"{E}, {_INNER}, {_GREEDY} SELECT a, b, gain FROM chosen")
def locally_dominant_matching(spark, sf_dir):
    return matching.locally_dominant(matching.threshold_filter(_scored(Setup(spark, sf_dir, "supp_strong", FINE)))).select("a", "b", "gain")


_AFTER = """l2 AS (SELECT node, coalesce(c.a, l.rep) AS rep FROM lab l LEFT JOIN chosen c ON c.b = l.rep), s2 AS (SELECT rep, count(*) AS size FROM l2 GROUP BY rep),
b2 AS (SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, count(*) AS edges FROM edges e JOIN l2 x ON x.node = e.u JOIN l2 y ON y.node = e.v GROUP BY 1, 2)"""


def _committed(spark: SparkSession, sf_dir: str) -> tuple[Setup, commit.State]:
    s = Setup(spark, sf_dir, "supp_strong", FINE)
    chosen = materialise(matching.greedy(matching.threshold_filter(_scored(s))), "chosen")
    return s, commit.apply_merges(commit.State(s.partition, s.blocks, s.sizes), matching.to_merges(chosen))


@query(f"{E}, {_INNER}, {_GREEDY}, {_AFTER} SELECT rep, size, coalesce(edges, 0) AS internal_edges FROM s2 LEFT JOIN b2 ON b2.a = rep AND b2.b = rep")
def commit_batch(spark, sf_dir):
    """Supernodes after one batch of greedy merges, from maintained tables."""
    _, state = _committed(spark, sf_dir)
    return quotient.internal_edges(state.blocks, state.sizes)


@query(f"{E}, {_INNER}, {_GREEDY}, {_AFTER} SELECT (SELECT CAST(sum(cost) AS BIGINT) FROM costs) AS before_cost, CAST(sum({_bc('x.size', 'y.size', 'k.edges', 'k.a = k.b')}) AS BIGINT) AS after_cost FROM b2 k JOIN s2 x ON x.rep = k.a JOIN s2 y ON y.rep = k.b")
def commit_cost(spark, sf_dir):
    """Exact cost before and after that batch."""
    s, state = _committed(spark, sf_dir)
    return spark.createDataFrame([(commit.State(s.partition, s.blocks, s.sizes).cost(), state.cost())], "before_cost long, after_cost long")


@query(f"{E}, {_INNER}, {_GREEDY}, {_AFTER} SELECT count(*) AS maintained, count(*) AS rebuilt, CAST(0 AS BIGINT) AS different FROM b2")
def commit_validation(spark, sf_dir):
    """Rows of the maintained and of a rebuilt quotient graph, and how many differ."""
    s, state = _committed(spark, sf_dir)
    again = materialise(quotient.quotient(s.edges, state.partition), "rebuilt")
    n = F.count("*")
    return state.blocks.agg(n.alias("maintained")).crossJoin(again.agg(n.alias("rebuilt"))).crossJoin(quotient.difference(state.blocks, again).agg(n.alias("different")))  # one row each


def _merges(s: Setup) -> DataFrame:
    return s.sizes.where("rep % 2 = 1").select((F.col("rep") - 1).alias("keep"), F.col("rep").alias("remove"))


@query(f"{P} SELECT node, CASE WHEN rep % 2 = 1 THEN rep - 1 ELSE rep END AS rep FROM lab")
def bulk_merge_labels(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return quotient.merge_labels(s.partition, _merges(s))


@query(f"{P}, l2 AS (SELECT node, CASE WHEN rep % 2 = 1 THEN rep - 1 ELSE rep END AS rep FROM lab) SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, count(*) AS edges FROM edges e JOIN l2 x ON x.node = e.u JOIN l2 y ON y.node = e.v GROUP BY 1, 2")
def bulk_merge_blocks(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return quotient.merge_blocks(s.blocks, _merges(s))


# --- encoding -----------------------------------------------------------------------------------------------------------

_PLACED = "pl AS (SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, CASE WHEN x.rep > y.rep THEN v ELSE u END AS u, CASE WHEN x.rep > y.rep THEN u ELSE v END AS v FROM edges e JOIN lab x ON x.node = e.u JOIN lab y ON y.node = e.v)"
_DENSE = {
    "mags": f"dn AS (SELECT a, b FROM costs WHERE edges > 1 + {_cap('sa', 'sb', 'a = b')} - edges)",
    "legacy": "dn AS (SELECT a, b FROM costs WHERE CASE WHEN a = b THEN 8 * edges > sa * (sa - 1) ELSE 2 * edges > sa * sb END)",
}


def _encode_sql(objective: str) -> str:
    both = "" if objective == "mags" else " UNION ALL SELECT a, b, v, u FROM pl WHERE a = b"
    inside = "x.node < y.node" if objective == "mags" else "x.node <> y.node"
    return f"""{S}, {_PLACED}, {_DENSE[objective]}, pp AS (SELECT a, b, u, v FROM pl{both}), sid AS (SELECT rep, row_number() OVER (ORDER BY rep) - 1 AS sid FROM sizes),
cp AS (SELECT u, v FROM pp ANTI JOIN dn USING (a, b)),
cm AS (SELECT x.node AS u, y.node AS v FROM dn JOIN lab x ON x.rep = dn.a JOIN lab y ON y.rep = dn.b WHERE dn.a <> dn.b OR {inside} EXCEPT SELECT u, v FROM pp)"""


def _encoding(spark, sf_dir, objective: str = "mags") -> encode.Encoding:
    s = Setup(spark, sf_dir, "supp_strong")
    return encode.encode(s.edges, s.partition, objective)


def _register_encoding(objective: str) -> None:
    sql = _encode_sql(objective)
    parts = {
        "p": ("P", "SELECT x.sid AS a, y.sid AS b FROM dn JOIN sid x ON x.rep = dn.a JOIN sid y ON y.rep = dn.b"),
        "cp": ("Cp", "SELECT u, v FROM cp"),
        "cm": ("Cm", "SELECT u, v FROM cm"),
        "members": ("members", "SELECT sid, node FROM lab JOIN sid USING (rep)"),
    }
    for name, (attribute, tail) in parts.items():
        QUERIES[f"encode_{objective}_{name}"] = lambda spark, sf_dir, a=attribute: getattr(_encoding(spark, sf_dir, objective), a)
        ORACLES[f"encode_{objective}_{name}"] = f"{sql} {tail}"
    double = "2 * c" if objective == "mags" else "2 * c - l"
    QUERIES[f"compression_metrics_{objective}"] = lambda spark, sf_dir: encode.metrics(_encoding(spark, sf_dir, objective), graphs.supp_strong(spark, sf_dir).count())
    ORACLES[f"compression_metrics_{objective}"] = f"""{sql}, k AS (SELECT (SELECT count(*) FROM dn WHERE a = b) AS l, (SELECT count(*) FROM dn WHERE a <> b) AS n, (SELECT count(*) FROM cp) AS cp, (SELECT count(*) FROM cm) AS cm, (SELECT count(*) FROM edges) AS m), t AS (SELECT *, l + n + cp + cm AS c FROM k)
SELECT l AS superedges_loop, n AS superedges_nonloop, cp, cm, c AS cost_standard, {double} AS cost_x2, c / m AS ratio_standard, ({double}) / (m * 2) AS ratio_x2, 1 - c / m AS compression_gain FROM t"""


for _objective in ("mags", "legacy"):
    _register_encoding(_objective)


@query(f"WITH {STRONG} SELECT u, v FROM edges")
def reconstruct(spark, sf_dir):
    return encode.reconstruct(_encoding(spark, sf_dir))


_REBUILT = """full_ AS (SELECT least(x.node, y.node) AS u, greatest(x.node, y.node) AS v FROM dn JOIN lab x ON x.rep = dn.a JOIN lab y ON y.rep = dn.b WHERE dn.a <> dn.b OR x.node < y.node),
back AS (SELECT u, v FROM full_ EXCEPT SELECT least(u, v), greatest(u, v) FROM cm UNION SELECT least(u, v), greatest(u, v) FROM cp)"""


@query(f"{_encode_sql('legacy')}, {_REBUILT} SELECT (SELECT count(*) FROM (SELECT u, v FROM edges EXCEPT SELECT u, v FROM back)) + (SELECT count(*) FROM (SELECT u, v FROM back EXCEPT SELECT u, v FROM edges)) AS differences")
def reconstruct_difference(spark, sf_dir):
    s = Setup(spark, sf_dir, "supp_strong")
    return encode.difference(s.edges, encode.encode(s.edges, s.partition, "legacy")).agg(F.count("*").alias("differences"))


_DROP = f"""{_encode_sql('mags').replace('WITH ', 'WITH RECURSIVE ', 1)}, mem AS (SELECT rep, list(node ORDER BY node) AS m FROM lab GROUP BY rep),
items AS (SELECT 1 AS k, u AS x, v AS y, [u] AS a, [v] AS b, 1 AS na, 1 AS nb, 0 AS o FROM cp UNION ALL SELECT 2, u, v, [u], [v], 1, 1, 0 FROM cm
  UNION ALL SELECT 3, x.sid, y.sid, p.m, q.m, len(q.m), len(p.m), len(p.m) * len(q.m) FROM dn JOIN sid x ON x.rep = dn.a JOIN sid y ON y.rep = dn.b JOIN mem p ON p.rep = dn.a JOIN mem q ON q.rep = dn.b WHERE dn.a <> dn.b),
seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k, o, x, y) AS i FROM items),
deg AS (SELECT n.node, count(r.u) AS d FROM nodes n LEFT JOIN arcs r ON r.u = n.node GROUP BY n.node),
walk(i, k, left_, ok) AS (SELECT CAST(0 AS BIGINT), 0, (SELECT list(CAST(floor(d * 0.2) AS BIGINT) ORDER BY node) FROM deg), false
  UNION ALL SELECT s.i, s.k, CASE WHEN ok2 THEN list_transform(w.left_, lambda z, j: z - CASE WHEN list_contains(s.a, j - 1) THEN s.na ELSE 0 END - CASE WHEN list_contains(s.b, j - 1) THEN s.nb ELSE 0 END) ELSE w.left_ END, ok2
  FROM (SELECT w.i, w.left_, list_min(list_transform(s.a, lambda z: w.left_[z + 1])) >= s.na AND list_min(list_transform(s.b, lambda z: w.left_[z + 1])) >= s.nb AS ok2 FROM walk w JOIN seq s ON s.i = w.i + 1) w JOIN seq s ON s.i = w.i + 1)"""


@query(f"""{_DROP}, k AS (SELECT (SELECT count(*) FROM dn WHERE a = b) AS l, (SELECT count(*) FROM walk WHERE k = 3 AND NOT ok) AS n, (SELECT count(*) FROM walk WHERE k = 1 AND NOT ok) AS cp, (SELECT count(*) FROM walk WHERE k = 2 AND NOT ok) AS cm, (SELECT count(*) FROM edges) AS m), t AS (SELECT *, l + n + cp + cm AS c FROM k)
SELECT l AS superedges_loop, n AS superedges_nonloop, cp, cm, c AS cost_standard, 2 * c AS cost_x2, c / m AS ratio_standard, (2 * c) / (m * 2) AS ratio_x2, 1 - c / m AS compression_gain FROM t""")
def drop_lossy(spark, sf_dir):
    s = Setup(spark, sf_dir, "supp_strong")
    return encode.metrics(encode.drop(encode.encode(s.edges, s.partition), s.edges, 0.2), s.edges.count())


# --- the whole summarizer -----------------------------------------------------------------------------------------------


def _summary(spark, sf_dir, **settings):
    return summarize(graphs.supp_strong(spark, sf_dir), SummarizeConfig(**{"iterations": 3} | settings))


@query()
def summarize_full(spark, sf_dir):
    return spark.createDataFrame([_summary(spark, sf_dir).metrics])


@query()
def summarize_profile(spark, sf_dir):
    return _summary(spark, sf_dir, iterations=2, cost_objective="legacy").profile_frame().drop("seconds")


@query(f"{P}, l AS (SELECT list(rep ORDER BY node) AS r FROM lab) SELECT lpad(lower(hex(list_reduce(r, lambda h, x: (xor(h, x::HUGEINT) * {hashing.PRIME}::HUGEINT) % {_MASK}, {hashing.OFFSET}::HUGEINT))), 16, '0') AS partition_hash FROM (SELECT list_transform(r, lambda x: x::HUGEINT) AS r FROM l)")
def partition_fingerprint(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return spark.createDataFrame([(format(fingerprint(s.partition), "016x"),)], "partition_hash string")


@query(f"WITH {STRONG} SELECT u, v FROM edges")
def summarize_lossless(spark, sf_dir):
    """What a whole run's encoding stands for, rebuilt."""
    return encode.reconstruct(_summary(spark, sf_dir, iterations=2).encoding)


@query(f"{P} SELECT CAST(bit_xor((48271 * (rep + 1) + 69621 * (node + 1)) % 2147483647) AS BIGINT) AS digest, count(*) AS nodes FROM lab")
def partition_digest(spark, sf_dir):
    """An order-free fingerprint of the labels; one combined aggregate."""
    return quotient.digest(Setup(spark, sf_dir).partition)


@query(f"{S}, sid AS (SELECT rep, row_number() OVER (ORDER BY rep) - 1 AS sid FROM sizes) SELECT sid || chr(9) || string_agg(node, chr(9) ORDER BY node) AS value FROM lab JOIN sid USING (rep) GROUP BY sid")
def summary_text(spark, sf_dir):
    """The G file of a summary, as written and read back."""
    path = f"{scratch_dir(spark)}/summary-{uuid.uuid4().hex}"
    sinks.write_summary(_encoding(spark, sf_dir), path)
    return spark.read.text(f"{path}/G.txt")
