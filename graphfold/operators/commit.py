"""Commit merges: all at once, or re-checked one by one on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.checkpoint import materialise
from graphfold.operators.quotient import merge_blocks, merge_labels, merge_sizes, partition_cost

#: Pairs taken between two sortings (fixed values).
MICRO_BATCH = {"s1": 1, "t2": 2, "t4": 4, "t8": 8, "m4": 4}


@dataclass
class State:
    partition: DataFrame
    blocks: DataFrame
    sizes: DataFrame

    def cost(self) -> int:
        return partition_cost(self.blocks, self.sizes).first()[0]


def apply_merges(state: State, merges: DataFrame) -> State:
    m = materialise(merges.select("keep", "remove"), "merges")
    return State(materialise(merge_labels(state.partition, m), "partition"), materialise(merge_blocks(state.blocks, m), "blocks"), materialise(merge_sizes(state.sizes, m), "sizes"))


def _bc(sa: int, sb: int, e: int, inside: bool) -> int:
    return min(e, 1 + (sa * (sa - 1) // 2 if inside else sa * sb) - e)


class LocalRows:
    """Rows of the supernodes that selected pairs touch, and the sizes around them."""

    def __init__(self, state: State, merges: DataFrame):
        reps = materialise(merges.select(F.explode(F.array("keep", "remove")).alias("rep")).distinct(), "touched")
        b = state.blocks
        mine = b.join(reps.withColumnRenamed("rep", "a"), "a", "left_semi").unionByName(b.join(reps.withColumnRenamed("rep", "b"), "b", "left_semi")).distinct()
        self.row: dict[int, dict[int, int]] = {r.rep: {} for r in reps.collect()}
        self.inner: dict[int, int] = dict.fromkeys(self.row, 0)
        for r in mine.collect():
            if r.a == r.b:
                self.inner[r.a] = r.edges
                continue
            self.row.setdefault(r.a, {})[r.b] = r.edges
            self.row.setdefault(r.b, {})[r.a] = r.edges
        near = reps.unionByName(mine.select(F.explode(F.array("a", "b")).alias("rep"))).distinct()
        self.size = {r.rep: r["size"] for r in state.sizes.join(near, "rep", "left_semi").collect()}

    def gain(self, a: int, b: int) -> int:
        sa, sb, ab = self.size[a], self.size[b], self.row[a].get(b, 0)
        before = _bc(sa, sa, self.inner[a], True) + _bc(sb, sb, self.inner[b], True) + _bc(sa, sb, ab, False)
        after = _bc(sa + sb, sa + sb, self.inner[a] + self.inner[b] + ab, True)
        for x in (self.row[a].keys() | self.row[b].keys()) - {a, b}:
            ea, eb, sx = self.row[a].get(x, 0), self.row[b].get(x, 0), self.size[x]
            before += _bc(sa, sx, ea, False) + _bc(sb, sx, eb, False)
            after += _bc(sa + sb, sx, ea + eb, False)
        return before - after

    def merge(self, a: int, b: int) -> None:
        self.inner[a] += self.inner.pop(b) + self.row[a].pop(b, 0)
        gone = self.row.pop(b)
        gone.pop(a, None)
        for x, e in gone.items():
            self.row[a][x] = self.row[a].get(x, 0) + e
            self.row[x].pop(b, None)
            self.row[x][a] = self.row[a][x]
        self.size[a] += self.size.pop(b)


def transactional(state: State, merges: DataFrame, policy: str, max_pairs: int = 200_000) -> tuple[list[tuple[int, int]], list[dict]]:
    """Merges to apply, and one audit entry per micro-batch.

    Inherently sequential: pending pairs are scored again and sorted, the first few are re-checked just before each applies, and one that
    no longer gains is rejected for good. Pairs and their rows are on the driver, so more than ``max_pairs`` raise.
    """
    size = MICRO_BATCH[policy]
    pending = [(r.keep, r.remove) for r in merges.limit(max_pairs + 1).collect()]
    if len(pending) > max_pairs:
        raise ValueError(f"more than {max_pairs} selected pairs; use policy g0")
    rows = LocalRows(state, merges)
    done, audit, total = [], [], 0
    while pending:
        scored = sorted(((rows.gain(a, b), min(a, b), max(a, b), a, b) for a, b in pending), key=lambda s: (-s[0], s[1], s[2]))
        rejected = 0
        for _, _, _, a, b in scored[:size]:
            g = rows.gain(a, b)
            if g > 0:
                rows.merge(a, b)
                done.append((a, b))
                total += g
            else:
                rejected += 1
        pending = [(a, b) for _, _, _, a, b in scored[size:]]
        audit.append({"batch_id": len(audit), "batch_size": min(size, len(scored)), "cumulative_realized_gain": total, "rejected_pair_count": rejected})
    return done, audit
