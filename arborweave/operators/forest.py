"""Parent forests: who stands left of whom in the ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions.vbyte import vbyte_length
from arborweave.session import ship

#: Slots per child, and what a candidate needs to replace the first-fit parent (fixed values).
SLOTS, MIN_SUPPORT, MIN_SCORE = 4, 2, 2.0
STABILITY_WEIGHT, ID_WEIGHT = 0.20, 0.05


def neighbours(rows: DataFrame) -> DataFrame:
    """src, parent, child, parent_freq, child_freq of each adjacent pair in a row."""
    left = Window.partitionBy("src").orderBy("pos")
    paired = rows.select("src", "dst", "freq", F.lag("dst").over(left).alias("parent"), F.lag("freq").over(left).alias("parent_freq"))
    return paired.filter("parent IS NOT NULL").select("src", "parent", F.col("dst").alias("child"), "parent_freq", F.col("freq").alias("child_freq"))


def first_fit(rows: DataFrame) -> DataFrame:
    """child, parent: the left neighbour in the first row (smallest src) where there is one."""
    return neighbours(rows).groupBy("child").agg(F.min_by("parent", "src").alias("parent"))


def scored_pairs(rows: DataFrame) -> DataFrame:
    """Adjacent pairs with their local score; eligible where a path of one step saves bytes."""
    gain = vbyte_length(F.col("parent") * 2) - 1
    stability = F.col("parent_freq").cast("double") / F.col("child_freq").cast("double")
    penalty = (vbyte_length(F.col("child") * 2 + 1) - 1).cast("double")
    score = gain.cast("double") + F.lit(STABILITY_WEIGHT) * stability - F.lit(ID_WEIGHT) * penalty
    return neighbours(rows).select("src", "parent", "child", score.alias("score"), (gain > 0).alias("eligible"))


class _Slots:
    """Candidates of one child, at most SLOTS at a time, fed in row order."""

    def __init__(self) -> None:
        self.held: dict[int, list] = {}  # parent -> [score, support]; order of slots is kept by replacing in place
        self.order: list[int] = []

    def feed(self, parent: int, score: float) -> None:
        own = self.held.get(parent)
        if own is None:
            if len(self.order) == SLOTS:
                weakest = min(range(SLOTS), key=lambda k: self.held[self.order[k]][0])
                if score <= self.held[self.order[weakest]][0]:
                    return
                del self.held[self.order[weakest]]
                self.order[weakest] = parent
            else:
                self.order.append(parent)
            own = self.held[parent] = [0.0, 0]
        own[0] += score
        own[1] += 1

    def winner(self) -> tuple[int, float, int] | None:
        if not self.held:
            return None
        parent = min(self.held, key=lambda p: (-self.held[p][0], -self.held[p][1], p))
        return parent, *self.held[parent]


def _without_eviction(child: np.ndarray, parent: np.ndarray, score: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Winners (child, parent, score, support) of the children that have SLOTS candidates at most, and a mask of the other children's rows.

    Rows are whole children in row order. A candidate's scores are added up in that order, as the slots would.
    """
    order = np.lexsort((parent, child))  # stable: a pair's rows stay in order
    c, p = child[order], parent[order]
    new = np.ones(len(c), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    pair = np.cumsum(new) - 1
    c, p = c[new], p[new]
    sums, support = np.zeros(len(c)), np.bincount(pair)
    np.add.at(sums, pair, score[order])
    best = np.lexsort((p, -support, -sums, c))
    starts = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
    few = np.diff(starts, append=len(c)) <= SLOTS
    chosen = best[starts[few]]
    return [c[chosen], p[chosen], sums[chosen], support[chosen]], np.isin(child, c[starts[~few]])


def slot_winners(rows: DataFrame) -> DataFrame:
    """child, parent, score, support of each child's best candidate.

    Slots are evicted in row order, so a child's pairs are folded in that order: pairs go to
    partitions by child and stream through in constant memory per child, a child with any number of rows included. Children whose
    rows lie in one batch and who fill no more than their slots are done at once; only the others go row by row.
    """
    names = ["child", "parent", "score", "support"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_child, slots = None, _Slots()

        def folded(child: np.ndarray, parent: np.ndarray, score: np.ndarray) -> list[tuple]:
            """Feeds rows one by one; winners of the children that end among them."""
            nonlocal open_child, slots
            out = []
            for c, p, s in zip(child.tolist(), parent.tolist(), score.tolist()):
                if c != open_child:
                    if open_child is not None:
                        out.append((open_child, *slots.winner()))
                    open_child, slots = c, _Slots()
                slots.feed(p, s)
            return out

        for batch in batches:
            if not len(batch):
                continue
            child, parent, score = (batch.column(n).to_numpy() for n in names[:3])
            begin = int(np.searchsorted(child, child[0], side="right")) if child[0] == open_child else 0
            end = int(np.searchsorted(child, child[-1]))  # the last child may go on
            found = folded(child[:begin], parent[:begin], score[:begin])
            if end > begin:
                inner = [x[begin:end] for x in (child, parent, score)]
                ready, rest = _without_eviction(*inner)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ready], names)
                found += folded(*[x[rest] for x in inner])
            if end >= begin:
                found += folded(child[end:], parent[end:], score[end:])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names)
        if open_child is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip((open_child, *slots.winner()))], names)

    ship(rows.sparkSession)
    pairs = scored_pairs(rows).filter("eligible").select("child", "parent", "score", "src")
    return pairs.repartition("child").sortWithinPartitions("child", "src").mapInArrow(run, "child long, parent long, score double, support long")


def best_candidates(rows: DataFrame) -> DataFrame:
    """The same over all candidates, none evicted: highest score to nine decimals, then support, then the smaller parent."""
    sums = scored_pairs(rows).filter("eligible").groupBy("child", "parent").agg(F.sum("score").alias("score"), F.count("*").alias("support"))
    order = F.struct(-F.round("score", 9), -F.col("support"), "parent")
    return sums.groupBy("child").agg(F.min_by(F.struct("parent", "score", "support"), order).alias("best")).select("child", "best.*")


def gain_driven(rows: DataFrame, evicting: bool = True) -> DataFrame:
    """child, parent, switched: first fit, replaced where the best candidate is frequent and good enough. ``evicting``: of SLOTS candidates at a time, else of all."""
    best = (slot_winners(rows) if evicting else best_candidates(rows)).filter((F.col("support") >= MIN_SUPPORT) & (F.col("score") >= MIN_SCORE)).select(F.col("child").alias("__child"), F.col("parent").alias("__best"))
    joined = first_fit(rows).join(best, F.col("child") == F.col("__child"), "left")
    return joined.select("child", F.coalesce("__best", "parent").alias("parent"), F.coalesce(F.col("__best") != F.col("parent"), F.lit(False)).alias("switched"))


def parent_array(parents: DataFrame, size: int) -> np.ndarray:
    """Parents by child id, -1 for none, on the driver; for graphs whose size was checked."""
    out = np.full(size, -1, dtype=np.int64)
    pairs = parents.select("child", "parent").toPandas()
    out[pairs["child"]] = pairs["parent"]
    return out
