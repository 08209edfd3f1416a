"""K-d tree partitioning of documents into shards of near equal bytes.

The metadata dimensions are the document's size and the checksum of its text. A node that holds
several leaves is split along the dimension in which it is widest (relative to the root), at the weighted
quantile that gives each side its leaves' share of the bytes, until every leaf holds about the target. Both dimensions depend
on the text alone, and each dimension's order is broken by the other, so equal texts are one point of
the tree: a group of copies stays in one shard unless it straddles the quantile and keeping it whole would
leave the split uneven by more than ``TOLERANCE`` of a leaf; then it is cut in doc_id order.

Quantiles are found by distributed histogram passes over narrow rows: each pass sums bytes in 1,024 bins
of a node's key range and goes on in the bin that holds the quantile. Only bins reach the driver.

Edge cases: null text has size 1 and checksum 0; rows that are equal in doc_id and text can't be told apart, so they stay in one shard, which may be
uneven by their bytes, and each takes a slot; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.functions.prefix import hash_bucket, running_total
from arborweave.session import cut

BINS = 1024
TOLERANCE = 0.002
DIMENSIONS = ("by_size", "by_crc")


@dataclass
class Node:
    """A node of the tree; ``first`` is its first leaf. A row goes left if its key is below ``key``, or equal with doc_id below ``tie``."""

    leaves: int
    first: int
    dimension: str = ""
    key: int = 0
    tie: int = -(1 << 62)
    left: "Node | None" = None
    right: "Node | None" = None

    def expression(self) -> Column:
        if self.left is None or self.right is None:
            return F.lit(self.first)
        if not self.dimension:  # a node without rows
            return F.lit(None).cast("int")
        own = F.col(self.dimension)
        goes_left = (own < F.lit(self.key)) | ((own == F.lit(self.key)) & (F.col("__tie") < F.lit(self.tie)))
        return F.when(goes_left, self.left.expression()).otherwise(self.right.expression())


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one totally ordered key per dimension; narrow rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tie = F.coalesce(F.greatest(F.least("doc_id", F.lit(1 << 61)), F.lit(-(1 << 61))), F.lit(-(1 << 61)))
    return rows.select("doc_id", "size", "text_crc32", F.shiftleft("size", 32).bitwiseOR(F.col("text_crc32")).alias("by_size"), F.shiftleft("text_crc32", 31).bitwiseOR(F.col("size")).alias("by_crc"), tie.alias("__tie"))


def _quantiles(rows: DataFrame, wanted: dict[int, tuple[str, int, int, float]]) -> dict[int, tuple[int, float, float]]:
    """For each node (dimension, low, high, bytes to the left): the key where the quantile falls, bytes below it, bytes on it.

    ``rows`` has the node's number in ``__node``. All nodes of a level go down together.
    """
    state = {n: (d, low, high, goal, 0.0) for n, (d, low, high, goal) in wanted.items()}
    found: dict[int, tuple[int, float, float]] = {}
    while state:
        bin_of: Column = F.lit(None).cast("int")
        for n, (d, low, high, _, _) in state.items():
            width = max(1, -(-(high - low + 1) // BINS))
            here = (F.col("__node") == n) & (F.col(d) >= F.lit(low)) & (F.col(d) <= F.lit(high))
            bin_of = F.when(here, F.expr(f"int(({d} - ({low}L)) div {width}L)")).otherwise(bin_of)
        key_of: Column = F.lit(None).cast("long")
        for n, (d, *_) in state.items():
            key_of = F.when(F.col("__node") == n, F.col(d)).otherwise(key_of)
        bins = rows.select("__node", bin_of.alias("bin"), key_of.alias("key"), "size").filter("bin IS NOT NULL").groupBy("__node", "bin").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for n in list(state):
            d, low, high, goal, below = state[n]
            own = sorted((r for r in bins if r["__node"] == n), key=lambda r: r["bin"])
            for i, r in enumerate(own):
                if below + r["size"] >= goal or i == len(own) - 1:
                    if r["low"] == r["high"]:
                        found[n] = (r["low"], below, float(r["size"]))
                        del state[n]
                    else:
                        state[n] = (d, r["low"], r["high"], goal, below)
                    break
                below += r["size"]
    return found


def _ties(rows: DataFrame, node: int, dimension: str, key: int, goal: float) -> tuple[int, float]:
    """Within one point: the doc_id before which about ``goal`` bytes lie. All its rows are of one size, so ids are halved by quantile bins."""
    own = rows.filter((F.col("__node") == node) & (F.col(dimension) == F.lit(key))).select(F.col("__tie").alias("tie"), "size")
    found = _quantiles(own.withColumn("__node", F.lit(0)), {0: ("tie", *own.agg(F.min("tie"), F.max("tie")).first(), goal)})[0]
    at, below, on = found
    return (at, below) if goal - below <= below + on - goal else (at + 1, below + on)


def build_tree(rows: DataFrame, shards: int) -> Node:
    """Split ``rows`` (of metadata()) into ``shards`` leaves, a level at a time."""
    root = Node(shards, 0)
    level = [root]
    spans: dict[str, int] = {}
    while level := [n for n in level if n.leaves > 1]:
        numbered = rows.withColumn("__leaf", root.expression())
        number: Column = F.lit(None).cast("int")
        for i, n in enumerate(level):
            number = F.when((F.col("__leaf") >= n.first) & (F.col("__leaf") < n.first + n.leaves), F.lit(i)).otherwise(number)
        numbered = numbered.withColumn("__node", number).filter("__node IS NOT NULL")
        edges = {r["__node"]: r for r in numbered.groupBy("__node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).collect()}
        spans = spans or {d: max(1, edges[0][f"max_{d}"] - edges[0][f"min_{d}"]) for d in DIMENSIONS if edges}
        wanted = {}
        for i, e in edges.items():
            n = level[i]
            n.dimension = max(DIMENSIONS, key=lambda d: (e[f"max_{d}"] - e[f"min_{d}"]) / spans[d])
            wanted[i] = (n.dimension, e[f"min_{n.dimension}"], e[f"max_{n.dimension}"], e["bytes"] * (n.leaves // 2) / n.leaves)
        found = _quantiles(numbered, wanted)
        for i, n in enumerate(level):
            half = n.leaves // 2
            n.left, n.right = Node(half, n.first), Node(n.leaves - half, n.first + half)
            if i in found:
                goal, (key, below, on) = wanted[i][3], found[i]
                leaf = edges[i]["bytes"] / n.leaves
                if min(goal - below, below + on - goal) <= TOLERANCE * leaf:
                    n.key = key if goal - below <= below + on - goal else key + 1
                else:
                    n.key = key
                    n.tie, _ = _ties(numbered, i, n.dimension, key, goal - below)
        level = [x for n in level for x in (n.left, n.right)]
    return root


def shard_by_bytes(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: give the number of shards, or the bytes that a shard should hold."""
    rows = cut(metadata(docs))
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, round((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    tree = build_tree(rows, shards)
    placed = rows.withColumn("shard", tree.expression().cast("int")).withColumn("__bucket", hash_bucket("__tie", "text_crc32"))
    ranked = running_total(placed, ["shard"], "__bucket", ["__tie", "text_crc32"], F.lit(1), "slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", "slot")
