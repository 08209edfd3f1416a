"""Triangles from blocks of edges: open ways are closed where they arise and never travel.

Edges go from the lower to the higher degree, so a triangle is a vertex ``a`` with two ways out, ``b`` and ``c``, and the
edge from ``b`` to ``c``. Ends are dealt into ``p`` colours; the block of two colours gets the edges between them, and from
every list of ways out the part that has these colours. It finds the triangles whose ``b`` and ``c`` have its colours, each
triangle in one block. An edge travels p + 1 times, as bytes of a gap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.operators import packed
from arborweave.operators.codecs import BROADCAST_VERTICES, _edges, _rows, _values
from arborweave.operators.forest import parent_array
from arborweave.session import cut, ship

#: Edges that a block holds on average (16 bytes each; the ways into one vertex of very high degree lie in p blocks, not
#: in p * p / 2), and the fewest colours, for enough tasks. The number of colours rises with the counted edges.
BLOCK_EDGES, LEAST_COLOURS = 1_000_000, 6
#: Marks of lists' members held at once (a byte each), and candidates or list entries looked at in one go.
MARKS, AT_ONCE = 1 << 25, 1 << 20


def oriented(adj: DataFrame, degree: DataFrame, vertices: int) -> DataFrame:
    """a, b of each edge once, from the lower to the higher degree (ties by id): no vertex has more than about sqrt(2E) ways out.

    ``degree``: src and d of each vertex with edges. Up to BROADCAST_VERTICES (``vertices``: the largest id and one) degrees travel as one array, else by joins.
    """
    once = adj.filter("src < dst").select("src", "dst")
    return _oriented_by_array(once, degree, vertices) if vertices <= BROADCAST_VERTICES else _oriented_by_joins(once, degree)


def _oriented_by_array(once: DataFrame, degree: DataFrame, vertices: int) -> DataFrame:
    counted, d = degree.toPandas(), np.zeros(vertices, np.int64)
    d[counted["src"]] = counted["d"]
    shared = once.sparkSession.sparkContext.broadcast(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = batch.column("src").to_numpy(), batch.column("dst").to_numpy()
            first = shared.value[src] <= shared.value[dst]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(first, src, dst)), pa.array(np.where(first, dst, src))], ["a", "b"])

    ship(once.sparkSession)
    return once.mapInArrow(run, "a long, b long")


def _oriented_by_joins(once: DataFrame, degree: DataFrame) -> DataFrame:
    ends = once.join(degree.select(F.col("src"), F.col("d").alias("du")), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dv")), "dst")
    first = F.struct("du", "src") < F.struct("dv", "dst")
    return ends.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b"))


def colours(n_edges: int) -> int:
    return max(LEAST_COLOURS, math.ceil(math.sqrt(2 * n_edges / BLOCK_EDGES)))


def _colour(ids: np.ndarray, p: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(p)).astype(np.int64)


def dealt(src: np.ndarray, dst: np.ndarray, p: int) -> list[pa.Array]:
    """block, side, src, payload of whole lists of ways out: side 0 the block's edges, side 1 what two ways may come from."""
    own, other = _colour(src, p), _colour(dst, p)
    n = len(src)
    left = np.concatenate((own, np.tile(other, p)))
    right = np.concatenate((other, np.repeat(np.arange(p), n)))
    block = np.minimum(left, right) * p + np.maximum(left, right)
    side = np.repeat(np.array([0, 1]), (n, n * p))
    src, dst, other = (np.tile(x, p + 1) for x in (src, dst, other))
    order = np.lexsort((dst, src, side, block))
    block, side, src, dst, other = (x[order] for x in (block, side, src, dst, other))
    new = np.ones(len(src), dtype=bool)
    new[1:] = (block[1:] != block[:-1]) | (side[1:] != side[:-1]) | (src[1:] != src[:-1])
    first = np.flatnonzero(new)
    both = np.minimum.reduceat(other, first) != np.maximum.reduceat(other, first)
    one_colour = block[first] // p == block[first] % p
    used = (side[first] == 0) | (np.diff(first, append=len(src)) > 1) & (both | one_colour)
    gap = dst - np.where(new, 0, np.concatenate(([0], dst[:-1])))
    payload = packed.binary(gap, first).filter(pa.array(used))
    return [pa.array(block[first][used]), pa.array(side[first][used].astype(np.int32)), pa.array(src[first][used]), payload]


class Block:
    """The edges between two colours, for closing ways."""

    def __init__(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate((src, dst)))
        n = len(self.ids)
        self.ends = np.searchsorted(self.ids, dst)
        self.begin = np.searchsorted(np.searchsorted(self.ids, src), np.arange(n + 1))
        self.rows_at_once = max(1, MARKS // n)
        self.marks = np.zeros(self.rows_at_once * n, dtype=bool)

    def closed(self, src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For whole lists: src and place of b of some entries; of each triangle its entry and the place of c. Places are in ``ids``."""
        n = len(self.ids)
        b = np.minimum(np.searchsorted(self.ids, dst), n - 1)
        known = self.ids[b] == dst
        src, b = src[known], b[known]
        edges = _edges(src)
        for low in range(0, len(edges) - 1, self.rows_at_once):
            high = min(low + self.rows_at_once, len(edges) - 1)
            part = slice(edges[low], edges[high])
            row = np.repeat(np.arange(high - low), np.diff(edges[low : high + 1])) * n
            self.marks[row + b[part]] = True
            yield from self._searched(src[part], b[part], row)
            self.marks[row + b[part]] = False

    def _searched(self, src: np.ndarray, b: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        count = self.begin[b + 1] - self.begin[b]
        group = (np.cumsum(count) - count) // AT_ONCE
        cuts = _edges(group)
        for x, y in zip(cuts, cuts[1:]):
            many = count[x:y]
            entry = np.repeat(np.arange(y - x), many)
            c = self.ends[np.arange(len(entry)) + np.repeat(self.begin[b[x:y]] - np.cumsum(many) + many, many)]
            hit = np.flatnonzero(self.marks[np.repeat(row[x:y], many) + c])
            if len(hit):
                yield src[x:y], b[x:y], entry[hit], c[hit]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """block, side, src and dst of lists that stand behind one another, about AT_ONCE entries at a time."""
    for batch in batches:
        if not len(batch):
            continue
        block, side, src = (batch.column(n).to_numpy() for n in ("block", "side", "src"))
        bytes_before = np.cumsum(pc.binary_length(batch.column("payload")).to_numpy()) // AT_ONCE
        new = np.flatnonzero(np.diff(block).astype(bool) | np.diff(side).astype(bool) | np.diff(bytes_before).astype(bool)) + 1
        cuts = [0, *new.tolist(), len(batch)]
        for x, y in zip(cuts, cuts[1:]):
            gap, counts = _values(batch.column("payload").slice(x, y - x))
            total = np.cumsum(gap)
            before = np.concatenate(([0], total))[np.cumsum(counts) - counts]
            yield int(block[x]), int(side[x]), np.repeat(src[x:y], counts), total - np.repeat(before, counts)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block and what its closed() gives, for a partition sorted by block, side and src."""
    current, parts, ready = None, [], None
    for block, side, src, dst in _lists(batches):
        if block != current:
            current, parts, ready = block, [], None
        if side == 0:
            parts.append((src, dst))
        elif parts:
            ready = ready or Block(*(np.concatenate(x) for x in zip(*parts)))
            for found in ready.closed(src, dst):
                yield ready, *found


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
DEALT = "block long, side int, src long, payload binary"


def _in_blocks(lists: DataFrame, p: int, run: Run, schema: str) -> DataFrame:
    """``run`` over the blocks of lists that dealt() has dealt."""
    return lists.repartition(p * (p + 1) // 2, "block").sortWithinPartitions("block", "side", "src").mapInArrow(run, schema)


def _over_blocks(adj: DataFrame, run: Run, schema: str) -> DataFrame:
    degree = cut(adj.groupBy("src").agg(F.count("*").alias("d")))
    top, ends = degree.agg(F.coalesce(F.max("src"), F.lit(-1)), F.coalesce(F.sum("d"), F.lit(0))).first()
    ways, p = oriented(adj, degree, top + 1), colours(ends // 2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, (dst,) in _rows(batches, ("dst",)):
            yield pa.RecordBatch.from_arrays(dealt(src, dst, p), ["block", "side", "src", "payload"])

    ship(adj.sparkSession)
    lists = ways.select(F.col("a").alias("src"), F.col("b").alias("dst")).repartition("src").sortWithinPartitions("src", "dst")
    return _in_blocks(lists.mapInArrow(deal, DEALT), p, run, schema)


def triangles(adj: DataFrame) -> DataFrame:
    """u < v < w of every triangle, once. Ids are not negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, src, b, entry, c in _closed(batches):
            ends = np.sort(np.stack((src[entry], block.ids[b[entry]], block.ids[c])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v", "w"])

    return _over_blocks(adj, run, "u long, v long, w long")


def triangle_ends(adj: DataFrame) -> DataFrame:
    """id, n: triangles at a vertex, in parts that are still to be summed up. Triangles are counted where they are found, none is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["id", "n"])

        last, ends = None, None
        for block, src, b, entry, c in _closed(batches):
            if block is not last:
                if last is not None:
                    yield part(last.ids, ends)
                last, ends = block, np.zeros(len(block.ids), np.int64)
            found = np.bincount(entry, minlength=len(src))
            np.add.at(ends, b, found)
            np.add.at(ends, c, 1)
            first = _edges(src)[:-1]
            yield part(src[first], np.add.reduceat(found, first))
        if last is not None:
            yield part(last.ids, ends)

    return _over_blocks(adj, run, "id long, n long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([sum(len(c) for *_, c in _closed(batches))], pa.int64())], ["n"])


def _total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("triangles"))


def triangle_count(adj: DataFrame) -> DataFrame:
    return _total(_over_blocks(adj, _counted, "n long"))


def triangle_count_of_rows(encoded: DataFrame, parents: DataFrame, vertices: int) -> DataFrame:
    """The same from rows' command bytes (src, payload, n_edges). A row is expanded where it stands and its ways out are dealt from there, so no edge travels alone.

    Up to BROADCAST_VERTICES ``vertices``. A row stands whole in one place, and with each edge stands its reverse.
    """
    counted = encoded.select("src", "n_edges").toPandas()
    degree = np.zeros(vertices, np.int64)
    degree[counted["src"]] = counted["n_edges"]
    p = colours(int(degree.sum()) // 2)
    shared = encoded.sparkSession.sparkContext.broadcast((degree, parent_array(parents, vertices)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree, parent = shared.value
        for src, dst in packed.expanded_rows(batches, parent, max(1, AT_ONCE // (p + 1))):
            out = (degree[src] < degree[dst]) | ((degree[src] == degree[dst]) & (src < dst))
            if out.any():
                yield pa.RecordBatch.from_arrays(dealt(src[out], dst[out], p), ["block", "side", "src", "payload"])

    ship(encoded.sparkSession)
    return _total(_in_blocks(encoded.select("src", "payload", "n_edges").mapInArrow(deal, DEALT), p, _counted, "n long"))
