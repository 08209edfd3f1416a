"""Adjacency, parents and commands on rows of bytes: no edge is a row of a shuffle or a checkpoint.

A list's distinct members travel and are kept as bytes of gaps, about a byte each in dense graphs. Frequencies and parents
are arrays, for graphs of up to BROADCAST_VERTICES vertices; ``relabel``, ``forest`` and ``codecs`` have the same for any graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.functions import vbyte
from arborweave.operators.codecs import MAX_STEPS, _decoded, _edges, _values, _walked, greedy_commands, in_row_parents
from arborweave.operators.forest import parent_array
from arborweave.session import ship, shuffle_partitions

#: Edges or list entries looked at in one go (FEW: where one takes many fields), and the most entries of a part of a list in a shuffle.
AT_ONCE, FEW, PART = 1 << 20, 1 << 18, 1 << 12

LISTS = "src long, n long, payload binary"
COMMANDS = "src long, payload binary, n_commands long, n_edges long"


def _distinct(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs by src, then dst. dst is not negative."""
    if not len(src):
        return src, dst
    low, width = int(src.min()), int(dst.max()) + 1
    if (int(src.max()) - low + 1) * width < 1 << 63:
        key = np.sort((src - low) * width + dst)
        key = key[np.diff(key, prepend=-1) != 0]
        row = key // width
        return row + low, key - row * width
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.ones(len(src), dtype=bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    return src[new], dst[new]


def binary(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """VByte bytes of ``values`` as one binary for each of the runs that begin at ``begin``."""
    raw, size = vbyte.encode(values)
    at = np.concatenate(([0], np.cumsum(size)))[np.append(begin, len(values))]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def _packed(src: np.ndarray, dst: np.ndarray, part: int | None = None) -> pa.RecordBatch:
    """Lists of sorted distinct pairs; in parts of ``part`` entries, if given, each with gaps of its own."""
    edges = _edges(src)
    begin = edges[:-1]
    if part is not None:
        place = np.arange(len(src)) - np.repeat(begin, np.diff(edges))
        begin = np.flatnonzero(place % part == 0)
    gap = np.diff(dst, prepend=0)
    gap[begin] = dst[begin]
    return pa.RecordBatch.from_arrays([pa.array(src[begin]), pa.array(np.diff(begin, append=len(src))), binary(gap, begin)], ["src", "n", "payload"])


def _slices(batches: Iterator[pa.RecordBatch], weight: str, most: int) -> Iterator[pa.RecordBatch]:
    """Whole rows whose column ``weight`` sums up to about ``most``."""
    for batch in batches:
        total = np.cumsum(batch.column(weight).to_numpy()) // most
        cuts = _edges(total).tolist()
        for x, y in zip(cuts, cuts[1:]):
            yield batch.slice(x, y - x)


def entries(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """src and dst of lists, whole rows and about ``most`` entries at a time."""
    for batch in _slices(batches, "n", most):
        gap, counts = _values(batch.column("payload"))
        total = np.cumsum(gap)
        before = np.concatenate(([0], total))[np.cumsum(counts) - counts]
        yield np.repeat(batch.column("src").to_numpy(), counts), total - np.repeat(before, counts)


def lists(edges: DataFrame) -> DataFrame:
    """src, n, payload: each vertex's distinct neighbours in both directions, without self-loops, as bytes of gaps. Ids are not negative.

    A task packs what it has of a list before the shuffle. The list of one vertex must fit a task's memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            src, dst = (np.concatenate(x) for x in zip(*held))
            if min(src.min(), dst.min()) < 0:
                raise ValueError("ids of vertices must not be negative")
            return _packed(*_distinct(np.concatenate((src, dst)), np.concatenate((dst, src))), PART)

        for batch in batches:
            if len(batch):
                held.append((batch.column("src").to_numpy(), batch.column("dst").to_numpy()))
                n += len(batch)
            if n >= AT_ONCE:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s, d in entries(batches):
            src, dst = _distinct(np.concatenate((src, s)), np.concatenate((dst, d)))
            done = int(np.searchsorted(src, src[-1]))
            if done:
                yield _packed(src[:done], dst[:done])
                src, dst = src[done:], dst[done:]
        if len(src):
            yield _packed(src, dst)

    spark = edges.sparkSession
    ship(spark)
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    parts = pairs.mapInArrow(pack, LISTS).repartition(shuffle_partitions(spark), "src")
    return parts.sortWithinPartitions("src").mapInArrow(merge, LISTS)


def expanded(lists: DataFrame) -> DataFrame:
    """src, dst of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in entries(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["src", "dst"])

    ship(lists.sparkSession)
    return lists.mapInArrow(run, "src long, dst long")


def places(lists: DataFrame, vertices: int) -> np.ndarray:
    """Place of each vertex by frequency from high to low, then id: the order of every row. A vertex stands in as many lists as its own has members."""
    counted = lists.select("src", "n").toPandas()
    src, n = counted["src"].to_numpy(), counted["n"].to_numpy()
    out = np.full(vertices, -1, np.int64)
    out[src[np.lexsort((src, -n))]] = np.arange(len(src))
    return out


def _ordered(src: np.ndarray, dst: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Members of lists, each list in the order of ``place``."""
    edges = _edges(src)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    return dst[np.argsort(row * len(place) + place[dst])]


def first_fit(lists: DataFrame, place: np.ndarray) -> DataFrame:
    """child, parent as ``forest.first_fit`` has them on ordered rows."""
    shared = lists.sparkSession.sparkContext.broadcast(place)
    names = ["child", "src", "parent"]

    def first(child: np.ndarray, src: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((src, child))
        order = order[np.diff(child[order], prepend=-1) != 0]
        return [child[order], src[order], parent[order]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in names]
        for src, dst in entries(batches, FEW):
            dst = _ordered(src, dst, shared.value)
            paired = np.flatnonzero(src[1:] == src[:-1])
            new = (dst[paired + 1], src[paired], dst[paired])
            held = first(*(np.concatenate(x) for x in zip(held, first(*new))))
            if len(held[0]) > AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)
                held = [np.zeros(0, np.int64) for _ in names]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)

    ship(lists.sparkSession)
    return lists.mapInArrow(run, "child long, src long, parent long").groupBy("child").agg(F.min_by("parent", "src").alias("parent"))


def encoded_rows(lists: DataFrame, parents: DataFrame, place: np.ndarray, most: int = MAX_STEPS) -> DataFrame:
    """src, payload, n_commands, n_edges as ``codecs.encoded_rows`` has them of the greedy cover."""
    context = lists.sparkSession.sparkContext
    shared = context.broadcast((place, parent_array(parents, len(place))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parent = shared.value
        for src, dst in entries(batches, FEW):
            dst = _ordered(src, dst, place)
            bottom, steps = greedy_commands(src, in_row_parents(src, dst, parent[dst]), most=most)
            own, path = src[bottom], steps > 0
            width = 1 + path
            at = np.cumsum(width) - width
            value = np.zeros(int(width.sum()), np.int64)
            value[at] = dst[bottom] * 2 + path
            value[at[path] + 1] = steps[path]
            begin = _edges(own)
            columns = [own[begin[:-1]], binary(value, at[begin[:-1]]), np.diff(begin), np.add.reduceat(steps + 1, begin[:-1])]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["src", "payload", "n_commands", "n_edges"])

    ship(lists.sparkSession)
    return lists.mapInArrow(run, COMMANDS)


def expanded_rows(batches: Iterator[pa.RecordBatch], parent: np.ndarray, most: int = FEW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """src and dst of encoded rows, whole rows and about ``most`` edges at a time, a row's members in no order."""
    for batch in _slices(batches, "n_edges", most):
        src, _, bottom, steps, _ = _decoded(batch.column("src").to_numpy(), batch.column("payload"))
        found = list(_walked(src, bottom, steps, parent))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))
