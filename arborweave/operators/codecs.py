"""Lossless codecs of neighbour lists: raw, delta, and parent-forest paths; decoding, verification, metrics.

A row's list becomes commands: a single node, or a node (``bottom``) and the ``steps`` ancestors above it
in the parent forest. Parents stand left of their children in every row (rows follow one global
order), so all ancestors of a node that stand in its row form a tree by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions import vbyte
from arborweave.functions.vbyte import command_bytes, vbyte_length
from arborweave.session import cut, ship

MAX_STEPS = 127
#: For covers whose paths may have any length; the number of steps is a VByte value like any other.
ANY_STEPS = 1 << 62
#: Parents as one array go to every executor up to this many vertices (8 bytes each); beyond it decoding joins.
BROADCAST_VERTICES = 10_000_000


def delta_gaps(adj: DataFrame) -> DataFrame:
    """src, dst, gap: rows ascending, the first value as it is."""
    row = Window.partitionBy("src").orderBy("dst")
    return adj.select("src", "dst", (F.col("dst") - F.coalesce(F.lag("dst").over(row), F.lit(0).cast("long"))).alias("gap"))


def delta_decode(gaps: DataFrame) -> DataFrame:
    """src, dst from src, seq, gap by running sums."""
    row = Window.partitionBy("src").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gaps.select("src", F.sum("gap").over(row).alias("dst"))


def delta_payload(adj: DataFrame) -> DataFrame:
    """src, payload, n_edges: the bytes of each row's gaps."""
    gaps = delta_gaps(adj).select("src", F.col("dst").alias("seq"), F.col("gap").alias("value"))
    return _payload(gaps).select("src", "payload", F.col("n_values").alias("n_edges"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All VByte values of a batch of payloads, and how many each payload holds (0 for null)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    value, ends = vbyte.decode(raw)
    return value, np.diff(np.searchsorted(ends, offsets - offsets[0], side="right"))


def delta_expanded(encoded: DataFrame) -> DataFrame:
    """src, dst from rows of gap bytes: running sums that begin anew with each row, without a sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, counts = _values(batch.column("payload"))
            total = np.cumsum(value)
            before = np.concatenate(([0], total))[np.cumsum(counts) - counts]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("src").to_numpy(), counts)), pa.array(total - np.repeat(before, counts))], ["src", "dst"])

    ship(encoded.sparkSession)
    return encoded.select("src", "payload").mapInArrow(run, "src long, dst long")


def _payload(values: DataFrame) -> DataFrame:
    """src, payload, n_values of (src, seq, value): VByte bytes in order of seq. A row's values meet in one task, as its list does in every codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, (value,) in _rows(batches, ("value",)):
            raw, size = vbyte.encode(value)
            edges = _edges(src)
            at = np.concatenate(([0], np.cumsum(size)))
            whole = raw.tobytes()
            payload = [whole[at[a] : at[b]] for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(src[edges[:-1]]), pa.array(payload, pa.binary()), pa.array(np.diff(edges))], ["src", "payload", "n_values"])

    ship(values.sparkSession)
    return values.repartition("src").sortWithinPartitions("src", "seq").select("src", "value").mapInArrow(run, "src long, payload binary, n_values long")


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole rows of a stream sorted by src: what a batch breaks off is carried to the next."""
    src, held = np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in names]
    for batch in batches:
        if not len(batch):
            continue
        src = np.concatenate((src, batch.column("src").to_numpy()))
        held = [np.concatenate((h, batch.column(n).to_numpy(zero_copy_only=False))) for h, n in zip(held, names)]
        done = int(np.searchsorted(src, src[-1]))
        if done:
            yield src[:done], [h[:done] for h in held]
            src, held = src[done:], [h[done:] for h in held]
    if len(src):
        yield src, held


def in_row_parents(src: np.ndarray, dst: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Index of each entry's parent in the same row, -1 for none. ``src`` is sorted; parent -1 for none."""
    edges = _edges(src)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    top = int(max(dst.max(initial=0), parent.max(initial=0))) + 2
    key, want = row * top + dst, row * top + parent
    order = np.argsort(key, kind="stable")
    at = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
    found = order[at]
    return np.where((parent >= 0) & (key[found] == want), found, -1)


def _levels(above: np.ndarray) -> list[np.ndarray]:
    """Entries by distance from their in-row root."""
    order = np.argsort(above, kind="stable")
    sorted_above = above[order]
    out = [np.flatnonzero(above < 0)]
    while len(out[-1]):
        low, high = np.searchsorted(sorted_above, out[-1]), np.searchsorted(sorted_above, out[-1], side="right")
        count = high - low
        begin = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        out.append(order[begin])
    return out[:-1]


def _scan(above: np.ndarray, first: int, last: int, least: int, most: int) -> list[tuple[int, int]]:
    """(bottom entry, steps) of one row, right to left: each free entry takes its free ancestors up to ``most`` steps, if ``least`` or more."""
    free, out = set(range(first, last)), []
    for bottom in range(last - 1, first - 1, -1):
        if bottom not in free:
            continue
        path, at = [bottom], above[bottom]
        while at in free and len(path) <= most:
            path.append(at)
            at = above[at]
        if len(path) - 1 < least:
            path = path[:1]
        free.difference_update(path)
        out.append((bottom, len(path) - 1))
    return out[::-1]


def greedy_commands(src: np.ndarray, above: np.ndarray, least: int = 1, most: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Bottom entries and steps of the greedy cover, in order of position.

    With least = 1 and no chain beyond ``most``, the cover has a closed form: an entry belongs to the rightmost entry
    of its subtree. Only rows with a longer chain, and covers with another ``least``, need the scan.
    """
    n = len(above)
    if least != 1:
        edges = _edges(src)
        found = [x for a, b in zip(edges, edges[1:]) for x in _scan(above, a, b, least, most)]
        return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    right = np.arange(n)
    levels = _levels(above)
    for entries in reversed(levels[1:]):
        np.maximum.at(right, above[entries], right[entries])
    size = np.bincount(right, minlength=n)
    bottom = np.flatnonzero(size)
    steps = size[bottom] - 1
    long = bottom[steps > most]
    if len(long):
        edges = _edges(src)
        capped = np.unique(np.searchsorted(edges, long, side="right") - 1)
        found = [x for r in capped for x in _scan(above, edges[r], edges[r + 1], least, most)]
        other = ~np.isin(np.searchsorted(edges, bottom, side="right") - 1, capped)
        bottom = np.concatenate((bottom[other], [x[0] for x in found])).astype(np.int64)
        steps = np.concatenate((steps[other], [x[1] for x in found])).astype(np.int64)
        order = np.argsort(bottom, kind="stable")
        bottom, steps = bottom[order], steps[order]
    return bottom, steps


def _ancestor(above: np.ndarray, distance: int) -> np.ndarray:
    """The entry ``distance`` levels above each entry, len(above) for none, by doubled jumps."""
    none = len(above)
    jump, out = np.append(np.where(above < 0, none, above), none), np.arange(none + 1)
    while distance:
        if distance & 1:
            out = jump[out]
        jump, distance = jump[jump], distance >> 1
    return out[:none]


def candidate_commands(src: np.ndarray, dst: np.ndarray, above: np.ndarray, most: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Bottom entries and steps of the plan by gain: disjoint chains of most saved bytes first, the rest singles.

    A chain goes from its bottom to the in-row root (``most`` steps at most) and saves its ancestors' single costs less the
    bytes of its steps. Chains of one tree all reach its root, so at most one per tree is taken; where the cap cuts chains
    short, chains are taken in order of gain as long as they are disjoint.
    """
    n = len(above)
    single = vbyte.lengths(dst * 2)
    saved, depth, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    levels = _levels(above)
    for entries in levels[1:]:
        up = above[entries]
        saved[entries], depth[entries], root[entries] = saved[up] + single[up], depth[up] + 1, root[up]
    gain = saved - vbyte.lengths(depth)
    edges = _edges(src)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    capped = np.unique(row[depth > most])
    usual = (depth > 0) & (gain > 0) & ~np.isin(row, capped)
    order = np.flatnonzero(usual)
    order = order[np.lexsort((dst[order], -depth[order], -gain[order], root[order]))]
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = root[order][1:] != root[order][:-1]
    bottom_steps, covered = np.full(n, -1, np.int64), np.zeros(n, dtype=bool)
    bottom_steps[order[keep]] = depth[order[keep]]
    covered[order[keep]] = True
    for entries in reversed(levels[1:]):  # a chain covers everything above its bottom
        covered[above[entries[covered[entries]]]] = True
    if len(capped):
        saved_far = np.append(saved, 0)[_ancestor(above, most)]
        steps, gain = np.minimum(depth, most), saved - saved_far - vbyte.lengths(np.minimum(depth, most))
        for r in capped:
            own = np.arange(edges[r], edges[r + 1])
            own = own[(steps[own] > 0) & (gain[own] > 0)]
            for bottom in own[np.lexsort((dst[own], -steps[own], -gain[own]))].tolist():
                path, at = [], bottom
                while len(path) <= steps[bottom] and not covered[at]:
                    path.append(at)
                    at = above[at]
                if len(path) > steps[bottom]:
                    covered[path] = True
                    bottom_steps[bottom] = steps[bottom]
    bottoms = np.flatnonzero(~covered | (bottom_steps >= 0))
    return bottoms, np.maximum(bottom_steps[bottoms], 0)


def _cost(bottom: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return vbyte.lengths(bottom * 2 + (steps > 0)) + np.where(steps > 0, vbyte.lengths(steps), 0)


def tree_commands(rows: DataFrame, parents: DataFrame, least: int = 1, optimised: bool = False, most: int = MAX_STEPS) -> DataFrame:
    """src, seq, bottom, steps, is_path of every row of ordered_rows().

    ``optimised``: per row the plan by gain where it takes strictly fewer bytes than the greedy cover. Rows are the
    unit of work; the largest row (degree) must fit a task's memory at 8 bytes a field.
    """
    pairs = parents.select(F.col("child").alias("__child"), "parent")
    joined = rows.join(pairs, F.col("dst") == F.col("__child"), "left").select("src", "pos", "dst", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, (dst, parent) in _rows(batches, ("dst", "parent")):
            above = in_row_parents(src, dst, parent)
            bottom, steps = greedy_commands(src, above, least, most)
            if optimised:
                other, other_steps = candidate_commands(src, dst, above, most)
                edges = _edges(src)
                def total(b: np.ndarray, s: np.ndarray) -> np.ndarray:
                    return np.bincount(np.searchsorted(edges, b, side="right") - 1, weights=_cost(dst[b], s), minlength=len(edges) - 1)

                better = total(other, other_steps) < total(bottom, steps)
                mine, theirs = (better[np.searchsorted(edges, b, side="right") - 1] for b in (bottom, other))
                bottom, steps = np.concatenate((bottom[~mine], other[theirs])), np.concatenate((steps[~mine], other_steps[theirs]))
                order = np.argsort(bottom, kind="stable")
                bottom, steps = bottom[order], steps[order]
            own = src[bottom]
            begin = _edges(own)
            seq = np.arange(len(own)) - np.repeat(begin[:-1], np.diff(begin))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seq), pa.array(dst[bottom]), pa.array(steps), pa.array(steps > 0)], ["src", "seq", "bottom", "steps", "is_path"])

    ship(rows.sparkSession)
    return joined.repartition("src").sortWithinPartitions("src", "pos").select("src", "dst", "parent").mapInArrow(run, "src long, seq long, bottom long, steps long, is_path boolean")


def encoded_rows(commands: DataFrame) -> DataFrame:
    """src, payload, n_commands: the byte stream of each row."""
    parts = F.when(F.col("is_path"), F.array(F.col("bottom") * 2 + 1, F.col("steps"))).otherwise(F.array(F.col("bottom") * 2))
    values = commands.select("src", "seq", "steps", F.posexplode(parts).alias("part", "value")).select("src", (F.col("seq") * 2 + F.col("part")).alias("seq"), "value")
    counted = commands.groupBy(F.col("src").alias("__src")).agg(F.count("*").alias("n_commands"), F.sum(F.col("steps") + 1).alias("n_edges"))
    return _payload(values).join(counted, F.col("src") == F.col("__src")).select("src", "payload", "n_commands", "n_edges")


def _decoded(src: np.ndarray, payload: pa.Array) -> tuple[np.ndarray, ...]:
    """src, seq, bottom, steps, is_path of rows' commands."""
    value, counts = _values(payload)
    if not len(value):
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool)
    odd = (value & 1) == 1
    index = np.arange(len(value))
    begin = np.where(np.concatenate(([True], ~odd[:-1])), index, 0)
    is_command = (index - np.maximum.accumulate(begin)) % 2 == 0
    at = np.flatnonzero(is_command)
    path = odd[at]
    steps = np.where(path, value[np.minimum(at + 1, len(value) - 1)], 0)
    edges = _edges(np.repeat(np.arange(len(counts)), counts)[at])
    seq = np.arange(len(at)) - np.repeat(edges[:-1], np.diff(edges))
    return np.repeat(src, counts)[at], seq, value[at] >> 1, steps, path


def decoded_commands(encoded: DataFrame) -> DataFrame:
    """src, seq, bottom, steps, is_path from byte streams. A value is a command unless the command before it asks for steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, seq, bottom, steps, path = _decoded(batch.column("src").to_numpy(), batch.column("payload"))
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (src, seq, bottom, steps, path)], ["src", "seq", "bottom", "steps", "is_path"])

    ship(encoded.sparkSession)
    return encoded.select("src", "payload").mapInArrow(run, "src long, seq long, bottom long, steps long, is_path boolean")


def expanded(commands: DataFrame, parents: DataFrame, vertices: int | None = None) -> DataFrame:
    """src, dst of every command: its bottom and ``steps`` ancestors.

    Up to BROADCAST_VERTICES (``vertices``: their checked number) parents travel as one array. Beyond it, or if
    the number isn't given, ancestors are fetched by joins, doubling the distance each round.
    """
    if vertices is not None and vertices <= BROADCAST_VERTICES:
        return _expanded_by_array(commands, parents, vertices)
    return _expanded_by_joins(commands, parents)


def _walked(src: np.ndarray, node: np.ndarray, steps: np.ndarray, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """src and node of all commands' bottoms, then of their ancestors one step up, and so on."""
    while len(node):
        yield src, node
        more = steps > 0
        src, node, steps = src[more], parent[node[more]], steps[more] - 1
        src, steps, node = src[node >= 0], steps[node >= 0], node[node >= 0]


def _expanded_by_array(commands: DataFrame, parents: DataFrame, vertices: int) -> DataFrame:
    from arborweave.operators.forest import parent_array

    spark = commands.sparkSession
    shared = spark.sparkContext.broadcast(parent_array(parents, vertices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, node in _walked(*(batch.column(c).to_numpy() for c in ("src", "bottom", "steps")), shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(node)], ["src", "dst"])

    ship(spark)
    return commands.select("src", "bottom", "steps").mapInArrow(run, "src long, dst long")


def _expanded_by_joins(commands: DataFrame, parents: DataFrame) -> DataFrame:
    """A command of s steps is two of about half as many, the second from the ancestor half way; jumps of 2^k are composed by self-joins, as many as the longest command needs."""
    most = commands.agg(F.max("steps")).first()[0] or 0
    jumps = [cut(parents.select(F.col("child").alias("node"), F.col("parent").alias("up")))]
    while 1 << len(jumps) <= most:
        a, b = jumps[-1], jumps[-1].select(F.col("node").alias("mid"), F.col("up").alias("top"))
        jumps.append(cut(a.join(b, F.col("up") == F.col("mid")).select("node", F.col("top").alias("up"))))
    every = commands.select("src", F.col("bottom").alias("node"), (F.col("steps") + 1).cast("long").alias("count"))
    done = [every.filter("count = 1")]
    open_ones = cut(every.filter("count > 1"))
    for k in reversed(range(len(jumps))):
        size = 1 << k
        # The upper part of more than 2^k nodes starts 2^k above.
        long = open_ones.filter(F.col("count") > size).join(jumps[k].withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"))
        upper = long.select("src", F.col("up").alias("node"), (F.col("count") - size).alias("count"))
        split = cut(open_ones.withColumn("count", F.least("count", F.lit(size).cast("long"))).unionByName(upper))
        done.append(split.filter("count = 1"))
        open_ones = split.filter("count > 1")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("src", F.col("node").alias("dst"))


def holds(commands: DataFrame, parents: DataFrame, probes: DataFrame, vertices: int | None = None) -> DataFrame:
    """src, dst of those ``probes`` that stand in their row, looked up in the commands of the probed rows alone."""
    probed = commands.join(probes.select(F.col("src").alias("__src")).distinct(), F.col("src") == F.col("__src"), "left_semi")
    return probes.select("src", "dst").join(expanded(probed, parents, vertices), ["src", "dst"], "left_semi")


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables hold the same rows the same number of times."""
    return a.select("src", "dst").exceptAll(b.select("src", "dst")).isEmpty() and b.select("src", "dst").exceptAll(a.select("src", "dst")).isEmpty()


def size_metrics(codec: str, n_edges, n_bytes) -> list:
    """Columns of one metric row from aggregates."""
    bytes_ = F.coalesce(n_bytes, F.lit(0)).cast("long")
    edges = n_edges.cast("long")
    bpe = F.when(edges > 0, F.round(bytes_ * 8.0 / edges, 6))
    return [F.lit(codec).alias("codec"), edges.alias("n_edges"), bytes_.alias("bytes"), F.round(bytes_ / F.lit(1048576.0), 6).alias("data_mb"), bpe.alias("bpe"), F.when(edges > 0, F.round(bytes_ * 25.0 / edges, 6)).alias("ratio_pct")]


def raw_metrics(adj: DataFrame) -> DataFrame:
    return adj.agg(F.count("*").alias("n")).select(*size_metrics("raw32", F.col("n"), F.col("n") * 4))


def delta_metrics(adj: DataFrame) -> DataFrame:
    return delta_gaps(adj).agg(F.count("*").alias("n"), F.sum(vbyte_length(F.col("gap"))).alias("b")).select(*size_metrics("delta_vbyte", F.col("n"), F.col("b")))


def command_metrics(codec: str, commands: DataFrame) -> DataFrame:
    cost = command_bytes(F.col("bottom"), F.col("steps"), F.col("is_path"))
    return commands.agg(F.coalesce(F.sum(F.col("steps") + 1), F.lit(0)).alias("n"), F.sum(cost).alias("b")).select(*size_metrics(codec, F.col("n"), F.col("b")))


def token_ratios(commands: DataFrame, n_vertices: int) -> DataFrame:
    """Commands per edge (1 without edges), paths per command (0 without), and bits per edge with parents and offsets counted in."""
    cost = command_bytes(F.col("bottom"), F.col("steps"), F.col("is_path"))
    sums = commands.agg(F.count("*").alias("n_commands"), F.coalesce(F.sum(F.col("is_path").cast("long")), F.lit(0)).alias("n_paths"), F.coalesce(F.sum(F.col("steps") + 1), F.lit(0)).alias("n_edges"), F.coalesce(F.sum(cost), F.lit(0)).alias("bytes"))
    token_edge = F.when(F.col("n_edges") > 0, F.round(F.col("n_commands") / F.col("n_edges"), 6)).otherwise(1.0)
    path_token = F.when(F.col("n_commands") > 0, F.round(F.col("n_paths") / F.col("n_commands"), 6)).otherwise(0.0)
    total = F.when(F.col("n_edges") > 0, F.round((F.col("bytes") * 8.0 + 32.0 * n_vertices + 32.0 * (n_vertices + 1)) / F.col("n_edges"), 6))
    return sums.select("n_commands", "n_paths", "n_edges", "bytes", token_edge.alias("token_edge_ratio"), path_token.alias("path_token_ratio"), total.alias("total_bpe"))
