"""SimHash near-duplicates: BK-trees over shards of fingerprints.

1. Fingerprints: words and word shingles of whole texts, XXH64 of every shingle, a majority vote per bit.
2. Equal fingerprints collapse into one row that carries their smallest doc_id, so a group of exact
   copies, however large, is one point.
3. The 64 bits are four blocks of 16. Two fingerprints with at most two differing bits agree in two
   blocks at least, so a fingerprint goes to six shards, one for each pair of blocks, keyed by those 32 bits.
   Each shard is a BK-tree: children hang under their parent by Hamming distance, and a search
   follows only edges within the radius of its own distance. Shard trees would be broadcast if they were
   bounded; they grow with the corpus, so each tree is built in the task that holds its shard, and the shard's own
   points are the searches. A shard of over ``SHARD_POINTS`` points is cut further, by the same argument about the bits left.
4. A shard returns one link per point that isn't the first of its local component, never all pairs. Components of
   the links are found by shared label rounds with reliable checkpoints.

Near copies by the similarity of word shingles, as the pipeline drops them, are in ``nearcopies``; it searches the same trees.

Edge cases: null, empty or wordless texts have fingerprint 0, linked like any other; fewer words than
a shingle make one shingle; repeated rows share their component; rows with null doc_id take part and never give a name
to a component with other ids; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.operators.components import component_labels
from arborweave.session import cut, ship

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BLOCK_BITS = 16
#: Points of a shard that one task takes as it is; a larger shard is refined.
SHARD_POINTS = 1 << 15
_UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """Unsigned XXH64 of every shingle of the lower-cased text, repeats included."""
    found = _WORD.findall(text.translate(_UPPER).encode("utf-8", "surrogatepass"))
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends = list(itertools.accumulate(map(len, found)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of one text: bits that are set in over half of its hashes."""
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 15):
        part = hashes[a : a + (1 << 15)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [majority(np.array(shingle_hashes(t or "", words), dtype=np.uint64)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees of many shards at once, as arrays; built and searched a level at a time.

    ``root`` names each point's tree by the index of its first point. Children hang under their parent by Hamming distance.
    """

    def __init__(self, points: np.ndarray, root: np.ndarray) -> None:
        self.points, self.root = points, root
        n = len(points)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        waiting = np.flatnonzero(root != np.arange(n))
        at = root[waiting]
        while len(waiting):
            distance = np.bitwise_count(points[waiting] ^ points[at]).astype(np.int64)
            _, first, group = np.unique(at * 65 + distance, return_index=True, return_inverse=True)
            child = waiting[first]
            self.parent[child], self.edge[child] = at[first], distance[first]
            rest = np.ones(len(waiting), dtype=bool)
            rest[first] = False
            at, waiting = child[group][rest], waiting[rest]
        key = self.parent * 65 + self.edge
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def links(self, radius: int, searches: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (search, point) of a tree within ``radius``, in bounded batches; every point is a search if none are named."""
        searches = np.arange(len(self.points)) if searches is None else searches
        stack = [(part, self.root[part]) for part in np.split(searches, range(1024, len(searches), 1024))]
        while stack:
            search, node = stack.pop()
            if len(search) > 1 << 14:
                half = len(search) // 2
                stack += [(search[:half], node[:half]), (search[half:], node[half:])]
                continue
            distance = np.bitwise_count(self.points[search] ^ self.points[node]).astype(np.int64)
            near = (distance <= radius) & (search != node)
            if near.any():
                yield search[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), side="right")
            count = high - low
            if total := int(count.sum()):
                begin = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
                stack.append((np.repeat(search, count), self.order[begin]))


def local_components(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable for each of n points."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def first_of_shards(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's shard; rows are sorted by their keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts[np.cumsum(new) - 1]


def shard_links(keys: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, first point of its component) within each shard of a key; keys are sorted."""
    label = local_components(len(points), BKForest(points, first_of_shards(keys)).links(radius))
    far = np.flatnonzero(label != np.arange(len(points)))
    return points[far], points[label[far]]


def whole_shards(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches in tables that end where a shard ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        begin = int(first_of_shards(*[batch.column(k).to_numpy() for k in keys])[-1])
        same = bool(held) and all(held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in keys)
        if begin or not same:  # what is held ends here, with the batch's first shards
            ready = [*held, batch.slice(0, begin)] if begin else held
            if ready:
                yield pa.Table.from_batches(ready)
            held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _refined(shards: DataFrame) -> DataFrame:
    """Shards (shard, fp) of over ``SHARD_POINTS`` points in three parts each, keyed by a third of the 32 bits in which their points
    may differ: of two points with two differing bits there, one third agrees. No part holds over 2^22 points.
    """
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_POINTS).select(F.col("shard").alias("hot"))
    whole = shards.select("shard", F.lit(0).alias("part"), "fp")
    hot = cut(sizes)
    if hot.isEmpty():
        return whole
    pair = F.floor(F.col("shard") / F.lit(1 << 32)).cast("int")
    blocks = [F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(64 // BLOCK_BITS)]
    rest = F.lit(None).cast("long")
    for i, j in itertools.combinations(range(4), 2):
        a, b = (k for k in range(4) if k not in (i, j))
        rest = F.when(pair == i * 4 + j, blocks[a] * F.lit(1 << BLOCK_BITS) + blocks[b]).otherwise(rest)
    thirds = F.array(*[((k + 1) * F.lit(1 << 11) + F.shiftrightunsigned(rest, s).bitwiseAND(F.lit((1 << w) - 1))).cast("int") for k, (s, w) in enumerate(((0, 11), (11, 11), (22, 10)))])
    is_hot = F.col("shard") == F.col("hot")
    return whole.join(hot, is_hot, "left_anti").unionByName(whole.join(hot, is_hot, "left_semi").select("shard", F.explode(thirds).alias("part"), "fp"))


def fingerprint_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: links that connect all fingerprints (column fp, distinct) within ``radius`` of each other."""
    if not 0 <= radius <= 2:
        raise ValueError("two agreeing blocks of four are certain up to radius 2 only")
    blocks = [F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(64 // BLOCK_BITS)]
    shards = F.array(*[F.lit(i * 4 + j).cast("long") * F.lit(1 << 32) + blocks[i] * F.lit(1 << BLOCK_BITS) + blocks[j] for i, j in itertools.combinations(range(4), 2)])
    dealt = _refined(points.select("fp", F.explode(shards).alias("shard"))).repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_shards(batches, ("shard", "part")):
            key = held.column("shard").to_numpy() * np.int64(1 << 14) + held.column("part").to_numpy()
            src, dst = shard_links(key, held.column("fp").to_numpy().view(np.uint64), radius)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    ship(points.sparkSession)
    return dealt.select("shard", "part", "fp").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included)."""
    prints = cut(fingerprints(docs, words))
    return components_of(prints, radius)


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    labels = component_labels(fingerprint_links(points.select("fp"), radius))  # only fingerprints with a link
    named = points.join(labels, points["fp"] == labels["id"], "left").select("fp", "smallest", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = named.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("class_fp"), "component_id")
    joined = prints.join(classes, F.col("fp") == F.col("class_fp"), "inner")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
