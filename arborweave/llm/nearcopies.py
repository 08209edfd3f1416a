"""SimHash near-dedup at a similarity of word shingles: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

At 0.8, fingerprints of 64 bits differ in about ten bits, far beyond the radius for which blocks of equal bits are certain, so
the shards are dealt by another key; trees, fingerprints and components are those of ``simhash``.

1. Every text gives its set of shingle hashes (XXH64), a SimHash of the set, and a parity sketch (below). Texts with equal
   sets are one point, however many they are.
2. Shards: 24 bands of 5 MinHash values each. A pair at 0.8 agrees in some band with probability 0.9999, and
   closer pairs more surely; sets of under four shingles reach 0.8 only if they are equal, so they have no bands.
   Only points that share a band with another go on.
3. A shard is a BK-tree of SimHashes, searched within ``RADIUS`` bits (over four standard deviations beyond the mean at 0.8).
   The pairs found are held to two bounds that no near pair fails: the sizes' ratio, and the parity sketches. A sketch
   has a bit for each residue of the hashes, set if an odd number of them fall there; two sketches differ in at most as many bits as the
   sets differ in elements, and near sets differ in at most a ninth of the sum of their sizes.
4. First a shard gives one pair per point, the likeliest; these are checked exactly on the whole sets, and components are
   found. Then the shards that still hold several components give all their pairs of different components that
   pass the bounds, so every candidate is either joined already or checked. A band of over ``SHARD_POINTS`` points is dealt out in
   groups: by itself each at first, then every two groups together.
5. Of each component one row stays: the first by doc_id, null last, and then by the text's hash.

Edge cases: null, empty and wordless texts have the empty set and are one point; fewer words than a shingle make one
shingle; several texts under one doc_id, and rows with null doc_id, are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.functions.sieve import sieve, sifted
from arborweave.llm import simhash
from arborweave.operators.components import component_labels
from arborweave.session import cut, ship

SHINGLE_WORDS = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
SHARED, OF = 4, 5
BANDS, BAND_ROWS = 24, 5
LEAST_SHINGLES = 4
RADIUS = 26
#: Points of a shard that one task takes at once.
SHARD_POINTS = 4096
#: Bits of a sketch, at least and at most; between them two to four a shingle.
LEAST_BITS, MOST_BITS = 128, 1 << 14
#: Texts held as sets at once.
TEXTS = 256
_draw = np.random.Generator(np.random.PCG64(42))
_FACTORS = (_draw.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_MASKS = _draw.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's shingles, each once."""
    return np.unique(np.array(simhash.shingle_hashes(text or "", SHINGLE_WORDS), dtype="<u8"))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band."""
    if len(hashes) < LEAST_SHINGLES:
        return []
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, dtype=np.uint32)
    for a in range(0, len(short), 512):
        np.minimum(low, ((short[None, a : a + 512] ^ _MASKS) * _FACTORS).min(axis=1), out=low)
    data, step = low.astype("<u4").tobytes(), 4 * BAND_ROWS
    return [xxhash.xxh64_intdigest(data[i * step : (i + 1) * step], i) for i in range(BANDS)]


def sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch of a set, as little-endian words of 64 bits."""
    bits = min(max(1 << (2 * len(hashes)).bit_length(), LEAST_BITS), MOST_BITS)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of many points in one matrix for each width."""

    def __init__(self, column: list[bytes]) -> None:
        self.width = np.array([len(x) // 8 for x in column], dtype=np.int64)
        self.place = np.zeros(len(column), dtype=np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join(column[i] for i in at), dtype="<u8").reshape(-1, w)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of differing bits of pairs; the wider sketch is folded to the other's width, which keeps the bound."""
        out = np.zeros(len(a), dtype=np.int64)
        widths = self.width[a] * (MOST_BITS // 64 + 1) + self.width[b]
        for both in np.unique(widths).tolist():
            at = np.flatnonzero(widths == both)
            wide, narrow = divmod(both, MOST_BITS // 64 + 1)
            left, right = a[at], b[at]
            if wide < narrow:
                wide, narrow, left, right = narrow, wide, right, left
            step = max(1, (1 << 17) // wide)
            for i in range(0, len(at), step):
                x, y = self.of[wide][self.place[left[i : i + step]]], self.of[narrow][self.place[right[i : i + step]]]
                if wide > narrow:
                    x = np.bitwise_xor.reduce(x.reshape(len(x), wide // narrow, narrow), axis=1)
                out[at[i : i + step]] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, each sorted and without repeats, are near."""
    low, high = sorted((len(a), len(b)))
    if OF * low < SHARED * high:
        return False
    common = low + high - len(np.unique(np.concatenate((a, b))))
    return OF * common >= SHARED * (low + high - common)


def may_be_similar(size: np.ndarray, sketches: Sketches, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the pairs that pass the bounds, and the share of elements in which they seem to differ."""
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    at = np.flatnonzero(OF * low >= SHARED * high)
    both = size[a[at]] + size[b[at]]
    differ = sketches.differing(a[at], b[at])
    kept = (OF + SHARED) * differ <= (OF - SHARED) * both
    return at[kept], differ[kept] / both[kept]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _key(docs: DataFrame) -> list[Column]:
    """unnamed, id, text_hash: what tells rows apart, none of it null."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().alias("unnamed"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("text_hash")]


KEY = ["unnamed", "id", "text_hash"]


def prints(docs: DataFrame) -> DataFrame:
    """unnamed, id, text_hash, sid (of the shingle set), n (its size), fp, sketch, bands."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, fps, sketches, keys, ends = [], [], [], [], [], [0]
        for t in batch.column("text").to_pylist():
            hashes = shingle_set(t)
            ids.append(set_id(hashes))
            sizes.append(len(hashes))
            fps.append(simhash.majority(hashes))
            sketches.append(sketch(hashes))
            keys += band_keys(hashes)
            ends.append(len(keys))
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(keys))
        columns = [*map(batch.column, KEY), _signed(ids), pa.array(sizes, pa.int32()), _signed(fps), pa.array(sketches, pa.binary()), bands]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "sid", "n", "fp", "sketch", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), TEXTS):
                yield made(batch.slice(a, TEXTS))

    ship(docs.sparkSession)
    return docs.select(*_key(docs), "text").mapInArrow(run, "unnamed boolean, id long, text_hash long, sid long, n int, fp long, sketch binary, bands array<long>")


def _likeliest(near: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], points: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each point the earlier one from which it seems to differ least."""
    share, other = np.full(points, np.inf), np.full(points, -1)
    for a, b, d in near:
        order = np.lexsort((b, d, a))
        first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
        better = first[d[first] < share[a[first]]]
        share[a[better]], other[a[better]] = d[better], b[better]
    at = np.flatnonzero(other >= 0)
    yield at, other[at]


def _pairs(shards: DataFrame, across: bool) -> DataFrame:
    """a, b (a < b, each pair once) of shards (band, low, high, own, root, sid, n, fp, sketch).

    ``across``: all pairs of different components, in shards of two groups those of different groups; else one pair per point.
    """
    keys = ("band", "low", "high")
    dealt = shards.repartition(*keys).sortWithinPartitions(*keys, "fp", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in simhash.whole_shards(batches, keys):
            key = [held.column(k).to_numpy() for k in keys]
            sid, root, own, size = (held.column(c).to_numpy() for c in ("sid", "root", "own", "n"))
            first = simhash.first_of_shards(*key)
            forest = simhash.BKForest(held.column("fp").to_numpy().view(np.uint64), first)
            sketches, size = Sketches(held.column("sketch").to_pylist()), size.astype(np.int64)
            two_groups = key[1] != key[2]

            def near() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for a, b in forest.links(RADIUS):
                    wanted = b < a
                    if across:
                        wanted &= (root[a] != root[b]) & (~two_groups[a] | (own[a] != own[b]))
                    a, b = a[wanted], b[wanted]
                    at, share = may_be_similar(size, sketches, a, b)
                    yield a[at], b[at], share

            found = ((a, b) for a, b, _ in near()) if across else _likeliest(near(), len(sid))
            for a, b in found:
                if len(a):
                    x, y = sid[a], sid[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    ship(shards.sparkSession)
    return dealt.select(*keys, "own", "root", "sid", "n", "fp", "sketch").mapInArrow(run, "a long, b long").distinct()


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst: the pairs that are near by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("hashes_a"), batch.column("hashes_b"))
            near = pa.array([similar(*[np.frombuffer(x.as_buffer(), "<u8") for x in pair]) for pair in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(near).rename_columns(["src", "dst"])

    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))
    needed = cut(sifted(sets, F.xxhash64("sid"), sieve(ends, F.xxhash64("sid")), "needed").filter("needed"))
    one, two = (needed.select(F.col("sid").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(check, "src long, dst long"))


def _whole_sets(points: DataFrame, docs: DataFrame) -> DataFrame:
    """sid, hashes: the sets of ``points``, made again from one text each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), TEXTS):
                part = batch.slice(a, TEXTS)
                yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array([shingle_set(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["sid", "hashes"])

    chosen = points.select("sid", "best.*")
    keyed = docs.select(*_key(docs), "text")
    texts = sifted(keyed, F.xxhash64(*KEY), sieve(chosen, F.xxhash64(*KEY)), "held").filter("held").drop("held").join(chosen, KEY).dropDuplicates(KEY).select("sid", "text")
    return cut(texts.mapInArrow(sets, "sid long, hashes binary"))


def _dealt(shared: DataFrame, points: DataFrame, across: bool) -> DataFrame:
    """The rows (band, size, sid) of ``shared`` as shards with their points' columns."""
    groups = F.ceil(F.col("size") / F.lit(SHARD_POINTS)).cast("int")
    own = F.pmod(F.xxhash64("sid", "band"), groups).cast("int")
    grouped = shared.withColumn("own", own)
    if across:
        grouped = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
    else:
        grouped = grouped.withColumn("other", F.col("own"))
    return grouped.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sid").join(points.select("sid", "root", "n", "fp", "sketch"), "sid")


def _rooted(points: DataFrame, links: DataFrame) -> DataFrame:
    labels = component_labels(links).select(F.col("id").alias("sid"), F.col("component").alias("root"))
    return points.join(labels, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def survivors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unnamed, id, text_hash of each component's row that stays; and of all rows by set: sid, unnamed, id, text_hash, rows."""
    each = cut(prints(docs))
    texts = each.groupBy("sid", *KEY).agg(F.count("*").alias("rows"))
    points = cut(each.groupBy("sid").agg(F.min(F.struct(*KEY)).alias("best"), *[F.max(c).alias(c) for c in ("n", "fp", "sketch", "bands")]))
    buckets = points.select("sid", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(buckets.join(sizes, "band"))
    candidates = cut(points.drop("bands").join(shared.select("sid").distinct(), "sid", "left_semi"))
    sets = _whole_sets(candidates, docs)
    first = cut(_pairs(_dealt(shared, candidates.withColumn("root", F.col("sid")), False), False))
    links = _checked(first, sets)
    rooted = cut(_rooted(candidates, links))
    # Bands that hold several components still.
    mixed = shared.join(rooted.select("sid", "root"), "sid").groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    more = cut(_pairs(_dealt(shared.join(mixed, "band", "left_semi"), rooted, True), True).join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty() and not (found := _checked(more, sets)).isEmpty():
        rooted = _rooted(candidates, links.union(found))
    alone = points.select("sid", "best").join(rooted.select("sid"), "sid", "left_anti").select(F.col("sid").alias("root"), "best")
    every = rooted.select("root", "best").groupBy("root").agg(F.min("best").alias("best")).union(alone)
    return every.select("best.*"), texts


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies; all columns of ``docs``.

    Only rows that may go, by a sieve of their keys, are shuffled with their texts.
    """
    kept, texts = survivors(docs)
    kept, key = cut(kept), F.xxhash64(*KEY)
    doubtful = texts.select(*KEY, "rows").join(kept.withColumn("kept", F.lit(True)), KEY, "left").filter("kept IS NULL OR rows > 1")
    keyed = docs.select(F.struct("*").alias("row"), *_key(docs))
    marked = sifted(keyed, key, cut(sieve(doubtful, key)), "doubtful")
    certain = marked.filter("NOT doubtful").select("row.*")
    return certain.unionByName(marked.filter("doubtful").join(kept, KEY, "left_semi").dropDuplicates(KEY).select("row.*"))
