"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, phrases into longer phrases, and so on. At each level:
runs of one symbol become one symbol; deterministic coin tossing turns symbols into small labels
(twice the lowest bit in which a symbol differs from its left neighbour, plus that bit, three
times over), neighbours staying different; phrases begin at the local minima of the labels. A boundary depends on a few
neighbouring symbols only, so equal substrings are parsed alike in their interior at any
offset. A phrase's name is a hash of its symbols in order. Levels go on until a text is one phrase.

The fingerprint is a bottom-k sketch of the names of all levels, weighted by the phrase's length alone: a phrase of ``FULL`` code
points or more counts in full, a shorter one, which many texts share, by the cube of its share of that. A name's rank is an
exponential variate drawn from its hash at the rate of its weight, so the smallest ranks are a weighted sample that all texts draw alike.
Likeness is the common share of the weight: exact while the sketches hold all names, beyond that estimated from the smallest ranks of the union.

Edge cases: null text counts as empty; empty texts have the empty fingerprint, which is like itself (1) and unlike any
other (0); equal rows have equal fingerprints; rows with null doc_id come last in
descending order; in a table of one row the next document is the row itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.session import ship, shuffle_partitions

SKETCH = 64
#: Length in code points from which a phrase has the whole weight.
FULL = 8
#: Code points parsed at once.
BATCH_CHARS = 300_000
_ODD1, _ODD2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = (np.arange(1, FULL + 1) / FULL) ** 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD1
    x = (x ^ (x >> np.uint64(27))) * _ODD2
    return x ^ (x >> np.uint64(31))


def _toss_table(size: int) -> np.ndarray:
    """Label of (symbol, left neighbour) for symbols below ``size``; equal ones can't be neighbours."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = own ^ left
    low = np.bitwise_count((differ & -differ) - 1)
    return np.where(differ == 0, own & 1, 2 * low + (own >> low & 1)).astype(np.uint8).ravel()


_TOSS128, _TOSS16 = _toss_table(128), _toss_table(16)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8, different between neighbours of a text; ``first``: where texts begin."""
    differ = symbols.copy()
    differ[1:] ^= symbols[:-1]
    differ[first] = np.uint64(1)
    low = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1))
    label = (place << 1) | ((symbols & low) != 0)
    for table, bits in ((_TOSS128, 7), (_TOSS16, 4)):
        index = label.astype(np.uint16) << bits
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        label = table[index | left]
    return label


def parse_level(symbols: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and sizes (in code points) of the phrases of all texts, and the index of each text's first phrase. No text is empty."""
    begins = np.empty(len(symbols), dtype=bool)
    begins[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    begins[first] = True
    at = np.flatnonzero(begins)
    if len(at) < len(symbols):
        run = np.diff(at, append=len(symbols)).astype(np.uint64)
        first = np.searchsorted(at, first)
        symbols, sizes = symbols[at], np.add.reduceat(sizes, at)
        symbols = np.where(run > 1, _mix(symbols + run * _STEP), symbols)
    label = _labels(symbols, first)
    begins = np.zeros(len(symbols), dtype=bool)
    begins[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    begins[first] = True
    last = np.append(first[1:], len(symbols)) - 1
    begins[np.setdiff1d(last, first)] = False  # a phrase of the last symbol alone would depend on the text's end
    at = np.flatnonzero(begins)
    count = np.diff(at, append=len(symbols))
    inside = np.arange(len(symbols), dtype=np.uint64) - np.repeat(at.astype(np.uint64), count)
    names = _mix(np.add.reduceat(_mix(symbols + inside * _STEP), at))
    return names, np.add.reduceat(sizes, at), np.searchsorted(at, first)


def ranks(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exponential variates at the rate of the phrases' weights, as the bits of 32-bit floats, which keep their order.

    The last three bits tell the weight: the phrase's size less one, ``FULL`` at most.
    """
    even = ((names >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    size = np.minimum(sizes, FULL)
    drawn = (-np.log(even) / (size / FULL) ** 3).astype(np.float32).view(np.uint32)
    return (drawn & np.uint32(0xFFFFFFF8)) | (size - 1).astype(np.uint32)


def fingerprint_all(texts: list[str], sketch: int = SKETCH) -> list[np.ndarray]:
    """Sorted 32-bit sketch of every text."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
    part: list[int] = []
    chars = 0
    for i, text in enumerate(texts):
        if text:
            part.append(i)
            chars += len(text)
        if part and (chars > BATCH_CHARS or i == len(texts) - 1):
            for k, own in zip(part, _sketches([texts[j] for j in part], sketch)):
                out[k] = own
            part, chars = [], 0
    return out


def _sketches(texts: list[str], sketch: int) -> list[np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.ones(len(symbols), dtype=np.int64)
    owners: list[np.ndarray] = []
    drawn: list[np.ndarray] = []
    open_texts, level = np.ones(len(texts), dtype=bool), 0
    while open_texts.any():
        level += 1
        symbols, sizes, first = parse_level(symbols, sizes, first)
        count = np.diff(first, append=len(symbols))
        chosen = np.repeat(open_texts, count)
        drawn.append(ranks(_mix(symbols[chosen] + np.uint64(level * int(_STEP) % (1 << 64))), sizes[chosen]))
        owners.append(np.repeat(np.arange(len(texts), dtype=np.uint64), count)[chosen])
        open_texts &= count > 1  # a text that is one phrase has no further level
    owner, rank = np.concatenate(owners), np.concatenate(drawn)
    # Ranks above a bound that three sketches' worth of names should fall below needn't be sorted; a text that has too few below it keeps all.
    weight = np.bincount(owner.view(np.int64), weights=_WEIGHTS[rank & np.uint32(7)], minlength=len(texts))
    below = rank <= (3 * sketch / weight).astype(np.float32).view(np.uint32)[owner]
    keyed = np.unique((owner[below] << np.uint64(32)) | rank[below])
    few = np.bincount((keyed >> np.uint64(32)).view(np.int64), minlength=len(texts)) < sketch
    rest = few[owner] & ~below
    if rest.any():
        keyed = np.unique(np.concatenate((keyed, (owner[rest] << np.uint64(32)) | rank[rest])))
    edges = np.searchsorted(keyed, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = keyed.astype(np.uint32)
    return [low[a : min(b, a + sketch)] for a, b in zip(edges, edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Share of the weight of common names in that of all names of two texts: exact if neither sketch is full, else estimated.

    The estimate takes the smallest ranks of the union below the last one that both sketches are sure to know, each entry's weight divided
    by the probability that a name of this weight has a rank below it.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    own = np.ones(len(both), dtype=bool)
    np.not_equal(both[1:], both[:-1], out=own[1:])
    union, common = both[own], ~np.append(own[1:], True)[own]
    weight = _WEIGHTS[union & np.uint32(7)]
    if max(len(a), len(b)) >= sketch and len(union) >= sketch > 1:
        bound = float((union[sketch - 1] & np.uint32(0xFFFFFFF8)).view(np.float32))
        weight, common = weight[: sketch - 1], common[: sketch - 1]
        weight = weight / -np.expm1(-weight * bound)
    return float(weight[common].sum() / weight.sum())


def as_hex(own: np.ndarray) -> str:
    return own.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def in_descending_order(docs: DataFrame) -> DataFrame:
    """pid, key, doc_id, text: ranges of descending doc_id, each with the next range's first row behind it (``behind``).

    Ranges are cut at quantiles of doc_id, a list as long as the number of partitions. Texts move once.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = shuffle_partitions(spark)
    shares = [i / parts for i in range(parts, 0, -1)]
    found = keyed.agg(F.percentile_approx("key", shares, 100 * parts).alias("q"), F.max("key").alias("top")).first()
    tops = sorted({*(found["q"] or []), *([found["top"]] if found["top"] is not None else [])}, reverse=True)
    bounds = F.array(*[F.lit(int(t)) for t in tops[1:]]) if len(tops) > 1 else F.array().cast("array<bigint>")
    pid = F.size(F.filter(bounds, lambda b: b >= F.col("key"))).cast("int")
    last = max(len(tops) - 1, 0)
    is_top = F.col("key").isin([int(t) for t in tops]) if tops else F.lit(False)
    copies = F.when(is_top, F.array(F.struct(F.col("pid"), F.lit(0).alias("behind")), F.struct(F.when(F.col("pid") == 0, last).otherwise(F.col("pid") - 1).alias("pid"), F.lit(1).alias("behind")))).otherwise(F.array(F.struct(F.col("pid"), F.lit(0).alias("behind"))))
    dealt = keyed.withColumn("pid", pid).withColumn("copy", F.explode(copies)).select("copy.pid", "copy.behind", "key", "doc_id", "text")
    return dealt.repartitionById(last + 1, F.col("pid")).sortWithinPartitions("pid", "behind", F.col("key").desc(), "text")


def compare_with_edits(docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """Fingerprint of every text and of its edited form, and their likeness, with that to the next document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, int, int]]:
        for batch in batches:
            names = ("doc_id", "text", "behind", "pid")
            for a in range(0, len(batch), 256):
                yield from zip(*[batch.column(c).slice(a, 256).to_pylist() for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray | None = None  # fingerprint of the first row held

        def emit(held: list[tuple], following: str) -> pa.RecordBatch:
            nonlocal known
            texts = [r[1] for r in held]
            after = [*texts[1:], following]
            changed = [edited(a, b) for a, b in zip(texts, after)]
            fresh = fingerprint_all([*texts[known is not None :], following, *changed], sketch)
            own = ([known] if known is not None else []) + fresh[: len(fresh) - len(changed)]
            new, known = fresh[len(fresh) - len(changed) :], own[-1]
            columns = [pa.array([r[0] for r in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], [as_hex(x) for x in own[:-1]], [as_hex(x) for x in new], [likeness(a, b, sketch) for a, b in zip(own, new)], [likeness(a, b, sketch) for a, b in zip(own, own[1:])]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held: list[tuple] = []
        chars, closed = 0, None
        for row in rows(batches):
            if closed == row[3]:
                continue  # further rows that share the first row's doc_id
            if row[2]:
                yield emit(held, row[1])
                held, chars, known, closed = [], 0, None, row[3]
                continue
            if chars > BATCH_CHARS // 2:
                yield emit(held, row[1])
                held, chars = [], 0
            held.append(row)
            chars += len(row[1])

    ship(docs.sparkSession)
    return in_descending_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text, where the texts lie: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_hex(x) for x in fingerprint_all(texts, sketch)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")
