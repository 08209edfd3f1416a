"""Best-fit packing planned on a length histogram.

1. Every text is tokenized once; a document's ids and the end id are cut into pieces of at most
   ``capacity``. One narrow row per piece goes to a checkpoint.
2. The histogram of piece lengths (at most ``capacity`` rows) comes to the driver. Best fit decreasing
   runs over counts: all pieces of one length are placed as ranges of ranks into ranges of equal sequences.
3. Every piece takes the planned slot of its rank within its length. Ranks are a count within the task
   that tokenized it plus the counts of the tasks before, so a length with a third of all
   pieces never meets in one task.

Edge cases: null text is empty and packs as the single end id; equal rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.session import cut, ship

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps in each of two generations, the longest word kept, and texts looked up at once.
CACHE_WORDS, CACHE_CHARS, TEXTS = 400_000, 64, 256
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, local long"


#: Lower-case letters of Latin-1: such a word passes normalizer and pre-tokenizer unchanged but for its bytes' stand-ins.
#: ASCII punctuation behind it is a token of its own.
_LETTERS = re.compile("([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+)([!-/:-@[-`{-~]*)")


def _stand_ins() -> dict[int, str]:
    """Byte-level vocabularies write bytes that aren't printable Latin-1 as characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, by way of their words.

    Right only for vocabularies that lower their input, and whose pre-tokenizer removes white space and whose normalizer
    doesn't look across it: then a text's ids are its words' ids in a row, and each word is encoded once. Texts
    in Latin-1, where lowering goes character by character and nothing composes, are lowered first.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.stand_ins = self.tokenizer.model, _stand_ins()
        self.cache_words = cache_words
        self.young: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if "<|" not in text:  # a special token's name has to be met as it stands
                text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encoded(self, words: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Ids of new words. Letters go to the vocabulary's merges alone, punctuation behind them is looked up."""
        young, old, merge, other = self.young, self.old, self.model.tokenize, []
        for word in words:
            if not (found := _LETTERS.fullmatch(word)):
                other.append(word)
                continue
            stem, tail = found.groups()
            ids = young.get(stem) or old.get(stem)
            if ids is None:
                plain = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.stand_ins)
                ids = array.array("I", [t.id for t in merge(plain)]).tobytes()
            if tail:
                if len(stem) <= CACHE_CHARS:
                    young[stem] = ids
                if tail not in self.tails:
                    if len(self.tails) > self.cache_words:
                        self.tails.clear()
                    self.tails[tail] = self.encoded([tail])[0]
                ids += self.tails[tail]
            young[word] = ids
        young.update(zip(other, self.encoded(other)))

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.young) > self.cache_words:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = set().union(*split).difference(young)
        new = missing.difference(old)
        young.update((w, old[w]) for w in missing if w not in new)
        if new:
            self.learn(list(new))
        out = [b"".join(map(young.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del young[w]
        return out


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    _loaded[path].cache_words = cache_words
    return _loaded[path]


def pieces_of(ids: bytes, capacity: int = CAPACITY, end_id: int = END_ID) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of a document, the end id appended."""
    ids += int(end_id).to_bytes(4, "little")
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece, with the task that made it and the piece's rank within its length in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = _tokenizer(path, cache_words), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            owner, rows = [], []
            for a in range(0, len(batch), TEXTS):
                texts = batch.column("text").slice(a, TEXTS).to_pylist()
                for i, ids in enumerate(tokenizer.ids([t or "" for t in texts]), a):
                    for row in pieces_of(ids, capacity, end_id):
                        owner.append(i)
                        rows.append(row)
            if not rows:
                continue
            piece, start, length, crc = np.array(rows, dtype=np.int64).T
            local = np.empty(len(rows), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            local[order] = seen[ordered] + np.arange(len(rows)) - np.searchsorted(ordered, ordered)
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(owner)), piece.astype(np.int32), start, length.astype(np.int32), crc, np.full(len(rows), task, np.int32), local]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Best fit decreasing over counts: length -> rows (first rank, ranks, first sequence, pieces per sequence, offset).

    A sequence is filled from 0 without gaps, so all sequences with the same room left are alike and
    are kept as ranges of numbers. The longest lengths go first; pieces of a length go where the least room is
    left that still holds one, as many into each as fit, and open new sequences when no room is left.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    slots: dict[int, np.ndarray] = {}
    opened = 0

    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        rank, left, out = 0, histogram[length], []

        def fill(first: int, count: int, space: int) -> None:
            """Put pieces into ``count`` sequences with ``space`` left, from number ``first``."""
            nonlocal rank, left
            each = space // length
            full = min(count, left // each)
            if full:
                out.append((rank, full * each, first, each, capacity - space))
                rank, left = rank + full * each, left - full * each
                room.setdefault(space - full_length(each), []).append((first, full))
            if full < count and left:
                out.append((rank, left, first + full, left, capacity - space))
                room.setdefault(space - full_length(left), []).append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                room.setdefault(space, []).append((first + full, count - full))

        def full_length(pieces: int) -> int:
            return pieces * length

        for space in sorted(s for s in room if s >= length):
            if not left:
                break
            ranges = room.pop(space)
            while ranges and left:
                fill(*ranges.pop(), space)
            if ranges:
                room.setdefault(space, []).extend(ranges)
        if left:
            need = -(-left // (capacity // length))
            fill(opened, need, capacity)
            opened += need
        room.pop(0, None)
        slots[length] = np.array(out, dtype=np.int64)
    return slots


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The broadcast plan holds a few ranges for each of ``capacity`` lengths, whatever the number of pieces. Fewer ``cache_words`` take
    less memory of a worker and more time.
    """
    spark = docs.sparkSession
    pieces = cut(tokenized_pieces(docs, path, capacity, end_id, cache_words))
    counts = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_slots(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("o_length"), F.col("task").alias("o_task"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    ranked = pieces.join(offsets, (F.col("length") == F.col("o_length")) & (F.col("task") == F.col("o_task"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(own):
                    continue
                ranges = slots[int(length[own[0]])]
                row = ranges[np.searchsorted(ranges[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + inside // row[:, 3]
                offset[own] = row[:, 4] + inside % row[:, 3] * length[own]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
