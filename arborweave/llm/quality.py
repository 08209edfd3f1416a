"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

Chunks of a text are compressed with either dictionary; text compresses better with the dictionary of
its own kind. The normalised difference of compressed sizes, over the whole text and in its worst part,
goes through a logistic curve that is calibrated on labelled rows that built no dictionary.

The fit sees at most ``SAMPLE`` labelled training rows (by hash of doc_id, a documented bound): about ``DICTIONARY_ROWS`` of either kind build
its dictionary, each with an excerpt of equal length, and all others calibrate. Every text is scored in whole.

Edge cases: null and empty texts get the share of good rows among the fit's rows; without labelled rows of both kinds
every score is the share of good rows (0.5 if there are none); repeated rows get equal scores; conflicting labels of one doc_id
all count; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.session import cut, ship

SAMPLE = 8_000
#: Bytes of training text in a dictionary, and of a chunk that is compressed on its own.
DICTIONARY, CHUNK = 112 << 10, 1_024
#: Rows of either kind that build its dictionary, about (half of the sampled rows at most), and bytes that one row may give to it.
DICTIONARY_ROWS, ROW_BYTES = 200, 1_200
LEVEL = 3
CUTOFF = 0.3
FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is in the held-out fold: crc32 of its id as text, divisible by ``folds``; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def chunks(text: str | None) -> list[bytes]:
    """The whole text's UTF-8 in chunks of even size, about CHUNK each."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, round(len(raw) / CHUNK))
    return [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)] if raw else []


def excerpt(text: str | None) -> bytes:
    """What one row may give to a dictionary: ROW_BYTES from a place that its hash names."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) > ROW_BYTES:
        at = int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little") % (len(raw) - ROW_BYTES + 1)
        raw = raw[at : at + ROW_BYTES]
    return raw


def dictionary(excerpts: list[bytes]) -> bytes:
    """Raw dictionary content: the beginnings of all excerpts at equal length."""
    share = DICTIONARY // max(1, len(excerpts))
    return b"\n".join(raw[:share] for raw in excerpts)


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    base: float = 0.5
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)


class Compressors:
    def __init__(self, good: bytes, bad: bytes) -> None:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = one(good).compress, one(bad).compress
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress

    def features(self, text: str | None) -> list[float] | None:
        """Size difference over the whole, of the part most and least like bad text, and the share saved by repetition."""
        parts = chunks(text)
        if not parts:
            return None
        good, bad = [len(self.good(p)) for p in parts], [len(self.bad(p)) for p in parts]
        ratios = [(g - b) / (g + b) for g, b in zip(good, bad)]
        raw = sum(map(len, parts))
        repeated = len(self.plain(b"".join(parts))) / (raw + 40)
        return [(sum(good) - sum(bad)) / (sum(good) + sum(bad)), max(ratios), min(ratios), math.log(min(g + b for g, b in zip(good, bad)) / (2 * raw / len(parts) + 20)), math.log(repeated)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton steps, each halved until the loss falls."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.diag([*np.ones(x.shape[1] - 1), 1e-3])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + v @ penalty @ v / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if new > now:
            break
        w, before, now = w + size * step, now, new
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their squares: either end of a size ratio can be odd."""
    return np.column_stack((x, x * x))


def calibrated(good: bytes, bad: bytes, features: list[list[float]], labels: list[int]) -> Model:
    """A model from dictionaries and the features of labelled rows that gave nothing to them."""
    base = sum(labels) / len(labels) if labels else 0.5
    if not good or not bad or len(set(labels)) < 2:
        return Model(base=base)
    x, y = np.array(features), np.array(labels, dtype=float)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic(expand(np.clip((x - centre) / spread, -8, 8)), y)
    return Model(good, bad, base, weights.tolist(), centre.tolist(), spread.tolist())


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), model.base)
    if not model.weights:
        return out
    tools = Compressors(model.good, model.bad)
    found = [tools.features(t) for t in texts]
    at = [i for i, f in enumerate(found) if f is not None]
    if at:
        x = expand(np.clip((np.array([found[i] for i in at]) - model.centre) / model.spread, -8, 8))
        w = np.array(model.weights)
        out[at] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return out


def _mapped(rows: DataFrame, made, schema: str) -> DataFrame:
    """place, quality and what ``made`` gives for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = made()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("quality"), make(batch.column("text").to_pylist())], ["place", "quality", "made"])

    return rows.mapInArrow(run, schema)


def _building(counts: dict[int, int], share: dict[int, float], kind: int) -> float:
    """Share of a kind's sampled rows that builds its dictionary."""
    return min(0.5, DICTIONARY_ROWS / max(1.0, counts.get(kind, 0) * share.get(kind, 1.0)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Fit on at most about ``sample`` labelled rows outside the held-out fold.

    The sampled rows are cut off once with their whole texts. Only excerpts for the dictionaries and five numbers a row
    come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality")).filter("__id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("__id"), folds))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if not counts:
        return Model()
    # Half of the sample for each kind, as far as there are rows.
    share = {k: min(1.0, sample / 2 / n) for k, n in counts.items()}
    limit = F.when(F.col("quality") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    drawn = F.shiftrightunsigned(F.xxhash64("__id"), 11) / F.lit(float(1 << 53))
    chosen = F.broadcast(marked.filter(drawn < limit))  # at most about ``sample`` narrow rows
    place = F.xxhash64("doc_id", "text", "quality")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("__id")).select(place.alias("place"), "quality", "text"))
    # Of each kind about DICTIONARY_ROWS rows build its dictionary, all others calibrate.
    builds = F.when(F.col("quality") == 1, F.lit(_building(counts, share, 1))).otherwise(F.lit(_building(counts, share, 0)))
    odd = F.shiftrightunsigned("place", 11) / F.lit(float(1 << 53)) < builds

    def excerpts():
        return lambda texts: pa.array([excerpt(t) for t in texts], pa.binary())

    parts = sorted(_mapped(rows.filter(odd), excerpts, "place long, quality int, made binary").collect(), key=lambda r: (r["place"], bytes(r["made"])))
    good, bad = (dictionary([bytes(r["made"]) for r in parts if r["quality"] == k]) for k in (1, 0))
    base = counts.get(1, 0) / sum(counts.values())
    if not good or not bad:
        return Model(base=base)

    def features():
        tools = Compressors(good, bad)
        return lambda texts: pa.array([tools.features(t) for t in texts], pa.list_(pa.float64()))

    found = sorted(_mapped(rows.filter(~odd), features, "place long, quality int, made array<double>").filter("made IS NOT NULL").collect(), key=lambda r: (r["place"], r["made"]))
    model = calibrated(good, bad, [list(r["made"]) for r in found], [r["quality"] for r in found])
    if model.weights:  # back from the sample's share of good rows to that of all labels
        seen = sum(r["quality"] for r in found) / len(found)
        model.weights[-1] += math.log(base / (1 - base)) - math.log(seen / (1 - seen))
    model.base = base
    return model


def quality_scores(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                found = scores(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= cutoff).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more, all columns; decided where the rows lie, without a join."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                yield part.filter(pa.array(scores(shared.value, part.column("text").to_pylist()) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
