"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of one to four characters
are hashed into a fixed number of buckets. The matrix of log probabilities (buckets x languages) is broadcast; a
batch of texts is scored in numpy by gathering the rows of the n-grams that occur and adding them up per text.

The fit sees at most about ``SAMPLE`` training rows of each language (by hash of doc_id, a documented bound) in whole; counts are summed by
tree in the executors. Every text is scored in whole.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with no training rows every text is ``und``; a tie goes to
the language first in code-point order; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.session import ship

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SAMPLE = 4_000
#: Languages that the broadcast matrix may have (64 MB); more are an error, none is dropped.
MAX_LANGUAGES = 512
BATCH_CHARS = 200_000
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_GAP = "\0" * (max(ORDERS) - 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the held-out fold: crc32 of its id as text leaves 1 when divided by 3; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def letters(text: str | None) -> str:
    """Lower-cased words between single spaces, one before and behind; empty without a letter."""
    kept = _OTHER.sub(" ", text or "").strip().lower()
    return f" {kept} " if any(map(str.isalpha, kept)) else ""


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of letters() texts, and the index of its text."""
    joined = _GAP.join(texts) + _GAP
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t) + len(_GAP) for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = code != 0
    buckets, owners = [], []
    hashed, valid = np.zeros(len(code), dtype=np.uint32), np.ones(len(code), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        end = len(code) - n + 1
        if end <= 0:
            break
        hashed, valid = hashed[:end] * np.uint32(0x01000193) + code[n - 1 :] * np.uint32(0x9E3779B1), valid[:end] & inside[n - 1 :]
        if n in ORDERS:
            mixed = hashed ^ (hashed >> np.uint32(15))
            mixed = (mixed * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            buckets.append(mixed[valid])
            owners.append(owner[:end][valid])
    return np.concatenate(buckets), np.concatenate(owners)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about BATCH_CHARS; a longer text goes in pieces that overlap by one n-gram less a character."""
    index, part, chars = [], [], 0
    over = max(ORDERS) - 1
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - over), BATCH_CHARS):
            piece = text[a : a + BATCH_CHARS + over]
            index.append(i)
            part.append(piece)
            chars += len(piece)
            if chars >= BATCH_CHARS:
                yield index, part
                index, part, chars = [], [], 0
    if part:
        yield index, part


def log_likelihoods(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its n-grams' log probabilities for every language, and the number of n-grams."""
    total, count = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts))
    for index, part in _pieces(texts):
        bucket, owner = grams(part)
        key, times = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)  # the batch as a sparse matrix
        row = (key // BUCKETS).astype(np.int64)
        values = matrix[key % BUCKETS] * times[:, None]
        edges = np.flatnonzero(np.diff(row, prepend=-1))
        if len(row):
            at = np.array(index)[row[edges]]
            np.add.at(total, at, np.add.reduceat(values, edges, axis=0))
            np.add.at(count, at, np.add.reduceat(times, edges))
    return total, count


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray) -> None:
        """``counts``: languages x buckets of the training rows; ``rows``: rows of each language among all training rows."""
        self.languages = languages
        smooth = counts.T + 0.5
        self.matrix = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.prior = np.log((rows + 1.0) / (rows.sum() + len(rows)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        kept = [letters(t) for t in texts]
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(kept) if t]
        if not known or not self.languages:
            return out, score
        total, count = log_likelihoods([kept[i] for i in known], self.matrix)
        # Overlapping n-grams are far from independent: the evidence of all orders counts as that of one.
        total = total / len(ORDERS) + self.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s in zip(known, best, share):
            out[i], score[i] = self.languages[b], s
        return out, score


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(rows)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix is planned for {MAX_LANGUAGES} at most")
    if not languages:
        return Model([], np.zeros((1, BUCKETS)), np.zeros(1))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    limit = F.element_at(F.create_map(*[x for k, n in rows.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))]), F.col("lang"))
    number = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.array([number[k] for k in batch.column("lang").to_pylist()], dtype=np.int64)
            kept = [letters(t) for t in batch.column("text").to_pylist()]
            for index, part in _pieces(kept):
                bucket, owner = grams(part)
                lang = own[np.array(index)][owner]
                for k in np.unique(lang):
                    counts.setdefault(int(k), np.zeros(BUCKETS, dtype=np.int64))
                    counts[int(k)] += np.bincount(bucket[lang == k], minlength=BUCKETS)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang_no", "bucket", "n"])

    partial = known.filter(place < limit).select("lang", "text").mapInArrow(run, "lang_no int, bucket int, n long")
    sums = partial.groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["lang_no"], sums["bucket"]] = sums["n"]
    return Model(languages, counts, np.array([rows[k] for k in languages], dtype=float))


def predicted_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
