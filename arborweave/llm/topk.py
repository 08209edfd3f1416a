"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions of a vector are cut into lists; a row's score for a query is the sum of its scores
in the lists. Queries come in blocks of a fixed size, which are broadcast; rows stay where they are.

1. Every task keeps, for each query and list, its k best rows by list score, with their full scores. The
   k-th best full score over all tasks is a safe cutoff: at least k rows reach it.
2. The cutoffs of the block are broadcast. A row can reach a query's cutoff only if one of its m list scores reaches
   cutoff / m (else the sum falls short); such entries are sufficient and are collected in the task.
3. The collected entries' full scores are resolved exactly; those that reach the cutoff and are
   among the task's k best go to the final top-k per query.

Scores are integers: components become floor(scale * x). Products are computed in floating point only while every
partial sum is certain to be an exact integer in it, else in 64-bit integers.

Edge cases: vectors that are null, hold null or non-finite components, or whose length differs from the first
query's of the block take no part; ties go to the smaller id; rows with null id take no part; with fewer than k candidates
all are returned; a row isn't a candidate for queries of its own id, repeats of the id included;
a query id with several different vectors is searched with each of them, and its k best (vec_id, score) pairs are ranked together;
equal pairs count once, be they from repeated rows or from several vectors;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.session import ship

#: Queries of a block at most, and their components at most: 4 million, 64 MB in the forms that are broadcast.
QUERY_BLOCK, BLOCK_COMPONENTS = 8192, 1 << 22
LISTS = 4
ROWS = 1024
SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: rows that take part, components as integers."""
    scaled = F.transform(F.col("embedding"), lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & sound).select("vec_id", F.transform(scaled, lambda x: F.floor(x)).alias("v"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that have ``width`` components."""
    column = batch.column("v")
    sizes = np.diff(column.offsets.to_numpy())
    ids = batch.column("vec_id").to_numpy()
    if (sizes == width).all():
        return ids, column.flatten().to_numpy().reshape(-1, width)
    right = np.flatnonzero(sizes == width)
    rows = column.take(pa.array(right))
    return ids[right], rows.flatten().to_numpy().reshape(-1, width)


class _Block:
    """A block of queries, and exact products with rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: int) -> None:
        self.ids, self.width = ids, vectors.shape[1]
        self.vectors, self.cuts = vectors, np.linspace(0, self.width, min(lists, self.width) + 1).astype(int)
        self.most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.typed = {t: vectors.T.astype(t) for t in (np.float32, np.float64)}

    def kind(self, rows: np.ndarray) -> type:
        bound = self.most * float(np.abs(rows.astype(np.float64)).max(initial=0)) * self.width
        return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        """Scores in each list: rows x queries, whole numbers."""
        kind = self.kind(rows)
        right = self.typed.get(kind, self.vectors.T)
        left = rows.astype(kind, copy=False)
        return [left[:, a:b] @ right[a:b] for a, b in zip(self.cuts, self.cuts[1:])]

    def resolve(self, rows: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Full scores of pairs."""
        return np.einsum("ij,ij->i", rows[row], self.vectors[query], dtype=np.int64)


class _Best:
    """The k best (score, smaller id first) of each query so far; equal (query, id) pairs once."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.more = k, [np.zeros(0, np.int64)] * 3, []

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.more.append((query, ids, score))
        if sum(len(m[0]) for m in self.more) > 1 << 19:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        query, ids, score = (np.concatenate([self.held[i], *[m[i] for m in self.more]]) for i in range(3))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        again = np.zeros(len(query), dtype=bool)
        again[1:] = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1]) & (score[1:] == score[:-1])
        query, ids, score = query[~again], ids[~again], score[~again]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.held, self.more = [x[rank < self.k] for x in (query, ids, score)], []
        return self.held

    def batch(self, block: _Block) -> pa.RecordBatch:
        query, ids, score = self.settle()
        return pa.RecordBatch.from_arrays([pa.array(block.ids[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def _phase_one(block: _Block, k: int, ids: np.ndarray, rows: np.ndarray, best: _Best) -> None:
    """Adds each list's k best rows of the batch, with full scores, own ids left out."""
    own = ids[:, None] == block.ids[None, :]
    for part in block.parts(rows):
        part = part.astype(np.float64)
        part[own] = -np.inf
        top = min(k, len(rows))
        row = np.argpartition(-part, top - 1, axis=0)[:top].ravel()
        query = np.tile(np.arange(len(block.ids)), top)
        other = ids[row] != block.ids[query]
        row, query = row[other], query[other]
        best.add(query, ids[row], block.resolve(rows, row, query))


def _phases_two_and_three(block: _Block, cutoff: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: _Best) -> None:
    parts = block.parts(rows)
    share = cutoff / len(parts)
    enough = parts[0] >= share
    for part in parts[1:]:
        enough |= part >= share
    row, query = np.nonzero(enough)
    for a in range(0, len(row), 1 << 18):
        r, q = row[a : a + (1 << 18)], query[a : a + (1 << 18)]
        score = block.resolve(rows, r, q)
        kept = (score >= cutoff[q]) & (ids[r] != block.ids[q])
        best.add(q[kept], ids[r[kept]], score[kept])


def search_block(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, lists: int) -> DataFrame:
    """query_id, rank, vec_id, score of one block of queries against all ``rows`` (vec_id, v)."""
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(_Block(ids, vectors, lists))
    step = max(1, min(ROWS, (1 << 22) // max(1, len(ids))))

    def over(batches: Iterator[pa.RecordBatch], phase) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            own_ids, own = _matrix(batch, block.value.width)
            for a in range(0, len(own_ids), step):
                phase(own_ids[a : a + step], own[a : a + step], best)
        yield best.batch(block.value)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return over(batches, lambda i, r, best: _phase_one(block.value, k, i, r, best))

    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    gathered = rows.mapInArrow(gather, SCHEMA).distinct()
    cutoffs = gathered.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("query_id", "score").collect()  # one row per query of the block
    low = np.full(len(ids), -np.inf)  # fewer than k candidates: everything is sufficient
    for r in cutoffs:
        low[ids == r["query_id"]] = r["score"]  # of all vectors of the id: their pairs are ranked together
    cutoff = spark.sparkContext.broadcast(low)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return over(batches, lambda i, r, best: _phases_two_and_three(block.value, cutoff.value, i, r, best))

    found = rows.mapInArrow(resolve, SCHEMA).distinct()
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best other rows of every row that ``is_query`` (a condition on vec_id) marks, by integer inner product."""
    spark = vectors.sparkSession
    ship(spark)
    rows = integer_vectors(vectors, scale)
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"])
    done: DataFrame | None = None
    ids: list[int] = []
    block: list[list[int]] = []
    components = 0

    def search() -> None:
        nonlocal done, ids, block
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(block):
            by_width.setdefault(len(v), []).append(i)
        for chosen in by_width.values():
            part = search_block(rows, np.array([ids[i] for i in chosen]), np.array([block[i] for i in chosen], dtype=np.int64), k, lists)
            done = part if done is None else done.unionByName(part)
        ids, block = [], []

    for row in queries.toLocalIterator():  # one block in the driver at a time
        ids.append(row["vec_id"])
        block.append(row["v"])
        components += len(row["v"])
        if len(ids) == query_block or components >= BLOCK_COMPONENTS:
            search()
            components = 0
    if ids:
        search()
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The vectors of one id may be in several blocks; a block has k rows for an id at most.
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return done.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(ranked).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
