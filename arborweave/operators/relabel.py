"""Vertex relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions.ranking import global_position

#: Weights of frequency, following and preceding in the code-length score (fixed values).
FREQUENCY_WEIGHT, PARENT_WEIGHT, CHILD_WEIGHT = 1.00, 0.75, 0.50


def degrees(adj: DataFrame) -> DataFrame:
    """id, degree of every vertex that has a row."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def by_degree(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """old_id, new_id: degree from high to low, then old id; isolated vertices last."""
    known = vertices.join(degrees(adj).withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    return global_position(known, [F.col("degree").desc(), F.col("id").asc()], "new_id").select(F.col("id").alias("old_id"), "new_id")


def scores(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, frequency, followed, preceded, score: in how many rows a vertex stands, has a successor, has a predecessor.

    Rows are by frequency from high to low, then id. First and last places of rows are counted instead of windows over
    every row: a vertex is preceded in all its rows but those that it begins.
    """
    counted = adj.groupBy(F.col("dst").alias("__id")).agg(F.count("*").alias("__n"))
    place = F.struct(-F.col("__n"), "dst")
    ends = adj.join(counted, F.col("dst") == F.col("__id")).groupBy("src").agg(F.min_by("dst", place).alias("first"), F.max_by("dst", place).alias("last"))
    begins = ends.groupBy(F.col("first").alias("id")).agg(F.count("*").alias("begins"))
    finishes = ends.groupBy(F.col("last").alias("id")).agg(F.count("*").alias("finishes"))
    frequency = adj.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("frequency"))
    zero = F.lit(0).cast("long")
    joined = vertices.join(frequency, "id", "left").join(begins, "id", "left").join(finishes, "id", "left")
    counted = joined.select("id", *[F.coalesce(c, zero).alias(c) for c in ("frequency", "begins", "finishes")])
    named = counted.select("id", "frequency", (F.col("frequency") - F.col("finishes")).alias("followed"), (F.col("frequency") - F.col("begins")).alias("preceded"))
    score = F.lit(FREQUENCY_WEIGHT) * F.col("frequency") + F.lit(PARENT_WEIGHT) * F.col("followed") + F.lit(CHILD_WEIGHT) * F.col("preceded")
    return named.withColumn("score", score)


def by_score(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """old_id, new_id: score from high to low, then frequency, then old id."""
    order = [F.col("score").desc(), F.col("frequency").desc(), F.col("id").asc()]
    return global_position(scores(adj, vertices), order, "new_id").select(F.col("id").alias("old_id"), "new_id")


def remap(adj: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """``adj`` with the ids of ``columns`` replaced by new ids."""
    out = adj
    for c in columns:
        out = out.join(mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("__new")), c).drop(c).withColumnRenamed("__new", c)
    return out.select("src", "dst")


def unmap(adj: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    return remap(adj, mapping.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")), columns)


def ordered_rows(adj: DataFrame) -> DataFrame:
    """src, pos (from 0), dst, freq: every row by frequency from high to low, then id."""
    frequency = adj.groupBy(F.col("dst").alias("__id")).agg(F.count("*").alias("freq"))
    joined = adj.join(frequency, F.col("dst") == F.col("__id")).drop("__id")
    order = Window.partitionBy("src").orderBy(F.col("freq").desc(), "dst")
    return joined.select("src", (F.row_number().over(order) - 1).alias("pos"), "dst", "freq")
