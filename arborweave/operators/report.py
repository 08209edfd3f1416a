"""Comparison tables of codecs: merging external results, ratios, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTERNAL = "SOTA"


def algorithm_rank(algorithm: Column, order: list[str]) -> Column:
    """Place in ``order`` from 0; unlisted ones come last."""
    place = F.array_position(F.array(*[F.lit(a) for a in order]), algorithm)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(order))).cast("int")


def merge_results(own: DataFrame, external: DataFrame, order: list[str]) -> DataFrame:
    """Own rows without external ones, then the external rows; of equal (Dataset, Algorithm) the one with the largest BPE stays."""
    both = own.filter(~F.upper("Algorithm").contains(EXTERNAL)).unionByName(external, allowMissingColumns=True)
    best = Window.partitionBy("Dataset", "Algorithm").orderBy(F.col("BPE").desc_nulls_last(), F.col("Data_MB").desc_nulls_last(), F.col("Correct").desc_nulls_last())
    kept = both.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
    return kept.withColumn("algo_rank", algorithm_rank(F.col("Algorithm"), order))


def insert_external(own: DataFrame, external: DataFrame, raw: str, fallback: str) -> DataFrame:
    """Own rows and one external row per dataset that has a raw row (or else a ``fallback`` row); blank if it isn't known.

    ``place`` orders rows within a dataset: the external row follows its raw row.
    """
    anchors = own.filter(F.col("Algorithm").isin(raw, fallback)).groupBy("Dataset").agg(F.max((F.col("Algorithm") == raw).cast("int")).alias("has_raw"))
    known = external.filter(F.upper("Algorithm").contains(EXTERNAL)).select(F.col("Dataset").alias("__d"), *[F.col(c).alias(f"__{c}") for c in ("Data_MB", "BPE", "Correct")])
    rows = anchors.join(known, F.col("Dataset") == F.col("__d"), "left").select("Dataset", F.lit(EXTERNAL).alias("Algorithm"), F.col("__Data_MB").alias("Data_MB"), F.col("__BPE").alias("BPE"), F.col("__Correct").alias("Correct"), F.when(F.col("has_raw") == 1, 0.5).otherwise(1.5).alias("place"))
    place = F.when(F.col("Algorithm") == raw, 0.0).when(F.col("Algorithm") == fallback, 1.0).otherwise(2.0)
    return own.select("Dataset", "Algorithm", "Data_MB", "BPE", "Correct", place.alias("place")).unionByName(rows)


def with_ratio(rows: DataFrame, baseline: str) -> DataFrame:
    """Adds ratio_pct against the dataset's baseline: by BPE, else by size, else against 32 bits; null where it would be infinite."""
    dataset = Window.partitionBy("Dataset")
    is_base = F.col("Algorithm") == baseline
    base_bpe, base_mb = (F.max(F.when(is_base, F.col(c))).over(dataset) for c in ("BPE", "Data_MB"))
    by_bpe, by_mb = F.col("BPE") / F.nullif(base_bpe, F.lit(0.0)) * 100, F.col("Data_MB") / F.nullif(base_mb, F.lit(0.0)) * 100
    return rows.withColumn("ratio_pct", F.coalesce(by_bpe, by_mb, F.col("BPE") / 32.0 * 100))


def wide_table(rows: DataFrame, algorithms: list[str]) -> DataFrame:
    """One row per dataset, one BPE column per algorithm; repeated (Dataset, Algorithm) rows are an error."""
    repeated = rows.groupBy("Dataset", "Algorithm").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("a dataset has two rows of one algorithm; merge them first")
    return rows.groupBy("Dataset").pivot("Algorithm", algorithms).agg(F.first("BPE"))


def ratio_curves(rows: DataFrame, baseline: str) -> DataFrame:
    """Data of the ratio chart: Dataset, Algorithm, ratio_pct of all algorithms, datasets aligned with the baseline's."""
    base = rows.filter(F.col("Algorithm") == baseline).select("Dataset", F.col("BPE").alias("__base"))
    ratio = F.col("BPE") / F.nullif(F.col("__base"), F.lit(0.0)) * 100
    return base.join(rows, "Dataset", "left").select("Dataset", "Algorithm", ratio.alias("ratio_pct"))
