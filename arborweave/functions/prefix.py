"""Ranks and running totals that don't put one key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.session import cut

BUCKETS = 1024


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one within ``keys``, as long.

    ``bucket`` must not decrease along the order: rows are ordered by (bucket, order). The window
    sees one bucket of a key at a time, so a key with a third of all rows is spread over its
    buckets; only one row per key and bucket takes part in the second window. Rows are written to
    the shared checkpoint folder once, because both the totals and the result read them.
    Null keys form a group of their own.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut(df.withColumn("__value", value.cast("long")).withColumn("__local", F.coalesce(F.sum("__value").over(inside), F.lit(0).cast("long"))))
    sums = local.groupBy(*keys, bucket).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(bucket).alias("__k_bucket"), F.coalesce(F.sum("__sum").over(before), F.lit(0).cast("long")).alias("__before"))
    on = F.col(bucket).eqNullSafe(F.col("__k_bucket"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = local.join(offsets, on, "inner").withColumn(out, F.col("__before") + F.col("__local"))
    return joined.drop("__value", "__local", "__before", "__k_bucket", *[f"__k_{k}" for k in keys])


def hash_bucket(*columns: str, buckets: int = BUCKETS) -> Column:
    """Bucket number 0..buckets-1 that rises with the 64-bit hash of ``columns``, so that (bucket, hash) is one order."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - (buckets.bit_length() - 1)).cast("int")
