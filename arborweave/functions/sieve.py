"""Sieves: bit maps of fixed size that tell which rows may have one of many keys, before those rows are shuffled.

A key that was put in is always found; others are found with a probability that rises with the number of keys. So a sieve only
saves work: rows that it lets through still go to an exact join, and with ever more keys it lets through ever more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sieve, each a map of 32,768 bits: 4 MB at most.
ROWS, BITS = 1024, 1 << 15


def _row(key: Column) -> Column:
    return key.bitwiseAND(F.lit(ROWS - 1))


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, ROWS.bit_length() - 1).bitwiseAND(F.lit(BITS - 1))


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """sieve_row, sieve_bits; ``key`` is a 64-bit hash."""
    return keys.select(_row(key).alias("sieve_row"), _bit(key).alias("bit")).groupBy("sieve_row").agg(F.bitmap_construct_agg("bit").alias("sieve_bits"))


def sifted(rows: DataFrame, key: Column, found: DataFrame, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: whether the sieve ``found`` may hold the key. Rows stay where they are."""
    joined = rows.withColumn("sieve_key", key).join(F.broadcast(found), _row(F.col("sieve_key")) == F.col("sieve_row"), "left")
    byte = F.conv(F.hex(F.substring("sieve_bits", F.floor(_bit(F.col("sieve_key")) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (_bit(F.col("sieve_key")) % 8).cast("int") + 1)) != 0
    return joined.withColumn(out, F.coalesce(held, F.lit(False))).drop("sieve_key", "sieve_row", "sieve_bits")
