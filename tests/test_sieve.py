"""Sieves let every key through that was put in, and few others."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborweave.functions.sieve import sieve, sifted


def test_keys_are_found(spark):
    rows = spark.range(-3_000, 30_000)
    found = sieve(rows.filter("id % 50 = 0"), F.xxhash64("id"))
    held = sifted(rows, F.xxhash64("id"), found, "held")
    assert held.columns == ["id", "held"] and held.count() == rows.count()
    assert held.filter("id % 50 = 0 AND NOT held").isEmpty()
    assert held.filter("id % 50 <> 0 AND held").count() < 20


def test_no_keys(spark):
    rows = spark.range(10)
    assert sifted(rows, F.xxhash64("id"), sieve(rows.limit(0), F.xxhash64("id")), "held").filter("held").isEmpty()
