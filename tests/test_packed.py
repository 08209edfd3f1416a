"""Rows of bytes against the same graphs as tables of edges."""

from __future__ import annotations

import numpy as np
import pytest

from arborweave.operators import analytics, codecs, forest, packed, relabel, triangles
from tests.test_analytics import graph


def rows_of(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


@pytest.mark.parametrize(("seed", "n", "m", "most"), [(1, 60, 40, codecs.ANY_STEPS), (2, 80, 400, 127), (3, 90, 3000, codecs.ANY_STEPS), (4, 90, 3000, 3)])
def test_packed_rows_are_those_of_tables(spark, seed, n, m, most):
    pairs = graph(seed, n, m)
    adj = spark.createDataFrame(pairs, "src long, dst long").cache()
    once = [(a, b) for a, b in pairs if a < b]
    edges = spark.createDataFrame(once + [(b, a) for a, b in once[::3]] + [(5, 5), (None, 1)], "src long, dst long")
    lists = packed.lists(edges.unionByName(edges)).cache()
    assert rows_of(packed.expanded(lists)) == pairs
    rows = relabel.ordered_rows(adj).cache()
    place = packed.places(lists, n)
    parents = packed.first_fit(lists, place).cache()
    assert rows_of(parents) == rows_of(forest.first_fit(rows))
    commands = codecs.tree_commands(rows, parents, most=most).cache()
    encoded = packed.encoded_rows(lists, parents, place, most).cache()
    assert rows_of(encoded) == rows_of(codecs.encoded_rows(commands))
    want = analytics.triangle_count(adj).first()[0]
    assert triangles.triangle_count_of_rows(encoded, parents, n).first()[0] == analytics.triangle_count_encoded(commands, parents, n).first()[0] == want


def test_long_lists_travel_in_parts():
    draw = np.random.default_rng(5)
    src, dst = np.sort(draw.integers(-3, 3, 5000)), draw.integers(0, 1 << 40, 5000)
    src, dst = packed._distinct(np.concatenate((src, src)), np.concatenate((dst, dst)))
    assert list(zip(src, dst)) == sorted(set(zip(src, dst)))
    for part in (None, 1, 7, 5000):
        batch = packed._packed(src, dst, part)
        assert part is None or max(batch.column("n").to_pylist()) <= part
        for most in (1, 100, 1 << 20):
            s, d = (np.concatenate(x) for x in zip(*packed.entries([batch.slice(0, 2), batch.slice(2)], most)))
            assert (s == src).all() and (d == dst).all()


def test_distinct_pairs_of_a_wide_range():
    """Keys that one 64-bit number can't hold."""
    src, dst = np.array([1 << 40, -5, 1 << 40, -5]), np.array([1 << 40, 3, 1 << 40, 2])
    assert [x.tolist() for x in packed._distinct(src, dst)] == [[-5, -5, 1 << 40], [2, 3, 1 << 40]]


def test_negative_ids_are_an_error(spark):
    with pytest.raises(Exception, match="must not be negative"):
        packed.lists(spark.createDataFrame([(1, -2)], "src long, dst long")).collect()
