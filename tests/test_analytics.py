from __future__ import annotations

import random
from collections import deque

import pytest

from arborweave.operators import analytics, codecs, components, forest, relabel, report, triangles
from arborweave.sources.edges import vertices


def graph(seed, n, m):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    return sorted({(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b})


def plain_labels(adj, ids):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in adj:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_levels(adj, start):
    near = {}
    for a, b in adj:
        near.setdefault(a, []).append(b)
    level, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in near.get(u, []):
            if v not in level:
                level[v] = level[u] + 1
                queue.append(v)
    return level


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 60, 40), (2, 80, 400)])
def test_plain_and_encoded(spark, seed, n, m):
    pairs = graph(seed, n, m)
    adj = spark.createDataFrame(pairs, "src long, dst long").cache()
    rows = relabel.ordered_rows(adj)
    parents = forest.first_fit(rows).cache()
    commands = codecs.tree_commands(rows, parents).cache()
    ids = vertices(adj)
    want = plain_labels(pairs, [r["id"] for r in ids.collect()])
    for got in (analytics.component_table(adj, ids), analytics.component_table_encoded(commands, parents, ids)):
        assert {r["id"]: r["component"] for r in got.collect()} == want
    sizes = {r["component"]: r["size"] for r in analytics.ranked_sizes(analytics.component_table(adj, ids)).collect()}
    assert sum(sizes.values()) == len(want)
    found = {tuple(sorted(t)) for t in map(tuple, analytics.triangles(adj).collect())}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    assert found == {(a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c}
    assert analytics.triangle_count(adj).first()[0] == analytics.triangle_count_encoded(commands, parents, n).first()[0] == len(found)
    start = analytics.start_vertex(adj)
    degree = {a: len(x) for a, x in near.items()}
    assert start == min(degree, key=lambda a: (-degree[a], a))
    want = plain_levels(pairs, start)
    for got in (analytics.bfs_levels(adj, start), analytics.bfs_levels_encoded(commands, parents, start, n)):
        assert {r["id"]: r["level"] for r in got.collect()} == want


def test_long_path_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert components.component_labels(edges).select("component").distinct().collect()[0][0] == 0
    assert components.component_labels(edges.filter("src < 0")).isEmpty()


def test_large_ids(spark):
    """Ids near the ends of the 64-bit range, as fingerprints have."""
    top = (1 << 63) - 1
    edges = spark.createDataFrame([(top, -top), (top, top - 1), (5, 6)], "src long, dst long")
    got = {r["id"]: r["component"] for r in components.component_labels(edges).collect()}
    assert got == {top: -top, -top: -top, top - 1: -top, 5: 5, 6: 5}


def test_many_large_labels(spark):
    """Sums over labels don't overflow."""
    top = (1 << 63) - 1
    edges = spark.createDataFrame([(top - 2 * i, top - 2 * i - 1) for i in range(40)], "src long, dst long")
    assert components.component_labels(edges).count() == 80


def test_gate():
    assert analytics.use_commands(0.2, 0.9, 1000)
    assert not analytics.use_commands(0.46, 0.1, 1000)
    assert not analytics.use_commands(0.1, 0.7, 5_000_000)
    assert not analytics.use_commands(0.12, 0.1, 5_000_000)
    assert analytics.use_commands(0.1, 0.1, 5_000_000)


def test_accuracy_and_speedup(spark):
    checks = spark.createDataFrame([("a", 1, 1), ("b", 2, 3)], "dataset string, plain long, encoded long")
    assert tuple(analytics.accuracy(checks).first()) == (2, 1, 1, 50.0)
    times = spark.createDataFrame([(10.0, 5.0), (10.0, 0.0), (None, 2.0)], "plain_ms double, encoded_ms double")
    assert [r["speedup"] for r in analytics.speedup(times).collect()] == [2.0, None, None]


SCHEMA = "Dataset string, Algorithm string, Data_MB double, BPE double, Correct double"


def test_merge_keeps_largest(spark):
    own = spark.createDataFrame([("a", "Raw", 1.0, 32.0, 1.0), ("a", "Raw", 1.0, 31.0, 1.0), ("a", "old sota", 1.0, 9.0, 1.0)], SCHEMA)
    external = spark.createDataFrame([("a", "SOTA", None, 5.0, 1.0)], SCHEMA)
    got = report.merge_results(own, external, ["Raw", "SOTA"])
    assert sorted((r["Algorithm"], r["BPE"], r["algo_rank"]) for r in got.collect()) == [("Raw", 32.0, 0), ("SOTA", 5.0, 1)]
    wide = report.wide_table(got, ["Raw", "SOTA"]).first()
    assert (wide["Raw"], wide["SOTA"]) == (32.0, 5.0)
    with pytest.raises(ValueError, match="two rows"):
        report.wide_table(own, ["Raw"])


def test_insert_external_and_ratio(spark):
    own = spark.createDataFrame([("a", "Raw", 4.0, 32.0, 1.0), ("a", "Tree", 1.0, 8.0, 1.0), ("b", "Tree", 1.0, 8.0, 1.0), ("c", "Other", 1.0, 0.0, 1.0)], SCHEMA)
    external = spark.createDataFrame([("a", "SOTA", 0.5, 4.0, 1.0)], SCHEMA)
    got = sorted((r["Dataset"], r["place"], r["Algorithm"], r["BPE"]) for r in report.insert_external(own, external, "Raw", "Tree").filter("BPE IS NOT NULL").collect())
    assert got == [("a", 0.0, "Raw", 32.0), ("a", 0.5, "SOTA", 4.0), ("a", 1.0, "Tree", 8.0), ("b", 1.0, "Tree", 8.0), ("c", 2.0, "Other", 0.0)]
    blank = report.insert_external(own, external, "Raw", "Tree").filter("Dataset = 'b' AND Algorithm = 'SOTA'").first()
    assert (blank["BPE"], blank["place"]) == (None, 1.5)
    ratio = {(r["Dataset"], r["Algorithm"]): r["ratio_pct"] for r in report.with_ratio(own, "Raw").collect()}
    assert ratio == {("a", "Raw"): 100.0, ("a", "Tree"): 25.0, ("b", "Tree"): 25.0, ("c", "Other"): 0.0}


def shuffled_rows(spark, run):
    """What ``run`` gives, and the rows that its stages wrote to shuffles where no table is small enough for a broadcast."""

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        return run(), written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


CLIQUE = [(a, b) for a in range(80) for b in range(80) if a != b]
#: Pairs of ways out of one vertex: 80 choose 3.
WAYS = 82_160


def test_triangle_count_moves_no_ways(spark):
    adj = spark.createDataFrame(CLIQUE, "src long, dst long")
    got, rows = shuffled_rows(spark, lambda: analytics.triangle_count(adj).first()[0])
    assert got == WAYS
    assert rows < WAYS / 2


def test_local_triangles_move_no_ways(spark):
    adj = spark.createDataFrame(CLIQUE, "src long, dst long")
    got, rows = shuffled_rows(spark, lambda: analytics.local_triangles(adj).collect())
    assert sorted(map(tuple, got)) == [(i, 79 * 78 // 2) for i in range(80)]
    assert rows < WAYS / 2


def test_local_triangles_make_no_row_of_a_triangle(spark):
    adj = spark.createDataFrame(CLIQUE, "src long, dst long")
    parts = triangles.triangle_ends(adj).collect()
    assert sum(r["n"] for r in parts) == 3 * WAYS
    assert len(parts) < WAYS / 2
    plan = analytics.local_triangles(adj)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_edges_are_shuffled_once_for_their_direction(spark, monkeypatch):
    adj = spark.createDataFrame(CLIQUE, "src long, dst long").cache()
    adj.count()
    dealt = triangles.LEAST_COLOURS * 80 * 2
    got, rows = shuffled_rows(spark, lambda: analytics.triangle_count(adj).first()[0])
    assert got == WAYS
    assert rows < len(CLIQUE) // 2 + dealt + 2_000
    monkeypatch.setattr(triangles, "BROADCAST_VERTICES", 79)
    assert analytics.triangle_count(adj).first()[0] == WAYS
    sparse = spark.createDataFrame(graph(4, 60, 500), "src long, dst long")
    by_joins = sorted(map(tuple, analytics.local_triangles(sparse).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, analytics.local_triangles(sparse).collect())) == by_joins


def test_encoded_triangles_move_no_ways(spark):
    adj = spark.createDataFrame(CLIQUE, "src long, dst long").cache()
    rows = relabel.ordered_rows(adj)
    parents = forest.first_fit(rows).cache()
    commands = codecs.tree_commands(rows, parents).cache()
    got, moved = shuffled_rows(spark, lambda: analytics.triangle_count_encoded(commands, parents, 80).first()[0])
    assert got == WAYS
    assert moved < WAYS / 2
