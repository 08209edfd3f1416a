"""Benchmarks and analytics over edge files, one after the other, as the command line runs them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.operators import analytics, codecs
from arborweave.plans.registry import Graph
from arborweave.session import cut
from arborweave.sources.edges import adjacency, dataset_name, read_edges

METRICS = "dataset string, codec string, n_edges long, bytes long, data_mb double, bpe double, ratio_pct double, meps double, correct boolean"
CHECKS = "dataset string, what string, plain long, encoded long, plain_ms double, encoded_ms double"


@dataclass
class Batch:
    """Rows of the datasets that could be read, and why the others couldn't."""

    rows: DataFrame
    failures: dict[str, str] = field(default_factory=dict)


def decode_meps(decoded: DataFrame, n_edges: int, min_ms: float = 20.0) -> float:
    """Million edges decoded a second: whole decodes without output are repeated until ``min_ms`` have passed; 0 without edges."""
    if not n_edges:
        return 0.0
    rounds, began = 0, time.perf_counter()
    while rounds == 0 or (time.perf_counter() - began) * 1000 < min_ms:
        decoded.write.format("noop").mode("overwrite").save()
        rounds += 1
    return n_edges * rounds / (time.perf_counter() - began) / 1e6


def _name(spark: SparkSession, path: str) -> str:
    return spark.range(1).select(dataset_name(F.lit(path))).first()[0]


def _over_files(spark: SparkSession, paths: Iterable[str], schema: str, make: Callable[[str, Graph], list[tuple]], fmt: str) -> Batch:
    rows, failures = [], {}
    for path in paths:
        try:
            g = Graph(spark, "", _name(spark, path), adjacency(read_edges(spark, path, fmt)))
        except AnalysisException as missing:
            failures[path] = missing.getCondition() or str(missing)
            continue
        rows += make(_name(spark, path), g)
    return Batch(spark.createDataFrame(rows, schema), failures)


def benchmark(spark: SparkSession, paths: Iterable[str], fmt: str = "edges", timed: bool = True) -> Batch:
    """Sizes of all codecs per dataset, each checked by decoding and comparing whole rows; ``timed``: decode speed too."""

    def make(name: str, g: Graph) -> list[tuple]:
        delta, tree, best = (cut(x) for x in (codecs.delta_payload(g.adj), codecs.encoded_rows(g.commands), codecs.encoded_rows(g.opt_commands)))
        n = g.n_vertices
        decoded = {
            "raw32": (codecs.raw_metrics(g.adj), g.adj, lambda d: d),
            "delta_vbyte": (codecs.delta_metrics(g.adj), codecs.delta_expanded(delta), lambda d: d),
            "tree_vbyte": (codecs.command_metrics("tree_vbyte", g.commands), codecs.expanded(codecs.decoded_commands(tree), g.parents, n), lambda d: d),
            "tree_vbyte_opt": (codecs.command_metrics("tree_vbyte_opt", g.opt_commands), codecs.expanded(codecs.decoded_commands(best), g.gain_parents, n), lambda d: _old_ids(d, g)),
        }
        out = []
        for codec, (metrics, rows, back) in decoded.items():
            m = metrics.first()
            meps = decode_meps(rows, m["n_edges"]) if timed else None
            out.append((name, codec, m["n_edges"], m["bytes"], m["data_mb"], m["bpe"], m["ratio_pct"], meps, codecs.same_edges(back(rows), g.adj)))
        return out

    return _over_files(spark, paths, METRICS, make, fmt)


def _old_ids(rows: DataFrame, g: Graph) -> DataFrame:
    from arborweave.operators.relabel import unmap

    return unmap(rows, g.score_map, ("dst",))


def _timed(make: Callable[[], int]) -> tuple[int, float]:
    began = time.perf_counter()
    value = make()
    return value, (time.perf_counter() - began) * 1000


def cross_checks(spark: SparkSession, paths: Iterable[str], fmt: str = "edges") -> Batch:
    """Components, triangles and reached vertices on plain and on encoded rows, with times, per dataset."""

    def make(name: str, g: Graph) -> list[tuple]:
        start, n = analytics.start_vertex(g.adj), g.n_vertices
        ratios = codecs.token_ratios(g.commands, n).first()
        on_commands = analytics.use_commands(ratios["token_edge_ratio"], ratios["path_token_ratio"], n)
        plain_bfs = (lambda: 0) if start is None else lambda: analytics.bfs_levels(g.adj, start).count()
        pairs = {
            "components": (lambda: analytics.component_table(g.adj, g.vertices).select("component").distinct().count(), lambda: analytics.component_table_encoded(g.commands, g.parents, g.vertices).select("component").distinct().count()),
            "triangles": (lambda: analytics.triangle_count(g.adj).first()[0], lambda: analytics.triangle_count_encoded(g.commands, g.parents, n).first()[0]),
            "bfs": (plain_bfs, plain_bfs if start is None or not on_commands else lambda: analytics.bfs_levels_encoded(g.commands, g.parents, start, n).count()),
        }
        return [(name, what, *(x for pair in zip(_timed(a), _timed(b)) for x in pair)) for what, (a, b) in pairs.items()]

    return _over_files(spark, paths, CHECKS, make, fmt)
