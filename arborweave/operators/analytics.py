"""Components, triangles and breadth-first search, on plain adjacency and on its encoded form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborweave.operators.codecs import expanded
from arborweave.operators.components import components
from arborweave.operators.triangles import triangle_count, triangle_ends, triangles
from arborweave.session import cut

#: When breadth-first search on commands gives way to plain adjacency (fixed values): commands per edge above the
#: first; or, from so many vertices on, paths per command or commands per edge at least so many.
MAX_TOKEN_EDGE, LARGE_GRAPH, LARGE_PATH_TOKEN, LARGE_TOKEN_EDGE = 0.45, 5_000_000, 0.70, 0.12


def component_table(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component (smallest reachable id) of every vertex."""
    return components(adj.filter("src < dst"), vertices)


def component_table_encoded(commands: DataFrame, parents: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same from parents and commands' bottoms, without expanding paths: a parent shares a row with its child, hence a neighbour."""
    tree = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    reduced = tree.union(commands.select("src", F.col("bottom").alias("dst")))
    return components(reduced, vertices)


def triangle_count_encoded(commands: DataFrame, parents: DataFrame, n_vertices: int | None = None) -> DataFrame:
    """The same on rows expanded from commands."""
    return triangle_count(expanded(commands, parents, n_vertices))


def start_vertex(adj: DataFrame) -> int | None:
    """The vertex of highest degree, the smallest of those; none for an empty graph."""
    best = adj.groupBy("src").agg(F.count("*").alias("d")).orderBy(F.col("d").desc(), "src").limit(1).collect()
    return best[0]["src"] if best else None


LEVELS = "id long, level int"
#: Levels after which the table of seen vertices is written anew; between, it is a union of the levels' own checkpoints.
MERGE_EVERY = 8


def _grown(seen: DataFrame, frontier: DataFrame, level: int) -> DataFrame:
    both = seen.unionByName(frontier)
    return cut(both) if level % MERGE_EVERY == 0 else both


def bfs_levels(adj: DataFrame, start: int | None) -> DataFrame:
    """id, level of every vertex that ``start`` reaches; none from None. One join and one anti-join a level, cut off by reliable checkpoints."""
    spark = adj.sparkSession
    if start is None:
        return spark.createDataFrame([], LEVELS)
    frontier = spark.range(start, start + 1).select("id", F.lit(0).alias("level"))
    seen, level = cut(frontier), 0
    frontier = seen
    while True:
        level += 1
        reached = frontier.join(adj, frontier["id"] == adj["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if frontier.isEmpty():
            return seen
        seen = _grown(seen, frontier, level)


def use_commands(token_edge_ratio: float, path_token_ratio: float, n_vertices: int) -> bool:
    """Whether searching on commands promises to pay."""
    if token_edge_ratio > MAX_TOKEN_EDGE:
        return False
    return not (n_vertices >= LARGE_GRAPH and (path_token_ratio >= LARGE_PATH_TOKEN or token_edge_ratio >= LARGE_TOKEN_EDGE))


def bfs_levels_encoded(commands: DataFrame, parents: DataFrame, start: int | None, n_vertices: int | None = None) -> DataFrame:
    """The same on commands. A path is expanded only beyond the steps that its bottom has been expanded to before."""
    spark = commands.sparkSession
    if start is None:
        return spark.createDataFrame([], LEVELS)
    seen = cut(spark.range(start, start + 1).select("id", F.lit(0).alias("level")))
    frontier, level = seen, 0
    done = cut(spark.createDataFrame([], "bottom long, expanded_to long"))
    while True:
        level += 1
        met = frontier.join(commands, frontier["id"] == commands["src"]).groupBy("bottom").agg(F.max("steps").alias("steps"))
        new = cut(met.join(done, "bottom", "left").filter(F.coalesce("expanded_to", F.lit(-1).cast("long")) < F.col("steps")).select("bottom", "steps"))
        reached = expanded(new.select(F.lit(0).cast("long").alias("src"), "bottom", "steps"), parents, n_vertices).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if frontier.isEmpty():
            return seen
        seen = _grown(seen, frontier, level)
        done = cut(done.union(new).groupBy("bottom").agg(F.max("expanded_to").alias("expanded_to")))


def accuracy(checks: DataFrame) -> DataFrame:
    """checked, correct, failed, accuracy_pct over rows of (dataset, plain, encoded)."""
    right = F.col("plain") == F.col("encoded")
    sums = checks.agg(F.count("*").alias("checked"), F.coalesce(F.sum(F.when(right, 1).otherwise(0)), F.lit(0)).cast("long").alias("correct"))
    return sums.select("checked", "correct", (F.col("checked") - F.col("correct")).alias("failed"), F.when(F.col("checked") > 0, F.round(F.col("correct") * 100.0 / F.col("checked"), 4)).alias("accuracy_pct"))


def speedup(timings: DataFrame) -> DataFrame:
    """Adds speedup = plain_ms / encoded_ms; null where either is missing or the second is not positive."""
    return timings.withColumn("speedup", F.when((F.col("encoded_ms") > 0) & F.col("plain_ms").isNotNull(), F.col("plain_ms") / F.col("encoded_ms")))


def component_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("component").agg(F.count("*").alias("size"))


def local_triangles(adj: DataFrame) -> DataFrame:
    """id, triangles of each vertex that is in one."""
    return triangle_ends(adj).groupBy("id").agg(F.sum("n").alias("triangles"))


def ranked_sizes(table: DataFrame) -> DataFrame:
    """Components by size; one row per component takes part in the window."""
    return component_sizes(table).withColumn("place", F.row_number().over(Window.orderBy(F.col("size").desc(), "component")))
