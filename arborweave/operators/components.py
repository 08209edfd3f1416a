"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweave.session import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a vertex is linked to the smallest vertex of the neighbourhood."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    joined = both.join(low, "src")
    return joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    joined = down.join(low, "src")
    links = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", F.col("low").alias("dst")))
    return links.filter("src <> dst").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every upper end hangs on one lower end alone, and no lower end hangs on another."""
    ends = links.select(F.col("src").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select(F.col("dst").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (src, dst); component is the smallest id that it reaches.

    Rounds of large and small stars halve path lengths until every vertex hangs on its smallest one; links that are
    stars from the start take no round. Each round is cut off by a reliable checkpoint, so a lost executor repeats one round at most.
    Self-loops, repeated and null-ended edges add nothing.
    """
    links = cut(edges.select("src", "dst").filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(MAX_ROUNDS):
        if _are_stars(links):
            break
        links = cut(_small_star(_large_star(links)))
    else:
        raise RuntimeError("components didn't settle")
    roots = links.select(F.col("dst").alias("id")).distinct()
    return links.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component) for every vertex, isolated ones included."""
    labels = component_labels(edges).withColumnRenamed("id", "__id")
    return vertices.join(labels, vertices["id"] == labels["__id"], "left").select("id", F.coalesce("component", "id").alias("component"))
