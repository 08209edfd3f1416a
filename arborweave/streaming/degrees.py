"""Edges that keep arriving: parsed from text as a stream, and degrees kept up to date.

Codecs stay in batch jobs: their parents follow from frequencies over the whole graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborweave.sources.edges import parsed_edges


def edge_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """src, dst of every edge line of text files that appear in ``folder``."""
    return parsed_edges(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder))


def degree_stream(edges: DataFrame, directed: bool = False) -> DataFrame:
    """id, degree so far: distinct neighbours of each vertex. State holds every distinct edge once."""
    pairs = edges if directed else edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    return pairs.dropDuplicates(["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def windowed_edges(edges: DataFrame, width: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """Edges per window of their time ``ts``; rows later than ``lateness`` are dropped once the watermark has passed."""
    return edges.withWatermark("ts", lateness).groupBy(F.window("ts", width)).agg(F.count("*").alias("n_edges"), F.approx_count_distinct("src").alias("sources"))


def append_adjacency(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's distinct edges, both directions, as Parquet; readers take the distinct rows. Exactly once per batch by the file sink's log."""
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    return both.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
