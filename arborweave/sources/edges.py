"""Edge lists as text, and adjacency tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = (1 << 32) - 1
EDGE = r"^\s*([0-9]+)\s+([0-9]+)"


def parsed_edges(lines: DataFrame, fmt: str = "edges", *kept: str) -> DataFrame:
    """src, dst, and the columns ``kept``, of every line of ``value`` that holds an edge.

    Comments (``#`` or ``%`` first), blank lines, lines without two leading non-negative integers up to 2^32 - 1, and
    self-loops are left out. Commas count as white space; what follows the second number is ignored.
    ``fmt='mtx'`` also leaves out the size line, the first line that is no comment; it needs the columns ``line`` (anything in the lines' order) and ``file``.
    """
    value = F.translate("value", ",", " ")
    found = lines.filter((F.col("value") != "") & ~F.col("value").rlike("^[#%]"))
    if fmt == "mtx":
        first = found.filter(F.trim("value") != "").groupBy("file").agg(F.min("line").alias("__size_line"))
        found = found.join(first, "file").filter(F.col("line") > F.col("__size_line"))
    elif fmt != "edges":
        raise ValueError(f"unknown edge format {fmt!r}")
    number = [F.regexp_extract(value, EDGE, i).try_cast("bigint") for i in (1, 2)]
    pairs = found.select(*kept, number[0].alias("src"), number[1].alias("dst"))
    return pairs.filter((F.col("src") <= MAX_ID) & (F.col("dst") <= MAX_ID) & (F.col("src") != F.col("dst")))


def reject_count(lines: DataFrame) -> DataFrame:
    """Number of lines by what becomes of them: comment, blank, edge, self_loop, rejected."""
    value = F.translate("value", ",", " ")
    a, b = (F.regexp_extract(value, EDGE, i).try_cast("bigint") for i in (1, 2))
    valid = F.coalesce((a <= MAX_ID) & (b <= MAX_ID), F.lit(False))
    what = F.when(F.col("value") == "", "blank").when(F.col("value").rlike("^[#%]"), "comment").when(valid & (a == b), "self_loop").when(valid, "edge").otherwise("rejected")
    return lines.groupBy(what.alias("line_kind")).agg(F.count("*").alias("n_lines"))


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file, line: the place of the file's part that a line was read from, and the line's number within what one task read."""
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), order.alias("line"))


def read_edges(spark: SparkSession, paths: str | list[str], fmt: str = "edges") -> DataFrame:
    """src, dst of one text file or several; a missing file raises Spark's path error."""
    return parsed_edges(_lines(spark, paths), fmt)


def dataset_name(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def read_datasets(spark: SparkSession, paths: Iterable[str], fmt: str = "edges") -> DataFrame:
    """dataset, src, dst of many files in one scan; the dataset is named after the file."""
    lines = _lines(spark, list(paths)).withColumn("dataset", dataset_name(F.col("file")))
    return parsed_edges(lines, fmt, "dataset")


def adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct src, dst without self-loops; both directions unless ``directed``, and then only one of them is shuffled."""
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    if directed:
        return pairs.distinct()
    once = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return once.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def vertices(adj: DataFrame) -> DataFrame:
    """id: 0 to the largest id; ids without edges are isolated vertices. Empty for an empty graph."""
    top = adj.agg(F.max(F.greatest("src", "dst")).alias("top")).first()["top"]
    return adj.sparkSession.range(0 if top is None else top + 1).select("id")
