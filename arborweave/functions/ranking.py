"""Global dense positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.session import cut, shuffle_partitions


def global_position(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in ``order``, as long. Ties get any order among themselves, so give a total one.

    Rows are range-partitioned and sorted; a row's place in its partition plus the sizes of the partitions before is
    its position. Only one row per partition goes through the second window.
    """
    placed = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id()))  # partition in the upper bits, place in the lower 33
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = sizes.select("__part", before.alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per partition
    return joined.withColumn(out, F.col("__before") + place).drop("__at", "__part", "__before")
