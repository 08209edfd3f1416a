"""Benchmark tables as CSV files: tolerant readers, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("Dataset", "Algorithm", "Data_MB", "BPE", "Correct")
#: Headers under which a ratio in percent of 32 bits may stand instead of bits per edge (fixed values).
RATIO_HEADERS = ("Ratio", "RatioPercent", "CompressionRatio", "Compression_Ratio", "Ratio_%")
SCHEMA = "Dataset string, Algorithm string, Data_MB double, BPE double, Correct double"


def _cells(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Trimmed header names, and ``cells`` (array) and ``line`` of every other line that isn't blank. Quoting isn't used in these files."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    head = lines.orderBy("line").limit(1).collect()
    if not head:
        return [], lines.select(F.array().cast("array<string>").alias("cells"), "line")
    names = [x.strip() for x in head[0]["value"].split(",")]
    rest = lines.filter((F.col("line") != F.lit(head[0]["line"])) & (F.trim("value") != ""))
    return names, rest.select(F.transform(F.split("value", ",", -1), lambda x: F.trim(x)).alias("cells"), "line")


def _number(c: Column) -> Column:
    return F.when(c != "", c).try_cast("double")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Dataset, Algorithm, Data_MB, BPE, Correct of a benchmark file, and MEPS where it has that column.

    A row with too many cells had thousands separators in Data_MB: the cells between the first two and the last ones are
    joined. Shorter rows are dropped, as are rows without Dataset, Algorithm or BPE; other bad numbers become null.
    """
    names, rows = _cells(spark, path)
    if not names:
        return spark.createDataFrame([], SCHEMA)
    behind = 3 if "MEPS" in names else 2
    width = 3 + behind
    n = F.size("cells")
    kept = rows.filter(n >= width)
    middle = F.array_join(F.slice("cells", F.lit(3), n - 2 - behind), "")
    cell = {"Dataset": F.col("cells")[0], "Algorithm": F.col("cells")[1], "Data_MB": _number(middle), "BPE": _number(F.element_at("cells", -behind)), "Correct": _number(F.element_at("cells", -1))}
    if behind == 3:
        cell["MEPS"] = _number(F.element_at("cells", -2))
    out = kept.select(*[F.when(v != "", v).alias(k) if k in ("Dataset", "Algorithm") else v.alias(k) for k, v in cell.items()])
    return out.dropna(subset=["Dataset", "Algorithm", "BPE"])


def malformed_rows(spark: SparkSession, path: str) -> int:
    """Rows that read_benchmark() repaired or dropped for their number of cells."""
    names, rows = _cells(spark, path)
    return rows.filter(F.size("cells") != (6 if "MEPS" in names else 5)).count() if names else 0


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External results in any of three forms: full, Dataset and BPE, or Dataset and a ratio. All rows are of algorithm SOTA.

    In the full form only rows whose algorithm contains SOTA count. Padded headers are found like others. The last row of a
    dataset wins.
    """
    names, rows = _cells(spark, path)

    def cell(name: str) -> Column:
        return F.when(F.get("cells", F.lit(names.index(name))) != "", F.get("cells", F.lit(names.index(name)))) if name in names else F.lit(None).cast("string")

    ratio = next((r for r in RATIO_HEADERS if r in names), None)
    if "Dataset" not in names or ("BPE" not in names and ratio is None):
        return spark.createDataFrame([], SCHEMA)
    bpe = _number(cell("BPE")) if "BPE" in names else _number(cell(ratio or "")) * 32.0 / 100.0
    full = "BPE" in names and "Algorithm" in names
    kept = rows.filter(F.upper(cell("Algorithm")).contains("SOTA")) if full else rows
    out = kept.select("line", cell("Dataset").alias("Dataset"), F.lit("SOTA").alias("Algorithm"), _number(cell("Data_MB")).alias("Data_MB") if full else F.lit(None).cast("double").alias("Data_MB"), bpe.alias("BPE"), _number(cell("Correct")).alias("Correct") if full else F.lit(1.0).alias("Correct"))
    out = out.dropna(subset=["Dataset", "BPE"])
    last = out.groupBy("Dataset").agg(F.max_by(F.struct("Algorithm", "Data_MB", "BPE", "Correct"), "line").alias("r"))
    return last.select("Dataset", "r.*")


def blank_or(c: Column, digits: int = 4) -> Column:
    """A number with fixed digits; blank for null and NaN."""
    return F.when(c.isNull() | F.isnan(c), "").otherwise(F.format_string(f"%.{digits}f", c))


def yes_no(c: Column) -> Column:
    """YES, NO, or blank where it isn't known."""
    return F.when(c.isNull(), "").when(c.cast("double") > 0, "YES").otherwise("NO")


def write_report(df: DataFrame, path: str, digits: int | None = None) -> None:
    """One CSV file with header in folder ``path``; a report has one row per dataset and algorithm. ``digits``: fixed, with blanks for unknown numbers."""
    out = df
    if digits is not None:
        out = df.select(*[blank_or(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.coalesce(1).write.option("header", True).option("emptyValue", "").option("nullValue", "").mode("overwrite").csv(path)


def console_table(df: DataFrame, digits: int = 4) -> DataFrame:
    """All columns as text, numbers with fixed digits and flags as YES or NO."""
    shown = {"double": lambda c: blank_or(c, digits), "boolean": yes_no}
    return df.select(*[shown.get(t, lambda c: F.coalesce(c.cast("string"), F.lit("")))(F.col(c)).alias(c) for c, t in df.dtypes])
