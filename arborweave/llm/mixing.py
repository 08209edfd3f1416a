"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Every source has a weight schedule over training time 0..1, given at evenly spaced knots and linear
between them. Its integral is the source's weight, from which a word target follows. The words of a
source form a stream in hash order; the mix takes the stream from its start, again from its start
once it is used up, until the target is met. A document's place in the stream, put through the
inverse of the integrated schedule, is its training position.

The stream is laid out by hash bucket: word sums per (source, bucket) are exact, and a document's
place is interpolated within its bucket. So no row waits for the rows before it, a source with a
third of all rows is spread over its buckets, and equal rows get equal decisions. In the one bucket
of a source in which the target ends, every document gives the same share of its words.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows without
words are never taken and have no position; repeated rows count each; columns of any name are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborweave.functions.prefix import hash_bucket
from arborweave.session import cut

#: Knot weights per class of source, repeating over sources in order; their integrals are 3, 1 and 2.
SCHEDULES: tuple[tuple[float, ...], ...] = ((4.5, 3.0, 1.5), (1.0, 1.0, 1.0), (1.0, 2.0, 3.0))
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 1024
#: Rows (of a source and bucket) that are broadcast to the documents: about 20 MB. With more, documents are joined by shuffles.
BROADCAST_RANGES = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def integral(knots: Sequence[float]) -> list[float]:
    """Cumulated trapezoids of a schedule at its knots, from 0 to the source's weight."""
    if len(knots) < 2 or min(knots) < 0 or max(knots) <= 0:
        raise ValueError(f"a schedule needs two knots or more, none negative and one positive: {knots}")
    total, out = 0.0, [0.0]
    for a, b in zip(knots, knots[1:]):
        total += (a + b) / 2 / (len(knots) - 1)
        out.append(total)
    return out


def training_time(share: Column, knots: Sequence[float]) -> Column:
    """Time at which the integrated schedule reaches ``share`` (0..1) of its total."""
    cumulated, step = integral(knots), 1 / (len(knots) - 1)
    need, time = share * F.lit(cumulated[-1]), F.lit(1.0)
    for i in reversed(range(len(knots) - 1)):
        a, slope = knots[i], (knots[i + 1] - knots[i]) / step
        rest = F.greatest(need - F.lit(cumulated[i]), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * rest, F.lit(0.0)))
        inside = F.when(F.lit(a) + root <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(a) + root))
        time = F.when(need <= F.lit(cumulated[i + 1]), F.lit(i * step) + F.least(inside, F.lit(step))).otherwise(time)
    return time


def source_targets(sums: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, class, weight, target.

    Targets are proportional to weight and stop at ``max_epochs`` times the source's size; what is
    over goes to the others by weight. That is one level L with target = min(cap, L * weight): sources in
    order of cap / weight are capped as long as the level that the rest would get lies above. One row per source takes part.
    """
    weights = [integral(s)[-1] for s in schedules]
    order = Window.orderBy(F.col("source").asc_nulls_last())
    classed = sums.withColumn("class", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("class") + 1)
    capped = classed.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    levels = capped.withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("__level", level)
    # From the first source that isn't capped on, levels fall: its level is the highest of those below their source's ratio.
    found = F.max(F.when(F.col("__cap") / F.col("weight") > F.col("__level"), F.col("__level"))).over(everything)
    target = F.coalesce(F.least(F.col("__cap"), found * F.col("weight")), F.col("__cap"))
    return levels.select("source", "source_size", "class", "weight", target.alias("target"))


def _sized(docs: DataFrame, buckets: int, *kept: Column) -> DataFrame:
    """key (doc_id), source, size, bucket, and ``kept``."""
    rows = docs.select(F.col("doc_id").alias("key"), F.col("source"), word_count(F.col("text")).alias("size"), *kept)
    return rows.withColumn("bucket", hash_bucket("key", "source", buckets=buckets))


def place(sized: DataFrame, sums: DataFrame, schedules: Sequence[Sequence[float]], share: float, max_epochs: int, buckets: int) -> DataFrame:
    """``sized`` with source_size, target, taken (words, repeats counted) and placements (array of epoch,
    words, position: one entry for each time that the document is used). ``sums``: words of each source and bucket.
    """
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, schedules, share, max_epochs).withColumnRenamed("source", "target_source")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0).cast("long")))
    ranges = ranges.join(targets, F.col("source").eqNullSafe(F.col("target_source")), "inner")
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("bucket").alias("r_bucket"), "words", "start", "source_size", "target", "class")
    if sums.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    joined = sized.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("bucket") == F.col("r_bucket")), "inner")
    #: The place within the bucket: the hash bits below those that name the bucket.
    low = F.shiftrightunsigned(F.shiftleft(F.xxhash64("key", "source"), buckets.bit_length() - 1), 11).cast("double") / F.lit(float(1 << 53))
    goal = F.round("target").cast("double")
    entries = []
    for epoch in range(max_epochs):
        start = F.col("start") + F.lit(float(epoch)) * F.col("source_size")
        part = F.when(F.col("words") > 0, F.least(F.greatest((goal - start) / F.col("words"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        words = F.round(part * F.col("size")).cast("long")
        at = F.least((start + F.col("low") * part * F.col("words")) / goal, F.lit(1.0))
        position = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            position = F.when(F.col("class") == i, training_time(at, knots)).otherwise(position)
        entries.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), position.alias("position")))
    placed = joined.withColumn("low", low).withColumn("all", F.array(*entries))
    taken = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.withColumn("taken", taken).withColumn("placements", F.filter("all", lambda x: x["words"] > 0)).drop("r_source", "r_bucket", "words", "start", "class", "low", "all")


def _sums(sized: DataFrame) -> DataFrame:
    """One row per source and bucket; the texts are not read again for the totals."""
    return cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))


def mix_positions(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document, range-sorted by its first position: doc_id, source, size, source_size, target, taken, placements.

    Texts are read once: their word counts are cut off in narrow rows before anything else.
    """
    narrow = cut(_sized(docs, buckets))
    placed = place(narrow, _sums(narrow), schedules, share, max_epochs, buckets)
    rows = placed.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken", "placements")
    return rows.orderBy(F.get("placements", F.lit(0))["position"].asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """The documents in training order, a document once for each time that the mix takes it; only ``docs``' own columns.

    Texts move once, to their places in the order.
    """
    placed = place(_sized(docs, buckets, F.struct("*").alias("row")), _sums(_sized(docs, buckets)), schedules, share, max_epochs, buckets)
    each = placed.select("row", "key", F.explode("placements").alias("placement"))
    return each.orderBy(F.col("placement.position"), F.xxhash64("key")).select("row.*")
