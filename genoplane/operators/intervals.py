"""Joins of points to ranges by bins: an equi-join on (key, level, bin), with the exact test as residue.

A range goes to the first level at which it covers few bins, and is exploded over them;
a point is exploded over the levels, one bin each. A key with very many points or ranges
is spread over its bins, and no key compares all its points with all its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of the bins of each level, and bins that a range may cover; the last level takes all longer ones.
WIDTHS = (64, 4096, 262_144)
MOST_BINS = 64


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def binned_ranges(ranges: DataFrame, begin: str, end: str) -> DataFrame:
    """ranges with level and bin, a row for each bin that a range covers. Ranges that end before they begin have none."""
    size = F.col(end).cast("long") - F.col(begin)
    level, bins = F.lit(len(WIDTHS) - 1), F.sequence(_bin(F.col(begin), WIDTHS[-1]), _bin(F.col(end), WIDTHS[-1]))
    for k in range(len(WIDTHS) - 2, -1, -1):
        fits = size < (MOST_BINS - 1) * WIDTHS[k]
        level = F.when(fits, k).otherwise(level)
        bins = F.when(fits, F.sequence(_bin(F.col(begin), WIDTHS[k]), _bin(F.col(end), WIDTHS[k]))).otherwise(bins)
    return ranges.filter(F.col(begin) <= F.col(end)).withColumn("__level", level).withColumn("__bin", F.explode(bins))


def binned_points(points: DataFrame, position: str) -> DataFrame:
    """points with level and bin, a row for each level."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), _bin(F.col(position), w).alias("bin")) for k, w in enumerate(WIDTHS)])
    return points.withColumn("__at", F.explode(levels)).withColumn("__level", F.col("__at.level")).withColumn("__bin", F.col("__at.bin")).drop("__at")


def positions(ranges: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """(key, position), each once, of all whole numbers that ranges hold, both ends included.

    Each range gives only what lies beyond all ranges of its key before it, so ranges are shuffled and never their positions.
    They are dealt again by their begin into a given number of partitions: ranges are small and their positions many, of one key too.
    """
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = ranges.filter(F.col(begin) <= F.col(end)).select(key, F.col(begin).alias("__begin"), F.col(end).alias("__end"))
    before = Window.partitionBy(key).orderBy("__begin", "__end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.max("__end").over(before)).filter("__before IS NULL OR __before < __end")
    spans = spans.withColumn("__begin", F.greatest(F.col("__begin"), F.col("__before") + 1))  # the first has none before it: greatest skips nulls
    return spans.repartition(parts, key, "__begin").select(key, F.explode(F.sequence("__begin", "__end")).alias("position"))


def join_ranges(points: DataFrame, ranges: DataFrame, key: str, position: str, begin: str, end: str) -> DataFrame:
    """A row for each point and range of its key that holds it. Column names must not clash but for the key."""
    inside = F.col(position).between(F.col(begin), F.col(end))
    return binned_points(points, position).join(binned_ranges(ranges, begin, end), [key, "__level", "__bin"]).filter(inside).drop("__level", "__bin")


def within_ranges(rows: DataFrame, ranges: DataFrame, key: str, position: str, begin: str, end: str) -> DataFrame:
    """The rows that some range of their key holds, each once.

    Distinct points are tested, so rows are neither exploded nor repeated; rows then meet the points that are held.
    """
    points = rows.select(key, position).distinct()
    held = join_ranges(points, ranges.select(F.col(key), F.col(begin).alias("__begin"), F.col(end).alias("__end")).distinct(), key, position, "__begin", "__end").select(key, position).distinct()
    return rows.join(held, [key, position], "left_semi")
