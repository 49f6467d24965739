"""Orders, pages and counts of results."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, SIZE, LEAST_SIZE, MOST_SIZE = 1, 25, 10, 1000
COUNT_CAP, COUNT_SECONDS, UNKNOWN_COUNT = 10_000, 3.0, -1
SORT_COLUMNS = {"cadd": "cadd_score", "am": "am_pathogenicity", "popeve": "popeve", "esm1b": "esm_score"}
#: Ends every order, so that pages are the same each time.
TIE_BREAK = ["protein_position", "codon_position", "alt_allele", "chromosome", "genomic_position", "allele", "accession"]


def ordering(sort: str | None = None, order: str = "desc", columns: list[str] | None = None) -> list[Column]:
    """Nulls first when falling and last when rising."""
    ties = [F.col(c).asc_nulls_last() for c in TIE_BREAK if columns is None or c in columns]
    if sort is None:
        return ties
    by = F.col(SORT_COLUMNS[sort])
    return [by.asc_nulls_last() if order.lower() == "asc" else by.desc_nulls_first(), *ties]


def page(rows: DataFrame, order: list[Column], number: int = PAGE, size: int = SIZE) -> DataFrame:
    """One page of a total order: a top-k in each task and a merge, no full sort."""
    if number < 1 or not 1 <= size <= MOST_SIZE:
        raise ValueError(f"page {number} of {size} rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def slice_lines(lines: DataFrame, number: int, size: int, column: str = "line_no") -> DataFrame:
    """A page of numbered lines (from 1), by range; past the end it is empty."""
    start = (number - 1) * size
    return lines.filter(F.col(column).between(start + 1, start + size))


def bounded_count(rows: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """(n, more): the count up to cap, and whether there are more."""
    counted = rows.limit(cap + 1).agg(F.count("*").alias("n"))
    return counted.select(F.least("n", F.lit(cap).cast("long")).alias("n"), (F.col("n") > cap).alias("more"))


def timed_count(rows: DataFrame, cap: int = COUNT_CAP, seconds: float = COUNT_SECONDS) -> int:
    """The count up to cap + 1, or UNKNOWN_COUNT if it takes longer; the jobs of a late count are cancelled."""
    context, tag = rows.sparkSession.sparkContext, f"count-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return rows.limit(cap + 1).count()
    except Exception:
        if late.is_set():
            return UNKNOWN_COUNT
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def count_distinct(columns: list[str]) -> Column:
    """Distinct row values; rows with nulls count, unlike in count(DISTINCT a, b)."""
    return F.countDistinct(F.struct(*columns))
