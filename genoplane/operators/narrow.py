"""Small inputs against large tables: inputs are counted, and few of them cut a table down where it is scanned.

Up to MOST_KEYS distinct keys, which are pairs of a name and a whole number, come to the
driver. From them a condition is made that Parquet's row groups are skipped by: lists of
numbers by name for few keys, else the range of numbers of each name. What the scan lets
through is held against the keys by a broadcast join. More keys are joined by a shuffle.
Rows of a few names (a gene's, a protein's), however many, give the range of each name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast (24 bytes each, or a short name more), names whose ranges are pushed to the scan, and keys that are listed.
MOST_KEYS, MOST_NAMES, MOST_LISTED = 10_000, 50, 200
#: Rows for each key of the most that are looked at first: where these hold too many keys, the others are not counted.
FIRST_ROWS = 4


class Keys:
    """Distinct pairs (name, number) that tables are cut down to. Pairs with a null match nothing."""

    def __init__(self, rows: DataFrame, name: str, number: str, most: int | None = None, peek: bool = False):
        """peek: rows are read from a table and may be many, so that their first ones are looked at before all are made distinct."""
        most = MOST_KEYS if most is None else most
        pairs = rows.select(F.col(name).alias("__name"), F.col(number).cast("long").alias("__number")).dropna()
        self.rows = pairs.distinct()
        self.small = not peek or len(set(map(tuple, pairs.limit(FIRST_ROWS * (most + 1)).collect()))) <= most
        found = [tuple(r) for r in self.rows.limit(most + 1).collect()] if self.small else []
        self.small = self.small and len(found) <= most
        self.by_name: dict[str, list[int]] = {}
        if self.small:
            for key, value in sorted(found):
                self.by_name.setdefault(key, []).append(value)
            self.rows = F.broadcast(rows.sparkSession.createDataFrame(found, "__name string, __number long"))

    def __len__(self) -> int:
        return sum(map(len, self.by_name.values()))

    def condition(self, name: str, number: str) -> Column:
        """True for all rows that have one of the keys; for a scan to push down."""
        if not self.by_name:
            return F.lit(False)
        if len(self) <= MOST_LISTED:
            return reduce(or_, [(F.col(name) == k) & F.col(number).isin(v) for k, v in self.by_name.items()])
        if len(self.by_name) <= MOST_NAMES:
            return reduce(or_, [(F.col(name) == k) & F.col(number).between(v[0], v[-1]) for k, v in self.by_name.items()])
        numbers = [n for v in self.by_name.values() for n in (v[0], v[-1])]
        return F.col(name).between(min(self.by_name), max(self.by_name)) & F.col(number).between(min(numbers), max(numbers))

    def of_names(self, name: str) -> Column:
        """True for rows with one of the names, whatever their number."""
        if len(self.by_name) <= MOST_LISTED:
            return F.col(name).isin(list(self.by_name))
        return F.col(name).between(min(self.by_name), max(self.by_name))

    def cut(self, table: DataFrame, name: str, number: str) -> DataFrame:
        """The rows of table with one of the keys."""
        if self.small:
            table = table.filter(self.condition(name, number))
            if len(self) <= MOST_LISTED:
                return table  # the condition is exact
        return table.join(self.rows, (F.col(name) == F.col("__name")) & (F.col(number) == F.col("__number")), "left_semi")

    def bounded(self, table: DataFrame, name: str, number: str) -> DataFrame:
        """cut, with a hint to broadcast what is left of a table that has few rows a key."""
        return F.broadcast(self.cut(table, name, number)) if self.small else self.cut(table, name, number)


Ranges = dict[str, tuple[int, int]] | None


def ranges(rows: DataFrame, *pairs: tuple[str, str]) -> list[Ranges]:
    """For each pair of columns (name, number) the least and the largest number of each name, in one pass over rows.

    None for every pair if more than MOST_NAMES combinations of names occur. Nulls match nothing.
    """
    ends = [f(number).alias(f"__{k}{end}") for k, (_, number) in enumerate(pairs) for end, f in enumerate((F.min, F.max))]
    found = rows.groupBy(*[F.col(name).alias(f"__name{k}") for k, (name, _) in enumerate(pairs)]).agg(*ends).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        return [None] * len(pairs)
    out: list[Ranges] = [{} for _ in pairs]
    for row in found:
        for k, held in enumerate(out):
            name, low, high = row[f"__name{k}"], row[f"__{k}0"], row[f"__{k}1"]
            if name is not None and low is not None:
                before = held.get(name, (low, high))
                held[name] = min(low, before[0]), max(high, before[1])
    return out


def within(table: DataFrame, name: str, number: str, held: Ranges) -> DataFrame:
    """The rows of table in the range of their name, by a condition that is pushed to the scan; all, if no ranges are known.

    Conditions of one column each come first: Spark infers those for the other sides of joins that a derived table is made of.
    """
    if held is None:
        return table
    if not held:
        return table.filter(F.lit(False))
    apart = F.col(name).isin(list(held)) & F.col(number).between(min(low for low, _ in held.values()), max(high for _, high in held.values()))
    return table.filter(apart & reduce(or_, [(F.col(name) == k) & F.col(number).between(*ends) for k, ends in held.items()]))
