"""Filters on variants: score bands, ranges, features, structures, known variants."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import FEATURE_GROUPS, parse_category
from .intervals import positions, within_ranges


def in_bands(value: Column, chosen: list[str], bands: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether value is in one of the chosen half-open bands; an open side has no comparison."""
    tests = []
    for name in chosen:
        low, high = bands[parse_category(name, bands)]
        sides = [value >= low] if low is not None else []
        sides += [value < high] if high is not None else []
        tests.append(reduce(lambda a, b: a & b, sides))
    return reduce(or_, tests) if tests else F.lit(True)


def in_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """low <= value <= high, either side optional."""
    test = F.lit(True) if low is None else value >= low
    return test if high is None else test & (value <= high)


def _positions(features: DataFrame) -> DataFrame:
    return features.select("accession", "begin_pos", "end_pos", "type")


def with_feature_groups(rows: DataFrame, features: DataFrame, groups: list[str]) -> DataFrame:
    """Rows in a feature of every group. Ranges meet positions by bins; disulfide bonds count at their two ends only."""
    for name in groups:
        types = FEATURE_GROUPS[parse_category(name, FEATURE_GROUPS)]
        ranged = _positions(features).filter(F.col("type").isin([t for t in types if t != "DISULFID"]))
        spans = ranged.select("accession", "begin_pos", "end_pos")
        if "DISULFID" in types:
            ends = _positions(features).filter("type = 'DISULFID'").select("accession", F.explode(F.array("begin_pos", "end_pos")).alias("begin_pos"))
            spans = spans.unionByName(ends.withColumn("end_pos", F.col("begin_pos")))
        rows = within_ranges(rows, spans, "accession", "protein_position", "begin_pos", "end_pos")
    return rows


def at_positions(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows whose (accession, protein_position) is among positions (accession, position)."""
    wanted = positions.select(F.col("accession").alias("__acc"), F.col("position").alias("__pos")).distinct()
    return rows.join(wanted, (F.col("accession") == F.col("__acc")) & (F.col("protein_position") == F.col("__pos")), "left_semi")


def disease_positions(population: DataFrame) -> DataFrame:
    return population.filter("disease").select("accession", "position")


def pocket_positions(pockets: DataFrame) -> DataFrame:
    return pockets.select(F.col("struct_id").alias("accession"), F.explode("pocket_resid").alias("position")).distinct()


def interface_positions(interfaces: DataFrame) -> DataFrame:
    """Both sides of each interface as a union of exploded lists: an OR in a join would compare all pairs."""
    side = lambda who, residues: interfaces.select(F.col(who).alias("accession"), F.explode(residues).alias("position"))
    return side("a", "a_residues").union(side("b", "b_residues")).distinct()


def structure_positions(structures: DataFrame) -> DataFrame:
    return positions(structures, "accession", "unp_start", "unp_end")


def in_structures(rows: DataFrame, structures: DataFrame) -> DataFrame:
    """Rows within unp_start and unp_end of a structure, by bins."""
    return within_ranges(rows, structures, "accession", "protein_position", "unp_start", "unp_end")


def in_regions(position: Column, regions: Column) -> Column:
    """Whether position is in one of an array of [start, end] pairs."""
    return F.exists(regions, lambda r: position.between(r[0], r[1]))


def known_variants(rows: DataFrame, lookup: DataFrame, alternates: Column | None = None) -> DataFrame:
    """Rows that a table of known variants has: equality on chromosome, position and reference; the alternate as residue."""
    alts = F.col("known_alts") if alternates is None else alternates
    right = lookup.select(F.col("chr").alias("__chr"), F.col("pos").alias("__pos"), F.col("ref").alias("__ref"), alts.alias("__alts"))
    same = (F.col("chromosome") == F.col("__chr")) & (F.col("genomic_position") == F.col("__pos")) & (F.col("allele") == F.col("__ref"))
    return rows.join(right, same & F.array_contains(F.col("__alts"), F.col("alt_allele")), "left_semi")


def exploded_known(lookup: DataFrame) -> DataFrame:
    """(chromosome, genomic_position, allele, alt_allele) of the lookup."""
    return lookup.select(F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position"), F.col("ref").alias("allele"), F.explode("known_alts").alias("alt_allele"))
