"""Choices and lists by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def top_by(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest_per_key(stats: DataFrame) -> DataFrame:
    """Rows with the newest created of their key; ties stay. A maximum by key and a join, no sort of a group."""
    newest = stats.groupBy(F.col("key").alias("__key")).agg(F.max("created").alias("__created"))
    return stats.join(newest, (F.col("key") == F.col("__key")) & (F.col("created") == F.col("__created")), "left_semi")


def latest_one(stats: DataFrame, release: str, kind: str, key: str) -> DataFrame:
    chosen = stats.filter((F.col("release") == release) & (F.col("type") == kind) & (F.col("key") == key))
    return chosen.orderBy(F.col("created").desc_nulls_last(), F.col("value").desc_nulls_last()).limit(1)


def pockets_by_residue(pockets: DataFrame) -> DataFrame:
    """(accession, residue, pocket_ids) with pockets by falling score."""
    exploded = pockets.select("struct_id", F.explode("pocket_resid").alias("residue"), "pocket_id", "pocket_score_combined_scaled")
    item = F.struct((-F.col("pocket_score_combined_scaled")).alias("order"), F.col("pocket_id").alias("id"))
    return exploded.groupBy(F.col("struct_id").alias("accession"), "residue").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["id"]).alias("pocket_ids"))


def interactions_by_residue(interfaces: DataFrame) -> DataFrame:
    """(accession, residue, partners) for both sides, partners by falling docking score."""
    side = lambda who, other, residues: interfaces.select(F.col(who).alias("accession"), F.explode(residues).alias("residue"), F.col(other).alias("partner"), "pdockq")
    both = side("a", "b", "a_residues").union(side("b", "a", "b_residues"))
    item = F.struct((-F.col("pdockq")).alias("order"), "partner")
    return both.groupBy("accession", "residue").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["partner"]).alias("partners"))


def foldx_middle(foldx: DataFrame) -> DataFrame:
    """The middle fragment (by af_id) of each prediction, with the number of fragments."""
    keys = ["protein_acc", "position", "mutated_type"]
    w = Window.partitionBy(*keys)
    ranked = foldx.withColumn("rank", F.row_number().over(w.orderBy("af_id"))).withColumn("num_fragments", F.count("*").over(w))
    return ranked.filter(F.col("rank") == F.floor(F.col("num_fragments") / 2) + 1).drop("rank")
