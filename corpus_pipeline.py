"""A training-data pipeline: classify, apply rules, drop copies and near copies, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that
the stage before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoplane.llm import exact_dedup, packing, quality_classifier, quality_rules, simhash_dedup
from genoplane.llm.queries import tokenizer_path
from genoplane.llm.workspace import delete, fresh, noted, read, written

#: Ids to drop that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """Adds a digest of all that a verdict rests on: text and language."""
    return docs.withColumn(name, F.unhex(F.sha2(F.concat(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary"), 256)))


def without(docs: DataFrame, judge: Callable[..., DataFrame], labels: DataFrame, keeps: F.Column) -> DataFrame:
    """The rows of docs that the judgement keeps. Rows are judged by their own text: verdicts are known by id and a digest, so rows with null or equal ids have verdicts of their own."""
    key, id_, lost_key = fresh(docs, "verdict_key", "lost_id", "lost_key")
    judged = judge(keyed(docs, key), labels, carried=[key])
    lost = written(judged.filter(~keeps).select(F.col("doc_id").alias(id_), F.col(key).alias(lost_key)).distinct(), "lost")
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    return keyed(docs, key).join(lost, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.col(key) == F.col(lost_key)), "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts. It learns from the labels of the rows that reach it; without any, all rows score alike."""
    return without(docs, quality_classifier.classify, read(spark, sf_dir, "labels"), F.col("predicted") == 1)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules; a text without ten words fails."""
    return without(docs, quality_rules.apply_rules, read(spark, sf_dir, "labels"), F.col("kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text that is equal but for white space: that with the least id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints within two bits: that with the least id. Rows with a null id stay."""
    return simhash_dedup.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of the documents.

    Null texts count as empty and fail the rules, null languages are one of their own.
    Repeated rows are judged alike, and one of them stays; very long texts go through
    whole; ties go to the least id. Extra columns pass all stages but the last,
    whatever their names. An empty table gives an empty result. Of the tables in the
    shared folder only the result stays.
    """
    docs, paths = read(spark, sf_dir, "documents"), []
    try:
        with noted(paths):
            for name, stage in STAGES[:-1]:
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
                # What the stage read and made on its way is not needed beside what it kept.
                while len(paths) > 1:
                    delete(spark, paths.pop(0))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        for path in paths:
            delete(spark, path)


#: A trained classifier, cutoffs by exact binomial bounds and a tokenizer are beyond SQL: tests hold each stage against a plain version.
ORACLE_SQL = None
