"""Expansion of mapping rows to variants, and joins of variants to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codon import alt_codon, alternates, consequence, rna_base, translate_codon

VARIANT_KEY = ["chromosome", "genomic_position", "allele", "alt_allele"]


def expand(mapping: DataFrame) -> DataFrame:
    """Three rows for each mapping row, one for each other base, with codon, amino acid and consequence: no join."""
    return with_change(mapping.withColumn("alt_allele", F.explode(alternates(F.col("allele")))))


def with_change(rows: DataFrame) -> DataFrame:
    """Adds codon, amino acid and consequence of alt_allele to mapping rows."""
    rows = rows.withColumn("alt_codon", alt_codon(F.col("codon"), F.col("codon_position"), rna_base(F.col("alt_allele"), F.col("reverse_strand"))))
    rows = rows.withColumn("alt_aa", translate_codon(F.col("alt_codon")))
    return rows.withColumn("consequence", consequence(F.col("protein_seq"), F.col("alt_aa")))


def _join(rows: DataFrame, table: DataFrame, keys: dict[str, str], values: list[str], how: str) -> DataFrame:
    """Equi-join on keys {column of rows: column of table}; only keys and values of the table are read."""
    right = table.select(*[F.col(v).alias(f"__{k}") for k, v in keys.items()], *([] if how in ("left_semi", "left_anti") else values))
    condition = [F.col(k) == F.col(f"__{k}") for k in keys]
    return rows.join(right, condition, how).drop(*[f"__{k}" for k in keys])


def with_cadd(rows: DataFrame, cadd: DataFrame, how: str = "left") -> DataFrame:
    """Adds cadd_score. cadd holds each variant once (see unique_cadd): a dedup here would shuffle the whole table for every query."""
    keys = {"chromosome": "chromosome", "genomic_position": "position", "allele": "reference_allele", "alt_allele": "alt_allele"}
    return _join(rows, cadd.withColumnRenamed("score", "cadd_score"), keys, ["cadd_score"], how)


def unique_cadd(cadd: DataFrame) -> DataFrame:
    """Each variant once, with its highest score: for loading a release, whose source repeats rows."""
    return cadd.groupBy("chromosome", "position", "reference_allele", "alt_allele").agg(F.max("score").alias("score"))


def with_frequency(rows: DataFrame, frequency: DataFrame, how: str = "left") -> DataFrame:
    return _join(rows, frequency, {"chromosome": "chr", "genomic_position": "pos", "allele": "ref", "alt_allele": "alt"}, ["ac", "an", "af"], how)


def at_places(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join of rows to a table by VARIANT_KEY, whose columns in it are keys, with the table's values.

    The alternates of a place are a list, so both sides meet by place alone, where rows of the mapping are dealt already.
    """
    place, alt = VARIANT_KEY[:3], VARIANT_KEY[3]
    items = table.filter(F.col(keys[3]).isNotNull()).select(*[F.col(k).alias(p) for k, p in zip(keys, place)], F.struct(F.col(keys[3]).alias("alt"), *values).alias("item"))
    listed = items.groupBy(*place).agg(F.sort_array(F.collect_list("item")).alias("__listed"))
    found = F.filter("__listed", lambda x: x["alt"] == F.col(alt))
    return rows.join(listed, place, "left").withColumn("__item", F.explode_outer(found)).select(*rows.columns, *[F.col(f"__item.{v}").alias(v) for v in values])


def with_alphamissense(rows: DataFrame, am: DataFrame, how: str = "left") -> DataFrame:
    return _join(rows, am, {"accession": "accession", "protein_position": "position", "protein_seq": "wt_aa", "alt_aa": "mt_aa"}, ["am_pathogenicity", "am_class"], how)


def with_esm(rows: DataFrame, esm: DataFrame, how: str = "left") -> DataFrame:
    return _join(rows, esm.withColumnRenamed("score", "esm_score"), {"accession": "accession", "protein_position": "position", "alt_aa": "mt_aa"}, ["esm_score"], how)


def with_conservation(rows: DataFrame, conservation: DataFrame, how: str = "left") -> DataFrame:
    keys = {"accession": "accession", "protein_position": "position", "protein_seq": "aa"}
    return _join(rows, conservation.withColumnRenamed("score", "conservation"), keys, ["conservation"], how)


def popeve_by_accession(popeve: DataFrame, refseq: DataFrame) -> DataFrame:
    """popEVE keyed by accession; an accession with several RefSeq ids has the most severe (least) score, so rows never multiply."""
    return least_popeve(popeve.join(refseq.select(F.col("refseq_acc").alias("refseq_protein"), F.col("uniprot_acc").alias("accession")).distinct(), "refseq_protein"))


def least_popeve(rows: DataFrame) -> DataFrame:
    """The most severe (least) score of each change of an accession."""
    return rows.groupBy("accession", "position", "wt_aa", "mt_aa").agg(F.min("popeve").alias("popeve"))


def accession_links(refseq: DataFrame) -> DataFrame:
    """(accession, of): accessions that share a RefSeq id, each with itself too, once a pair."""
    ids = refseq.select("refseq_acc", "uniprot_acc").dropna().distinct()
    return ids.withColumnRenamed("uniprot_acc", "accession").join(ids.withColumnRenamed("uniprot_acc", "of"), "refseq_acc").select("accession", "of").distinct()


def with_popeve(rows: DataFrame, by_accession: DataFrame, how: str = "left") -> DataFrame:
    """Adds popeve from the table keyed by accession, written once with a release or derived by the catalog."""
    keys = {"accession": "accession", "protein_position": "position", "protein_seq": "wt_aa", "alt_aa": "mt_aa"}
    return _join(rows, by_accession, keys, ["popeve"], how)


def with_stability(rows: DataFrame, foldx: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows with a stability prediction (that keep accepts): a semi join, so fragments never multiply rows."""
    found = foldx if keep is None else foldx.filter(keep)
    return _join(rows, found, {"accession": "protein_acc", "protein_position": "position", "alt_aa": "mutated_type"}, [], "left_semi")
