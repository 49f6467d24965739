"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import POPEVE_BANDS

#: Fixed words for the mitochondrial chromosome.
MITOCHONDRIAL = ["m", "mt", "mit", "mtdna", "mitochondria", "mitochondrion"]


def normalize_chromosome(name: Column) -> Column:
    """1 to 22, X, Y or MT from any usual spelling; null for others."""
    usual = [*map(str, range(1, 23)), "X", "Y", "MT"]
    bare = F.regexp_replace(F.lower(name), "^chr", "")
    number = F.when(bare.rlike("^[0-9]{1,9}$"), bare.cast("int"))
    return F.when(name.isin(usual), name).when(bare.isin(MITOCHONDRIAL), "MT").when(bare.isin("x", "y"), F.upper(bare)).when(number.between(1, 22), number.cast("string"))


def popeve_class(score: Column) -> Column:
    """The band of a score, from the open-ended bands of the schema."""
    found = F.when(score.isNull(), None)
    for name, (_, high) in POPEVE_BANDS.items():
        found = found.when(score < high, name) if high is not None else found.otherwise(name)
    return found


def or_na(value: Column) -> Column:
    return F.when(value.isNull() | (value.cast("string") == ""), "N/A").otherwise(value.cast("string"))


def upper_first(text: Column) -> Column:
    """First letter upper case, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def versioned(identifier: Column, version: Column) -> Column:
    return F.concat(F.coalesce(identifier, F.lit("")), F.lit("."), F.coalesce(version, F.lit("")))


def ranges(positions: Column) -> Column:
    """Sorted distinct positions as runs, like ``1-3 7 9-10``."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    runs = F.aggregate(
        F.array_sort(F.array_distinct(positions)),
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] == x - 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), x.cast("int").alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.cast("int").alias("s"), x.cast("int").alias("e"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["s"] == r["e"], r["s"].cast("string")).otherwise(F.concat(r["s"].cast("string"), F.lit("-"), r["e"].cast("string")))), " ")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays of numbers, in doubles."""
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Fixed patterns, tried in this order.
ENSEMBL = r"(?i)^ENS[GTPE]\d{11}(\.\d+)?$"
PDB = r"^[0-9][A-Za-z0-9]{3}$"
UNIPROT = r"(?i)^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z]([0-9][A-Z][A-Z0-9]{2}){1,2}[0-9])(-[1-9][0-9]*)?$"
REFSEQ = r"(?i)^(NC|NM|NP|NG|LRG|NR)_\d{6,}(\.\d+)?$"
GENE = r"^[A-Za-z][A-Za-z0-9\-_]{1,19}$"
VARIANT_PREFIX = r"(?i)^(rs|RCV|VCV|COS[VMN]|NC_|NM_|NP_|chr)"
RESULT_ID = r"^[a-fA-F0-9]{32}$"


def identifier_type(text: Column, is_variant: Column) -> Column:
    """uniprot, gene, pdb, ensembl or refseq; null for variants, result ids and what no pattern fits."""
    t = F.trim(text)
    kind = F.when(t.rlike(RESULT_ID), None).when(t.rlike(ENSEMBL), "ensembl").when(t.rlike(PDB), "pdb").when(t.rlike(UNIPROT), "uniprot").when(is_variant, None)
    return kind.when(t.rlike(REFSEQ), "refseq").when(t.rlike(GENE) & ~t.rlike(VARIANT_PREFIX), "gene")
