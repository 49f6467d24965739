"""The variant grammar, case by case."""

import pytest
from pyspark.sql import functions as F

from genoplane.functions import grammar as g
from genoplane.functions.scalars import identifier_type, normalize_chromosome, ranges, upper_first

CASES = [
    ("chr01 12345", "INTERNAL_GENOMIC", {"chr": "1", "pos": 12345, "ref": None}),
    ("00022 999999", "INTERNAL_GENOMIC", {"chr": "22", "pos": 999999}),
    ("mitochondria:302", "INTERNAL_GENOMIC", {"chr": "MT", "pos": 302}),
    ("1 000456 . T A", "VCF", {"chr": "1", "pos": 456, "vcf_id": ".", "ref": "T", "alt": "A"}),
    ("MT 16569 m.16569A>G A G", "VCF", {"chr": "MT", "vcf_id": "m.16569A>G"}),
    ("chr1 12345 A/T", "INTERNAL_GENOMIC", {"ref": "A", "alt": "T"}),
    ("chr1 12345 a>t", "INTERNAL_GENOMIC", {"ref": "A", "alt": "T"}),
    ("x:12345:a:T", "INTERNAL_GENOMIC", {"chr": "X", "ref": "A", "alt": "T"}),
    ("1-55516888-G-T", "GNOMAD", {"chr": "1", "pos": 55516888, "ref": "G", "alt": "T"}),
    ("12 1345789 C T G", "VCF", {"vcf_id": "C", "ref": "T", "alt": "G"}),
    ("P22304 205 A/P", "INTERNAL_PROTEIN", {"acc": "P22304", "aa_pos": 205, "ref_aa": "A", "alt_aa": "P"}),
    ("p22304 p.A205P", "INTERNAL_PROTEIN", {"acc": "P22304", "aa_pos": 205, "ref_aa": "A", "alt_aa": "P"}),
    ("P22304 Ala205=", "INTERNAL_PROTEIN", {"ref_aa": "A", "alt_aa": "A"}),
    ("P22304 205 A *", "INTERNAL_PROTEIN", {"ref_aa": "A", "alt_aa": "*"}),
    ("P07949 asn783thr", "INTERNAL_PROTEIN", {"ref_aa": "N", "alt_aa": "T", "aa_pos": 783}),
    ("P22309 71", "INTERNAL_PROTEIN", {"aa_pos": 71, "ref_aa": None, "alt_aa": None}),
    ("Q9BXN1 M1?", "INTERNAL_PROTEIN", {"aa_pos": 1, "ref_aa": "M", "alt_aa": None, "alt_unknown": True}),
    ("P22304-2 205 Gly Arg", "INTERNAL_PROTEIN", {"acc": "P22304-2", "ref_aa": "G", "alt_aa": "R"}),
    ("NP_123456.1: p.(R490S)", "HGVS_PROTEIN", {"refseq_id": "NP_123456.1", "aa_pos": 490, "ref_aa": "R", "alt_aa": "S"}),
    ("NM_017547.4 (FOXRED1):c.1289A>G p.(Asn430Ser)", "HGVS_CODING", {"refseq_id": "NM_017547.4", "gene_symbol": "FOXRED1", "pos": 1289, "ref": "A", "alt": "G", "ref_aa": "Asn", "aa_pos": 430, "alt_aa": "Ser"}),
    ("NC_000001.11:g.123A>T", "HGVS_GENOMIC", {"chr": "1", "pos": 123, "ref": "A", "alt": "T", "refseq37": False}),
    ("NC_000001.10:g.123A>T", "HGVS_GENOMIC", {"chr": "1", "refseq37": True}),
    ("NC_012920.1:g.3A>C", "HGVS_GENOMIC", {"chr": "MT", "refseq37": False}),
    ("RS123456", "DBSNP", {}),
    ("vcv000012345", "CLINVAR", {}),
    ("COSM123", "COSMIC", {}),
]

WRONG = [
    ("NM_000001.1:c.-128A>G", "HGVS_CODING", "C_5UTR"),
    ("NM_000001.1:c.128+1G>A", "HGVS_CODING", "C_INTRON5"),
    ("NM_000001.1:c.128-1G>A", "HGVS_CODING", "C_INTRON3"),
    ("NM_000001.1:c.*128A>G", "HGVS_CODING", "C_3UTR"),
    ("NG_123456.1:g.123A>T", "HGVS_GENOMIC", "G_REFSEQ"),
    ("NC_000099.1:g.123A>T", "HGVS_GENOMIC", "G_CHROMOSOME"),
    ("NC_000001.11:g.123A>", "HGVS_GENOMIC", "G_CHANGE"),
    ("NP_1.1:p.R490", "HGVS_PROTEIN", "P_CHANGE"),
    ("NC_000001.11:m.123A>T", "INVALID", "SCHEME_M"),
    ("LRG_1:n.123A>T", "INVALID", "PREFIX_LRG"),
    ("RCV12345678", "CLINVAR", "CLINVAR"),
    ("rs12x", "DBSNP", "DBSNP"),
    ("COSV12b", "COSMIC", "COSMIC"),
    ("P22304 zzz", "INTERNAL_PROTEIN", "PROTEIN"),
    ("completely_invalid_format_12345", "INVALID", "UNSUPPORTED"),
    ("   ", "INVALID", "EMPTY"),
    (None, "INVALID", "EMPTY"),
    ("12 1345789 123 C/T", "INVALID", "UNSUPPORTED"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = [c[0] for c in CASES] + [w[0] for w in WRONG]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", g.parse_variant(F.col("line")).alias("v")).collect()
    return {r.line: r.v for r in rows}


@pytest.mark.parametrize("line,form,want", CASES)
def test_accepted(parsed, line, form, want):
    v = parsed[line]
    assert v.format == form and v.type == g.TYPES[form] and v.messages == []
    assert {k: v[k] for k in want} == want


@pytest.mark.parametrize("line,form,key", WRONG)
def test_messages(parsed, line, form, key):
    v = parsed[line]
    assert v.format == form and g.MESSAGES[key] in v.messages


def test_versioned_ids_are_optional(spark):
    df = spark.createDataFrame([("RCV000012345.2",)], "line string")
    assert df.select(g.parse_variant(F.col("line"))["format"]).first()[0] == "INVALID"
    v = df.select(g.parse_variant(F.col("line"), versioned_ids=True).alias("v")).first().v
    assert (v.format, v.messages) == ("CLINVAR", [])


def test_reference_sequences():
    known = g.refseq_chromosomes()
    assert len(known) == 49 and known["NC_000023.10"] == ("X", True) and known["NC_000014.9"] == ("14", False)


def test_chromosomes_and_identifiers(spark):
    names = {"chrX": "X", "CHR007": "7", "m": "MT", "mtDNA": "MT", "23": None, "0": None, "": None}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", normalize_chromosome(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names
    ids = {"ENSG00000139618.2": "ensembl", "1abc": "pdb", "P12345": "uniprot", "NM_017547.4": "refseq", "BRCA1": "gene", "rs12": None, "a" * 32: None, "x y z": None}
    rows = spark.createDataFrame([(k,) for k in ids], "n string")
    got = rows.select("n", identifier_type(F.col("n"), g.parse_variant(F.col("n"))["format"] != "INVALID").alias("t")).collect()
    assert {r.n: r.t for r in got} == ids


def test_ranges_and_case(spark):
    df = spark.createDataFrame([([3, 1, 2, 7, 10, 9, 9],), ([],), ([5],)], "p array<int>")
    assert [r[0] for r in df.select(ranges(F.col("p"))).collect()] == ["1-3 7 9-10", "", "5"]
    assert spark.range(1).select(upper_first(F.lit("hELLO wORLD"))).first()[0] == "Hello world"
