"""Parsing of variant strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar as g
from ..functions.codon import coding_to_protein
from ..functions.codon import consequence as consequence_of
from ..functions.scalars import identifier_type, normalize_chromosome
from ..operators import variants as var
from . import query

#: Lines are made from variants, by their position in one of twelve spellings: the SQL takes what they were made of, and parses nothing.
_MADE = "(SELECT * FROM {variants} WHERE is_canonical AND alt_allele = CASE WHEN allele = 'A' THEN 'T' ELSE 'A' END)"
_SPELLED = ["GNOMAD", "VCF", "INTERNAL_GENOMIC", "INTERNAL_GENOMIC", "INTERNAL_PROTEIN", "INTERNAL_PROTEIN", "DBSNP", "HGVS_GENOMIC", "HGVS_CODING", "HGVS_PROTEIN", "", "INVALID"]
_FORMAT = "CASE {0} % 12 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(_SPELLED) if name) + " END"


def _sql(columns: str, *spelled: str) -> str:
    """The columns, of the variants whose lines are spelled so."""
    kinds = ", ".join(str(k) for k, name in enumerate(_SPELLED) if name in spelled)
    return f"SELECT CAST(genomic_position AS BIGINT) AS line_no, {columns} FROM {_MADE} WHERE genomic_position % 12 IN ({kinds})"


def _parsed(t):
    lines = t["input_lines"].filter(~F.col("line").startswith("#")).select("line_no", F.trim("line").alias("line"))
    return lines.withColumn("v", g.parse_variant(F.col("line"))).select("line_no", "line", "v.*")


@query(f"SELECT line_no, line, {_FORMAT.format('line_no')} AS format FROM {{input_lines}} WHERE line_no % 12 <> 10 AND line IS NOT NULL")
def parse_variant_format(t):
    return _parsed(t).select("line_no", "line", "format")


_CHANGE = "upper(allele) AS ref, upper(alt_allele) AS alt"
_AMINO_ACIDS = "upper(protein_seq) AS ref_aa, upper(alt_aa) AS alt_aa"


@query(_sql(f"{_FORMAT.format('genomic_position')} AS format, chromosome AS chr, genomic_position AS pos, {_CHANGE}", "GNOMAD", "VCF", "INTERNAL_GENOMIC"))
def parse_genomic(t):
    rows = _parsed(t).filter(F.col("format").isin("GNOMAD", "VCF", "INTERNAL_GENOMIC"))
    return rows.select("line_no", "format", "chr", "pos", "ref", "alt")


@query(_sql(f"upper(accession) AS acc, protein_position AS aa_pos, {_AMINO_ACIDS}", "INTERNAL_PROTEIN") + " AND protein_seq IS NOT NULL AND alt_aa IS NOT NULL")
def parse_protein(t):
    rows = _parsed(t).filter("format = 'INTERNAL_PROTEIN' AND size(messages) = 0")
    return rows.select("line_no", "acc", "aa_pos", "ref_aa", "alt_aa")


@query(_sql(f"'1' AS chr, 'NC_000001.11' AS refseq_id, genomic_position AS pos, {_CHANGE}", "HGVS_GENOMIC"))
def parse_hgvs_g(t):
    return _parsed(t).filter("format = 'HGVS_GENOMIC'").select("line_no", "chr", "refseq_id", "pos", "ref", "alt")


@query(_sql(f"'NM_000001.1' AS refseq_id, 'GENE1' AS gene_symbol, protein_position AS pos, {_CHANGE}", "HGVS_CODING"))
def parse_hgvs_c(t):
    return _parsed(t).filter("format = 'HGVS_CODING'").select("line_no", "refseq_id", "gene_symbol", "pos", "ref", "alt")


@query(_sql(f"'NP_000001.1' AS refseq_id, protein_position AS aa_pos, {_AMINO_ACIDS}", "HGVS_PROTEIN") + " AND protein_seq IS NOT NULL AND alt_aa IS NOT NULL")
def parse_hgvs_p(t):
    return _parsed(t).filter("format = 'HGVS_PROTEIN'").select("line_no", "refseq_id", "aa_pos", "ref_aa", "alt_aa")


@query(_sql("'DBSNP' AS format, true AS valid", "DBSNP"))
def parse_variant_ids(t):
    rows = _parsed(t).filter(F.col("format").isin("DBSNP", "CLINVAR", "COSMIC"))
    return rows.select("line_no", "format", (F.size("messages") == 0).alias("valid"))


_NAMES = """(SELECT accession AS id FROM {uniprot_entry} UNION SELECT pdb_id FROM {structure} UNION SELECT ensg FROM {mapping} UNION SELECT gene_name FROM {mapping} UNION SELECT refseq_acc FROM {uniprot_refseq} UNION SELECT id FROM {dbsnp})"""


@query(f"""SELECT id, CASE WHEN id LIKE 'ENSG%' THEN 'ensembl' WHEN regexp_matches(id, '^[0-9][A-Za-z0-9]{{3}}$') THEN 'pdb' WHEN regexp_matches(id, '^P[0-9]{{5}}$') THEN 'uniprot' WHEN id LIKE 'rs%' THEN NULL WHEN id LIKE 'NP%' THEN 'refseq' WHEN id LIKE 'GENE%' THEN 'gene' END AS type FROM {_NAMES}""")
def identifier_autodetect(t):
    """The type of every identifier that the tables hold."""
    parts = [t["uniprot_entry"].select("accession"), t["structure"].select("pdb_id"), t["mapping"].select("ensg"), t["mapping"].select("gene_name"), t["uniprot_refseq"].select("refseq_acc"), t["dbsnp"].select("id")]
    ids = parts[0].toDF("id")
    for p in parts[1:]:
        ids = ids.union(p.toDF("id"))
    variant = g.parse_variant(F.col("id"))["format"] != "INVALID"
    return ids.distinct().select("id", identifier_type(F.col("id"), variant).alias("type"))


@query("SELECT DISTINCT chromosome, CASE CAST(chromosome AS INT) % 3 WHEN 0 THEN 'chr0' || chromosome WHEN 1 THEN 'CHR' || chromosome ELSE '000' || chromosome END AS spelled, chromosome AS normal FROM {mapping}")
def chr_normalize(t):
    code = F.col("chromosome").cast("int") % 3
    spelled = F.when(code == 0, F.concat(F.lit("chr0"), "chromosome")).when(code == 1, F.concat(F.lit("CHR"), "chromosome")).otherwise(F.concat(F.lit("000"), "chromosome"))
    rows = t["mapping"].select("chromosome").distinct().withColumn("spelled", spelled)
    return rows.withColumn("normal", normalize_chromosome(F.col("spelled")))


@query("SELECT l_orderkey, l_linenumber, l_orderkey AS coding_pos, CAST((l_orderkey + 2) // 3 AS INT) AS protein_pos, CAST((l_orderkey - 1) % 3 + 1 AS INT) AS codon_pos FROM {lineitem} WHERE l_orderkey >= 1")
def cdna_to_protein(t):
    protein, codon = coding_to_protein(F.col("l_orderkey"))
    return t["lineitem"].filter("l_orderkey >= 1").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("coding_pos"), protein.alias("protein_pos"), codon.alias("codon_pos"))


@query("SELECT CASE WHEN alt_aa = protein_seq THEN 'synonymous' WHEN alt_aa = '*' THEN 'stop gained' ELSE 'missense' END AS consequence, count(*) AS n FROM {variants} GROUP BY 1")
def consequence(t):
    rows = var.expand(t["mapping"])
    return rows.groupBy(consequence_of(F.col("protein_seq"), F.col("alt_aa")).alias("consequence")).agg(F.count("*").alias("n"))
