"""Browsing by identifiers, and the strategies of requests without them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import browse as plan
from ..plans.browse import Request
from ..plans.lines import resolve_lines
from ..sources.catalog import Catalog
from ..sources.schemas import IdentifierType as I
from . import query

KEY = ["chromosome", "genomic_position", "allele", "alt_allele", "accession", "protein_position"]
_V = "v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession, v.protein_position"


def _browse(t, ids, **more):
    return plan.browse(t, Request(ids=ids, **more).validate()).select(*KEY).distinct()


def _of(where: str) -> str:
    return f"SELECT DISTINCT {_V} FROM {{variants}} v WHERE {where}"


@query(_of("v.accession = 'P00010'"))
def browse_uniprot(t):
    return _browse(t, [(I.UNIPROT, "p00010")])


@query(_of("v.accession = 'P00010' AND v.protein_position BETWEEN 2000 AND 9000"))
def browse_uniprot_range(t):
    return _browse(t, [(I.UNIPROT, "P00010")], positions=(9000, 2000))


@query(_of("v.gene_name = 'GENE7'"))
def browse_gene(t):
    return _browse(t, [(I.GENE, "GENE7")])


@query(_of("v.gene_name IN ('GENE7', 'GENE8', 'GENE31')"))
def browse_gene_multi(t):
    return _browse(t, [(I.GENE, "GENE7"), (I.GENE, "gene8"), (I.GENE, "GENE31")])


@query(f"""SELECT DISTINCT {_V} FROM {{variants}} v JOIN {{cadd}} c ON c.chromosome = v.chromosome AND c.position = v.genomic_position AND c.reference_allele = v.allele AND c.alt_allele = v.alt_allele
 JOIN {{alphamissense}} a ON a.accession = v.accession AND a.position = v.protein_position AND a.wt_aa = v.protein_seq AND a.mt_aa = v.alt_aa
 WHERE v.gene_name = 'GENE7' AND c.score >= 15 AND c.score < 100 AND a.am_class = 1 AND EXISTS (SELECT 1 FROM {{mapping_dbsnp_lookup}} d WHERE d.chr = v.chromosome AND d.pos = v.genomic_position AND d.ref = v.allele AND list_contains(d.known_alts, v.alt_allele))""")
def browse_gene_filtered(t):
    bands = ["POTENTIALLY_DELETERIOUS", "QUITE_LIKELY_DELETERIOUS", "PROBABLY_DELETERIOUS", "HIGHLY_LIKELY_DELETERIOUS"]
    return _browse(t, [(I.GENE, "GENE7")], cadd=bands, am=[1], known=True)


@query(_of("EXISTS (SELECT 1 FROM {structure_regions} s WHERE s.accession = v.accession AND s.pdb_id = '4abc' AND len(list_filter(s.observed_regions, lambda r: v.protein_position BETWEEN r[1] AND r[2])) > 0)"))
def browse_pdb(t):
    return _browse(t, [(I.PDB, "4ABC")])


@query(_of("v.ensg = 'ENSG00000000007'"))
def browse_ensembl(t):
    return _browse(t, [(I.ENSEMBL, "ENSG00000000007")])


_REFSEQ = "v.accession IN (SELECT uniprot_acc FROM {uniprot_refseq} WHERE %s)"


@query(_of(_REFSEQ % "refseq_acc = 'NP_000004.2'"))
def browse_refseq_versioned(t):
    return _browse(t, [(I.REFSEQ, "NP_000004.2")])


@query(_of(_REFSEQ % "split_part(refseq_acc, '.', 1) = 'NP_000004'"))
def browse_refseq_unversioned(t):
    return _browse(t, [(I.REFSEQ, "NP_000004")])


@query(_of(_REFSEQ % "refseq_acc = 'NP_000000.1' OR split_part(refseq_acc, '.', 1) IN ('NP_000004', 'NP_000010')"))
def browse_refseq_multi(t):
    return _browse(t, [(I.REFSEQ, "NP_000000.1"), (I.REFSEQ, "NP_000004"), (I.REFSEQ, "NP_000010")])


@query(_of("v.accession = 'P00010' OR v.gene_name = 'GENE7' OR v.enst = 'ENST00000000012' OR " + _REFSEQ % "refseq_acc = 'NP_000004.2'"))
def browse_multi_identifier(t):
    return _browse(t, [(I.UNIPROT, "P00010"), (I.GENE, "GENE7"), (I.ENSEMBL, "ENST00000000012"), (I.REFSEQ, "NP_000004.2")])


@query("SELECT split_part(refseq_acc, '.', 1) AS refseq, string_agg(uniprot_acc, ',' ORDER BY uniprot_acc) AS accessions FROM {uniprot_refseq} GROUP BY 1")
def refseq_no_version_map(t):
    bare = F.split_part("refseq_acc", F.lit("."), F.lit(1)).alias("refseq")
    return t["uniprot_refseq"].groupBy(bare).agg(F.array_join(F.array_sort(F.collect_list("uniprot_acc")), ",").alias("accessions"))


@query(f"""SELECT DISTINCT {_V} FROM {{variants}} v SEMI JOIN (SELECT struct_id AS acc, unnest(pocket_resid) AS pos FROM {{pocket}} UNION SELECT a, unnest(a_residues) FROM {{interfaces}} UNION SELECT b, unnest(b_residues) FROM {{interfaces}}
 UNION SELECT accession, unnest(generate_series(unp_start, unp_end)) FROM {{structure}}) f ON f.acc = v.accession AND f.pos = v.protein_position WHERE v.is_canonical""")
def strategy2_features(t):
    """Pocket, interface or structure: any of them."""
    request = Request(pocket=True, interact=True, experimental_model=True, any_feature=True)
    return plan.browse(t, request.validate()).select(*KEY).distinct()


@query(f"SELECT DISTINCT {_V}, v.alt_aa FROM {{variants}} v JOIN {{mapping_dbsnp_lookup}} d ON d.chr = v.chromosome AND d.pos = v.genomic_position AND d.ref = v.allele AND list_contains(d.known_alts, v.alt_allele) WHERE v.is_canonical")
def strategy3_known(t):
    return plan.browse(t, Request(known=True).validate()).select(*KEY, "alt_aa").distinct()


@query(f"SELECT DISTINCT {_V}, a.af FROM {{variants}} v JOIN {{gnomad_allele_freq}} a ON a.chr = v.chromosome AND a.pos = v.genomic_position AND a.ref = v.allele AND a.alt = v.alt_allele WHERE v.is_canonical AND a.af >= 0.001 AND a.af < 0.005")
def strategy4_af(t):
    return plan.frequency_first(t, ["RARE"]).select(*KEY, "af").distinct()


@query(f"SELECT DISTINCT {_V} FROM {{variants}} v JOIN {{conserv_score}} c ON c.accession = v.accession AND c.position = v.protein_position AND c.aa = v.protein_seq WHERE v.is_canonical AND c.score >= 0.9")
def strategy4_conservation(t):
    return plan.conservation_first(t, 0.9, None).select(*KEY).distinct()



@query(f"""SELECT DISTINCT {_V}, m.am_class, e.score AS esm_score FROM {{variants}} v JOIN {{gnomad_allele_freq}} a ON a.chr = v.chromosome AND a.pos = v.genomic_position AND a.ref = v.allele AND a.alt = v.alt_allele
 JOIN {{alphamissense}} m ON m.accession = v.accession AND m.position = v.protein_position AND m.wt_aa = v.protein_seq AND m.mt_aa = v.alt_aa JOIN {{esm}} e ON e.accession = v.accession AND e.position = v.protein_position AND e.mt_aa = v.alt_aa
 WHERE v.is_canonical AND a.af >= 0.05 AND a.af < 1 AND m.am_class = 1 AND e.score >= -20""")
def strategy4_af_with_scores(t):
    """Frequencies lead, scores of the protein filter: the alternate amino acid is made on the way."""
    request = Request(allele_frequency=["COMMON"], am=["PATHOGENIC"], esm1b=(-20, None))
    return plan.browse(t, request).select(*KEY, "am_class", "esm_score").distinct()


@query(_of("v.accession = 'P00010' OR v.gene_name = 'GENE7'"))
def browse_query_text(t):
    """A query text of identifiers, the gene in another case than the release writes."""
    return plan.browse(t, Request(q="gene7, p00010\n# no line").validate()).select(*KEY).distinct()


@query(f"""SELECT DISTINCT {_V} FROM {{variants}} v SEMI JOIN (SELECT chromosome, genomic_position, allele, alt_allele FROM {{variants}} WHERE is_canonical AND genomic_position % 12 = 0 AND alt_allele = CASE WHEN allele = 'A' THEN 'T' ELSE 'A' END) u
 ON u.chromosome = v.chromosome AND u.genomic_position = v.genomic_position AND u.allele = v.allele AND u.alt_allele = v.alt_allele""")
def browse_stored_upload(t):
    """The variants of a stored upload, here the lines of one notation; another upload beside it stays out."""
    lines = t["input_lines"].select(F.when(F.col("line_no") % 12 == 0, "5f2b").otherwise("77aa").alias("upload_id"), "line_no", "line")
    stored = Catalog(t.spark, t.directory, {**t.given, "uploads": lines})
    return plan.browse(stored, Request(result_id="5f2b").validate()).select(*KEY).distinct()


@query("SELECT DISTINCT v.chromosome, v.genomic_position, v.allele, v.alt_allele FROM {variants} v JOIN {crossmap} c ON c.chr = v.chromosome AND c.grch38_pos = v.genomic_position AND c.grch38_base = v.allele")
def resolve_assembly_auto(t):
    """Lines on GRCh37 with no assembly named: it is found from a sample, and the lines are lifted."""
    lines = t["crossmap"].select(F.monotonically_increasing_id().alias("line_no"), F.concat_ws(" ", "chr", F.col("grch37_pos").cast("string"), "grch37_base").alias("line"))
    return resolve_lines(lines, t, None).select("chromosome", "genomic_position", "allele", "alt_allele").distinct()
