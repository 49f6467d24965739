"""Joins to scores, and lookups by lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as var
from ..plans.annotate import scores_long
from ..plans.resolve import ids_to_variants
from . import query

KEY = ["chromosome", "genomic_position", "allele", "alt_allele", "accession"]
_V = "v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession"


@query("SELECT c.chromosome, c.position, c.reference_allele, c.alt_allele, c.score FROM {cadd} c SEMI JOIN {dbsnp} d ON d.chr = c.chromosome AND d.pos = c.position")
def batch_cadd(t):
    wanted = t["dbsnp"].select(F.col("chr").alias("chromosome"), F.col("pos").alias("position"))
    return t["cadd"].join(wanted, ["chromosome", "position"], "left_semi").select("chromosome", "position", "reference_allele", "alt_allele", "score")


@query("SELECT a.chr, a.pos, a.ref, a.alt, a.af FROM {gnomad_allele_freq} a SEMI JOIN {dbsnp} d ON d.chr = a.chr AND d.pos = a.pos")
def batch_allele_freq(t):
    return t["gnomad_allele_freq"].join(t["dbsnp"].select("chr", "pos"), ["chr", "pos"], "left_semi").select("chr", "pos", "ref", "alt", "af")


@query(f"SELECT {_V}, c.score AS cadd_score FROM {{variants}} v LEFT JOIN {{cadd}} c ON c.chromosome = v.chromosome AND c.position = v.genomic_position AND c.reference_allele = v.allele AND c.alt_allele = v.alt_allele")
def join_cadd_left(t):
    return var.with_cadd(var.expand(t["mapping"]), t["cadd"]).select(*KEY, "cadd_score")


@query(f"SELECT {_V}, a.am_pathogenicity, CAST(a.am_class AS DOUBLE) AS am_class FROM {{variants}} v LEFT JOIN {{alphamissense}} a ON a.accession = v.accession AND a.position = v.protein_position AND a.wt_aa = v.protein_seq AND a.mt_aa = v.alt_aa")
def join_am_left(t):
    return var.with_alphamissense(var.expand(t["mapping"]), t["alphamissense"]).select(*KEY, "am_pathogenicity", F.col("am_class").cast("double").alias("am_class"))


@query(f"SELECT {_V}, min(p.popeve) AS popeve FROM {{variants}} v LEFT JOIN {{uniprot_refseq}} r ON r.uniprot_acc = v.accession LEFT JOIN {{popeve}} p ON p.refseq_protein = r.refseq_acc AND p.position = v.protein_position AND p.wt_aa = v.protein_seq AND p.mt_aa = v.alt_aa GROUP BY ALL")
def join_popeve_twohop(t):
    return var.with_popeve(var.expand(t["mapping"]), t["popeve_by_accession"]).select(*KEY, "popeve")


@query(f"SELECT {_V}, e.score AS esm_score FROM {{variants}} v LEFT JOIN {{esm}} e ON e.accession = v.accession AND e.position = v.protein_position AND e.mt_aa = v.alt_aa")
def join_esm_left(t):
    return var.with_esm(var.expand(t["mapping"]), t["esm"]).select(*KEY, "esm_score")


@query("""SELECT DISTINCT p.accession, p.position, i.a, i.b, i.pdockq FROM {population} p JOIN {interfaces} i ON (i.a = p.accession AND list_contains(i.a_residues, p.position)) OR (i.b = p.accession AND list_contains(i.b_residues, p.position))""")
def batch_interactions(t):
    """The OR of two sides as a union of two equi-joins on exploded residues."""
    wanted = t["population"].select("accession", "position").distinct()
    side = lambda who, residues: t["interfaces"].select(F.col(who).alias("accession"), F.explode(residues).alias("position"), "a", "b", "pdockq")
    return wanted.join(side("a", "a_residues").union(side("b", "b_residues")).distinct(), ["accession", "position"])


_LONG = """SELECT 'CONSERV' AS score_type, accession, position, CAST(NULL AS VARCHAR) AS mt_aa, score, CAST(NULL AS VARCHAR) AS class FROM {conserv_score}
 UNION ALL SELECT 'EVE', accession, position, mt_aa, score, CAST(class AS VARCHAR) FROM {eve_score}
 UNION ALL SELECT 'ESM', accession, position, mt_aa, score, NULL FROM {esm}
 UNION ALL SELECT 'AM', accession, position, mt_aa, am_pathogenicity, CAST(am_class AS VARCHAR) FROM {alphamissense}
 UNION ALL SELECT 'POPEVE', r.uniprot_acc, p.position, p.mt_aa, min(p.popeve), NULL FROM {popeve} p JOIN {uniprot_refseq} r ON r.refseq_acc = p.refseq_protein GROUP BY r.uniprot_acc, p.position, p.wt_aa, p.mt_aa
 UNION ALL SELECT 'M3D', uniprot_id, pos, mut, NULL, prediction FROM {m3d}"""


@query(f"SELECT s.* FROM ({_LONG}) s SEMI JOIN {{population}} p ON p.accession = s.accession AND p.position = s.position")
def batch_scores_long(t):
    return scores_long(t, t["population"].select("accession", "position")).select("score_type", "accession", "position", "mt_aa", "score", "class")


@query(f"SELECT s.score_type, s.mt_aa, s.score, s.class FROM ({_LONG}) s WHERE s.accession = 'P00000' AND s.position = 10206")
def scores_at_position(t):
    return scores_long(t).filter("accession = 'P00000' AND position = 10206").select("score_type", "mt_aa", "score", "class")


@query(f"SELECT s.accession, s.score_type, count(*) AS n, min(s.score) AS low, max(s.score) AS high FROM ({_LONG}) s GROUP BY 1, 2")
def scores_by_accession(t):
    return scores_long(t).groupBy("accession", "score_type").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("SELECT p.accession, p.position, k.pocket_id, k.pocket_score_combined_scaled AS score FROM (SELECT DISTINCT accession, position FROM {population}) p JOIN {pocket} k ON k.struct_id = p.accession AND list_contains(k.pocket_resid, p.position)")
def batch_pockets(t):
    held = t["pocket"].select(F.col("struct_id").alias("accession"), F.explode(F.array_distinct("pocket_resid")).alias("position"), "pocket_id", F.col("pocket_score_combined_scaled").alias("score"))
    return held.join(t["population"].select("accession", "position").distinct(), ["accession", "position"])


@query("SELECT f.protein_acc, f.position, f.af_id, f.mutated_type, f.foldx_ddg, f.plddt FROM {foldx} f SEMI JOIN {population} p ON p.accession = f.protein_acc AND p.position = f.position")
def batch_foldx(t):
    wanted = t["population"].select(F.col("accession").alias("protein_acc"), "position")
    return t["foldx"].join(wanted, ["protein_acc", "position"], "left_semi").select("protein_acc", "position", "af_id", "mutated_type", "foldx_ddg", "plddt")


@query("SELECT p.accession, p.position, p.disease, p.clin_sig FROM {population} p SEMI JOIN {mapping} m ON m.accession = p.accession AND m.protein_position = p.position")
def batch_population(t):
    wanted = t["mapping"].select("accession", F.col("protein_position").alias("position"))
    return t["population"].join(wanted, ["accession", "position"], "left_semi").select("accession", "position", "disease", "clin_sig")


def _lookup(t, lines):
    return ids_to_variants(lines, t["dbsnp"], t["clinvar_extended"], t["cosmic"])


@query("SELECT DISTINCT upper(d.id) AS input, d.chr, d.pos, d.ref, unnest(string_split(d.alt, ',')) AS alt FROM {dbsnp} d")
def dbsnp_id_lookup(t):
    return _lookup(t, t["dbsnp"].select(F.upper("id").alias("id")).distinct())


@query("SELECT DISTINCT lower(c.vcv) AS input, c.chr, c.pos, c.ref, c.alt FROM {clinvar_extended} c")
def clinvar_vcv_lookup(t):
    """Ids in lower case: they are upper-cased once."""
    return _lookup(t, t["clinvar_extended"].select(F.lower("vcv").alias("id")).distinct())


@query("SELECT DISTINCT x.rcv AS input, c.chr, c.pos, c.ref, c.alt FROM (SELECT DISTINCT rcvs[1] AS rcv FROM {clinvar_extended}) x JOIN {clinvar_extended} c ON list_contains(c.rcvs, x.rcv)")
def clinvar_rcv_lookup(t):
    return _lookup(t, t["clinvar_extended"].select(F.col("rcvs")[0].alias("id")).distinct())


@query("SELECT DISTINCT x.id AS input, c.chr, c.pos, c.ref, c.alt FROM (SELECT DISTINCT legacy_id AS id FROM {cosmic} UNION SELECT id FROM {cosmic}) x JOIN {cosmic} c ON c.id = x.id OR c.legacy_id = x.id")
def cosmic_lookup(t):
    both = t["cosmic"].select("legacy_id").union(t["cosmic"].select("id")).distinct()
    return _lookup(t, both.select(F.col("legacy_id").alias("id")))
