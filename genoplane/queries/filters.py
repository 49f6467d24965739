"""Filters on variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import popeve_class as popeve_class_of
from ..operators import filters as flt
from ..operators import variants as var
from ..plans.browse import Request, browse
from ..sources import schemas
from ..sources.schemas import IdentifierType
from . import query

KEY = ["chromosome", "genomic_position", "allele", "alt_allele", "accession", "alt_aa"]
_V = "v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession, v.alt_aa"


def _all(t):
    return var.expand(t["mapping"])


@query(f"""SELECT DISTINCT {_V}, c.score AS cadd_score FROM {{variants}} v JOIN {{cadd}} c ON c.chromosome = v.chromosome AND c.position = v.genomic_position AND c.reference_allele = v.allele AND c.alt_allele = v.alt_allele
 WHERE v.gene_name = 'GENE7' AND v.is_canonical AND ((c.score >= 15 AND c.score < 20) OR (c.score >= 25 AND c.score < 30))""")
def filter_cadd_bands(t):
    """The variants of a gene in two CADD bands."""
    request = Request(ids=[(IdentifierType.GENE, "GENE7")], cadd=["POTENTIALLY_DELETERIOUS", "PROBABLY_DELETERIOUS"], canonical_only=True)
    return browse(t, request.validate()).select(*KEY, "cadd_score").distinct()


@query(f"""SELECT {_V}, a.af FROM {{variants}} v JOIN {{gnomad_allele_freq}} a ON a.chr = v.chromosome AND a.pos = v.genomic_position AND a.ref = v.allele AND a.alt = v.alt_allele
 WHERE (a.af >= 0 AND a.af < 0.001) OR (a.af >= 0.05 AND a.af < 1)""")
def filter_af_bands(t):
    return var.with_frequency(_all(t), t["gnomad_allele_freq"], "inner").filter(flt.in_bands(F.col("af"), ["VERY_RARE", "COMMON"], schemas.FREQUENCY_BANDS)).select(*KEY, "af")


@query(f"""SELECT {_V}, p.popeve FROM {{variants}} v LEFT JOIN (SELECT r.uniprot_acc, e.position, e.wt_aa, e.mt_aa, min(e.popeve) AS popeve FROM {{popeve}} e JOIN {{uniprot_refseq}} r ON r.refseq_acc = e.refseq_protein GROUP BY ALL) p
 ON p.uniprot_acc = v.accession AND p.position = v.protein_position AND p.wt_aa = v.protein_seq AND p.mt_aa = v.alt_aa WHERE p.popeve < -5.056 OR p.popeve >= -4.617""")
def filter_popeve_bands(t):
    rows = var.with_popeve(_all(t), t["popeve_by_accession"], "inner")
    return rows.filter(flt.in_bands(F.col("popeve"), ["SEVERE", "UNLIKELY_DELETERIOUS"], schemas.POPEVE_BANDS)).select(*KEY, "popeve")


_AM = "{alphamissense} a ON a.accession = v.accession AND a.position = v.protein_position AND a.wt_aa = v.protein_seq AND a.mt_aa = v.alt_aa"


@query(f"SELECT {_V}, a.am_class FROM {{variants}} v JOIN {_AM} WHERE a.am_class IN (-1, 1)")
def filter_am_class(t):
    return var.with_alphamissense(_all(t), t["alphamissense"], "inner").filter(F.col("am_class").isin(-1, 1)).select(*KEY, "am_class")


@query(f"SELECT {_V}, CAST(a.am_class AS DOUBLE) AS am_class FROM {{variants}} v LEFT JOIN {_AM} WHERE a.am_class = 0 OR a.am_class IS NULL")
def filter_am_class_or_null(t):
    return var.with_alphamissense(_all(t), t["alphamissense"]).filter((F.col("am_class") == 0) | F.col("am_class").isNull()).select(*KEY, F.col("am_class").cast("double").alias("am_class"))


@query(f"SELECT {_V}, c.score AS conservation FROM {{variants}} v JOIN {{conserv_score}} c ON c.accession = v.accession AND c.position = v.protein_position AND c.aa = v.protein_seq WHERE c.score >= 0.25 AND c.score <= 0.75")
def filter_conservation(t):
    return var.with_conservation(_all(t), t["conserv_score"], "inner").filter(flt.in_range(F.col("conservation"), 0.25, 0.75)).select(*KEY, "conservation")


@query(f"SELECT {_V}, e.score AS esm_score FROM {{variants}} v JOIN {{esm}} e ON e.accession = v.accession AND e.position = v.protein_position AND e.mt_aa = v.alt_aa WHERE e.score <= -7.5")
def filter_esm1b(t):
    return var.with_esm(_all(t), t["esm"], "inner").filter(flt.in_range(F.col("esm_score"), None, -7.5)).select(*KEY, "esm_score")


@query(f"SELECT {_V} FROM {{variants}} v LEFT JOIN (SELECT protein_acc, position, mutated_type, max(foldx_ddg) AS ddg FROM {{foldx}} GROUP BY 1, 2, 3) f ON f.protein_acc = v.accession AND f.position = v.protein_position AND f.mutated_type = v.alt_aa WHERE f.ddg >= 2")
def filter_stability(t):
    return var.with_stability(_all(t), t["foldx"], F.col("foldx_ddg") >= schemas.STABILITY_CUTOFF).select(*KEY)


_FEATURE = "EXISTS (SELECT 1 FROM {function_feature} f WHERE f.accession = v.accession AND f.type IN (%s) AND "


@query(
    f"SELECT {_V} FROM {{variants}} v WHERE "
    + (_FEATURE % "'DOMAIN','REGION','REPEAT','ZN_FING','DNA_BIND','COILED','MOTIF','COMPBIAS'") + "v.protein_position BETWEEN f.begin_pos AND f.end_pos) AND "
    + (_FEATURE % "'MOD_RES','LIPID','CARBOHYD','DISULFID','CROSSLNK'") + "CASE WHEN f.type = 'DISULFID' THEN v.protein_position IN (f.begin_pos, f.end_pos) ELSE v.protein_position BETWEEN f.begin_pos AND f.end_pos END)"
)
def filter_feature_groups(t):
    return flt.with_feature_groups(_all(t), t["function_feature"], ["DOMAIN", "PTM"]).select(*KEY)


@query(f"SELECT {_V} FROM {{variants}} v WHERE EXISTS (SELECT 1 FROM {{population}} p WHERE p.disease AND p.accession = v.accession AND p.position = v.protein_position)")
def filter_disease_residue(t):
    return var.expand(flt.at_positions(t["mapping"], flt.disease_positions(t["population"]))).select(*KEY)


@query(f"SELECT {_V} FROM {{variants}} v JOIN {{mapping_dbsnp_lookup}} d ON d.chr = v.chromosome AND d.pos = v.genomic_position AND d.ref = v.allele AND list_contains(d.known_alts, v.alt_allele)")
def filter_known_array(t):
    return flt.known_variants(_all(t), t["mapping_dbsnp_lookup"]).select(*KEY)


@query(f"SELECT {_V} FROM {{variants}} v JOIN {{dbsnp}} d ON d.chr = v.chromosome AND d.pos = v.genomic_position AND d.ref = v.allele AND list_contains(string_split(d.alt, ','), v.alt_allele)")
def filter_known_delimited(t):
    return flt.known_variants(_all(t), t["dbsnp"], F.split("alt", ",")).select(*KEY)


@query(f"SELECT {_V} FROM {{variants}} v WHERE EXISTS (SELECT 1 FROM {{pocket}} p WHERE p.struct_id = v.accession AND list_contains(p.pocket_resid, v.protein_position))")
def filter_pocket(t):
    return flt.at_positions(_all(t), flt.pocket_positions(t["pocket"])).select(*KEY)


@query(f"""SELECT {_V} FROM {{variants}} v SEMI JOIN (SELECT a AS acc, unnest(a_residues) AS pos FROM {{interfaces}} UNION SELECT b, unnest(b_residues) FROM {{interfaces}}) i ON i.acc = v.accession AND i.pos = v.protein_position""")
def filter_interact(t):
    return var.expand(flt.at_positions(t["mapping"], flt.interface_positions(t["interfaces"]))).select(*KEY)


@query(f"SELECT {_V} FROM {{variants}} v WHERE EXISTS (SELECT 1 FROM {{structure}} s WHERE s.accession = v.accession AND v.protein_position BETWEEN s.unp_start AND s.unp_end)")
def filter_experimental_model(t):
    return var.expand(flt.in_structures(t["mapping"], t["structure"])).select(*KEY)


@query("SELECT struct_id, pocket_id, pocket_score_combined_scaled AS score FROM {pocket} WHERE struct_id = 'P00000' AND list_contains(pocket_resid, 3751)")
def pocket_point(t):
    found = t["pocket"].filter((F.col("struct_id") == "P00000") & F.array_contains("pocket_resid", 3751))
    return found.select("struct_id", "pocket_id", F.col("pocket_score_combined_scaled").alias("score")).orderBy(F.desc("score"), "pocket_id")


@query("SELECT a, b, pdockq FROM {interfaces} WHERE (a = 'P00000' AND list_contains(a_residues, 3752)) OR (b = 'P00000' AND list_contains(b_residues, 3752))")
def interaction_point(t):
    side = lambda who, residues: t["interfaces"].filter((F.col(who) == "P00000") & F.array_contains(residues, 3752))
    return side("a", "a_residues").union(side("b", "b_residues")).distinct().select("a", "b", "pdockq")


@query("SELECT m.accession, m.protein_position, s.pdb_id, s.chain_id FROM (SELECT DISTINCT accession, protein_position FROM {mapping}) m JOIN {structure_regions} s ON s.accession = m.accession AND len(list_filter(s.observed_regions, lambda r: m.protein_position BETWEEN r[1] AND r[2])) > 0")
def structure_observed_filter(t):
    positions = t["mapping"].select("accession", "protein_position").distinct()
    rows = positions.join(t["structure_regions"], "accession").filter(flt.in_regions(F.col("protein_position"), F.col("observed_regions")))
    return rows.select("accession", "protein_position", "pdb_id", "chain_id")


@query("SELECT chr, pos, ref, alt, ac, an, af FROM {gnomad_allele_freq} WHERE chr = '5' AND pos = 145 AND alt = 'G'")
def allele_freq_point(t):
    return t["gnomad_allele_freq"].filter((F.col("chr") == "5") & (F.col("pos") == 145) & (F.col("alt") == "G")).select("chr", "pos", "ref", "alt", "ac", "an", "af")


@query("SELECT p_partkey, array_to_string(list_filter([p_brand, p_type, 'InterPro', 'Pfam', 'CATH'], lambda x: x IN ('InterPro', 'Pfam', 'CATH')), ',') AS refs FROM {part}")
def filter_db_references(t):
    """Of an array of cross references, those of three databases."""
    refs = F.array("p_brand", "p_type", F.lit("InterPro"), F.lit("Pfam"), F.lit("CATH"))
    return t["part"].select("p_partkey", F.array_join(F.filter(refs, lambda x: x.isin("InterPro", "Pfam", "CATH")), ",").alias("refs"))


@query("""SELECT accession, array_to_string(list_sort(list(CASE WHEN begin_pos = end_pos THEN lpad(CAST(feature_index AS VARCHAR), 12, '0') END) FILTER (begin_pos = end_pos)), ',') AS residues,
 array_to_string(list_sort(list(lpad(CAST(feature_index AS VARCHAR), 12, '0')) FILTER (begin_pos <> end_pos)), ',') AS regions FROM {function_feature} GROUP BY accession""")
def feature_residue_region(t):
    """Features at one residue apart from those over a region."""
    name = F.lpad(F.col("feature_index").cast("string"), 12, "0")
    grouped = t["function_feature"].groupBy("accession").agg(F.collect_list(F.struct("begin_pos", "end_pos", name.alias("name"))).alias("all"))
    pick = lambda test: F.array_join(F.sort_array(F.transform(F.filter("all", test), lambda x: x["name"])), ",")
    none = lambda c: F.when(c != "", c)
    return grouped.select("accession", none(pick(lambda x: x["begin_pos"] == x["end_pos"])).alias("residues"), none(pick(lambda x: x["begin_pos"] != x["end_pos"])).alias("regions"))


@query("SELECT v.chromosome, v.genomic_position, v.alt_allele, p.popeve, CASE WHEN p.popeve < -5.056 THEN 'SEVERE' WHEN p.popeve < -4.617 THEN 'MODERATELY_DELETERIOUS' WHEN p.popeve IS NOT NULL THEN 'UNLIKELY_DELETERIOUS' END AS class FROM {variants} v LEFT JOIN (SELECT r.uniprot_acc, e.position, e.wt_aa, e.mt_aa, min(e.popeve) AS popeve FROM {popeve} e JOIN {uniprot_refseq} r ON r.refseq_acc = e.refseq_protein GROUP BY ALL) p ON p.uniprot_acc = v.accession AND p.position = v.protein_position AND p.wt_aa = v.protein_seq AND p.mt_aa = v.alt_aa WHERE p.popeve IS NOT NULL")
def popeve_class(t):
    rows = var.with_popeve(_all(t), t["popeve_by_accession"], "inner")
    return rows.select("chromosome", "genomic_position", "alt_allele", "popeve", popeve_class_of(F.col("popeve")).alias("class"))
