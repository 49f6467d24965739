"""Aggregates, groupwise choices, orders and pages, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grammar import parse_variant
from ..functions.scalars import ranges
from ..operators import groupwise as grp
from ..operators import variants as var
from ..operators.paging import bounded_count as bounded
from ..operators.paging import count_distinct, ordering, page, slice_lines
from ..operators.vector import nearest
from . import query

KEY = ["chromosome", "genomic_position", "allele", "alt_allele", "accession"]
_V = "v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession"
_TIES = "v.protein_position, v.codon_position, v.alt_allele, v.chromosome, v.genomic_position, v.allele, v.accession"


@query("SELECT count(*) AS n FROM (SELECT DISTINCT v.chromosome, v.genomic_position, a.am_class FROM {variants} v LEFT JOIN {alphamissense} a ON a.accession = v.accession AND a.position = v.protein_position AND a.mt_aa = v.alt_aa AND a.wt_aa = v.protein_seq)")
def count_distinct_rows(t):
    """Distinct rows, also those with a null."""
    rows = var.with_alphamissense(var.expand(t["mapping"]), t["alphamissense"])
    return rows.agg(count_distinct(["chromosome", "genomic_position", "am_class"]).alias("n"))


@query("SELECT least(count(*), 10000) AS n, count(*) > 10000 AS more FROM (SELECT 1 FROM {variants} WHERE is_canonical LIMIT 10001)")
def bounded_count(t):
    return bounded(var.expand(t["mapping"].filter("is_canonical")))


@query("SELECT s.type, s.key, s.release, s.value FROM {stats} s WHERE s.created = (SELECT max(x.created) FROM {stats} x WHERE x.key = s.key)")
def stats_latest_per_key(t):
    return grp.latest_per_key(t["stats"]).select("type", "key", "release", "value")


@query("SELECT type, key, release, value FROM {stats} WHERE release = '1' AND type = 'click' AND key = '7' ORDER BY created DESC NULLS LAST, value DESC NULLS LAST LIMIT 1")
def stats_latest_one(t):
    return grp.latest_one(t["stats"], "1", "click", "7").select("type", "key", "release", "value")


@query("SELECT struct_id AS accession, residue, string_agg(CAST(pocket_id AS VARCHAR), ',' ORDER BY score DESC, pocket_id) AS pocket_ids FROM (SELECT struct_id, pocket_id, pocket_score_combined_scaled AS score, unnest(pocket_resid) AS residue FROM {pocket}) GROUP BY 1, 2")
def pockets_by_residue(t):
    return grp.pockets_by_residue(t["pocket"]).withColumn("pocket_ids", F.array_join(F.col("pocket_ids").cast("array<string>"), ","))


@query("""SELECT accession, residue, string_agg(partner, ',' ORDER BY pdockq DESC, partner) AS partners FROM (SELECT a AS accession, unnest(a_residues) AS residue, b AS partner, pdockq FROM {interfaces}
 UNION ALL SELECT b, unnest(b_residues), a, pdockq FROM {interfaces}) GROUP BY 1, 2""")
def interactions_by_residue(t):
    return grp.interactions_by_residue(t["interfaces"]).withColumn("partners", F.array_join("partners", ","))


@query("""SELECT protein_acc, position, mutated_type, af_id, foldx_ddg, num_fragments FROM (SELECT *, row_number() OVER (PARTITION BY protein_acc, position, mutated_type ORDER BY af_id) AS rn,
 count(*) OVER (PARTITION BY protein_acc, position, mutated_type) AS num_fragments FROM {foldx}) WHERE rn = num_fragments // 2 + 1""")
def foldx_middle_fragment(t):
    return grp.foldx_middle(t["foldx"]).select("protein_acc", "position", "mutated_type", "af_id", "foldx_ddg", "num_fragments")


@query("SELECT chr, pos, alt, min_by(af, ref) AS af FROM {gnomad_allele_freq} GROUP BY chr, pos, alt")
def allele_freq_map(t):
    """One frequency for each alternate at a position: of several, that of the first reference."""
    return grp.first_by(t["gnomad_allele_freq"], ["chr", "pos", "alt"], [F.col("ref")]).select("chr", "pos", "alt", "af")


@query("""SELECT CASE WHEN line LIKE 'RS%' THEN 'VARIANT_ID' WHEN line LIKE 'NC\\_%' ESCAPE '\\' OR line LIKE 'chr%' OR regexp_matches(line, '^[0-9]') THEN 'GENOMIC' WHEN line LIKE 'NM\\_%' ESCAPE '\\' THEN 'CODING_DNA'
 WHEN line LIKE 'NP\\_%' ESCAPE '\\' OR lower(line) LIKE 'p0%' THEN 'PROTEIN' ELSE 'INVALID' END AS type, count(*) AS n FROM {input_lines} WHERE line NOT LIKE '#%' GROUP BY 1""")
def input_summary(t):
    lines = t["input_lines"].filter(~F.col("line").startswith("#"))
    return lines.select(parse_variant(F.col("line"))["type"].alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT accession, string_agg(pdb || ';' || chains, '|' ORDER BY pdb) AS structures FROM (SELECT accession, pdb_id AS pdb, string_agg(chain_id, ',' ORDER BY chain_id) AS chains FROM {structure} GROUP BY 1, 2) GROUP BY accession")
def csv_structure_column(t):
    chains = t["structure"].groupBy("accession", "pdb_id").agg(F.array_join(F.array_sort(F.collect_list("chain_id")), ",").alias("chains"))
    cells = F.array_sort(F.collect_list(F.struct("pdb_id", F.concat("pdb_id", F.lit(";"), "chains").alias("cell"))))
    return chains.groupBy("accession").agg(F.array_join(F.transform(cells, lambda x: x["cell"]), "|").alias("structures"))


@query("SELECT struct_id, string_agg(CAST(pocket_id AS VARCHAR) || ';' || array_to_string(pocket_resid, ','), '|' ORDER BY pocket_id, array_to_string(pocket_resid, ',')) AS pockets FROM {pocket} GROUP BY struct_id")
def csv_pocket_column(t):
    resids = F.array_join(F.col("pocket_resid").cast("array<string>"), ",")
    cells = F.array_sort(F.collect_list(F.struct("pocket_id", resids.alias("resids"))))
    return t["pocket"].groupBy("struct_id").agg(F.array_join(F.transform(cells, lambda x: F.concat_ws(";", x["pocket_id"].cast("string"), x["resids"])), "|").alias("pockets"))


@query("SELECT split_part(refseq_acc, '.', 1) AS refseq, count(*) AS n FROM {uniprot_refseq} GROUP BY 1 HAVING count(*) > 1")
def refseq_version_multiplicity(t):
    return t["uniprot_refseq"].groupBy(F.split_part("refseq_acc", F.lit("."), F.lit(1)).alias("refseq")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT struct_id, residue, pocket_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY struct_id, residue ORDER BY score DESC, pocket_id) AS rank FROM (SELECT struct_id, pocket_id, pocket_score_combined_scaled AS score, unnest(pocket_resid) AS residue FROM {pocket})) WHERE rank <= 2")
def pocket_topn_per_residue(t):
    held = t["pocket"].select("struct_id", F.explode("pocket_resid").alias("residue"), "pocket_id", F.col("pocket_score_combined_scaled").alias("score"))
    return grp.top_by(held, ["struct_id", "residue"], [F.desc("score"), F.col("pocket_id")], 2).select("struct_id", "residue", "pocket_id", "score", "rank")


@query(f"SELECT {_V}, c.score AS cadd_score FROM {{variants}} v LEFT JOIN {{cadd}} c ON c.chromosome = v.chromosome AND c.position = v.genomic_position AND c.reference_allele = v.allele AND c.alt_allele = v.alt_allele ORDER BY c.score DESC NULLS FIRST, {_TIES} LIMIT 100")
def sort_cadd_desc(t):
    rows = var.with_cadd(var.expand(t["mapping"]), t["cadd"])
    return page(rows, ordering("cadd"), 1, 100).select(*KEY, "cadd_score")


@query(f"SELECT {_V}, a.am_pathogenicity FROM {{variants}} v LEFT JOIN {{alphamissense}} a ON a.accession = v.accession AND a.position = v.protein_position AND a.wt_aa = v.protein_seq AND a.mt_aa = v.alt_aa ORDER BY a.am_pathogenicity ASC NULLS LAST, {_TIES} LIMIT 100")
def sort_am_asc(t):
    rows = var.with_alphamissense(var.expand(t["mapping"]), t["alphamissense"])
    return page(rows, ordering("am", "asc"), 1, 100).select(*KEY, "am_pathogenicity")


@query(f"SELECT {_V} FROM {{variants}} v ORDER BY {_TIES} LIMIT 25 OFFSET 50")
def page_offset(t):
    return page(var.expand(t["mapping"]), ordering(), 3, 25).select(*KEY)


@query("SELECT line_no, line FROM {input_lines} WHERE line_no BETWEEN 101 AND 200")
def page_upload(t):
    return slice_lines(t["input_lines"], 2, 100)


@query("SELECT accession, pdb_id, chain_id, unp_end - unp_start + 1 AS covered FROM {structure}")
def structures_ordered(t):
    rows = t["structure"].withColumn("covered", F.col("unp_end") - F.col("unp_start") + 1)
    return rows.select("accession", "pdb_id", "chain_id", "covered").orderBy(F.desc("covered"), "accession", "pdb_id")


_QUERY = [((k * 7) % 13 - 6) / 10 for k in range(64)]
_LIST = "[" + ", ".join(str(x) for x in _QUERY) + "]"
_DISTANCE = f"round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_LIST} AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST({_LIST} AS DOUBLE[]), CAST({_LIST} AS DOUBLE[]))), 6)"


@query(f"SELECT vec_id, label, {_DISTANCE} AS distance FROM {{embeddings}} ORDER BY distance, vec_id LIMIT 20")
def semantic_topk(t):
    return nearest(t["embeddings"], _QUERY, 20).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, {_DISTANCE} AS distance FROM {{embeddings}} WHERE label = 3 ORDER BY distance, vec_id LIMIT 10 OFFSET 5")
def semantic_topk_filtered(t):
    return nearest(t["embeddings"].filter("label = 3"), _QUERY, 10, 5).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""SELECT accession, string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END, ' ' ORDER BY s) AS ranges FROM (SELECT accession, island, min(p) AS s, max(p) AS e FROM (
 SELECT accession, p, p - row_number() OVER (PARTITION BY accession ORDER BY p) AS island FROM (SELECT DISTINCT struct_id AS accession, unnest(pocket_resid) AS p FROM {pocket})) GROUP BY 1, 2) GROUP BY accession""")
def residue_ranges(t):
    held = t["pocket"].select(F.col("struct_id").alias("accession"), F.explode("pocket_resid").alias("p"))
    return held.groupBy("accession").agg(ranges(F.collect_set("p")).alias("ranges"))
