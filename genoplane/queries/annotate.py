"""Annotation and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..functions.codon import AMINO_ACIDS
from ..functions.scalars import or_na
from ..operators import variants as var
from ..plans import annotate as ann
from ..plans.export import HEADER, csv_rows, full_rows
from ..plans.residues import facts, function_answer
from ..service import ordered_download
from . import query

_CONSEQUENCE = "CASE WHEN v.alt_aa = v.protein_seq THEN 'synonymous' WHEN v.alt_aa = '*' THEN 'stop gained' ELSE 'missense' END"
_POPEVE = "(SELECT r.uniprot_acc, e.position, e.wt_aa, e.mt_aa, min(e.popeve) AS popeve FROM {popeve} e JOIN {uniprot_refseq} r ON r.refseq_acc = e.refseq_protein GROUP BY ALL)"
_CORE = f"""FROM {{variants}} v SEMI JOIN {{gnomad_allele_freq}} g ON g.chr = v.chromosome AND g.pos = v.genomic_position AND g.ref = v.allele AND g.alt = v.alt_allele
 LEFT JOIN {{cadd}} c ON c.chromosome = v.chromosome AND c.position = v.genomic_position AND c.reference_allele = v.allele AND c.alt_allele = v.alt_allele
 LEFT JOIN {{alphamissense}} a ON v.is_canonical AND a.accession = v.accession AND a.position = v.protein_position AND a.wt_aa = v.protein_seq AND a.mt_aa = v.alt_aa
 LEFT JOIN {_POPEVE} p ON v.is_canonical AND p.uniprot_acc = v.accession AND p.position = v.protein_position AND p.wt_aa = v.protein_seq AND p.mt_aa = v.alt_aa"""


def _inputs(t):
    """Every variant with a population frequency, as input."""
    return t["gnomad_allele_freq"].select(F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position"), F.col("ref").alias("allele"), F.col("alt").alias("alt_allele"))


def _core(t, scores=True):
    return ann.annotate_core(_inputs(t), t, scores=scores)


@query(f"SELECT v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession, v.alt_aa, {_CONSEQUENCE} AS consequence, c.score AS cadd_score, a.am_pathogenicity, p.popeve {_CORE}")
def annotate_variant_core(t):
    return _core(t).select("chromosome", "genomic_position", "allele", "alt_allele", "accession", "alt_aa", "consequence", "cadd_score", "am_pathogenicity", "popeve")


@query("""SELECT m.accession, m.position, s.conserv, s.eve, s.esm, s.am, coalesce(s.n, 0) AS n_scores FROM (SELECT DISTINCT accession, protein_position AS position FROM {mapping}) m LEFT JOIN (SELECT accession, position, min(score) FILTER (k = 'CONSERV') AS conserv, min(score) FILTER (k = 'EVE') AS eve, min(score) FILTER (k = 'ESM') AS esm,
 min(score) FILTER (k = 'AM') AS am, count(*) AS n FROM (SELECT 'CONSERV' AS k, accession, position, score FROM {conserv_score} UNION ALL SELECT 'EVE', accession, position, score FROM {eve_score} UNION ALL SELECT 'ESM', accession, position, score FROM {esm}
 UNION ALL SELECT 'AM', accession, position, am_pathogenicity FROM {alphamissense} UNION ALL SELECT 'M3D', uniprot_id, pos, NULL FROM {m3d} UNION ALL SELECT 'POPEVE', uniprot_acc, position, popeve FROM """ + _POPEVE + """) GROUP BY 1, 2) s ON s.accession = m.accession AND s.position = m.position""")
def annotate_function(t):
    positions = t["mapping"].select("accession", F.col("protein_position").alias("position"))
    return ann.function_of(positions, t).select("accession", "position", "conserv", "eve", "esm", "am", F.coalesce("n_scores", F.lit(0)).alias("n_scores"))


@query("""SELECT v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession, g.af, p.disease, p.clin_sig FROM {variants} v JOIN {gnomad_allele_freq} g ON g.chr = v.chromosome AND g.pos = v.genomic_position AND g.ref = v.allele AND g.alt = v.alt_allele
 LEFT JOIN {population} p ON p.accession = v.accession AND p.position = v.protein_position""")
def annotate_population(t):
    rows = var.with_frequency(var.expand(t["mapping"]), t["gnomad_allele_freq"], "inner")
    people = t["population"].withColumnRenamed("position", "protein_position")
    return rows.join(people, ["accession", "protein_position"], "left").select("chromosome", "genomic_position", "allele", "alt_allele", "accession", "af", "disease", "clin_sig")


@query("""SELECT v.accession, v.protein_position, v.alt_aa, string_agg(DISTINCT o.alt_aa, ',' ORDER BY o.alt_aa) AS colocated FROM (SELECT DISTINCT accession, protein_position, alt_aa FROM {variants}) v
 JOIN (SELECT DISTINCT accession, protein_position, alt_aa FROM {variants}) o ON o.accession = v.accession AND o.protein_position = v.protein_position AND o.alt_aa <> v.alt_aa GROUP BY 1, 2, 3""")
def population_colocated(t):
    """For each amino acid change the others at its residue: one list for each residue, no self-join."""
    every = var.expand(t["mapping"]).groupBy("accession", "protein_position").agg(F.array_sort(F.collect_set("alt_aa")).alias("all"))
    rows = every.select("accession", "protein_position", F.explode("all").alias("alt_aa"), "all")
    return rows.select("accession", "protein_position", "alt_aa", F.array_join(F.array_remove("all", F.col("alt_aa")), ",").alias("colocated")).filter("colocated <> ''")


@query("SELECT m.accession, m.protein_position, s.pdb_id, s.chain_id, m.protein_position + s.pdb_start - s.unp_start AS pdb_pos FROM (SELECT DISTINCT accession, protein_position FROM {mapping}) m JOIN {structure_regions} s ON s.accession = m.accession AND len(list_filter(s.observed_regions, lambda r: m.protein_position BETWEEN r[1] AND r[2])) > 0")
def structure_residues(t):
    rows = t["mapping"].select("accession", "protein_position").distinct().join(t["structure_regions"], "accession")
    return ann.structure_residues(rows, F.col("protein_position")).select("accession", "protein_position", "pdb_id", "chain_id", "pdb_pos")


@query("SELECT accession, feature_index, type, begin_pos, end_pos FROM {function_feature} WHERE accession = 'P00000' AND 4000 BETWEEN begin_pos AND end_pos AND (type <> 'DISULFID' OR 4000 IN (begin_pos, end_pos))")
def features_at_position(t):
    return ann.features_at(t["function_feature"], "P00000", 4000).select("accession", "feature_index", "type", "begin_pos", "end_pos")


@query("""SELECT accession, protein_position, ensg FROM (SELECT accession, protein_position, ensg, row_number() OVER (PARTITION BY protein_position % 500 ORDER BY CASE WHEN is_canonical AND is_mane_select THEN 0 WHEN is_canonical THEN 1 WHEN is_mane_select THEN 2 ELSE 3 END, ensg) AS r,
 first_value(ensg) OVER (PARTITION BY protein_position % 500 ORDER BY CASE WHEN is_canonical AND is_mane_select THEN 0 WHEN is_canonical THEN 1 WHEN is_mane_select THEN 2 ELSE 3 END, ensg) AS best FROM {mapping}) WHERE ensg = best""")
def gene_choice(t):
    """Genes that share a locus (here: five hundred loci, each with many genes); one stays for each."""
    rows = t["mapping"].withColumn("locus", F.col("protein_position") % 500)
    return ann.gene_choice(rows, ["locus"]).select("accession", "protein_position", "ensg")


_THREE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMINO_ACIDS.items())


@query(f"""SELECT v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession, v.is_canonical, CASE v.protein_seq {_THREE} END AS ref_aa, CASE v.alt_aa {_THREE} END AS variant_aa, {_CONSEQUENCE} AS consequence, v.enst AS transcripts,
 CASE WHEN v.is_canonical THEN '/function/' || v.accession || '/' || v.protein_position || '?variantAA=' || CASE v.alt_aa {_THREE} END END AS function_uri FROM {{variants}} v SEMI JOIN {{gnomad_allele_freq}} g ON g.chr = v.chromosome AND g.pos = v.genomic_position AND g.ref = v.allele AND g.alt = v.alt_allele""")
def isoforms(t):
    rows = ann.isoforms(_core(t, scores=False)).withColumn("transcripts", F.array_join("transcripts", ","))
    return rows.select("chromosome", "genomic_position", "allele", "alt_allele", "accession", "is_canonical", "ref_aa", "variant_aa", "consequence", "transcripts", "function_uri")


@query("SELECT accession, enst, count(*) AS n_rows, min(protein_position) AS first_position FROM {mapping} GROUP BY 1, 2")
def transcripts_by_isoform(t):
    return t["mapping"].groupBy("accession", "enst").agg(F.count("*").alias("n_rows"), F.min("protein_position").alias("first_position"))


def _evidences(items: str) -> str:
    """SQL of the evidences cell of a list: ids by name of the source."""
    named = f"list_filter(list_transform({items}, lambda e: e.source), lambda s: s.name IS NOT NULL)"
    one = f"n || ':[' || array_to_string(list_transform(list_filter({named}, lambda s: s.name = n), lambda s: s.id), ',') || ']'"
    return f"CASE WHEN len({items}) > 0 THEN '(' || array_to_string(list_transform(list_sort(list_distinct(list_transform({named}, lambda s: s.name))), lambda n: {one}), '') || ')' ELSE '' END"


_E = '[<<"source":<<"name":"VARCHAR","id":"VARCHAR">>>>]'
_HEAD = (
    '<<"proteinExistence":"VARCHAR","sequence":<<"length":"INTEGER","modified":"VARCHAR">>,"info":<<"modified":"VARCHAR">>,"comments":[<<"type":"VARCHAR","text":[<<"value":"VARCHAR">>],'
    f'"reaction":<<"dbReferences":[<<"id":"VARCHAR">>],"evidences":{_E}>>,"locations":[<<"location":<<"value":"VARCHAR">>,"topology":<<"value":"VARCHAR">>>>],"interactions":[<<"accession2":"VARCHAR","gene":"VARCHAR">>]>>]>>'
)
_VARIANT = (
    '<<"genomicLocation":["VARCHAR"],"cytogeneticBand":"VARCHAR","xrefs":[<<"name":"VARCHAR","id":"VARCHAR">>],"clinicalSignificances":[<<"type":"VARCHAR","sources":["VARCHAR"]>>],'
    f'"populationFrequencies":[<<"populationName":"VARCHAR","frequency":"DOUBLE","source":"VARCHAR">>],"association":[<<"name":"VARCHAR","evidences":{_E}>>]>>'
)
_NA = "coalesce(nullif(CAST({} AS VARCHAR), ''), 'N/A')"
_OF = "list_filter(j.comments, lambda c: c.type = '{}')"
_SENTENCE = "split_part(c.text[1].value, '.', 1)"

#: Cells by residue and by change, from v (chromosome, genomic_position, allele, alt_allele, accession, protein_position, protein_seq, alt_aa).
_CELLS = f"""r AS MATERIALIZED (SELECT DISTINCT accession, protein_position AS p FROM v),
 f AS (SELECT accession, p, string_agg(cell, '|' ORDER BY feature_index) FILTER (begin_pos = end_pos) AS one, string_agg(cell, '|' ORDER BY feature_index) FILTER (begin_pos <> end_pos) AS span FROM (
  SELECT accession, p, feature_index, begin_pos, end_pos, type || coalesce('-' || description, '') || CASE WHEN begin_pos <> end_pos THEN ';Range:' || begin_pos || '-' || end_pos ELSE '' END || {_evidences("ev")} AS cell
  FROM (SELECT r.accession, r.p, x.*, CASE WHEN json_valid(evidences_json) THEN json_transform(evidences_json, '{_E}') ELSE [] END AS ev FROM r JOIN {{function_feature}} x ON x.accession = r.accession AND r.p BETWEEN begin_pos AND end_pos AND (type <> 'DISULFID' OR r.p IN (begin_pos, end_pos)) WHERE category <> 'VARIANTS')) GROUP BY 1, 2),
 h AS (SELECT accession, j.proteinExistence AS existence, j.sequence.length AS len, j.info.modified AS updated, j.sequence.modified AS modified,
  array_to_string(list_transform({_OF.format("CATALYTIC_ACTIVITY")}, lambda c: list_filter(c.reaction.dbReferences, lambda d: d.id LIKE '%RHEA:%')[1].id || {_evidences("c.reaction.evidences")}), '|') AS activity,
  array_to_string(list_transform({_OF.format("SUBUNIT")}, lambda c: {_SENTENCE}), '|') AS complex, array_to_string(list_transform({_OF.format("SIMILARITY")}, lambda c: {_SENTENCE}), '|') AS family,
  array_to_string(list_transform({_OF.format("SUBCELLULAR_LOCATION")}, lambda c: array_to_string(list_transform(c.locations, lambda l: l.location.value), ';') || '(' || array_to_string(list_filter(list_transform(c.locations, lambda l: l.topology.value), lambda q: q IS NOT NULL), ';') || ')'), '|') AS location,
  array_to_string(list_transform({_OF.format("INTERACTION")}, lambda c: array_to_string(list_transform(c.interactions, lambda i: i.accession2 || '(' || i.gene || ')'), ';')), '|') AS partners
  FROM (SELECT accession, json_transform(header_json, '{_HEAD}') AS j FROM {{function_header}} WHERE json_valid(header_json))),
 k AS (SELECT r.accession, r.p, string_agg('pocket_id:' || pocket_id || ';rad_gyration:' || pocket_rad_gyration || ';energy_per_vol:' || pocket_energy_per_vol || ';buriedness:' || pocket_buriedness || ';resid:' || pocket_resid[1] || '-' || pocket_resid[2] || ' ' || pocket_resid[3] || ';mean_plddt:' || pocket_mean_plddt || ';score:' || pocket_score_combined_scaled, '|' ORDER BY pocket_score_combined_scaled DESC, pocket_id, pocket_rad_gyration)
  AS pockets FROM r JOIN (SELECT *, unnest(pocket_resid) AS q FROM {{pocket}}) x ON x.struct_id = r.accession AND x.q = r.p GROUP BY 1, 2),
 b AS (SELECT a AS accession, unnest(a_residues) AS p, a, b, a_residues, b_residues, pdockq FROM {{interfaces}} UNION SELECT b, unnest(b_residues), a, b, a_residues, b_residues, pdockq FROM {{interfaces}}),
 i AS (SELECT accession, p, string_agg(a || '-' || b || ';A residues:' || array_to_string(a_residues, ' ') || ';B residues:' || array_to_string(b_residues, ' ') || ';pDockQ:' || pdockq, '|' ORDER BY pdockq DESC, a, b, a_residues) AS interactions FROM r JOIN b USING (accession, p) GROUP BY 1, 2),
 x AS (SELECT protein_acc, position, mutated_type, string_agg('foldxDdg:' || foldx_ddg || ';plddt:' || plddt, '|' ORDER BY af_id) AS foldx FROM {{foldx}} GROUP BY 1, 2, 3),
 c AS (SELECT accession, position, min(score) AS score FROM {{conserv_score}} GROUP BY 1, 2),
 n AS (SELECT accession, position AS p, wild_type, alt, CASE wild_type {_THREE} END AS wild3, CASE alt {_THREE} END AS alt3, json_transform(raw_json, '{_VARIANT}') AS j FROM {{population}} WHERE json_valid(raw_json)),
 m AS (SELECT accession, p, wild_type, alt, alt3, wild3, j.cytogeneticBand IS NULL AS no_band, coalesce(j.genomicLocation[1], 'N/A') AS place, coalesce(j.cytogeneticBand, 'N/A') AS band, j, array_to_string(list_transform(j.xrefs, lambda x: x.name || '-' || x.id
   || coalesce(';' || list_filter(j.populationFrequencies, lambda q: q.source = x.name)[-1].populationName || ':' || list_filter(j.populationFrequencies, lambda q: q.source = x.name)[-1].frequency, '')
   || coalesce(';' || list_filter(j.clinicalSignificances, lambda q: list_contains(q.sources, x.name))[-1].type, '')), '|') AS ids,
   array_to_string(list_transform(j.association, lambda d: d.name || '-' || {_evidences("d.evidences")}), '|') AS diseases FROM n),
 w AS (SELECT v.chromosome, v.genomic_position, v.allele, v.alt_allele, v.accession, string_agg(m.place, '|' ORDER BY m.wild_type, m.alt, m.place) FILTER (m.alt = v.alt_aa) AS place, string_agg(m.band, '|' ORDER BY m.wild_type, m.alt, m.place) FILTER (m.alt = v.alt_aa) AS band,
   string_agg(m.ids, '|' ORDER BY m.wild_type, m.alt, m.place) FILTER (m.alt = v.alt_aa) AS ids, string_agg({_NA.format("m.diseases")}, '|' ORDER BY m.wild_type, m.alt, m.place) FILTER (m.alt = v.alt_aa) AS diseases,
   string_agg('[' || m.wild3 || '>' || m.alt3 || ';' || m.place || ';' || m.band || ';' || m.ids || ']', '' ORDER BY m.wild_type, m.alt, m.place) FILTER (m.alt <> v.alt_aa) AS colocated FROM v JOIN m ON m.accession = v.accession AND m.p = v.protein_position GROUP BY ALL),
 t AS (SELECT accession, p, string_agg(pdb_id || ';' || places || ';' || resolution || ';' || experimental_method, '|' ORDER BY pdb_id) AS structures FROM (SELECT r.accession, r.p, z.pdb_id, z.resolution, z.experimental_method, string_agg(z.chain_id || (r.p + z.pdb_start - z.unp_start), ',' ORDER BY z.chain_id) AS places FROM r JOIN {{structure_regions}} z
   ON z.accession = r.accession AND len(list_filter(z.observed_regions, lambda q: r.p BETWEEN q[1] AND q[2])) > 0 GROUP BY ALL) GROUP BY 1, 2)"""
_JOINS = """LEFT JOIN f ON f.accession = v.accession AND f.p = v.protein_position LEFT JOIN h ON h.accession = v.accession LEFT JOIN k ON k.accession = v.accession AND k.p = v.protein_position LEFT JOIN i ON i.accession = v.accession AND i.p = v.protein_position
 LEFT JOIN x ON x.protein_acc = v.accession AND x.position = v.protein_position AND x.mutated_type = v.alt_aa LEFT JOIN c ON c.accession = v.accession AND c.position = v.protein_position LEFT JOIN {esm} e ON e.accession = v.accession AND e.position = v.protein_position AND e.mt_aa = v.alt_aa
 LEFT JOIN w ON w.chromosome = v.chromosome AND w.genomic_position = v.genomic_position AND w.allele = v.allele AND w.alt_allele = v.alt_allele AND w.accession = v.accession LEFT JOIN t ON t.accession = v.accession AND t.p = v.protein_position
 LEFT JOIN {gnomad_allele_freq} g ON g.chr = v.chromosome AND g.pos = v.genomic_position AND g.ref = v.allele AND g.alt = v.alt_allele"""
#: A double below a thousandth is written with an exponent; here it is a number of fifty-thousandths.
_AF = "CASE WHEN g.ac > 0 AND 2 * g.ac < 10 THEN (2 * g.ac) || '.0E-5' WHEN g.ac > 0 AND 2 * g.ac < 100 THEN (2 * g.ac // 10) || '.' || (2 * g.ac % 10) || 'E-4' ELSE CAST(g.af AS VARCHAR) END"
_FUNCTION = {
    "Residue_function_(evidence)": "f.one", "Region_function_(evidence)": "f.span", "Protein_existence_evidence": "h.existence", "Protein_length": "h.len", "Entry_last_updated": "h.updated", "Sequence_last_updated": "h.modified",
    "Protein_catalytic_activity": "h.activity", "Protein_complex": "h.complex", "Protein_sub_cellular_location": "h.location", "Protein_family": "h.family", "Protein_interactions_PROTEIN(gene)": "h.partners",
    "Predicted_pockets(energy;per_vol;score;resids)": "k.pockets", "Predicted_interactions(chainA-chainB;a_resids;b_resids;pDockQ)": "i.interactions", "Foldx_prediction(foldxDdg;plddt)": "x.foldx", "Conservation_score": "c.score", "ESM1b_score": "e.score",
}
_POPULATION = {
    "Gnomad_allele_freq(ac;an;af)": f"g.ac || ';' || g.an || ';' || {_AF}", "Genomic_location": "w.place", "Cytogenetic_band": "w.band", "Other_identifiers_for_the_variant": "w.ids",
    "Diseases_associated_with_variant": "w.diseases", "Variants_colocated_at_residue_position": "w.colocated", "Position_in_structures": "t.structures",
}
_MAPPED = {
    "Gene": "v.gene_name", "Codon_change": "v.codon || '/' || v.alt_codon", "Strand": "CASE WHEN v.reverse_strand THEN '-' ELSE '+' END", "CADD_phred_like_score": "d.score", "Canonical_isoform_transcripts": "'[' || v.ensp || '(' || v.enst || ')]'",
    "MANE_transcript": "CASE WHEN v.is_mane_select THEN v.enst END", "Uniprot_canonical_isoform_(non_canonical)": "v.accession", "Alternative_isoform_mappings": f"CASE WHEN NOT v.is_canonical THEN v.accession || ';' || v.protein_position || ';' || CASE v.protein_seq {_THREE} END || '/' || CASE v.alt_aa {_THREE} END || ';' || {_CONSEQUENCE} || ';[' || v.ensp || '(' || v.enst || ')]' END",
    "Protein_name": "v.protein_name", "Amino_acid_position": "v.protein_position", "Amino_acid_change": f"CASE v.protein_seq {_THREE} END || '/' || CASE v.alt_aa {_THREE} END", "Consequences": _CONSEQUENCE,
    "AlphaMissense_pathogenicity(class)": "CASE WHEN v.is_canonical THEN a.am_pathogenicity || '(' || CASE a.am_class WHEN -1 THEN 'AMBIGUOUS' WHEN 0 THEN 'BENIGN' ELSE 'PATHOGENIC' END || ')' END",
    "popEVE_score(class)": "CASE WHEN v.is_canonical THEN u.popeve || '(' || CASE WHEN u.popeve < -5.056 THEN 'SEVERE' WHEN u.popeve < -4.617 THEN 'MODERATELY_DELETERIOUS' ELSE 'UNLIKELY_DELETERIOUS' END || ')' END",
}
_SCORES = f"""LEFT JOIN {{cadd}} d ON d.chromosome = v.chromosome AND d.position = v.genomic_position AND d.reference_allele = v.allele AND d.alt_allele = v.alt_allele LEFT JOIN {{alphamissense}} a ON a.accession = v.accession AND a.position = v.protein_position AND a.wt_aa = v.protein_seq AND a.mt_aa = v.alt_aa
 LEFT JOIN {_POPEVE} u ON u.uniprot_acc = v.accession AND u.position = v.protein_position AND u.wt_aa = v.protein_seq AND u.mt_aa = v.alt_aa"""
_KEY = ["chromosome", "genomic_position", "allele", "alt_allele", "accession"]
_KNOWN = "SELECT v.* FROM {variants} v SEMI JOIN {gnomad_allele_freq} g ON g.chr = v.chromosome AND g.pos = v.genomic_position AND g.ref = v.allele AND g.alt = v.alt_allele"
#: The codon with the base of the alternate allele in its place.
_ALT_CODON = "CASE WHEN reverse_strand THEN replace(translate(alt_allele, 'ATGC', 'TACG'), 'T', 'U') ELSE replace(alt_allele, 'T', 'U') END"
_CODON = f"CASE codon_position WHEN 1 THEN {_ALT_CODON} || substr(codon, 2, 2) WHEN 2 THEN substr(codon, 1, 1) || {_ALT_CODON} || substr(codon, 3, 1) ELSE substr(codon, 1, 2) || {_ALT_CODON} END"


def _cells(named: dict[str, str]) -> str:
    return ", ".join(f'{_NA.format(sql)} AS "{name}"' for name, sql in named.items())


def _known_cells(t, names, keys=_KEY):
    """Cells of every variant with a population frequency, after its key."""
    near = t.by_place()
    rows = full_rows(ann.annotate_core(_inputs(near), near, scores=False), t, near, names)
    return csv_rows(rows.withColumns({f"key_{c}": F.col(c) for c in keys}), [f"key_{c}" for c in keys]).select(*[F.col(f"key_{c}").alias(c) for c in keys], *[F.col(f"`{n}`") for n in names])


_KEYS = ", ".join(f"v.{c}" for c in _KEY)


@query(f"WITH v AS MATERIALIZED ({_KNOWN}), {_CELLS} SELECT {_KEYS}, {_cells(_FUNCTION)} FROM v {_JOINS}")
def csv_function_columns(t):
    return _known_cells(t, list(_FUNCTION))


@query(f"WITH v AS MATERIALIZED ({_KNOWN}), {_CELLS} SELECT {_KEYS}, {_cells(_POPULATION)} FROM v {_JOINS}")
def csv_population_columns(t):
    return _known_cells(t, list(_POPULATION))


_INPUT = {
    "User_input": "v.chromosome || '-' || v.genomic_position || '-' || v.allele || '-' || v.alt_allele", "Chromosome": "v.chromosome", "Coordinate": "v.genomic_position", "ID": "NULL",
    "Reference_allele": "v.allele", "Alternative_allele": "v.alt_allele", "Notes": "NULL",
}
_EVERY = {**_INPUT, **_MAPPED, **_FUNCTION, **_POPULATION}


@query(f"WITH v AS MATERIALIZED (SELECT *, {_CODON} AS alt_codon FROM ({_KNOWN})), {_CELLS} SELECT {_cells({name: _EVERY[name] for name in HEADER})} FROM v {_JOINS} {_SCORES}")
def csv_export_rows(t):
    """All 44 cells."""
    return _known_cells(t, HEADER, [])


#: Every line with what it stands for: kind 0 to 3 the variant that it was made of, 4 the alternates of an id, 5 a place without mapping, 6 no variant, 7 a place on chromosome 1.
_LINES = """l AS MATERIALIZED (SELECT genomic_position AS line_no, d.line, v.genomic_position % 8 AS k, v.chromosome, v.allele, v.alt_allele FROM {variants} v JOIN {download_input} d ON d.line_no = v.genomic_position WHERE is_canonical AND alt_allele = CASE WHEN allele = 'A' THEN 'T' ELSE 'A' END),
 o AS MATERIALIZED (SELECT line_no, line, k, chromosome AS chr, allele AS ref, alt_allele AS alt FROM l WHERE k < 4 UNION ALL SELECT line_no, line, k, s.chr, s.ref, unnest(string_split(s.alt, ',')) FROM l JOIN {dbsnp} s ON s.id = l.line WHERE k = 4
  UNION ALL SELECT line_no, line, k, 'X', 'A', 'T' FROM l WHERE k = 5 UNION ALL SELECT line_no, line, k, '1', allele, alt_allele FROM l WHERE k = 7
  UNION ALL SELECT line_no, line, k, NULL, NULL, NULL FROM l WHERE k = 6 OR k = 4 AND line NOT IN (SELECT id FROM {dbsnp})),"""


@query(f"""WITH {_LINES} v AS MATERIALIZED (SELECT o.line_no, o.line, o.k, z.*, {_CODON.replace("alt_allele", "z.alt_allele").replace("codon_position", "z.codon_position").replace("reverse_strand", "z.reverse_strand")} AS alt_codon FROM o JOIN {{variants}} z ON z.chromosome = o.chr AND z.genomic_position = o.line_no AND z.allele = o.ref AND z.alt_allele = o.alt), {_CELLS},
 y AS (SELECT DISTINCT v.line_no, v.chromosome, v.genomic_position, v.allele, v.alt_allele, {_cells({**_MAPPED, **_FUNCTION, **_POPULATION})} FROM v {_JOINS} {_SCORES})
 SELECT o.line_no, row_number() OVER (PARTITION BY o.line_no ORDER BY o.alt) AS seq, o.line AS "User_input", {_NA.format("o.chr")} AS "Chromosome", CASE WHEN o.chr IS NULL THEN 'N/A' ELSE CAST(o.line_no AS VARCHAR) END AS "Coordinate", CASE o.k WHEN 1 THEN 'id' || o.line_no WHEN 4 THEN o.line ELSE 'N/A' END AS "ID",
 {_NA.format("o.ref")} AS "Reference_allele", {_NA.format("o.alt")} AS "Alternative_allele", CASE WHEN y.line_no IS NOT NULL THEN 'N/A' WHEN o.k = 6 THEN 'ERROR:Unsupported format' WHEN o.k = 4 THEN 'ERROR:No mapping found for dbSNP ID.' ELSE 'No mapping found' END AS "Notes",
 {", ".join(f"coalesce(y.{chr(34)}{n}{chr(34)}, 'N/A') AS {chr(34)}{n}{chr(34)}" for n in [*_MAPPED, *_FUNCTION, *_POPULATION])} FROM o LEFT JOIN y ON y.line_no = o.line_no AND y.chromosome = o.chr AND y.allele = o.ref AND y.alt_allele = o.alt""")
def download_lines(t):
    """Every line of an input with its 44 cells and its place in the download: mapped, unmapped and invalid ones."""
    return ordered_download(t["download_input"], t).withColumn("seq", F.col("seq").cast("long"))


@query(f"""WITH v AS MATERIALIZED (SELECT DISTINCT '' AS chromosome, 0 AS genomic_position, '' AS allele, '' AS alt_allele, accession, protein_position, protein_seq, '' AS alt_aa FROM {{mapping}} WHERE is_canonical), {_CELLS}
 SELECT v.accession, v.protein_position, {_cells({"existence": "h.existence", "n_comments": "h.family", "residue_function": "f.one", "region_function": "f.span", "conservation": "c.score"})}, coalesce(s.n, 0) AS n_pockets, coalesce(b2.n, 0) AS n_interactions FROM v {_JOINS}
 LEFT JOIN (SELECT struct_id, q, count(*) AS n FROM (SELECT struct_id, unnest(pocket_resid) AS q FROM {{pocket}}) GROUP BY 1, 2) s ON s.struct_id = v.accession AND s.q = v.protein_position LEFT JOIN (SELECT accession, p, count(*) AS n FROM b GROUP BY 1, 2) b2 ON b2.accession = v.accession AND b2.p = v.protein_position""")
def function_records(t):
    """The function of every canonical residue as a nested record: one shuffle for all tables of facts."""
    asked = t["mapping"].filter("is_canonical").select("accession", "protein_position", F.lit(None).cast("string").alias("variant_aa")).distinct()
    of_facts = {"residue_function": records.features_cell(F.col("features"), True), "region_function": records.features_cell(F.col("features"), False), **{f"n_{c}": F.size(c).cast("long") for c in ("pockets", "interactions")}}
    of_entry = {"n_comments": records.comment_cells(F.col("entry")["comments"])["family"]}
    rows = function_answer(asked, t, ["features", "conservation", "pockets", "interactions"], of_facts, of_entry)
    return rows.select("accession", "protein_position", *[or_na(F.col(c)).alias(c) for c in ("existence", "n_comments", "residue_function", "region_function", "conservation")], "n_pockets", "n_interactions")


@query("""SELECT accession, position AS protein_position, string_agg(alt, ',' ORDER BY wild_type, alt) AS alts, CAST(count(*) AS BIGINT) AS n FROM {population} SEMI JOIN (SELECT DISTINCT accession, protein_position FROM {mapping}) m ON m.accession = population.accession AND m.protein_position = position
 WHERE json_valid(raw_json) GROUP BY 1, 2""")
def population_records(t):
    """Population variants of every mapped residue as records; rows whose record can't be read are left out."""
    known = facts(t["mapping"].select("accession", "protein_position"), t, ["variants"])
    alts = F.transform(F.filter("variants", lambda v: records.variant(v["raw_json"]).isNotNull()), lambda v: v["alt"])
    return known.select("accession", "protein_position", F.array_join(alts, ",").alias("alts"), F.size(alts).cast("long").alias("n")).filter("n > 0")
