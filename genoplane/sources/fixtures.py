"""Variant tables derived from the star schema, for tests and for checks against DuckDB.

Each text is SQL in which ``{name}`` stands for another table, ARR(...) for an array
literal, SPLIT(...) for splitting at a comma, SORTED_LIST(...) for values joined by
a comma in order, and << and >> for the braces of JSON. ``spark_text`` and ``duckdb_text`` put in the spelling of an engine.
"""

from __future__ import annotations

import re

from ..functions.codon import CODONS

TABLES: dict[str, str] = {
    "codon_table": "SELECT codon, amino_acid FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CODONS.items()) + ") c(codon, amino_acid)",
    "mapping": """
SELECT s.chromosome, s.genomic_position,
 CASE WHEN s.reverse_strand THEN translate(substr(s.cod, s.codon_position, 1),'ACGU','TGCA')
      ELSE translate(substr(s.cod, s.codon_position, 1),'U','T') END AS allele,
 s.accession, s.protein_position, ct.amino_acid AS protein_seq,
 CASE s.codon_position WHEN 1 THEN substr(s.cod,1,1) || lower(substr(s.cod,2,2))
   WHEN 2 THEN lower(substr(s.cod,1,1)) || substr(s.cod,2,1) || lower(substr(s.cod,3,1))
   ELSE lower(substr(s.cod,1,2)) || substr(s.cod,3,1) END AS codon,
 s.codon_position, s.reverse_strand, s.gene_name, s.ensg, s.enst, s.ensp, s.is_canonical, s.is_mane_select, s.protein_name
FROM (
 SELECT CAST(1 + o_custkey % 22 AS VARCHAR(8)) AS chromosome,
  CAST(o_orderkey*3 + k.cp AS INT) AS genomic_position,
  'P' || lpad(CAST(o_custkey AS VARCHAR(12)), 5, '0') AS accession,
  CAST(o_orderkey AS INT) AS protein_position,
  substr('ACGU', CAST(1 + o_orderkey % 4 AS INT), 1) || substr('ACGU', CAST(1 + (o_orderkey*7 + o_custkey) % 4 AS INT), 1)
   || substr('ACGU', CAST(1 + (o_custkey*3 + o_orderkey*5) % 4 AS INT), 1) AS cod,
  k.cp AS codon_position, (o_custkey % 2 = 1) AS reverse_strand,
  'GENE' || CAST(o_custkey % 40 AS VARCHAR(12)) AS gene_name,
  'ENSG' || lpad(CAST(o_custkey % 40 AS VARCHAR(12)), 11, '0') AS ensg,
  'ENST' || lpad(CAST(o_custkey AS VARCHAR(12)), 11, '0') AS enst, 'ENSP' || lpad(CAST(o_custkey AS VARCHAR(12)), 11, '0') AS ensp,
  'protein ' || CAST(o_custkey AS VARCHAR(12)) AS protein_name,
  (o_orderkey % 5 <> 0) AS is_canonical, (o_orderkey % 3 = 0) AS is_mane_select
 FROM {orders} CROSS JOIN (VALUES (1),(2),(3)) k(cp)) s
JOIN {codon_table} ct ON ct.codon = s.cod
""",
    "variants": """
SELECT m.*, b.alt_allele, c.amino_acid AS alt_aa
FROM {mapping} m JOIN (VALUES ('A'),('T'),('G'),('C')) b(alt_allele) ON b.alt_allele <> m.allele
LEFT JOIN {codon_table} c ON c.codon = upper(CASE m.codon_position
  WHEN 1 THEN (CASE WHEN m.reverse_strand THEN replace(translate(b.alt_allele,'ATGC','TACG'),'T','U') ELSE replace(b.alt_allele,'T','U') END) || substr(m.codon,2,2)
  WHEN 2 THEN substr(m.codon,1,1) || (CASE WHEN m.reverse_strand THEN replace(translate(b.alt_allele,'ATGC','TACG'),'T','U') ELSE replace(b.alt_allele,'T','U') END) || substr(m.codon,3,1)
  WHEN 3 THEN substr(m.codon,1,2) || (CASE WHEN m.reverse_strand THEN replace(translate(b.alt_allele,'ATGC','TACG'),'T','U') ELSE replace(b.alt_allele,'T','U') END)
  ELSE m.codon END)
""",
    "cadd": """
SELECT DISTINCT chromosome, genomic_position AS position, allele AS reference_allele, alt_allele,
 CAST((genomic_position*13 + ascii(alt_allele)*7) % 1000 AS DOUBLE)/10 AS score
FROM {variants} WHERE genomic_position % 7 <> 0
""",
    "alphamissense": """
SELECT DISTINCT accession, protein_position AS position, protein_seq AS wt_aa, alt_aa AS mt_aa,
 CAST((protein_position*17 + ascii(alt_aa)*31) % 1000 AS DOUBLE)/1000 AS am_pathogenicity,
 (protein_position + ascii(alt_aa)) % 3 - 1 AS am_class
FROM {variants} WHERE is_canonical AND alt_aa <> protein_seq AND alt_aa <> '*'
""",
    "gnomad_allele_freq": """
SELECT DISTINCT chromosome AS chr, genomic_position AS pos, allele AS ref, alt_allele AS alt,
 (genomic_position*11) % 5000 AS ac, 50000 AS an,
 CAST((genomic_position*11) % 5000 AS DOUBLE)/50000 AS af
FROM {variants} WHERE (genomic_position + ascii(alt_allele)) % 4 = 0
""",
    "conserv_score": """
SELECT DISTINCT accession, protein_position AS position, protein_seq AS aa,
 CAST((protein_position*37) % 100 AS DOUBLE)/100 AS score FROM {mapping} WHERE protein_position % 6 <> 1
""",
    "structure": """
SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR(12)), 5, '0') AS accession, CAST(1 + c_custkey % 9 AS VARCHAR(4)) || 'abc' AS pdb_id,
 substr('ABCD', CAST(1 + c_custkey % 4 AS INT), 1) AS chain_id,
 CAST(c_custkey AS INT) AS unp_start, CAST(c_custkey + 800 AS INT) AS unp_end, 1 AS pdb_start
FROM {customer} WHERE c_custkey % 3 = 0
""",
    "dbsnp": """
SELECT 'rs' || CAST(g.pos AS VARCHAR(12)) AS id, g.chr, g.pos, g.ref, SORTED_LIST(g.alt) AS alt
FROM (SELECT DISTINCT chr, pos, ref, alt FROM {gnomad_allele_freq} WHERE pos % 5 < 3) g GROUP BY g.chr, g.pos, g.ref
""",
    "uniprot_refseq": """
SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR(12)), 5, '0') AS uniprot_acc,
 'NP_' || lpad(CAST(c_custkey - c_custkey % 2 AS VARCHAR(12)), 6, '0') || '.' || CAST(1 + c_custkey % 3 AS VARCHAR(4)) AS refseq_acc
FROM {customer} WHERE c_custkey % 4 <> 3
""",
    "esm": """
SELECT DISTINCT accession, protein_position AS position, alt_aa AS mt_aa,
 CAST(0 - (protein_position*19 + ascii(alt_aa)*5) % 250 AS DOUBLE)/10 AS score FROM {variants} WHERE is_canonical
""",
    "popeve": """
SELECT DISTINCT r.refseq_acc AS refseq_protein, v.protein_position AS position, v.protein_seq AS wt_aa, v.alt_aa AS mt_aa,
 CAST(0 - (v.protein_position*23 + ascii(v.alt_aa)*3) % 700 AS DOUBLE)/100 AS popeve
FROM {variants} v JOIN {uniprot_refseq} r ON r.uniprot_acc = v.accession WHERE v.is_canonical
""",
    "foldx": """
SELECT DISTINCT v.accession AS protein_acc, v.protein_position AS position,
 'AF-' || v.accession || '-F' || CAST(f.n AS VARCHAR(4)) AS af_id, v.protein_position - (f.n-1)*200 AS af_pos,
 v.protein_seq AS wild_type, v.alt_aa AS mutated_type,
 CAST((v.protein_position*29 + ascii(v.alt_aa) + f.n) % 80 AS DOUBLE)/10 - 2 AS foldx_ddg,
 CAST((v.protein_position + f.n*7) % 100 AS DOUBLE) AS plddt
FROM {variants} v JOIN (VALUES (1),(2),(3)) f(n) ON f.n <= 1 + v.protein_position % 3 WHERE v.is_canonical AND v.protein_position % 4 = 0
""",
    "crossmap": """
SELECT DISTINCT chromosome AS chr, genomic_position AS grch38_pos, allele AS grch38_base,
 genomic_position + 100000 AS grch37_pos, allele AS grch37_base FROM {mapping} WHERE genomic_position % 11 <> 0
""",
    "function_feature": """
SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR(12)), 5, '0') AS accession, CAST(o_orderkey AS INT) AS feature_index,
 CASE o_orderkey % 7 WHEN 0 THEN 'MOD_RES' WHEN 1 THEN 'DOMAIN' WHEN 2 THEN 'DISULFID' WHEN 3 THEN 'BINDING' WHEN 4 THEN 'ACT_SITE' WHEN 5 THEN 'TRANSMEM' ELSE 'MUTAGEN' END AS type,
 CAST(o_orderkey AS INT) AS begin_pos, CAST(o_orderkey + CASE WHEN o_orderkey % 7 IN (1,2,5) THEN 900 ELSE 0 END AS INT) AS end_pos,
 CASE WHEN o_orderkey % 11 = 0 THEN 'VARIANTS' ELSE 'DOMAINS_AND_SITES' END AS category, CASE WHEN o_orderkey % 3 > 0 THEN 'site ' || CAST(o_orderkey % 5 AS VARCHAR(4)) END AS description,
 CASE o_orderkey % 8 WHEN 0 THEN '[' WHEN 2 THEN '[]' WHEN 4 THEN '[<<"code":"ECO:1","source":<<"name":"PubMed","id":"' || CAST(o_orderkey AS VARCHAR(12)) || '">>>>,<<"source":<<"name":"PROSITE","id":"PS1">>>>,<<"code":"ECO:2">>,<<"source":<<"name":"PubMed","id":"7">>>>]' END AS evidences_json
FROM {orders} WHERE o_orderkey % 2 = 0
""",
    "function_header": """
SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR(12)), 5, '0') AS accession,
 CASE WHEN c_custkey % 17 = 3 THEN '<<bad' ELSE '<<"accession":"P' || CAST(c_custkey AS VARCHAR(12)) || '","proteinExistence":"' || CASE WHEN c_custkey % 2 = 0 THEN 'evidence at protein level' ELSE 'predicted' END
 || '","info":<<"type":"Swiss-Prot","modified":"2024-0' || CAST(1 + c_custkey % 9 AS VARCHAR(4)) || '-01">>,"sequence":<<"length":' || CAST(100 + c_custkey % 900 AS VARCHAR(8)) || ',"modified":"2020-0' || CAST(1 + c_custkey % 7 AS VARCHAR(4)) || '-02">>,'
 || '"protein":<<"recommendedName":<<"fullName":<<"value":"protein ' || CAST(c_custkey AS VARCHAR(12)) || '">>>>,"alternativeName":[<<"fullName":<<"value":"x">>>>,<<"fullName":<<"value":"y">>>>]>>,'
 || '"gene":[<<"name":<<"value":"GENE' || CAST(c_custkey % 40 AS VARCHAR(12)) || '">>>>],"dbReferences":[<<"type":"Pfam","id":"PF1">>,<<"type":"PDB","id":"1ABC">>],"comments":['
 || '<<"type":"CATALYTIC_ACTIVITY","reaction":<<"dbReferences":[<<"type":"ChEBI","id":"CHEBI:1">>,<<"type":"Rhea","id":"RHEA:' || CAST(c_custkey % 5 AS VARCHAR(4)) || '">>],"evidences":[<<"source":<<"name":"PubMed","id":"' || CAST(c_custkey AS VARCHAR(12)) || '">>>>]>>>>,'
 || '<<"type":"SUBCELLULAR_LOCATION","locations":[<<"location":<<"value":"Membrane">>,"topology":<<"value":"Single-pass">>>>,<<"location":<<"value":"Nucleus">>>>]>>,'
 || CASE WHEN c_custkey % 3 = 0 THEN '<<"type":"SUBUNIT","text":[<<"value":"Homodimer. Rarely a tetramer.">>]>>,' ELSE '' END
 || '<<"type":"SIMILARITY","text":[<<"value":"Belongs to family ' || CAST(c_custkey % 11 AS VARCHAR(4)) || '">>]>>,<<"type":"SIMILARITY","text":[<<"value":"Second. Of two.">>]>>,'
 || '<<"type":"INTERACTION","interactions":[<<"accession1":"P","accession2":"Q' || CAST(c_custkey % 7 AS VARCHAR(4)) || '","gene":"G1">>,<<"accession2":"Q9","gene":"G2">>]>>]>>' END AS header_json
FROM {customer} WHERE c_custkey % 9 <> 4
""",
    "population": """
SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR(12)), 5, '0') AS accession, CAST(o_orderkey AS INT) AS position,
 (o_orderkey % 4 = 1) AS disease, o_orderpriority AS clin_sig, substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + o_orderkey % 20 AS INT), 1) AS wild_type,
 substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + (o_orderkey*7 + k.n*3) % 20 AS INT), 1) AS alt,
 CASE o_orderkey % 13 WHEN 5 THEN '<<bad' WHEN 7 THEN NULL ELSE '<<"genomicLocation":["NC_1:g.' || CAST(o_orderkey*3 + k.n AS VARCHAR(12)) || 'A>T","second"],' || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '"cytogeneticBand":"1p' || CAST(o_orderkey % 30 AS VARCHAR(4)) || '",' END
  || '"xrefs":[<<"name":"ClinVar","id":"RCV' || CAST(o_orderkey AS VARCHAR(12)) || '">>,<<"name":"gnomAD","id":"rs' || CAST(o_orderkey AS VARCHAR(12)) || '">>,<<"name":"Ensembl","id":"e' || CAST(k.n AS VARCHAR(4)) || '">>],'
  || '"clinicalSignificances":[<<"type":"Benign","sources":["ClinVar","Ensembl"]>>,<<"type":"Pathogenic","sources":["ClinVar"]>>],"populationFrequencies":[<<"populationName":"MAF","frequency":0.25,"source":"gnomAD">>],'
  || '"association":[' || CASE WHEN o_orderkey % 4 = 1 THEN '<<"name":"disease ' || CAST(o_orderkey % 9 AS VARCHAR(4)) || '","evidences":[<<"source":<<"name":"ClinVar","id":"RCV1">>>>,<<"source":<<"name":"ClinVar","id":"RCV2">>>>]>>' ELSE '' END || ']>>' END AS raw_json
FROM {orders} JOIN (VALUES (0),(1)) k(n) ON k.n = 0 OR o_orderkey % 5 = 0 WHERE o_orderkey % 3 <> 2
""",
    "pocket": """
SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR(12)), 5, '0') AS struct_id, CAST(o_orderkey % 10 AS INT) AS pocket_id,
 ARR(CAST(o_orderkey AS INT), CAST(o_orderkey + 1 AS INT), CAST(o_orderkey + 5 AS INT)) AS pocket_resid,
 CAST(o_orderkey % 900 AS DOUBLE) AS pocket_score_combined_scaled, CAST(o_orderkey % 70 AS DOUBLE)/4 AS pocket_rad_gyration, CAST(0 - o_orderkey % 30 AS DOUBLE)/2 AS pocket_energy_per_vol,
 CAST(o_orderkey % 9 AS DOUBLE)/8 AS pocket_buriedness, CAST(50 + o_orderkey % 50 AS DOUBLE) AS pocket_mean_plddt FROM {orders} WHERE o_orderkey % 10 < 4
""",
    "interfaces": """
SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR(12)), 5, '0') AS a, 'P' || lpad(CAST(1 + (o_custkey*7) % 1500 AS VARCHAR(12)), 5, '0') AS b,
 ARR(CAST(o_orderkey AS INT), CAST(o_orderkey + 2 AS INT)) AS a_residues, ARR(CAST(o_orderkey + 3 AS INT)) AS b_residues,
 CAST(o_orderkey % 100 AS DOUBLE)/100 AS pdockq FROM {orders} WHERE o_orderkey % 6 = 0
""",
    "structure_regions": """
SELECT accession, pdb_id, chain_id, unp_start, unp_end, pdb_start,
 ARR(ARR(unp_start, unp_start + 300), ARR(unp_start + 500, unp_end)) AS observed_regions,
 CAST(unp_start % 40 AS DOUBLE)/8 AS resolution, 'X-ray diffraction' AS experimental_method FROM {structure}
""",
    "input_lines": """
SELECT CAST(genomic_position AS BIGINT) AS line_no, CASE genomic_position % 12
 WHEN 0 THEN chromosome || '-' || CAST(genomic_position AS VARCHAR(12)) || '-' || allele || '-' || alt_allele
 WHEN 1 THEN 'chr' || chromosome || ' ' || CAST(genomic_position AS VARCHAR(12)) || ' . ' || allele || ' ' || alt_allele || ' 50 PASS'
 WHEN 2 THEN chromosome || ' ' || CAST(genomic_position AS VARCHAR(12)) || ' ' || allele || '/' || alt_allele
 WHEN 3 THEN chromosome || ':' || CAST(genomic_position AS VARCHAR(12)) || ':' || lower(allele) || ':' || alt_allele
 WHEN 4 THEN accession || ' ' || CAST(protein_position AS VARCHAR(12)) || ' ' || protein_seq || ' ' || alt_aa
 WHEN 5 THEN lower(accession) || ' p.' || protein_seq || CAST(protein_position AS VARCHAR(12)) || alt_aa
 WHEN 6 THEN 'RS' || CAST(genomic_position AS VARCHAR(12))
 WHEN 7 THEN 'NC_000001.11:g.' || CAST(genomic_position AS VARCHAR(12)) || allele || '>' || alt_allele
 WHEN 8 THEN 'NM_000001.1 (GENE1):c.' || CAST(protein_position AS VARCHAR(12)) || allele || '>' || alt_allele
 WHEN 9 THEN 'NP_000001.1: p.(' || protein_seq || CAST(protein_position AS VARCHAR(12)) || alt_aa || ')'
 WHEN 10 THEN '# comment' ELSE 'completely_invalid_format_' || CAST(genomic_position AS VARCHAR(12)) END AS line
FROM {variants} WHERE is_canonical AND alt_allele = CASE WHEN allele = 'A' THEN 'T' ELSE 'A' END
""",
    "download_input": """
SELECT CAST(genomic_position AS BIGINT) AS line_no, CASE genomic_position % 8
 WHEN 0 THEN chromosome || '-' || CAST(genomic_position AS VARCHAR(12)) || '-' || allele || '-' || alt_allele
 WHEN 1 THEN chromosome || ' ' || CAST(genomic_position AS VARCHAR(12)) || ' id' || CAST(genomic_position AS VARCHAR(12)) || ' ' || allele || ' ' || alt_allele
 WHEN 2 THEN chromosome || ' ' || CAST(genomic_position AS VARCHAR(12)) || ' ' || allele || '/' || alt_allele
 WHEN 3 THEN chromosome || ':' || CAST(genomic_position AS VARCHAR(12)) || ':' || lower(allele) || ':' || alt_allele
 WHEN 4 THEN 'rs' || CAST(genomic_position AS VARCHAR(12)) WHEN 5 THEN 'X-' || CAST(genomic_position AS VARCHAR(12)) || '-A-T'
 WHEN 6 THEN 'no variant ' || CAST(genomic_position AS VARCHAR(12)) ELSE 'NC_000001.11:g.' || CAST(genomic_position AS VARCHAR(12)) || allele || '>' || alt_allele END AS line
FROM {variants} WHERE is_canonical AND alt_allele = CASE WHEN allele = 'A' THEN 'T' ELSE 'A' END
""",
    "eve_score": """
SELECT DISTINCT accession, protein_position AS position, alt_aa AS mt_aa,
 CAST((protein_position*41 + ascii(alt_aa)*3) % 1000 AS DOUBLE)/1000 AS score, (protein_position + ascii(alt_aa)) % 3 + 1 AS class
FROM {variants} WHERE is_canonical AND protein_position % 5 = 0
""",
    "m3d": """
SELECT DISTINCT accession AS uniprot_id, protein_position AS pos, alt_aa AS mut,
 CASE WHEN (protein_position + ascii(alt_aa)) % 2 = 0 THEN 'Damaging' ELSE 'Neutral' END AS prediction,
 'feature ' || CAST(protein_position % 4 AS VARCHAR(4)) AS damaging_feature
FROM {variants} WHERE is_canonical AND protein_position % 7 = 0
""",
    "clinvar_extended": """
SELECT ARR('RCV' || lpad(CAST(pos AS VARCHAR(12)), 9, '0'), 'RCV' || lpad(CAST(pos + 1 AS VARCHAR(12)), 9, '0')) AS rcvs,
 'VCV' || lpad(CAST(pos AS VARCHAR(12)), 9, '0') AS vcv, chr, pos, ref, alt FROM {gnomad_allele_freq} WHERE pos % 3 = 0
""",
    "cosmic": """
SELECT 'COSV' || CAST(pos AS VARCHAR(12)) AS id, 'COSM' || CAST(pos % 5000 AS VARCHAR(12)) AS legacy_id, chr, pos, ref, alt
FROM {gnomad_allele_freq} WHERE pos % 2 = 0
""",
    "mapping_dbsnp_lookup": """
SELECT DISTINCT m.chromosome AS chr, m.genomic_position AS pos, m.allele AS ref, SPLIT(d.alt) AS known_alts
FROM {mapping} m JOIN {dbsnp} d ON d.chr = m.chromosome AND d.pos = m.genomic_position AND d.ref = m.allele
""",
    "uniprot_entry": """
SELECT DISTINCT 'P' || lpad(CAST(c_custkey AS VARCHAR(12)), 5, '0') AS accession FROM {customer} WHERE c_custkey % 8 <> 5
""",
    "cytoband": """
SELECT CAST(1 + c.chr AS VARCHAR(8)) AS chr, CAST(1 + b.k * 3000 AS INT) AS begin_pos, CAST((b.k + 1) * 3000 AS INT) AS end_pos,
 CASE WHEN b.k % 2 = 0 THEN 'p' ELSE 'q' END || CAST(11 + b.k AS VARCHAR(8)) AS band
FROM (SELECT DISTINCT c_custkey % 22 AS chr FROM {customer}) c CROSS JOIN (SELECT DISTINCT c_custkey % 70 AS k FROM {customer}) b
""",
    "stats": """
SELECT event_type AS type, CAST(user_id % 50 AS VARCHAR(12)) AS key, CAST(user_id % 3 AS VARCHAR(4)) AS release, value, ts AS created FROM {events}
""",
}

#: Names in braces begin with a letter; repetitions of patterns, like {9}, do not.
_NAME = re.compile(r"\{([a-z]\w*)\}")


def needs(text: str) -> list[str]:
    """The tables that a text names, each once, in order."""
    return list(dict.fromkeys(_NAME.findall(text)))


def spark_text(text: str) -> str:
    text = re.sub(r"SORTED_LIST\(([\w.]+)\)", r"listagg(\1, ',') WITHIN GROUP (ORDER BY \1)", text)
    text = re.sub(r"\bSPLIT\(([\w.]+)\)", r"split(\1, ',')", text)
    # Braces are doubled, as the text is a format of table names.
    return text.replace("ARR(", "array(").replace("<<", "{{").replace(">>", "}}")


def duckdb_text(text: str) -> str:
    text = re.sub(r"SORTED_LIST\(([\w.]+)\)", r"string_agg(\1, ',' ORDER BY \1)", text)
    text = re.sub(r"\bSPLIT\(([\w.]+)\)", r"string_split(\1, ',')", text)
    return _NAME.sub(r"\1", text.replace("ARR(", "list_value(")).replace("<<", "{").replace(">>", "}")


def duckdb_query(text: str) -> str:
    """A DuckDB query with one WITH entry for each derived table that it needs, in order of need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES and name not in ordered:
            for other in needs(TABLES[name]):
                add(other)
            ordered.append(name)

    for name in needs(text):
        add(name)
    entries = [f"{name} AS MATERIALIZED ({duckdb_text(TABLES[name]).strip()})" for name in ordered]
    body = duckdb_text(text).strip()
    if not entries:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(entries) + ",\n" + body[5:]
    return "WITH " + ",\n".join(entries) + "\n" + body
