"""Scans, sources and lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.codon import is_snv_pair
from ..operators import variants as var
from ..operators.filters import structure_positions
from ..plans.annotate import merge_json_features
from ..sources.lineage import cut, shared_folder
from ..sources.text_input import checksum, lines_of
from ..streaming.jobs import job_counts, job_states, read_ledger, run_jobs
from . import query


@query("SELECT accession FROM {uniprot_entry}")
def uniprot_entries_all(t):
    return t["uniprot_entry"].orderBy("accession")


@query("SELECT m.chromosome, m.genomic_position, m.allele, m.accession, m.codon, m.is_canonical FROM {mapping} m JOIN (SELECT DISTINCT chr, pos FROM {dbsnp}) d ON d.chr = m.chromosome AND d.pos = m.genomic_position")
def batch_mapping_by_chr_pos(t):
    wanted = t["dbsnp"].select(F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position")).distinct()
    rows = t["mapping"].filter("codon IS NOT NULL").join(wanted, ["chromosome", "genomic_position"], "left_semi")
    return rows.select("chromosome", "genomic_position", "allele", "accession", "codon", "is_canonical").orderBy(F.desc("is_canonical"), "chromosome", "genomic_position", "accession")


@query("SELECT m.accession, m.protein_position, m.chromosome, m.genomic_position, m.allele, m.codon FROM {mapping} m JOIN (SELECT DISTINCT accession, position FROM {population}) p ON p.accession = m.accession AND p.position = m.protein_position")
def batch_mapping_by_acc_pos(t):
    wanted = t["population"].select("accession", F.col("position").alias("protein_position")).distinct()
    return t["mapping"].join(wanted, ["accession", "protein_position"], "left_semi").select("accession", "protein_position", "chromosome", "genomic_position", "allele", "codon")


@query("SELECT struct_id, unnest(pocket_resid) AS residue, unnest(list_transform(pocket_resid, lambda x: x * 2)) AS twice FROM {pocket}")
def aligned_unnest(t):
    """Arrays of one length, unnested side by side."""
    pairs = F.arrays_zip(F.col("pocket_resid").alias("residue"), F.transform("pocket_resid", lambda x: x * 2).alias("twice"))
    return t["pocket"].select("struct_id", F.inline(pairs).alias("residue", "twice"))


@query("SELECT DISTINCT accession, unnest(generate_series(unp_start, unp_end)) AS position FROM {structure}")
def explode_structure_positions(t):
    return structure_positions(t["structure"])


@query("SELECT chromosome, genomic_position, allele, alt_allele, accession FROM {variants}")
def expand_alt_alleles(t):
    return var.expand(t["mapping"]).select("chromosome", "genomic_position", "allele", "alt_allele", "accession")


@query("""SELECT v.chromosome, v.genomic_position, v.alt_allele, v.alt_aa, CASE WHEN v.alt_aa = v.protein_seq THEN 'synonymous' WHEN v.alt_aa = '*' THEN 'stop gained' ELSE 'missense' END AS consequence FROM {variants} v""")
def codon_translate(t):
    return var.expand(t["mapping"]).select("chromosome", "genomic_position", "alt_allele", "alt_aa", "consequence")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_no, line FROM (
 SELECT doc_id, k, trim(x) AS line FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]|,')) AS x, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]|,'), 1) AS k FROM {documents})) WHERE line <> '' AND line NOT LIKE '#%'""")
def normalize_input_lines(t):
    """Whole documents taken as uploads: split at line breaks and commas, trimmed, blank lines and comments dropped."""
    return t["documents"].select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))


@query("""SELECT doc_id, regexp_replace(md5(array_to_string(list_filter(list_transform(string_split_regex(text, '\\n|,'), lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%'), chr(10))), '^0+(.)', '\\1') AS upload_id FROM {documents}""")
def input_checksum(t):
    return t["documents"].select("doc_id", checksum(lines_of(F.col("text"))).alias("upload_id"))


@query("""SELECT accession, feature_index, type AS type, begin_pos AS begin_at, end_pos AS end_at, CASE WHEN feature_index % 10 = 0 THEN NULL ELSE 'feature ' || CAST(feature_index AS VARCHAR) END AS description FROM {function_feature}""")
def json_feature_merge(t):
    """JSON with other positions than the columns; the columns win, and bad JSON gives an empty feature."""
    good = F.to_json(F.struct(F.lit("OTHER").alias("type"), F.concat(F.lit("feature "), F.col("feature_index").cast("string")).alias("description"), (F.col("begin_pos") + 5).alias("begin")))
    rows = t["function_feature"].withColumn("raw_json", F.when(F.col("feature_index") % 10 == 0, F.lit("{broken")).otherwise(good))
    merged = merge_json_features(rows)
    return merged.select("accession", "feature_index", "feature.type", F.col("feature.begin").alias("begin_at"), F.col("feature.end").alias("end_at"), "feature.description")


@query("SELECT event_type AS state, strftime(ts, '%Y-%m-%d') AS day, count(*) AS jobs FROM {events} GROUP BY 1, 2")
def download_counters(t):
    counts = job_counts(t["events"].select(F.col("event_type").alias("state"), F.col("ts").alias("changed")))
    return counts.withColumn("day", F.col("day").cast("string"))


@query("SELECT CAST(line_no // 1000 AS VARCHAR) AS job_id, CASE WHEN count(*) > 300 THEN 'FAILED' ELSE 'READY' END AS state, CAST(CASE WHEN count(*) > 300 THEN 0 ELSE 1 END AS BIGINT) AS attempt, CAST(CASE WHEN count(*) > 300 THEN 0 ELSE count(*) END AS BIGINT) AS n_lines FROM {input_lines} GROUP BY line_no // 1000")
def download_jobs(t):
    """The lines as requests of a stream, a thousand numbers a job: what its ledger and its output say of each job. More than 300 lines are too many here."""
    folder = f"{shared_folder(t.spark)}/jobs-{uuid.uuid4().hex}"
    requests = t["input_lines"].groupBy(F.floor(F.col("line_no") / 1000).cast("string").alias("job_id")).agg(F.collect_list("line").alias("lines"), F.current_timestamp().alias("submitted"))
    requests.write.json(f"{folder}/inbox")
    run_jobs(t.spark, f"{folder}/inbox", f"{folder}/ledger", f"{folder}/checkpoint", lambda lines: lines, f"{folder}/output", most_rows=300).awaitTermination()
    done = t.spark.read.schema("line_no int, line string, job_id string").parquet(f"{folder}/output").groupBy("job_id").agg(F.count("*").alias("n_lines"))
    states = job_states(read_ledger(t.spark, f"{folder}/ledger")).join(done, "job_id", "left")
    return cut(states.select("job_id", "state", F.col("attempt").cast("long").alias("attempt"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")))


@query("SELECT chr, pos, ref, array_to_string(known_alts, ',') AS known_alts FROM {mapping_dbsnp_lookup}")
def build_dbsnp_lookup(t):
    known = t["dbsnp"].select(F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position"), F.col("ref").alias("allele"), F.split("alt", ",").alias("known_alts"))
    rows = t["mapping"].select("chromosome", "genomic_position", "allele").join(known, ["chromosome", "genomic_position", "allele"]).distinct()
    return rows.select(F.col("chromosome").alias("chr"), F.col("genomic_position").alias("pos"), F.col("allele").alias("ref"), F.array_join("known_alts", ",").alias("known_alts"))


@query("SELECT count(*) AS n_rows, count(DISTINCT chr) AS n_chromosomes, round(avg(len(known_alts)), 9) AS mean_alts FROM {mapping_dbsnp_lookup}")
def dbsnp_lookup_profile(t):
    return t["mapping_dbsnp_lookup"].agg(F.count("*").alias("n_rows"), F.countDistinct("chr").alias("n_chromosomes"), F.round(F.avg(F.size("known_alts")), 9).alias("mean_alts"))


@query("SELECT chr, count(*) AS n_positions FROM {mapping_dbsnp_lookup} GROUP BY chr")
def dbsnp_positions_by_chr(t):
    return t["mapping_dbsnp_lookup"].groupBy("chr").agg(F.count("*").alias("n_positions"))


@query("SELECT DISTINCT accession FROM {mapping} WHERE is_canonical")
def accessions_mapped(t):
    return t["mapping"].filter("is_canonical").select("accession").distinct().orderBy("accession")


@query("SELECT accession FROM {uniprot_entry} EXCEPT SELECT accession FROM {mapping} WHERE is_canonical")
def accessions_unmapped(t):
    return t["uniprot_entry"].join(t["mapping"].filter("is_canonical"), "accession", "left_anti").select("accession").distinct()


@query("SELECT DISTINCT accession, chromosome, genomic_position FROM {mapping}")
def accession_coordinates(t):
    return t["mapping"].select("accession", "chromosome", "genomic_position").distinct()


@query("""SELECT upper(m.codon) AS from_codon, c.codon AS to_codon, CAST(count(*) AS BIGINT) AS n, min(CAST(m.codon[1] <> c.codon[1] AS INT) + CAST(upper(m.codon)[2] <> c.codon[2] AS INT) + CAST(upper(m.codon)[3] <> c.codon[3] AS INT)) AS changes
 FROM (SELECT * REPLACE (upper(codon) AS codon) FROM {mapping}) m JOIN {codon_table} c ON CASE m.codon_position WHEN 1 THEN c.codon[1] <> m.codon[1] AND c.codon[2:3] = m.codon[2:3] WHEN 2 THEN c.codon[2] <> m.codon[2] AND c.codon[1] = m.codon[1] AND c.codon[3] = m.codon[3]
 ELSE c.codon[3] <> m.codon[3] AND c.codon[1:2] = m.codon[1:2] END GROUP BY 1, 2""")
def codon_change_matrix(t):
    """How often each codon of the mapping becomes another by one of its variants, and in how many letters these differ."""
    pairs = var.expand(t["mapping"]).groupBy(F.upper("codon").alias("from_codon"), F.upper("alt_codon").alias("to_codon")).agg(F.count("*").alias("n"))
    differs = sum((F.substring("from_codon", k, 1) != F.substring("to_codon", k, 1)).cast("int") for k in (1, 2, 3))
    return pairs.withColumn("changes", differs)


@query("""SELECT wild_type AS ref_aa, alt AS alt_aa, CAST(count(*) AS BIGINT) AS n, bool_or(s.a IS NOT NULL) AS by_snv FROM {population} LEFT JOIN (SELECT DISTINCT a.amino_acid AS a, b.amino_acid AS b FROM {codon_table} a JOIN {codon_table} b
 ON CAST(a.codon[1] <> b.codon[1] AS INT) + CAST(a.codon[2] <> b.codon[2] AS INT) + CAST(a.codon[3] <> b.codon[3] AS INT) = 1) s ON s.a = wild_type AND s.b = alt GROUP BY 1, 2""")
def aa_snv_pairs(t):
    """Changes of the population variants, and whether one base can cause them."""
    pairs = t["population"].groupBy(F.col("wild_type").alias("ref_aa"), F.col("alt").alias("alt_aa")).agg(F.count("*").alias("n"))
    return pairs.withColumn("by_snv", is_snv_pair(F.col("ref_aa"), F.col("alt_aa")))
