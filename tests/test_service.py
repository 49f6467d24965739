"""Lines in every notation, end to end over small written tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from genoplane import service
from genoplane.plans.browse import Request
from genoplane.sources.catalog import Catalog
from genoplane.sources.schemas import IdentifierType
from genoplane.streaming.jobs import expire


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    # codon AUG (M) at protein position 3 of P00001, forward strand, chr 1:101-103; and of P00002, reverse strand, chr 2:203-201
    base = "chromosome string, protein_position int, protein_seq string, genomic_position int, allele string, codon string, accession string, reverse_strand boolean, codon_position int, gene_name string, ensg string, enst string, is_canonical boolean, is_mane_select boolean"
    rows = [("1", 3, "M", 101, "A", "Aug", "P00001", False, 1), ("1", 3, "M", 102, "T", "aUg", "P00001", False, 2), ("1", 3, "M", 103, "G", "auG", "P00001", False, 3)]
    rows += [("2", 3, "M", 203, "T", "Aug", "P00002", True, 1), ("2", 3, "M", 202, "A", "aUg", "P00002", True, 2), ("2", 3, "M", 201, "C", "auG", "P00002", True, 3)]
    mapping = make([(*r, f"GENE{r[0]}", f"ENSG{r[0]}", f"ENST{r[0]}", True, True) for r in rows], base)
    tables = {
        "mapping": mapping,
        "dbsnp": make([("rs7", "1", 101, "A", "C,G")], "id string, chr string, pos int, ref string, alt string"),
        "clinvar_extended": make([(["RCV000000001"], "VCV000000001", "1", 102, "T", "C")], "rcvs array<string>, vcv string, chr string, pos int, ref string, alt string"),
        "cosmic": make([("COSV9", "COSM3", "2", 201, "C", "A")], "id string, legacy_id string, chr string, pos int, ref string, alt string"),
        "uniprot_refseq": make([("P00001", "NM_000001.1"), ("P00002", "NP_000002.3")], "uniprot_acc string, refseq_acc string"),
        "crossmap": make([("1", 103, "G", 1103, "G")], "chr string, grch38_pos int, grch38_base string, grch37_pos int, grch37_base string"),
        "cadd": make([("1", 101, "A", "G", 22.5)], "chromosome string, position int, reference_allele string, alt_allele string, score double"),
        "alphamissense": make([("P00001", 3, "M", "V", 0.9, 1)], "accession string, position int, wt_aa string, mt_aa string, am_pathogenicity double, am_class int"),
        "popeve": make([("NM_000001.1", 3, "M", "V", -5.5)], "refseq_protein string, position int, wt_aa string, mt_aa string, popeve double"),
    }
    return Catalog(spark, "/nowhere", tables)


LINES = {
    1: ("1-101-A-G", {("1", 101, "A", "G")}),
    2: ("1 101", {("1", 101, "A", x) for x in "CGT"}),
    3: ("chr1:102:C:A", {("1", 102, "T", "A")}),  # the reference is corrected
    4: ("rs7", {("1", 101, "A", "C"), ("1", 101, "A", "G")}),
    5: ("rcv000000001.3", {("1", 102, "T", "C")}),
    6: ("COSM3", {("2", 201, "C", "A")}),
    7: ("NM_000001.1:c.7A>G", {("1", 101, "A", "G")}),
    8: ("NP_000002.3:p.Met3Val", {("2", 203, "T", "C")}),
    9: ("P00001 M3I", {("1", 103, "G", x) for x in "ACT"}),
    10: ("P00001 3 M W", None),  # no base gives it: all are candidates
    11: ("9 5 A T", set()),
    12: ("nonsense", set()),
    13: ("NC_000001.10:g.1103G>A", {("1", 103, "G", "A")}),
}


def lines_of(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in LINES.items()], "line_no long, line string")


def test_every_notation_resolves(spark, t):
    found = {}
    for r in service.resolve_lines(lines_of(spark), t).collect():
        found.setdefault(r.line_no, set()).add((r.chromosome, r.genomic_position, r.allele, r.alt_allele))
    for k, (_, want) in LINES.items():
        assert len(found[k]) == 9 if want is None else found.get(k, set()) == want, k
    assert [r.line_no for r in service.invalid_lines(lines_of(spark)).collect()] == [12]
    assert [r.line_no for r in service.unmapped_lines(lines_of(spark), t).collect()] == [11]


def test_old_assembly_is_lifted(spark, t):
    line = spark.createDataFrame([(1, "1-1103-G-A")], "line_no long, line string")
    assert service.resolve_lines(line, t).count() == 0
    assert service.resolve_lines(line, t, "GRCH37").first().genomic_position == 103


def test_annotation_and_download(spark, t):
    row = service.Service(t).mapping("1-101-A-G").first()
    assert (row.gene_name, row.alt_aa, row.consequence, row.cadd_score, row.am_class, row.popeve) == ("GENE1", "V", "missense", 22.5, 1, -5.5)
    cells = service.download_lines(lines_of(spark), t).collect()
    assert len(cells[0]) == 44
    first = next(c for c in cells if c.User_input == "1-101-A-G")
    assert (first["popEVE_score(class)"], first["AlphaMissense_pathogenicity(class)"], first.Amino_acid_change, first.MANE_transcript) == ("-5.5(SEVERE)", "0.9(PATHOGENIC)", "Met/Val", "ENST1")
    wrong = next(c for c in cells if c.User_input == "nonsense")
    assert wrong.Notes == "ERROR:Unsupported format" and wrong.Gene == "N/A"


def test_requests(spark, t):
    s = service.Service(t)
    page = s.browse(Request(ids=[(IdentifierType.GENE, "GENE1")], cadd=["QUITE_LIKELY_DELETERIOUS"], sort="cadd", page_size=10)).collect()
    assert [(r.genomic_position, r.alt_allele) for r in page] == [(101, "G")]
    assert s.assembly_mapping(spark.createDataFrame([("1", 103)], "chr string, pos int"), 38, 37).first().to_pos == 1103
    with pytest.raises(ValueError):
        s.assembly_mapping(spark.range(1), 38, 38)


def test_requests_over_derived_tables(spark):
    s = service.Service(Catalog(spark, "/root/testdata/sf0.001"))
    feature = s.t["function_feature"].orderBy("accession", "feature_index").first()
    assert s.features(feature.accession, feature.begin_pos).count() >= 1
    record = s.function(feature.accession, feature.begin_pos).first()
    assert feature.feature_index is not None and feature.type in [f.type for f in record.features]
    pocket = s.t["pocket"].orderBy("struct_id", "pocket_id").first()
    assert s.pockets(pocket.struct_id, pocket.pocket_resid[0]).count() >= 1
    link = s.t["interfaces"].orderBy("a", "b").first()
    assert s.interactions(link.b, link.b_residues[0]).count() >= 1
    assert s.accessions("all").count() >= s.accessions("unmapped").count()
    assert s.latest_stats().count() > 0
    assert s.nearest([1.0] * len(s.t["embeddings"].first().embedding), 5).count() == 5
    f = s.t["foldx"].first()
    assert s.foldx(f.protein_acc, f.position, "middle").count() <= s.foldx(f.protein_acc, f.position).count()
    assert s.scores(f.protein_acc, f.position).count() > 0 and s.population("none", 1).first().variants == []
    assert s.allele_frequency("1", -1).count() == 0 and s.structure("none", 1).count() == 0


def test_old_jobs_expire(spark):
    now = datetime.datetime.now()
    rows = [("a", "READY", now - datetime.timedelta(days=40), 1), ("b", "READY", now, 1), ("c", "READY", now - datetime.timedelta(days=40), 1), ("c", "EXPIRED", now, 2)]
    ledger = spark.createDataFrame(rows, "job_id string, state string, changed timestamp, batch long")
    ledger = ledger.withColumn("attempt", F.lit(1))
    assert [r.job_id for r in expire(ledger).select("job_id", F.lit(1)).collect()] == ["a"]


def test_messages_of_protein_lines_reach_the_warnings(spark, t):
    lines = [(1, "P00001 3 V W"), (2, "P00001 3"), (3, "P00001 M3?"), (4, "NP_000002.9:p.Met3Val")]
    got = {}
    for r in service.resolve_lines(spark.createDataFrame(lines, "line_no long, line string"), t).collect():
        got.setdefault(r.line_no, set()).update(r.warnings)
    says = lambda k, part: any(part in w for w in got[k])
    assert says(1, "(Val) does not match the UniProt sequence (Met) at position 3") and says(1, "(Trp) cannot be caused by an SNV")
    assert says(2, "reference amino acid empty") and says(2, "variant amino acid empty")
    assert says(3, "variant amino acid unknown (?)")
    assert says(4, "NP_000002.9") and says(4, "NP_000002.3")


def test_a_bad_job_fails_alone(spark, tmp_path):
    from genoplane.streaming.jobs import job_states, read_ledger, run_jobs

    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.json").write_text('{"job_id": "good", "lines": ["x"]}\n{"job_id": "bad", "lines": ["boom"]}\n{"job_id": "long", "lines": ["a", "b", "c"]}\n')
    tried = []

    def work(lines):
        jobs = [r.line for r in lines.collect()]
        tried.append(jobs)
        if "boom" in jobs:
            raise ValueError("boom")
        return lines

    run_jobs(spark, str(tmp_path / "inbox"), str(tmp_path / "ledger"), str(tmp_path / "cp"), work, str(tmp_path / "out"), most_rows=2, attempts=3).awaitTermination()
    states = {r.job_id: (r.state, r.attempt, r.reason) for r in job_states(read_ledger(spark, str(tmp_path / "ledger"))).collect()}
    assert states == {"good": ("READY", 2, None), "bad": ("FAILED", 3, "processing failed"), "long": ("FAILED", 0, "too many lines")}
    assert tried.count(["boom"]) == 2 and [r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]
