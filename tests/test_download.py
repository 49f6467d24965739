"""Downloads line by line, their cells against texts worked out by hand, and how they are written."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from genoplane import service
from genoplane.functions import records
from genoplane.plans import export, residues
from genoplane.sources.catalog import Catalog

PUBMED = {"code": "ECO:1", "source": {"name": "PubMed", "id": "11"}}
EVIDENCES = [PUBMED, {"source": {"name": "PROSITE", "id": "PS1"}}, {"code": "ECO:2"}, {"source": {"name": "PubMed", "id": "12"}}]
HEADER = {
    "accession": "P00001", "proteinExistence": "evidence at protein level", "info": {"type": "Swiss-Prot", "modified": "2024-01-01"}, "sequence": {"length": 9, "modified": "2020-02-02", "mass": 5},
    "protein": {"recommendedName": {"fullName": {"value": "Protein one"}}, "alternativeName": [{"fullName": {"value": "a"}}, {"fullName": {"value": "b"}}]},
    "gene": [{"name": {"value": "ALPHA"}}], "dbReferences": [{"type": "Pfam", "id": "PF1"}, {"type": "PDB", "id": "1abc"}, {"type": "cath", "id": "C1"}],
    "comments": [
        {"type": "CATALYTIC_ACTIVITY", "reaction": {"dbReferences": [{"type": "ChEBI", "id": "CHEBI:1"}, {"type": "Rhea", "id": "RHEA:5"}], "evidences": [PUBMED]}},
        {"type": "CATALYTIC_ACTIVITY", "reaction": {"dbReferences": []}}, {"type": "CATALYTIC_ACTIVITY"},
        {"type": "SUBUNIT", "text": [{"value": "Homodimer. Else more."}, {"value": "unused"}]}, {"type": "SUBUNIT", "text": []},
        {"type": "SUBCELLULAR_LOCATION", "locations": [{"location": {"value": "Membrane"}, "topology": {"value": "Single-pass"}}, {"location": {"value": "Nucleus"}}]},
        {"type": "SUBCELLULAR_LOCATION", "locations": [{"location": {"value": "Golgi"}}]},
        {"type": "SIMILARITY", "text": [{"value": "Belongs to a family"}]},
        {"type": "INTERACTION", "interactions": [{"accession1": "P00001", "accession2": "Q1", "gene": "G1"}, {"accession2": "Q2", "gene": "G2"}]},
        {"type": "FUNCTION", "text": [{"value": "None of the cells."}]},
    ],
}
VARIANT = {
    "genomicLocation": ["NC_1:g.101A>G", "other"], "cytogeneticBand": "1p1", "xrefs": [{"name": "ClinVar", "id": "RCV1"}, {"name": "gnomAD", "id": "rs1"}, {"name": "Other", "id": "o"}],
    "clinicalSignificances": [{"type": "Benign", "sources": ["ClinVar", "Other"]}, {"type": "Pathogenic", "sources": ["ClinVar"]}],
    "populationFrequencies": [{"populationName": "MAF", "frequency": 0.5, "source": "gnomAD"}, {"populationName": "AFR", "frequency": 0.25, "source": "gnomAD"}],
    "association": [{"name": "disease one", "evidences": [PUBMED]}, {"name": "disease two"}],
}
IDS = "ClinVar-RCV1;Pathogenic|gnomAD-rs1;AFR:0.25|Other-o;Benign"


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    mapping = (
        "chromosome string, protein_position int, protein_seq string, genomic_position int, allele string, codon string, accession string, reverse_strand boolean, codon_position int,"
        " gene_name string, ensg string, enst string, ensp string, is_canonical boolean, is_mane_select boolean, protein_name string"
    )
    at = lambda acc, gene, enst, canonical, mane, pos=3, codon="Aug", aa="M": ("1", pos, aa, 101, "A", codon, acc, False, 1, gene, f"ENSG_{gene}", enst, enst.replace("T", "P", 1), canonical, mane, f"name {acc}")
    rows = [at("P00001", "ALPHA", "T1", True, True), at("P00001", "ALPHA", "T2", True, False), at("P00001-2", "ALPHA", "T3", False, False, 2), at("P00002", "BETA", "T4", True, False, 7)]
    variant = json.dumps(VARIANT)
    tables = {
        "mapping": make(rows, mapping),
        "crossmap": make([("1", 101, "A", 1101, "A")], "chr string, grch38_pos int, grch38_base string, grch37_pos int, grch37_base string"),
        "dbsnp": make([], "id string, chr string, pos int, ref string, alt string"),
        "clinvar_extended": make([], "rcvs array<string>, vcv string, chr string, pos int, ref string, alt string"),
        "cosmic": make([], "id string, legacy_id string, chr string, pos int, ref string, alt string"),
        "uniprot_refseq": make([("P00001", "NM_000001.1")], "uniprot_acc string, refseq_acc string"),
        "uniprot_entry": make([("P00001",)], "accession string"),
        "cadd": make([("1", 101, "A", "G", 22.5)], "chromosome string, position int, reference_allele string, alt_allele string, score double"),
        "alphamissense": make([("P00001", 3, "M", "V", 0.9, 1)], "accession string, position int, wt_aa string, mt_aa string, am_pathogenicity double, am_class int"),
        "popeve": make([("NM_000001.1", 3, "M", "V", -5.5)], "refseq_protein string, position int, wt_aa string, mt_aa string, popeve double"),
        "conserv_score": make([("P00001", 3, "M", 0.5)], "accession string, position int, aa string, score double"),
        "esm": make([("P00001", 3, "V", -7.5), ("P00001", 3, "L", -1.0)], "accession string, position int, mt_aa string, score double"),
        "eve_score": make([("P00001", 3, "V", 0.25, 1)], "accession string, position int, mt_aa string, score double, class int"),
        "m3d": make([], "uniprot_id string, pos int, mut string, prediction string, damaging_feature string"),
        "foldx": make([("P00001", 3, "AF-2", "M", "V", 1.5, 80.0), ("P00001", 3, "AF-1", "M", "V", 2.0, 70.5), ("P00001", 3, "AF-1", "M", "L", 9.0, 70.5)], "protein_acc string, position int, af_id string, wild_type string, mutated_type string, foldx_ddg double, plddt double"),
        "pocket": make([("P00001", 1, [5, 3, 4, 9], 0.5, 1.5, -2.0, 0.75, 90.0), ("P00001", 2, [3], 0.9, 1.0, -1.0, None, 80.0)], "struct_id string, pocket_id int, pocket_resid array<int>, pocket_score_combined_scaled double, pocket_rad_gyration double, pocket_energy_per_vol double, pocket_buriedness double, pocket_mean_plddt double"),
        "interfaces": make([("P00001", "P9", [3, 4], [8], 0.25), ("P8", "P00001", [1], [2, 3], 0.75), ("P7", "P00001", [3], [9], 0.99)], "a string, b string, a_residues array<int>, b_residues array<int>, pdockq double"),
        "function_header": make([("P00001", json.dumps(HEADER)), ("P00002", "{bad")], "accession string, header_json string"),
        "function_feature": make(
            [("P00001", 2, "MOD_RES", "PTM", 3, 3, "Phosphoserine", json.dumps(EVIDENCES)), ("P00001", 1, "ACT_SITE", "S", 3, 3, None, None), ("P00001", 3, "DOMAIN", "S", 1, 9, "Kinase", "[bad"), ("P00001", 4, "DISULFID", "S", 1, 9, None, None), ("P00001", 5, "VARIANT", "VARIANTS", 3, 3, "x", None)],
            "accession string, feature_index int, type string, category string, begin_pos int, end_pos int, description string, evidences_json string",
        ),
        "population": make([("P00001", 3, "M", "V", True, "x", variant), ("P00001", 3, "M", "V", True, "x", json.dumps({"xrefs": []})), ("P00001", 3, "M", "L", False, "x", variant), ("P00001", 3, "M", "K", False, "x", "{bad"), ("P00001", 3, "M", "K", False, "x", None)], "accession string, position int, wild_type string, alt string, disease boolean, clin_sig string, raw_json string"),
        "gnomad_allele_freq": make([("1", 101, "A", "G", 3, 50000, 6.0e-5)], "chr string, pos int, ref string, alt string, ac int, an int, af double"),
        "structure_regions": make([("P00001", "1abc", "B", 1, 9, 101, [[1, 9]], 2.5, "X-ray"), ("P00001", "1abc", "A", 1, 9, 1, [[1, 2], [3, 3]], 2.5, "X-ray"), ("P00001", "2xyz", "A", 1, 9, 1, [[5, 9]], 1.0, "NMR")], "accession string, pdb_id string, chain_id string, unp_start int, unp_end int, pdb_start int, observed_regions array<array<int>>, resolution double, experimental_method string"),
    }
    return Catalog(spark, "/nowhere", tables)


LINES = ["1-101-A-G", "1 101 my.id A G", "nonsense", "9 5 A T", "rs404", "P00001 M3V", "NM_000009.1:c.7A>G", "A0A024R1R8 3", "NC_000001.10:g.55A>T", "1-101-A-G", "NC_000001.10:g.1101A>G", "RCV000000009", "COSM5"]


def lines_of(spark, texts=LINES):
    # Numbers run against the order of rows, and rows are dealt to partitions.
    return spark.createDataFrame([(10 * k, x) for k, x in reversed(list(enumerate(texts)))], "line_no long, line string").repartition(3)


@pytest.fixture(scope="module")
def rows(spark, t):
    return service.download_lines(lines_of(spark), t).collect()


def test_every_line_comes_out_in_order(rows):
    assert [r.User_input for r in rows] == LINES
    assert len(rows[0]) == 44 and rows[0].__fields__ == export.HEADER


def test_notes_say_what_became_of_a_line(rows):
    assert [r.Notes for r in rows] == [
        "N/A", "N/A", "ERROR:Unsupported format", "No mapping found", "ERROR:No mapping found for dbSNP ID.", "N/A",
        "WARN:Could not map RefSeq ID to a Uniprot protein.;ERROR:Could not map cDNA input to genomic coordinate(s). ",
        "ERROR:A0A024R1R8 is not a human UniProt accession. ;ERROR:Could not map protein input to genomic coordinate(s). ",
        "ERROR:Unable to map GRCh37 to GRCh38 coordinate.", "N/A", "N/A", "ERROR:No mapping found for ClinVar ID.", "ERROR:No mapping found for COSMIC ID.",
    ]
    place = lambda r: (r.Chromosome, r.Coordinate, r.ID, r.Reference_allele, r.Alternative_allele)
    assert place(rows[1]) == ("1", "101", "my.id", "A", "G") and place(rows[2]) == ("N/A",) * 5
    assert place(rows[3]) == ("9", "5", "N/A", "A", "T") and place(rows[4]) == ("N/A", "N/A", "rs404", "N/A", "N/A")
    assert place(rows[8]) == ("1", "55", "N/A", "A", "T") and place(rows[10]) == ("1", "101", "N/A", "A", "G")
    assert all(set(r[7:]) == {"N/A"} for r in (rows[2], rows[3], rows[4]))


def test_cells_by_hand(rows):
    assert dict(zip(export.HEADER[7:], rows[0][7:], strict=True)) == {
        "Gene": "ALPHA", "Codon_change": "Aug/Gug", "Strand": "+", "CADD_phred_like_score": "22.5", "Canonical_isoform_transcripts": "[P1(T1), P2(T2)]", "MANE_transcript": "T1",
        "Uniprot_canonical_isoform_(non_canonical)": "P00001", "Alternative_isoform_mappings": "P00001-2;2;Met/Val;missense;[P3(T3)]", "Protein_name": "name P00001", "Amino_acid_position": "3",
        "Amino_acid_change": "Met/Val", "Consequences": "missense",
        "Residue_function_(evidence)": "ACT_SITE|MOD_RES-Phosphoserine(PROSITE:[PS1]PubMed:[11,12])", "Region_function_(evidence)": "DOMAIN-Kinase;Range:1-9",
        "Protein_existence_evidence": "evidence at protein level", "Protein_length": "9", "Entry_last_updated": "2024-01-01", "Sequence_last_updated": "2020-02-02",
        "Protein_catalytic_activity": "RHEA:5(PubMed:[11])|", "Protein_complex": "Homodimer", "Protein_sub_cellular_location": "Membrane;Nucleus(Single-pass)|Golgi", "Protein_family": "Belongs to a family",
        "Protein_interactions_PROTEIN(gene)": "Q1(G1);Q2(G2)",
        "Predicted_pockets(energy;per_vol;score;resids)": "pocket_id:2;rad_gyration:1.0;energy_per_vol:-1.0;buriedness:N/A;resid:3;mean_plddt:80.0;score:0.9|pocket_id:1;rad_gyration:1.5;energy_per_vol:-2.0;buriedness:0.75;resid:3-5 9;mean_plddt:90.0;score:0.5",
        "Predicted_interactions(chainA-chainB;a_resids;b_resids;pDockQ)": "P8-P00001;A residues:1;B residues:2-3;pDockQ:0.75|P00001-P9;A residues:3-4;B residues:8;pDockQ:0.25",
        "Foldx_prediction(foldxDdg;plddt)": "foldxDdg:2.0;plddt:70.5|foldxDdg:1.5;plddt:80.0", "Conservation_score": "0.5", "AlphaMissense_pathogenicity(class)": "0.9(PATHOGENIC)", "popEVE_score(class)": "-5.5(SEVERE)", "ESM1b_score": "-7.5",
        "Gnomad_allele_freq(ac;an;af)": "3;50000;6.0E-5", "Genomic_location": "NC_1:g.101A>G|N/A", "Cytogenetic_band": "1p1|N/A", "Other_identifiers_for_the_variant": f"{IDS}|N/A",
        "Diseases_associated_with_variant": "disease one-(PubMed:[11])|disease two-|N/A", "Variants_colocated_at_residue_position": f"[Met>Leu;NC_1:g.101A>G;1p1;{IDS}]", "Position_in_structures": "1abc;A3,B103;2.5;X-ray",
    }


def test_one_gene_is_chosen_or_every_gene_has_its_row(spark, t, rows):
    assert [r.Gene for r in rows if r.User_input == "1-101-A-G"] == ["ALPHA", "ALPHA"]  # the same line twice
    both = service.download_lines(lines_of(spark, LINES[:1]), t, every_gene=True).collect()
    assert [(r.Gene, r.Amino_acid_position, r.Alternative_isoform_mappings) for r in both] == [("ALPHA", "3", "P00001-2;2;Met/Val;missense;[P3(T3)]"), ("BETA", "7", "N/A")]
    assert both[1].Protein_existence_evidence == "N/A"  # its header is bad JSON


def test_detected_assembly_is_told(spark, t):
    got = service.download_lines(lines_of(spark, ["1-1101-A-G"]), t, "AUTO").collect()
    assert [(r.Coordinate, r.Gene, r.Notes) for r in got] == [("101", "ALPHA", "INFO:Genomic variants assembly predicted to be GRCh37 (100.00% GRCh37, 0.00% GRCh38 matches)")]
    unsure = service.download_lines(lines_of(spark, ["2-7-A-G"]), t, "AUTO").collect()
    assert unsure[0].Notes.startswith("WARN:Unable to predict which genome assembly was inputted (0.00% GRCh38, 0.00% GRCh37 matches)") and unsure[0].Notes.endswith(";No mapping found")


def test_no_lines_give_the_header_only(spark, t, tmp_path):
    service.write_download(lines_of(spark, LINES[:1]).limit(0), t, str(tmp_path / "none.csv.gz"), single_file=True)
    assert gzip.open(tmp_path / "none.csv.gz", "rt").read() == ",".join(f'"{c}"' for c in export.HEADER) + "\n"


@pytest.fixture
def apart(spark):
    """Small parts are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_file_is_in_order_and_parts_are_bounded(spark, tmp_path, apart):
    made = spark.range(5000).select((4999 - F.col("id")).alias("line_no"), F.lit(1).alias("seq"), F.concat(F.lit('a "quoted", '), F.col("id").cast("string")).alias("cell")).repartition(7)
    path = str(tmp_path / "one.csv.gz")
    export.write_csv(made, path, ["line_no", "seq"], single_file=True)
    lines = gzip.open(path, "rt").read().splitlines()
    assert lines == ['"cell"'] + [f'"a ""quoted"", {4999 - k}"' for k in range(5000)]
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["one.csv.gz"]
    export.write_csv(made, str(tmp_path / "parts"), ["line_no", "seq"])
    parts = sorted((tmp_path / "parts").glob("part-*"))
    counts = [len(gzip.open(p, "rt").read().splitlines()) for p in parts]
    assert len(parts) > 1 and max(counts) < 4000
    with pytest.raises(ValueError, match="more than 10 rows"):
        export.write_csv(made, str(tmp_path / "many.csv.gz"), ["line_no", "seq"], single_file=True, most_joined=10)


def test_answers_of_a_residue(spark, t):
    s = service.Service(t)
    r = s.function("P00001", 3, "V").first()
    assert (r.name, r.alternative_names, r.entry_type, r.last_updated, r.sequence.length, r.genes) == ("Protein one", "a;b", "Swiss-Prot", "2024-01-01", 9, ["ALPHA"])
    assert [x.id for x in r.references] == ["PF1", "C1"] and len(r.comments) == len(HEADER["comments"])
    assert [(f.type, len(f.evidences)) for f in r.features] == [("ACT_SITE", 0), ("MOD_RES", 4), ("DOMAIN", 0), ("VARIANT", 0)]
    assert ([p.pocket_id for p in r.pockets], [i.a for i in r.interactions], [x.af_id for x in r.foldx]) == ([2, 1], ["P8", "P00001"], ["AF-1", "AF-2"])
    assert (r.conservation, r.esm, r.popeve, r.eve.score, r.alphamissense.am_class, r.m3d) == (0.5, -7.5, -5.5, 0.25, 1, None)
    assert s.function("P00001", 3).first().esm is None and s.function("P9", 1).first().features == []
    p = s.population("P00001", 3, "1", 101, "g").first()
    assert [(v.wild_type, v.alt) for v in p.variants] == [("Met", "Leu"), ("Met", "Val"), ("Met", "Val")] and p.frequencies["G"].ac == 3
    assert s.population("P00001", 3, "1", 101, "T").first().frequencies == {} and set(s.population("P00001", 3, "1", 101).first().frequencies) == {"G"}
    some = spark.createDataFrame([("1", 101), ("2", 5)], "chromosome string, genomic_position int")
    assert sorted((r.chromosome, r.ac) for r in s.allele_frequencies(some).collect()) == [("1", 3), ("2", None)]


def test_many_and_few_residues_have_the_same_facts(spark, t, monkeypatch):
    asked = spark.createDataFrame([("P00001", 3), ("P00001", 5), ("P9", 1)], "accession string, protein_position int")
    few = sorted(map(repr, residues.facts(asked, t).collect()))
    monkeypatch.setattr("genoplane.operators.narrow.MOST_KEYS", 1)
    assert sorted(map(repr, residues.facts(asked, t).collect())) == few and len(few) == 3


def test_records_of_bad_texts(spark):
    texts = spark.createDataFrame([("{bad",), (None,), ("{}",), ("[]",), ('{"comments": [{"type": "SIMILARITY", "text": "no list"}]}',)], "x string")
    got = texts.select(records.header(F.col("x")).alias("h"), records.evidences(F.col("x")).alias("e")).collect()
    assert [r.h is None for r in got] == [True, True, False, True, False] and all(r.e is not None for r in got)
