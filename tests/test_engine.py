"""Operators and plans: invariants, plans without pair comparison, and agreement with DuckDB."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from genoplane import queries
from genoplane.functions import codon
from genoplane.operators import filters as flt
from genoplane.operators import paging
from genoplane.operators import variants as var
from genoplane.operators.groupwise import latest_per_key
from genoplane.operators.vector import nearest, search_text
from genoplane.plans import annotate, browse, export, resolve
from genoplane.sources import fixtures, schemas
from genoplane.sources.catalog import Catalog
from genoplane.sources.schemas import Assembly, IdentifierType
from genoplane.sources.text_input import checksum, read_lines, store_upload
from genoplane.streaming.jobs import run_jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
queries.load()


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    """The derived tables, written once."""
    folder = tmp_path_factory.mktemp("tables")
    derived = Catalog(spark, SF)
    for name in fixtures.TABLES:
        derived[name].coalesce(1).write.parquet(str(folder / name))
    return Catalog(spark, SF, {name: str(folder / name) for name in fixtures.TABLES})


@pytest.fixture(scope="module")
def duck(t):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, path in t.given.items():
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{path}/*.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else round(float(value), 9)
    return str(value)


def same_rows(got, result):
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["mapping", "dbsnp", "popeve", "structure_regions", "clinvar_extended", "stats"])
def test_derived_tables_match_sql(t, name):
    con = duckdb.connect()
    for base in ("orders", "customer", "events"):
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{SF}/{base}.parquet'")
    same_rows(t[name], con.execute(fixtures.duckdb_query(f"SELECT * FROM {{{name}}}")))


@pytest.mark.parametrize("name", sorted(queries.TEXTS))
def test_query_matches_sql(t, duck, name):
    same_rows(queries.FUNCTIONS[name](t), duck.execute(fixtures.duckdb_text(queries.TEXTS[name])))


@pytest.mark.parametrize("name", ["filter_cadd_bands", "browse_gene_filtered", "annotate_variant_core"])
def test_registered_query_matches_registered_sql(spark, name):
    con = duckdb.connect()
    for base in ("orders", "customer", "events"):
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{SF}/{base}.parquet'")
    same_rows(queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name]))


def test_codon_matrix():
    classes = [codon.changed_bases(a, b) for a in codon.CODONS for b in codon.CODONS]
    assert [classes.count(k) for k in (0, 1, 2, 3)] == [64, 576, 1728, 1728]


def test_three_alternates_each(t):
    rows = var.expand(t["mapping"])
    assert rows.count() == 3 * t["mapping"].count()
    assert rows.filter("allele = alt_allele OR alt_aa IS NULL OR consequence IS NULL").count() == 0


def test_repeated_scores_count_once(spark):
    rows = spark.createDataFrame([("1", 5, "A", "T", 3.0), ("1", 5, "A", "T", 3.0), ("1", 5, "A", "C", 1.0)], "chromosome string, position int, reference_allele string, alt_allele string, score double")
    assert sorted((r.alt_allele, r.score) for r in var.unique_cadd(rows).collect()) == [("C", 1.0), ("T", 3.0)]


def test_strands(spark):
    df = spark.createDataFrame([("T", True), ("T", False), ("C", True)], "b string, r boolean")
    assert [r[0] for r in df.select(codon.rna_base(F.col("b"), F.col("r"))).collect()] == ["A", "U", "G"]


def test_pages_make_up_the_whole(t):
    rows = var.expand(t["mapping"]).filter("gene_name = 'GENE7'").select("protein_position", "codon_position", "alt_allele", "chromosome", "genomic_position", "allele", "accession")
    whole = [tuple(r) for r in rows.orderBy(*paging.ordering()).collect()]
    size = 50
    pages = [tuple(r) for k in range(1, len(whole) // size + 3) for r in paging.page(rows, paging.ordering(), k, size).collect()]
    assert pages == whole and len(whole) > size


def test_bounded_counts(spark):
    assert tuple(paging.bounded_count(spark.range(100), 10).first()) == (10, True)
    assert tuple(paging.bounded_count(spark.range(7), 10).first()) == (7, False)
    assert paging.timed_count(spark.range(50), 20, 60) == 21
    slow = spark.range(0, 10**10, 1, 8).filter("pmod(xxhash64(id), 1000000007) = 3").select(F.sha2(F.col("id").cast("string"), 512))
    assert paging.timed_count(slow, 10**9, 0.5) == paging.UNKNOWN_COUNT


def test_requests_are_validated():
    ok = dict(ids=[(IdentifierType.GENE, "GENE1")])
    browse.Request(**ok).validate()
    for wrong in ({}, {**ok, "page": 0}, {**ok, "page_size": 5}, {**ok, "conservation": (2, None)}, {**ok, "sort": "x"}, {**ok, "cadd": ["NONE"]}, {"cadd": ["LIKELY_BENIGN"]}, {**ok, "positions": (0, 3)}):
        with pytest.raises(ValueError):
            browse.Request(**wrong).validate()
    assert browse.Request(**ok, positions=(1, 2)).warnings() and not browse.Request(ids=[(IdentifierType.UNIPROT, "P1")], positions=(1, 2)).warnings()
    assert schemas.parse_category(1, schemas.AM_CLASSES) == "PATHOGENIC" and Assembly.of(None).name == "AUTO" and Assembly.of("h37").name == "GRCH37"


def test_unparsable_ensembl_ids_find_nothing(t):
    for identifier in ("ENSE00000000001", "nonsense"):
        assert browse.by_ensembl(t["mapping"], [identifier]).count() == 0


def test_strategies_equal_the_naive_plan(t):
    naive = flt.known_variants(var.expand(t["mapping"].filter("is_canonical")), t["mapping_dbsnp_lookup"])
    assert browse.browse(t, browse.Request(known=True)).select(*var.VARIANT_KEY).distinct().count() == naive.select(*var.VARIANT_KEY).distinct().count()
    page = browse.browse_page(t, browse.Request(known=True, pocket=True, sort="cadd", page_size=10))
    assert page.count() <= 10 and "cadd_score" in page.columns


@pytest.mark.parametrize("name", ["filter_interact", "batch_interactions", "filter_feature_groups", "filter_experimental_model", "browse_pdb", "filter_known_array", "strategy2_features", "population_colocated"])
def test_no_pairwise_joins(t, name):
    plan = queries.FUNCTIONS[name](t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(t):
    rows = t["mapping"].filter("gene_name = 'GENE7'").select("accession", "gene_name")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gene_name,GENE7)" in plan and "ReadSchema: struct<accession:string,gene_name:string>" in plan


def test_gene_choice_rules(spark):
    rows = spark.createDataFrame([(1, "ENSG2", True, False), (1, "ENSG1", False, True), (1, "ENSG3", True, True), (2, "ENSG9", False, False), (2, "ENSG8", False, True), (3, "ENSG5", False, False), (3, "ENSG4", False, False)], "locus int, ensg string, is_canonical boolean, is_mane_select boolean")
    assert {(r.locus, r.ensg) for r in annotate.gene_choice(rows, ["locus"]).collect()} == {(1, "ENSG3"), (2, "ENSG8"), (3, "ENSG4")}


def test_alt_base_messages(spark):
    rows = spark.createDataFrame([("A", "G", "A"), ("C", "G", "A"), ("A", "a", "A"), ("A", None, "A"), (None, None, "A")], "ref string, alt string, mapping_ref string")
    got = [(sorted(r.alts), r.warnings) for r in resolve.resolve_alt_bases(rows).collect()]
    every = ["C", "G", "T"]
    assert got == [(["G"], []), (["G"], [resolve.REF_MISMATCH % ("C", "A")]), (every, [resolve.SAME_ALLELES]), (every, [resolve.ALT_EMPTY]), (every, [resolve.REF_EMPTY])]


def test_protein_messages(spark):
    rows = spark.createDataFrame([(7, "M", "M", "V", False), (7, "M", "A", "W", False), (7, "M", None, None, False), (7, "M", "M", None, True)], "p int, s string, r string, a string, u boolean")
    got = [[m.code for m in r[0]] for r in rows.select(resolve.protein_messages(*map(F.col, "psrau"))).collect()]
    assert got == [[], ["100", "102"], ["101", "103"], ["104"]]


def test_refseq_versions(spark):
    refseq = spark.createDataFrame([("P2", "NM_1.2"), ("P1", "NM_1.2"), ("P9", "NM_1.3"), ("P3", "NM_7.1")], "uniprot_acc string, refseq_acc string")
    asked = spark.createDataFrame([("NM_1.2",), ("NM_1.9",), ("NM_7",), ("NM_5.1",)], "refseq_id string")
    got = {r.refseq_id: (r.acc, r.n_proteins, r.other_version) for r in resolve.refseq_to_accession(asked, refseq).collect()}
    assert got == {"NM_1.2": ("P1", 2, None), "NM_1.9": ("P1", 2, "NM_1.2"), "NM_7": ("P3", 1, "NM_7.1"), "NM_5.1": (None, 0, None)}


def test_assembly_detection(spark):
    cross = spark.createDataFrame([("1", k, "A", k + 1000, "C") for k in range(1, 40)], "chr string, grch38_pos int, grch38_base string, grch37_pos int, grch37_base string")
    on38 = spark.createDataFrame([("1", k, "A") for k in range(1, 30)], "chr string, pos int, ref string")
    on37 = spark.createDataFrame([("1", k + 1000, "C") for k in range(1, 30)], "chr string, pos int, ref string")
    neither = spark.createDataFrame([("9", 5, None)], "chr string, pos int, ref string")
    assert tuple(resolve.detect_build(on38, cross).first()) == ("GRCh38", 100, 0, True)
    assert tuple(resolve.detect_build(on37, cross).first()) == ("GRCh37", 0, 100, True)
    assert tuple(resolve.detect_build(neither, cross).first()) == ("GRCh38", 0, 0, False)
    assert {r.message for r in resolve.assembly_mapping(neither.select("chr", "pos"), cross).collect()} == {"No mapping found"}


def test_latest_keeps_ties(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("b", 4, 1)], "key string, value int, created int")
    assert sorted(r.value for r in latest_per_key(rows).collect()) == [2, 3, 4]


def test_nearest_matches_brute_force(spark):
    rng = random.Random(1)
    data = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)]
    asked = [rng.gauss(0, 1) for _ in range(8)]
    dist = lambda v: 1 - sum(a * b for a, b in zip(v, asked)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in asked))
    vectors = spark.createDataFrame(data, "vec_id int, embedding array<float>")
    got = [r.vec_id for r in nearest(vectors, asked, 5, 3).collect()]
    assert got == [k for k, v in sorted(data, key=lambda x: dist(x[1]))][3:8]
    with pytest.raises(ValueError):
        nearest(vectors, asked, 0)
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "id int, source_text string")
    found = search_text(vectors.withColumnRenamed("vec_id", "text_id"), texts, "query", lambda _: asked, limit=3).collect()
    assert [r.id for r in found] == [k for k, v in sorted(data, key=lambda x: dist(x[1]))][:3]


def test_uploads(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# note\n1 2 A, 3 4 C \r\n\nrs1\n")
    assert sorted(r.line for r in read_lines(spark, str(tmp_path / "in.txt")).collect()) == ["1 2 A", "3 4 C", "rs1"]
    texts = spark.createDataFrame([("a,b\n#c",), ("a\nb",), ("z",)], "value string")
    made = store_upload(texts, str(tmp_path / "uploads")).collect()
    assert len({r.upload_id for r in made}) == 2
    assert spark.range(1).select(checksum(F.array(F.lit("jk8ssl")))).first()[0] == "18e6137ac2caab16074784a6"


def test_csv(spark, t, tmp_path):
    assert len(export.HEADER) == 44
    core = annotate.annotate_core(var.expand(t["mapping"].filter("gene_name = 'GENE7'")), t)
    rows = export.csv_rows(core)
    assert rows.columns == export.HEADER
    export.write_csv(rows, str(tmp_path / "out.csv.gz"), single_file=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "out.csv.gz"))
    assert back.count() == rows.count() and back.columns == export.HEADER
    assert annotate.nested_genes(core).filter("size(genes) >= 1").count() == core.select(*var.VARIANT_KEY).distinct().count()


def test_json_features(spark):
    rows = spark.createDataFrame([("SITE", 3, 4, '{"description": "d", "begin": 9}'), (None, None, 4, "{bad"), (None, 1, 2, None)], "type string, begin_pos int, end_pos int, raw_json string")
    got = [tuple(r.feature) for r in annotate.merge_json_features(rows).collect()]
    assert got == [("SITE", "d", 3, 4), (None, None, None, 4), (None, None, 1, 2)]


def test_jobs_run_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"job_id": "j1", "lines": ["1 5 A", "rs1"]}\n{"job_id": "j1", "lines": ["1 5 A", "rs1"]}\n')
    go = lambda: run_jobs(spark, str(inbox), str(tmp_path / "ledger"), str(tmp_path / "cp"), lambda x: x.withColumn("n", F.length("line")), str(tmp_path / "out")).awaitTermination()
    go()
    (inbox / "b.json").write_text('{"job_id": "j1", "lines": ["other"]}\n{"job_id": "j2", "lines": ["x"]}\n')
    go()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.job_id, r.line) for r in out) == [("j1", "1 5 A"), ("j1", "rs1"), ("j2", "x")]
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "ledger")).filter("state = 'READY'").collect()) == ["j1", "j2"]


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
