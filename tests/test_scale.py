"""Plans and joins that must hold at any size: few inputs against large tables, ranges by bins, jobs over crashes, sweeps."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from genoplane import queries, service
from genoplane.operators import filters, intervals, narrow
from genoplane.operators import variants as var
from genoplane.plans import annotate, browse, export, lines, residues, resolve
from genoplane.sources import fixtures
from genoplane.sources.catalog import Catalog
from genoplane.sources.schemas import RESIDUE_TABLES
from genoplane.streaming import jobs

SF = "/root/testdata/sf0.001"
#: Tables sorted by place or by residue, as a release is loaded, in small row groups.
ORDER = {"mapping": ["chromosome", "genomic_position"], "cadd": ["chromosome", "position"], "alphamissense": ["accession", "position"], "popeve_by_accession": ["accession", "position"], "gnomad_allele_freq": ["chr", "pos"]}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder, made = tmp_path_factory.mktemp("release"), Catalog(spark, SF)
    given = {}
    for name, order in ORDER.items():
        given[name] = str(folder / name)
        made[name].orderBy(*order).coalesce(1).sortWithinPartitions(*order).write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).option("parquet.block.size.row.check.min", 10).parquet(given[name])
    return Catalog(spark, SF, given)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df, table):
    """Rows that the scans of a stored table gave out in all jobs of df, from the final plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and f"/{table}" in node.toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_one_line_leaves_no_exchange_of_a_large_table(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = stored["mapping"].filter("is_canonical").select("chromosome", "genomic_position", "allele", F.when(F.col("allele") == "A", "T").otherwise("A").alias("alt_allele")).first()
        variants = spark.createDataFrame([(1, *v)], "line_no long, chromosome string, genomic_position int, allele string, alt_allele string")
        cut_down = annotate.narrowed(stored, variants)
        core = annotate.annotate_core(variants, cut_down, ["line_no"])
        assert core.count() >= 1
        plan = plan_of(core)
        assert not re.search(r"SortMergeJoin|ShuffledHashJoin", plan)
        # The only rows that are dealt out are those of the request.
        for scan in re.split(r"(?=Exchange )", plan)[1:]:
            assert "cadd" not in scan.split("Scan parquet")[-1][:200] or "BroadcastExchange" in scan
        whole = spark.read.parquet(stored.given["cadd"]).count()
        assert 0 < rows_scanned(cut_down["cadd"], "cadd") < whole / 5
        assert 0 < rows_scanned(narrow.Keys(variants, "chromosome", "genomic_position").cut(stored["mapping"], "chromosome", "genomic_position"), "mapping") < stored["mapping"].count() / 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("request_of", [{"cadd": ["PROBABLY_DELETERIOUS"], "sort": "am"}, {"known": True, "allele_frequency": ["COMMON"], "sort": "cadd"}, {"conservation": (0.2, None), "stability": ["LIKELY_DESTABILISING"], "sort": "popeve"}, {"esm1b": (None, -1.0), "disease": True}])
def test_a_gene_reads_its_ranges_of_the_scores(stored, monkeypatch, request_of):
    request = browse.Request(ids=[("gene", "GENE7")], **request_of).validate()
    rows = browse.browse(stored, request)
    got = sorted(map(repr, rows.collect()))
    if "cadd" in (*request_of, request_of.get("sort")):
        assert 0 < rows_scanned(rows, "cadd") < stored["cadd"].count() / 2
    monkeypatch.setattr(narrow, "MOST_NAMES", 0)  # more names than that: nothing is cut down
    assert sorted(map(repr, browse.browse(stored, request).collect())) == got


def test_ranges_of_names(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 5, "x", 1), ("a", 2, "y", 9), ("b", 7, "x", 3), (None, 4, "z", 4), ("c", None, None, 2)], "n string, p int, m string, q int")
    by_n, by_m = narrow.ranges(rows, ("n", "p"), ("m", "q"))
    assert by_n == {"a": (2, 5), "b": (7, 7)} and by_m == {"x": (1, 3), "y": (9, 9), "z": (4, 4)}
    table = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 8), (None, 3), ("c", 2)], "n string, p int")
    assert sorted(tuple(r) for r in narrow.within(table, "n", "p", by_n).collect()) == [("a", 2), ("a", 5)]
    assert narrow.within(table, "n", "p", {}).count() == 0 and narrow.within(table, "n", "p", None).count() == 6
    monkeypatch.setattr(narrow, "MOST_NAMES", 4)
    assert narrow.ranges(rows, ("n", "p"), ("m", "q")) == [None, None]


def test_few_and_many_inputs_give_the_same(spark, stored, monkeypatch):
    texts = [r.line for r in stored["input_lines"].orderBy("line_no").limit(60).collect()]
    given = spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")
    few = sorted(map(repr, service.annotate_lines(given, stored).collect()))
    monkeypatch.setattr(narrow, "MOST_KEYS", 3)
    assert sorted(map(repr, service.annotate_lines(given, stored).collect())) == few and len(few) > 20


@pytest.mark.parametrize("listed,names", [(200, 50), (5, 50), (5, 2), (5, 0)])
def test_keys_cut_alike_in_every_form(spark, monkeypatch, listed, names):
    monkeypatch.setattr(narrow, "MOST_LISTED", listed)
    monkeypatch.setattr(narrow, "MOST_NAMES", names)
    table = spark.createDataFrame([(f"n{k % 7}", k, "v") for k in range(300)] + [(None, 1, "v"), ("n1", None, "v")], "name string, number int, other string")
    wanted = [("n1", 8), ("n1", 15), ("n2", 2), ("n2", 200), ("n3", 3), ("n4", 4), ("n4", 5), (None, 1), ("n1", None), ("nope", 1)]
    asked = spark.createDataFrame(wanted, "a string, b int")
    expect = sorted((n, k) for n, k in wanted if n is not None and k is not None and n == f"n{k % 7}" and k < 300)
    for most in (0, 100):
        keys = narrow.Keys(asked, "a", "b", most)
        assert keys.small == (most == 100)
        assert sorted((r.name, r.number) for r in keys.cut(table, "name", "number").collect()) == expect
    none = narrow.Keys(asked.limit(0), "a", "b")
    assert none.small and none.cut(table, "name", "number").count() == 0


def test_ranges_by_bins_are_the_naive_join(spark):
    rng = random.Random(3)
    widths = [0, 1, 63, 64, 65, 4000, 4095 * 64, 300_000, 20_000_000]
    ranges = [(rng.choice("ab"), k, b, b + rng.choice(widths) - (k % 50 == 0)) for k in range(400) for b in [rng.randrange(-300, 400_000)]]
    points = [(rng.choice("abc"), p) for p in [rng.randrange(-300, 500_000) for _ in range(300)] + [0, 63, 64, 4096, 262_144, 19_000_000]]
    expect = sorted((n, p, k) for n, p in points for m, k, b, e in ranges if n == m and b <= p <= e)
    frames = spark.createDataFrame(points, "key string, p int"), spark.createDataFrame(ranges, "key string, id int, b int, e int")
    got = intervals.join_ranges(*frames, "key", "p", "b", "e")
    assert sorted((r.key, r.p, r.id) for r in got.collect()) == expect
    held = sorted((r.key, r.p) for r in intervals.within_ranges(*frames, "key", "p", "b", "e").collect())
    assert held == sorted((n, p) for n, p in points if any(n == m and b <= p <= e for m, _, b, e in ranges))


def test_a_hot_key_is_spread_over_bins(spark):
    ranges = spark.range(2000).select(F.lit("hot").alias("key"), (F.col("id") * 20).alias("b"), (F.col("id") * 20 + 30).alias("e"))
    points = spark.range(40_000).select(F.lit("hot").alias("key"), F.col("id").alias("p"))
    dealt = intervals.binned_points(points, "p").join(intervals.binned_ranges(ranges, "b", "e"), ["key", "__level", "__bin"])
    # Pairs that meet: a few for each point, not two thousand.
    assert dealt.count() < 40_000 * 12
    assert "__bin" in plan_of(dealt.filter("p BETWEEN b AND e"))


def test_liftover_groups_only_what_is_asked(spark, stored):
    asked = spark.createDataFrame([("1", 5)], "chr string, pos int")
    from genoplane.plans import resolve

    assert resolve.liftover(asked, stored["crossmap"]).first().lifted is False
    assert resolve.assembly_mapping(asked, stored["crossmap"], 38).first().message == "No mapping found"


# jobs


def requests(tmp_path, *ids):
    (tmp_path / "inbox").mkdir(exist_ok=True)
    (tmp_path / "inbox" / f"{len(os.listdir(tmp_path / 'inbox'))}.json").write_text("".join(json.dumps({"job_id": i, "lines": [f"{i} 1", f"{i} 2"]}) + "\n" for i in ids))


def run(spark, tmp_path, work=lambda x: x):
    jobs.run_jobs(spark, *(str(tmp_path / d) for d in ("inbox", "ledger", "checkpoint")), work, str(tmp_path / "out")).awaitTermination()


def states(spark, tmp_path):
    return {r.job_id: (r.state, r.attempt, r.reason) for r in jobs.job_states(jobs.read_ledger(spark, str(tmp_path / "ledger"))).collect()}


def crash_on(monkeypatch, state):
    real = jobs.append

    def append(rows, ledger, to, *args, **more):
        if to == state:
            raise RuntimeError("the process dies")
        real(rows, ledger, to, *args, **more)

    monkeypatch.setattr(jobs, "append", append)
    return lambda: monkeypatch.setattr(jobs, "append", real)


def test_a_crash_between_output_and_ledger(spark, tmp_path, monkeypatch):
    requests(tmp_path, "a", "b")
    mend = crash_on(monkeypatch, "READY")
    with pytest.raises(Exception, match="dies"):
        run(spark, tmp_path)
    assert states(spark, tmp_path) == {"a": ("PROCESSING", 1, None), "b": ("PROCESSING", 1, None)}
    mend()
    requests(tmp_path, "a", "c")
    run(spark, tmp_path)
    assert states(spark, tmp_path) == {"a": ("READY", 2, None), "b": ("READY", 2, None), "c": ("READY", 1, None)}
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.line for r in out) == ["a 1", "a 2", "b 1", "b 2", "c 1", "c 2"]


def test_attempts_hold_over_restarts(spark, tmp_path, monkeypatch):
    requests(tmp_path, "poison")
    mend = crash_on(monkeypatch, "READY")
    for _ in range(3):
        with pytest.raises(Exception, match="dies"):
            run(spark, tmp_path)
    assert states(spark, tmp_path)["poison"] == ("PROCESSING", 3, None)
    mend()
    tried = []
    run(spark, tmp_path, lambda x: tried.append(x.count()) or x)
    assert states(spark, tmp_path)["poison"] == ("FAILED", 3, "attempts exhausted") and sum(tried) == 0


def test_sweep_of_jobs_and_files(spark, tmp_path, monkeypatch):
    requests(tmp_path, "old", "new=1")
    run(spark, tmp_path)
    ledger, out = str(tmp_path / "ledger"), str(tmp_path / "out")
    assert jobs.sweep_jobs(spark, ledger, out, days=1) == jobs.Swept(0, 0)
    # As if a job had ended long ago.
    aged = jobs.read_ledger(spark, ledger).withColumn("changed", F.when(F.col("job_id") == "old", F.col("changed") - F.make_interval(days=F.lit(40))).otherwise(F.col("changed")))
    aged.coalesce(1).write.parquet(str(tmp_path / "aged"))
    mend = crash_on(monkeypatch, "EXPIRED")
    with pytest.raises(RuntimeError):
        jobs.sweep_jobs(spark, str(tmp_path / "aged"), out)
    mend()
    assert sorted(os.listdir(out))[-1] == "job_id=new%3D1" and "job_id=old" not in os.listdir(out)
    assert jobs.sweep_jobs(spark, str(tmp_path / "aged"), out) == jobs.Swept(0, 0)
    assert [r.job_id for r in jobs.read_ledger(spark, str(tmp_path / "aged")).filter("state = 'EXPIRED'").collect()] == ["old"]
    assert jobs.sweep_jobs(spark, str(tmp_path / "aged"), out) == jobs.Swept(0, 0)
    assert jobs.job_states(jobs.read_ledger(spark, str(tmp_path / "aged"))).filter("job_id = 'old'").first().state == "EXPIRED"
    again = jobs.sweep_jobs(spark, ledger, out, days=0)
    assert again.items == 1 and again.bytes > 0 and not [x for x in os.listdir(out) if x.startswith("job_id")]

    folder = tmp_path / "downloads"
    (folder / "x.csv.gz").mkdir(parents=True)
    for name, age in {"a.csv.gz": 40, "b.csv.gz": 2, "c.txt": 40}.items():
        (folder / name).write_bytes(b"12345")
        os.utime(folder / name, (1e9, 1e9 - age * 86_400))
    assert jobs.sweep_files(spark, str(folder), days=30, now=1e9) == jobs.Swept(1, 5)
    assert sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == ["b.csv.gz", "c.txt", "x.csv.gz"]
    assert jobs.sweep_files(spark, str(folder), days=30, now=1e9) == jobs.sweep_files(spark, str(tmp_path / "nowhere")) == jobs.Swept(0, 0)


def test_ledger_of_messages_names_stages(spark, stored):
    given = spark.createDataFrame([(1, "junk"), (2, "rs404404404"), (3, "NM_999999.1:c.7A>G")], "line_no long, line string")
    told = lines.resolve_all(given, stored).ledger.collect()
    assert sorted((r.line_no, r.stage, r.code) for r in told if r.code) == [(2, lines.RESOLVE, "DBSNP_NO_MAPPING"), (3, lines.IDENTIFY, "REFSEQ_NO_PROTEIN"), (3, lines.RESOLVE, "CODING_NO_MAPPING")]
    assert [r.text for r in told if r.line_no == 1] == ["ERROR:Unsupported format"]
    assert set(fixtures.needs(fixtures.TABLES["download_input"])) == {"variants"}


def joins_in_unions(df):
    """Joins below a union in the optimized plan."""
    found, todo = 0, [(df._jdf.queryExecution().optimizedPlan(), False)]
    while todo:
        node, inside = todo.pop()
        name = node.getClass().getSimpleName()
        found += inside and name == "Join"
        children = node.children()
        todo += [(children.apply(k), inside or name == "Union") for k in range(children.size())]
    return found


def test_features_meet_without_a_union_of_shuffled_parts(spark):
    # Of such a union Spark expects as many partitions in each part, which large sides do not give ("Can't zip RDDs", at six times sf0.1).
    places = [(f"P{k % 40:05d}", k) for k in range(4000)]
    mapping = spark.createDataFrame([("1", p, "A", a, p, "K", "Aaa", 1, False, True) for a, p in places], "chromosome string, genomic_position int, allele string, accession string, protein_position int, protein_seq string, codon string, codon_position int, reverse_strand boolean, is_canonical boolean")
    tables = {
        "mapping": mapping, "pocket": mapping.filter("protein_position % 7 = 0").select(F.col("accession").alias("struct_id"), F.array("protein_position").alias("pocket_resid")),
        "interfaces": mapping.filter("protein_position % 11 = 0").select(F.col("accession").alias("a"), F.lit("Q").alias("b"), F.array("protein_position").alias("a_residues"), F.array(F.lit(1)).alias("b_residues")),
        "structure": spark.createDataFrame([(f"P{k:05d}", 100 * k, 100 * k + 300) for k in range(0, 40, 3)], "accession string, unp_start int, unp_end int"),
    }
    request = browse.Request(pocket=True, interact=True, experimental_model=True, any_feature=True).validate()
    want = {p for a, p in places if p % 7 == 0 or p % 11 == 0 or (int(a[1:]) % 3 == 0 and 100 * int(a[1:]) <= p <= 100 * int(a[1:]) + 300)}
    found = browse.browse(Catalog(spark, SF, tables), request)
    assert joins_in_unions(found) == 0
    assert {r[0] for r in found.select("protein_position").distinct().collect()} == want
    assert found.count() == 3 * len(want)


def test_positions_of_structures_are_not_shuffled(spark):
    rng = random.Random(3)
    ranges = [("P1", b, b + rng.randrange(40)) for b in (rng.randrange(300) for _ in range(60))] + [("P2", 5, 9), ("P2", 5, 9), ("P2", 6, 7), ("P2", 12, 11), ("P3", 4, 1), ("P4", None, 3), ("P5", 3, None), (None, 1, 2), (None, 2, 3), ("P6", 2**31 - 3, 2**31 - 1), ("P6", 2**31 - 2, 2**31 - 1)]
    rows = [tuple(r) for r in filters.structure_positions(spark.createDataFrame(ranges, "accession string, unp_start int, unp_end int")).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, p) for a, b, e in ranges if b is not None and e is not None for p in range(b, e + 1)}
    queries.load()
    plan = plan_of(queries.FUNCTIONS["explode_structure_positions"](Catalog(spark, SF)))
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "Exchange" in final and "Exchange" not in final[: final.index("Generate")]


def test_derived_popeve_is_not_multiplied_by_the_ids_of_an_accession(spark):
    # P1 has ten ids, of which it shares one with P2, given twice; P3 has none.
    variants = spark.createDataFrame([(a, p, "K", alt, True) for a in ("P1", "P2", "P3") for p in (1, 2) for alt in ("L", "W", "L")], "accession string, protein_position int, protein_seq string, alt_aa string, is_canonical boolean")
    refseq = spark.createDataFrame([("P1", f"NP_{k}.1") for k in range(10)] + [("P2", "NP_9.1")] * 2, "uniprot_acc string, refseq_acc string")
    t = Catalog(spark, SF, {"variants": variants.union(variants.filter("accession = 'P2'").withColumn("protein_position", F.lit(5))), "uniprot_refseq": refseq})
    found = t["popeve_by_accession"]
    assert "popeve" not in t._made
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == len(set(rows)) == 2 * 3 * 2
    assert rows == sorted(map(tuple, var.popeve_by_accession(t["popeve"], refseq).collect()))


def test_headers_of_an_accession_multiply_its_rows_last(spark):
    head = '{"proteinExistence":"%s","comments":[{"type":"SIMILARITY","text":[{"value":"Of one. Two."}]}]}'
    tables = {
        "function_header": spark.createDataFrame([("P1", head % "first"), ("P1", head % "second")], "accession string, header_json string"),
        "gnomad_allele_freq": spark.createDataFrame([("1", 7, "A", "C", 1, 10, 0.1)], "chr string, pos int, ref string, alt string, ac int, an int, af double"),
        "conserv_score": spark.createDataFrame([("P1", 3, "K", 0.5)], "accession string, position int, aa string, score double"),
    }
    lacking = {name: spark.createDataFrame([], schema) for name, schema in RESIDUE_TABLES.items() if name not in tables}
    t = Catalog(spark, SF, {**lacking, **tables})
    rows = spark.createDataFrame([("1", 7, "A", "C", "P1", 3, "R")], "chromosome string, genomic_position int, allele string, alt_allele string, accession string, protein_position int, alt_aa string")
    full = export.with_cells(rows, t)
    assert sorted((r.existence, r.family, r.conservation_score, r.ac) for r in full.collect()) == [("first", "Of one", 0.5, 1), ("second", "Of one", 0.5, 1)]
    node = full._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() != "Join":
        node = node.children().apply(0)
    assert "af#" in node.left().toString() and "af#" not in node.right().toString()
    # Facts that are not asked for are not read, and cells are made of a residue's facts before headers multiply it.
    asked = spark.createDataFrame([("P1", 3, None)], "accession string, protein_position int, variant_aa string")
    made = residues.function_answer(asked, t, ["conservation"], {"twice": 2 * F.col("conservation")[0]["score"]})
    assert "popeve" not in made.columns and [(r.conservation, r.twice) for r in made.collect()] == [(0.5, 1.0)] * 2


def test_coding_inputs_meet_refseq_once_and_residues_are_tested_before_expansion(spark):
    refseq = spark.createDataFrame([("P2", "NM_1.1"), ("P1", "NM_1.1"), ("P3", "NM_1.2"), ("P4", "NM_2.7"), (None, "NM_3.1")], "uniprot_acc string, refseq_acc string")
    inputs = spark.createDataFrame([(x,) for x in ("NM_1.1", "NM_1.2", "NM_1.9", "NM_1", "NM_2", "NM_3.1", "NM_4.1", None)], "refseq_id string")
    found = resolve.refseq_to_accession(inputs, refseq)
    assert len(re.findall(r"Join ", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    rows = {r.refseq_id: (r.acc, r.n_proteins, r.other_version) for r in found.collect()}
    assert rows == {"NM_1.1": ("P1", 2, None), "NM_1.2": ("P3", 1, None), "NM_1.9": ("P1", 2, "NM_1.1"), "NM_1": ("P1", 2, "NM_1.1"), "NM_2": ("P4", 1, "NM_2.7"), "NM_3.1": (None, 0, "NM_3.1"), "NM_4.1": (None, 0, None), None: (None, 0, None)}
    queries.load()
    for name in ("filter_disease_residue", "filter_experimental_model", "filter_interact"):
        plan = queries.FUNCTIONS[name](Catalog(spark, SF))._jdf.queryExecution().analyzed().toString()
        assert plan.index("alt_allele") < plan.index("LeftSemi")


def test_proteins_meet_residues_not_places(spark):
    shape = "accession string, protein_position int, protein_seq string, codon string, codon_position int, reverse_strand boolean, chromosome string, genomic_position int, allele string"
    rows = [("P1", 7, "M", c, k + 1, False, "1", 20 + k, "ATG"[k]) for k, c in enumerate(("Aug", "aUg", "auG"))] + [("P1", 7, "M", "uUg", 2, False, "1", 21, "T"), ("P2", 9, "X", "nNn", 2, False, "2", 50, "A")]
    mapping = spark.createDataFrame(rows * 2, shape)
    asked = spark.createDataFrame([(1, "P1", 7, "M", "L"), (2, "P1", 7, "K", "W"), (3, "P1", 7, None, None), (4, "P2", 9, None, "L"), (5, "P2", 9, None, None), (6, "P3", 7, "M", "L")], "line_no long, acc string, aa_pos int, ref_aa string, alt_aa string")
    found = resolve.protein_to_genomic(asked, mapping)
    got = sorted((r.line_no, r.genomic_position, r.alt_allele, r.fits, r.ref_mismatch) for r in found.collect())
    every = [(20 + k, b) for k in range(3) for b in sorted("ACGT") if b != "ATG"[k]]
    assert [x[:4] for x in got if x[0] == 1] == [(1, 20, "C", True), (1, 20, "T", True)]  # CUG and UUG
    assert got[2:11] == [(2, p, b, False, True) for p, b in every] and [x[:3] for x in got[11:20]] == [(3, p, b) for p, b in every]
    assert [x[:4] for x in got[20:]] == [(5, 50, b, True) for b in "CGT"]  # codons that code for nothing neither fit nor fail
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(re.findall("Join ", plan)) == 1


def test_a_gene_of_many_proteins_has_the_ranges_of_its_chromosomes(spark):
    rows = [(str(k % 3), k, f"P{k}", 7) for k in range(90)]
    leading = spark.createDataFrame(rows, "chromosome string, genomic_position int, accession string, protein_position int")
    scores = spark.createDataFrame([(str(k % 5), 3 * k) for k in range(50)], "chromosome string, position int")
    am = spark.createDataFrame([("P1", 7)], "accession string, position int")
    made = browse.narrowed(Catalog(spark, SF, {"cadd": scores, "alphamissense": am}), leading, browse.Request(cadd=["PROBABLY_DELETERIOUS"], am=[1]))
    assert sorted(map(tuple, made["cadd"].collect())) == sorted((str(k % 5), 3 * k) for k in range(50) if k % 5 < 3 and k % 5 <= 3 * k <= 87 + k % 5)
    assert made["alphamissense"].count() == 1
    # Both sides of the joins that a derived table is made of are cut.
    lookup = narrow.within(Catalog(spark, SF)["mapping_dbsnp_lookup"], "chr", "pos", {"1": (5, 90), "2": (7, 80)})
    assert lookup._jdf.queryExecution().optimizedPlan().toString().count("<= 90") >= 2


@pytest.mark.parametrize("name", ["batch_scores_long", "annotate_function", "join_popeve_twohop"])
def test_scores_of_residues_are_shuffled_by_residue_only(spark, name):
    """What derives the scores is cut at the residues asked for: no table of changes is shuffled whole. Links of popEVE meet the mapping, not variants."""
    queries.load()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")  # the codons
    try:
        plan = queries.FUNCTIONS[name](Catalog(spark, "/root/testdata/sf0.1"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = re.findall(r"hashpartitioning\((.*), \d+\)", plan)
    assert any(keys.startswith("of#") for keys in shuffled)
    assert name == "join_popeve_twohop" or all(keys.count("#") <= 2 for keys in shuffled)


def test_scores_of_residues_are_those_of_the_whole(spark):
    """Derived, given as tables, and of popEVE or variants that are given: the same rows."""
    t = Catalog(spark, SF)
    residues = t["population"].select("accession", "position").filter("position % 7 = 3")
    want = sorted(map(str, annotate.scores_long(t).join(residues, ["accession", "position"], "left_semi").select("score_type", "accession", "position", "mt_aa", "score", "class").collect()))
    for given in ([], list(annotate.PROTEIN_SCORES), ["popeve"], ["variants"]):
        u = Catalog(spark, SF, {name: t[name] for name in given})
        assert sorted(map(str, annotate.scores_long(u, residues).collect())) == want


def test_many_lines_meet_each_table_by_one_shuffle(spark, stored, monkeypatch):
    """more lines than are broadcast are lifted and find their bases without a semi join before it, and give the same variants."""
    old = stored["crossmap"].select(F.col("grch37_pos").cast("long").alias("line_no"), F.concat_ws(" ", "chr", F.col("grch37_pos").cast("string"), "grch37_base").alias("line"))
    given = old.unionByName(stored["input_lines"].withColumn("line_no", F.col("line_no") + 1_000_000).filter("line_no % 12 IN (4, 6, 10, 11)"))
    given = given.unionByName(given.limit(50))  # each once in the result
    told = lambda assembly: sorted(map(str, lines.resolve_lines(given, stored, assembly).collect()))
    want = {assembly: told(assembly) for assembly in (None, "GRCH38")}
    assert len(want[None]) > 1000
    monkeypatch.setattr(narrow, "MOST_KEYS", 5)
    assert {assembly: told(assembly) for assembly in want} == want
    plan = lines.resolve_lines(old, stored, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "LeftSemi" not in plan


def test_many_keys_are_told_from_the_first_rows(spark, monkeypatch):
    """rows are made distinct only where the first ones leave it open whether there are few keys."""
    rows = spark.range(1000).select(F.lit("a").alias("name"), F.col("id").alias("number"))
    assert not narrow.Keys(rows, "name", "number", 9, peek=True).small
    late = spark.range(1000, numPartitions=1).select(F.lit("a").alias("name"), F.greatest(F.lit(900), "id").alias("number"))
    assert not narrow.Keys(late, "name", "number", 9, peek=True).small and narrow.Keys(late, "name", "number", 100, peek=True).small
    assert len(narrow.Keys(late, "name", "number", 100, peek=True)) == 100


def test_ids_of_the_same_accessions_multiply_coding_inputs_last(spark, tmp_path):
    queries.load()
    # Ten ids of P1 alone, one of P1 and P2, one twice, one without accession.
    refseq = spark.createDataFrame([("P1", f"NP_{k}.1") for k in range(10)] + [("P1", "NP_a.1"), ("P2", "NP_a.1"), ("P2", "NP_b.1"), ("P2", "NP_b.1"), (None, "NP_c.1")], "uniprot_acc string, refseq_acc string")
    mapping = spark.createDataFrame([("1", 3 * p + c, "A", a, p, c, False) for a, p in (("P1", 1), ("P2", 1), ("P2", 2)) for c in (1, 2, 3)] * 2, "chromosome string, genomic_position int, allele string, accession string, protein_position int, codon_position int, reverse_strand boolean")
    t = Catalog(spark, SF, {"uniprot_refseq": refseq, "mapping": mapping})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, n in (("coding_to_protein", 10 * 3 + 6 + 6), ("coding_to_genomic", 10 * 3 + 3 + 6)):
            made = queries.FUNCTIONS[name](t)
            rows = [tuple(r) for r in made.collect()]
            assert len(rows) == len(set(rows)) == n, name
            assert "Exchange" not in plan_of(made).split("Generate")[0], name
        assert {(r.acc, r.n_proteins) for r in queries.FUNCTIONS["coding_to_protein"](t).filter("refseq_id = 'NP_a.1'").collect()} == {("P1", 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_are_made_after_the_last_shuffle_and_bad_headers_give_no_row(spark):
    head = '{"proteinExistence":"%s"}'
    tables = {
        "function_header": spark.createDataFrame([("P1", head % "first"), ("P1", head % "second"), ("P1", head % "second"), ("P1", "{bad"), ("P2", "{bad")], "accession string, header_json string"),
        "conserv_score": spark.createDataFrame([("P1", 3, "K", 0.5)], "accession string, position int, aa string, score double"),
    }
    lacking = {name: spark.createDataFrame([], schema) for name, schema in RESIDUE_TABLES.items() if name not in tables}
    t = Catalog(spark, SF, {**lacking, **tables})
    rows = spark.createDataFrame([("1", 7, "A", "C", "P1", 3, "R"), ("1", 8, "A", "C", "P2", 3, "R"), ("1", 9, "A", "C", None, None, None)], "chromosome string, genomic_position int, allele string, alt_allele string, accession string, protein_position int, alt_aa string")
    shown = ["Conservation_score", "Protein_existence_evidence"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        full = export.with_cells(rows, t, shown)
        got = sorted((r.genomic_position, r.entry_no, r.existence, r.conservation_score) for r in full.collect())
        assert got == [(7, 0, "first", 0.5), (7, 1, "second", 0.5), (7, 2, "second", 0.5), (8, 0, None, None), (9, 0, None, None)]
        assert [r.entry_no for r in export.with_cells(rows, t, shown, distinct=True).filter("genomic_position = 7").orderBy("entry_no").collect()] == [0, 1]
        final = plan_of(full).split("Initial Plan")[0]
        assert "Window" in final and "Exchange" not in final[: final.index("Window")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_export_has_all_cells():
    queries.load()
    assert all(f'AS "{name}"' in queries.TEXTS["csv_export_rows"] for name in export.HEADER)
