"""Bucketed tables of a release: joins to scores without an exchange, with the same rows."""

import pytest

from genoplane.operators import variants as var
from genoplane.sources import release
from genoplane.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"
TABLES = ["mapping", "cadd", "gnomad_allele_freq", "alphamissense", "popeve_by_accession", "esm", "conserv_score", "foldx"]
JOINS = {
    "place": [lambda r, t: var.with_cadd(r, t["cadd"]), lambda r, t: var.with_frequency(r, t["gnomad_allele_freq"], "inner")],
    "residue": [
        lambda r, t: var.with_alphamissense(r, t["alphamissense"]),
        lambda r, t: var.with_popeve(r, t["popeve_by_accession"]),
        lambda r, t: var.with_esm(r, t["esm"], "inner"),
        lambda r, t: var.with_conservation(r, t["conserv_score"]),
        lambda r, t: var.with_stability(r, t["foldx"], t["foldx"].foldx_ddg >= 2),
    ],
}


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    t = Catalog(spark, SF)
    folder = str(tmp_path_factory.mktemp("release"))
    release.load(t, folder, "rel", 5, TABLES)
    release.attach(spark, folder, "again", 5)
    return t


@pytest.mark.parametrize("prefix", ["rel", "again"])
@pytest.mark.parametrize("kind", ["place", "residue"])
def test_score_joins_need_no_exchange(spark, plain, prefix, kind):
    loaded = release.catalog(plain, prefix, kind)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with release.co_partitioned(spark):
            for join in JOINS[kind]:
                made = join(var.expand(loaded["mapping"]), loaded)
                plan = made._jdf.queryExecution().executedPlan().toString()
                assert "Exchange" not in plan and "Join" in plan
                if prefix == "rel":
                    same = join(var.expand(plain["mapping"]), plain)
                    assert sorted(map(repr, made.select(*sorted(made.columns)).collect())) == sorted(map(repr, same.select(*sorted(same.columns)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_file_a_bucket(spark, plain):
    assert len(spark.table("rel_place_cadd").inputFiles()) <= 5
    assert release.catalog(plain, "nothing")["mapping"].columns == plain["mapping"].columns
