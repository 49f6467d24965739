"""A release as bucketed tables: joins of the mapping to its scores need no exchange.

Tables are written in buckets of a place (chromosome, position) or of a residue
(accession, position), one file a bucket, sorted by the same columns, so Parquet's ranges
stand in for an index too. The mapping is written both ways. Joins are on more columns
than the buckets (bases, amino acids), so Spark must be allowed to rely on some of the
keys: ``co_partitioned`` sets that for the plans made inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .catalog import Catalog

#: Columns of the buckets of each table.
BY_PLACE = {"mapping": ["chromosome", "genomic_position"], "cadd": ["chromosome", "position"], "gnomad_allele_freq": ["chr", "pos"], "dbsnp": ["chr", "pos"], "mapping_dbsnp_lookup": ["chr", "pos"]}
BY_RESIDUE = {
    "mapping": ["accession", "protein_position"], "alphamissense": ["accession", "position"], "popeve_by_accession": ["accession", "position"], "esm": ["accession", "position"],
    "eve_score": ["accession", "position"], "conserv_score": ["accession", "position"], "foldx": ["protein_acc", "position"], "population": ["accession", "position"],
}
#: For some 4 GB of the largest table in a bucket of 100 million rows: releases name their own.
BUCKETS = 256
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _write(t: Catalog, name: str, columns: list[str], table: str, path: str, buckets: int) -> None:
    # Dealt by the columns of the buckets into as many parts: each task writes one file, that of its bucket.
    rows = t[name].repartition(buckets, *columns)
    rows.write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).format("parquet").saveAsTable(table)


def load(t: Catalog, directory: str, prefix: str = "release", buckets: int = BUCKETS, tables: list[str] | None = None) -> None:
    """Writes the tables of the catalog that it has (or those named) to directory, as bucketed tables of the session's catalog."""
    for kind, columns_of in {"place": BY_PLACE, "residue": BY_RESIDUE}.items():
        for name, columns in columns_of.items():
            if (tables is None or name in tables) and name in t:
                _write(t, name, columns, f"{prefix}_{kind}_{name}", f"{directory}/{kind}/{name}", buckets)


def attach(spark: SparkSession, directory: str, prefix: str = "release", buckets: int = BUCKETS) -> None:
    """Names the tables of a release that another session wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for kind, columns_of in {"place": BY_PLACE, "residue": BY_RESIDUE}.items():
        for name, columns in columns_of.items():
            at = hadoop.Path(f"{directory}/{kind}/{name}")
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                fields = spark.read.parquet(at.toString()).schema.fields
                shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
                by = ", ".join(columns)
                spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}_{kind}_{name} ({shape}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}'")


def catalog(t: Catalog, prefix: str = "release", mapping: str = "place") -> Catalog:
    """t with the tables of a release; its mapping is in buckets of places or of residues, as the joins of a plan need it."""
    made = {}
    for kind, columns_of in {"place": BY_PLACE, "residue": BY_RESIDUE}.items():
        for name in columns_of:
            table = f"{prefix}_{kind}_{name}"
            if (name != "mapping" or kind == mapping) and t.spark.catalog.tableExists(table):
                made[name] = t.spark.table(table)
    return Catalog(t.spark, t.directory, {**t.given, **made})


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may join by buckets of some of the keys."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)
