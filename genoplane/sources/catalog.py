"""Logical tables as DataFrames.

A table is, in this order: a DataFrame or path given for its name, a Parquet table
``<directory>/<name>.parquet``, or a derivation from other tables. Scans are lazy
and pruned by Catalyst; nothing is cached here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures


def _popeve_by_accession(t: Catalog, residues: DataFrame | None = None) -> DataFrame:
    from ..operators.variants import accession_links, least_popeve, popeve_by_accession

    if "popeve" in t.given:
        return at_residues(popeve_by_accession(t["popeve"], t["uniprot_refseq"]), residues)
    # popEVE itself is derived from variants by the RefSeq ids of their accession: an accession with many ids has its variants as many
    # times in it. Its text over the links of accessions, in place of the ids, gives the rows of each accession at once.
    text = fixtures.TABLES["popeve"].replace("SELECT DISTINCT", "SELECT", 1)  # repeated rows have one least score
    links = accession_links(t["uniprot_refseq"])
    if "variants" in t.given:
        links = links.select(F.col("of").alias("uniprot_acc"), F.col("accession").alias("refseq_acc"))
        made = t.spark.sql(fixtures.spark_text(text), variants=t["variants"], uniprot_refseq=links)
        return at_residues(least_popeve(made.withColumnRenamed("refseq_protein", "accession")), residues)
    # Rows of the mapping meet the links and the residues asked for, before they multiply into variants.
    mapping = t["mapping"].filter("is_canonical").withColumnRenamed("accession", "of").join(links, "of").drop("of")
    mapping = mapping.repartition("accession") if t.dealt else mapping
    variants = Catalog(t.spark, t.directory, {**t.given, "mapping": at_residues(mapping, residues, position="protein_position")})["variants"]
    text = text.replace("JOIN {uniprot_refseq} r ON r.uniprot_acc = v.accession", "").replace("r.refseq_acc AS refseq_protein", "v.accession")
    return least_popeve(t.spark.sql(fixtures.spark_text(text), variants=variants))


def at_residues(table: DataFrame, residues: DataFrame | None, accession: str = "accession", position: str = "position") -> DataFrame:
    """The rows of table at residues (accession, position); all, if none are given."""
    if residues is None:
        return table
    wanted = residues.select(F.col("accession").alias("__accession"), F.col("position").alias("__position"))
    return table.join(wanted, (F.col(accession) == F.col("__accession")) & (F.col(position) == F.col("__position")), "left_semi")


#: Tables made from others by operators, where a release has not written them.
DERIVED = {"popeve_by_accession": _popeve_by_accession}
DERIVED_FROM = {"popeve_by_accession": ["popeve", "uniprot_refseq"]}


class Catalog:
    def __init__(self, spark: SparkSession, directory: str, tables: dict[str, DataFrame | str] | None = None):
        self.spark, self.directory = spark, directory
        self.given = dict(tables or {})
        self.dealt = False
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def at_residues(self, names: dict[str, tuple[str, str]], residues: DataFrame) -> Catalog:
        """This catalog with tables, named with their columns of accession and position, cut down to residues (accession, position).

        What is derived is made of the mapping's rows at the residues: the shuffle that cuts these, before they multiply, serves
        all grouping after it. Tables that are given are cut themselves.
        """
        of_mapping = Catalog(self.spark, self.directory, {**self.given, "mapping": at_residues(self["mapping"], residues, position="protein_position")})
        made = {}
        for name, (accession, position) in names.items():
            if name in self.given or name not in DERIVED and "variants" in self.given:
                made[name] = at_residues(self[name], residues, accession, position)
            else:
                made[name] = DERIVED[name](self, residues) if name in DERIVED else of_mapping[name]
        return Catalog(self.spark, self.directory, {**self.given, **made})

    def by_place(self) -> Catalog:
        """This catalog with a derived mapping dealt by place: of its rows, before they multiply, frequencies and CADD are made without another shuffle."""
        return self._dealt("chromosome", "genomic_position", "allele")

    def by_accession(self) -> Catalog:
        """This catalog with a derived mapping dealt by accession: of its rows, before they multiply, tables of residues are made without another shuffle."""
        return self._dealt("accession")

    def _dealt(self, *keys: str) -> Catalog:
        if "mapping" in self.given:
            return self
        made = Catalog(self.spark, self.directory, {**self.given, "mapping": self["mapping"].repartition(*keys)})
        made.dealt = keys == ("accession",)
        return made

    def __contains__(self, name: str) -> bool:
        """Whether a table is given, written, or derived from such."""
        if name in self.given:
            return True
        if name in DERIVED:
            return all(other in self for other in DERIVED_FROM[name])
        if name in fixtures.TABLES:
            return all(other in self for other in fixtures.needs(fixtures.TABLES[name]))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}.parquet")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def or_empty(self, schemas: dict[str, str]) -> Catalog:
        """This catalog with an empty table for each of schemas that it lacks."""
        lacking = {name: self.spark.createDataFrame([], schema) for name, schema in schemas.items() if name not in self}
        return Catalog(self.spark, self.directory, {**self.given, **lacking}) if lacking else self

    def write_derived(self, directory: str) -> Catalog:
        """Writes the tables derived by operators, as a load of a release does, and reads them from there on."""
        made = {}
        for name in DERIVED:
            made[name] = f"{directory}/{name}.parquet"
            self[name].sortWithinPartitions("accession", "position").write.mode("overwrite").parquet(made[name])
        return Catalog(self.spark, self.directory, {**self.given, **made})

    def _make(self, name: str) -> DataFrame:
        given = self.given.get(name)
        if isinstance(given, DataFrame):
            return given
        if given is not None:
            return self.spark.read.parquet(given)
        if name in DERIVED:
            return DERIVED[name](self)
        if name in fixtures.TABLES:
            text = fixtures.TABLES[name]
            return self.spark.sql(fixtures.spark_text(text), **{n: self[n] for n in fixtures.needs(text)})
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")
