"""What a user asks for, as functions that return DataFrames.

Lines of variants in any notation are resolved to genomic variants, which are annotated
once. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import groupwise, narrow, vector
from .plans import annotate, browse, export, residues, resolve
from .plans.lines import Resolved, invalid_lines, parse_lines, resolve_all, resolve_lines, unmapped_lines
from .sources.catalog import Catalog
from .sources.lineage import cut, stored

__all__ = ["Service", "annotate_lines", "download_lines", "invalid_lines", "ordered_download", "parse_lines", "resolve_lines", "unmapped_lines", "write_download"]

#: Columns that order a download: lines as given, then variants and genes of a line.
ORDER = ["line_no", "seq"]


def annotate_variants(variants: DataFrame, t: Catalog, carried: list[str]) -> DataFrame:
    """annotate_core for variants that may be few: these cut the mapping and the scores down at their scans."""
    variants = cut(variants)
    return annotate.annotate_core(variants, annotate.narrowed(t, variants), carried)


def annotate_lines(lines: DataFrame, t: Catalog, assembly: str | None = "GRCH38") -> DataFrame:
    """Resolved lines with gene, consequence and scores, one row for each line, variant and mapping."""
    return annotate_variants(resolve_lines(lines, t, assembly), t, ["line_no", "warnings"])


def _notes(done: Resolved) -> DataFrame:
    """(line_no, said): what the ledger says of each line, stage by stage."""
    items = F.sort_array(F.collect_set(F.struct("stage", "text")))
    return done.ledger.groupBy("line_no").agg(F.transform(items, lambda x: x["text"]).alias("said"))


def ordered_download(lines: DataFrame, t: Catalog, assembly: str | None = "GRCH38", every_gene: bool = False) -> DataFrame:
    """line_no, seq and the 44 cells: every line has a row, whatever became of it; seq numbers the rows of a line.

    A mapped line has a row for each variant and gene, a valid one without mapping a row for each place that it
    names (one, if it names none), an invalid one a row with its messages. Line numbers must be distinct.
    """
    done = resolve_all(lines, t, assembly)
    variants = stored(done.variants)
    places = narrow.Keys(variants, "chromosome", "genomic_position", peek=True)
    near = annotate.narrowed(t, variants, places)
    core = annotate.annotate_core(variants, near, ["line_no", "warnings"], scores=False)
    genes = export.with_places(export.gene_rows(core, ["line_no", "warnings"], every_gene), near).withColumn("found", F.lit(True))
    # All that a line has meets by its number, while rows are narrow: genes, places without any, what was said, and the line itself.
    named = done.places.select("line_no", "chromosome", "genomic_position", F.col("ref").alias("allele"), F.col("alt").alias("alt_allele"), F.col("notes").alias("warnings"))
    rows = genes.repartition("line_no").unionByName(named.repartition("line_no"), allowMissingColumns=True)
    mapped = F.max("found").over(Window.partitionBy("line_no", "chromosome", "genomic_position"))
    rows = rows.withColumn("mapped", mapped).filter("found OR mapped IS NULL").drop("found", "mapped")
    about = done.parsed.select("line_no", F.col("line").alias("input"), F.coalesce(F.when(F.col("type") == "VARIANT_ID", F.trim("line")), "vcf_id").alias("input_id"), F.struct("chr", "pos", "ref", "alt", "type").alias("given"))
    # Outer: lines that name no place keep their row.
    rows = about.join(_notes(done), "line_no", "left").join(rows, "line_no", "left")
    named = F.col("chromosome").isNull() & (F.col("given.type") == "GENOMIC")
    for own, of in {"chromosome": "chr", "genomic_position": "pos", "allele": "ref", "alt_allele": "alt"}.items():
        rows = rows.withColumn(f"__{own}", F.when(named, F.col("given")[of]).otherwise(F.col(own)))
    for own in ("chromosome", "genomic_position", "allele", "alt_allele"):
        rows = rows.drop(own).withColumnRenamed(f"__{own}", own)
    notes = F.array_distinct(F.concat(F.coalesce("said", F.array().cast("array<string>")), F.coalesce("warnings", F.array().cast("array<string>"))))
    wrong = F.exists(notes, lambda n: n.startswith("ERROR:"))
    notes = F.when(F.col("accession").isNull() & ~wrong, F.concat(notes, F.array(F.lit(export.NO_MAPPING)))).otherwise(notes)
    # A row is numbered behind the rows that those before it in its line give: one for each header of their accession, which multiply them last.
    proteins = narrow.Keys(near["mapping"], *export.RESIDUE) if places.small else None
    several = stored(export.entries(t, proteins, distinct=True).select("accession", F.size("entries").alias("n_entries")).filter("n_entries > 1"))
    before = Window.partitionBy("line_no").orderBy("chromosome", "genomic_position", "allele", "alt_allele", "gene_name", "ensg", "warnings").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("notes", F.array_join(notes, ";")).join(several, "accession", "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n_entries", F.lit(1))).over(before), F.lit(0)))
    rows = stored(rows.drop("given", "said", "warnings", "n_entries"))
    rows = export.with_cells(rows, t, distinct=True).withColumn("seq", (F.col("before") + F.col("entry_no") + 1).cast("int"))
    return export.csv_rows(rows, ORDER)


def download_lines(lines: DataFrame, t: Catalog, assembly: str | None = "GRCH38", every_gene: bool = False) -> DataFrame:
    """The 44 cells of ordered_download, in its order."""
    return ordered_download(lines, t, assembly, every_gene).orderBy(*ORDER).drop(*ORDER)


def write_download(lines: DataFrame, t: Catalog, path: str, assembly: str | None = "GRCH38", single_file: bool = False, every_gene: bool = False) -> None:
    """A download as gzip CSV: sorted parts, or one file of them under one header."""
    export.write_csv(ordered_download(lines, t, assembly, every_gene), path, ORDER, single_file)


class Service:
    """The requests of the annotation service over a catalog."""

    def __init__(self, t: Catalog):
        self.t = t

    def browse(self, request: browse.Request) -> DataFrame:
        return browse.browse_page(self.t, request)

    def mapping(self, line: str, assembly: str | None = None) -> DataFrame:
        return annotate_lines(self.t.spark.createDataFrame([(1, line)], "line_no long, line string"), self.t, assembly)

    def features(self, accession: str, position: int) -> DataFrame:
        return annotate.features_at(self.t["function_feature"], accession, position)

    def function(self, accession: str, position: int, variant_aa: str | None = None) -> DataFrame:
        """The record of the residue's function: entry, features with evidences, pockets, interactions, and the predictions for an amino acid (one letter)."""
        return residues.function_answer(self.t.spark.createDataFrame([(accession, position, variant_aa)], "accession string, protein_position int, variant_aa string"), self.t)

    def population(self, accession: str, position: int, chromosome: str | None = None, genomic_position: int | None = None, alt_allele: str | None = None) -> DataFrame:
        """Population variants of the residue as records, and frequencies at the genomic place by alternate base."""
        asked = [(accession, position, chromosome, genomic_position, alt_allele)]
        return residues.population_answer(self.t.spark.createDataFrame(asked, "accession string, protein_position int, chromosome string, genomic_position int, alt_allele string"), self.t)

    def structure(self, accession: str, position: int) -> DataFrame:
        return annotate.structure_residues(self.t["structure_regions"].filter(F.col("accession") == accession), F.lit(position))

    def scores(self, accession: str, position: int) -> DataFrame:
        return annotate.scores_long(self.t).filter((F.col("accession") == accession) & (F.col("position") == position))

    def allele_frequency(self, chromosome: str, position: int) -> DataFrame:
        return self.t["gnomad_allele_freq"].filter((F.col("chr") == chromosome) & (F.col("pos") == position))

    def allele_frequencies(self, places: DataFrame) -> DataFrame:
        """Frequencies of many (chromosome, genomic_position), those without any too."""
        keys = narrow.Keys(places, "chromosome", "genomic_position")
        found = keys.bounded(self.t["gnomad_allele_freq"], "chr", "pos").withColumnsRenamed({"chr": "chromosome", "pos": "genomic_position"})
        return places.select("chromosome", "genomic_position").distinct().join(found, ["chromosome", "genomic_position"], "left")

    def foldx(self, accession: str, position: int, fragments: str = "all") -> DataFrame:
        rows = self.t["foldx"].filter((F.col("protein_acc") == accession) & (F.col("position") == position))
        return groupwise.foldx_middle(rows) if fragments == "middle" else rows.orderBy("mutated_type", "af_id")

    def pockets(self, accession: str, position: int) -> DataFrame:
        held = self.t["pocket"].filter((F.col("struct_id") == accession) & F.array_contains("pocket_resid", position))
        return held.orderBy(F.desc("pocket_score_combined_scaled"), "pocket_id")

    def interactions(self, accession: str, position: int) -> DataFrame:
        side = lambda who, residues: self.t["interfaces"].filter((F.col(who) == accession) & F.array_contains(residues, position))
        return side("a", "a_residues").union(side("b", "b_residues")).distinct().orderBy(F.desc("pdockq"), "a", "b")

    def assembly_mapping(self, positions: DataFrame, source: int, target: int) -> DataFrame:
        if {source, target} != {37, 38}:
            raise ValueError("assemblies are 37 and 38")
        return resolve.assembly_mapping(positions, self.t["crossmap"], source)

    def accessions(self, which: str) -> DataFrame:
        mapped = self.t["mapping"].filter("is_canonical").select("accession").distinct()
        every = self.t["uniprot_entry"].select("accession").distinct()
        found = {"all": lambda: every, "mapped": lambda: mapped, "unmapped": lambda: every.join(mapped, "accession", "left_anti")}[which]()
        return found.orderBy("accession")

    def latest_stats(self) -> DataFrame:
        return groupwise.latest_per_key(self.t["stats"])

    def nearest(self, query: list[float], limit: int = 10, offset: int = 0) -> DataFrame:
        return vector.nearest(self.t["embeddings"], query, limit, offset)
