"""Lines of variants in any notation, to genomic variants and messages.

Lines are parsed in one projection; each type of input that occurs is resolved by its own
joins, and the results meet in one union. What a stage has to say of a line goes to one
ledger (line_no, stage, code, text), whatever the type. Few inputs cut the large tables
down where these are scanned. Nothing is collected but counts by type, the assembly of a
sample, and up to ``narrow.MOST_KEYS`` keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import parse_variant
from ..functions.reuse import reused
from ..operators import narrow
from ..operators.narrow import Keys
from ..sources.catalog import Catalog
from ..sources.lineage import cut, stored
from ..sources.schemas import Assembly
from . import resolve

#: Stages in the order in which their messages are told.
PARSE, ASSEMBLY, IDENTIFY, RESOLVE = range(4)
LEDGER = "line_no long, stage int, code string, text string"
#: Fixed texts of messages on lines, with their level.
MESSAGES = {
    "AUTO_DETECT_38": "INFO:Genomic variants assembly predicted to be GRCh38 (%s%% GRCh38, %s%% GRCh37 matches)",
    "AUTO_DETECT_37": "INFO:Genomic variants assembly predicted to be GRCh37 (%s%% GRCh37, %s%% GRCh38 matches)",
    "AUTO_DETECT_UNKNOWN": "WARN:Unable to predict which genome assembly was inputted (%s%% GRCh38, %s%% GRCh37 matches). Defaulting to GRCh38",
    "ASSEMBLY_NOT_FOUND": "ERROR:Unable to map GRCh37 to GRCh38 coordinate.",
    "DBSNP_NO_MAPPING": "ERROR:No mapping found for dbSNP ID.",
    "CLINVAR_NO_MAPPING": "ERROR:No mapping found for ClinVar ID.",
    "COSMIC_NO_MAPPING": "ERROR:No mapping found for COSMIC ID.",
    "REFSEQ_NO_PROTEIN": "WARN:Could not map RefSeq ID to a Uniprot protein.",
    "PROTEIN_NO_MAPPING": "ERROR:Could not map protein input to genomic coordinate(s). ",
    "CODING_NO_MAPPING": "ERROR:Could not map cDNA input to genomic coordinate(s). ",
    "ACCESSION_NOT_FOUND": "ERROR:%s is not a human UniProt accession. ",
}
_NOT_FOUND = {"DBSNP": "DBSNP_NO_MAPPING", "CLINVAR": "CLINVAR_NO_MAPPING", "COSMIC": "COSMIC_NO_MAPPING", "HGVS_PROTEIN": "PROTEIN_NO_MAPPING", "INTERNAL_PROTEIN": "PROTEIN_NO_MAPPING", "HGVS_CODING": "CODING_NO_MAPPING"}
PLACE = ["chromosome", "genomic_position"]
_FOUND = ["line_no", *PLACE, "ref", "alt", "notes"]


@dataclass
class Resolved:
    """parsed lines; places (line_no, chromosome, genomic_position, ref, alt, notes) before references are known; variants; the ledger."""

    parsed: DataFrame
    places: DataFrame
    variants: DataFrame
    ledger: DataFrame


def parse_lines(lines: DataFrame, versioned_ids: bool = True) -> DataFrame:
    """lines: (line_no, line). One column for each field of a parsed variant."""
    parsed = reused(lines, ("parse_lines", versioned_ids), lambda: parse_variant(F.trim("line"), versioned_ids).alias("v"))
    return lines.select("line_no", "line", parsed).select("line_no", "line", "v.*")


def _no_notes() -> Column:
    return F.array().cast("array<string>")


def _said(rows: DataFrame, stage: int, code: Column, text: Column) -> DataFrame:
    return rows.select(F.col("line_no").cast("long"), F.lit(stage).alias("stage"), code.alias("code"), text.alias("text"))


def _message(rows: DataFrame, stage: int, code: str, *parts: str | Column) -> DataFrame:
    return _said(rows, stage, F.lit(code), F.format_string(MESSAGES[code], *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _leveled(notes: Column, level: str) -> Column:
    return F.transform(notes, lambda x: F.concat(F.lit(f"{level}:"), x))


def _genomic(parsed: DataFrame, t: Catalog, assembly: str) -> tuple[DataFrame, list[DataFrame]]:
    """Genomic inputs on GRCh38: sequences of GRCh37 always are lifted, other formats if the assembly says so. HGVS is never taken for 37 otherwise."""
    rows = parsed.filter("type = 'GENOMIC' AND size(messages) = 0").select("line_no", "format", "refseq37", "chr", "pos", "ref", "alt")
    plain, said = rows.filter("format <> 'HGVS_GENOMIC'"), []
    if Assembly.of(assembly).name == "AUTO":
        inputs = plain.filter("ref IS NOT NULL").select("chr", "pos", "ref")
        found = resolve.detect_build(inputs, t["crossmap"]).first()  # one row, of a sample
        code = "AUTO_DETECT_UNKNOWN" if not found.sure else "AUTO_DETECT_37" if found.build == "GRCh37" else "AUTO_DETECT_38"
        shares = [f"{float(found.match38):.2f}", f"{float(found.match37):.2f}"]
        said.append(_message(plain, ASSEMBLY, code, *(shares[::-1] if code == "AUTO_DETECT_37" else shares)))
        assembly = found.build
    old = F.coalesce("refseq37", F.lit(False)) | (F.lit(Assembly.of(assembly).name == "GRCH37") & (F.col("format") != "HGVS_GENOMIC"))
    lifted = resolve.liftover(rows.filter(old), t["crossmap"])
    said.append(_message(lifted.filter("NOT lifted"), ASSEMBLY, "ASSEMBLY_NOT_FOUND"))
    every = rows.filter(~old).unionByName(lifted.filter("lifted").drop("lifted"))
    return every.select("line_no", F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position"), "ref", "alt", _no_notes().alias("notes")), said


def _identifiers(parsed: DataFrame, t: Catalog) -> tuple[DataFrame, list[DataFrame]]:
    rows = parsed.filter("type = 'VARIANT_ID' AND size(messages) = 0").select("line_no", F.trim("line").alias("id"))
    found = resolve.ids_to_variants(rows, t["dbsnp"], t["clinvar_extended"], t["cosmic"]).withColumnRenamed("input", "id")
    return rows.join(found, "id").select("line_no", F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position"), "ref", "alt", _no_notes().alias("notes")), []


def _refseq_notes() -> Column:
    """That another version was used is for information, that there are several proteins a warning."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{level}:"), text) for level, text in zip(("INFO", "WARN"), resolve.refseq_texts(), strict=True)]))


def _coding(parsed: DataFrame, t: Catalog) -> tuple[DataFrame, list[DataFrame]]:
    rows = parsed.filter("type = 'CODING_DNA' AND size(messages) = 0").select("line_no", "refseq_id", "pos", "ref", "alt")
    named = cut(resolve.coding_to_proteins(rows, t["uniprot_refseq"]))
    mapping = Keys(named, "acc", "protein_position").cut(t["mapping"], "accession", "protein_position")
    found = resolve.coding_to_genomic(named, mapping)
    made = found.select("line_no", "chromosome", "genomic_position", F.col("allele").alias("ref"), F.col("alt_allele").alias("alt"), _refseq_notes().alias("notes"))
    return made, [_message(named.filter("acc IS NULL"), IDENTIFY, "REFSEQ_NO_PROTEIN")]


def _protein(parsed: DataFrame, t: Catalog) -> tuple[DataFrame, list[DataFrame]]:
    rows = parsed.filter("type = 'PROTEIN' AND size(messages) = 0").select("line_no", "acc", "refseq_id", "aa_pos", "ref_aa", "alt_aa", "alt_unknown")
    named = rows.filter("refseq_id IS NULL").drop("refseq_id").withColumn("notes", _no_notes())
    by_refseq = resolve.refseq_to_accession(rows.filter("refseq_id IS NOT NULL").drop("acc"), t["uniprot_refseq"]).withColumn("notes", _refseq_notes()).select(*named.columns)
    every = cut(named.withColumn("given", F.lit(True)).unionByName(by_refseq.withColumn("given", F.lit(False))))
    said = [_message(every.filter("acc IS NULL"), IDENTIFY, "REFSEQ_NO_PROTEIN")]
    if "uniprot_entry" in t:
        unknown = every.filter("given").join(t["uniprot_entry"].select(F.col("accession").alias("acc")), "acc", "left_anti")
        said.append(_message(unknown, IDENTIFY, "ACCESSION_NOT_FOUND", F.col("acc")))
    mapping = Keys(every, "acc", "aa_pos").cut(t["mapping"], "accession", "protein_position")
    found = resolve.protein_to_genomic(every, mapping)
    says = resolve.protein_messages(F.col("aa_pos"), F.col("protein_seq"), F.col("ref_aa"), F.col("alt_aa"), F.coalesce("alt_unknown", F.lit(False)))
    notes = F.concat("notes", _leveled(F.transform(says, lambda x: x["text"]), "WARN")).alias("notes")
    return found.select("line_no", "chromosome", "genomic_position", F.col("allele").alias("ref"), F.col("alt_allele").alias("alt"), notes), said


def resolve_all(lines: DataFrame, t: Catalog, assembly: str | None = "GRCH38", once: bool = False) -> Resolved:
    """The variants that each line stands for, references from the mapping, and the ledger of what was said of it.

    once: of places, variants and ledger one is read, and once, so places of many lines are not written for the others.
    """
    parsed = stored(parse_lines(lines))
    kinds = {r.type for r in parsed.filter("size(messages) = 0").select("type").distinct().collect()}
    said = [_said(parsed.select("line_no", F.explode("messages").alias("m")), PARSE, F.lit(None).cast("string"), F.concat(F.lit("ERROR:"), F.col("m")))]
    found = []
    for kind, resolver in {"GENOMIC": lambda: _genomic(parsed, t, assembly), "VARIANT_ID": lambda: _identifiers(parsed, t), "CODING_DNA": lambda: _coding(parsed, t), "PROTEIN": lambda: _protein(parsed, t)}.items():
        if kind in kinds:
            rows, messages = resolver()
            found.append(rows.select(*_FOUND))
            said += messages
    if not found:
        found = [t.spark.createDataFrame([], "line_no long, chromosome string, genomic_position int, ref string, alt string, notes array<string>")]
    places = reduce(DataFrame.unionByName, found).distinct()
    few = not once or len(parsed.select("line_no").limit(narrow.MOST_KEYS + 1).collect()) <= narrow.MOST_KEYS
    if few:
        places = stored(places)
    lost = parsed.filter(F.col("format").isin(list(_NOT_FOUND)) & (F.size("messages") == 0)).join(places.select("line_no").distinct(), "line_no", "left_anti")
    code = F.element_at(F.create_map(*[F.lit(x) for item in _NOT_FOUND.items() for x in item]), F.col("format"))
    said.append(_said(lost, RESOLVE, code, F.element_at(F.create_map(*[F.lit(x) for k in set(_NOT_FOUND.values()) for x in (k, MESSAGES[k])]), code)))
    # Few places cut the mapping down at its scan. Many meet it by one shuffle of it, whose parts are made distinct.
    bases = t["mapping"].select(*PLACE, F.col("allele").alias("mapping_ref"))
    keys = Keys(places, *PLACE, peek=True) if few else None
    bases = keys.bounded(bases, *PLACE).distinct() if few and keys.small else bases.repartition(*PLACE).distinct()
    rows = resolve.resolve_alt_bases((places if few else reduce(DataFrame.unionByName, found)).join(bases, PLACE))  # variants are made distinct
    warnings = F.concat("notes", _leveled(F.col("warnings"), "WARN")).alias("warnings")
    variants = rows.select("line_no", *PLACE, F.col("resolved_ref").alias("allele"), F.explode("alts").alias("alt_allele"), warnings).distinct()
    return Resolved(parsed, places, variants, reduce(DataFrame.unionByName, said))


def resolve_lines(lines: DataFrame, t: Catalog, assembly: str | None = "GRCH38") -> DataFrame:
    """(line_no, chromosome, genomic_position, allele, alt_allele, warnings): the variants that each line stands for, references from the mapping."""
    return resolve_all(lines, t, assembly, once=True).variants


def invalid_lines(lines: DataFrame) -> DataFrame:
    """(line_no, line, messages) of lines that no format accepts or whose parts are wrong."""
    return parse_lines(lines).filter("type = 'INVALID' OR size(messages) > 0").select("line_no", "line", "messages")


def unmapped_lines(lines: DataFrame, t: Catalog, assembly: str | None = "GRCH38") -> DataFrame:
    """Valid lines without a genomic variant."""
    done = resolve_all(lines, t, assembly, once=True)
    valid = done.parsed.filter("type <> 'INVALID' AND size(messages) = 0").select("line_no", "line", "type")
    return valid.join(done.variants.select("line_no").distinct(), "line_no", "left_anti")
