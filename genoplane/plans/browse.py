"""Browse requests: identifiers, filters, the table that leads, sort and page.

A request becomes a DataFrame; Catalyst does the rest. The planner only chooses the
leading set, the smallest that the request names, so that joins start from it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import parse_variant
from ..functions.scalars import ENSEMBL, identifier_type
from ..operators import filters as flt
from ..operators import variants as var
from ..operators.narrow import Keys, ranges, within
from ..operators.paging import SORT_COLUMNS, ordering, page
from ..sources import schemas
from ..sources.catalog import Catalog
from ..sources.lineage import cut
from ..sources.schemas import IdentifierType
from ..sources.text_input import split_text
from .lines import resolve_lines


@dataclass
class Request:
    """What a user may ask for. Filters are joined by AND."""

    ids: list[tuple[IdentifierType, str]] = field(default_factory=list)
    q: str | None = None
    result_id: str | None = None
    assembly: str | None = None
    cadd: list[str] = field(default_factory=list)
    am: list[str | int] = field(default_factory=list)
    popeve: list[str] = field(default_factory=list)
    allele_frequency: list[str] = field(default_factory=list)
    conservation: tuple[float | None, float | None] = (None, None)
    esm1b: tuple[float | None, float | None] = (None, None)
    stability: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    disease: bool = False
    known: bool = False
    pocket: bool = False
    interact: bool = False
    experimental_model: bool = False
    any_feature: bool = False
    positions: tuple[int | None, int | None] = (None, None)
    sort: str | None = None
    order: str = "desc"
    page: int = 1
    page_size: int = 25
    canonical_only: bool = False

    def validate(self) -> Request:
        if not (self.ids or self.q or self.result_id or self.pocket or self.interact or self.experimental_model or self.known):
            raise ValueError("a request needs an input, identifiers, or one of pocket, interact, experimental_model, known")
        if self.page < 1 or not 10 <= self.page_size <= 1000:
            raise ValueError("page is at least 1 and page_size 10 to 1000")
        for name, (low, high), least, most in (("conservation", self.conservation, 0, 1), ("esm1b", self.esm1b, -25, 0)):
            if any(x is not None and not least <= x <= most for x in (low, high)):
                raise ValueError(f"{name} is {least} to {most}")
        if any(x is not None and x < 1 for x in self.positions):
            raise ValueError("positions are at least 1")
        if self.sort is not None and self.sort not in SORT_COLUMNS:
            raise ValueError(f"sort is one of {', '.join(SORT_COLUMNS)}")
        for chosen, known in ((self.cadd, schemas.CADD_BANDS), (self.popeve, schemas.POPEVE_BANDS), (self.allele_frequency, schemas.FREQUENCY_BANDS), (self.am, schemas.AM_CLASSES), (self.features, schemas.FEATURE_GROUPS)):
            for x in chosen:
                schemas.parse_category(x, known)
        return self

    def warnings(self) -> list[str]:
        one = len(self.ids) == 1 and self.ids[0][0] == IdentifierType.UNIPROT
        return ["position range ignored: it needs exactly one UniProt accession and both bounds"] if any(self.positions) and not (one and all(self.positions)) else []


def split_ensembl(identifier: str) -> tuple[str, str, str | None] | None:
    """(column, id, version) of an Ensembl id; None for exons and what is no id."""
    if not re.match(ENSEMBL, identifier):
        return None
    base, _, version = identifier.upper().partition(".")
    column = {"G": "ensg", "T": "enst", "P": "ensp"}.get(base[3])
    return (column, base, version or None) if column else None


def by_uniprot(mapping: DataFrame, accessions: list[str]) -> DataFrame:
    return mapping.filter(F.col("accession").isin([a.upper() for a in accessions]))


def of_genes(mapping: DataFrame, genes: list[str]) -> Column:
    """Symbols in any case, as C9orf72: by gene_key, the symbol in upper case, where a release has written it, which reaches the scan."""
    return (F.col("gene_key") if "gene_key" in mapping.columns else F.upper("gene_name")).isin([g.upper() for g in genes])


def by_gene(mapping: DataFrame, genes: list[str]) -> DataFrame:
    return mapping.filter(of_genes(mapping, genes))


def of_ensembl(mapping: DataFrame, identifiers: list[str]) -> Column:
    """Ids of genes, transcripts and proteins, with or without version; none that fits gives no rows."""
    tests = [F.lit(False)]
    for column, base, version in filter(None, map(split_ensembl, identifiers)):
        test = F.col(column) == base
        tests.append(test & (F.col(column + "v") == version) if version and column + "v" in mapping.columns else test)
    return reduce(lambda a, b: a | b, tests)


def by_ensembl(mapping: DataFrame, identifiers: list[str]) -> DataFrame:
    return mapping.filter(of_ensembl(mapping, identifiers))


def refseq_accessions(refseq: DataFrame, identifiers: list[str]) -> DataFrame:
    """(accession) of RefSeq ids. A versioned id is matched whole; one without version by the part before the dot."""
    whole = [i.upper() for i in identifiers if "." in i]
    bare = [i.upper() for i in identifiers if "." not in i]
    found = refseq.filter(F.col("refseq_acc").isin(whole) | F.split_part("refseq_acc", F.lit("."), F.lit(1)).isin(bare))
    return found.select(F.col("uniprot_acc").alias("accession")).distinct()


def by_refseq(mapping: DataFrame, refseq: DataFrame, identifiers: list[str]) -> DataFrame:
    return mapping.join(refseq_accessions(refseq, identifiers), "accession", "left_semi")


def by_pdb(mapping: DataFrame, regions: DataFrame, identifiers: list[str]) -> DataFrame:
    """Positions that a structure observes."""
    found = regions.filter(F.col("pdb_id").isin([i.lower() for i in identifiers])).select(F.col("accession").alias("__acc"), "observed_regions").distinct()
    return mapping.join(found, (F.col("accession") == F.col("__acc")) & flt.in_regions(F.col("protein_position"), F.col("observed_regions")), "left_semi")


def by_identifiers(t: Catalog, ids: list[tuple[IdentifierType, str]]) -> DataFrame:
    """The union of what each type of identifier finds, each mapping row once.

    One type is a filter or a semi join of its own. Several are one pass: tests of the row, and flags from small
    tables joined by accession, with OR; wide mapping rows are never made distinct.
    """
    mapping, of = t["mapping"], {}
    for kind, value in ids:
        of.setdefault(IdentifierType(kind), []).append(value)
    if len(of) == 1:
        kind, values = next(iter(of.items()))
        return {
            IdentifierType.UNIPROT: lambda v: by_uniprot(mapping, v),
            IdentifierType.GENE: lambda v: by_gene(mapping, v),
            IdentifierType.ENSEMBL: lambda v: by_ensembl(mapping, v),
            IdentifierType.REFSEQ: lambda v: by_refseq(mapping, t["uniprot_refseq"], v),
            IdentifierType.PDB: lambda v: by_pdb(mapping, t["structure_regions"], v),
        }[kind](values)
    rows, tests = mapping, []
    if accessions := of.get(IdentifierType.UNIPROT):
        tests.append(F.col("accession").isin([a.upper() for a in accessions]))
    if genes := of.get(IdentifierType.GENE):
        tests.append(of_genes(mapping, genes))
    if ensembl := of.get(IdentifierType.ENSEMBL):
        tests.append(of_ensembl(mapping, ensembl))
    if refseq := of.get(IdentifierType.REFSEQ):
        rows = rows.join(refseq_accessions(t["uniprot_refseq"], refseq).withColumn("__refseq", F.lit(True)), "accession", "left")
        tests.append(F.coalesce("__refseq", F.lit(False)))
    if pdb := of.get(IdentifierType.PDB):
        held = t["structure_regions"].filter(F.col("pdb_id").isin([i.lower() for i in pdb]))
        held = held.groupBy("accession").agg(F.flatten(F.collect_list("observed_regions")).alias("__regions"))
        rows = rows.join(held, "accession", "left")
        tests.append(F.coalesce(flt.in_regions(F.col("protein_position"), F.col("__regions")), F.lit(False)))
    return rows.filter(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in tests])).select(*mapping.columns)


def input_lines(t: Catalog, r: Request) -> DataFrame:
    """(line_no, line) of q, or of the stored upload named by result_id (table uploads: upload_id, line_no, line)."""
    if r.result_id:
        return t["uploads"].filter(F.col("upload_id") == r.result_id).select("line_no", "line")
    return split_text(t.spark.createDataFrame([(r.q,)], "value string")).select("line_no", "line")


def by_input(t: Catalog, r: Request) -> DataFrame:
    """The variants that the lines of an input stand for. Lines of q that name a gene, protein or structure count as identifiers."""
    lines = input_lines(t, r)
    found = None
    if r.q:
        variant = parse_variant(F.trim("line"))["format"] != "INVALID"
        kinds = lines.select("line_no", "line", identifier_type(F.col("line"), variant).alias("kind")).filter("kind IS NOT NULL").collect()  # lines of one query text
        if kinds:
            found = var.expand(by_identifiers(t, [(IdentifierType(k.kind), k.line.strip()) for k in kinds]))
            lines = lines.filter(~F.col("line_no").isin([k.line_no for k in kinds]))
            if lines.isEmpty():
                return found
    wanted = cut(resolve_lines(lines, t, r.assembly).select(*var.VARIANT_KEY).distinct())
    # Few variants cut the mapping down at its scan.
    held = Keys(wanted, "chromosome", "genomic_position").bounded(t["mapping"], "chromosome", "genomic_position")
    rows = var.with_change(held.join(wanted, var.VARIANT_KEY[:3]))
    return rows if found is None else found.unionByName(rows.select(*found.columns)).distinct()


def feature_tests(t: Catalog, r: Request) -> list[Callable[[DataFrame], DataFrame]]:
    """A filter for each structural feature asked for: lists of residues by equality, structures by range."""
    out = []
    if r.pocket:
        out.append(lambda rows: flt.at_positions(rows, flt.pocket_positions(t["pocket"])))
    if r.interact:
        out.append(lambda rows: flt.at_positions(rows, flt.interface_positions(t["interfaces"])))
    if r.experimental_model:
        out.append(lambda rows: flt.in_structures(rows, t["structure"]))
    return out


def leading(t: Catalog, r: Request) -> tuple[DataFrame, str]:
    """(variants, the strategy that leads)."""
    mapping = t["mapping"].filter("is_canonical")
    if r.q or r.result_id:
        rows = by_input(t, r)
        return (rows.filter("is_canonical") if r.canonical_only else rows), "input"
    if r.ids:
        rows = by_identifiers(t, r.ids)
        if r.canonical_only:
            rows = rows.filter("is_canonical")
        if not r.warnings() and any(r.positions):
            rows = rows.filter(F.col("protein_position").between(min(r.positions), max(r.positions)))
        return var.expand(rows), "identifiers"
    tests = feature_tests(t, r)
    if len(tests) == 1:
        return var.expand(tests[0](mapping)), "features"
    if tests:
        # Features are of residues: their keys are made distinct, never the wide rows. Each feature marks its residues, and rows with
        # any mark stay: in a union of parts that are dealt by residue already, Spark fails where their numbers of partitions differ.
        residue = ["accession", "protein_position"]
        places = mapping.select(*residue).distinct()
        marks = [f"__feature{k}" for k in range(len(tests))]
        for mark, test in zip(marks, tests):
            mapping = mapping.join(test(places).withColumn(mark, F.lit(True)), residue, "left")
        return var.expand(mapping.filter(F.coalesce(*marks, F.lit(False))).drop(*marks)), "features"
    if r.known:
        return known_first(t), "known"
    if r.allele_frequency:
        return frequency_first(t, r.allele_frequency), "frequency"
    if any(x is not None for x in r.conservation):
        return conservation_first(t, *r.conservation), "conservation"
    raise ValueError("the request names no set of variants")


def known_first(t: Catalog) -> DataFrame:
    """Strategy 3: known variants exploded, then the canonical mapping of their base."""
    known = flt.exploded_known(t["mapping_dbsnp_lookup"])
    rows = t["mapping"].filter("is_canonical").join(known, ["chromosome", "genomic_position", "allele"])
    return var.with_change(rows)


def frequency_first(t: Catalog, bands: list[str]) -> DataFrame:
    """Strategy 4a: frequencies in the bands, then the canonical mapping."""
    chosen = t["gnomad_allele_freq"].filter(flt.in_bands(F.col("af"), bands, schemas.FREQUENCY_BANDS))
    renamed = chosen.select(F.col("chr").alias("chromosome"), F.col("pos").alias("genomic_position"), F.col("ref").alias("allele"), F.col("alt").alias("alt_allele"), "af")
    return var.with_change(t["mapping"].filter("is_canonical").join(renamed, ["chromosome", "genomic_position", "allele"]))


def conservation_first(t: Catalog, low: float | None, high: float | None) -> DataFrame:
    """Strategy 4b: conserved positions in the range, then the canonical mapping, expanded."""
    chosen = t["conserv_score"].filter(flt.in_range(F.col("score"), low, high)).select("accession", F.col("position").alias("protein_position"), F.col("aa").alias("protein_seq"), F.col("score").alias("conservation"))
    return var.expand(t["mapping"].filter("is_canonical").join(chosen, ["accession", "protein_position", "protein_seq"]))


def apply_filters(t: Catalog, rows: DataFrame, r: Request, led: str) -> DataFrame:
    """All filters of the request; a score is joined if it filters (inner) or only sorts (left)."""
    how = lambda chosen: "inner" if chosen else "left"
    if r.cadd or r.sort == "cadd":
        rows = var.with_cadd(rows, t["cadd"], how(r.cadd))
        rows = rows.filter(flt.in_bands(F.col("cadd_score"), r.cadd, schemas.CADD_BANDS)) if r.cadd else rows
    if r.am or r.sort == "am":
        rows = var.with_alphamissense(rows, t["alphamissense"], how(r.am))
        codes = [schemas.AM_CLASSES[schemas.parse_category(x, schemas.AM_CLASSES)] for x in r.am]
        rows = rows.filter(F.col("am_class").isin(codes)) if codes else rows
    if r.popeve or r.sort == "popeve":
        rows = var.with_popeve(rows, t["popeve_by_accession"], how(r.popeve))
        rows = rows.filter(flt.in_bands(F.col("popeve"), r.popeve, schemas.POPEVE_BANDS)) if r.popeve else rows
    esm = any(x is not None for x in r.esm1b)
    if esm or r.sort == "esm1b":
        rows = var.with_esm(rows, t["esm"], how(esm))
        rows = rows.filter(flt.in_range(F.col("esm_score"), *r.esm1b)) if esm else rows
    if any(x is not None for x in r.conservation) and led != "conservation":
        rows = var.with_conservation(rows, t["conserv_score"], "inner").filter(flt.in_range(F.col("conservation"), *r.conservation))
    if r.allele_frequency and led != "frequency":
        rows = var.with_frequency(rows, t["gnomad_allele_freq"], "inner").filter(flt.in_bands(F.col("af"), r.allele_frequency, schemas.FREQUENCY_BANDS))
    if r.stability:
        low = F.col("foldx_ddg") < schemas.STABILITY_CUTOFF
        chosen = {x.upper() for x in r.stability}
        rows = var.with_stability(rows, t["foldx"], None if len(chosen) > 1 else ~low if chosen == {"LIKELY_DESTABILISING"} else low)
    if r.features:
        rows = flt.with_feature_groups(rows, t["function_feature"], r.features)
    if r.disease:
        rows = flt.at_positions(rows, flt.disease_positions(t["population"]))
    if led in ("identifiers", "input") or not r.any_feature:
        for test in feature_tests(t, r):
            rows = test(rows)
    if r.known and led != "known":
        rows = flt.known_variants(rows, t["mapping_dbsnp_lookup"])
    return rows


def narrowed(t: Catalog, rows: DataFrame, r: Request) -> Catalog:
    """The catalog with the tables that the request's filters join cut down to the places and residues of the leading rows, where these are of few names.

    A gene's scores are then one range of a table sorted by place, whatever the table's size.
    """
    place, residue = ("chromosome", "genomic_position"), ("accession", "protein_position")
    by_place = {
        "cadd": ("chromosome", "position", r.cadd or r.sort == "cadd"),
        "gnomad_allele_freq": ("chr", "pos", r.allele_frequency),
        "mapping_dbsnp_lookup": ("chr", "pos", r.known),
    }
    by_residue = {
        "alphamissense": ("accession", "position", r.am or r.sort == "am"),
        "popeve_by_accession": ("accession", "position", r.popeve or r.sort == "popeve"),
        "esm": ("accession", "position", r.sort == "esm1b" or any(x is not None for x in r.esm1b)),
        "conserv_score": ("accession", "position", any(x is not None for x in r.conservation)),
        "foldx": ("protein_acc", "position", r.stability),
        "population": ("accession", "position", r.disease),
    }
    made = {}
    for tables, pair in ((by_place, place), (by_residue, residue)):
        if any(used for *_, used in tables.values()):
            # A gene of very many proteins still is on few chromosomes, so each pair is counted by itself.
            held = ranges(rows, pair)[0]
            made |= {table: within(t[table], name, number, held) for table, (name, number, used) in tables.items() if used}
    return Catalog(t.spark, t.directory, {**t.given, **made})


def browse(t: Catalog, r: Request) -> DataFrame:
    """All variants that the request finds, each once, before paging."""
    rows, led = leading(t, r)
    if led == "identifiers":
        t = narrowed(t, rows, r)
    return apply_filters(t, rows, r, led)


def browse_page(t: Catalog, r: Request) -> DataFrame:
    rows = browse(t, r.validate())
    return page(rows, ordering(r.sort, r.order, rows.columns), r.page, r.page_size)
