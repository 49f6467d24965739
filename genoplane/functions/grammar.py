"""The grammar of variant strings as one struct-returning Column expression.

``parse_variant(line)`` tries the formats in a fixed order, the first whose outline
fits decides; a full pattern then takes the parts out or adds messages. Everything
is built-in regular expressions: parsing a line is a projection, so it runs in the
scan's stage and never shuffles. A line's struct is computed once, whatever number of
its fields is read, and the parts of a layout come from one match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codon import one_letter
from .scalars import UNIPROT, normalize_chromosome

#: Fixed patterns of the parts of a variant.
POSITION = "0*[1-9][0-9]*"  # fits in one way only: nothing is tried again where a layout fails after it
BASE = "[ACGT]"
CHROMOSOME = "(?:chr)?(?:0*(?:[1-9]|1[0-9]|2[0-2])|[XY]|M|MT)|mit|mtDNA|mitochondria|mitochondrion"
AA1 = r"[ACDEFGHIKLMNPQRSTVWY\*BZUXOJ]"
AA3 = "(?:Ala|Cys|Asp|Glu|Phe|Gly|His|Ile|Lys|Leu|Met|Asn|Pro|Gln|Arg|Ser|Thr|Val|Trp|Tyr|Ter|Asx|Glx|Sec|Unk|Pyl|Xle)"
ACCESSION = UNIPROT.removeprefix("(?i)^").removesuffix("$").replace("(", "(?:")

#: The chromosome of each reference sequence, and whether it is of GRCh37.
REFSEQ_CHROMOSOMES = {
    "NC_000001.11": ("1", False),
    "NC_000002.12": ("2", False),
    "NC_000003.12": ("3", False),
    "NC_000004.12": ("4", False),
    "NC_000005.10": ("5", False),
    "NC_000006.12": ("6", False),
    "NC_000007.14": ("7", False),
    "NC_000008.11": ("8", False),
    "NC_000009.12": ("9", False),
    "NC_000010.11": ("10", False),
    "NC_000011.10": ("11", False),
    "NC_000012.12": ("12", False),
    "NC_000013.11": ("13", False),
    "NC_000014.9": ("14", False),
    "NC_000015.10": ("15", False),
    "NC_000016.10": ("16", False),
    "NC_000017.11": ("17", False),
    "NC_000018.10": ("18", False),
    "NC_000019.10": ("19", False),
    "NC_000020.11": ("20", False),
    "NC_000021.9": ("21", False),
    "NC_000022.11": ("22", False),
    "NC_000023.11": ("X", False),
    "NC_000024.10": ("Y", False),
    "NC_000001.10": ("1", True),
    "NC_000002.11": ("2", True),
    "NC_000003.11": ("3", True),
    "NC_000004.11": ("4", True),
    "NC_000005.9": ("5", True),
    "NC_000006.11": ("6", True),
    "NC_000007.13": ("7", True),
    "NC_000008.10": ("8", True),
    "NC_000009.11": ("9", True),
    "NC_000010.10": ("10", True),
    "NC_000011.9": ("11", True),
    "NC_000012.11": ("12", True),
    "NC_000013.10": ("13", True),
    "NC_000014.8": ("14", True),
    "NC_000015.9": ("15", True),
    "NC_000016.9": ("16", True),
    "NC_000017.10": ("17", True),
    "NC_000018.9": ("18", True),
    "NC_000019.9": ("19", True),
    "NC_000020.10": ("20", True),
    "NC_000021.8": ("21", True),
    "NC_000022.10": ("22", True),
    "NC_000023.10": ("X", True),
    "NC_000024.9": ("Y", True),
    "NC_012920.1": ("MT", False),
}


def refseq_chromosomes() -> dict[str, tuple[str, bool]]:
    """Reference sequence to (chromosome, whether of GRCh37)."""
    return dict(REFSEQ_CHROMOSOMES)


#: Fixed texts of messages.
MESSAGES = {
    "EMPTY": "Empty input",
    "UNSUPPORTED": "Unsupported format",
    "DBSNP": "Invalid dbSNP ID. Prefix 'rs' prefix should follow one or more digits.",
    "CLINVAR": "Invalid ClinVar ID. Prefix 'RCV' or 'VCV' should follow 9 numerals and an optional version number (e.g. '.1').",
    "COSMIC": "Invalid COSMIC ID. Prefix 'COSV', 'COSM' or 'COSN' should follow one or more digits.",
    "SCHEME_N": "Non-coding scheme (n.) not supported. Please use a supported scheme - g. (genomic), c. (cDNA) or p. (protein).",
    "SCHEME_M": "Mitochondrial scheme (m.) not supported. Please use a supported scheme - g. (genomic), c. (cDNA) or p. (protein).",
    "SCHEME_R": "RNA scheme (r.) not supported. Supported scheme - g. (genomic), c. (cDNA) or p. (protein).",
    "SCHEME": "Invalid HGVS scheme.",
    "PREFIX_NG": "NG prefix (gene or genomic region) is not supported. Please use a reference sequence with NC (genomic), NM (cDNA) or NP (protein) prefix.",
    "PREFIX_LRG": "LRG prefix (Locus Reference Genomic) is not supported. Please use a reference sequence with NC (genomic), NM (cDNA) or NP (protein) prefix.",
    "PREFIX_NR": "NR prefix (non-protein-coding RNA) is not supported. Please use a reference sequence with NC (genomic), NM (cDNA) or NP (protein) prefix.",
    "PREFIX": "HGVS reference sequence prefix is not supported. Please use a reference sequence with NC (genomic), NM (cDNA) or NP (protein) prefix.",
    "G_CHROMOSOME": "The reference sequence does not map to a chromosome in GRCh37 or 38.",
    "G_REFSEQ": "The reference sequence for HGVS g. input should be a valid NC accession, for e.g. NC_000002.12.",
    "G_CHANGE": "The variant description for HGVS g. input should contain a valid position, reference and alternate allele, for e.g. g.123A>T.",
    "C_REFSEQ": "The reference sequence for HGVS c. input should be a valid NM or NP accession, for e.g. NM_017547.4.",
    "C_CHANGE": "The variant description for HGVS c. input should contain a valid position, reference and alternate allele (optionally, the protein substitution) e.g. c.1289A>G p.(Asn430Ser).",
    "C_5UTR": "5' UTR positions are not supported (e.g., c.-128A>G).",
    "C_INTRON5": "Intronic positions (5' side) are not supported (e.g., c.128+1G>A).",
    "C_INTRON3": "Intronic positions (3' side) are not supported (e.g., c.128-1G>A).",
    "C_3UTR": "3' UTR positions are not supported (e.g., c.*128A>G).",
    "P_REFSEQ": "The reference sequence for HGVS p. input should be a valid NP or NM accession, for e.g. NP_001305738.1.",
    "P_CHANGE": "The variant description for HGVS p. should contain a valid reference and alternate (1- or 3-letter) amino acid and a position, e.g. p.Arg490Ser or p.R490S.",
    "PROTEIN": "Invalid protein input. Ensure the format is correct and includes a valid protein position. Reference and alternate amino acids are optional. ",
}

#: Formats and the type of each.
TYPES = {
    "HGVS_GENOMIC": "GENOMIC", "INTERNAL_GENOMIC": "GENOMIC", "VCF": "GENOMIC", "GNOMAD": "GENOMIC", "HGVS_CODING": "CODING_DNA",
    "HGVS_PROTEIN": "PROTEIN", "INTERNAL_PROTEIN": "PROTEIN", "DBSNP": "VARIANT_ID", "CLINVAR": "VARIANT_ID", "COSMIC": "VARIANT_ID", "INVALID": "INVALID",
}

#: Fixed patterns: outlines, schemes and layouts of the formats.
HGVS_OUTLINE = r"(?i)^([^:]+):(\s*[a-z]\.)[^:]+$"
SCHEMES = {s: rf"(?i)^([^:]+):\s*{s}\.(.+)$" for s in "gcp"}
G_REFSEQ = r"(?i)^NC_\d+(\.\d+)?$"
G_CHANGE = rf"(?i)^({POSITION})({BASE})>({BASE})$"
C_REFSEQ = r"(?i)^(?:NM_|NP_)\d+(\.\d+)?(\s*\([A-Z][A-Z0-9]+\))?$"
C_CHANGE = rf"(?i)^({POSITION})({BASE})>({BASE})(?:\s*(?:p\.\(|\(p\.)({AA3})({POSITION})({AA3}|=|\*)\))?$"
C_SPECIAL = {
    "C_5UTR": rf"^-{POSITION}{BASE}>{BASE}$",
    "C_INTRON5": rf"^{POSITION}\+[1-9]\d*{BASE}>{BASE}$",
    "C_INTRON3": rf"^{POSITION}-[1-9]\d*{BASE}>{BASE}$",
    "C_3UTR": rf"^\*{POSITION}{BASE}>{BASE}$",
}
P_REFSEQ = r"(?i)^(?:NM_|NP_)\d+(\.\d+)?$"
P_CHANGE = rf"(?i)^\(?({AA1}|{AA3})({POSITION})({AA1}|{AA3}|=|\?)\)?$"
PROTEIN_OUTLINE = rf"(?i)^(?:{ACCESSION})\s+\S"
#: Layouts of protein variants: (pattern, groups of reference, position and alternate).
PROTEIN = [
    (rf"(?i)^({ACCESSION})\s+(?:p\.)?({AA1})({POSITION})({AA1}|=|\?)$", (2, 3, 4)),
    (rf"(?i)^({ACCESSION})\s+(?:p\.)?({AA3})({POSITION})({AA3}|=|\*|\?)$", (2, 3, 4)),
    (rf"(?i)^({ACCESSION})\s+({POSITION})(?:\s+({AA1})(?:[\s/]({AA1}|=|\?))?)?$", (3, 2, 4)),
    (rf"(?i)^({ACCESSION})\s+({POSITION})(?:\s+({AA3})(?:[\s/]({AA3}|=|\*|\?))?)?$", (3, 2, 4)),
]
GNOMAD = rf"(?i)^({CHROMOSOME})-({POSITION})-({BASE})-({BASE})$"
VCF = rf"(?i)^({CHROMOSOME})\s+({POSITION})\s+(\S+)\s+({BASE})\s+({BASE})(?:\s+.*)?$"
SPACED = rf"(?i)^({CHROMOSOME})\s+({POSITION})(?:\s+({BASE})(?:(?:\s+|/|>)({BASE}))?)?$"
COLONS = rf"(?i)^({CHROMOSOME}):({POSITION})(?::({BASE})(?::({BASE}))?)?$"

#: Between groups; no character of a line that a layout accepts.
_MARK = "\x01"

FIELDS = {
    "format": "string", "type": "string", "chr": "string", "pos": "int", "ref": "string", "alt": "string", "vcf_id": "string", "acc": "string", "aa_pos": "int",
    "ref_aa": "string", "alt_aa": "string", "alt_unknown": "boolean", "refseq_id": "string", "refseq37": "boolean", "gene_symbol": "string", "messages": "array<string>",
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, and the result not taken apart into a CASE for each of its fields."""
    return F.transform(F.array(value), use)[0]


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern of whole texts by one match, as an array; without a match the text alone."""
    return F.split(F.regexp_replace(text, pattern, _MARK.join(f"${k}" for k in range(1, n + 1))), _MARK, -1)


def _part(groups: Column, k: int) -> Column:
    """A group of _groups, null where it is empty."""
    return F.when(groups[k - 1] != "", groups[k - 1])


def _group(text: Column, pattern: str, k: int) -> Column:
    """A group of a match, null where it is empty or the pattern does not fit."""
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found)


def _number(text: Column) -> Column:
    return F.when(F.length(text) <= 18, text.cast("long")).cast("int")


def _row(form: str, messages: list[Column] = (), **fields: Column) -> Column:
    made = {"format": F.lit(form), "type": F.lit(TYPES[form]), **fields, "messages": F.array_compact(F.array(*messages)) if messages else F.array()}
    return F.struct(*[made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()])


def _say(unless: Column, key: str) -> Column:
    return F.when(~unless, F.lit(MESSAGES[key]))


def _aa(ref: Column, alt: Column) -> dict[str, Column]:
    unknown = F.coalesce(alt == "?", F.lit(False))
    return {"ref_aa": one_letter(ref), "alt_aa": F.when(~unknown, one_letter(F.when(alt == "=", ref).otherwise(alt))), "alt_unknown": unknown}


def _hgvs_genomic(line: Column) -> Column:
    refseq, change = _group(line, SCHEMES["g"], 1), _group(line, SCHEMES["g"], 2)
    known = refseq_chromosomes()
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.upper(refseq))
    valid = refseq.rlike(G_REFSEQ)
    chromosome = F.when(valid, pick({k: v[0] for k, v in known.items()}))
    says = [F.when(~valid, MESSAGES["G_REFSEQ"]).when(chromosome.isNull(), MESSAGES["G_CHROMOSOME"]), _say(change.rlike(G_CHANGE), "G_CHANGE")]
    return _row(
        "HGVS_GENOMIC", says, refseq_id=F.when(valid, refseq), chr=chromosome, refseq37=F.coalesce(F.when(valid, pick({k: v[1] for k, v in known.items()})), F.lit(False)),
        pos=_number(_group(change, G_CHANGE, 1)), ref=F.upper(_group(change, G_CHANGE, 2)), alt=F.upper(_group(change, G_CHANGE, 3)),
    )


def _hgvs_coding(line: Column) -> Column:
    refseq, change = _group(line, SCHEMES["c"], 1), _group(line, SCHEMES["c"], 2)
    valid, fits = refseq.rlike(C_REFSEQ), change.rlike(C_CHANGE)
    special = F.lit(MESSAGES["C_CHANGE"])
    for key, pattern in reversed(C_SPECIAL.items()):
        special = F.when(change.rlike(pattern), MESSAGES[key]).otherwise(special)
    ref, alt = _group(change, C_CHANGE, 4), _group(change, C_CHANGE, 6)
    return _row(
        "HGVS_CODING", [_say(valid, "C_REFSEQ"), F.when(~fits, special)],
        refseq_id=F.when(valid, F.regexp_replace(refseq, r"\s*\([A-Z][A-Z0-9]+\)", "")), gene_symbol=F.when(valid, _group(refseq, r"\(([A-Z][A-Z0-9]+)\)", 1)),
        pos=_number(_group(change, C_CHANGE, 1)), ref=F.upper(_group(change, C_CHANGE, 2)), alt=F.upper(_group(change, C_CHANGE, 3)),
        ref_aa=ref, aa_pos=_number(_group(change, C_CHANGE, 5)), alt_aa=F.when(alt == "=", ref).otherwise(alt),
    )


def _hgvs_protein(line: Column) -> Column:
    refseq, change = _group(line, SCHEMES["p"], 1), _group(line, SCHEMES["p"], 2)
    valid = refseq.rlike(P_REFSEQ)
    return _row(
        "HGVS_PROTEIN", [_say(valid, "P_REFSEQ"), _say(change.rlike(P_CHANGE), "P_CHANGE")], refseq_id=F.when(valid, refseq),
        aa_pos=_number(_group(change, P_CHANGE, 2)), **_aa(_group(change, P_CHANGE, 1), _group(change, P_CHANGE, 3)),
    )


def _hgvs_other(line: Column) -> Column:
    scheme, refseq = F.trim(F.regexp_extract(line, HGVS_OUTLINE, 2)), F.upper(F.trim(F.regexp_extract(line, HGVS_OUTLINE, 1)))
    of_scheme = F.when(scheme == "n.", MESSAGES["SCHEME_N"]).when(scheme == "m.", MESSAGES["SCHEME_M"]).when(scheme == "r.", MESSAGES["SCHEME_R"]).otherwise(MESSAGES["SCHEME"])
    of_prefix = (
        F.when(refseq.startswith("NG"), MESSAGES["PREFIX_NG"]).when(refseq.startswith("LRG"), MESSAGES["PREFIX_LRG"]).when(refseq.startswith("NR"), MESSAGES["PREFIX_NR"])
        .when(~refseq.rlike(r"^(NC_|NM_|NP_)\d+(\.\d+)?$"), MESSAGES["PREFIX"])
    )
    return _row("INVALID", [of_scheme, of_prefix])


def _protein_layout(line: Column, pattern: str, ref: int, pos: int, alt: int) -> Column:
    def row(g: Column) -> Column:
        return _row("INTERNAL_PROTEIN", acc=F.upper(_part(g, 1)), aa_pos=_number(_part(g, pos)), **_aa(_part(g, ref), _part(g, alt)))

    return _once(_groups(line, pattern, 4), row)


def _protein(line: Column) -> Column:
    made = _row("INTERNAL_PROTEIN", [F.lit(MESSAGES["PROTEIN"])])
    for pattern, groups in reversed(PROTEIN):
        made = F.when(line.rlike(pattern), _protein_layout(line, pattern, *groups)).otherwise(made)
    return made


def _genomic(form: str, line: Column, pattern: str, groups: tuple[int, int, int, int], vcf_id: int | None = None) -> Column:
    def row(g: Column) -> Column:
        chromosome, pos, ref, alt = (_part(g, k) for k in groups)
        more = {"vcf_id": _part(g, vcf_id)} if vcf_id else {}
        return _row(form, chr=normalize_chromosome(chromosome), pos=_number(pos), ref=F.upper(ref), alt=F.upper(alt), **more)

    return _once(_groups(line, pattern, max(groups)), row)


def parse_variant(line: Column, versioned_ids: bool = False) -> Column:
    """The struct of FIELDS for a trimmed line.

    versioned_ids also reads database ids with a version (``RCV000000001.2``), which are not single words.
    """
    return _once(line, lambda x: _parse(x, versioned_ids))


def _parse(line: Column, versioned_ids: bool) -> Column:
    word = line.rlike(r"^\w+$") | (F.lit(versioned_ids) & line.rlike(r"(?i)^(RCV|VCV)[\d.]+$"))
    identifier = lambda form, full, key: _row(form, [_say(line.rlike(full), key)])
    # Of two conditions the one that most lines fail soonest comes first.
    hgvs = line.contains(":") & line.rlike(HGVS_OUTLINE)
    of_scheme = F.when(line.rlike(SCHEMES["p"]), _hgvs_protein(line)).when(line.rlike(SCHEMES["c"]), _hgvs_coding(line)).when(line.rlike(SCHEMES["g"]), _hgvs_genomic(line)).otherwise(_hgvs_other(line))
    return (
        F.when(line.isNull() | (F.trim(line) == ""), _row("INVALID", [F.lit(MESSAGES["EMPTY"])]))
        .when(line.rlike(r"(?i)^rs\d") & word, identifier("DBSNP", r"(?i)^rs\d+$", "DBSNP"))
        .when(line.rlike(r"(?i)^(RCV|VCV)\d") & word, identifier("CLINVAR", r"(?i)^(RCV|VCV)\d{9}(\.\d+)?$", "CLINVAR"))
        .when(line.rlike(r"(?i)^COS[VMN]\d") & word, identifier("COSMIC", r"(?i)^COS[VMN]\d+$", "COSMIC"))
        .when(hgvs, of_scheme)
        .when(line.rlike(PROTEIN_OUTLINE), _protein(line))
        .when(line.contains("-") & line.rlike(GNOMAD), _genomic("GNOMAD", line, GNOMAD, (1, 2, 3, 4)))
        .when(line.rlike(VCF), _genomic("VCF", line, VCF, (1, 2, 4, 5), vcf_id=3))
        .when(line.rlike(SPACED), _genomic("INTERNAL_GENOMIC", line, SPACED, (1, 2, 3, 4)))
        .when(line.rlike(COLONS), _genomic("INTERNAL_GENOMIC", line, COLONS, (1, 2, 3, 4)))
        .otherwise(_row("INVALID", [F.lit(MESSAGES["UNSUPPORTED"])]))
    )
