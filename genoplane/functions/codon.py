"""Codons and amino acids as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code.
CODONS = {
    "UUU": "F", "UUC": "F", "UUA": "L", "UUG": "L", "UCU": "S", "UCC": "S", "UCA": "S", "UCG": "S",
    "UAU": "Y", "UAC": "Y", "UAA": "*", "UAG": "*", "UGU": "C", "UGC": "C", "UGA": "*", "UGG": "W",
    "CUU": "L", "CUC": "L", "CUA": "L", "CUG": "L", "CCU": "P", "CCC": "P", "CCA": "P", "CCG": "P",
    "CAU": "H", "CAC": "H", "CAA": "Q", "CAG": "Q", "CGU": "R", "CGC": "R", "CGA": "R", "CGG": "R",
    "AUU": "I", "AUC": "I", "AUA": "I", "AUG": "M", "ACU": "T", "ACC": "T", "ACA": "T", "ACG": "T",
    "AAU": "N", "AAC": "N", "AAA": "K", "AAG": "K", "AGU": "S", "AGC": "S", "AGA": "R", "AGG": "R",
    "GUU": "V", "GUC": "V", "GUA": "V", "GUG": "V", "GCU": "A", "GCC": "A", "GCA": "A", "GCG": "A",
    "GAU": "D", "GAC": "D", "GAA": "E", "GAG": "E", "GGU": "G", "GGC": "G", "GGA": "G", "GGG": "G",
}
BASES = ("A", "T", "G", "C")
#: One- and three-letter names, the extended ones last.
AMINO_ACIDS = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met",
    "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "*": "Ter",
    "B": "Asx", "Z": "Glx", "U": "Sec", "X": "Unk", "O": "Pyl", "J": "Xle",
}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a key in a constant map; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def translate_codon(codon: Column) -> Column:
    """The amino acid of an RNA codon in any case; null if it is none."""
    return _lookup(CODONS, F.upper(codon))


def complement(bases: Column) -> Column:
    return F.translate(bases, "ATGCU", "TACGA")


def rna_base(base: Column, reverse: Column) -> Column:
    """The RNA letter of a DNA base as the transcript has it: complemented on the reverse strand, then T to U."""
    return F.replace(F.when(reverse, F.translate(base, "ATGC", "TACG")).otherwise(base), F.lit("T"), F.lit("U"))


def alt_codon(codon: Column, position: Column, base: Column) -> Column:
    """codon with base at position 1 to 3; any other position leaves it as it is."""
    put = [F.concat(F.substring(codon, 1, k - 1), base, F.substring(codon, k + 1, 3)) for k in (1, 2, 3)]
    return F.when(position == 1, put[0]).when(position == 2, put[1]).when(position == 3, put[2]).otherwise(codon)


def alternates(allele: Column) -> Column:
    """The three bases other than allele, as an array."""
    return F.array_except(F.array(*map(F.lit, BASES)), F.array(allele))


def one_letter(name: Column) -> Column:
    """The one-letter code of a one- or three-letter amino acid in any case; null for others."""
    names = {x.upper(): k for k, v in AMINO_ACIDS.items() for x in (k, v)}
    return _lookup(names, F.upper(name))


def three_letter(code: Column) -> Column:
    return _lookup(AMINO_ACIDS, F.upper(code))


def consequence(ref: Column, alt: Column) -> Column:
    """Synonymous is tested first, then stop gained, else missense; null if either is."""
    return F.when(ref == alt, "synonymous").when(alt == "*", "stop gained").when(ref.isNotNull() & alt.isNotNull(), "missense")


def coding_to_protein(position: Column) -> tuple[Column, Column]:
    """(protein position, codon position) of a coding position."""
    return F.ceil(position / 3).cast("int"), ((position - 1) % 3 + 1).cast("int")


def changed_bases(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b))


#: Pairs of amino acids that one changed base turns into each other.
SNV_PAIRS = sorted({(CODONS[a], CODONS[b]) for a in CODONS for b in CODONS if changed_bases(a, b) == 1})


def is_snv_pair(ref: Column, alt: Column) -> Column:
    """Whether one base can turn ref into alt."""
    return F.concat(ref, alt).isin([a + b for a, b in SNV_PAIRS])
