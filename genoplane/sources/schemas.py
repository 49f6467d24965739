"""Schemas and categories of the logical tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

#: Half-open score bands [low, high).
CADD_BANDS = {
    "LIKELY_BENIGN": (0.0, 15.0),
    "POTENTIALLY_DELETERIOUS": (15.0, 20.0),
    "QUITE_LIKELY_DELETERIOUS": (20.0, 25.0),
    "PROBABLY_DELETERIOUS": (25.0, 30.0),
    "HIGHLY_LIKELY_DELETERIOUS": (30.0, 100.0),
}
FREQUENCY_BANDS = {"VERY_RARE": (0.0, 0.001), "RARE": (0.001, 0.005), "LOW_FREQUENCY": (0.005, 0.05), "COMMON": (0.05, 1.0)}
POPEVE_BANDS = {"SEVERE": (None, -5.056), "MODERATELY_DELETERIOUS": (-5.056, -4.617), "UNLIKELY_DELETERIOUS": (-4.617, None)}
AM_CLASSES = {"AMBIGUOUS": -1, "BENIGN": 0, "PATHOGENIC": 1}
EVE_CLASSES = {"BENIGN": 1, "PATHOGENIC": 2, "UNCERTAIN": 3}
STABILITY_CUTOFF = 2.0

#: Feature types of each feature group.
FEATURE_GROUPS = {
    "PTM": ["MOD_RES", "LIPID", "CARBOHYD", "DISULFID", "CROSSLNK"],
    "MUTAGENESIS": ["MUTAGEN"],
    "DOMAIN": ["DOMAIN", "REGION", "REPEAT", "ZN_FING", "DNA_BIND", "COILED", "MOTIF", "COMPBIAS"],
    "BINDING_SITE": ["BINDING"],
    "ACTIVE_SITE": ["ACT_SITE"],
    "TRANSMEMBRANE": ["TRANSMEM"],
}


class IdentifierType(str, Enum):
    UNIPROT = "uniprot"
    GENE = "gene"
    PDB = "pdb"
    ENSEMBL = "ensembl"
    REFSEQ = "refseq"


def parse_category(value: str | int, known: dict[str, object]) -> str:
    """The name of a category, given as a name in any case or (where categories are numbered) as its code."""
    text = str(value).strip().upper()
    if text in known:
        return text
    for name, code in known.items():
        if not isinstance(code, tuple) and str(code) == text:
            return name
    raise ValueError(f"unknown category {value!r}; known: {', '.join(known)}")


@dataclass(frozen=True)
class Assembly:
    name: str

    @staticmethod
    def of(value: str | None) -> Assembly:
        """AUTO where nothing is given."""
        text = (value or "AUTO").strip().upper()
        for name, aliases in {"GRCH38": {"GRCH38", "H38", "38"}, "GRCH37": {"GRCH37", "H37", "37"}, "AUTO": {"AUTO"}}.items():
            if text in aliases:
                return Assembly(name)
        raise ValueError(f"unknown assembly {value!r}")


MAPPING = (
    "chromosome string, protein_position int, protein_seq string, genomic_position int, allele string, codon string, accession string,"
    " reverse_strand boolean, ensg string, ensgv string, ensp string, enspv string, enst string, enstv string, ense string, is_match boolean,"
    " patch_name string, gene_name string, codon_position int, is_canonical boolean, is_mane_select boolean, protein_name string"
)
CADD = "chromosome string, position int, reference_allele string, alt_allele string, raw_score double, score double"
ALLELE_FREQUENCY = "chr string, pos int, ref string, alt string, ac int, an int, af double"
ALPHAMISSENSE = "accession string, position int, wt_aa string, mt_aa string, am_pathogenicity double, am_class int"

#: Tables of facts about residues; where a release has none, nothing is known of that kind.
RESIDUE_TABLES = {
    "function_header": "accession string, header_json string",
    "function_feature": "accession string, feature_index int, type string, category string, begin_pos int, end_pos int, description string, evidences_json string",
    "pocket": "struct_id string, pocket_id int, pocket_rad_gyration double, pocket_energy_per_vol double, pocket_buriedness double, pocket_resid array<int>, pocket_mean_plddt double, pocket_score_combined_scaled double",
    "interfaces": "a string, b string, a_residues array<int>, b_residues array<int>, pdockq double",
    "foldx": "protein_acc string, position int, af_id string, wild_type string, mutated_type string, foldx_ddg double, plddt double",
    "conserv_score": "accession string, position int, aa string, score double",
    "eve_score": "accession string, position int, mt_aa string, score double, class int",
    "esm": "accession string, position int, mt_aa string, score double",
    "popeve_by_accession": "accession string, position int, wt_aa string, mt_aa string, popeve double",
    "alphamissense": ALPHAMISSENSE,
    "m3d": "uniprot_id string, pos int, mut string, prediction string, damaging_feature string",
    "gnomad_allele_freq": ALLELE_FREQUENCY,
    "population": "accession string, position int, wild_type string, alt string, disease boolean, clin_sig string, raw_json string",
    "structure_regions": "accession string, pdb_id string, chain_id string, unp_start int, unp_end int, pdb_start int, observed_regions array<array<int>>, resolution double, experimental_method string",
}
