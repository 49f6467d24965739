"""From parsed inputs to genomic variants: ids, coding and protein changes, assemblies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codon import alt_codon, alternates, coding_to_protein, complement, is_snv_pair, rna_base, three_letter, translate_codon
from ..operators.narrow import Keys

#: Sample for the detection of an assembly, and the shares (percent) that decide.
SAMPLE, DECIDES, RULES_OUT = 100, 75, 25

#: Fixed texts of messages; those of protein inputs by their codes.
PROTEIN_MESSAGES = {
    "100": "User input reference amino acid (%s) does not match the UniProt sequence (%s) at position %d. The service will use the reference amino acid (%s).",
    "101": "User input reference amino acid empty. The service will use the reference amino acid at position %d (%s).",
    "102": "User input variant amino acid (%s) cannot be caused by an SNV from the reference amino acid (%s), therefore the returned results are position but not variant specific.",
    "103": "User input variant amino acid empty, therefore the returned results are position but not variant specific.",
    "104": "User input variant amino acid unknown (?), therefore the returned results are position but not variant specific.",
}
OTHER_VERSION = "RefSeq id %s has no UniProt accession; %s was used."
SEVERAL_PROTEINS = "RefSeq id %s maps to %d UniProt accessions; %s was used."
REF_MISMATCH = "User input reference allele (%s) does not match the UniProt sequence (%s) at the genomic location."
SAME_ALLELES = "Reference and alternate are the same. The service will show all possible alternatives of the reference."
ALT_EMPTY = "User input variant allele empty."
REF_EMPTY = "User input reference and variant allele empty. The service will use the reference allele at the genomic location."


def resolve_alt_bases(inputs: DataFrame) -> DataFrame:
    """inputs: ref, alt, mapping_ref (of the genome). Adds resolved_ref, alts (array) and warnings, in a fixed order."""
    ref, alt, own = F.col("ref"), F.col("alt"), F.col("mapping_ref")
    every = alternates(own)
    same = F.upper(alt) == own
    warnings = F.array_compact(
        F.array(
            F.when(F.upper(ref) != own, F.format_string(REF_MISMATCH, ref, own)),
            F.when(ref.isNotNull() & same, SAME_ALLELES).when(ref.isNotNull() & alt.isNull(), ALT_EMPTY).when(ref.isNull(), REF_EMPTY),
        )
    )
    alts = F.when(ref.isNotNull() & alt.isNotNull() & ~same, F.array(F.upper(alt))).otherwise(every)
    return inputs.withColumn("resolved_ref", own).withColumn("alts", alts).withColumn("warnings", warnings)


def ids_to_variants(ids: DataFrame, dbsnp: DataFrame, clinvar: DataFrame, cosmic: DataFrame) -> DataFrame:
    """ids: (id). Genomic variants of dbSNP, ClinVar (RCV, VCV) and COSMIC ids in any case, versions stripped; each once."""
    wanted = ids.select(F.col("id").alias("input"), F.split_part(F.upper(F.trim("id")), F.lit("."), F.lit(1)).alias("key")).distinct()
    of = lambda prefix: wanted.filter(F.col("key").startswith(prefix))
    place = ["chr", "pos", "ref", "alt"]
    # A release writes rs ids in lower case, all others in upper case: ids are joined as they stand, and alternates are exploded after it.
    snp = of("RS").withColumn("id", F.lower("key")).join(dbsnp.select("id", *place), "id").withColumn("alt", F.explode(F.split("alt", ",")))
    rcv = of("RCV").join(clinvar.select(F.explode("rcvs").alias("key"), *place), "key")
    vcv = of("VCV").join(clinvar.select(F.col("vcv").alias("key"), *place), "key")
    by_id = of("COS").join(cosmic.select(F.col("id").alias("key"), *place), "key")
    by_legacy = of("COS").join(cosmic.select(F.col("legacy_id").alias("key"), *place), "key")
    found = [x.select("input", *place) for x in (snp, rcv, vcv, by_id, by_legacy)]
    return reduce(DataFrame.union, found).distinct()


def refseq_to_accession(inputs: DataFrame, refseq: DataFrame) -> DataFrame:
    """inputs with refseq_id. Adds acc (least of the id), n_proteins and other_version: the id used where the version given is unknown.

    One equi-join on the part before the dot, whose versions are a small list: the least and the one asked for are taken from it.
    """
    bare = F.split_part("refseq_acc", F.lit("."), F.lit(1))
    whole = refseq.filter("refseq_acc IS NOT NULL").groupBy("refseq_acc").agg(F.min("uniprot_acc").alias("acc"), F.countDistinct("uniprot_acc").alias("n"))
    versions = whole.groupBy(bare.alias("__bare")).agg(F.sort_array(F.collect_list(F.struct(F.col("refseq_acc").alias("id"), "acc", "n"))).alias("__versions"))
    rows = inputs.join(versions, F.split_part("refseq_id", F.lit("."), F.lit(1)) == F.col("__bare"), "left")
    rows = rows.withColumn("__asked", F.get(F.filter("__versions", lambda v: v["id"] == F.col("refseq_id")), F.lit(0))).withColumn("__first", F.get("__versions", F.lit(0)))
    made = rows.withColumn("acc", F.coalesce("__asked.acc", "__first.acc")).withColumn("n_proteins", F.coalesce("__asked.n", "__first.n", F.lit(0)))
    made = made.withColumn("other_version", F.when(F.col("__asked.acc").isNull(), F.col("__first.id")))
    return made.select(*[c for c in made.columns if not c.startswith("__")])


def refseq_groups(refseq: DataFrame) -> DataFrame:
    """(group, acc, n_proteins, accessions, ids): RefSeq ids that stand for the same accessions, in one row.

    What is made of the mapping for an id is the same for all ids of its group, so it is made once a group, and ids multiply it last.
    """
    of_id = refseq.filter("refseq_acc IS NOT NULL AND uniprot_acc IS NOT NULL").groupBy("refseq_acc").agg(F.sort_array(F.collect_set("uniprot_acc")).alias("accessions"))
    groups = of_id.groupBy("accessions").agg(F.sort_array(F.collect_list("refseq_acc")).alias("ids"))
    return groups.select(F.col("ids")[0].alias("group"), F.col("accessions")[0].alias("acc"), F.size("accessions").cast("long").alias("n_proteins"), "accessions", "ids")


def with_ids(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of groups, each once, for each id of their group as refseq_id: nothing is shuffled or compared after ids multiply them."""
    rows = rows.repartition("group").distinct()
    return rows.join(groups.select("group", "ids"), "group").withColumn("refseq_id", F.explode("ids")).drop("group", "ids")


def coding_to_proteins(inputs: DataFrame, refseq: DataFrame) -> DataFrame:
    """Coding inputs (refseq_id, pos) with accession, protein position and position in the codon."""
    return with_protein_place(refseq_to_accession(inputs, refseq))


def with_protein_place(inputs: DataFrame) -> DataFrame:
    """Adds the protein position and the position in the codon of the coding position pos."""
    protein, codon = coding_to_protein(F.col("pos"))
    return inputs.withColumn("protein_position", protein).withColumn("codon_position", codon)


def coding_to_genomic(inputs: DataFrame, mapping: DataFrame, narrow: bool = True) -> DataFrame:
    """Coding inputs with acc, protein_position, codon_position, ref and alt: the genomic variants whose base agrees."""
    places = mapping.select(
        F.col("accession").alias("acc"), "protein_position", "codon_position", "reverse_strand", "chromosome", "genomic_position", "allele"
    )
    keys = ["acc", "protein_position", "codon_position"]
    # Only what few inputs name is deduplicated, not the mapping; many inputs are not read a second time for it.
    places = Keys(inputs, "acc", "protein_position").cut(places, "acc", "protein_position") if narrow else places.repartition(*keys)
    rows = inputs.join(places.dropDuplicates([*keys, "chromosome", "genomic_position", "allele"]), keys)
    strand = lambda base: F.when(F.col("reverse_strand"), complement(base)).otherwise(base)
    return rows.filter(F.col("allele") == strand(F.col("ref"))).withColumn("alt_allele", strand(F.col("alt")))


def protein_to_genomic(inputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Protein inputs (line_no, acc, aa_pos, ref_aa, alt_aa): their genomic variants.

    Those that code for the amino acid asked for; where none does, all. Adds flags:
    ref_mismatch, non_snv. The mapping is grouped whole: where inputs are few, the caller cuts it down to them.
    """
    places = mapping.filter("allele IS NOT NULL AND protein_seq IS NOT NULL AND codon IS NOT NULL").select(
        F.col("accession").alias("acc"), F.col("protein_position").alias("aa_pos"), "protein_seq", "codon", "codon_position", "reverse_strand", "chromosome", "genomic_position", "allele"
    )
    # A residue has one row until its candidates are chosen, so what is shuffled and sorted are residues: the few places of a residue
    # as a list, of each place the first row, and whether any candidate of an input fits from the list.
    place = ["chromosome", "genomic_position", "allele"]
    found = F.array_sort(F.collect_set(F.struct(*place, "codon_position", "codon", "protein_seq", "reverse_strand")))
    same = lambda p, q: F.struct(*[p[c] for c in place]).eqNullSafe(F.struct(*[q[c] for c in place]))
    places = places.groupBy("acc", "aa_pos").agg(found.alias("__all"))
    places = places.select("acc", "aa_pos", F.filter("__all", lambda p, k: (k == 0) | ~same(p, F.get("__all", k - 1))).alias("__places"))
    made = lambda p, base: translate_codon(alt_codon(F.upper(p["codon"]), p["codon_position"], rna_base(base, p["reverse_strand"])))
    tests = F.flatten(F.transform("__places", lambda p: F.transform(alternates(p["allele"]), lambda base: made(p, base) == F.col("alt_aa"))))
    rows = inputs.join(places, ["acc", "aa_pos"]).withColumn("any_fit", F.col("alt_aa").isNull() | F.array_max(tests))
    rows = rows.withColumn("__place", F.explode("__places")).select(*inputs.columns, "any_fit", "__place.*").withColumn("alt_allele", F.explode(alternates(F.col("allele"))))
    rows = rows.withColumn("fits", F.col("alt_aa").isNull() | (made({c: F.col(c) for c in ("codon", "codon_position", "reverse_strand")}, F.col("alt_allele")) == F.col("alt_aa")))
    rows = rows.filter(F.col("fits") | ~F.col("any_fit"))
    rows = rows.withColumn("ref_mismatch", F.coalesce(F.col("ref_aa") != F.col("protein_seq"), F.lit(False)))
    return rows.withColumn("non_snv", F.coalesce(~is_snv_pair(F.col("protein_seq"), F.col("alt_aa")), F.lit(False)))


def protein_messages(position: Column, seq: Column, ref: Column, alt: Column, unknown: Column) -> Column:
    """The messages of a protein input, as (code, text), in a fixed order."""
    say = lambda code, *parts: F.struct(F.lit(code).alias("code"), F.format_string(PROTEIN_MESSAGES[code], *parts).alias("text"))
    none_given = ref.isNull() & alt.isNull() & ~unknown
    return F.array_compact(
        F.array(
            F.when(ref != seq, say("100", three_letter(ref), three_letter(seq), position, three_letter(seq))),
            F.when(none_given, say("101", position, three_letter(seq))),
            F.when(~is_snv_pair(seq, alt), say("102", three_letter(alt), three_letter(seq))),
            F.when(unknown, say("104"))
            .when(alt.isNull(), say("103")),
        )
    )


def refseq_texts() -> list[Column]:
    """That another version was used, and that there are several proteins, of an input with refseq_id, acc, n_proteins and other_version; null where not so."""
    return [
        F.when(F.col("other_version").isNotNull(), F.format_string(OTHER_VERSION, "refseq_id", "other_version")),
        F.when(F.col("n_proteins") > 1, F.format_string(SEVERAL_PROTEINS, "refseq_id", "n_proteins", "acc")),
    ]


def build_match(inputs: DataFrame, crossmap: DataFrame, build: int) -> DataFrame:
    """(match): whole percent of the inputs (chr, pos, ref) whose base the assembly has; a null base never matches."""
    total = inputs.agg(F.count("*").alias("n"))
    place = crossmap.select("chr", F.col(f"grch{build}_pos").alias("pos"), F.col(f"grch{build}_base").alias("ref"))
    found = inputs.join(place, ["chr", "pos", "ref"]).agg(F.countDistinct(F.struct("chr", "pos", "ref")).alias("found"))
    return found.crossJoin(total).select(F.expr("CASE WHEN n > 0 THEN 100 * found div n ELSE 0 END").cast("long").alias("match"))


def detect_build(inputs: DataFrame, crossmap: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(build, match38, match37, sure) from the first inputs in the order of a hash: the same sample each time."""
    inputs = inputs.select("chr", "pos", "ref")
    chosen = [tuple(r) for r in inputs.orderBy(F.md5(F.concat_ws("-", "chr", "pos", "ref")), "chr", "pos").limit(sample).collect()]
    # The sample is taken once, and one scan of the crossmap that it cuts down gives what it matches on both assemblies.
    places = inputs.sparkSession.createDataFrame(chosen, inputs.schema)
    numbers = sorted({pos for _, pos, _ in chosen if pos is not None})
    near = crossmap.filter(F.col("grch38_pos").isin(numbers) | F.col("grch37_pos").isin(numbers))
    builds = F.array(*[F.struct(F.lit(b).alias("build"), F.col(f"grch{b}_pos").alias("pos"), F.col(f"grch{b}_base").alias("ref")) for b in (38, 37)])
    found = near.select("chr", F.inline(builds)).join(F.broadcast(places.distinct()), ["chr", "pos", "ref"])
    share = lambda b: F.floor(F.size(F.collect_set(F.when(F.col("build") == b, F.struct("chr", "pos", "ref")))) * 100 / max(len(chosen), 1)).cast("long")
    both = found.agg(share(38).alias("match38"), share(37).alias("match37"))
    is38 = (F.col("match38") > DECIDES) & (F.col("match37") < RULES_OUT)
    is37 = (F.col("match37") > DECIDES) & (F.col("match38") < RULES_OUT)
    return both.select(F.when(is37, "GRCh37").otherwise("GRCh38").alias("build"), "match38", "match37", (is38 | is37).alias("sure"))


def liftover(inputs: DataFrame, crossmap: DataFrame) -> DataFrame:
    """Inputs on GRCh37 (chr, pos) with pos replaced by that on GRCh38; lifted says whether there was one. Only the position changes."""
    # Few places cut the crossmap down before it is grouped; with many its groups meet them by the shuffle that grouping needs.
    keys = Keys(inputs, "chr", "pos", peek=True)
    asked = keys.bounded(crossmap, "chr", "grch37_pos") if keys.small else crossmap
    least = asked.groupBy(F.col("chr").alias("__chr"), F.col("grch37_pos").alias("__pos37")).agg(F.min("grch38_pos").alias("__pos38"))
    rows = inputs.join(least, (F.col("chr") == F.col("__chr")) & (F.col("pos") == F.col("__pos37")), "left")
    return rows.withColumn("lifted", F.col("__pos38").isNotNull()).withColumn("pos", F.coalesce("__pos38", "pos")).drop("__chr", "__pos37", "__pos38")


def assembly_mapping(positions: DataFrame, crossmap: DataFrame, source: int = 37) -> DataFrame:
    """(chr, pos, to_pos, message) for each position on the source assembly: none found and several found are said."""
    target = 38 if source == 37 else 37
    asked = Keys(positions, "chr", "pos").bounded(crossmap, "chr", f"grch{source}_pos")
    found = asked.groupBy("chr", F.col(f"grch{source}_pos").alias("pos")).agg(F.countDistinct(f"grch{target}_pos").alias("n"), F.min(f"grch{target}_pos").alias("first"))
    rows = positions.join(found, ["chr", "pos"], "left")
    message = F.when(F.col("n").isNull(), "No mapping found").when(F.col("n") > 1, "Multiple mappings found")
    return rows.select("chr", "pos", F.when(F.col("n") == 1, F.col("first")).alias("to_pos"), message.alias("message"))
