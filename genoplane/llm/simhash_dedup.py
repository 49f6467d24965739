"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in two
bits or fewer differ in at most two of them, so they share at least six. The
postings of the index are keyed by the values of four positions; of the eight
bytes in four pairs at least two pairs are untouched, so every link meets in the
posting of one of six position sets. For each pair that meets, the shared
positional bytes are tallied, pairs under six are dropped, and the rest are
verified by counting differing bits.

A posting with more than ``hot`` fingerprints emits no pairs. In it, each
fingerprint is put under itself and under every one-bit change of its four free
bytes; two fingerprints are within two bits exactly if they meet under one such
value, and no value holds more than 33 of them. They are tied to the least of
them. So the work stays in proportion to the fingerprints, and no link is lost.

Defined cases. A null or empty text has fingerprint zero, linked like any other.
A very long text gives all its
shingles; a bit set in just half of them is 0; of equal fingerprints the least id names
the class. A null id is returned with its fingerprint; it is never a component's id unless
the component has no other. Equal fingerprints are handled once, so thousands of
copies cost one index entry. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import fresh, over_texts, tidy, type_of, written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
LEAST_SHARED_BYTES = 8 - MAX_BITS
HOT_POSTING = 256
#: Up to so many ids (8 bytes each and a little more) of rows to drop are broadcast; more are joined by a shuffle.
BROADCAST_LOST = 200_000
#: Sets of four byte positions: two of the four pairs of neighbouring bytes.
POSITION_SETS = [(a, a + 1, b, b + 1) for a, b in combinations((0, 2, 4, 6), 2)]

_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = [words[k:] for k in range(min(shingle, len(words)))]
    h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*parts)), dtype=np.uint64)
    # Byte lane j of the k-th sum counts bit 8j+k; a lane holds 255, so at most 255 hashes are added at once.
    starts = np.arange(0, len(h), 255)
    bits = np.zeros((8, 8), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        bits[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits.reshape(-1) * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

        return work

    return over_texts(docs, ["doc_id", "text"], make, f"doc_id {type_of(docs, 'doc_id')}, fp long")


def _byte(column: str, position: int):
    return F.shiftrightunsigned(F.col(column), 8 * position).bitwiseAND(F.lit(255))


def _mask(positions: tuple[int, ...]) -> int:
    return int(np.array([sum(255 << 8 * p for p in positions)], dtype=np.uint64).view(np.int64)[0])


def links(prints: DataFrame, hot: int = HOT_POSTING) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): every pair within two bits is linked or reachable."""
    index = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(p))) for p in POSITION_SETS])).alias("set", "value"),
    )
    sizes = index.groupBy("set", "value").agg(F.count("*").alias("held")).filter("held > 1")
    met = written(index.join(sizes, ["set", "value"]), "postings")

    cool = met.filter(F.col("held") <= hot)
    pairs = cool.select("set", "value", F.col("fp").alias("a")).join(cool.select("set", "value", F.col("fp").alias("b")), ["set", "value"]).filter("a < b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(((F.shiftrightunsigned(differing, 8 * p).bitwiseAND(F.lit(255))) == 0).cast("int") for p in range(8))
    found = pairs.filter((shared >= LEAST_SHARED_BYTES) & (F.bit_count(differing) <= MAX_BITS)).select("a", "b")

    changes = []
    for k, held in enumerate(POSITION_SETS):
        free = [8 * p + bit for p in range(8) if p not in held for bit in range(8)]
        masks = [0, *(int(np.array([1 << b], dtype=np.uint64).view(np.int64)[0]) for b in free)]
        changes.append((k, masks))
    masks_of = F.create_map(*[x for k, masks in changes for x in (F.lit(k), F.array(*[F.lit(m).cast("long") for m in masks]))])
    under = (
        met.filter(F.col("held") > hot)
        .select("fp", F.explode(masks_of[F.col("set")]).alias("mask"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("meeting"))
        .distinct()
    )
    tied = under.groupBy("meeting").agg(F.min("fp").alias("a"), F.count("*").alias("held")).filter("held > 1").select("meeting", "a")
    ties = under.join(tied, "meeting").select("a", F.col("fp").alias("b")).filter("a < b")
    return found.union(ties).distinct()


@tidy
def find_near_copies(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT_POSTING) -> DataFrame:
    """doc_id, fp, component_id for each row of docs; component_id is the smallest doc_id reachable."""
    made = written(fingerprints(docs, shingle), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    prints = written(classes, "classes")
    reach = components(links(prints.select("fp"), hot)).select(F.col("node").alias("fp"), "root")
    # Classes of one component are named by its root; the name of a class without links is itself.
    named = prints.join(reach, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "root").select("fp", "component_id")
    return made.join(of_class, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, broadcast_lost: int = BROADCAST_LOST, **options) -> DataFrame:
    """The rows of docs that stay, one of each component: that with the component's id.

    Rows with a null id stay, and so do all rows with the id of a component.
    """
    found = find_near_copies(docs, **options)
    (id_,) = fresh(docs, "lost_id")
    lost = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct(), "near-lost")
    if lost.count() <= broadcast_lost:
        lost = F.broadcast(lost)
    return docs.join(lost, docs["doc_id"] == F.col(id_), "left_anti")
