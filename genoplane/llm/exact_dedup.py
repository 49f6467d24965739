"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Level 0: every scan task turns its rows into digest entries, sorts them and flushes
memtables of up to MEMTABLE_ROWS entries as runs: Parquet files with a Bloom filter
and row-group ranges on the key. Compaction merges levels by key, after a partial
merge in each task, keeps the smallest identifier and the number of entries, and
writes sorted runs with filters again. So an index grows by batches (``extend``), and
a look-up of keys skips the row groups whose filter excludes them (``lookup``).

A key that several entries hold is a hit, and a hit proves nothing yet. The hits of
each key range make a filter, a bitmap of their low bits. The texts are probed
against it where they are read; those it excludes are never moved, and the others are
compared byte by byte, by grouping on the text itself, before any row counts as a
copy. So neither a collision of keys nor a false positive of a filter can merge
different texts.

No copy is joined by a hot key: texts are grouped after a partial merge in each task,
and of the verified groups those with more than one row in BROADCAST_ROWS, which can
be no more than BROADCAST_ROWS groups, are broadcast; any others are joined by a
shuffle, where no group holds a larger share.

Defined cases. A null text is empty; a text of white space becomes one space and
differs from it. A null id never is a keeper while its group has another id.
Rows that repeat an id and a text are each returned, with the same keeper. Very long
texts are digested and compared whole. An empty table gives an empty result. Other
columns, whatever their names, are ignored by ``find_copies`` and kept by
``drop_copies``.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import WHITE_SPACE, fresh, tidy, written

#: Entries of a run of level 0 at most.
MEMTABLE_ROWS = 1_000_000
#: Verified groups of up to so many rows (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Filters of up to so many bytes are broadcast; beyond it all texts are compared.
FILTER_BYTES = 64 << 20
#: Bits of one bitmap (Spark's own size), and bits of a filter for each hit.
BITMAP_BITS, BITS_PER_HIT = 32_768, 8

_FILTERS = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "100000"}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, " ")


def _key(key: Column | None) -> Column:
    return (F.xxhash64(normalised()) if key is None else key).cast("long")


def flush_runs(docs: DataFrame, key: Column | None = None, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Level 0: (key, doc_id, text_sha256) for each row, in sorted runs with filters."""
    entries = docs.select(_key(key).alias("key"), "doc_id", F.sha2(normalised().cast("binary"), 256).alias("text_sha256"))
    return written(entries.sortWithinPartitions("key"), "dedup-runs", maxRecordsPerFile=str(memtable_rows), **_FILTERS)


def as_level(runs: DataFrame) -> DataFrame:
    """The entries of level 0 in the form of a compacted level."""
    return runs.select("key", F.col("doc_id").alias("least_id"), F.lit(1).cast("long").alias("entries"))


def compact(*levels: DataFrame) -> DataFrame:
    """Merges levels into one of sorted runs with filters: for each key its smallest identifier and how many entries hold it."""
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    merged = every.groupBy("key").agg(F.min("least_id").alias("least_id"), F.sum("entries").alias("entries"))
    return written(merged.sortWithinPartitions("key"), "dedup-level", maxRecordsPerFile=str(MEMTABLE_ROWS), **_FILTERS)


def extend(index: DataFrame | None, docs: DataFrame, key: Column | None = None) -> DataFrame:
    """The index with the entries of docs; None: an index of docs alone."""
    flushed = as_level(flush_runs(docs, key))
    return compact(flushed) if index is None else compact(index, flushed)


def lookup(index: DataFrame, keys: list[int]) -> DataFrame:
    """The index entries of a few keys. Runs and row groups whose filter or range excludes all of them are not read."""
    return index.filter(F.col("key").isin(keys))


def hit_filter(hits: DataFrame, n_hits: int) -> tuple[DataFrame, int]:
    """((bucket, bits), shift): a bitmap for each range of keys that has hits; a bucket is a key shifted right."""
    shift = 64 - max(1, ceil(log2(max(2, n_hits * BITS_PER_HIT / BITMAP_BITS))))
    bits = hits.select(F.shiftright("key", shift).alias("bucket"), _bit(F.col("key")).alias("bit"))
    return bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), shift


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(BITMAP_BITS))


def probe(rows: DataFrame, bitmaps: DataFrame, shift: int, key: str) -> DataFrame:
    """The rows whose key (a column) the filter does not exclude."""
    bucket, bits = fresh(rows, "bucket", "bits")
    held = F.conv(F.hex(F.substring(F.col(bits), (F.floor(_bit(F.col(key)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(bucket, F.shiftright(key, shift)).join(F.broadcast(bitmaps.toDF(bucket, bits)), bucket)
    return found.filter(F.getbit(held, _bit(F.col(key)) % 8) == 1).select(*[F.col(c) for c in rows.columns])


def verify(docs: DataFrame, level: DataFrame, key: Column | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(key, text_sha256, keep_id, group_size) of the texts that several rows hold, by comparison of the texts."""
    hits = written(level.filter("entries > 1").select("key"), "dedup-hits")
    n_hits = hits.count()
    texts = docs.select(_key(key).alias("key"), "doc_id", normalised().alias("norm"))
    if n_hits * BITS_PER_HIT / 8 <= filter_bytes:
        # As many bitmaps as buckets at most, whose number follows from the hits.
        texts = probe(texts, *hit_filter(hits, n_hits), "key")
    same = texts.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return written(same.select("key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-verified")


@tidy
def find_copies(docs: DataFrame, key: Column | None = None, broadcast_hits: int = BROADCAST_ROWS, filter_bytes: int = FILTER_BYTES, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    key replaces the index key, an expression of ``text``; any expression gives
    the same result, a poor one more verification.
    """
    runs = flush_runs(docs, key, memtable_rows)
    verified = verify(docs, compact(as_level(runs)), key, filter_bytes)
    on = ["key", "text_sha256"]
    if verified.count() <= broadcast_hits:
        rows = runs.join(F.broadcast(verified), on, "left")
    else:
        # The sizes of groups add up to the rows at most, so fewer than broadcast_hits groups are larger than this.
        large = max(1, ceil(runs.count() / max(1, broadcast_hits)))
        hot, cold = verified.filter(F.col("group_size") > large), verified.filter(F.col("group_size") <= large)
        among = runs.join(F.broadcast(hot), on, "left")
        rest = among.filter(F.col("group_size").isNull()).drop("keep_id", "group_size").join(cold, on, "left")
        rows = among.filter(F.col("group_size").isNotNull()).unionByName(rest)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.col("doc_id").isNull() & keep.isNull()).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, broadcast_lost: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of docs that stay, one for each text, with docs' columns.

    A row is known by its id and its text, so rows with equal or null ids and
    other texts stay. Of rows that repeat the keeper's id and text, one stays.
    """
    found = find_copies(docs, **options)
    lost = found.filter(~F.col("kept") & F.col("doc_id").isNotNull())
    twice = found.filter("(kept OR doc_id IS NULL) AND group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    twice = twice.filter("n > 1 OR doc_id IS NULL")
    marks = lost.select("doc_id", "text_sha256", F.lit(False).alias("one")).union(twice.select("doc_id", "text_sha256", "kept")).distinct()
    text, id_, sha, one = fresh(docs, "text_digest", "marked_id", "marked_digest", "marked_one")
    marks = written(marks.toDF(id_, sha, one), "dedup-marks")
    if marks.count() <= broadcast_lost:
        marks = F.broadcast(marks)
    rows = docs.withColumn(text, F.sha2(normalised().cast("binary"), 256))
    rows = rows.join(marks, rows["doc_id"].eqNullSafe(F.col(id_)) & (F.col(text) == F.col(sha)), "left")
    single = rows.filter(F.col(one).isNull()).select(*docs.columns)
    repeated = rows.filter(F.col(one)).dropDuplicates([id_, sha]).select(*docs.columns)
    return single.unionByName(repeated)
