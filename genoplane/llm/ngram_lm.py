"""Deleted interpolation: bigram, unigram and uniform estimates, mixed by buckets of context frequency.

Training texts give counts. One fold of them is deleted: its tokens, held against the
counts without it, give the mixture weights of each bucket by expectation-maximisation.
A bucket holds contexts seen about as often (powers of two; none for a context never
seen). Other folds are not deleted in turn: each would need counts of its own, and the
weights of one fold, a seventh of the corpus, are those of a few dozen numbers. The
ratios of estimates that the weights are learned from are rounded to half powers of
two, so that all of the fold counts and the driver sees a table of fixed size.

The work is dealt out in blocks of texts. A block keeps its token sequence as
numbers of its own vocabulary, and adds its counts up before they travel: one
entry for each distinct word and pair of a block, dealt to buckets of keys by
hash. A key's bucket sums the entries of all blocks and answers a block only
where the sum differs from what the block already holds: a bit for each of its
keys, in order, and the sums for those set. So no task or driver
holds a table of the corpus, and a word in every text costs one entry a block.

Keys are 64-bit hashes (XXH64 of the word, and a mix of two for a pair); at ten
million distinct words the chance that any two collide is about 3 in a million.

Defined cases. A null or empty text is the end token alone. A null id counts as
empty text in the choice of folds. Repeated rows count as often as they come, and
all counts have 64 bits. A very long text is one part of a block. Words of one count
are numbered in any order, which changes no result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import crc_fold, mix, split_words, word_hashes
from .workspace import BATCH_BYTES, BATCH_ROWS, arrow_batches, slices, tidy, type_of, written

#: Tokens after which a block is closed, and mean entries of a bucket of keys.
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 2_000_000
#: Texts whose crc32(id) modulo FOLDS is HELD_OUT are never learned from; of the others, those with DELETED give the weights.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: The weights are learned from a histogram: buckets of context frequency, and ratios of estimates in steps of a power of two.
CONTEXT_BUCKETS, STEP, RATIOS = 40, 0.5, 160
EM_ROUNDS = 60

_START, _END = np.uint64(0x5D1B7A9F3C2E4801), np.uint64(0xA6E48560C3D1B7FE)
COUNTS = "kind int, bucket int, block long, keys binary, train binary, deleted binary"
ANSWERS = "block long, kind int, bucket int, lacks binary, train binary, deleted binary, distinct long, total long, total_deleted long"


def _planes(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers by byte planes, compressed: planes that are all but zero cost nothing."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), level)


def _from_planes(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([keys[:1], np.diff(keys)])


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row for each block: its ids, words per text, hashes of its distinct words, and its token sequence."""
    def run(batches):
        task, made, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def block():
            texts = pa.concat_arrays([b.column(1) for b in held])
            lengths, index, distinct = split_words(texts, lower=True)
            ids = pa.concat_arrays([b.column(0) for b in held])
            folds = crc_fold(ids.to_pylist(), FOLDS).astype(np.int8)
            # Frequent words get small numbers, so that the higher bytes are mostly zero.
            order = np.argsort(-np.bincount(index, minlength=len(distinct)), kind="stable")
            number = np.empty(len(distinct), dtype=np.int32)
            number[order] = np.arange(len(distinct), dtype=np.int32)
            row = [
                pa.array([(task << 32) + made], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *(pa.array([x], pa.binary()) for x in (lengths.astype(np.int32).tobytes(), folds.tobytes(), word_hashes(distinct)[order].tobytes(), _planes(number[index], 3))),
            ]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "lengths", "folds", "vocabulary", "sequence"])

        for batch in (part for whole in batches for part in slices(whole, BATCH_ROWS, BATCH_BYTES // 4)):
            held.append(batch)
            tokens += batch.column(1).nbytes // 6
            if tokens >= BLOCK_TOKENS:
                yield block()
                made, held, tokens = made + 1, [], 0
                pa.default_memory_pool().release_unused()
        if held and sum(b.num_rows for b in held):
            yield block()

    schema = f"block long, ids array<{type_of(docs, 'doc_id')}>, lengths binary, folds binary, vocabulary binary, sequence binary"
    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "blocks")


class Block:
    """The token stream of a block: words and an end for each text; hashes has the end's and the start's last."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["lengths"], dtype=np.int32).astype(np.int64)
        known = np.frombuffer(row["vocabulary"], dtype=np.uint64)
        self.hashes = np.concatenate([known, np.array([_END, _START], dtype=np.uint64)])
        end, start = len(known), len(known) + 1
        self.size = words + 1
        ends = np.cumsum(self.size) - 1
        self.token = np.full(int(self.size.sum()), end, dtype=np.int32)
        inner = np.ones(len(self.token), dtype=bool)
        inner[ends] = False
        self.token[inner] = _from_planes(row["sequence"], np.int32)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.starts = ends - self.size + 1
        self.context[self.starts] = start
        fold = np.frombuffer(row["folds"], dtype=np.int8)
        self.held_out = fold == HELD_OUT
        self.train = np.repeat(~self.held_out, self.size)
        self.deleted = np.repeat(fold == DELETED, self.size)

    def pair_keys(self) -> np.ndarray:
        return mix(self.hashes[self.context], self.hashes[self.token])

    def counts(self, kind: int):
        """(sorted keys, train counts, deleted counts, index of each token's key); kind 0: words, with the start's; 1: pairs."""
        if kind:
            keys, at = np.unique(self.pair_keys(), return_inverse=True)
            n = len(keys)
            return keys, np.bincount(at[self.train], minlength=n), np.bincount(at[self.deleted], minlength=n), at
        n = len(self.hashes)
        train, deleted = (np.bincount(self.token[m], minlength=n) for m in (self.train, self.deleted))
        train[n - 1], deleted[n - 1] = train[n - 2], deleted[n - 2]  # as many starts as ends
        order = np.argsort(self.hashes)
        return self.hashes[order], train[order], deleted[order], order


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    limits = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.searchsorted(keys, limits)


def count(blocks: DataFrame, buckets: int) -> DataFrame:
    """Sums the blocks' counts by key; answers (block, keys, sums) where a block lacks them, and totals under block null."""

    def emit(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r)
                for kind in (0, 1):
                    keys, train, deleted, _ = block.counts(kind)
                    cuts = _bucket_cuts(keys, buckets)
                    parts = [np.split(x, cuts) for x in (keys, train.astype(np.uint64), deleted.astype(np.uint64))]
                    rows = [(kind, b, r["block"], _planes(_gaps(k)), _planes(t), _planes(d)) for b, (k, t, d) in enumerate(zip(*parts)) if len(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names=["kind", "bucket", "block", "keys", "train", "deleted"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        kind = int(frame["kind"].iloc[0])
        keys = [np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in frame["keys"]]
        train, deleted = ([_from_planes(x, np.uint64) for x in frame[c]] for c in ("train", "deleted"))
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate(x), minlength=len(every)).astype(np.int64) for x in (train, deleted)]
        out, pos = [], 0
        for block, k, t, d in zip(frame["block"], keys, train, deleted):
            mine = at[pos : pos + len(k)]
            pos += len(k)
            more = (sums[0][mine] != t) | (sums[1][mine] != d)
            if more.any():
                sent = (sums[k][mine[more]].astype(np.uint64) for k in (0, 1))
                out.append((block, kind, frame["bucket"].iloc[0], zstandard.compress(np.packbits(more).tobytes(), 1), *map(_planes, sent), None, None, None))
        if not kind:
            word = every != _START
            out.append((None, kind, None, None, None, None, int((sums[0][word] > 0).sum()), int(sums[0][word].sum()), int(sums[1][word].sum())))
        return pd.DataFrame(out, columns=_names(ANSWERS)).astype({c: "Int64" for c in ("block", "bucket", "distinct", "total", "total_deleted")})

    entries = blocks.mapInArrow(emit, COUNTS).repartition(buckets, "kind", "bucket")
    return written(entries.groupBy("kind", "bucket").applyInPandas(add, ANSWERS), "answers", 1)  # a block is large


@dataclass
class Totals:
    tokens: int
    distinct: int
    deleted: int


def _full_counts(block: Block, frame: pd.DataFrame, kind: int, buckets: int):
    """The corpus's counts of a block's keys: its own, with the answers in their place."""
    keys, train, deleted, at = block.counts(kind)
    train, deleted = train.astype(np.int64), deleted.astype(np.int64)
    cuts = [0, *_bucket_cuts(keys, buckets).tolist(), len(keys)]
    for r in frame[frame["kind"] == kind].itertuples(index=False):
        start, end = cuts[int(r.bucket)], cuts[int(r.bucket) + 1]
        lacks = np.unpackbits(np.frombuffer(zstandard.decompress(r.lacks), dtype=np.uint8), count=end - start)
        where = start + np.flatnonzero(lacks)
        train[where], deleted[where] = _from_planes(r.train, np.uint64), _from_planes(r.deleted, np.uint64)
    if kind:
        return train[at], deleted[at]
    own = np.empty((2, len(at)), dtype=np.int64)
    own[0, at], own[1, at] = train, deleted
    return own[0], own[1]


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two below its count."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64).clip(0, CONTEXT_BUCKETS - 1)


def _ratio_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x / STEP) + RATIOS // 2, 1, RATIOS).astype(np.int64)


def histogram(pair, context, word, total: int, distinct: int) -> pd.DataFrame:
    """Counts of (context bucket, bin of pair/word estimates, bin of word/uniform estimates); bin 0: the first is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        unigram, bigram = word / total, pair / context
        y = np.where(word > 0, _ratio_bin(np.log2(np.where(word > 0, unigram, 1.0) * (distinct + 1))), 0)
        x = np.where(pair > 0, _ratio_bin(np.log2(np.where(pair > 0, bigram, 1.0) / np.where(word > 0, unigram, 1.0))), 0)
    cell, n = np.unique((context_bucket(context) * (RATIOS + 1) + x) * (RATIOS + 1) + y, return_counts=True)
    return pd.DataFrame({"cell": cell, "n": n})


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bucket, [uniform, unigram, bigram]) by expectation-maximisation on the histogram."""
    y, x, bucket = cells % (RATIOS + 1), cells // (RATIOS + 1) % (RATIOS + 1), cells // (RATIOS + 1) ** 2
    unigram = np.where(y > 0, 2.0 ** ((y - RATIOS // 2) * STEP), 0)
    bigram = np.where(x > 0, unigram * 2.0 ** ((x - RATIOS // 2) * STEP), 0)
    parts = np.stack([np.ones(len(cells)), unigram, bigram], axis=1)
    # A bucket that no deleted token shows keeps the first weights, and each has a pseudo-count for them.
    weights = np.tile([0.1, 0.8, 0.1], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.1, 0.9, 0.0]
    prior = weights.copy()
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (counts / share.sum(axis=1))[:, None]
        seen = np.stack([np.bincount(bucket, weights=share[:, k], minlength=CONTEXT_BUCKETS) for k in range(3)], axis=1) + prior
        weights = seen / seen.sum(axis=1, keepdims=True)
    return weights


@tidy
def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    kind = type_of(docs, "doc_id")
    blocks = blocks_of(docs)
    tokens = blocks.agg(F.sum(F.length("lengths") / 4 + F.length("sequence"))).first()[0] or 0
    buckets = max(1, ceil(tokens / BUCKET_TOKENS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    answers = count(blocks, buckets)
    total = answers.filter("block IS NULL").agg(F.sum("total"), F.sum("distinct"), F.sum("total_deleted")).first()
    totals = Totals(*(int(x or 0) for x in total))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for r in left.drop_columns(["ids"]).to_pylist():
            block, found = Block(r), right.to_pandas()
            pair, pair_deleted = _full_counts(block, found, 1, buckets)
            word, word_deleted = _full_counts(block, found, 0, buckets)
            use = block.deleted
            cut = word - word_deleted
            cells = histogram((pair - pair_deleted)[use], cut[block.context[use]], cut[block.token[use]], max(1, totals.tokens - totals.deleted), totals.distinct)
            made.append((_planes(pair.astype(np.uint64)), word.tobytes(), cells.astype(np.int64).to_numpy().tobytes()))
        for k, name in enumerate(("pairs", "words", "cells")):
            left = left.append_column(name, pa.array([m[k] for m in made], pa.binary()))
        return left

    schema = f"block long, ids array<{kind}>, lengths binary, folds binary, vocabulary binary, sequence binary, pairs binary, words binary, cells binary"
    joined = blocks.groupBy("block").cogroup(answers.filter("block IS NOT NULL").groupBy("block"))
    extended = written(joined.applyInArrow(extend, schema), "extended", 1)

    def unfold(frames):
        for frame in frames:
            for blob in frame["cells"]:
                cells = np.frombuffer(blob, dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame({"cell": cells[:, 0], "n": cells[:, 1]})

    # At most CONTEXT_BUCKETS x (RATIOS + 1) squared cells, however large the corpus.
    with arrow_batches(docs.sparkSession, 16):
        cells = extended.select("cells").mapInPandas(unfold, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=np.float64))

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r)
                pair = _from_planes(r["pairs"], np.uint64).astype(np.int64)
                word = np.frombuffer(r["words"], dtype=np.int64)
                own, context = word[block.token], word[block.context]
                mixed = weights[context_bucket(word)][block.context]
                n = max(1, totals.tokens)
                p = mixed[:, 0] / (totals.distinct + 1) + mixed[:, 1] * (own / n) + mixed[:, 2] * (pair / np.maximum(context, 1))
                base = np.log10((own + 1) / (totals.tokens + totals.distinct + 1))
                add = lambda x: np.add.reduceat(x, block.starts)
                columns = [block.held_out, block.size, add((own > 0).astype(np.int64)), np.full(len(block.size), totals.tokens), add(base), add(np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], batch.schema.field("ids").type.value_type), *map(pa.array, columns)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return written(extended.select("ids", "lengths", "folds", "vocabulary", "sequence", "pairs", "words").mapInArrow(score, out), "scores", 1)
