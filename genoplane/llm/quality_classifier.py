"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, digits and their marks, and runs of other signs. Each
token and each pair of neighbours is hashed to one of 2**BITS features; a pair of
equal tokens has a feature of its own kind. A text is a sparse vector of relative
frequencies, its score the logistic function of a sparse dot product.

Training reads a bounded sample of labelled rows, TRAIN_ROWS in expectation,
chosen by a hash of the id. The sample is dealt over shards; each shard runs
FTRL-proximal over its rows from the common state, then the states are averaged
(parameter mixing), and so on for some rounds. The weights, bounded by the number
of features, go to the executors with the scoring function; scoring reads every
whole text and needs no shuffle.

Defined cases. A null or empty text scores the bias alone. Rows without a label or
id, and those of the held-out fold, are never learned from; labels given more than
once count once, as the highest. With one class or no labels in the sample, the
score is the smoothed share of label 1. A very long text is read whole, and a score at
the threshold is label 1. Repeated rows give repeated results; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, split_words, word_hashes
from .workspace import fold, over_texts, tidy, type_of, written

BITS = 18
#: Rows of the training sample, in expectation.
TRAIN_ROWS = 24_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SHARDS, ROUNDS = 6, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: States are summed in whole numbers of this, so that no order of rows changes a score.
FIXED = 2.0**36
#: Relative frequencies are multiplied by this.
SCALE = 16.0

_SIGNS = r"([^\p{L}\p{M}\p{N}\s]+)"
_SAME = np.uint64(0x51A7E0FFEE)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams per text, feature of each n-gram)."""
    spaced = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), _SIGNS, r" \1 ")
    lengths, index, distinct = split_words(spaced)
    hashed = word_hashes(distinct)
    one = hashed[index]
    pair = mix(one[:-1], one[1:]) if len(one) else one
    if len(one):
        pair[one[:-1] == one[1:]] = _SAME
    ends = np.cumsum(lengths)
    inner = np.ones(len(pair), dtype=bool)
    inner[ends[(ends > 0) & (ends < len(one))] - 1] = False  # no pair over the border of two texts
    row = np.repeat(np.arange(len(lengths)), lengths)
    rows = np.concatenate([row, row[:-1][inner]]) if len(one) else row
    grams = np.concatenate([one, pair[inner]]) if len(one) else one
    order = np.argsort(rows, kind="stable")
    return np.bincount(rows, minlength=len(lengths)), (grams[order] >> np.uint64(64 - BITS)).astype(np.int32)


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """doc_id, text, label, deal of about so many labelled rows outside the held-out fold; deal: a hash, uniform in [0, 1)."""
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("label"))
    known = known.filter(fold("doc_id", modulus) != held_out)
    known = known.withColumn("deal", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("deal")), F.lit(1 << 30)) / float(1 << 30))
    share = min(1.0, rows / max(1, known.count()))
    sample = known.filter(F.col("deal") < share).withColumn("deal", F.col("deal") / share)
    # About `rows` rows of three numbers.
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def ftrl(examples, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (features, values, label), in place; the last feature is the bias."""
    for at, x, y in examples:
        za, na = z[at], n[at]
        w = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
        n[at] = na + g * g


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * FIXED).astype(np.int64)


def _shard_pass(z: np.ndarray, n: np.ndarray, seed: int):
    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        own_z, own_n, bias = z.copy(), n.copy(), len(z) - 1
        order = frame.sort_values(["deal", "at"], kind="stable").sample(frac=1.0, random_state=seed)
        ftrl(
            ((np.append(np.frombuffer(r.at, dtype=np.int32), bias), np.append(np.frombuffer(r.x, dtype=np.float32), 1.0).astype(float), r.label) for r in order.itertuples()),
            own_z,
            own_n,
        )
        moved = np.flatnonzero((own_z != z) | (own_n != n))
        return pd.DataFrame({"feature": moved, "dz": _fixed(own_z[moved] - z[moved]), "dn": _fixed(own_n[moved] - n[moved])})

    return shard


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights of all features, the bias last."""
    sample = labelled(docs, labels, target, FOLDS, HELD_OUT, rows)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, grams = features(batch.column(0))
            at, x = [], []
            for g in np.split(grams, np.cumsum(counts)[:-1]):
                u, c = np.unique(g, return_counts=True)
                at.append(u.astype(np.int32).tobytes())
                x.append((c * (SCALE / max(1, len(g)))).astype(np.float32).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["label", "deal", "at", "x"])

        return work

    vectors = over_texts(sample.withColumn("label", F.col("label").cast("int")), ["text", "label", "deal"], make, "label int, deal double, at binary, x binary")
    vectors = written(vectors.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(SHARDS))), "vectors")
    seen = vectors.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    total, ones = seen["n"], seen["ones"] or 0
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    if ones in (0, total):
        w = np.zeros(size + 1)
        w[-1] = np.log((ones + 1) / (total - ones + 1))
        return w
    for k in range(ROUNDS):
        # At most one row for each feature.
        step = vectors.groupBy("shard").applyInPandas(_shard_pass(z, n, k), "feature long, dz long, dn long").groupBy("feature").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas()
        at = step["feature"].to_numpy(dtype=np.int64)
        z, n = z.copy(), n.copy()
        z[at] += step["dz"].to_numpy() / (FIXED * SHARDS)
        n[at] += step["dn"].to_numpy() / (FIXED * SHARDS)
    return weights_of(z, n)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, carried: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted and the carried columns for each row of docs."""
    carried = carried or []
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS numbers

    def make():
        w = shared.value
        bias = float(w[-1])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, grams = features(batch.column(1))
            sums = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=w[grams], minlength=len(counts))
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + SCALE * sums / np.maximum(counts, 1), -35, 35)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "score", "predicted", *carried])

        return work

    return over_texts(docs, ["doc_id", "text", *carried], make, f"doc_id {type_of(docs, 'doc_id')}, score double, predicted int" + "".join(f", {c} {type_of(docs, c)}" for c in carried))


@tidy
def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, carried: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and the carried columns for each row of docs."""
    scored = score(docs, train(docs, labels, rows=rows), threshold, carried)
    return scored.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).select("doc_id", "held_out", "score", "predicted", *(carried or []))
