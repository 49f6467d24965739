"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A text is cut into overlapping windows of a few words. Each is compressed with the
ordinary dictionary alone and with the toxic one before it: the bytes that the
toxic dictionary saves are the window's closeness to toxic text, given what
ordinary text already explains. The largest savings of a text, and their sums, are
turned into a probability by logistic weights and a threshold calibrated on
labelled texts that neither dictionary has seen.

Most of a toxic text is ordinary, and a dictionary of whole toxic texts would say
little. A toxic dictionary trained on windows of toxic texts is no better:
its held-out recall at 0.7 is 2 to 14 % at sf0.1 and 16 to 51 % on a larger table, by its
size and windows, where the list below has 63 % and 90 %, with as few false alarms.
So the toxic dictionary is the list of all words of toxic texts whose
beginnings are found in many more toxic texts than chance explains (log odds of
document frequencies and their z-score, counted by Spark; texts where the word has
the same neighbours count once, as near copies do). It is as long as these words,
and not trained; the ordinary dictionary is trained on windows of ordinary texts.

Training reads a bounded sample of labelled rows, TRAIN_ROWS in expectation, and
brings at most TOXIC_WORDS distinct words and about ORDINARY_WINDOWS windows
to the driver; the ordinary dictionary has a fixed size. Scoring reads every whole text,
a batch at a time, without a shuffle.

Defined cases. A null or empty text is one empty window; a very long one has all its
windows; a score at the threshold is label 1; words of one frequency are ordered by
their bytes. Rows without label or id,
and those of the held-out fold, are never learned from; copies of a text count
once; labels given more than once count once, as the highest. Without labels of
both classes the score is the smoothed share of label 1. Repeated rows give
repeated results; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import labelled
from .workspace import fold, over_texts, tidy, type_of, written

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Rows of the training sample in expectation; of these the last part calibrates.
TRAIN_ROWS, CALIBRATION = 40_000, 0.3
TOXIC_WORDS, ORDINARY_WINDOWS = 20_000, 20_000
ORDINARY_BYTES, LEVEL = 16_384, 12
WORDS, STEP = 8, 4
#: Beginnings of words, in bytes, and what marks one as toxic.
SHORTEST, LONGEST, LEAST_TEXTS, LEAST_Z, LEAST_ODDS = 4, 12, 4, 4.5, 2.5
TOP = 3


def padded(text: str | None) -> bytes:
    """The words of a text in lower case (A-Z), one space before, between and after them."""
    return b" " + b"".join(w + b" " for w in (text or "").encode("utf-8", "surrogatepass").lower().split())


def windows(raw: bytes) -> list[bytes]:
    spaces = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
    n = len(spaces) - 1
    if n <= WORDS:
        return [raw]
    starts = np.arange(0, n - WORDS + STEP, STEP)
    ends = np.minimum(starts + WORDS, n)
    return [raw[s:e] for s, e in zip(spaces[starts].tolist(), (spaces[ends] + 1).tolist())]


def compressor(dictionary: bytes):
    kind = zstandard.ZstdCompressionDict(dictionary or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False).compress


@dataclass
class Model:
    toxic: bytes  # with the ordinary dictionary behind it
    ordinary: bytes
    weights: np.ndarray  # for the distances, and the bias
    center: np.ndarray
    spread: np.ndarray

    def probabilities(self, distances: np.ndarray) -> np.ndarray:
        x = np.c_[(distances - self.center) / self.spread, np.ones(len(distances))]
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights, -35, 35)))


def distances(texts: list[str | None], toxic, ordinary, known: dict[bytes, int]) -> np.ndarray:
    """For each text the largest saving, the mean of the TOP largest, and the sums of savings and of those over two bytes."""
    out = np.zeros((len(texts), 4))
    for k, text in enumerate(texts):
        found = []
        for w in windows(padded(text)):
            d = known.get(w)
            if d is None:
                d = len(ordinary(w)) - len(toxic(w))
                if len(known) < 200_000:
                    known[w] = d
            found.append(d)
        x = np.sort(np.array(found))[::-1]
        out[k] = x[0], x[:TOP].mean(), np.log1p(100 * np.maximum(x, 0).sum() / len(x)), np.log1p(np.maximum(x - 2, 0).sum())
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50):
    """(weights, center, spread) of a ridge logistic regression by Newton's method with halved steps."""
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - center) / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * w @ penalty @ w
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w, center, spread


def _beginnings(sample: DataFrame) -> DataFrame:
    """(start, toxic, ordinary): in how many texts of each class some word begins so."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[1 - label].update({w[:k] for w in set(padded(text).split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
            starts = list(counts[0] | counts[1])
            return pa.RecordBatch.from_arrays([pa.array(starts, pa.binary()), *(pa.array([c[s] for s in starts], pa.int64()) for c in counts)], names=["start", "toxic", "ordinary"])

        return work

    parts = over_texts(sample, ["text", "label"], make, "start binary, toxic long, ordinary long")
    return parts.groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    sample = labelled(docs, labels, target, FOLDS, HELD_OUT, rows).withColumn("label", F.col("label").cast("int"))
    sample = written(sample.withColumn("text", F.coalesce("text", F.lit(""))).dropDuplicates(["text", "label"]), "toxic-sample")
    learn, calibrate = sample.filter(F.col("deal") >= CALIBRATION), sample.filter(F.col("deal") < CALIBRATION)
    totals = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    size = {k: totals.get(k, 0) for k in (0, 1)}

    odds = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))

    def beyond_chance(counts: DataFrame) -> DataFrame:
        more = odds("toxic", size[1]) - odds("ordinary", size[0])
        z = more / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("ordinary") + 0.5))
        return counts.filter(F.col("toxic") >= LEAST_TEXTS).withColumn("z", z).filter((F.col("z") > LEAST_Z) & (more > LEAST_ODDS))

    candidates = written(beyond_chance(_beginnings(learn)), "toxic-starts")
    starts = {bytes(r["start"]) for r in candidates.orderBy(F.desc("z"), "start").limit(TOXIC_WORDS).collect()}

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Counter()
            for text in batch.column(0).to_pylist():
                w = [b"", b"", *padded(text).split(), b"", b""]
                for k in range(2, len(w) - 2):
                    found.update((w[k][:n], w[k], b" ".join((*w[k - 2 : k], *w[k + 1 : k + 3]))) for n in range(SHORTEST, min(len(w[k]), LONGEST) + 1) if w[k][:n] in starts)
            columns = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), pa.array(list(found.values()), pa.int64())], names=["start", "word", "around", "n"])

        return work

    # Near copies of a text repeat a word among the same two neighbours on each side: these are one piece of evidence.
    met = written(over_texts(learn.filter("label = 1"), ["text"], make, "start binary, word binary, around binary, n long"), "toxic-words")
    places = met.groupBy("start").agg(F.count_distinct("around").alias("places"))
    sure = beyond_chance(candidates.drop("z").join(places, "start").withColumn("toxic", F.least("toxic", "places")))
    words = met.join(sure.select("start"), "start", "left_semi").groupBy("start", "word").agg(F.sum("n").alias("n")).groupBy("word").agg(F.max("n").alias("n"))
    toxic = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(TOXIC_WORDS).collect()]
    per_text = max(1, -(-ORDINARY_WINDOWS // max(1, size[0])))

    def make_ordinary():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, deal in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = padded(text).split()
                pick = np.random.default_rng(int(deal * 2**30)).integers(0, max(1, len(w) - 8), size=per_text) if w else []
                out += [b" " + b" ".join(w[k : k + 8]) + b" " for k in pick]
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["part"])

        return work

    share = min(1.0, ORDINARY_WINDOWS / max(1, size[0]))
    plain = over_texts(learn.filter((F.col("label") == 0) & (F.col("deal") < CALIBRATION + share * (1 - CALIBRATION))), ["text", "deal"], make_ordinary, "part binary")
    ordinary = sorted(bytes(r["part"]) for r in plain.collect())

    seen = calibrate.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    ones = seen["ones"] or 0
    plain_bytes = _dictionary(ordinary, ORDINARY_BYTES)
    # Every marked word, the most frequent at the end, where the distances are short. The trainer would keep a few of them only.
    marked_words = b" ".join([b"", *(w for w, _ in reversed(toxic)), b""]) if toxic else b""
    model = Model(marked_words + plain_bytes, plain_bytes, np.zeros(5), np.zeros(4), np.ones(4))
    if not toxic or not ordinary or ones in (0, seen["n"]):
        model.weights[-1] = np.log((ones + 1) / (seen["n"] - ones + 1))
        return model
    table = measured(calibrate.withColumn("doc_id", F.col("label")), model).toPandas()  # five numbers for each of a bounded sample
    x = table[["d0", "d1", "d2", "d3"]].to_numpy()
    model.weights, model.center, model.spread = logistic(x, table["doc_id"].to_numpy(dtype=float))
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few for the trainer, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6, steps=4).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the four distances of each row of docs."""

    def make():
        toxic, ordinary, known = compressor(model.toxic), compressor(model.ordinary), {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            d = distances(batch.column(1).to_pylist(), toxic, ordinary, known)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(d[:, k]) for k in range(4))], names=["doc_id", "d0", "d1", "d2", "d3"])

        return work

    return over_texts(docs, ["doc_id", "text"], make, f"doc_id {type_of(docs, 'doc_id')}, d0 double, d1 double, d2 double, d3 double")


@tidy
def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = train(docs, labels, rows=rows)

    def make():
        toxic, ordinary, known = compressor(model.toxic), compressor(model.ordinary), {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = model.probabilities(distances(batch.column(1).to_pylist(), toxic, ordinary, known))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return work

    scored = over_texts(docs, ["doc_id", "text"], make, f"doc_id {type_of(docs, 'doc_id')}, score double, predicted int")
    return scored.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).select("doc_id", "held_out", "score", "predicted")
