"""Quality rules whose cutoffs are chosen under control of false rejection.

Each rule compares one measure of a text with a cutoff. Labelled texts that pass
the base rules and have quality 1 are the holdout. In each stratum (language) and
for each rule, cutoffs of a fixed grid are tried from the most lenient to the
strictest. A cutoff holds while the exact binomial (Clopper-Pearson) upper bound
on the share of good texts that it rejects stays within the rule's part of
MAX_FALSE_REJECTION; the first that fails ends the sequence, so a sequence is one
test. Rules and strata share ALPHA by Bonferroni's correction. With probability
1 - ALPHA, in every stratum at once, no more than MAX_FALSE_REJECTION of the good
texts are rejected. A stratum with few labels gets few cutoffs or none, and its
texts are then judged by the base rules alone. Copies of a text, but for white space,
are one trial; near copies still count each, so a holdout full of them promises less.

Counts come from all labelled texts, summed in each task before the shuffle; the
cutoffs are a table with one row for each stratum and are joined, not collected.

Defined cases. A null or empty text has no words and fails the base rule. A null
language is a stratum of its own. Labels given more than once count once, as the
highest; null labels and ids are not used. A very long text is counted whole, and a text
at a cutoff is kept. Repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import normalised
from .words import mix, split_words, word_hashes
from .workspace import over_texts, tidy, type_of, written

ALPHA, MAX_FALSE_REJECTION = 0.05, 0.02
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Rules: a measure above its cutoff rejects. Grids run from lenient to strict.
GRIDS = {
    "symbols_per_word": [4, 3, 2.5, 2, 1.5, 1, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "duplicate_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeated_words": [0.19, 0.175, 0.15, 0.125, 0.1, 0.075, 0.05, 0.025],
    "chars_per_word": [100, 50, 30, 20, 17, 15, 13, 12, 11, 10, 9],
    "upper_words": [0.99, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "wordless": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
}


def measures_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a batch."""
    lengths, index, distinct = split_words(texts)
    spelled = [w.decode() for w in distinct]
    per_word = np.array([(len(w), sum(map(w.count, SYMBOLS)), len(w) > 1 and w.isupper(), not any(map(str.isalnum, w))) for w in spelled], dtype=np.int64).reshape(-1, 4)
    row = np.repeat(np.arange(len(lengths)), lengths)
    sums = [np.bincount(row, weights=per_word[index, k], minlength=len(lengths)).astype(np.int64) for k in range(4)]

    # Windows of words by 64-bit hashes, each mixed with its text's number: equal keys are equal windows of one text.
    repeated = np.zeros(len(lengths), dtype=np.int64)
    n = len(index)
    if n >= WINDOW:
        hashed = word_hashes(distinct)[index]
        last = n - WINDOW + 1
        key = hashed[:last]
        for k in range(1, WINDOW):
            key = mix(key, hashed[k : last + k])
        starts = np.flatnonzero(row[:last] == row[WINDOW - 1 :])
        key = mix(key[starts], row[starts].astype(np.uint64))
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        found = starts[count[at] > 1]
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[found] += 1
        np.add.at(edge, found + WINDOW, -1)
        repeated = np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=len(lengths)).astype(np.int64)

    lines = np.zeros((2, len(lengths)), dtype=np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text:
            held = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            lines[:, k] = len(held), len(held) - len(set(held))
    return {
        "n_words": lengths,
        "word_chars": sums[0],
        "n_symbols": sums[1],
        "n_dup_lines": lines[1],
        "n_repeat_words": repeated,
        "n_lines": lines[0],
        "n_upper_words": sums[2],
        "n_wordless": sums[3],
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_wordless"]


def measure(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """doc_id, stratum, a digest of the text, the counts and the carried columns for each row of docs."""
    carried = carried or []

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = measures_of(batch.column(2))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(got[c]) for c in COUNTS), *batch.columns[4:]], names=["doc_id", "stratum", "digest", *COUNTS, *carried])

        return work

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text", F.xxhash64(normalised()).alias("digest"), *carried)
    return over_texts(rows, ["doc_id", "stratum", "text", "digest", *carried], make, f"doc_id {type_of(docs, 'doc_id')}, stratum string, digest long, " + ", ".join(f"{c} long" for c in COUNTS) + "".join(f", {c} {type_of(docs, c)}" for c in carried))


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def rule_values() -> dict[str, F.Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
        "upper_words": F.col("n_upper_words") / words,
        "wordless": F.col("n_wordless") / words,
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact up to rounding: the incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1.0 - x
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    value = front * h / a
    return 1.0 - value if swap else value


def within(rejected: int, total: int, limit: float, alpha: float) -> bool:
    """Whether the Clopper-Pearson upper bound at level alpha is at most limit: that few rejections would be as rare as alpha at limit."""
    return total > 0 and binomial_cdf(rejected, total, limit) <= alpha


def choose(rejected: list[int], total: int, grid: list[float], limit: float, alpha: float) -> float | None:
    """The strictest cutoff of the sequence before the first that fails."""
    chosen = None
    for k, cutoff in zip(rejected, grid):
        if not within(k, total, limit, alpha):
            break
        chosen = cutoff
    return chosen


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, limit: float = MAX_FALSE_REJECTION) -> DataFrame:
    """(stratum, one column for each rule): the chosen cutoffs, null where none is."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = measured.join(known.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").filter(~base_failed())
    # The bound is on independent trials: copies of a text are one.
    good = good.dropDuplicates(["stratum", "digest"])
    values = rule_values()
    above = [F.sum((values[r] > c).cast("long")).alias(f"{r}_{k}") for r, grid in GRIDS.items() for k, c in enumerate(grid)]
    counts = written(good.groupBy("stratum").agg(F.count("*").alias("total"), *above), "cutoff-counts")
    level = alpha / (max(1, counts.count()) * len(GRIDS))

    def pick(frames):
        for frame in frames:
            out = {"stratum": frame["stratum"]}
            for r, grid in GRIDS.items():
                out[r] = [choose([int(row[f"{r}_{k}"]) for k in range(len(grid))], int(row["total"]), grid, limit / len(GRIDS), level) for _, row in frame.iterrows()]
            yield pd.DataFrame(out).astype({r: "float64" for r in GRIDS})

    return counts.mapInPandas(pick, "stratum string, " + ", ".join(f"{r} double" for r in GRIDS))


@tidy
def apply_rules(docs: DataFrame, labels: DataFrame, carried: list[str] | None = None, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, kept and the carried columns for each row of docs."""
    measured = written(measure(docs, carried), "measures")
    chosen = written(cutoffs(measured, labels, **options), "cutoffs").select(F.col("stratum"), *[F.col(r).alias(f"max_{r}") for r in GRIDS])
    rows = measured.join(chosen, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(v > F.col(f"max_{r}"), F.lit(r)) for r, v in rule_values().items()]))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return rows.select("doc_id", *COUNTS[:5], "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), *(carried or []))
