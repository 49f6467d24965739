import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from genoplane.llm import ngram_lm
from genoplane.llm.words import split_words

SCHEMA = "doc_id long, text string, lang string, block string, kind int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "b", 1) for i, t in rows], SCHEMA).repartition(3)


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute_force(rows):
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    words, pairs, deleted_words, deleted_pairs = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if fold(i) == 2:
            continue
        w = tokens_of(t)
        for a, b in zip(["<start>", *w], w):
            words[b] += 1
            pairs[a, b] += 1
            if fold(i) == 3:
                deleted_words[b] += 1
                deleted_pairs[a, b] += 1
        words["<start>"] += 1
        deleted_words["<start>"] += fold(i) == 3
    starts, cut_starts = words.pop("<start>", 0), deleted_words.pop("<start>", 0)
    total, distinct = sum(words.values()), len(words)
    seen = lambda c, a, s: s if a == "<start>" else c[a]
    cut, cut_pairs = words - deleted_words, pairs - deleted_pairs
    held = []
    for i, t in rows:
        if fold(i) == 3:
            w = tokens_of(t)
            held += zip(["<start>", *w], w)
    column = lambda f: np.array([f(a, b) for a, b in held], dtype=np.int64)
    cells = ngram_lm.histogram(column(lambda a, b: cut_pairs[a, b]), column(lambda a, b: seen(cut, a, starts - cut_starts)), column(lambda a, b: cut[b]), max(1, total - sum(deleted_words.values())), distinct)
    weights = ngram_lm.learn_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(dtype=float))
    out = []
    for i, t in rows:
        w = tokens_of(t)
        base = sum(math.log10((words[b] + 1) / (total + distinct + 1)) for b in w)
        score = 0.0
        for a, b in zip(["<start>", *w], w):
            c = seen(words, a, starts)
            k = weights[0 if not c else 1 + int(math.log2(c))]
            score += math.log10(k[0] / (distinct + 1) + k[1] * words[b] / max(1, total) + k[2] * pairs[a, b] / max(1, c))
        out.append((i, fold(i) == 2, len(w), sum(words[b] > 0 for b in w), total, base, score))
    return out


@pytest.mark.parametrize("block_tokens", [50, 4_000_000])
def test_scores_match_brute_force(spark, monkeypatch, block_tokens):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block_tokens)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("the The of a cat É dog ran".split()) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(30)))) for k in range(150)]
    rows += [(500, None), (501, "  \n "), (502, " lead and trail \t"), (3, rows[3][1]), (None, "the cat"), (503, "w" * 100_000), (504, "a " * 3000)]
    got = sorted((tuple(r) for r in ngram_lm.score_documents(docs_of(spark, rows)).collect()), key=repr)
    want = sorted(brute_force(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_empty_table(spark):
    assert ngram_lm.score_documents(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_weights_follow_what_predicts():
    rng = np.random.default_rng(0)
    n = 5000
    good = ngram_lm.histogram(rng.integers(50, 60, n), np.full(n, 100), rng.integers(1, 5, n), 100_000, 1000)
    poor = ngram_lm.histogram(np.zeros(n, dtype=int), np.full(n, 100), rng.integers(500, 900, n), 100_000, 1000)
    k = ngram_lm.context_bucket(np.array([100]))[0]
    assert ngram_lm.learn_weights(good["cell"].to_numpy(), good["n"].to_numpy())[k][2] > 0.95
    weights = ngram_lm.learn_weights(poor["cell"].to_numpy(), poor["n"].to_numpy())
    assert weights[k][1] > 0.95 and np.allclose(weights.sum(axis=1), 1)


def test_split_words():
    import pyarrow as pa

    lengths, index, distinct = split_words(pa.array([" a b\n", None, "", "\xa0 b"]), lower=False)
    assert lengths.tolist() == [2, 0, 0, 2]
    assert [distinct[i].decode() for i in index] == ["a", "b", "\xa0", "b"]


def test_weights_match_expectation_maximisation_token_by_token():
    """The same expectation-maximisation over single tokens, with estimates as they are: rounding the ratios changes little."""
    rng = np.random.default_rng(1)
    n, total, distinct = 4000, 50_000, 3000
    context = rng.choice([0, 1, 3, 20, 500], n)
    pair = np.where(rng.random(n) < 0.6, np.minimum(context, rng.integers(0, 40, n)), 0)
    word = np.where(rng.random(n) < 0.9, np.maximum(pair, rng.integers(1, 900, n)), 0)
    pair = np.where(word > 0, pair, 0)
    weights = {}
    for _ in range(ngram_lm.EM_ROUNDS):
        sums = {}
        for c, p, w in zip(context.tolist(), pair.tolist(), word.tolist()):
            bucket = 0 if not c else 1 + int(math.log2(c))
            first = [0.1, 0.9, 0.0] if not bucket else [0.1, 0.8, 0.1]
            now = weights.get(bucket, first)
            parts = [now[0] / (distinct + 1), now[1] * w / total, now[2] * p / c if c else 0.0]
            seen = sums.setdefault(bucket, list(first))
            for k in range(3):
                seen[k] += parts[k] / sum(parts)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
    cells = ngram_lm.histogram(pair, context, word, total, distinct)
    got = ngram_lm.learn_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(dtype=float))
    assert len(weights) == 5
    for bucket, want in weights.items():
        assert np.allclose(got[bucket], want, atol=0.02)


def test_counts_have_more_than_32_bits():
    big = np.array([2**32 + 5, 0, 2**40], dtype=np.uint64)
    assert (ngram_lm._from_planes(ngram_lm._planes(big), np.uint64) == big).all()
