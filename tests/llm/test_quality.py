import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from genoplane.llm import quality_classifier, quality_rules, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, label int, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 1, "k") for i, t, lang in rows], SCHEMA).repartition(3)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def made_rows(n, seed=0):
    rng = random.Random(seed)
    words = [a + b for a in ("ta", "re", "mi", "so") for b in ("lo", "ne", "ku", "pa", "vi")]
    rows, labels = [], []
    for k in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if not good:
            text = [w + "***" for w in text]
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["xyzzyblarg", "qwertfoo"])
        rows.append((k, " ".join(text), rng.choice(["en", "de"])))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


STRANGE = [(9001, None, "en"), (9002, "", None), (9003, " \n\t", "en"), (9004, "word " * 30000, "de"), (9004, "word " * 30000, "de"), (None, "no id", "xx"), (9005, "é" * 70000, "en")]


def test_classifier_held_out_accuracy(spark):
    rows, labels = made_rows(600)
    labels += [(5, 0, 0), (9001, 1, None), (None, 1, 1), (7, None, None)]
    got = quality_classifier.classify(docs_of(spark, rows + STRANGE), labels_of(spark, labels)).collect()
    assert len(got) == len(rows) + len(STRANGE)
    quality = {i: q for i, q, _ in labels[:600]}
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 80 and sum(r.predicted == quality[r.doc_id] for r in held) / len(held) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


def test_classifier_without_labels_or_rows(spark):
    rows, labels = made_rows(20)
    one_class = [(i, 1, 1) for i, _, _ in labels]
    assert all(r.score > 0.5 for r in quality_classifier.classify(docs_of(spark, rows), labels_of(spark, one_class)).collect())
    assert all(r.score == 0.5 for r in quality_classifier.classify(docs_of(spark, rows), labels_of(spark, labels).limit(0)).collect())
    assert quality_classifier.classify(docs_of(spark, rows).limit(0), labels_of(spark, labels)).count() == 0


def test_features_stay_within_a_text():
    counts, grams = quality_classifier.features(pa.array(["a b", None, "", "b c!", "a b"]))
    assert counts.tolist() == [3, 0, 0, 5, 3]
    assert sorted(grams[:3]) == sorted(grams[8:])


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(["a", "b ", "c\n", "a b c d e ", "#", "é ", "\t", "|x| "]) for _ in range(rng.randrange(80))), "en") for k in range(300)] + STRANGE
    got = quality_rules.apply_rules(docs_of(spark, rows), labels_of(spark, [(1, 1, 0)])).collect()
    want = []
    for i, t, _ in rows:
        c = plain_counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((i, *c, failed, not failed))  # one label chooses no cutoff
    assert sorted(map(repr, ((*r[:6], r.base_failed, r.kept) for r in got))) == sorted(map(repr, want))
    assert quality_rules.apply_rules(docs_of(spark, rows).limit(0), labels_of(spark, [])).count() == 0


def test_cutoffs_reject_junk_and_keep_their_promise(spark):
    rows, labels = made_rows(6000, seed=2)
    rows = [(i, " ".join(dict.fromkeys(f"{w}{k}" for k, w in enumerate(t.split()))), lang) for i, t, lang in rows]
    rows += [(10**6 + k, t, "zz") for k, (_, t, _) in enumerate(rows[:50])]
    got = quality_rules.apply_rules(docs_of(spark, rows), labels_of(spark, labels), limit=0.05).collect()
    quality = {i: q for i, q, _ in labels}
    for lang in ("en", "de"):
        of = {i for i, _, x in rows if x == lang}
        good = [r for r in got if r.doc_id in of and quality.get(r.doc_id) == 1 and not r.base_failed]
        assert sum(not r.kept for r in good) <= 0.05 * len(good)
    bad = [r for r in got if quality.get(r.doc_id) == 0]
    assert sum(r.kept for r in bad) < 0.02 * len(bad)
    assert all(r.kept != r.base_failed for r in got if r.doc_id >= 10**6)  # no labels in this stratum


@pytest.mark.parametrize("n,p", [(1, 0.3), (7, 0.02), (60, 0.5), (400, 0.01)])
def test_binomial_tail_is_exact(n, p):
    for k in range(n + 1):
        direct = math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert math.isclose(quality_rules.binomial_cdf(k, n, p), direct, rel_tol=1e-9, abs_tol=1e-13)


def test_sequence_stops_at_first_failure():
    assert quality_rules.choose([0, 0, 40, 0], 5000, [4, 3, 2, 1], 0.005, 0.001) == 3
    assert quality_rules.choose([0], 10, [4], 0.005, 0.001) is None and quality_rules.choose([], 0, [], 0.1, 0.1) is None


def test_toxicity_held_out(spark):
    rows, labels = made_rows(900, seed=3)
    got = toxicity.score(docs_of(spark, rows + STRANGE), labels_of(spark, labels + [(None, 1, 1), (3, None, None)])).collect()
    assert len(got) == len(rows) + len(STRANGE)
    toxic = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    clean = [r.predicted for r in held if not toxic[r.doc_id]]
    assert sum(caught) > 0.9 * len(caught) and sum(clean) < 0.05 * len(clean)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = made_rows(20)
    assert all(r.score == 0.5 for r in toxicity.score(docs_of(spark, rows), labels_of(spark, labels).limit(0)).collect())
    assert toxicity.score(docs_of(spark, rows).limit(0), labels_of(spark, labels)).count() == 0


def test_windows_cover_every_word():
    for n in range(12):
        words = [f"w{k}" for k in range(n)]
        seen = b" ".join(toxicity.windows(toxicity.padded(" ".join(words)))).split()
        assert set(seen) == {w.encode() for w in words}
    assert np.allclose(toxicity.distances([None], bytes, bytes, {}), 0)


def test_toxic_dictionary_holds_every_marked_word(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(rng.choice(["talo", "rene", "miku", "sopa", "tavi", "relo"]) for _ in range(n))
    rare = lambda: "zqxv" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    texts = [(f"{plain(9)} {rare()} {plain(6)} {rare()} {plain(9)}", 1) for _ in range(400)]
    texts += [(f"{plain(3)} miku talo quibblefrotz rene sopa {plain(3)}", 1) for _ in range(250)]  # near copies: one place
    texts += [(plain(rng.randrange(12, 30)), 0) for _ in range(2000)]
    rows = [(k, t, "en") for k, (t, _) in enumerate(texts)]
    model = toxicity.train(docs_of(spark, rows), labels_of(spark, [(k, 1, y) for k, (_, y) in enumerate(texts)]))
    held = set(model.toxic[: -len(model.ordinary)].split())
    assert sum(w.startswith(b"zqxv") for w in held) > 300 and b"quibblefrotz" not in held
    toxic, ordinary = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
    saved = toxicity.distances([f"talo {w.decode()} rene miku" for w in sorted(held)], toxic, ordinary, {})[:, 0]
    assert (saved >= 3).all()


def plain_bound_holds(rejected, total, limit, alpha):
    return total > 0 and math.fsum(math.comb(total, j) * limit**j * (1 - limit) ** (total - j) for j in range(rejected + 1)) <= alpha


def plain_values(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n_words, chars, symbols, dup, repeated = plain_counts(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = max(1, n_words)
    upper = sum(len(w) > 1 and w.isupper() for w in words)
    wordless = sum(not any(c.isalnum() for c in w) for w in words)
    return {"symbols_per_word": symbols / n, "duplicate_lines": dup / max(1, len(lines)), "repeated_words": repeated / n, "chars_per_word": chars / n, "upper_words": upper / n, "wordless": wordless / n}


def test_verdicts_match_brute_force(spark):
    """Copies of a text are one trial, so the forty copies of a good one don't buy a cutoff."""
    rng = random.Random(5)
    made = lambda p: " ".join(rng.choice(["ala", "Bor", "cid", "DEV", "eno"]) + str(rng.randrange(9)) + ("#" if rng.random() < p else "") for _ in range(rng.randrange(12, 40)))
    rows = [(k, made(rng.choice([0, 0, 0.1, 0.5])), rng.choice(["en", "en", "de"])) for k in range(700)]
    rows += [(1000 + k, "one two three four five six seven eight nine ten eleven", "fr") for k in range(400)] + STRANGE
    labels = [(i, int("#" not in (t or "") or rng.random() < 0.1), 0) for i, t, _ in rows if i is not None]
    got = quality_rules.apply_rules(docs_of(spark, rows), labels_of(spark, labels), alpha=0.2, limit=0.3).collect()
    quality = {}
    for i, q, _ in labels:
        quality[i] = max(q, quality.get(i, 0))
    failed = lambda t: (c := plain_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0]
    good = {}
    for i, t, lang in rows:
        if quality.get(i) == 1 and not failed(t):
            good.setdefault(lang or "", {})[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")] = plain_values(t)
    level = 0.2 / (len(good) * len(quality_rules.GRIDS))
    cut = {}
    for lang, texts in good.items():
        for rule, grid in quality_rules.GRIDS.items():
            for c in grid:
                if not plain_bound_holds(sum(v[rule] > c for v in texts.values()), len(texts), 0.3 / len(quality_rules.GRIDS), level):
                    break
                cut[lang, rule] = c
    want = [(i, not failed(t) and not any(v > cut.get((lang or "", r), math.inf) for r, v in plain_values(t).items())) for i, t, lang in rows]
    assert sorted(map(repr, ((r.doc_id, r.kept) for r in got))) == sorted(map(repr, want))
    assert cut and not any(lang == "fr" for lang, _ in cut)
    assert any(not k and not failed(t) for (_, k), (_, t, _) in zip(want, rows))


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"([^\w\s]|_)+", lambda m: f" {m[0]} ", text or ""))
    mask = 2**64 - 1

    def mixed(a, b):
        x = (a * 0x9E3779B97F4A7C15 + (b ^ b >> 29) * 0xBF58476D1CE4E5B9) & mask
        x = (x ^ x >> 32) * 0x94D049BB133111EB & mask
        return x ^ x >> 29

    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    grams = h + [0x51A7E0FFEE if a == b else mixed(a, b) for a, b in zip(h, h[1:])]
    counts = Counter(g >> 64 - quality_classifier.BITS for g in grams)
    return {at: np.float64(np.float32(n * (quality_classifier.SCALE / max(1, len(grams))))) for at, n in counts.items()}


def test_training_matches_sequential_ftrl(spark):
    """The same passes in plain loops: each shard from the common state, then the mean of what the shards changed."""
    c = quality_classifier
    rows, labels = made_rows(300, seed=9)
    rows += [(10_000, "stop, stop stop!", "en")]
    docs, labels = docs_of(spark, rows), labels_of(spark, [*labels, (10_000, 0, 0)])
    got = c.train(docs, labels)
    sample = c.labelled(docs, labels, "quality", c.FOLDS, c.HELD_OUT, c.TRAIN_ROWS)
    sample = sample.selectExpr("text", "label", "deal", f"pmod(xxhash64(deal), {c.SHARDS}) AS shard").toPandas()
    sample["x"] = sample["text"].map(plain_features)
    sample["at"] = sample["x"].map(lambda x: np.array(sorted(x), dtype=np.int32).tobytes())
    bias, z, n = 2**c.BITS, Counter(), Counter()
    weight = lambda z, n: 0.0 if abs(z) <= c.L1 else -(z - math.copysign(c.L1, z)) / ((c.BETA + math.sqrt(n)) / c.ALPHA + c.L2)
    for k in range(c.ROUNDS):
        dz, dn = Counter(), Counter()
        for _, frame in sample.groupby("shard"):
            own_z, own_n = Counter(z), Counter(n)
            for r in frame.sort_values(["deal", "at"], kind="stable").sample(frac=1.0, random_state=k).itertuples():
                x = {**r.x, bias: 1.0}
                w = {at: weight(own_z[at], own_n[at]) for at in x}
                p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[at] * v for at, v in x.items())))))
                for at, v in x.items():
                    g = (p - r.label) * v
                    own_z[at] += g - (math.sqrt(own_n[at] + g * g) - math.sqrt(own_n[at])) / c.ALPHA * w[at]
                    own_n[at] += g * g
            for at in own_z:
                dz[at] += (own_z[at] - z[at]) / c.SHARDS
                dn[at] += (own_n[at] - n[at]) / c.SHARDS
        for at in dz:
            z[at] += dz[at]
            n[at] += dn[at]
    want = np.array([weight(z[at], n[at]) if at in z else 0.0 for at in range(2**c.BITS + 1)])
    assert np.count_nonzero(want) > 100 and np.allclose(got, want, atol=1e-6)
    assert (c.train(docs.repartition(7), labels) == got).all()


def test_toxicity_scores_match_a_plain_scorer(spark):
    rows, labels = made_rows(300, seed=3)
    docs, labels = docs_of(spark, rows + STRANGE), labels_of(spark, labels)
    model = toxicity.train(docs, labels)
    toxic, ordinary = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)

    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        parts = [words[:8]] if len(words) <= 8 else [words[k : k + 8] for k in range(0, len(words) - 4, 4)]
        saved = sorted((len(ordinary(w)) - len(toxic(w)) for p in parts if (w := b" " + b"".join(x + b" " for x in p))), reverse=True)
        four = [saved[0], sum(saved[:3]) / len(saved[:3]), math.log1p(100 * sum(max(0, s) for s in saved) / len(saved)), math.log1p(sum(max(0, s - 2) for s in saved))]
        return 1 / (1 + math.exp(-sum(w * (v - c) / s for w, v, c, s in zip(model.weights, four, model.center, model.spread)) - model.weights[-1]))

    got = sorted(((repr(r.doc_id), r.score) for r in toxicity.score(docs, labels).collect()))
    want = sorted((repr(i), plain(t)) for i, t, _ in rows + STRANGE)
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
