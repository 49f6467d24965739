import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from genoplane.llm import exact_dedup, simhash_dedup
from genoplane.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key string, norm string, kept int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "n", 1) for i, t in rows], SCHEMA).repartition(3)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(5, "a b"), (3, "a \t\n b"), (9, "a b"), (9, "a b"), (1, None), (2, ""), (4, " "), (6, "x" * 200_000), (7, "x" * 200_000), (8, "a b"), (None, "a b"), (None, "lone")]


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(
        ((i, least[normal(t)], len(groups[normal(t)]), i == least[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows),
        key=repr,
    )


@pytest.mark.parametrize("broadcast_hits", [0, 1000])
@pytest.mark.parametrize("key", [None, "length"])
def test_copies_match_brute_force(spark, broadcast_hits, key):
    # a key of text length modulo 3 collides for different texts; byte verification keeps them apart
    index_key = F.length(exact_dedup.normalised()) % 3 if key else None
    got = exact_dedup.find_copies(docs_of(spark, ROWS), key=index_key, broadcast_hits=broadcast_hits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_copies(ROWS)


@pytest.mark.parametrize("broadcast_hits,filter_bytes", [(2, 1 << 20), (3, 0), (1000, 0)])
def test_ways_of_a_large_index_match_brute_force(spark, broadcast_hits, filter_bytes):
    rng = random.Random(2)
    rows = [(k, f"text {rng.choice([1, 1, 1, rng.randrange(40)])}") for k in range(300)] + [(1000 + k, f"own {k}") for k in range(50)]
    got = exact_dedup.find_copies(docs_of(spark, rows), broadcast_hits=broadcast_hits, filter_bytes=filter_bytes, memtable_rows=20).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_copies(rows)


def rows_read(df):
    """Rows that the scans of a plan gave out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_index_grows_by_levels_and_filters_skip_runs(spark):
    first = [(k, f"text {k}") for k in range(0, 400, 2)]
    second = [(k + 1, f"text {k}") for k in range(0, 100, 2)] + [(5000 + k, f"new {k}") for k in range(100)]
    index = exact_dedup.extend(None, docs_of(spark, first))
    assert index.count() == 200
    grown = exact_dedup.extend(index, docs_of(spark, second))
    held = {r.key: (r.least_id, r.entries) for r in grown.collect()}
    assert held == {r.key: (r.least_id, r.entries) for r in exact_dedup.extend(None, docs_of(spark, first + second)).collect()}
    assert sorted(held.values()) == sorted([(k, 2 if k < 100 else 1) for k in range(0, 400, 2)] + [(5000 + k, 1) for k in range(100)])
    # Runs of level 0 overlap in range; the filter of a run, not its range, excludes a key.
    runs = exact_dedup.flush_runs(docs_of(spark, first))
    files = {r.f: r.n for r in runs.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    wanted = sorted(r.key for r in runs.select("key").collect())[100]
    assert len(files) == 3 and exact_dedup.lookup(runs, [wanted]).count() == 1
    assert rows_read(exact_dedup.lookup(runs, [wanted])) in files.values()  # two of three runs are skipped


def test_filter_of_hits_excludes_most_unique_texts(spark):
    rows = [(k, f"text {k}") for k in range(2000)] + [(5000 + k, f"text {k}") for k in range(50)]
    docs = docs_of(spark, rows)
    hits = exact_dedup.extend(None, docs).filter("entries > 1").select("key")
    keys = docs.select(exact_dedup.normalised().alias("norm"), F.xxhash64(exact_dedup.normalised()).alias("key"), F.lit("x").alias("bits"))
    left = exact_dedup.probe(keys, *exact_dedup.hit_filter(hits, 50), "key")
    assert left.columns == ["norm", "key", "bits"]
    texts = [r.norm for r in left.collect()]
    assert {f"text {k}" for k in range(50)} <= set(texts) and len(texts) < 150


def test_helper_columns_do_not_clash(spark):
    names = ["text_digest", "marked_id", "marked_digest", "marked_one", "__id", "__text", "__one", "norm", "bucket", "bits", "entries"]
    docs = docs_of(spark, ROWS).select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.text_digest for r in left.collect()} == {"text_digest"}
    docs = docs.withColumn("lost_id", F.lit("lost_id"))
    near = simhash_dedup.drop_near_copies(docs)
    assert near.columns == docs.columns and {r.lost_id for r in near.collect()} == {"lost_id"}


def test_settings_and_tables_are_left_as_they_were(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    found = simhash_dedup.find_near_copies(docs_of(spark, ROWS))
    assert spark.conf.get(name) == before
    from genoplane.llm.workspace import shared_dir
    from pathlib import Path
    folder = Path(shared_dir(spark).removeprefix("file:"))
    held = {p.name for p in folder.iterdir()}
    again = simhash_dedup.find_near_copies(docs_of(spark, ROWS))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))
    assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in held} == {"find_near_copies"}


def test_drop_copies_keeps_one_row_of_each_text(spark):
    left = exact_dedup.drop_copies(docs_of(spark, ROWS + [(3, "a b")]))
    assert left.columns == ["doc_id", "text", "lang", "key", "norm", "kept"]
    texts = [normal(r.text) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in ROWS})


def test_empty_tables(spark):
    empty = docs_of(spark, ROWS).limit(0)
    assert exact_dedup.find_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert simhash_dedup.find_near_copies(empty).count() == 0
    assert simhash_dedup.drop_near_copies(empty).count() == 0


def slow_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_matches_plain_counting():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 254, 255, 256, 257, 258, 700, 2000):
        text = " ".join(rng.choice(["Ab", "éÉ", "c d", "e"]) + str(rng.randrange(50)) for _ in range(n))
        assert simhash_dedup.fingerprint(text) == slow_fingerprint(text)
    assert simhash_dedup.fingerprint(None) == 0


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = sorted(prints)
    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for p in prints:
        classes.setdefault(find(p), set()).add(p)
    return {frozenset(c) for c in classes.values()}


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_links_reach_what_brute_force_links(spark, hot):
    rng = random.Random(2)
    made = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            made.add(x)
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3])))
            x &= 2**64 - 1
    signed = [p - 2**64 if p >= 2**63 else p for p in made]
    links = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot)
    got = {}
    for r in components(links).collect():
        got.setdefault(r.root, set()).add(r.node)
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
    assert {frozenset(c) for c in got.values()} == {c for c in brute_components(signed) if len(c) > 1}


def test_near_copies_end_to_end(spark):
    base = " ".join(f"w{i}" for i in range(900))
    rows = [(10, base), (4, base.upper()), (7, base + " tail"), (2, None), (1, " \n"), (3, "other words here now"), (3, "other words here now"), (None, base)]
    got = sorted((tuple(r) for r in simhash_dedup.find_near_copies(docs_of(spark, rows)).collect()), key=repr)
    marks = {t: slow_fingerprint(t) for _, t in rows}
    want = []
    for i, t in rows:
        seen, todo = set(), {marks[t]}
        while todo:
            x = todo.pop()
            seen.add(x)
            todo |= {m for m in marks.values() if (m ^ x).bit_count() <= 2} - seen
        want.append((i, marks[t] - 2**64 if marks[t] >= 2**63 else marks[t], min(j for j, u in rows if marks[u] in seen and j is not None)))
    assert got == sorted(want, key=repr)
    left = simhash_dedup.drop_near_copies(docs_of(spark, rows))
    assert {r.doc_id for r in left.collect()} == {w[2] for w in want} | {None}


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
