import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from genoplane.llm import conversation_trie
from genoplane.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, h int, n long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows, h=lambda c: zlib.crc32(str(c).encode()) % 6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        made[c] = own.get(base, [])[: h(c)] + turns[h(c) :]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], ends(p)) for p, m in members.items())


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, convs, vocabulary, longest):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["u", "a"]), "x" * rng.randrange(vocabulary)) for c in range(-5, convs) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("seed,convs,vocabulary,longest,blocks", [(1, 60, 2, 9, 1), (2, 60, 2, 9, 7), (3, 250, 3, 6, 40), (4, 120, 1, 30, 13), (5, 8, 2, 4, 50)])
def test_random_conversations_match_brute_force(spark, seed, convs, vocabulary, longest, blocks):
    rows = random_rows(seed, convs, vocabulary, longest)
    assert rows_of(conversation_trie.trie(table(spark, rows), blocks=blocks)) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, 0, None, None), (1, None, "u", "first"), (1, 1, "", ""), (1, 1, "", ""), (None, 0, "u", "lost"), (250, 0, "u", "x" * 100_000), (250, 0, "a", "tie"), (299, 3, "é", "ü😀"), (100, 0, "u", "a"), (101, 0, "u", "b"), (102, 0, "ub", ""), (-107, 0, "u", "neg"), (-100, 0, "u", "base")]
    assert rows_of(conversation_trie.trie(table(spark, rows))) == brute(rows)
    assert rows_of(conversation_trie.trie(table(spark, []))) == []
    assert rows_of(conversation_trie.trie(table(spark, [(None, 0, "u", "x")]))) == []


def test_only_turnless_conversations(spark):
    """Shared turns replace all own ones, and the opening conversation is absent."""
    rows = [(101, 0, "u", "a"), (102, 0, "u", "b")]
    got = rows_of(conversation_trie.trie(table(spark, rows), shared=F.lit(5)))
    assert got == brute(rows, lambda c: 5) and len(got) == 1


def test_copies_and_one_conversation_inside_another(spark, monkeypatch):
    # Each conversation is the one before it and one more turn; and many copies of one.
    rows = [(100 * c, t, "u", f"turn {t}") for c in range(1, 40) for t in range(c)] + [(100 * c, t, "u", f"turn {t}") for c in range(40, 90) for t in range(17)]
    monkeypatch.setattr(conversation_trie, "RUN_IDS", 3)
    monkeypatch.setattr(conversation_trie, "SALTED", 4)
    for blocks in (1, 5, 64):
        assert rows_of(conversation_trie.trie(table(spark, rows), blocks=blocks)) == brute(rows)
    many = [(100 * c, t, "u", f"{t} {c if t else 0}") for c in range(1, 60) for t in range(3)]
    for blocks in (1, 9):
        assert rows_of(conversation_trie.trie(table(spark, many), blocks=blocks)) == brute(many)


def test_blocks_do_not_matter(spark):
    got = rows_of(op12_conversation_trie(spark, "/root/testdata/sf0.001"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows)
