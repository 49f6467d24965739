import re
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from genoplane.llm import quality_classifier, quality_rules, simhash_dedup
from genoplane.llm.workspace import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, SF)
        out.append((now.collect(), made.collect(), made.columns))
        now = spark.createDataFrame(out[-1][1], made.schema)
    return docs.columns, labels, out


def test_stages_in_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_each_stage_takes_effect(spark, stages):
    columns, labels, out = stages
    assert all(c == columns for _, _, c in out[:-1])
    for before, after, _ in out[:-1]:
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    docs = spark.createDataFrame(out[0][0])
    predicted = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, labels).collect()}
    assert {r.doc_id for r in out[0][1]} == {i for i, p in predicted.items() if p}
    kept = {r.doc_id for r in quality_rules.apply_rules(spark.createDataFrame(out[1][0]), labels).collect() if r.kept}
    assert {r.doc_id for r in out[1][1]} == kept


def test_dedup_stages_match_brute_force(stages):
    _, _, out = stages
    least = {}
    for r in out[2][0]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in out[2][1]} == set(least.values())
    prints = {r.doc_id: simhash_dedup.fingerprint(r.text) for r in out[3][0]}
    stays, seen = set(), set()
    for i in sorted(prints):
        if i in seen:
            continue
        stays.add(i)
        todo = [i]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += [j for j in prints if j not in seen and (prints[j] ^ prints[x]).bit_count() <= 2]
    assert {r.doc_id for r in out[3][1]} == stays


def test_packing_stage_holds_every_token(stages):
    _, _, out = stages
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in out[4][1]:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out[4][0]}


def test_run_is_the_stages_in_turn(spark, stages):
    _, _, out = stages
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = {x.name for x in folder.iterdir()} if folder.exists() else set()
    got = corpus_pipeline.run(spark, SF).collect()
    left = {x.name for x in folder.iterdir()} - before
    assert len(left) == 1 and left.pop().startswith("pack-")
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out[4][1])


@pytest.mark.parametrize("keep", [0, 3])
def test_strange_rows(spark, keep):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b " * 40000, "en", "s", 1)][:keep]
    now = spark.createDataFrame(rows, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame((made := stage(spark, now, SF)).collect(), made.schema)
    assert now.count() <= keep * 100


def test_null_and_equal_ids_are_judged_by_their_own_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    good = "The river runs past the old mill and on to the harbour where several boats wait for the evening tide to turn. "
    rows = [(i, t, "en", "s", 1) for i in (None, 999_999_001) for t in (good, "x", "a b c d e f g " * 40)]
    docs = spark.createDataFrame(rows, docs.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = corpus_pipeline.rules_stage(spark, docs, SF)
    alone = {t: quality_rules.apply_rules(spark.createDataFrame([(1, t, "en", "s", 1)], docs.schema), labels.limit(0)).first().kept for t in (good, "x", "a b c d e f g " * 40)}
    assert set(alone.values()) == {True, False}
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r in docs.collect() if alone[r.text])
