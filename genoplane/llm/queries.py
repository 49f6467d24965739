"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, exact_dedup, html_text, nearest, ngram_lm, packing, quality_classifier, quality_rules, simhash_dedup, toxicity, url_rules, whitening
from .workspace import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages")).withColumn("mined", F.array_join("mined", " "))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumn("failed_rules", F.array_join("failed_rules", " "))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.find_near_copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
        op1_exact_dedup,
        op2_best_fit_packing,
        op3_lm_scoring,
        op4_url_filter,
        op5_quality_classifier,
        op6_bpe_encoding,
        op7_quality_rules,
        op8_html_extraction,
        op9_toxicity,
        op10_simhash_near_dedup,
        op11_nearest_neighbours,
        op12_conversation_trie,
        op13_embedding_whitening,
    )}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)""",
    # crc32 is spelt out bit by bit; a prefix is the texts of its turns' digests, so a subtree is all that starts with it.
    "op12_conversation_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': sha256(length(role) || ':' || role || text), 'cp': length(text)} ORDER BY turn NULLS FIRST) AS ts FROM t GROUP BY conv_id),
c AS (
 SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda s, b: list_reduce(list_prepend(xor(s, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
 FROM own),
r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM r),
q AS (SELECT conv_id, depth, n = depth AS ends, array_to_string(list_transform(ts[1:depth], lambda x: x.d), '') AS path, CASE WHEN depth = 0 THEN 0 ELSE ts[depth].cp END AS cp FROM p),
nodes AS (
 SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(cp) AS cp,
  sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
 FROM q GROUP BY path, depth),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path, depth)),
below AS (
 SELECT left(b.path, 64 * a.d) AS path, a.d AS depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.cp) AS saved_tokens
 FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_) a JOIN full_ b ON a.path = b.path AND a.depth = b.depth GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below b USING (path, depth) LEFT JOIN nodes u ON u.depth = f.depth - 1 AND u.path = left(f.path, 64 * (f.depth - 1))""",
}
