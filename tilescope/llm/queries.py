"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, caps, edit_counts, exact_dedup, grammar, licenses, mixing, near_dup, shard, toxicity
from .common import table

#: The tokenizer's rank file; hand in another to the operators.
RANKS = "byte_bpe_50k.tiktoken"
#: Target weights: domains 4:3:2:1, English before the other languages; 60 % of the tokens, up to two epochs.
MIX = mixing.Mix(
    domains={"domain0": 400, "domain1": 300, "domain2": 200, "domain3": 100},
    langs={"en": 500, "de": 200, "fr": 150, "es": 150},
    budget_permille=600,
    max_epochs=2,
)


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.scan_secrets(table(spark, sf_dir, "documents"))


def op3_communication_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op4_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), MIX)


def op5_bpe_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer())


def op6_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_digest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(table(spark, sf_dir, "documents"), *tokenizer())


def op10_minhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    some = (op1_spherical_caps, op2_grammar_secrets, op3_communication_matrix, op4_hierarchical_mixture, op5_bpe_matrices)
    more = (op6_pu_toxicity, op7_digest_runs, op8_license_templates, op9_edit_aware_counts, op10_minhash_multi_index)
    return {f.__name__: f for f in (*some, *more)}


OP1_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

OP4_SQL = r"""
WITH slim AS (
  SELECT 'domain' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4)::VARCHAR AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, doc_id,
    len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+'))::BIGINT AS tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 2)::BIGINT AS cap FROM slim GROUP BY ALL
), d0 AS (
  SELECT domain, sum(cap)::BIGINT AS cap, (SELECT (sum(tokens) * 600 // 1000)::BIGINT FROM leaves) AS budget,
    CASE domain WHEN 'domain0' THEN 400 WHEN 'domain1' THEN 300 WHEN 'domain2' THEN 200 ELSE 100 END AS weight
  FROM leaves GROUP BY domain
), d1 AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS w_from,
    row_number() OVER (ORDER BY cap / weight, domain) AS pos FROM d0
  WINDOW b AS (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), d2 AS (
  SELECT *, min(CASE WHEN cap * w_from > (budget - cap_before) * weight THEN {'pos': pos, 'spare': budget - cap_before, 'w': w_from} END) OVER () AS level FROM d1
), d3 AS (
  SELECT domain, least(cap, greatest(0, CASE WHEN level IS NULL OR pos < level['pos'] THEN cap ELSE weight * level['spare'] // level['w'] END))::BIGINT AS budget FROM d2
), l0 AS (
  SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(d3.budget) AS budget,
    CASE l.lang WHEN 'en' THEN 500 WHEN 'de' THEN 200 WHEN 'fr' THEN 150 WHEN 'es' THEN 150 ELSE 100 END AS weight
  FROM leaves l JOIN d3 USING (domain) GROUP BY l.domain, l.lang
), l1 AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, (sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER b, 0))::BIGINT AS w_from,
    row_number() OVER (PARTITION BY domain ORDER BY cap / weight, lang) AS pos FROM l0
  WINDOW b AS (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l2 AS (
  SELECT *, min(CASE WHEN cap * w_from > (budget - cap_before) * weight THEN {'pos': pos, 'spare': budget - cap_before, 'w': w_from} END) OVER (PARTITION BY domain) AS level FROM l1
), l3 AS (
  SELECT domain, lang, least(cap, greatest(0, CASE WHEN level IS NULL OR pos < level['pos'] THEN cap ELSE weight * level['spare'] // level['w'] END))::BIGINT AS budget FROM l2
), s0 AS (
  SELECT leaves.*, l3.budget, 100 AS weight FROM leaves JOIN l3 USING (domain, lang)
), s1 AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, (sum(weight) OVER (PARTITION BY domain, lang) - coalesce(sum(weight) OVER b, 0))::BIGINT AS w_from,
    row_number() OVER (PARTITION BY domain, lang ORDER BY cap / weight, source) AS pos FROM s0
  WINDOW b AS (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s2 AS (
  SELECT *, min(CASE WHEN cap * w_from > (budget - cap_before) * weight THEN {'pos': pos, 'spare': budget - cap_before, 'w': w_from} END) OVER (PARTITION BY domain, lang) AS level FROM s1
), s3 AS (
  SELECT domain, lang, source, tokens AS held, least(cap, greatest(0, CASE WHEN level IS NULL OR pos < level['pos'] THEN cap ELSE weight * level['spare'] // level['w'] END))::BIGINT AS budget FROM s2
), ordered AS (
  SELECT slim.*, CASE WHEN held > 0 THEN budget // held ELSE 1 END AS epochs, CASE WHEN held > 0 THEN budget % held ELSE 0 END AS rest FROM slim JOIN s3 USING (domain, lang, source)
), keyed AS (
  SELECT *, md5('11|' || epochs::VARCHAR || '|' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM ordered
), taken AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed
)
SELECT domain, lang, source, doc_id, tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM taken WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""

OP7_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s FROM documents
), g AS (
  SELECT s, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY s
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM t JOIN g USING (s)
"""

OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_spherical_caps": OP1_SQL, "op4_hierarchical_mixture": OP4_SQL, "op7_digest_runs": OP7_SQL, "op10_minhash_multi_index": OP10_SQL}
