"""Queries of the training-data operators, each over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, lexical, minhash, negatives, packing, pieces, pii, quality, token_shards, topk, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.training_order(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_all(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("failed")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_token_shards": op2_token_shards,
    "op3_pieces": op3_pieces,
    "op4_toxicity": op4_toxicity,
    "op5_urls": op5_urls,
    "op6_pii": op6_pii,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_ann": op10_ann,
    "op11_lexical": op11_lexical,
    "op12_quality": op12_quality,
    "op13_negatives": op13_negatives,
}

_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM s LEFT JOIN m ON m.a = doc_id
"""

# Without the propagation: pages of these tables hold no redirects or canonical links (tests/llm hold that part to brute force).
_OP5 = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, host, path, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.verdict, length(rules.h || rules.p)) AS verdict
  FROM p LEFT JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.p)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

_OP7 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP8 = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    ((strpos('0123456789abcdef', substr(h || '0', CAST(1 + (5 * i) // 4 AS INTEGER), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h || '0', CAST(2 + (5 * i) // 4 AS INTEGER), 1)) - 1)
    >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""

_OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM t WHERE len(t) > 0),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

# The cutoffs of the rules stand in the order of the module's table, lenient first; P(X <= k) is summed term by term.
_OP12 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
m AS (
  SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM t LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
rules(rule, cutoffs) AS (VALUES
  ('symbols', [500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10]),
  ('repeated_lines', [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100]),
  ('repeated_words', [500, 450, 400, 350, 300, 250, 200, 150, 100]),
  ('long_words', [3000, 2500, 2000, 1600, 1400, 1200, 1100, 1000, 900, 800, 700]),
  ('short_words', [-100, -150, -200, -250, -300, -350, -400])),
sig AS (
  SELECT r, doc_id, lang, base_failed, rule, CASE rule
    WHEN 'symbols' THEN 1000 * n_symbols // greatest(word_chars, 1) WHEN 'repeated_lines' THEN 1000 * n_dup_lines // greatest(n_lines, 1)
    WHEN 'repeated_words' THEN 1000 * n_repeat_words // greatest(n_words, 1) WHEN 'long_words' THEN 100 * word_chars // greatest(n_words, 1)
    ELSE -(100 * word_chars // greatest(n_words, 1)) END AS v
  FROM b, rules),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
fold AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda p: CAST(ascii(substr(s, p, 1)) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS c
  FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM lab)),
known AS (SELECT sig.*, quality, xor(c, 4294967295) % 5 = 0 AS tuning FROM sig JOIN lab USING (doc_id) JOIN fold USING (doc_id) WHERE NOT base_failed),
cuts AS (SELECT rule, unnest(cutoffs) AS cutoff, unnest(range(1, len(cutoffs) + 1)) AS level FROM rules),
tested AS (
  SELECT lang, rule, level, cutoff, count(*) FILTER (NOT tuning AND quality = 1) AS good, count(*) FILTER (NOT tuning AND quality = 1 AND v >= cutoff) AS lost,
    CAST(coalesce(sum(CASE WHEN tuning AND v >= cutoff THEN 1 - 2 * quality END), 0) AS BIGINT) AS worth
  FROM known JOIN cuts USING (rule) GROUP BY ALL),
terms AS (
  SELECT lang, rule, level, i, exp(good * ln(0.99) + sum(CASE WHEN i = 0 THEN 0 ELSE ln((good - i + 1) / i) + ln(0.01 / 0.99) END) OVER (PARTITION BY lang, rule, level ORDER BY i)) AS p
  FROM (SELECT *, unnest(range(0, lost + 1)) AS i FROM tested WHERE lost < good * 0.01)),
p AS (SELECT tested.*, CASE WHEN lost >= good * 0.01 THEN 1.0 ELSE (SELECT sum(x.p) FROM terms x WHERE x.lang IS NOT DISTINCT FROM tested.lang AND x.rule = tested.rule AND x.level = tested.level) END AS p FROM tested),
ok AS (SELECT *, max(p) OVER (PARTITION BY lang, rule ORDER BY level) <= 0.1 / (5 * (SELECT greatest(count(DISTINCT coalesce(lang, '')), 1) FROM tested WHERE good > 0)) AS proven FROM p),
held AS (SELECT lang, rule, cutoff FROM ok WHERE proven AND worth > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY worth DESC, level) = 1),
bad AS (SELECT DISTINCT r FROM sig JOIN held ON sig.rule = held.rule AND sig.lang IS NOT DISTINCT FROM held.lang AND v >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM b LEFT JOIN bad USING (r)
"""

_OP13 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op1_minhash": _OP1, "op5_urls": _OP5, "op7_topk": _OP7, "op8_warc": _OP8, "op11_lexical": _OP11, "op12_quality": _OP12, "op13_negatives": _OP13}
