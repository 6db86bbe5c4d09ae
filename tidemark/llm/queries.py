"""The operators over the test tables, one query each, with their checks in SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import alignment, decontaminate, divergence, html_text, langid, licenses, packing, pii, quality, secret_scan, sharding, simhash, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def _sha(spans: Column) -> Column:
    return F.sha2(spans, 256)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    counts = [_of_kind("_base", k).alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, _sha(secret_scan.written(F.col("_base"))).alias("base_sha256"), secret_scan.written(F.col("_spans")).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("item_shingles").alias("item_shingles"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
iz AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM iz GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles
FROM ds JOIN iz USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(item_shingles)
"""


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    counts = [_of_kind("_base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, _sha(pii.written(F.col("_base"))).alias("base_sha256"), pii.written(F.col("_spans")).alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.link_scores(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
held AS (SELECT lang, source, term, count(*) AS n FROM t JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN held USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (g.total + 5 * l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
more AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM more) WHERE rank <= 50
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


#: Greedy checks of a capacity are steps of a recursion over the running sum of group sizes; the checksum is taken by half bytes.
OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place FROM documents),
half AS (SELECT i, list_reduce([i, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step FROM (SELECT unnest(range(16))::BIGINT AS i)),
steps AS (SELECT list(step ORDER BY i) AS step FROM half),
sums AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\2\1', 'g'), ''), lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT)),
         lambda c, x: xor(c >> 4, step[(xor(c, x) & 15) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT text FROM d WHERE text <> '') CROSS JOIN steps),
grp AS (SELECT key, sum(size)::BIGINT AS size FROM d GROUP BY key),
ranked AS (SELECT key, size, row_number() OVER by_size AS i, sum(size) OVER () - sum(size) OVER by_size + size AS remaining FROM grp WINDOW by_size AS (ORDER BY size DESC, key)),
alone AS (SELECT key, i - 1 AS shard FROM ranked WHERE i <= 24 AND i < (SELECT coalesce(min(i), 100) FROM ranked WHERE size * (25 - i) < remaining)),
rest AS (SELECT key, (sum(size) OVER (ORDER BY key))::BIGINT AS upto FROM grp WHERE key NOT IN (SELECT key FROM alone)),
given AS (SELECT 24 - (SELECT count(*) FROM alone) AS n, (SELECT coalesce(max(upto), 0) FROM rest) AS total),
search AS (
  SELECT (total + n - 1) // greatest(n, 1) AS low, total AS high, 0 AS k, 0::BIGINT AS begun FROM given
  UNION ALL
  SELECT CASE WHEN NOT full_ AND failed THEN mid + 1 ELSE low END, CASE WHEN full_ THEN mid ELSE high END, CASE WHEN full_ OR failed THEN 0 ELSE k + 1 END, CASE WHEN full_ OR failed THEN 0 ELSE upto END
  FROM (SELECT s.*, mid, upto, upto >= total AS full_, upto <= s.begun OR k + 1 = n AS failed
        FROM (SELECT *, (low + high) // 2 AS mid, coalesce((SELECT max(upto) FROM rest WHERE upto <= s0.begun + (s0.low + s0.high) // 2), 0) AS upto FROM search s0 WHERE low < high) s, given)),
capacity AS (SELECT min(low) AS c FROM search WHERE low >= high),
earliest AS (
  SELECT 0 AS m, total::BIGINT AS begun FROM given
  UNION ALL
  SELECT m + 1, (SELECT min(upto) FROM (SELECT upto FROM rest UNION ALL SELECT 0) WHERE upto >= earliest.begun - (SELECT c FROM capacity)) FROM earliest WHERE m < 24),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS begun
  UNION ALL
  SELECT k + 1, least(greatest(CASE WHEN below IS NOT NULL AND (above IS NULL OR share - below <= above - share) THEN below ELSE above END, (SELECT begun FROM earliest WHERE m = n - s.k - 1)),
                      (SELECT max(upto) FROM rest WHERE upto <= s.begun + (SELECT c FROM capacity)))
  FROM (SELECT *, (SELECT max(upto) FROM rest WHERE upto <= share AND upto > x.begun) AS below, (SELECT min(upto) FROM rest WHERE upto > share) AS above
        FROM (SELECT cuts.*, n, cuts.begun + (total - cuts.begun) // (n - cuts.k) AS share FROM cuts, given WHERE cuts.begun < total AND cuts.k < n) x) s),
placed AS (SELECT key, shard FROM alone UNION ALL SELECT key, (SELECT count(*) FROM alone) + (SELECT count(*) FROM cuts WHERE cuts.k > 0 AND cuts.begun < rest.upto) FROM rest)
SELECT doc_id, size::BIGINT AS size, coalesce(crc, 0)::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, key) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN placed USING (key) LEFT JOIN sums USING (text)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_url_rules": op3_url_rules,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_licenses": op10_licenses,
    "op11_alignment": op11_alignment,
    "op12_divergence": op12_divergence,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op8_decontamination": OP8_SQL, "op12_divergence": OP12_SQL, "op13_sharding": OP13_SQL}
