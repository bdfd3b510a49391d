"""The queries of this package: thin views of its operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import audit, exact, licenses, lines, packing, phrases, quality, sharding, simhash, tokens, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trips(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"), grow=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"), F.char_length(text).alias("n_left"), F.sha2(text, 256).alias("text_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.judged(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    counts = [f"_q.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_packing, op2_bpe, op3_toxicity, op4_line_dedup, op5_licenses, op6_quality_rules, op7_simhash, op8_url_filters, op9_exact_dedup, op10_warc, op11_filter_audit, op12_collocations, op13_sharding)}

SQL = {
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op10_warc": r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT page_id, h, n, max(page_id) OVER (PARTITION BY h) AS top FROM t)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM g""",
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
lab AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ks, array_to_string(list_transform(ks, lambda k: substr('ABCDE', k + 1, 1)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
b AS (SELECT *, 1 << ks[step] AS bit, list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k))::bigint AS before FROM s),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0), 0)::bigint AS kept, coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0), 0)::bigint AS removed,
  coalesce(sum(n) FILTER (mask & coalesce(before, 0) <> 0 AND mask & bit <> 0), 0)::bigint AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::bigint AS unique_fails,
  coalesce(sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0), 0)::bigint AS good_lost, coalesce(sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit <> 0), 0)::bigint AS toxic_lost FROM c, b GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM r""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
c AS (SELECT lang, ws[i:i + k - 1] AS ph, k, count(*) AS a FROM g GROUP BY lang, ph, k),
t AS (SELECT lang, sum(a)::bigint AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE k >= 2 AND a >= 30),
cuts AS (SELECT lang, ph, k, a, unnest(range(1, k)) AS cut FROM cand),
scored AS (SELECT u.lang, u.ph, u.k, u.a, cut, x.a AS l, y.a AS r, 2000000::hugeint * u.a // (x.a + y.a) AS score FROM cuts u JOIN c x ON x.lang = u.lang AND x.ph = u.ph[1:cut] JOIN c y ON y.lang = u.lang AND y.ph = u.ph[cut + 1:u.k]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
part AS (SELECT lang, ph, k, a, unnest(range(2, k)) AS m FROM cand),
sub AS (SELECT lang, ph, k, a, m, unnest(range(1, k - m + 2)) AS i FROM part),
gone AS (SELECT DISTINCT s.lang, s.ph[i:i + m - 1] AS ph FROM sub s JOIN cand b ON b.lang = s.lang AND b.ph = s.ph[i:i + m - 1] WHERE 100 * s.a >= 80 * b.a),
kept AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score FROM best b WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = b.lang AND gone.ph = b.ph)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::bigint AS score FROM ranked JOIN t ON t.lang = ranked.lang WHERE rank <= 2000""",
}
