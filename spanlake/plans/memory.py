"""Queries over incident memory: every document is a record, every 50th of them a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import memory
from spanlake.plans import fixtures
from spanlake.plans.base import NS, csv, query

_DAY = 86400 * 1_000_000_000
_FIELDS = {
    "record_id": "doc_id",
    "tenant": "concat('tenant-', doc_id % 3)",
    "kind": "case when doc_id % 10 = 0 then 'runbook' else 'incident' end",
    "body": "coalesce(text, '')",
    "weight": "1.0 + (doc_id % 5) / 10.0",
    "created_ns": f"{NS} - (doc_id % 500) * {_DAY}",
    "last_used_ns": f"case when doc_id % 4 = 0 then {NS} - (doc_id % 100) * {_DAY} end",
    "supersedes_id": "case when doc_id % 20 = 13 then doc_id - 3 end",
}
#: A correction is about the service, error and dependency of what it corrects.
_OF = "(case when doc_id % 20 = 13 then doc_id - 3 else doc_id end)"
_TOKENS = [f"concat('svc:svc-', {_OF} % 10)", f"concat('errsig:', {_OF} % 97)", f"concat('dep:', {_OF} % 13)", "concat('ns:', coalesce(source, ''))", f"concat('svc:svc-', {_OF} % 10)"]
_FOLD = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_distinct(regexp_extract_all({_FOLD % 'body'}, '[a-z0-9]+'))"
RECORDS_SQL = f"""records AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _FIELDS.items())}, list_slice(list_sort(list_distinct([{', '.join(_TOKENS)}])), 1, 24) AS tokens FROM documents)"""
_EFFECTIVE = f"greatest(0.0, weight * pow(0.5, greatest(0.0, ({NS} - coalesce(last_used_ns, created_ns)) / {_DAY}.0) / 90))"


def records(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "documents")
    return rows.select(*(F.expr(e).alias(k) for k, e in _FIELDS.items()), memory.tokens(F.array(*map(F.expr, _TOKENS))).alias("tokens")).withColumn("weight", F.col("weight").cast("double"))


@query("SELECT record_id, tenant, array_to_string(tokens, ',') AS tokens, md5(tenant || chr(0) || array_to_string(tokens, chr(0))) AS fingerprint FROM records", views=(RECORDS_SQL,))
def memory_fingerprint(spark, sf_dir):
    return records(spark, sf_dir).select("record_id", "tenant", csv("tokens").alias("tokens"), memory.fingerprint().alias("fingerprint"))


@query(f"SELECT record_id, round({_EFFECTIVE}, 9) AS weight FROM records", views=(RECORDS_SQL,))
def effective_weight(spark, sf_dir):
    return records(spark, sf_dir).select("record_id", F.round(memory.effective_weight(NS), 9).alias("weight"))


_SIMILAR = f"""asked AS (SELECT record_id AS query_id, tenant, tokens AS q_tokens, body AS q_body FROM records WHERE record_id % 50 = 0),
overlap AS (SELECT query_id, r.record_id, len(list_intersect(q_tokens, tokens)) AS n, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q_tokens, tokens)) DESC, r.record_id) AS place
  FROM asked a JOIN records r ON r.tenant = a.tenant WHERE len(list_intersect(q_tokens, tokens)) > 0),
worded AS (SELECT *, {_WORDS} AS words, {_EFFECTIVE} AS effective FROM records),
pairs AS (SELECT o.query_id, o.n AS t, len(a.q_tokens) + len(r.tokens) - o.n AS tu, len(list_intersect(q.words, r.words)) AS w, len(q.words) + len(r.words) AS wn, a.q_body, r.* FROM overlap o JOIN asked a ON a.query_id = o.query_id JOIN worded q ON q.record_id = o.query_id JOIN worded r ON r.record_id = o.record_id WHERE place <= 500),
scored AS (SELECT *, CASE WHEN q_body = '' THEN t / tu::double ELSE 0.7 * (t / tu::double) + 0.3 * CASE WHEN wn > w THEN w / (wn - w)::double ELSE 0 END END AS score FROM pairs),
found AS (SELECT *, score * (1 + effective) AS worth FROM scored WHERE score >= 0.35),
fixes AS (SELECT query_id, supersedes_id, max(worth) AS above FROM found WHERE supersedes_id IS NOT NULL GROUP BY query_id, supersedes_id),
kept AS (SELECT f.*, x.above, s.record_id IS NOT NULL AS corrected FROM found f LEFT JOIN fixes x ON x.query_id = f.query_id AND x.supersedes_id = f.record_id LEFT JOIN records s ON s.supersedes_id = f.record_id AND s.tenant = f.tenant),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(least(worth, above), 12) DESC, corrected, record_id) AS rank FROM kept WHERE NOT corrected OR above IS NOT NULL)"""


@query("SELECT query_id, record_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 10", views=(RECORDS_SQL, _SIMILAR))
def similar_incidents(spark, sf_dir):
    rows = records(spark, sf_dir)
    asked = rows.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id")
    return memory.similar(asked, rows, now_ns=NS).withColumn("score", F.round("score", 6))


@query("SELECT query_id, record_id, rank FROM placed WHERE rank <= 10 AND (corrected OR supersedes_id IS NOT NULL)", views=(RECORDS_SQL, _SIMILAR))
def superseded_records(spark, sf_dir):
    """Of the searches' results, corrections and what they correct."""
    rows = records(spark, sf_dir)
    found = memory.similar(rows.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id"), rows, now_ns=NS)
    touched = rows.where("supersedes_id is not null").select(F.explode(F.array("record_id", "supersedes_id")).alias("record_id")).distinct()
    return found.join(touched, "record_id", "left_semi").select("query_id", "record_id", "rank")


_ASKED = "license error of the database"


@query(
    f"""scored AS (SELECT record_id, len(list_intersect({_WORDS}, ['license', 'error', 'of', 'the', 'database'])) AS n, len({_WORDS}) AS m, contains({_FOLD % 'body'}, '{_ASKED}') AS holds FROM records)
SELECT record_id, round(n / (m + 5 - n)::double, 6) AS score FROM scored WHERE n > 0 OR holds ORDER BY n / (m + 5 - n)::double DESC, record_id LIMIT 20""",
    views=(RECORDS_SQL,),
)
def memory_search(spark, sf_dir):
    return memory.search(records(spark, sf_dir), text=_ASKED).withColumn("score", F.round("score", 6))


_EVENTS = "SELECT conv_id AS record_id, turn AS seq, CASE WHEN role = 'user' THEN 'confirmation' ELSE 'correction' END AS kind FROM conversations"


def _events(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "conversations").selectExpr("conv_id as record_id", "turn as seq", "case when role = 'user' then 'confirmation' else 'correction' end as kind")


@query(
    f"""events AS ({_EVENTS}), steps AS (SELECT record_id, list(CASE WHEN kind = 'correction' THEN -0.35 ELSE 0.15 END::double ORDER BY seq, CASE WHEN kind = 'correction' THEN -0.35 ELSE 0.15 END) AS s, count(*) FILTER (kind = 'correction') AS corrections FROM events GROUP BY record_id)
SELECT record_id, round(list_reduce(list_prepend(1.0::double, s), lambda w, x: least(2.0, greatest(0.0, w + x))), 6) AS weight, corrections FROM steps""",
    views=(RECORDS_SQL,),
)
def memory_feedback(spark, sf_dir):
    return memory.feedback(_events(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    """SELECT record_id FROM records r WHERE NOT (kind <> 'runbook' AND %d - created_ns > 400 * %d) AND NOT EXISTS (SELECT 1 FROM records o WHERE o.tenant = r.tenant AND o.kind = r.kind AND (o.created_ns, o.record_id) > (r.created_ns, r.record_id)
  AND len(list_intersect(o.tokens, r.tokens)) / (len(o.tokens) + len(r.tokens) - len(list_intersect(o.tokens, r.tokens)))::double >= 0.6)"""
    % (NS, _DAY),
    views=(RECORDS_SQL,),
)
def consolidate(spark, sf_dir):
    return memory.consolidate(records(spark, sf_dir), now_ns=NS).select("record_id")


@query("SELECT record_id FROM records WHERE record_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", views=(RECORDS_SQL,))
def memory_delete(spark, sf_dir):
    rows = records(spark, sf_dir)
    erased = fixtures.table(spark, sf_dir, "labels").where("toxic = 1").selectExpr("concat('tenant-', doc_id % 3) as tenant", "doc_id as record_id")
    return memory.delete(rows, erased).select("record_id")


@query("SELECT tenant, count(*) AS records, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM records x WHERE x.tenant = r.tenant)) AS tokens FROM records r GROUP BY tenant", views=(RECORDS_SQL,))
def memory_stats(spark, sf_dir):
    return memory.stats(records(spark, sf_dir))


@query("SELECT o_orderkey AS incident, 1.0 AS weight, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS provenance, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS trust FROM orders", views=(RECORDS_SQL,))
def memory_from_investigations(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "orders").selectExpr("o_orderkey as incident", "if(o_orderstatus = 'F', 'llm', 'rules') as author")
    return memory.from_investigations(rows).drop("author")


@query(
    """SELECT '{"record_id":' || record_id || ',"tenant":"' || tenant || '","kind":"' || kind || '","fingerprint":"' || md5(tenant || chr(0) || array_to_string(tokens, chr(0))) || '","created_at":"' || strftime(make_timestamp(created_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') || '","tokens":["' || array_to_string(tokens, '","') || '"],"weight":' || printf('%.1f', weight) || '}' AS line FROM records""",
    views=(RECORDS_SQL,),
)
def memory_export(spark, sf_dir):
    return memory.export(records(spark, sf_dir))


@query("SELECT CASE WHEN record_id % 2 = 0 THEN 'imported/' || record_id ELSE record_id::varchar END AS record_id, 'imported' AS provenance, 2 AS trust FROM records", views=(RECORDS_SQL,))
def memory_import(spark, sf_dir):
    """All records come in; those with even ids exist already."""
    rows = records(spark, sf_dir)
    return memory.imported(rows.where("record_id % 2 = 0"), rows).select("record_id", "provenance", "trust")


@query(
    f"""SELECT record_id::varchar AS record_id, tenant, kind, array_to_string(tokens, ',') AS tokens, weight, created_ns, NULL AS error FROM records WHERE record_id % 7 <> 0 AND record_id % 11 <> 0
  UNION ALL SELECT record_id::varchar, tenant, kind, array_to_string(tokens, ','), weight, created_ns, 'schema' FROM records WHERE record_id % 7 = 0
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'malformed' FROM records WHERE record_id % 7 <> 0 AND record_id % 11 = 0""",
    views=(RECORDS_SQL,),
)
def memory_import_lines(spark, sf_dir):
    """Exported lines, read again; some name an unknown schema, some are no JSON."""
    number = F.get_json_object("line", "$.record_id").cast("bigint")
    line = F.when(number % 7 == 0, F.regexp_replace("line", r"\A\{", '{"schema":"0",')).when(number % 11 == 0, F.lit("[broken")).otherwise(F.col("line"))
    return memory.parsed(memory.export(records(spark, sf_dir)).select(line.alias("line"))).drop("body").withColumn("tokens", csv("tokens"))


@query(
    """SELECT doc_id, 'Runbook ' || doc_id AS title, array_to_string(list_sort(list_distinct(['svc:svc-' || doc_id % 10, 'errsig:t' || doc_id % 7, 'errsig:slow'])), ',') AS tokens, length(coalesce(text, '')) AS n FROM documents WHERE doc_id % 4 <> 0""",
    views=(RECORDS_SQL,),
)
def runbook_import(spark, sf_dir):
    """A Markdown file of each document; every fourth names no service."""
    service = "if(doc_id % 4 = 0, '', concat('service: svc-', doc_id % 10, '\\n'))"
    files = fixtures.table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat('---\\ntitle: Runbook ', doc_id, '\\n', {service}, 'symptom_tags: [t', doc_id % 7, ', slow]\\n---\\n', coalesce(text, '')) as markdown")
    return memory.runbooks(files, keep=("doc_id",)).select("doc_id", "title", csv("tokens").alias("tokens"), F.char_length("body").cast("bigint").alias("n"))
