"""Queries over questions: all turns of conversations, each with a question put before its text, since that text asks none."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import questions
from spanlake.plans import fixtures
from spanlake.plans.base import NS, S, csv, query

_ASKED = (
    "How is chekout-svc doing today?", "Find traces for payment-svc in the last 15 minutes", "Explain trace 0123456789ABCDEF0123456789abcdef", "Why is cart svc slow since 2023-12-31T20:00:00Z?",
    "What calls payment-svc and compare it with yesterday", "Any incidents between 2023-12-30T10:00:00Z and 2023-12-29T10:00:00+02:00?", 'Have we seen this error before: "connection reset by peer"', "restart checkout-svc", "What changed since the svc-33 deploy?", "status of investigation inv-7, error: pool timeout",
)
_TEXT = "concat(case (conv_id + turn) % 10 " + " ".join(f"when {k} then '{q}'" for k, q in enumerate(_ASKED)) + " end, ' ', coalesce(text, ''))"
_QUESTIONS = ["conv_id * 1000 + turn AS question_id", f"{_TEXT} AS text", "conv_id AS thread", "turn", f"{NS} + (conv_id * 100 + turn * (conv_id % 7) * 10) * {60 * S} AS at_ns"]
QUESTIONS_SQL = f"questions AS (SELECT {', '.join(_QUESTIONS)} FROM conversations)"
_CATALOG = ("checkout-svc", "payment-svc", "cart-svc")


def asked(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "conversations").selectExpr(*_QUESTIONS)


_TOPS = []
for _number, _name in enumerate(questions.INTENTS[1:], 1):
    _cases = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {min(0.95, max(0.5, 0.5 + 0.05 * k))}::double ELSE 0 END" for i, p, k in questions.PATTERNS if i == _name)
    _TOPS.append(f"SELECT question_id, {_number} AS k, '{_name}' AS name, greatest({_cases}, 0.0) AS c FROM questions")
_INTENTS_SQL = f"""tops AS ({' UNION ALL '.join(_TOPS)}), hit AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY c DESC, k) AS r FROM tops WHERE c > 0),
classified AS (SELECT q.question_id, CASE WHEN a.name IS NULL OR round(a.c - b.c, 9) < 0.15 THEN 'unknown' ELSE a.name END AS intent, CASE WHEN a.name IS NULL OR round(a.c - b.c, 9) < 0.15 THEN 0.0 ELSE a.c END AS confidence,
  CASE WHEN round(a.c - b.c, 9) < 0.15 THEN a.name || ',' || b.name ELSE '' END AS candidates FROM questions q LEFT JOIN hit a ON a.question_id = q.question_id AND a.r = 1 LEFT JOIN hit b ON b.question_id = q.question_id AND b.r = 2)"""


def classified(spark, sf_dir):
    return asked(spark, sf_dir).withColumn("q", questions.intents(F.col("text"))).select("*", "q.*").drop("q")


@query("SELECT question_id, intent, round(confidence, 6) AS confidence, candidates FROM classified", views=(QUESTIONS_SQL, _INTENTS_SQL))
def classify_questions(spark, sf_dir):
    return classified(spark, sf_dir).select("question_id", "intent", F.round("confidence", 6).alias("confidence"), csv("candidates").alias("candidates"))


_NAMES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(_CATALOG))
_SERVICE_SQL = f"""catalog(seq, service) AS (VALUES {_NAMES}), split AS (SELECT question_id, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS w FROM questions),
words AS (SELECT question_id, unnest(w) AS word FROM split UNION SELECT question_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] || '-' || x[2])) FROM split),
near AS (SELECT question_id, levenshtein(word, service) AS distance, seq, service FROM words, catalog WHERE levenshtein(word, service) <= 2),
named AS (SELECT question_id, arg_min(service, (distance, seq)) AS service, min(distance) AS distance FROM near GROUP BY question_id)"""


@query("SELECT q.question_id, service, distance FROM questions q LEFT JOIN named n ON n.question_id = q.question_id", views=(QUESTIONS_SQL, _SERVICE_SQL))
def match_service(spark, sf_dir):
    return questions.services(asked(spark, sf_dir), questions.catalog(spark, _CATALOG)).select("question_id", "service", "distance")


_DAY = 86400 * S


_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})"
_at = lambda group: f"CASE WHEN regexp_full_match({group}, '{_ISO}') THEN epoch_us(try_cast({group} AS timestamptz)) * 1000 END"
_RANGE_SQL = rf"""said AS (SELECT question_id, text, try_cast(regexp_extract(text, '(?i)\blast\s+(\d+)\s*(second|minute|hour|day|week)s?\b', 1) AS bigint) AS n, lower(regexp_extract(text, '(?i)\blast\s+(\d+)\s*(second|minute|hour|day|week)s?\b', 2)) AS unit,
  regexp_extract(text, '(?i)\bbetween\s+(\S+)\s+and\s+(\S+)\b', 1) AS a, regexp_extract(text, '(?i)\bbetween\s+(\S+)\s+and\s+(\S+)\b', 2) AS b, regexp_extract(text, '(?i)\bsince\s+(\S+)\b', 1) AS c, regexp_extract(text, '{_ISO}') AS d,
  lower(regexp_extract(text, '(?i)\bsince\s+the\s+([a-zA-Z0-9_-]+)\s+deploy\b', 1)) AS word FROM questions),
catalog AS (SELECT unnest(range(0, 10)) AS seq), near AS (SELECT word, arg_min(seq, (levenshtein(word, 'svc-' || seq), seq)) AS seq FROM (SELECT DISTINCT word FROM said WHERE word <> ''), catalog WHERE levenshtein(word, 'svc-' || seq) <= 2 GROUP BY word),
latest AS (SELECT service, max(at_ns) AS at_ns FROM deploys WHERE at_ns <= {NS + 900 * S} GROUP BY service),
told AS (SELECT s.*, n * CASE unit WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 END * {S} AS ago, {_at('a')} AS a_ns, {_at('b')} AS b_ns, {_at('c')} AS c_ns, {_at('d')} AS d_ns, l.at_ns AS deploy_ns
  FROM said s LEFT JOIN near ON near.word = s.word LEFT JOIN latest l ON l.service = 'svc-' || near.seq),
ruled AS (SELECT *, CASE WHEN ago IS NOT NULL THEN 'last' WHEN a_ns IS NOT NULL AND b_ns IS NOT NULL THEN 'between' WHEN c_ns IS NOT NULL THEN 'since' WHEN regexp_matches(text, '(?i)\byesterday\b') THEN 'yesterday' WHEN regexp_matches(text, '(?i)\btoday\b') THEN 'today'
  WHEN d_ns IS NOT NULL THEN 'time' WHEN deploy_ns IS NOT NULL THEN 'deploy' ELSE 'default' END AS rule, {NS + 900 * S} AS now_ns FROM told)"""


@query(
    f"""SELECT question_id, CASE rule WHEN 'last' THEN now_ns - ago WHEN 'between' THEN least(a_ns, b_ns) WHEN 'since' THEN c_ns WHEN 'yesterday' THEN {NS} - {_DAY} WHEN 'today' THEN {NS} WHEN 'time' THEN d_ns WHEN 'deploy' THEN deploy_ns ELSE now_ns - {1800 * S} END AS start_ns,
  CASE rule WHEN 'between' THEN greatest(a_ns, b_ns) WHEN 'yesterday' THEN {NS} ELSE now_ns END AS end_ns, rule FROM ruled""",
    views=(QUESTIONS_SQL, fixtures.DEPLOYS_SQL, _RANGE_SQL),
)
def extract_time_range(spark, sf_dir):
    """A quarter past midnight is now."""
    now = NS + 900 * S
    rows = questions.since_deploys(asked(spark, sf_dir), questions.catalog(spark, [f"svc-{k}" for k in range(10)]), fixtures.deploys(spark, sf_dir), now_ns=now)
    found = rows.select("question_id", questions.time_range(F.col("text"), now, deploy_ns=F.col("deploy_ns")).alias("t"))
    return found.select("question_id", F.col("t.start_ns").cast("bigint").alias("start_ns"), "t.end_ns", "t.rule")


@query(
    """SELECT question_id, nullif(lower(regexp_extract(text, '\\b([0-9a-fA-F]{32})\\b', 1)), '') AS trace_id, coalesce(nullif(regexp_extract(text, '"([^"]{1,128})"', 1), ''), nullif(trim(regexp_extract(text, '(?i)\\berror:\\s*(.{1,128})', 1), ' '), '')) AS error_text FROM questions""",
    views=(QUESTIONS_SQL,),
)
def extract_ids(spark, sf_dir):
    return asked(spark, sf_dir).select("question_id", questions.ids(F.col("text")).alias("i")).select("question_id", "i.*")


_CONTEXT_SQL = """turns AS (SELECT q.question_id, thread, turn, at_ns, intent, service FROM questions q JOIN classified c ON c.question_id = q.question_id LEFT JOIN named n ON n.question_id = q.question_id),
lagged AS (SELECT *, coalesce(at_ns - lag(at_ns) OVER w > 1800000000000, true) AS fresh, coalesce(intent = lag(intent) OVER w, false) AS same FROM turns WINDOW w AS (PARTITION BY thread ORDER BY at_ns, turn)),
islands AS (SELECT *, sum(CASE WHEN fresh OR NOT same THEN 1 ELSE 0 END) OVER w AS island, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER w AS session FROM lagged WINDOW w AS (PARTITION BY thread ORDER BY at_ns, turn))"""


@query(
    "SELECT question_id, last_value(service IGNORE NULLS) OVER (PARTITION BY thread, island ORDER BY at_ns, turn) AS service, array_to_string(list(intent) OVER (PARTITION BY thread, session ORDER BY at_ns, turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS recent FROM islands",
    views=(QUESTIONS_SQL, _INTENTS_SQL, _SERVICE_SQL, _CONTEXT_SQL),
)
def conversation_context(spark, sf_dir):
    rows = questions.services(classified(spark, sf_dir), questions.catalog(spark, _CATALOG))
    return questions.conversation(rows).select("question_id", "service", csv("recent").alias("recent"))
