"""How queries register themselves: a function over the views, and SQL over the same views for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import red, spans, traces
from spanlake.plans import fixtures

QUERIES: dict = {}
SQL: dict = {}
NS = fixtures.BASE_NS
S = 1_000_000_000


def query(sql: str | None = None, *, views=(fixtures.SPANS_SQL,)):
    """Register a function under its name; ``sql`` may start with further common table expressions, each ended by a comma."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            SQL[f.__name__] = "WITH " + ",\n".join(views) + ("\n" if body.startswith("SELECT") else ",\n") + body
        return f

    return register


def base_spans(spark: SparkSession, sf_dir: str, whole_traces: bool = False) -> DataFrame:
    """Deduplicated spans with their derived columns, which come first: attributes that no one asks for needn't be shuffled."""
    raw = spans.features(fixtures.raw_spans(spark, sf_dir))
    return spans.dedupe(raw, order=("received_ns", "tie1", "tie2"), whole_traces=whole_traces).drop("tie1", "tie2")


def base_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.rollup(base_spans(spark, sf_dir, whole_traces=True))


def base_red(spark: SparkSession, sf_dir: str) -> DataFrame:
    return red.rollup(base_spans(spark, sf_dir))


def csv(column: str):
    """An array as text, which compares alike in every engine."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


#: SQL of the histogram of duration_ns as text, and of the bucket number.
BUCKET_SQL = "least(length(bin(greatest(duration_ns // 1000000, 1))) - 1, 15)"
HIST_SQL = "concat_ws(',', " + ", ".join(f"count(*) FILTER (b = {i})" for i in range(16)) + ")"
TRACES_SQL = """traces AS (SELECT tenant, trace_id, string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(*) FILTER (is_error) AS error_count,
  arg_min(service, (CASE WHEN is_root THEN 0 ELSE 1 END, received_ns, span_id)) AS root_service, arg_min(name, (CASE WHEN is_root THEN 0 ELSE 1 END, received_ns, span_id)) AS root_name,
  max(duration_ns) AS duration_ns, min(received_ns) AS start_ns, max(received_ns) AS end_ns, count(*) AS span_count FROM spans GROUP BY tenant, trace_id)"""
RED_SQL = f"""bucketed AS (SELECT *, received_ns - received_ns % 10000000000 AS bucket_ns, {BUCKET_SQL} AS b FROM spans),
red AS (SELECT tenant, service, name, bucket_ns, count(*) AS calls, count(*) FILTER (is_error) AS errors, sum(duration_ns)::bigint AS duration_sum_ns, {", ".join(f"count(*) FILTER (b = {i}) AS h{i}" for i in range(16))} FROM bucketed GROUP BY ALL)"""


def quantile_sql(p: float, h=lambda i: f"h{i}") -> str:
    """SQL of a histogram's quantile in ns."""
    total = "(" + " + ".join(h(i) for i in range(16)) + ")"
    cases = " ".join(f"WHEN {' + '.join(h(k) for k in range(i + 1))} >= floor({total} * {p}) THEN {(2**i if i < 15 else 32000) * 1_000_000}" for i in range(16))
    return f"CASE WHEN {total} = 0 THEN 0 {cases} END"
