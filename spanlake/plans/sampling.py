"""Queries over sampling decisions. The baseline's p99 is taken from a table of operations; predicates are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import sampling, spans, traces
from spanlake.operators.lineage import cut
from spanlake.plans import fixtures
from spanlake.plans.base import S, TRACES_SQL, base_spans, query
from spanlake.plans.spans import PATHS_SQL

_BASE_SQL = """opbase AS (SELECT tenant, service AS root_service, name AS root_name, quantile_disc(duration_ns, 0.5) AS base_p99_ns, count(*) >= 200 AS warmed FROM spans GROUP BY tenant, service, name)"""
_SIGNED = """straces AS (SELECT t.*, s.path_signature, lag(start_ns) OVER (PARTITION BY t.tenant, s.path_signature ORDER BY start_ns, t.trace_id) AS seen_ns FROM traces t JOIN signed s ON s.tenant = t.tenant AND s.trace_id = t.trace_id),
rares AS (SELECT *, seen_ns IS NULL OR start_ns - seen_ns > 600000000000 AS rare FROM straces)"""
_PREDICATE = "CASE WHEN duration_ns >= 900000000 AND list_contains(string_split(services, ','), 'svc-' || substr(tenant, 8)) THEN 'slow-' || tenant WHEN error_count > 0 AND duration_ns >= 500000000 THEN 'errors' END"
_DECIDE = f"""asked AS (SELECT r.*, base_p99_ns, warmed, {_PREDICATE} AS predicate, error_count > 0 AS e, coalesce(warmed AND duration_ns > base_p99_ns AND duration_ns > 1000000000, false) AS s FROM rares r LEFT JOIN opbase USING (tenant, root_service, root_name)),
tokens AS (SELECT *, start_ns // 60000000000 AS minute, NOT e AND NOT s AND rare AS wants FROM asked),
rared AS (SELECT *, wants AND row_number() OVER (PARTITION BY tenant, minute, wants ORDER BY start_ns, trace_id) <= 20 AS r FROM tokens),
lefts AS (SELECT *, NOT e AND NOT s AND NOT r AND predicate IS NULL AS wants2 FROM rared),
floors AS (SELECT *, wants2 AND row_number() OVER (PARTITION BY tenant, root_service, minute, wants2 ORDER BY start_ns, trace_id) <= 2 AS f FROM lefts),
decided AS (SELECT *, CASE WHEN e THEN 1 WHEN s THEN 2 WHEN r THEN 3 WHEN predicate IS NOT NULL THEN 4 WHEN f THEN 5 WHEN cast('0x' || substr(md5(trace_id), 1, 8) AS bigint) % 10000 < 100 THEN 6 ELSE 7 END AS reason FROM floors),
decisions AS (SELECT tenant, trace_id, start_ns, reason, reason <> 7 AS keep, predicate, CASE WHEN s AND reason <> 2 THEN 4 ELSE 0 END + CASE WHEN rare AND reason <> 3 THEN 8 ELSE 0 END + CASE WHEN predicate IS NOT NULL AND reason <> 4 THEN 16 ELSE 0 END AS also FROM decided)"""
VIEWS = (fixtures.SPANS_SQL, TRACES_SQL, PATHS_SQL, _BASE_SQL, _SIGNED, _DECIDE)


def signed_traces(spark, sf_dir):
    own = base_spans(spark, sf_dir, whole_traces=True)
    return cut(traces.rollup(own).join(traces.path_signature(own, whole_traces=True), ["tenant", "trace_id"]))  # read twice for rare ones


def predicates(spark, sf_dir):
    """Of each tenant: slow traces of one service, then traces with errors of half a second."""
    tenants = fixtures.raw_spans(spark, sf_dir).select("tenant").distinct()
    empty = F.array().cast("array<string>")
    one = tenants.select("tenant", F.lit(1).alias("seq"), F.concat(F.lit("slow-"), "tenant").alias("predicate"), F.lit(900_000_000).alias("min_duration_ns"), F.lit(False).alias("errors_only"), empty.alias("trace_ids"), empty.alias("signatures"), F.array(F.concat(F.lit("svc-"), F.expr("substr(tenant, 8)"))).alias("services"), F.lit(3).alias("hits"), F.lit(0).alias("expires_ns"))
    two = tenants.select("tenant", F.lit(2).alias("seq"), F.lit("errors").alias("predicate"), F.lit(500_000_000).alias("min_duration_ns"), F.lit(True).alias("errors_only"), empty.alias("trace_ids"), empty.alias("signatures"), empty.alias("services"), F.lit(1).alias("hits"), F.lit(5).alias("expires_ns"))
    return one.unionByName(two)


def asked(spark, sf_dir):
    rows = sampling.rare_candidates(signed_traces(spark, sf_dir), quiet_ns=600 * S)
    base = base_spans(spark, sf_dir).groupBy("tenant", F.col("service").alias("root_service"), F.col("name").alias("root_name")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ns)").cast("bigint").alias("base_p99_ns"), (F.count("*") >= 200).alias("warmed"))
    return sampling.interest(rows, predicates(spark, sf_dir)).join(base, ["tenant", "root_service", "root_name"], "left").withColumn("truncated", F.lit(False))


def decisions(spark, sf_dir):
    return sampling.decide(asked(spark, sf_dir), floor_rate=2, rare_rate=20, slow_ns=1_000_000_000)


@query("SELECT tenant, trace_id, reason, keep, predicate, also FROM decisions", views=VIEWS)
def decide(spark, sf_dir):
    return decisions(spark, sf_dir).select("tenant", "trace_id", "reason", "keep", "predicate", "also")


def _class(name, reason):
    from spanlake.plans.base import QUERIES, SQL

    QUERIES[name] = lambda spark, sf_dir: decisions(spark, sf_dir).where(F.col("reason") == reason).select("tenant", "trace_id")
    SQL[name] = "WITH " + ",\n".join(VIEWS) + f"\nSELECT tenant, trace_id FROM decisions WHERE reason = {reason}"


for _name, _reason in (("keep_error", 1), ("keep_slow", 2), ("keep_rare", 3), ("keep_interest", 4), ("keep_floor", 5), ("keep_probabilistic", 6)):
    _class(_name, _reason)


@query("SELECT tenant, trace_id, predicate FROM asked", views=VIEWS)
def interest_match(spark, sf_dir):
    return asked(spark, sf_dir).select("tenant", "trace_id", "predicate")


@query("SELECT DISTINCT tenant, 'slow-' || tenant AS predicate FROM spans")
def predicates_active(spark, sf_dir):
    """The second predicate of each tenant has expired at time 6."""
    return sampling.active_predicates(predicates(spark, sf_dir), now_ns=6).select("tenant", "predicate")


@query("SELECT tenant, trace_id, row_number() OVER (PARTITION BY tenant, root_service, start_ns // 60000000000 ORDER BY start_ns, trace_id) <= 6 AS taken FROM traces", views=(fixtures.SPANS_SQL, TRACES_SQL))
def token_bucket(spark, sf_dir):
    return sampling.per_minute(traces.rollup(base_spans(spark, sf_dir)), by=["tenant", "root_service"], rate=6, when=F.lit(True), name="taken").select("tenant", "trace_id", "taken")


@query(
    """ordered AS (SELECT tenant, root_service, trace_id, start_ns, row_number() OVER (PARTITION BY tenant, root_service ORDER BY start_ns, trace_id) AS k FROM traces),
walk AS (SELECT *, 6.0::double AS full_, true AS taken, 5.0::double AS left_ FROM ordered WHERE k = 1 UNION ALL
  SELECT o.*, least(6.0::double, w.left_ + (o.start_ns - w.start_ns) / 1000000000.0::double * 6 / 60) AS full_, least(6.0::double, w.left_ + (o.start_ns - w.start_ns) / 1000000000.0::double * 6 / 60) >= 1,
    least(6.0::double, w.left_ + (o.start_ns - w.start_ns) / 1000000000.0::double * 6 / 60) - CASE WHEN least(6.0::double, w.left_ + (o.start_ns - w.start_ns) / 1000000000.0::double * 6 / 60) >= 1 THEN 1 ELSE 0 END
  FROM walk w JOIN ordered o ON o.tenant = w.tenant AND o.root_service = w.root_service AND o.k = w.k + 1)
SELECT tenant, root_service, trace_id, start_ns, taken FROM walk""",
    views=("RECURSIVE " + fixtures.SPANS_SQL, TRACES_SQL),
)
def token_bucket_exact(spark, sf_dir):
    rows = traces.rollup(base_spans(spark, sf_dir)).select("tenant", "root_service", "trace_id", "start_ns")
    return sampling.token_bucket(rows, by=["tenant", "root_service"], rate=6)


_SHED = """ranked AS (SELECT *, start_ns // 60000000000 AS minute, CASE WHEN NOT keep THEN -1 ELSE CASE reason WHEN 1 THEN 9 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END END AS k FROM decisions),
placed AS (SELECT *, row_number() OVER (PARTITION BY tenant, minute ORDER BY k DESC, trace_id) AS p, count(*) OVER (PARTITION BY tenant, minute) AS n FROM ranked)"""


@query("SELECT tenant, trace_id, CASE WHEN keep AND k < 9 AND p > floor(n * 0.25) THEN 8 ELSE reason END AS reason, keep AND NOT (k < 9 AND p > floor(n * 0.25)) AS keep FROM placed", views=(*VIEWS, _SHED))
def shed(spark, sf_dir):
    return sampling.shed(decisions(spark, sf_dir)).select("tenant", "trace_id", "reason", "keep")


#: The decisions of the last minute as a list; r is the place in the order of shedding, -1 for what is never shed.
_GOVERNED = """placed AS (SELECT tenant, trace_id, start_ns, keep, reason, CASE reason WHEN 6 THEN 0 WHEN 5 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 ELSE -1 END AS r,
  row_number() OVER (PARTITION BY tenant ORDER BY start_ns, trace_id) AS k FROM decisions),
governed AS (SELECT tenant, trace_id, k, keep, reason, [{'t': start_ns, 'keep': keep, 'r': r}] AS past FROM placed WHERE k = 1
  UNION ALL SELECT tenant, trace_id, k, keep AND NOT gone, CASE WHEN gone THEN 8 ELSE reason END, list_append(seen, {'t': start_ns, 'keep': keep AND NOT gone, 'r': r}) FROM (
    SELECT *, keep AND r >= 0 AND len(seen) > 0 AND len(list_filter(seen, lambda x: x.keep)) > 0.25 * len(seen) AND len(list_filter(seen, lambda x: x.keep AND x.r >= 0 AND x.r < r)) = 0 AS gone FROM (
      SELECT p.*, list_filter(g.past, lambda x: x.t >= p.start_ns - 60000000000) AS seen FROM governed g JOIN placed p ON p.tenant = g.tenant AND p.k = g.k + 1)))"""


@query("SELECT tenant, trace_id, keep, reason FROM governed", views=("RECURSIVE " + VIEWS[0], *VIEWS[1:], _GOVERNED))
def govern(spark, sf_dir):
    return sampling.govern(decisions(spark, sf_dir)).select("tenant", "trace_id", "keep", "reason")


@query(
    f"""ticks AS (SELECT tenant, reason, start_ns - start_ns % {10 * S} + {10 * S} * i AS tick_ns FROM decisions, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)),
rolled AS (SELECT tenant, tick_ns, reason, count(*) AS n FROM ticks GROUP BY tenant, tick_ns, reason)
SELECT tenant, tick_ns, reason, n, round(n / sum(n) OVER (PARTITION BY tenant, tick_ns), 9) AS share FROM rolled""",
    views=VIEWS,
)
def keep_rate_rolling(spark, sf_dir):
    return sampling.rolling_rates(decisions(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("SELECT s.tenant, s.trace_id, s.span_id, d.reason, CASE WHEN d.reason <= 4 THEN 1 ELSE 2 END AS tier FROM spans s JOIN decisions d ON d.tenant = s.tenant AND d.trace_id = s.trace_id WHERE d.keep", views=VIEWS)
def apply_decisions(spark, sf_dir):
    return sampling.apply(base_spans(spark, sf_dir), decisions(spark, sf_dir)).select("tenant", "trace_id", "span_id", "reason", "tier")


@query("SELECT CASE WHEN reason <= 4 THEN 1 ELSE 2 END AS tier, count(*) AS traces FROM decisions WHERE keep GROUP BY 1", views=VIEWS)
def tier_route(spark, sf_dir):
    return decisions(spark, sf_dir).where("keep").groupBy(sampling.tier().alias("tier")).agg(F.count("*").alias("traces"))


@query("SELECT tenant, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tenant), 9) AS share FROM decisions GROUP BY tenant, reason", views=VIEWS)
def keep_rate_by_reason(spark, sf_dir):
    return sampling.keep_rates(decisions(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(
    """SELECT tenant, used, round(used / 12000000.0::double, 12) AS ratio, CASE WHEN used / 12000000.0 > 1.15 THEN 0.005 WHEN used / 12000000.0 < 0.85 THEN 0.015 ELSE 0.01 END AS floor,
  CASE WHEN used / 12000000.0 >= 0.95 THEN 'critical' WHEN used / 12000000.0 >= 0.85 THEN 'high' WHEN used / 12000000.0 >= 0.8 THEN 'warn' ELSE 'ok' END AS watermark FROM (SELECT tenant, count(*) * 750 AS used FROM spans GROUP BY tenant)"""
)
def cost_signal(spark, sf_dir):
    out = sampling.cost_signal(spans.ingested_bytes(base_spans(spark, sf_dir)), budget=12_000_000)
    return out.withColumns({"ratio": F.round("ratio", 12), "floor": F.round("floor", 6)})
