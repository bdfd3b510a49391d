"""Queries over payloads, limits, logs, exemplars and audit events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import correlate
from spanlake.plans import fixtures
from spanlake.plans.base import NS, S, TRACES_SQL, base_spans, base_traces, csv, query
from spanlake.sources import payloads

_AUDIT = ["concat('tenant-', o_orderkey % 3) AS tenant", "concat('user-', o_custkey) AS actor", "o_orderstatus AS action", f"{NS} + o_orderkey * 200000000 AS at_ns", "o_orderkey AS seq"]
_AUDIT_SQL = f"audit AS (SELECT {', '.join(_AUDIT)} FROM orders)"
_KEYS_SQL = "list_filter([CASE WHEN db IS NOT NULL THEN 'db.system' END, CASE WHEN http IS NOT NULL THEN 'http.request.method' END, CASE WHEN peer IS NOT NULL THEN 'peer.service' END, 'retry.count'], lambda x: x IS NOT NULL)"


@query(
    """SELECT tenant, trace_id, span_id, parent_span_id, service, name, CASE kind WHEN 1 THEN 0 ELSE kind END AS kind, start_ns,
  start_ns + (end_ns - start_ns) // 1000 * 1000 AS end_ns, retries FROM raw"""
)
def normalize_zipkin(spark, sf_dir):
    rows = fixtures.raw_spans(spark, sf_dir)
    body = F.to_json(F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("parent_span_id").alias("parentId"), "name",
        F.expr("case kind when 3 then 'CLIENT' when 2 then 'SERVER' end").alias("kind"), F.expr("start_ns div 1000").alias("timestamp"),
        F.expr("(end_ns - start_ns) div 1000").alias("duration"), F.struct(F.col("service").alias("serviceName")).alias("localEndpoint"), F.col("attrs").alias("tags"),
    ))
    out = payloads.normalize_zipkin(rows.select("tenant", body.alias("payload")))
    return out.select("tenant", "trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ns", "end_ns", F.col("attrs")["retry.count"].alias("retries"))


@query(f"SELECT tenant, trace_id, span_id, received_ns, array_to_string(list_slice({_KEYS_SQL}, 1, 2), ',') AS keys, greatest(len({_KEYS_SQL}) - 2, 0) AS dropped_attrs FROM raw")
def apply_span_limits(spark, sf_dir):
    out = payloads.apply_limits(fixtures.raw_spans(spark, sf_dir), attrs=2)
    return out.select("tenant", "trace_id", "span_id", "received_ns", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("keys"), F.col("dropped_attrs").cast("bigint").alias("dropped_attrs"))


@query(f"SELECT log_id, ts_ns, level, body FROM logs WHERE tenant = 'tenant-0' AND service = 'svc-3' AND ts_ns BETWEEN {NS} AND {NS + 1800 * S} AND contains(body, 'click') ORDER BY ts_ns, log_id LIMIT 500", views=(fixtures.LOGS_SQL,))
def log_search(spark, sf_dir):
    return correlate.log_search(fixtures.logs(spark, sf_dir), tenant="tenant-0", service="svc-3", start_ns=NS, end_ns=NS + 1800 * S, text="click").select("log_id", "ts_ns", "level", "body")


@query(
    f"""near AS (SELECT l.tenant, l.trace_id, log_id, ts_ns, row_number() OVER w AS rank, count(*) OVER (PARTITION BY l.tenant, l.trace_id) AS n
  FROM logs l JOIN traces t ON l.tenant = t.tenant AND l.trace_id = t.trace_id AND ts_ns BETWEEN start_ns - {600 * S} AND end_ns + {600 * S} WINDOW w AS (PARTITION BY l.tenant, l.trace_id ORDER BY ts_ns, log_id))
SELECT tenant, trace_id, log_id, ts_ns, rank, n > 5 AS truncated FROM near WHERE rank <= 5""",
    views=(fixtures.SPANS_SQL, TRACES_SQL, fixtures.LOGS_SQL),
)
def logs_for_trace(spark, sf_dir):
    out = correlate.logs_for_traces(fixtures.logs(spark, sf_dir), base_traces(spark, sf_dir), pad_ns=600 * S, limit=5)
    return out.select("tenant", "trace_id", "log_id", "ts_ns", F.col("rank").cast("bigint").alias("rank"), "truncated")


@query(f"SELECT tenant, service, name, ts_ns - ts_ns % {60 * S} AS step_ns, round(avg(value), 4) AS value, count(*) AS n FROM exemplars WHERE ts_ns BETWEEN {NS} AND {NS + 1800 * S} GROUP BY tenant, service, name, ts_ns - ts_ns % {60 * S}", views=(fixtures.EXEMPLARS_SQL,))
def metric_range(spark, sf_dir):
    return correlate.metric_range(fixtures.exemplars(spark, sf_dir), start_ns=NS, end_ns=NS + 1800 * S, service="").withColumn("value", F.round("value", 4))


@query(f"SELECT tenant, service, name, count(*) AS n, min(value) AS low, max(value) AS high, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM exemplars WHERE ts_ns BETWEEN {NS} AND {NS + 1800 * S} GROUP BY tenant, service, name", views=(fixtures.EXEMPLARS_SQL,))
def metric_series(spark, sf_dir):
    return correlate.metric_series(fixtures.exemplars(spark, sf_dir), start_ns=NS, end_ns=NS + 1800 * S)


@query(
    f"""found AS (SELECT s.tenant, s.trace_id, s.span_id, e.ts_ns, e.value FROM spans s JOIN exemplars e ON e.tenant = s.tenant AND e.service = s.service AND e.name = s.name AND e.ts_ns BETWEEN s.start_ns - {S} AND s.end_ns + {S})
SELECT tenant, trace_id, span_id, 'exemplars' AS source, count(*) AS n, string_agg(ts_ns::varchar, ',' ORDER BY ts_ns, value) AS times, string_agg(round(value * 100)::bigint::varchar, ',' ORDER BY ts_ns, value) AS cents FROM found GROUP BY tenant, trace_id, span_id""",
    views=(fixtures.SPANS_SQL, fixtures.EXEMPLARS_SQL),
)
def metrics_for_span(spark, sf_dir):
    """The points around every span, a second before and after it."""
    rows = correlate.metrics_for_spans(fixtures.exemplars(spark, sf_dir), base_spans(spark, sf_dir), pad_ns=S)
    cents = F.transform("points", lambda p: F.round(p["value"] * 100).cast("bigint"))
    return rows.select("tenant", "trace_id", "span_id", "source", F.size("points").cast("bigint").alias("n"), csv("points.ts_ns").alias("times"), F.array_join(cents.cast("array<string>"), ",").alias("cents"))


@query(f"SELECT tenant, actor, action, at_ns, seq FROM audit WHERE tenant = 'tenant-1' AND action = 'F' AND at_ns BETWEEN {NS} AND {NS + 1800 * S}", views=(_AUDIT_SQL,))
def audit_query(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "orders").selectExpr(*_AUDIT)
    return correlate.audit_query(events, tenant="tenant-1", start_ns=NS, end_ns=NS + 1800 * S, action="F")


#: Batches are orders; every 40th has spans with an id of zeros, every 50th is no JSON.
def _otlp(spark, sf_dir):
    rows = fixtures.raw_spans(spark, sf_dir).withColumn("k", F.conv("trace_id", 16, 10).cast("bigint") - 1)
    pair = lambda k, kind, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias(kind)).alias("value"))
    text = F.array_compact(F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value"))))
    zero = F.when((F.col("k") % 40 == 0), F.lit("0" * 16)).otherwise(F.col("span_id"))
    span = F.struct(F.upper("trace_id").alias("traceId"), zero.alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), "name", "kind", F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), text.alias("attributes"), F.struct(F.col("status_code").alias("code")).alias("status"))
    resource = F.struct(F.array(pair("service.name", "stringValue", F.col("service"))).alias("attributes"))
    own = F.struct(resource.alias("resource"), F.array(F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))
    batches = rows.groupBy("tenant", F.col("trace_id").alias("batch_id")).agg(F.collect_list(own).alias("resourceSpans"), F.first("k").alias("k"))
    return batches.select("tenant", "batch_id", F.when(F.col("k") % 50 == 0, "{broken").otherwise(F.to_json(F.struct("resourceSpans"))).alias("payload"))


_GOOD = "(l_order % 50 <> 0 AND l_order % 40 <> 0)"
_ORDERED = "ordered AS (SELECT *, (start_ns - 1704067200000000000) // 1000000 // 200 AS l_order FROM raw)"


@query(f"SELECT tenant, trace_id, span_id, parent_span_id, service, name, kind, start_ns, end_ns, status_code, retries FROM ordered WHERE {_GOOD}", views=(fixtures.SPANS_SQL, _ORDERED))
def normalize_otlp(spark, sf_dir):
    """Requests of an order's spans each; those with a span without an id are rejected, those that aren't JSON give nothing."""
    out = payloads.normalize_otlp(_otlp(spark, sf_dir))
    return out.select("tenant", "trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ns", "end_ns", "status_code", payloads.text_of(F.try_element_at("attrs", F.lit("retry.count"))).alias("retries"))


@query(
    "batches AS (SELECT tenant, l_order, count(*) AS n FROM ordered GROUP BY tenant, l_order) SELECT tenant, CASE WHEN l_order % 50 = 0 THEN 'malformed' WHEN n > 6 THEN 'oversize' WHEN l_order % 40 = 0 THEN 'malformed' ELSE 'accepted' END AS reason, count(*) AS batches, sum(CASE WHEN l_order % 50 = 0 THEN 0 ELSE n END)::bigint AS spans FROM batches GROUP BY 1, 2",
    views=(fixtures.SPANS_SQL, _ORDERED),
)
def reject_report(spark, sf_dir):
    """Six spans at most."""
    return payloads.reject_report(payloads.verdicts(payloads.otlp_spans(_otlp(spark, sf_dir)), max_spans=6), "tenant")


@query("SELECT trace_id, span_id, received_ns, CASE WHEN db IS NOT NULL THEN NULL ELSE '00-' || trace_id || '-' || span_id || CASE WHEN retries = '1' THEN '-01' ELSE '-00' END END AS traceparent FROM raw")
def b3_to_traceparent(spark, sf_dir):
    """Single headers of client spans, X-B3 ones of others; spans of a database have a malformed id."""
    rows = fixtures.raw_spans(spark, sf_dir)
    short = F.when(F.map_contains_key("attrs", "db.system"), "xyz").otherwise(F.substring("trace_id", 17, 16))
    sampled = F.col("attrs")["retry.count"]
    one = F.create_map(F.lit("b3"), F.concat_ws("-", short, "span_id", F.when(sampled == "2", "d").otherwise(sampled)))
    many = F.create_map(F.lit("x-b3-traceid"), short, F.lit("x-b3-spanid"), F.upper("span_id"), F.lit("x-b3-sampled"), sampled)
    return rows.withColumn("headers", F.when(F.col("kind") == 3, one).otherwise(many)).select("trace_id", "span_id", "received_ns", payloads.b3_to_traceparent().alias("traceparent"))


@query("SELECT tenant, service AS caller, 'db-' || name AS callee, count(*) AS calls, count(*) FILTER (status_code = 2) AS errors, sum((end_ns - start_ns) // 1000000)::bigint AS duration_ms FROM raw WHERE kind = 3 GROUP BY tenant, service, name")
def envoy_edges(spark, sf_dir):
    """Access-log lines of all spans; those of client spans name an upstream cluster."""
    up = "if(kind = 3, concat('upstream_cluster=db-', name), '')"
    line = f"concat('[t] \"GET /\" response_code=', if(status_code = 2, 503, 200), ' duration=', (end_ns - start_ns) div 1000000, ' caller=', service, ' ', {up}) as line"
    rows = payloads.envoy_edges(fixtures.raw_spans(spark, sf_dir).selectExpr("tenant", line))
    return rows.groupBy("tenant", "caller", "callee").agg(F.count("*").alias("calls"), F.count_if(F.col("status") >= 500).alias("errors"), F.sum("duration_ms").alias("duration_ms"))
