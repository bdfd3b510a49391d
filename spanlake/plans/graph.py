"""Queries over the service graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import graph, spans
from spanlake.plans import fixtures
from spanlake.plans.base import BUCKET_SQL, HIST_SQL, NS, S, base_spans, csv, query

_PROTOCOL = "CASE WHEN http IS NOT NULL THEN 'http' WHEN db IS NOT NULL THEN 'db' ELSE 'unknown' END"
_CALLS = f"""clients AS (SELECT *, {_PROTOCOL} AS proto FROM spans WHERE kind IN (3, 4)),
peers AS (SELECT tenant, service AS caller, coalesce(peer, 'db:' || db) AS callee, CASE WHEN peer IS NOT NULL THEN proto ELSE 'db' END AS p, name AS operation, trace_id, span_id, received_ns, duration_ns, status_code = 2 AS failed FROM clients WHERE peer IS NOT NULL OR db IS NOT NULL),
served AS (SELECT s.*, c.service AS c_service, c.proto AS c_proto, coalesce(abs(s.received_ns - c.received_ns) <= 30000000000, false) AS near FROM spans s
  LEFT JOIN clients c ON c.tenant = s.tenant AND c.trace_id = s.trace_id AND c.span_id = s.parent_span_id AND c.peer IS NULL AND c.db IS NULL WHERE s.kind IN (2, 5)),
owned AS (SELECT *, near AND row_number() OVER (PARTITION BY tenant, trace_id, parent_span_id, near ORDER BY received_ns, span_id) = 1 AS own FROM served),
joined AS (SELECT tenant, CASE WHEN own THEN c_service ELSE 'external' END AS caller, service AS callee, CASE WHEN own THEN c_proto ELSE 'unknown' END AS p, name AS operation, trace_id, span_id, received_ns, duration_ns, status_code = 2 AS failed FROM owned),
calls AS (SELECT tenant, caller, callee, CASE WHEN caller = callee THEN 'internal' ELSE p END AS protocol, operation, trace_id, span_id, received_ns, duration_ns, failed, {BUCKET_SQL} AS b FROM (SELECT * FROM peers UNION ALL SELECT * FROM joined)),
edges AS (SELECT tenant, caller, callee, protocol, count(*) AS calls, count(*) FILTER (failed) AS errors, sum(duration_ns)::bigint AS duration_sum_ns, {HIST_SQL} AS hist, min(received_ns) AS first_ns, max(received_ns) AS last_ns FROM calls GROUP BY tenant, caller, callee, protocol),
links AS (SELECT tenant, caller AS a, callee AS b FROM edges UNION SELECT tenant, callee, caller FROM edges)"""
VIEWS = (fixtures.SPANS_SQL, _CALLS)
CALLS_SQL = _CALLS
_KEY = "tenant, caller, callee, protocol"


def base_calls(spark, sf_dir):
    """Attributes are read before the dedupe, and only clients and servers are deduplicated: an id's kind is always the same here."""
    raw = graph.prepared(spans.features(fixtures.raw_spans(spark, sf_dir))).where(F.col("kind").isin(*graph.CALLERS, *graph.CALLEES))
    return graph.calls(spans.dedupe(raw, order=("received_ns", "tie1", "tie2"), whole_traces=True))


def base_edges(spark, sf_dir):
    return graph.edges(base_calls(spark, sf_dir))


@query("SELECT tenant, CASE WHEN caller = callee THEN 'internal' ELSE p END AS protocol, caller, callee, trace_id, span_id FROM peers", views=VIEWS)
def peer_edges(spark, sf_dir):
    return graph.peer_calls(base_spans(spark, sf_dir)).select("tenant", "protocol", "caller", "callee", "trace_id", "span_id")


@query("SELECT tenant, CASE WHEN caller = callee THEN 'internal' ELSE p END AS protocol, caller, callee, trace_id, span_id FROM joined", views=VIEWS)
def edge_join(spark, sf_dir):
    return graph.joined_calls(base_spans(spark, sf_dir)).select("tenant", "protocol", "caller", "callee", "trace_id", "span_id")


@query("SELECT protocol, count(*) AS calls FROM calls GROUP BY protocol", views=VIEWS)
def edge_protocol(spark, sf_dir):
    return base_calls(spark, sf_dir).groupBy("protocol").agg(F.count("*").alias("calls"))


@query("SELECT * FROM edges", views=VIEWS)
def service_graph(spark, sf_dir):
    return base_edges(spark, sf_dir).withColumn("hist", csv("hist"))


@query(f"SELECT {_KEY}, received_ns - received_ns % 10000000000 AS bucket_ns, count(*) AS calls, count(*) FILTER (failed) AS errors, sum(duration_ns)::bigint AS duration_sum_ns FROM calls GROUP BY {_KEY}, received_ns - received_ns % 10000000000", views=VIEWS)
def edge_red(spark, sf_dir):
    return graph.edges(base_calls(spark, sf_dir), width_ns=10 * S).select("tenant", "caller", "callee", "protocol", "bucket_ns", "calls", "errors", "duration_sum_ns")


@query(f"SELECT * FROM (SELECT {_KEY}, operation, count(*) AS calls, count(*) FILTER (failed) AS errors, max(duration_ns) AS max_ns, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, operation) AS rank FROM calls GROUP BY {_KEY}, operation) WHERE rank <= 1", views=VIEWS)
def edge_ops_top(spark, sf_dir):
    return graph.edge_operations(base_calls(spark, sf_dir), n=1).drop("p99_ns")


@query(f"SELECT {_KEY}, calls FROM edges WHERE last_ns >= {NS + 60 * S} AND first_ns <= {NS + 120 * S}", views=VIEWS)
def edges_in_window(spark, sf_dir):
    return graph.edges_in_window(base_edges(spark, sf_dir), start_ns=NS + 60 * S, end_ns=NS + 120 * S).select("tenant", "caller", "callee", "protocol", "calls")


@query(f"SELECT {_KEY}, received_ns AS at_ns, before_ns FROM (SELECT *, lag(received_ns) OVER (PARTITION BY {_KEY} ORDER BY received_ns, trace_id, span_id) AS before_ns FROM calls) WHERE before_ns IS NULL OR received_ns - before_ns > 60000000000", views=VIEWS)
def new_edges(spark, sf_dir):
    """Silence of a minute: the data spans less than a day."""
    return graph.new_edges(base_calls(spark, sf_dir), quiet_ns=60 * S)


@query(f"SELECT {_KEY}, last_ns FROM edges WHERE (SELECT max(received_ns) FROM raw) - last_ns > 150000000000", views=VIEWS)
def vanished_edges(spark, sf_dir):
    return graph.vanished_edges(base_edges(spark, sf_dir), now_ns=fixtures.latest(spark, sf_dir), after_ns=150 * S).select("tenant", "caller", "callee", "protocol", "last_ns")


@query(
    """hop1 AS (SELECT DISTINCT b FROM links WHERE tenant = 'tenant-0' AND a = 'svc-1' AND b <> 'svc-1'),
hop2 AS (SELECT DISTINCT l.b FROM links l JOIN hop1 h ON l.a = h.b WHERE l.tenant = 'tenant-0' AND l.b <> 'svc-1' AND l.b NOT IN (SELECT b FROM hop1))
SELECT b AS other, 1 AS hops FROM hop1 UNION ALL SELECT b, 2 FROM hop2""",
    views=VIEWS,
)
def neighbors(spark, sf_dir):
    return graph.neighbors(base_edges(spark, sf_dir), tenant="tenant-0", service="svc-1", hops=2)


_DISTANCE = """nodes AS (SELECT DISTINCT tenant, a FROM links),
d1 AS (SELECT DISTINCT tenant, a, b FROM links WHERE a <> b),
d2 AS (SELECT DISTINCT x.tenant, x.a, y.b FROM d1 x JOIN d1 y ON x.tenant = y.tenant AND x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM d1 z WHERE z.tenant = x.tenant AND z.a = x.a AND z.b = y.b)),
distances AS (SELECT tenant, a AS service, a AS other, 0 AS hops FROM nodes UNION ALL SELECT tenant, a, b, 1 FROM d1 UNION ALL SELECT tenant, a, b, 2 FROM d2)"""
DISTANCE_SQL = _DISTANCE


@query("SELECT * FROM distances", views=(*VIEWS, _DISTANCE))
def service_distance(spark, sf_dir):
    return graph.distances(base_edges(spark, sf_dir), hops=2)


@query("SELECT tenant, caller, callee, protocol, calls FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY calls DESC, last_ns DESC, first_ns DESC, caller, callee, protocol) AS r FROM edges) WHERE r <= 50", views=VIEWS)
def edge_cap(spark, sf_dir):
    return graph.capped(base_edges(spark, sf_dir), most=50).select("tenant", "caller", "callee", "protocol", "calls")


@query("SELECT e.tenant, count(*) AS edges, (SELECT count(DISTINCT a) FROM links l WHERE l.tenant = e.tenant) AS services, sum(calls)::bigint AS calls FROM edges e GROUP BY e.tenant", views=VIEWS)
def graph_snapshot(spark, sf_dir):
    return graph.snapshot(base_edges(spark, sf_dir))


@query("""SELECT tenant, '"' || caller || '" -> "' || callee || '" [protocol=' || protocol || ' calls=' || calls || ']' AS line FROM edges""", views=VIEWS)
def graph_export(spark, sf_dir):
    return graph.export(base_edges(spark, sf_dir))
