"""Queries over retention, merged tables, actions, audit chains and scores of root-cause results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanlake.operators import anomaly, audit, graph, lifecycle, red
from spanlake.operators.lineage import cut, folder
from spanlake.plans import fixtures
from spanlake.plans.base import HIST_SQL, NS, RED_SQL, S, TRACES_SQL, base_red, base_spans, base_traces, csv, query
from spanlake.plans.graph import CALLS_SQL, base_edges

_MIDDLE = f"(SELECT (max(received_ns) + {NS}) // 2 FROM raw)"


def _middle(spark, sf_dir):
    return (fixtures.latest(spark, sf_dir) + NS) // 2


@query(f"SELECT tenant, trace_id, span_id FROM spans WHERE received_ns - received_ns % {10 * S} + {10 * S - 1} >= {_MIDDLE}")
def expire_rows(spark, sf_dir):
    """What stays of spans when the first half of the time goes, by buckets of ten seconds."""
    return lifecycle.expire(base_spans(spark, sf_dir), time_col="received_ns", before_ns=_middle(spark, sf_dir), bucket_ns=10 * S).select("tenant", "trace_id", "span_id")


_BLOCKS = f"blocks AS (SELECT tenant, (start_ns - {NS}) // {60 * S} AS minute, count(*) AS traces, max(end_ns) AS sealed_ns FROM traces GROUP BY tenant, (start_ns - {NS}) // {60 * S})"


def _blocks(spark, sf_dir):
    """Blocks of a minute, sealed with their last arrival."""
    return base_traces(spark, sf_dir).groupBy("tenant", F.expr(f"(start_ns - {NS}) div {60 * S}").alias("minute")).agg(F.count("*").alias("traces"), F.max("end_ns").alias("sealed_ns"))


@query(f"SELECT tenant, minute, traces FROM blocks WHERE sealed_ns + {30 * S} <= {_MIDDLE}", views=(fixtures.SPANS_SQL, TRACES_SQL, _BLOCKS))
def expire_blocks(spark, sf_dir):
    return lifecycle.expired_blocks(_blocks(spark, sf_dir), retention_ns=30 * S, now_ns=_middle(spark, sf_dir)).drop("sealed_ns")


#: Tables of the plan: their SQL, the column of their time, and here their horizon in seconds, since the data spans less than a day.
_RETAINED = {"spans": ("spans", "received_ns", 60), "traces": ("traces", "start_ns", 120), "red": ("red", "bucket_ns", 300), "edges": ("edges", "last_ns", 2), "anomalous": ("traces WHERE error_count > 0", "end_ns", 400), "sampled": ("traces WHERE error_count = 0", "end_ns", 200)}


@query(
    " UNION ALL ".join(f"""SELECT '{name}' AS "table", tenant, count(*) AS rows, count(*) FILTER ({at} < (SELECT max(received_ns) FROM raw) - {n * S}) AS expired FROM {rows} GROUP BY tenant""" for name, (rows, at, n) in _RETAINED.items()),
    views=(fixtures.SPANS_SQL, TRACES_SQL, RED_SQL, CALLS_SQL),
)
def retention_plan(spark, sf_dir):
    """All six tables, kept traces by tier."""
    own, trace = base_spans(spark, sf_dir), base_traces(spark, sf_dir)
    rows = {"spans": own, "traces": trace, "red": red.rollup(own), "edges": base_edges(spark, sf_dir), "anomalous": trace.where("error_count > 0"), "sampled": trace.where("error_count = 0")}
    return lifecycle.retention_plan({k: (r, _RETAINED[k][1]) for k, r in rows.items()}, now_ns=fixtures.latest(spark, sf_dir), horizons={k: n * S for k, (_, _, n) in _RETAINED.items()})


_CONCLUDED = ["concat('tenant-', o_orderkey % 3) AS tenant", "o_orderkey AS incident", "case when o_orderstatus = 'F' then 'concluded' else 'open' end AS outcome", "(o_orderkey % 100) / cast(100 as double) AS confidence", f"{NS} + o_orderkey * {S} AS at_ns"]


@query(f"SELECT tenant, incident, 'sig-' || (o_custkey % 50) || ',path-' || (o_custkey % 7) AS signatures, at_ns + {86400 * S} AS expires_ns FROM (SELECT {', '.join(_CONCLUDED)}, o_custkey FROM orders) WHERE outcome = 'concluded' AND confidence >= 0.75", views=("none AS (SELECT 1)",))
def recurrence_predicates(spark, sf_dir):
    """Orders as investigations."""
    rows = fixtures.table(spark, sf_dir, "orders").selectExpr(*_CONCLUDED, "array(concat('sig-', o_custkey % 50), concat('path-', o_custkey % 7)) as signatures")
    return lifecycle.recurrence_predicates(rows).withColumn("signatures", csv("signatures"))


@query(f"SELECT tenant, service, name, bucket_ns, count(*) AS calls, count(*) FILTER (is_error) AS errors, sum(duration_ns)::bigint AS duration_sum_ns, {HIST_SQL} AS hist FROM bucketed GROUP BY tenant, service, name, bucket_ns", views=(fixtures.SPANS_SQL, RED_SQL))
def index_batch_upsert(spark, sf_dir):
    """A stored rollup of server spans, and one of all others as a batch: together that of all spans."""
    rows = base_spans(spark, sf_dir)
    old, new = red.rollup(rows.where("kind = 2")), red.rollup(rows.where("kind <> 2"))
    return lifecycle.merge(old, new, key=["tenant", "service", "name", "bucket_ns"], add=("calls", "errors", "duration_sum_ns"), add_each={"hist": 16}).withColumn("hist", csv("hist"))


@query("SELECT tenant, caller, callee, protocol, calls FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY calls DESC, last_ns DESC, first_ns DESC, caller, callee, protocol) AS r FROM edges) WHERE r <= 100", views=(fixtures.SPANS_SQL, CALLS_SQL))
def load_edges(spark, sf_dir):
    """Edges, written and loaded again: at most 100 of a tenant."""
    path = f"{folder(spark)}/edges-{uuid.uuid4().hex}"
    lifecycle.write_edges(base_edges(spark, sf_dir), path)
    return lifecycle.load_edges(spark, path, most=100).select("tenant", "caller", "callee", "protocol", "calls")


@query(f"SELECT tenant, trace_id FROM traces WHERE start_ns < {_MIDDLE} AND error_count = 0", views=(fixtures.SPANS_SQL, TRACES_SQL))
def pending_cold(spark, sf_dir):
    """Traces with errors stand for those that are in a block."""
    rows = cut(base_traces(spark, sf_dir))
    return lifecycle.pending(rows, rows.where("error_count > 0"), before_ns=_middle(spark, sf_dir)).select("tenant", "trace_id")


_STATES = "case o_orderkey % 5 when 0 then 'proposed' when 1 then 'approved' when 2 then 'executed' when 3 then 'rejected' else 'expired' end"
_ACTIONS = ["concat('tenant-', o_orderkey % 3) AS tenant", "o_orderkey AS action", "o_custkey AS incident", f"{_STATES} AS state", f"{NS} + o_orderkey * {S} AS proposed_ns", f"{NS} + o_orderkey * {S} + {3600 * S} AS expires_ns"]
_ACTIONS_SQL = f"actions AS (SELECT {', '.join(_ACTIONS)} FROM orders)"
_NOW = f"(SELECT max(proposed_ns) FROM actions) - {600 * S}"


def _actions(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").selectExpr(*_ACTIONS)


@query("SELECT action, incident, state FROM actions WHERE tenant = 'tenant-1' AND state IN ('proposed', 'approved')", views=(_ACTIONS_SQL,))
def actions_list(spark, sf_dir):
    return lifecycle.actions(_actions(spark, sf_dir), tenant="tenant-1", states=("proposed", "approved")).select("action", "incident", "state")


@query(f"SELECT action, CASE WHEN state = 'proposed' AND {_NOW} - proposed_ns > {900 * S} OR state = 'approved' AND expires_ns < {_NOW} THEN 'expired' ELSE state END AS state FROM actions", views=(_ACTIONS_SQL,))
def expire_actions(spark, sf_dir):
    rows = _actions(spark, sf_dir)
    now = rows.agg(F.max("proposed_ns")).first()[0] - 600 * S
    return lifecycle.expire_actions(rows, now_ns=now, ttl_ns=900 * S).select("action", "state")


@query("SELECT tenant, state, count(*) AS actions FROM actions GROUP BY tenant, state", views=(_ACTIONS_SQL,))
def action_counts(spark, sf_dir):
    return lifecycle.action_counts(_actions(spark, sf_dir))


@query("SELECT tenant, incident, count(*) FILTER (state NOT IN ('rejected', 'expired')) AS used FROM actions GROUP BY tenant, incident", views=(_ACTIONS_SQL,))
def action_budget(spark, sf_dir):
    return lifecycle.action_budget(_actions(spark, sf_dir))


@query(
    f"""around AS (SELECT tenant, a AS epicenter, list_sort(list(DISTINCT b)) AS blast FROM links GROUP BY tenant, a)
SELECT tenant, epicenter AS incident, array_to_string(list_slice(list_sort(list_distinct(list_append(blast, epicenter))), 1, 32), ',') AS services, {NS} + {1800 * S} AS expires_ns FROM around""",
    views=(fixtures.SPANS_SQL, CALLS_SQL),
)
def scope_predicates(spark, sf_dir):
    """An incident at every service, with its neighbours in the graph as blast radius; services are sorted to be compared."""
    links = graph.neighbours(base_edges(spark, sf_dir)).withColumnRenamed("service", "epicenter")
    rows = links.select("tenant", F.col("epicenter").alias("incident"), "epicenter", F.col("around").alias("blast_radius"), F.lit(NS).alias("at_ns"))
    return lifecycle.scope_predicates(rows).withColumn("services", F.array_join(F.array_sort("services"), ","))


_AUDIT = ["concat('tenant-', o_orderkey % 3) AS tenant", "cast(o_orderkey as bigint) AS seq", "concat('user-', o_custkey) AS actor", "o_orderstatus AS action", "o_orderpriority AS payload", f"{NS} + o_orderkey * 200000000 AS at_ns"]


def _chain(spark, sf_dir):
    return audit.chained(fixtures.table(spark, sf_dir, "orders").selectExpr(*_AUDIT))


@query("SELECT concat('tenant-', o_orderkey % 3) AS tenant, count(*) AS events, min(CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 700 = 7 THEN o_orderkey END) AS broken_seq FROM orders GROUP BY concat('tenant-', o_orderkey % 3)", views=("none AS (SELECT 1)",))
def audit_verify(spark, sf_dir):
    """A chain of all orders, with the payload of some of one tenant's altered."""
    altered = F.expr("if(seq % 3 = 1 and seq % 700 = 7, concat(payload, '!'), payload)")
    return audit.verified(cut(_chain(spark, sf_dir)).withColumn("payload", altered))


@query("SELECT concat('tenant-', o_orderkey % 3) AS tenant, max(o_orderkey) AS seq, true AS sound FROM orders GROUP BY concat('tenant-', o_orderkey % 3)", views=("none AS (SELECT 1)",))
def audit_anchor(spark, sf_dir):
    """The last event of each chain; sound: its hash follows from the one before it."""
    rows = cut(_chain(spark, sf_dir))
    sound = audit.verified(rows).select("tenant", F.col("broken_seq").isNull().alias("sound"))
    return audit.anchors(rows).drop("hash").join(sound, "tenant")


_WANT = ["o_orderkey AS scenario", "cast(o_orderkey % 3 as int) AS category", "concat('svc-', o_custkey % 4) AS component", "o_orderkey % 600 AS seconds_", "o_custkey * 100 AS cost"]
_HYPOTHESES = ["l_orderkey AS scenario", "cast(l_partkey % 3 as int) AS category", "concat('svc-', l_suppkey % 4) AS component", "l_discount AS score", "l_linenumber * 1000000 + l_partkey AS seq", "l_suppkey AS tie"]
_EVAL_SQL = f"""wanted AS (SELECT {', '.join(_WANT)} FROM orders), hypotheses AS (SELECT {', '.join(_HYPOTHESES)} FROM lineitem),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY h.scenario ORDER BY score DESC, h.seq * 100000 + tie) AS rank, h.category = w.category AS near, h.category = w.category AND h.component = w.component AS exact FROM hypotheses h JOIN wanted w ON w.scenario = h.scenario),
best AS (SELECT w.scenario, coalesce(max(exact AND rank = 1), false) AS top1, coalesce(max(exact), false) AS top3, coalesce(max(near), false) AS near FROM wanted w LEFT JOIN ranked r ON r.scenario = w.scenario AND rank <= 3 GROUP BY w.scenario),
surfaced AS (SELECT l_orderkey AS scenario, list(DISTINCT cast(l_partkey % 5 as int)) AS own FROM lineitem GROUP BY l_orderkey),
needed AS (SELECT o_orderkey AS scenario, list_distinct([cast(o_orderkey % 5 as int), cast(o_custkey % 5 as int)]) AS want FROM orders),
evidence AS (SELECT n.scenario, CASE WHEN own IS NULL THEN 0.0 ELSE len(list_intersect(own, want)) / len(own)::double END AS "precision", CASE WHEN own IS NULL THEN 0.0 ELSE len(list_intersect(own, want)) / len(want)::double END AS recall FROM needed n LEFT JOIN surfaced s ON s.scenario = n.scenario),
report AS (SELECT count(*) AS scenarios, avg(top1::int) AS top1, avg(top3::int) AS top3, avg(seconds_) AS seconds, avg("precision") AS "precision", avg(recall) AS recall, floor(quantile_cont(cost, 0.5))::bigint AS median_cost, max(cost) AS max_cost FROM best JOIN evidence USING (scenario) JOIN wanted USING (scenario))"""


def _wanted(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").selectExpr(*_WANT)


def _hypotheses(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "lineitem").selectExpr(*_HYPOTHESES).withColumn("seq", F.expr("seq * 100000 + tie")).drop("tie")


@query("SELECT scenario, rank, near AS same_category, exact FROM ranked", views=(_EVAL_SQL,))
def hypothesis_vs_expectation(spark, sf_dir):
    from pyspark.sql import Window

    rows = audit.matched(_hypotheses(spark, sf_dir), _wanted(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("score"), "seq"))
    return rows.select("scenario", rank.alias("rank"), "same_category", "exact")


@query('SELECT scenario, top1, top3, CASE WHEN top1 THEN 1.0 WHEN near THEN 0.5 ELSE 0.0 END AS "partial" FROM best', views=(_EVAL_SQL,))
def score_root_cause(spark, sf_dir):
    return audit.root_cause_scores(_hypotheses(spark, sf_dir), _wanted(spark, sf_dir))


def _evidence(spark, sf_dir):
    surfaced = fixtures.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as scenario", "cast(l_partkey % 5 as int) as category")
    expected = fixtures.table(spark, sf_dir, "orders").selectExpr("o_orderkey as scenario", "array(cast(o_orderkey % 5 as int), cast(o_custkey % 5 as int)) as categories")
    return audit.evidence_scores(surfaced, expected)


@query('SELECT scenario, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM evidence', views=(_EVAL_SQL,))
def score_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def _report(spark, sf_dir):
    rows = audit.root_cause_scores(_hypotheses(spark, sf_dir), _wanted(spark, sf_dir)).join(_evidence(spark, sf_dir), "scenario").join(_wanted(spark, sf_dir).select("scenario", F.col("seconds_").alias("seconds"), "cost"), "scenario")
    return audit.report(rows)


@query('SELECT scenarios, round(top1, 6) AS top1, round(top3, 6) AS top3, round(seconds, 6) AS seconds, round("precision", 6) AS "precision", round(recall, 6) AS recall, median_cost, max_cost FROM report', views=(_EVAL_SQL,))
def eval_report(spark, sf_dir):
    return _report(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("top1", "top3", "seconds", "precision", "recall")})


@query(
    """SELECT top1 >= 0.4 - 1e-9 AS accuracy, seconds <= 180 + 1e-9 AS time, median_cost <= 80000 AS median, max_cost <= 500000 AS most, true AS no_drop, seconds <= 0.5 * seconds * 1.25 + 1e-9 AS no_slower,
  top1 >= 0.4 - 1e-9 AND seconds <= 180 + 1e-9 AND median_cost <= 80000 AND max_cost <= 500000 AND seconds <= 0.5 * seconds * 1.25 + 1e-9 AS passed FROM report""",
    views=(_EVAL_SQL,),
)
def eval_gates(spark, sf_dir):
    """Against a baseline of the same accuracy that took half the time."""
    own = _report(spark, sf_dir)
    return audit.gates(own, own.withColumn("seconds", F.col("seconds") * 0.5))


@query(
    """SELECT tenant, service, arg_max(peer, (received_ns, peer)) FILTER (peer IS NOT NULL) AS peer_service, arg_max(db, (received_ns, db)) FILTER (db IS NOT NULL) AS db_system FROM spans GROUP BY tenant, service"""
)
def service_meta(spark, sf_dir):
    return lifecycle.service_meta(base_spans(spark, sf_dir), keys=("peer.service", "db.system"))


_SLO = f"""by_bucket AS (SELECT tenant, service, bucket_ns, sum(calls) AS calls, sum(errors) AS errors FROM red GROUP BY tenant, service, bucket_ns),
over AS (SELECT *, sum(errors) OVER w > 0.06 * sum(calls) OVER w AS bad FROM by_bucket WINDOW w AS (PARTITION BY tenant, service ORDER BY bucket_ns RANGE BETWEEN {60 * S - 1} PRECEDING AND CURRENT ROW)),
islands AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY tenant, service ORDER BY bucket_ns) AS island FROM over),
stretches AS (SELECT tenant, service, min(bucket_ns) AS start_ns, max(bucket_ns) + {10 * S} AS end_ns FROM islands WHERE bad GROUP BY tenant, service, island)"""


@query(f"SELECT * FROM stretches WHERE end_ns - start_ns >= {30 * S}", views=(fixtures.SPANS_SQL, RED_SQL, _SLO))
def slo_breach(spark, sf_dir):
    """Errors of over 6 % in a minute, for half a minute at least."""
    return lifecycle.slo_breaches(base_red(spark, sf_dir), ratio=0.06, window_ns=60 * S, sustained_ns=30 * S)


@query(
    f"""by_bucket AS (SELECT tenant, service, bucket_ns, count(*) AS calls, count(*) FILTER (retries <> '0') AS retried FROM bucketed GROUP BY tenant, service, bucket_ns)
SELECT tenant, service, bucket_ns, calls, retried FROM (SELECT *, avg(calls) OVER (PARTITION BY tenant, service) AS mean FROM by_bucket) WHERE calls > 1.4 * mean AND retried > 0.5 * calls""",
    views=(fixtures.SPANS_SQL, RED_SQL),
)
def rule_retry_storm(spark, sf_dir):
    """1.4 times the mean rate: these spans come evenly."""
    bucket = red.floor_to("received_ns", 10 * S).alias("bucket_ns")
    retried = base_spans(spark, sf_dir).groupBy("tenant", "service", bucket).agg(F.count_if(F.try_element_at("attrs", F.lit("retry.count")) != "0").alias("retried"))
    return lifecycle.retry_storms(base_red(spark, sf_dir), retried, factor=1.4)


@query(
    f"""SELECT tenant, service, signature, samples > 30 AND samples % 2 = 0 OR (SELECT max(received_ns) FROM raw) - first_ns >= {2 * 300 * S} OR samples > 60 AS page FROM (
  SELECT tenant, service, md5(service || chr(1) || name || chr(1)) AS signature, min(received_ns) AS first_ns, count(*) AS samples FROM spans WHERE is_error GROUP BY tenant, service, name)"""
)
def page_gate(spark, sf_dir):
    """Error signatures as incidents: an even number of samples over 30 stands for an ended investigation with evidence, over 60 for a breach."""
    rows = anomaly.error_signatures(base_spans(spark, sf_dir)).withColumns({"ended": F.expr("samples > 30"), "evidence": F.expr("1 - samples % 2"), "reached_ns": F.col("first_ns") + 300 * S, "breached": F.expr("samples > 60")})
    return lifecycle.page_gate(rows, now_ns=fixtures.latest(spark, sf_dir)).select("tenant", "service", "signature", "page")

