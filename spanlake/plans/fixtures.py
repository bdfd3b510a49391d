"""Span, log, metric and deploy views over the given tables, for Spark and as SQL for another engine.

Expressions are written once; integer division is ``div`` in Spark and ``//`` in the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_NS = 1_704_067_200_000_000_000
_COLUMNS = {
    "tenant": "concat('tenant-', l_orderkey % 3)",
    "trace_id": "lpad(lower(hex(l_orderkey + 1)), 32, '0')",
    "span_id": "lpad(lower(hex(cast(l_linenumber as bigint))), 16, '0')",
    "parent_span_id": "case when l_linenumber = 1 then null else lpad(lower(hex(cast(l_linenumber {div} 2 as bigint))), 16, '0') end",
    "service": "concat('svc-', l_suppkey % 10)",
    "name": "concat('op-', l_partkey % 2)",
    "kind": "case l_linenumber % 3 when 0 then 3 when 1 then 2 else 1 end",
    "start_ns": "1704067200000000000 + (l_orderkey * 200 + l_linenumber) * 1000000",
    "end_ns": "1704067200000000000 + (l_orderkey * 200 + l_linenumber) * 1000000 + cast(round(l_extendedprice * 100) as bigint) * 100",
    "received_ns": "1704067200000000000 + (l_orderkey * 200 + l_linenumber) * 1000000 + cast(round(l_extendedprice * 100) as bigint) * 100",
    "status_code": "case when l_returnflag = 'R' and l_discount >= 0.09 then 2 else 1 end",
    "peer": "case when l_linenumber % 3 = 0 and l_tax >= 0.06 then concat('svc-', l_partkey % 10) end",
    "http": "case when l_linestatus = 'F' then 'GET' end",
    "db": "case when l_partkey % 7 = 0 then 'pg' end",
    "retries": "cast(cast(l_quantity as bigint) % 3 as {string})",
    "tie1": "l_partkey",
    "tie2": "l_suppkey",
}
_READ = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_ATTRS = {"peer.service": "peer", "http.request.method": "http", "db.system": "db", "retry.count": "retries"}


def _select(div: str, string: str) -> str:
    return ",\n  ".join(f"{e.replace('{div}', div).replace('{string}', string)} AS {k}" for k, e in _COLUMNS.items())


#: Spans as delivered (duplicate span ids are wanted), and after dedupe with the derived columns.
SPANS_SQL = f"""raw AS (SELECT {_select('//', 'varchar')} FROM lineitem),
spans AS (SELECT *, end_ns - start_ns AS duration_ns, status_code = 2 AS is_error, parent_span_id IS NULL AS is_root FROM
  (SELECT *, row_number() OVER (PARTITION BY tenant, trace_id, span_id ORDER BY received_ns, tie1, tie2) AS rn FROM raw) WHERE rn = 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_spans(spark: SparkSession, sf_dir: str, attrs: bool = True) -> DataFrame:
    """Spans as delivered; without ``attrs``, which cost a map for each span, for what reads none. No span here has an error.type."""
    read = table(spark, sf_dir, "lineitem").select(*_READ)
    if read.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a small file is one task: deal it out first
        read = read.repartition(spark.sparkContext.defaultParallelism)
    rows = read.selectExpr(*(f"{e.replace('{div}', 'div').replace('{string}', 'string')} AS {k}" for k, e in _COLUMNS.items()))
    if not attrs:
        return rows.drop(*_ATTRS.values())
    keys = ", ".join(f"if({v} is null, null, '{k}')" for k, v in _ATTRS.items())
    return rows.selectExpr(*(c for c in _COLUMNS if c not in _ATTRS.values()), f"map_from_arrays(array_compact(array({keys})), array_compact(array({', '.join(_ATTRS.values())}))) AS attrs")


def latest(spark: SparkSession, sf_dir: str) -> int:
    """The last arrival of a span."""
    return table(spark, sf_dir, "lineitem").selectExpr(f"max({_COLUMNS['received_ns']})").first()[0]


def deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order stands for a deploy."""
    return table(spark, sf_dir, "orders").selectExpr(*_DEPLOYS)


#: A service here is deployed every few seconds, so that what is near a deploy is near in seconds too.
DEPLOY_NS = 30_000_000_000
#: An error that follows a deploy here follows it at once.
AFTER_NS = 2_000_000_000


_DEPLOYS = ["concat('dep-', o_orderkey) AS deploy_id", "concat('tenant-', o_orderkey % 3) AS tenant", "concat('svc-', o_custkey % 10) AS service", f"{BASE_NS} + o_orderkey * 200000000 AS at_ns"]
DEPLOYS_SQL = f"deploys AS (SELECT {', '.join(_DEPLOYS)} FROM orders)"

#: Logs and exemplars: whole seconds of event time since the base, from the event's id.
_EVENT = ["concat('tenant-', (event_id % 1500) % 3) AS tenant", "lpad(lower(hex(event_id % 1500 + 1)), 32, '0') AS trace_id", "concat('svc-', user_id % 10) AS service"]
_LOGS = [*_EVENT, f"{BASE_NS} + event_id * 10000000 AS ts_ns", "case when event_type = 'error' then 'ERROR' else 'INFO' end AS level", "concat(event_type, ' ', props) AS body", "event_id AS log_id"]
_EXEMPLARS = [*_EVENT, "concat('op-', event_id % 2) AS name", f"{BASE_NS} + event_id * 10000000 AS ts_ns", "value", "event_id AS exemplar_id"]
LOGS_SQL = f"logs AS (SELECT {', '.join(_LOGS)} FROM events)"
EXEMPLARS_SQL = f"exemplars AS (SELECT {', '.join(_EXEMPLARS)} FROM events)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_LOGS)


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_EXEMPLARS)
