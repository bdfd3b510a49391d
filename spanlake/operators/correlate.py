"""Logs and metrics that belong to traces, services and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_search(logs: DataFrame, *, tenant: str, service: str, start_ns: int, end_ns: int, text: str = "", limit: int = 500) -> DataFrame:
    """The first ``limit`` logs of a service in a window, ends included, that have ``text`` literally."""
    rows = logs.where((F.col("tenant") == tenant) & (F.col("service") == service) & F.col("ts_ns").between(start_ns, end_ns))
    return (rows.where(F.contains("body", F.lit(text))) if text else rows).orderBy("ts_ns", "log_id").limit(limit)


def logs_for_traces(logs: DataFrame, traces: DataFrame, *, pad_ns: int, limit: int = 500) -> DataFrame:
    """For all ``traces``, their first ``limit`` logs from ``pad_ns`` before them to as long after, and whether there are more.

    Ranks are cut before the shuffle, so a trace with very many logs sends few of each task.
    """
    spans = traces.select("tenant", "trace_id", (F.col("start_ns") - pad_ns).alias("low"), (F.col("end_ns") + pad_ns).alias("high"))
    near = logs.join(spans, ["tenant", "trace_id"]).where("ts_ns between low and high").drop("low", "high")
    own = Window.partitionBy("tenant", "trace_id")
    first = near.withColumn("rank", F.row_number().over(own.orderBy("ts_ns", "log_id"))).where(F.col("rank") <= limit + 1)
    return first.withColumn("truncated", F.max("rank").over(own) > limit).where(F.col("rank") <= limit)


def metric_range(exemplars: DataFrame, *, start_ns: int, end_ns: int, step_s: int = 60, **fields: str) -> DataFrame:
    """Mean exemplar value by step, aligned to the epoch, of each operation in a window; ``fields`` filter, empty ones match all."""
    rows = exemplars.where(F.col("ts_ns").between(start_ns, end_ns))
    for name, value in fields.items():
        rows = rows.where(F.col(name) == value) if value else rows
    width = step_s * 1_000_000_000
    return rows.groupBy("tenant", "service", "name", (F.col("ts_ns") - F.col("ts_ns") % width).alias("step_ns")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def metric_series(exemplars: DataFrame, *, start_ns: int, end_ns: int) -> DataFrame:
    """Points, smallest and largest value, first and last time of each operation's series in a window; empty series have no row."""
    rows = exemplars.where(F.col("ts_ns").between(start_ns, end_ns))
    return rows.groupBy("tenant", "service", "name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def metrics_for_spans(exemplars: DataFrame, spans: DataFrame, *, pad_ns: int, source: str = "exemplars") -> DataFrame:
    """(tenant, trace_id, span_id, source, points): for each span the exemplars (ts_ns, value) of its service and operation from ``pad_ns``
    before its start to as long after its end, in time order; spans without any have no row.

    Times are cut into steps of ``pad_ns``; a span is handed to the steps that it touches, which makes the range an equi-join.
    """
    step = lambda c: F.floor(c / F.lit(pad_ns)).cast("bigint")
    low, high = F.col("start_ns") - pad_ns, F.col("end_ns") + pad_ns
    asked = spans.select("tenant", "service", "name", "trace_id", "span_id", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(step(low), step(high))).alias("_step"))
    told = exemplars.select("tenant", "service", "name", step(F.col("ts_ns")).alias("_step"), "ts_ns", "value")
    found = asked.join(told, ["tenant", "service", "name", "_step"]).where(F.col("ts_ns").between(F.col("_low"), F.col("_high")))
    return found.groupBy("tenant", "trace_id", "span_id").agg(F.array_sort(F.collect_list(F.struct("ts_ns", "value"))).alias("points")).withColumn("source", F.lit(source))


def audit_query(events: DataFrame, *, tenant: str, start_ns: int, end_ns: int, actor: str = "", action: str = "") -> DataFrame:
    """Audit events of a tenant from ``start_ns`` to ``end_ns``, in time order; an empty actor or action matches all."""
    rows = events.where((F.col("tenant") == tenant) & F.col("at_ns").between(start_ns, end_ns))
    for name, value in (("actor", actor), ("action", action)):
        rows = rows.where(F.col(name) == value) if value else rows
    return rows.orderBy("at_ns", "seq")
