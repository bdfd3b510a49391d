"""Rate, errors and duration: rollups, cascades, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import latency

SECOND = 1_000_000_000


def floor_to(column: str, width_ns: int) -> Column:
    return (F.col(column) - F.pmod(F.col(column), F.lit(width_ns))).cast("bigint")


def rollup(spans: DataFrame, *, width_ns: int = 10 * SECOND, time_col: str = "received_ns", exemplars: int = 4, sketch: int | None = None) -> DataFrame:
    """Calls, errors, summed duration, histogram and exemplar trace ids by tenant, service, operation and bucket; with ``sketch``, the
    size of it, a KLL sketch of the durations too (``SKETCH`` keeps the error of a rank under 1 %), which can be stored and merged.

    The exemplars are the lowest trace ids of each of ``exemplars`` classes (the last character's code, modulo their number), so that all
    columns are combined before the one shuffle: a busy bucket arrives as a row from each task. Without any (0), nothing needs sorting.
    """
    key = ["tenant", "service", "name", "bucket_ns"]
    keyed = spans.select("tenant", "service", "name", floor_to(time_col, width_ns).alias("bucket_ns"), "trace_id", "is_error", "duration_ns").withColumn("_b", latency.bucket(F.col("duration_ns")))
    kind = F.ascii(F.right("trace_id", F.lit(1))) % exemplars
    least = [F.min(F.when(kind == i, F.col("trace_id"))) for i in range(exemplars)]
    shown = [F.array_sort(F.array_compact(F.array(*least))).alias("exemplars")] if exemplars else []
    sketches = [F.call_function("kll_sketch_agg_bigint", F.col("duration_ns"), F.lit(sketch)).alias("sketch")] if sketch else []
    return keyed.groupBy(*key).agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.sum("duration_ns").alias("duration_sum_ns"), latency.counted(F.col("_b")).alias("hist"), *shown, *sketches)


def first_exemplars(spans: DataFrame, *, width_ns: int = 10 * SECOND, time_col: str = "received_ns", n: int = 4) -> DataFrame:
    """(tenant, service, name, bucket_ns, exemplars): the ``n`` least trace ids of each bucket, or all if it has fewer.

    Ranks are limited before the shuffle, so that a task sends the spans of ``n`` traces of a bucket, however busy that is.
    """
    key = ["tenant", "service", "name", "bucket_ns"]
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("trace_id"))
    rows = spans.select("tenant", "service", "name", floor_to(time_col, width_ns).alias("bucket_ns"), "trace_id").withColumn("_k", rank).where(F.col("_k") <= n)
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("trace_id")).alias("exemplars"))


#: Size of a sketch of durations. One of up to so many durations holds them all.
SKETCH = 512


def _merged(red: DataFrame) -> list[Column]:
    return [F.call_function("kll_merge_agg_bigint", F.col("sketch")).alias("sketch")] if "sketch" in red.columns else []


def cascade(red: DataFrame, *, width_ns: int, before_ns: int | None = None) -> DataFrame:
    """Buckets older than ``before_ns``, added up at a coarser width, histograms and sketches included."""
    rows = red.where(F.col("bucket_ns") < before_ns) if before_ns is not None else red
    rows = rows.withColumn("bucket_ns", floor_to("bucket_ns", width_ns))
    return rows.groupBy("tenant", "service", "name", "bucket_ns").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration_sum_ns").alias("duration_sum_ns"), latency.merged("hist").alias("hist"), *_merged(red))


def sketched_quantiles(red: DataFrame, *, by: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, p50_ns ...): quantiles of durations over all buckets of a group, from the stored sketches; spans aren't read again.
    A value is that of rank ceil(p n), exactly up to ``SKETCH`` durations, within 1 % of the ranks beyond."""
    found = red.groupBy(*by).agg(*_merged(red)).withColumn("q", F.call_function("kll_sketch_get_quantile_bigint", F.col("sketch"), F.array(*(F.lit(p) for p in ps))))
    return found.select(*by, *(F.get("q", F.lit(i)).alias(f"p{round(p * 100)}_ns") for i, p in enumerate(ps)))


def resolution(span_ns: int) -> str:
    """The table for a window: ten seconds up to an hour, five minutes up to 48 hours, else an hour."""
    return "10s" if span_ns <= 3600 * SECOND else "5m" if span_ns <= 48 * 3600 * SECOND else "1h"


def query(tables: dict[str, DataFrame], *, tenant: str, service: str, name: str, start_ns: int, end_ns: int) -> DataFrame:
    """The series of an operation in a window, with quantiles, from the table that suits the window."""
    rows = tables[resolution(end_ns - start_ns)].where((F.col("tenant") == tenant) & (F.col("service") == service) & (F.col("name") == name) & F.col("bucket_ns").between(start_ns, end_ns))
    return rows.withColumn("q", latency.quantiles(F.col("hist"))).orderBy("bucket_ns")


def compare_windows(red: DataFrame, *, start_ns: int, end_ns: int) -> DataFrame:
    """Calls and errors of [start, end) and of the window of equal length before it, by service, in one pass."""
    before = 2 * start_ns - end_ns
    now, then = F.col("bucket_ns") >= start_ns, F.col("bucket_ns") < start_ns
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    rows = red.where((F.col("bucket_ns") >= before) & (F.col("bucket_ns") < end_ns))
    return rows.groupBy("tenant", "service").agg(total("calls", now).alias("calls"), total("calls", then).alias("calls_before"), total("errors", now).alias("errors"), total("errors", then).alias("errors_before"))


def overview(red: DataFrame, *, start_ns: int, end_ns: int) -> DataFrame:
    """Tiles by service: calls, error rate, mean duration, p95, over all operations of a window."""
    rows = red.where(F.col("bucket_ns").between(start_ns, end_ns)).groupBy("tenant", "service").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration_sum_ns").alias("duration_sum_ns"), latency.merged("hist").alias("hist"))
    return rows.select("tenant", "service", "calls", "errors", (F.col("errors") / F.col("calls")).alias("error_rate"), latency.quantile(F.col("hist"), 0.95).alias("p95_ns"))


def overview_incidents(tiles: DataFrame, incidents: DataFrame, *, since_ns: int) -> DataFrame:
    """Tiles of ``overview`` with the active incidents of each service as epicenter, updated since ``since_ns``: their number and
    the highest severity (null without any). A service with incidents but no calls has a tile too."""
    own = incidents.where(F.col("status").between(1, 4) & (F.col("last_ns") >= since_ns)).groupBy("tenant", F.col("epicenter").alias("service")).agg(F.count("*").alias("incidents"), F.max("score").alias("score"))
    return tiles.join(own, ["tenant", "service"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("calls", "errors", "incidents")})


def exemplars_for(spans: DataFrame, *, n: int = 4, time_col: str = "received_ns") -> DataFrame:
    """The latest n spans of each operation."""
    latest = F.row_number().over(Window.partitionBy("tenant", "service", "name").orderBy(F.desc(time_col), "trace_id", "span_id"))
    return spans.withColumn("rank", latest).where(F.col("rank") <= n).select("tenant", "service", "name", "rank", "trace_id", "span_id", time_col)
