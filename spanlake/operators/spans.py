"""Operators on single spans: dedupe, derived columns, limits, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant", "trace_id", "span_id"]


def dedupe(spans: DataFrame, *, order=("received_ns",), whole_traces: bool = False) -> DataFrame:
    """The first delivery of each span id within its tenant and trace.

    ``whole_traces`` deals spans by trace, so that what works on whole traces next needs no shuffle of its own.
    The first has none before it; for a rank, Spark would sort all spans before the shuffle too, though few are delivered twice.
    """
    spans = spans.repartition("tenant", "trace_id") if whole_traces else spans
    before = F.lag(F.lit(True)).over(Window.partitionBy(*KEY).orderBy(*order))
    return spans.withColumn("_before", before).where("_before is null").drop("_before")


def features(spans: DataFrame) -> DataFrame:
    """is_error (status 2 or a non-empty error.type, where there are attributes), duration_ns (never below 0), service ('' if absent), is_root."""
    named = F.coalesce(F.try_element_at("attrs", F.lit("error.type")), F.lit("")) != "" if "attrs" in spans.columns else F.lit(False)
    return spans.withColumns({
        "duration_ns": F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0).cast("bigint")),
        "is_error": (F.col("status_code") == 2) | named,
        "service": F.coalesce("service", F.lit("")),
        "is_root": F.col("parent_span_id").isNull(),
    })


def search(spans: DataFrame, *, tenant: str, attribute: tuple[str, str] | None = None, text: str | None = None, service: str | None = None, operation: str | None = None, start_ns: int | None = None, end_ns: int | None = None, limit: int = 100) -> DataFrame:
    """The latest spans by attribute, else text, else service, else time. The attribute's path ignores the window."""
    rows = spans.where(F.col("tenant") == tenant)
    if attribute:
        rows = rows.where(F.col("attrs")[attribute[0]] == attribute[1])
    else:
        if text is not None:
            rows = rows.where(F.exists(F.map_values("attrs"), lambda v: v.ilike(f"%{text}%")) | F.col("name").ilike(f"%{text}%"))
        elif service is not None:
            rows = rows.where(F.col("service") == service)
            rows = rows.where(F.col("name") == operation) if operation else rows
        rows = rows.where(F.col("start_ns") >= start_ns) if start_ns is not None else rows
        rows = rows.where(F.col("start_ns") <= end_ns) if end_ns is not None else rows
    return rows.orderBy(F.desc("start_ns"), "trace_id", "span_id").limit(limit)


def services_present(spans: DataFrame, *, time_col: str = "received_ns") -> DataFrame:
    """Every named service of a tenant, with its first and last sighting."""
    return spans.where("service <> ''").groupBy("tenant", "service").agg(F.min(time_col).alias("first_ns"), F.max(time_col).alias("last_ns"))


def ingested_bytes(spans: DataFrame, *, per_span: int = 750, time_col: str = "received_ns") -> DataFrame:
    """Bytes by tenant and minute, at a fixed size of a span."""
    minute = (F.floor(F.col(time_col) / F.lit(60_000_000_000)) * 60_000_000_000).cast("bigint")
    return spans.groupBy("tenant", minute.alias("minute_ns")).agg((F.count("*") * per_span).alias("bytes"))


def attribute_dictionary(spans: DataFrame, *, keys=None, time_col: str = "received_ns") -> DataFrame:
    """Distinct attribute values by tenant and key, with first and last sighting and the number of spans."""
    pairs = spans.select("tenant", time_col, F.explode("attrs").alias("key", "value"))
    pairs = pairs.where(F.col("key").isin(*keys)) if keys else pairs
    return pairs.groupBy("tenant", "key", "value").agg(F.min(time_col).alias("first_ns"), F.max(time_col).alias("last_ns"), F.count("*").alias("spans"))


def parent_child(spans: DataFrame) -> DataFrame:
    """Pairs of a parent and its child within a trace."""
    p = spans.select("tenant", "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("parent_service"), F.col("name").alias("parent_name"))
    return spans.join(p, ["tenant", "trace_id", "parent_span_id"]).select("tenant", "trace_id", "parent_span_id", "parent_service", "parent_name", "span_id", "service", "name", "duration_ns")


def families(spans: DataFrame, *carry: str) -> DataFrame:
    """Each span under its own id (``family``) and, as a ``child``, under that of its parent; with the ``parent`` (service, duration_ns and the columns
    ``carry``) whose id that is, null if the trace lacks it, and the children of the same id, service and name (``siblings``). A span id is there once.

    Parents and children meet in one window, not in a join, so that spans dealt by trace need no further shuffle.
    """
    places = F.array(*(F.struct(F.col(c).alias("family"), F.lit(child).alias("child")) for c, child in (("span_id", False), ("parent_span_id", True))))
    rows = spans.select("*", F.inline(places)).where("family is not null")
    key, own = ["tenant", "trace_id", "family"], F.when(~F.col("child"), F.struct("service", "duration_ns", *carry))
    rows = rows.withColumn("siblings", F.count_if("child").over(Window.partitionBy(*key, "service", "name")))
    return rows.withColumn("parent", F.max(own).over(Window.partitionBy(*key)))


def once(families: DataFrame) -> DataFrame:
    """Of ``families``, each span once: as a child if it names a parent."""
    return families.where(F.col("child") | F.col("parent_span_id").isNull())


def orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which their trace lacks."""
    p = spans.select("tenant", "trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.where("parent_span_id is not null").join(p, ["tenant", "trace_id", "parent_span_id"], "left_anti")
