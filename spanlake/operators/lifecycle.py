"""Retention, merging of stored tables, and the states of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86400 * SECOND
#: Horizon of each table (fixed values).
HORIZONS = {"spans": 3 * DAY, "traces": 3 * DAY, "red": 30 * DAY, "edges": 30 * DAY, "anomalous": 30 * DAY, "sampled": 7 * DAY}


def expire(rows: DataFrame, *, time_col: str, before_ns: int, bucket_ns: int = 1) -> DataFrame:
    """``rows`` that aren't older than ``before_ns`` (strictly); with ``bucket_ns``, by the bucket of their time."""
    at = F.col(time_col) if bucket_ns == 1 else F.col(time_col) - F.pmod(F.col(time_col), F.lit(bucket_ns)) + bucket_ns - 1
    return rows.where(at >= before_ns)


def expired_blocks(manifest: DataFrame, *, retention_ns: int, now_ns: int, sealed: str = "sealed_ns") -> DataFrame:
    """Blocks whose seal is ``retention_ns`` ago or longer; they go as wholes."""
    return manifest.where(F.col(sealed) + retention_ns <= now_ns)


def retention_plan(tables: dict[str, tuple[DataFrame, str]], *, now_ns: int, horizons: dict[str, int] | None = None) -> DataFrame:
    """(table, tenant, rows, expired) for ``tables`` (name: rows and their time column): what each table's horizon lets go."""
    horizons, out = horizons or HORIZONS, None
    for name, (rows, at) in sorted(tables.items()):
        own = rows.groupBy("tenant").agg(F.count("*").alias("rows"), F.count_if(F.col(at) < now_ns - horizons[name]).alias("expired")).select(F.lit(name).alias("table"), "tenant", "rows", "expired")
        out = own if out is None else out.unionByName(own)
    return out


def disk_ratio(spark: SparkSession, folder: str, raw_bytes: int) -> float:
    """Bytes of the files in ``folder`` over the bytes that were taken in. Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return (files.agg(F.sum("length")).first()[0] or 0) / raw_bytes


def merge(old: DataFrame, new: DataFrame, *, key: list[str], add: tuple[str, ...] = (), add_each: dict[str, int] | None = None, first: tuple[str, ...] = (), last: tuple[str, ...] = (), latest: tuple[str, ...] = (), version: str = "version") -> DataFrame:
    """A stored table and a batch as one, a row a key: ``add`` columns are added, those of ``add_each`` (arrays of so many
    numbers) number by number, ``first`` keep the least, ``last`` the largest value, ``latest`` come from the row of the
    largest ``version``. With keys only, rows that exist are ignored."""
    rows = old.unionByName(new)
    out = [F.sum(c).alias(c) for c in add]
    out += [F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(c) for c, n in (add_each or {}).items()]
    out += [F.min(c).alias(c) for c in first] + [F.max(c).alias(c) for c in last]
    out += [F.max_by(c, version).alias(c) for c in latest] + ([F.max(version).alias(version)] if latest else [])
    return rows.groupBy(*key).agg(*out) if out else rows.select(*key).distinct()


def pending(traces: DataFrame, manifest: DataFrame, *, before_ns: int) -> DataFrame:
    """Traces that began before ``before_ns`` and are in no block (tenant, trace_id)."""
    return traces.where(F.col("start_ns") < before_ns).join(manifest.select("tenant", "trace_id"), ["tenant", "trace_id"], "left_anti")


def actions(rows: DataFrame, *, tenant: str, incident: int | None = None, states: tuple[str, ...] = ()) -> DataFrame:
    """Actions of a tenant, of an incident and in some states if given."""
    rows = rows.where(F.col("tenant") == tenant)
    rows = rows.where(F.col("incident") == incident) if incident is not None else rows
    return rows.where(F.col("state").isin(*states)) if states else rows


def expire_actions(rows: DataFrame, *, now_ns: int, ttl_ns: int) -> DataFrame:
    """``rows`` with the state expired where a proposal is older than ``ttl_ns`` or an approval is past ``expires_ns``."""
    due = ((F.col("state") == "proposed") & (F.lit(now_ns) - F.col("proposed_ns") > ttl_ns)) | ((F.col("state") == "approved") & (F.col("expires_ns") < now_ns))
    return rows.withColumn("state", F.when(due, "expired").otherwise(F.col("state")))


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant", "state").agg(F.count("*").alias("actions"))


def action_budget(rows: DataFrame) -> DataFrame:
    """Actions of each incident that count against its budget: all but rejected and expired ones."""
    return rows.groupBy("tenant", "incident").agg(F.count_if(~F.col("state").isin("rejected", "expired")).alias("used"))


def scope_predicates(incidents: DataFrame, *, ttl_ns: int = 1800 * SECOND, most: int = 32) -> DataFrame:
    """(tenant, incident, services, expires_ns): the epicenter and the blast radius, each service once, ``most`` at most."""
    own: Column = F.slice(F.array_distinct(F.concat(F.array("epicenter"), "blast_radius")), 1, most)
    return incidents.select("tenant", "incident", own.alias("services"), (F.col("at_ns") + ttl_ns).alias("expires_ns"))


def recurrence_predicates(investigations: DataFrame, *, ttl_ns: int = DAY, least: float = 0.75) -> DataFrame:
    """(tenant, incident, signatures, expires_ns) of concluded investigations: signatures only."""
    rows = investigations.where((F.col("outcome") == "concluded") & (F.col("confidence") >= least))
    return rows.select("tenant", "incident", "signatures", (F.col("at_ns") + ttl_ns).alias("expires_ns"))


def write_edges(edge: DataFrame, folder: str) -> None:
    edge.write.mode("overwrite").parquet(folder)


def load_edges(spark: SparkSession, folder: str, *, most: int = 20_000) -> DataFrame:
    """Stored edges, the hottest of each tenant."""
    from spanlake.operators import graph

    return graph.capped(spark.read.parquet(folder), most=most)


def service_meta(spans: DataFrame, *, keys: tuple[str, ...], time_col: str = "received_ns") -> DataFrame:
    """The latest value of each of ``keys`` among a service's attributes, null where it has none."""
    value = lambda k: F.try_element_at("attrs", F.lit(k))
    return spans.groupBy("tenant", "service").agg(*(F.max_by(value(k), F.when(value(k).isNotNull(), F.struct(time_col, value(k)))).alias(k.replace(".", "_")) for k in keys))


def slo_breaches(red: DataFrame, *, ratio: float, window_ns: int, sustained_ns: int, width_ns: int = 10 * SECOND) -> DataFrame:
    """(tenant, service, start_ns, end_ns): stretches of buckets whose errors over the last ``window_ns`` are over ``ratio`` of
    the calls, at least ``sustained_ns`` long."""
    by = red.groupBy("tenant", "service", "bucket_ns").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    own = Window.partitionBy("tenant", "service").orderBy("bucket_ns")
    over = own.rangeBetween(-window_ns + 1, 0)
    rows = by.withColumn("bad", F.sum("errors").over(over) > F.lit(ratio) * F.sum("calls").over(over))
    rows = rows.withColumn("island", F.sum((~F.col("bad")).cast("int")).over(own)).where("bad")
    found = rows.groupBy("tenant", "service", "island").agg(F.min("bucket_ns").alias("start_ns"), (F.max("bucket_ns") + width_ns).alias("end_ns"))
    return found.where(F.col("end_ns") - F.col("start_ns") >= sustained_ns).drop("island")


def retry_storms(red: DataFrame, retries: DataFrame, *, factor: float = 3.0, share: float = 0.5) -> DataFrame:
    """Services and buckets with over ``factor`` times the mean rate, most of whose spans are retries (tenant, service,
    bucket_ns, retried)."""
    by = red.groupBy("tenant", "service", "bucket_ns").agg(F.sum("calls").alias("calls"))
    rows = by.withColumn("mean", F.avg("calls").over(Window.partitionBy("tenant", "service"))).join(retries, ["tenant", "service", "bucket_ns"])
    return rows.where((F.col("calls") > factor * F.col("mean")) & (F.col("retried") > share * F.col("calls"))).drop("mean")


def page_gate(incidents: DataFrame, *, now_ns: int, wait_ns: int = 300 * SECOND) -> DataFrame:
    """``incidents`` with ``page``: an ended investigation has evidence, or the score has stood for ``wait_ns``, or a service
    level is breached."""
    ended = F.col("ended") & (F.col("evidence") > 0)
    return incidents.withColumn("page", ended | (F.lit(now_ns) - F.col("reached_ns") >= wait_ns) | F.col("breached"))
