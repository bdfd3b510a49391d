"""Detectors over RED windows, their debounce and enrichment, and the grouping of their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
KEY = ["tenant", "service", "name"]


def _one(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def window_groups(red: DataFrame, *, window_ns: int = 90 * SECOND, tick_ns: int = 30 * SECOND) -> DataFrame:
    """Calls and errors of each key in the window before each tick, and the quantiles (and exemplar, if any) of its last bucket.

    A bucket is handed to the ticks whose windows hold it, so one aggregation does all windows.
    """
    first = F.col("bucket_ns") - F.pmod("bucket_ns", F.lit(tick_ns)) + tick_ns
    ticks = F.transform(F.sequence(F.lit(0), F.lit(window_ns // tick_ns - 1)), lambda i: first + i * tick_ns)
    rows = red.withColumn("tick_ns", F.explode(ticks)).where((F.col("bucket_ns") >= F.col("tick_ns") - window_ns) & (F.col("bucket_ns") < F.col("tick_ns")))
    shown = [c for c in ("p95_ns", "p99_ns", "exemplar") if c in red.columns]
    return rows.groupBy(*KEY, "tick_ns").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), *(F.max_by(c, "bucket_ns").alias(c) for c in shown))


def _verdict(kind: str, breach: Column, observed: Column, base: Column, score: Column) -> Column:
    holds = F.coalesce(breach, F.lit(False))
    return F.struct(F.lit(kind).alias("kind"), holds.alias("breach"), observed.cast("double").alias("observed"), base.cast("double").alias("baseline"), F.when(holds, score).alias("score"))


def latency_shift(*, ratio: float = 1.5, delta_ns: float = 50e6, min_calls: int = 20, widen: float = 1.5) -> Column:
    """p95 at least ``ratio`` times its baseline and ``delta_ns`` above it; both wider without an hourly baseline."""
    factor = F.when(F.col("state") == "global", widen).otherwise(1.0)
    base, seen = F.col("base_p95_ns"), F.col("p95_ns")
    delta = seen - base
    breach = (F.col("state") != "cold") & (base > 0) & (seen >= base * ratio * factor) & (delta >= F.lit(delta_ns) * factor) & (F.col("calls") >= min_calls)
    return _verdict("latency_shift", breach, seen, base, _one(0.5 * _one(F.try_divide(seen, base) - 1) + 0.5 * _one(delta / (4 * delta_ns))))


def error_burst(*, delta: float = 0.05, ratio: float = 3.0, min_calls: int = 20) -> Column:
    """Error rate at least ``delta`` above its moving average and ``ratio`` times it."""
    rate, base = F.col("errors") / F.col("calls"), F.col("base_error_rate")
    breach = (F.col("state") != "cold") & (rate - base >= delta) & (rate >= ratio * base) & (F.col("calls") >= min_calls)
    return _verdict("error_burst", breach, rate, base, _one(0.5 * _one((rate - base) / 0.2) + 0.5 * _one(rate)))


def throughput_drop(*, ratio: float = 0.5, min_rps: float = 0.1, window_s: int = 90) -> Column:
    """Calls a second at most ``ratio`` of their moving average."""
    rps, base = F.col("calls") / window_s, F.col("base_rps")
    breach = (F.col("state") != "cold") & (base >= min_rps) & (rps <= ratio * base)
    return _verdict("throughput_drop", breach, rps, base, _one(1 - F.try_divide(rps, base)))


def verdicts(groups: DataFrame, *detectors: Column) -> DataFrame:
    """A row for each window and detector, with a score where it breaches. ``groups`` are windows with a looked-up baseline;
    all detectors are asked in one pass."""
    shown = ["exemplar"] if "exemplar" in groups.columns else []
    return groups.select(*KEY, "tick_ns", "state", *shown, F.inline(F.array(*detectors)))


def silent(groups: DataFrame, baselines: DataFrame) -> DataFrame:
    """``groups`` and, for every tick there is, a window without calls of each key with a baseline that has none in it: an
    outage is seen too. Ticks and keys are few next to spans."""
    ticks = groups.select("tenant", "tick_ns").distinct()
    keys = baselines.where("slot = -1").select(*KEY).distinct()
    none = keys.join(ticks, "tenant").join(groups.select(*KEY, "tick_ns"), [*KEY, "tick_ns"], "left_anti")
    zero = F.lit(0).cast("bigint")
    return groups.unionByName(none.select(*KEY, "tick_ns", zero.alias("calls"), zero.alias("errors"), F.lit(None).cast("bigint").alias("p95_ns"), F.lit(None).cast("bigint").alias("p99_ns")))


def debounced(verdicts: DataFrame, *, ticks: int = 2, runs: DataFrame | None = None) -> DataFrame:
    """Verdicts that fire: every ``ticks``-th breach in a row of a key; a tick without a breach starts anew. ``runs`` (key, kind, run)
    are the breaches in a row just before the first tick, of verdicts that go on from others."""
    order = Window.partitionBy(*KEY, "kind").orderBy("tick_ns")
    island = F.sum((~F.col("breach")).cast("int")).over(order)
    rank = F.row_number().over(Window.partitionBy(*KEY, "kind", "island").orderBy("tick_ns"))
    rows = verdicts.withColumn("island", island).where("breach").withColumn("rank", rank)  # breaches are few
    if runs is not None:
        rows = rows.join(runs, [*KEY, "kind"], "left").withColumn("rank", F.col("rank") + F.when(F.col("island") == 0, F.coalesce("run", F.lit(0))).otherwise(0)).drop("run")
    return rows.where(F.col("rank") % ticks == 0).drop("island", "rank", "breach")


def fired(groups: DataFrame, *detectors: Column, ticks: int = 2) -> DataFrame:
    """``debounced`` ``verdicts`` of ``groups``: each window is sorted once, for all detectors, and only breaches become rows."""
    shown = ["exemplar"] if "exemplar" in groups.columns else []
    order = Window.partitionBy(*KEY).orderBy("tick_ns")
    named = [f"_v{i}" for i in range(len(detectors))]
    rows = groups.select(*KEY, "tick_ns", "state", *shown, *(d.alias(n) for d, n in zip(detectors, named)))
    rows = rows.withColumns({f"_i{n}": F.sum((~F.col(f"{n}.breach")).cast("int")).over(order) for n in named}).where(" or ".join(f"{n}.breach" for n in named))
    rows = rows.select(*KEY, "tick_ns", "state", *shown, F.inline(F.array(*(F.struct(f"{n}.*", F.col(f"_i{n}").alias("island")) for n in named)))).where("breach")
    rank = F.row_number().over(Window.partitionBy(*KEY, "kind", "island").orderBy("tick_ns"))
    return rows.withColumn("rank", rank).where(F.col("rank") % ticks == 0).drop("island", "rank", "breach")


def runs(verdicts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, kind, run): the breaches in a row up to the last tick of each key, going on from ``before``."""
    last = F.max(F.when(~F.col("breach"), F.col("tick_ns")))
    now = verdicts.withColumn("calm", last.over(Window.partitionBy(*KEY, "kind"))).groupBy(*KEY, "kind").agg(F.count_if(F.col("calm").isNull() | (F.col("tick_ns") > F.col("calm"))).alias("run"), F.first("calm").alias("calm"))
    if before is None:
        return now.drop("calm")
    both = now.join(before.withColumnRenamed("run", "old"), [*KEY, "kind"], "full")
    on = F.when(F.col("calm").isNull(), F.coalesce("old", F.lit(0))).otherwise(0)
    return both.select(*KEY, "kind", (F.coalesce("run", F.lit(0)) + on).alias("run"))


def signature() -> Column:
    """A hash of a failed span's service, operation and kind of error, with digits masked."""
    kind = F.coalesce(F.try_element_at("attrs", F.lit("exception.type")), F.try_element_at("attrs", F.lit("error.type")), F.lit(""))
    return F.md5(F.concat_ws("\x01", "service", "name", F.regexp_replace(kind, r"\d+", "#")))


def error_signatures(spans: DataFrame, *, time_col: str = "received_ns") -> DataFrame:
    """Signatures of failed spans, with first and last sighting."""
    return spans.where("is_error").groupBy("tenant", "service", signature().alias("signature")).agg(F.min(time_col).alias("first_ns"), F.max(time_col).alias("last_ns"), F.count("*").alias("samples"))


def new_error_signatures(signatures: DataFrame, *, start_ns: int, end_ns: int, min_samples: int = 5) -> DataFrame:
    """Signatures first seen in a window, with a score that grows with their samples."""
    rows = signatures.where(F.col("first_ns").between(start_ns, end_ns) & (F.col("samples") >= min_samples))
    return rows.select("tenant", "service", "signature", "first_ns", "samples", _one(0.4 + 0.6 * _one(F.col("samples") / 50)).alias("score"))


def topology_changes(new: DataFrame, vanished: DataFrame, edge: DataFrame, *, min_new: int = 5, min_vanished: int = 1000, dedupe_ns: int = 1800 * SECOND) -> DataFrame:
    """Events for new edges (0.5) and for vanished ones (0.6) with enough calls; one for each edge and kind in ``dedupe_ns``."""
    key = ["tenant", "caller", "callee", "protocol"]
    calls = edge.select(*key, "calls")
    a = new.join(calls, key).where(F.col("calls") >= min_new).select(*key, F.lit("new_edge").alias("kind"), "at_ns", F.lit(0.5).alias("score"))
    b = vanished.where(F.col("calls") >= min_vanished).select(*key, F.lit("vanished_edge").alias("kind"), F.col("last_ns").alias("at_ns"), F.lit(0.6).alias("score"))
    before = F.lag("at_ns").over(Window.partitionBy(*key, "kind").orderBy("at_ns"))
    rows = a.unionByName(b).withColumn("before", before)
    return rows.where(F.col("before").isNull() | (F.col("at_ns") - F.col("before") > dedupe_ns)).drop("before").withColumn("service", F.col("callee"))


def deploys_near(events: DataFrame, deploys: DataFrame, *, at: str, within_ns: int = 1800 * SECOND) -> DataFrame:
    """Pairs of an event and a deploy of its service at most ``within_ns`` apart: an equi-join on service and time bucket, the
    events being handed to their neighbouring buckets too."""
    bucket = lambda c: F.floor(c / F.lit(within_ns)).cast("bigint")
    d = deploys.select("tenant", "service", "deploy_id", "at_ns").withColumn("_b", bucket(F.col("at_ns")))
    rows = events.withColumn("_b", F.explode(F.array(*(bucket(F.col(at)) + k for k in (-1, 0, 1)))))
    return rows.join(d, ["tenant", "service", "_b"]).where(F.abs(F.col(at) - F.col("at_ns")) <= within_ns).drop("_b")


def enriched(events: DataFrame, deploys: DataFrame, *, within_ns: int = 1800 * SECOND, window_ns: int = 90 * SECOND, bonus: float = 0.1) -> DataFrame:
    """Events with the deploys near the start of their window; those of latency and errors that have any score ``bonus`` more."""
    rows = events.withColumn("window_start_ns", F.col("tick_ns") - window_ns)
    near = deploys_near(rows.where(F.col("kind").isin("latency_shift", "error_burst")).select(*KEY, "kind", "tick_ns", "window_start_ns"), deploys, at="window_start_ns", within_ns=within_ns)
    found = near.groupBy(*KEY, "kind", "tick_ns").agg(F.array_sort(F.collect_set("deploy_id")).alias("deploys"))
    out = rows.join(found, [*KEY, "kind", "tick_ns"], "left")
    return out.withColumn("score", F.when(F.col("deploys").isNotNull(), _one(F.col("score") + bonus)).otherwise(F.col("score"))).drop("window_start_ns")


def gate(events: DataFrame, *, least: float = 0.55) -> DataFrame:
    return events.where(F.col("score") >= least)


def fingerprints(events: DataFrame) -> DataFrame:
    """Events with a fingerprint of tenant, service, kind and operation."""
    tokens = F.array_sort(F.array(F.concat(F.lit("svc:"), "service"), F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("op:"), "name")))
    return events.withColumn("fingerprint", F.concat(F.lit("fp1:"), F.substring(F.md5(F.concat_ws("\x02", F.col("tenant"), F.array_join(tokens, "\x01"))), 1, 16)))


def deploy_windows(red: DataFrame, deploys: DataFrame, *, before_ns: int = 1800 * SECOND, skip_ns: int = 120 * SECOND) -> DataFrame:
    """Calls and errors of a deployed service in the time before a deploy and in as long a time after it and a pause."""
    span = before_ns + skip_ns
    d = deploys.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at_ns") - before_ns) / F.lit(span)), F.floor((F.col("at_ns") + span) / F.lit(span)))))
    rows = red.withColumn("_b", F.floor(F.col("bucket_ns") / F.lit(span))).join(d, ["tenant", "service", "_b"])
    pre = F.col("bucket_ns").between(F.col("at_ns") - before_ns, F.col("at_ns"))
    post = F.col("bucket_ns").between(F.col("at_ns") + skip_ns, F.col("at_ns") + span)
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    return rows.where(pre | post).groupBy("tenant", "service", "deploy_id").agg(total("calls", pre).alias("calls_before"), total("errors", pre).alias("errors_before"), total("calls", post).alias("calls_after"), total("errors", post).alias("errors_after"))


def deploy_asof(events: DataFrame, deploys: DataFrame, *, at: str) -> DataFrame:
    """Events with the latest deploy of their service at or before ``at``: one ordered pass over the union of both."""
    both = events.withColumn("_t", F.col(at)).withColumn("_d", F.lit(None).cast("string")).withColumn("_own", F.lit(1))
    marks = deploys.select("tenant", "service", F.col("at_ns").alias("_t"), F.col("deploy_id").alias("_d"), F.lit(0).alias("_own"))
    order = Window.partitionBy("tenant", "service").orderBy("_t", "_own", "_d").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.unionByName(marks, allowMissingColumns=True).withColumn("deploy_id", F.last("_d", ignorenulls=True).over(order))
    return rows.where("_own = 1").drop("_t", "_d", "_own")
