"""Streaming forms of span operators: the same rows as the batch forms, once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import latency
from spanlake.operators import anomaly, baseline, lifecycle


def timed(spans: DataFrame, time_col: str = "received_ns", delay: str = "30 seconds") -> DataFrame:
    """``spans`` with an event time of microseconds and a watermark on it."""
    return spans.withColumn("at", F.timestamp_micros(F.floor(F.col(time_col) / 1000).cast("long"))).withWatermark("at", delay)


def dedupe(spans: DataFrame) -> DataFrame:
    """The first delivery of each span id of a trace; state is kept as long as the watermark's delay."""
    return spans.dropDuplicatesWithinWatermark(["tenant", "trace_id", "span_id"])


def rollup(spans: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Calls, errors, summed duration and histogram by tenant, service, operation and window, each sent once when it is closed."""
    duration = F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0))
    rows = spans.withColumn("_d", duration).groupBy(F.window("at", width).alias("w"), "tenant", "service", "name")
    out = rows.agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") == 2).alias("errors"), F.sum("_d").alias("duration_sum_ns"), latency.hist(F.col("_d")).alias("hist"))
    return out.withColumn("bucket_ns", F.unix_micros("w.start") * 1000).drop("w")


def edges(spans: DataFrame, within: str = "30 seconds") -> DataFrame:
    """(tenant, trace_id, caller, callee, at) of server and consumer spans: the caller is the client or producer span that is
    their parent, at most ``within`` away; without one, ``external``, which is sent once the watermark has passed."""
    callee = spans.where("kind in (2, 5)").select("tenant", "trace_id", F.coalesce("parent_span_id", F.lit("")).alias("up"), F.col("service").alias("callee"), "at")
    caller = spans.where("kind in (3, 4)").select(F.col("tenant").alias("t"), F.col("trace_id").alias("i"), "span_id", F.col("service").alias("caller"), F.col("at").alias("called_at"))
    on = f"tenant = t and trace_id = i and up = span_id and at between called_at - interval {within} and called_at + interval {within}"
    return callee.join(caller, F.expr(on), "left").select("tenant", "trace_id", F.coalesce("caller", F.lit("external")).alias("caller"), "callee", "at")


def _ms(ns: int) -> int:
    return -(-ns // 1_000_000)


def assemble(spans: DataFrame, *, idle_ns: int = 8_000_000_000, hard_ns: int = 30_000_000_000) -> DataFrame:
    """(tenant, trace_id, first_ns, last_ns, span_count) of trace fragments, each sent once: when ``idle_ns`` have passed
    without an arrival, or ``hard_ns`` since its first. A later span of the trace begins a new fragment.

    The state of a trace is four numbers. ``spans`` has a watermark (``timed``); time is that of arrival.
    """
    out = "tenant string, trace_id string, first_ns long, last_ns long, span_count long"

    def step(key, batches, state):
        import pandas as pd

        done, now = [], state.get if state.exists else None
        if state.hasTimedOut:
            done.append((*key, *now))
            state.remove()
        else:
            for at in sorted(t for b in batches for t in b["received_ns"].tolist()):
                if now and at - now[1] < idle_ns and at - now[0] < hard_ns:
                    now = (now[0], max(now[1], at), now[2] + 1)
                else:
                    done += [(*key, *now)] if now else []
                    now = (at, at, 1)
            state.update(now)
            state.setTimeoutTimestamp(max(_ms(min(now[1] + idle_ns, now[0] + hard_ns)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["tenant", "trace_id", "first_ns", "last_ns", "span_count"])

    rows = spans.select("tenant", "trace_id", "received_ns", "at")
    return rows.groupBy("tenant", "trace_id").applyInPandasWithState(step, out, "first_ns long, last_ns long, span_count long", "append", "EventTimeTimeout")


def edge_changes(calls: DataFrame, *, quiet_ns: int = 24 * 3600 * 1_000_000_000, vanish_ns: int = 3600 * 1_000_000_000) -> DataFrame:
    """(tenant, caller, callee, kind, at_ns): a new edge at its first sighting and after ``quiet_ns`` without one, a vanished one
    once ``vanish_ns`` have passed since the last. ``calls``: tenant, caller, callee, received_ns, at, with a watermark. No
    change is dropped; an edge's state is its last sighting and whether it is said to have vanished."""
    out = "tenant string, caller string, callee string, kind string, at_ns long"

    def step(key, batches, state):
        import pandas as pd

        done, (last, gone) = [], state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if not gone:
                done.append((*key, "vanished_edge", last))
                state.update((last, True))
                state.setTimeoutTimestamp(max(_ms(last + quiet_ns) + 1, state.getCurrentWatermarkMs() + 1))
            else:
                state.remove()
        else:
            for at in sorted(t for b in batches for t in b["received_ns"].tolist()):
                if last is not None and not gone and at - last > vanish_ns:  # before the watermark told so
                    done.append((*key, "vanished_edge", last))
                if last is None or at - last > quiet_ns:
                    done.append((*key, "new_edge", at))
                last, gone = at if last is None else max(last, at), False
            state.update((last, False))
            state.setTimeoutTimestamp(max(_ms(last + vanish_ns) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["tenant", "caller", "callee", "kind", "at_ns"])

    rows = calls.select("tenant", "caller", "callee", "received_ns", "at")
    return rows.groupBy("tenant", "caller", "callee").applyInPandasWithState(step, out, "last_ns long, gone boolean", "append", "EventTimeTimeout")


def merge_into(folder: str, **columns):
    """A function for ``foreachBatch``: merges each batch into the table in ``folder`` (``lifecycle.merge`` with ``columns``).

    A version is written for each batch, from the one before; a batch that is repeated after a failure writes its own again.
    ``merged`` reads the latest."""

    def sink(batch: DataFrame, number: int) -> None:
        old = merged(batch.sparkSession, folder, before=number)
        table = lifecycle.merge(old, batch.select(*old.columns), **columns) if old is not None else lifecycle.merge(batch, batch.limit(0), **columns)
        table.write.mode("overwrite").parquet(f"{folder}/version={number:020}")

    return sink


def merged(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The latest version of a merged table, or the latest one before a batch; None without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{folder}/version={numbers[-1]:020}") if numbers else None


def windows(buckets: DataFrame, window: str = "90 seconds", tick: str = "30 seconds") -> DataFrame:
    """``anomaly.window_groups`` of a stream of closed RED buckets (``timed`` by bucket_ns): Spark keeps the open windows from batch to batch and
    sends each once, when the watermark has passed its tick."""
    last = F.max_by(F.struct("p95_ns", "p99_ns"), "bucket_ns")
    rows = buckets.groupBy(F.window("at", window, tick).alias("w"), *anomaly.KEY).agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), last.alias("last"))
    return rows.select(*anomaly.KEY, (F.unix_micros("w.end") * 1000).alias("tick_ns"), "calls", "errors", "last.p95_ns", "last.p99_ns")


def detect(baselines: DataFrame, folder: str, *detectors, ticks: int = 2):
    """A function for ``foreachBatch`` over ``windows``: asks all ``detectors`` of them against a table of baselines and writes what fires to
    ``folder``/events. What fires doesn't depend on how the stream is cut into batches.

    Windows come in order of their ticks, but breaches in a row go on from batch to batch: their number by key and kind is
    a table beside the events, a version for each batch, made from the one before. A batch that is repeated after a failure replaces its own parts.
    """

    def sink(batch: DataFrame, number: int) -> None:
        asked = anomaly.verdicts(baseline.lookup(batch, baselines, at="tick_ns"), *detectors).persist()
        runs = merged(batch.sparkSession, f"{folder}/runs", before=number)
        anomaly.debounced(asked, ticks=ticks, runs=runs).write.mode("overwrite").parquet(f"{folder}/events/batch={number:020}")
        anomaly.runs(asked, runs).write.mode("overwrite").parquet(f"{folder}/runs/version={number:020}")
        asked.unpersist()

    return sink


def baselines(buckets: DataFrame, *, alpha: float = 0.2, window: int = 200, width_s: int = 10) -> DataFrame:
    """``baseline.build`` of a stream of RED buckets: rows of the keys and slots that a batch has changed (mode ``update``), n telling
    which is the latest.

    The state of a slot are the ``window`` latest buckets, whatever the order in which they came, and how often each bucket
    quantile occurred; these are read off histograms, so there are at most 17 values of each.
    """
    quantiles = ("p50_ns", "p95_ns", "p99_ns")
    out = "tenant string, service string, name string, slot int, p50_ns double, p95_ns double, p99_ns double, error_rate double, rps double, n long, first_ns long"

    def median(counts: dict) -> float:
        total, values, upto = sum(counts.values()), sorted((int(v), c) for v, c in counts.items()), 0
        ends = []
        for place in ((total - 1) // 2, total // 2):
            upto = 0
            for value, c in values:
                upto += c
                if upto > place:
                    ends.append(value)
                    break
        return sum(ends) / 2

    def step(key, batches, state):
        import json

        import pandas as pd

        old = json.loads(state.get[0]) if state.exists else {"n": 0, "first": None, "recent": [], **{q: {} for q in quantiles}}
        for b in batches:
            old["n"] += len(b)
            old["first"] = min(x for x in (old["first"], int(b["bucket_ns"].min())) if x is not None)
            both = old["recent"] + [list(map(int, r)) for r in b[["bucket_ns", "calls", "errors"]].itertuples(index=False)]
            old["recent"] = sorted(both, reverse=True)[:window]
            for q in quantiles:
                for value, c in b[q].value_counts().items():
                    old[q][str(int(value))] = old[q].get(str(int(value)), 0) + int(c)
        state.update((json.dumps(old),))
        weights = [alpha * (1 - alpha) ** k for k in range(len(old["recent"]))]
        errors = sum(w * e / c for w, (_, c, e) in zip(weights, old["recent"]))
        rps = sum(w * c / width_s for w, (_, c, _) in zip(weights, old["recent"]))
        yield pd.DataFrame([(*key, *(median(old[q]) for q in quantiles), errors, rps, old["n"], old["first"])], columns=[c.split()[0] for c in out.split(", ")])

    rows = buckets.select(*anomaly.KEY, "bucket_ns", "calls", "errors", *quantiles, F.explode(baseline.slots()).alias("slot"))
    return rows.groupBy(*anomaly.KEY, "slot").applyInPandasWithState(step, out, "seen string", "update", "NoTimeout")


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark and were dropped, over the progress reports of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
