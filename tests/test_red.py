"""RED rollups: stored sketches keep the ranks of quantiles, exemplars are spread."""

from pyspark.sql import functions as F

from spanlake.operators import red


def _spans(spark, n):
    ids = F.md5(F.col("id").cast("string"))
    return spark.range(n).select(F.lit("t").alias("tenant"), F.lit("s").alias("service"), (F.col("id") % 2).cast("string").alias("name"), (F.col("id") * 1_000_000).alias("received_ns"), ids.alias("trace_id"), F.lit(False).alias("is_error"), F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double"), F.lit(1.5)).cast("long").alias("duration_ns"))


def test_sketches(spark):
    """After two merges, the share of durations up to an estimate is within 1 % of what was asked for."""
    rows = _spans(spark, 200_000).cache()
    hour = red.cascade(red.cascade(red.rollup(rows, sketch=red.SKETCH), width_ns=60 * red.SECOND), width_ns=3600 * red.SECOND)
    found = red.sketched_quantiles(hour, by=["tenant", "service", "name"])
    share = lambda c: F.avg((F.col("duration_ns") <= F.col(c)).cast("int")).alias(c)
    for r in rows.join(found, ["tenant", "service", "name"]).groupBy("name").agg(*(share(c) for c in ("p50_ns", "p95_ns", "p99_ns"))).collect():
        assert all(abs(r[c] - p) <= 0.01 for c, p in (("p50_ns", 0.5), ("p95_ns", 0.95), ("p99_ns", 0.99)))
    assert red.sketched_quantiles(red.rollup(rows.limit(0), sketch=64), by=["tenant"]).count() == 0


def test_combined(spark):
    """No window and no shuffle of spans stands before the aggregation; exemplars are the least of their classes."""
    rows = red.rollup(_spans(spark, 40_000))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1
    ids = {}
    for r in _spans(spark, 40_000).select("name", "received_ns", "trace_id").collect():
        own = ids.setdefault((r.name, r.received_ns // (10 * red.SECOND)), {})
        k = ord(r.trace_id[-1]) % 4
        own[k] = min(r.trace_id, own.get(k, r.trace_id))
    assert {(r.name, r.bucket_ns // (10 * red.SECOND)): r.exemplars for r in rows.collect()} == {k: sorted(v.values()) for k, v in ids.items()}


def test_first_exemplars(spark):
    """A bucket with four traces or more has four exemplars, its least ids, and they are limited before the shuffle."""
    rows = spark.createDataFrame([("t", "s", "o", k, f"{k % 6}0") for k in range(60)] + [("t", "s", "p", 5, "70")], "tenant string, service string, name string, received_ns long, trace_id string")
    got = red.first_exemplars(rows)
    assert {r.name: r.exemplars for r in got.collect()} == {"o": ["00", "10", "20", "30"], "p": ["70"]}
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()
