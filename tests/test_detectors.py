"""The detectors' queries ask for shifts of 50 ms."""

from spanlake.plans import anomaly, base

NS, MS = base.NS, 1_000_000


def test_small_shifts(spark, monkeypatch):
    """A p95 that rises from 128 to 256 ms is a shift, and fires at its second tick."""
    rows = [("t", "s", "o", NS + k * 30 * base.S, 20, 0, 256 * MS, 256 * MS, "x", "warm", 128 * MS, 128 * MS, 128 * MS, 0.0, 0.2) for k in range(2)]
    names = "tenant string, service string, name string, tick_ns long, calls long, errors long, p95_ns long, p99_ns long, exemplar string, state string, base_p50_ns double, base_p95_ns double, base_p99_ns double, base_error_rate double, base_rps double"
    table = spark.createDataFrame([(*r[:10], *map(float, r[10:])) for r in rows], names)
    monkeypatch.setattr(anomaly, "looked_up", lambda *_: table)
    assert [r.tick_ns for r in base.QUERIES["latency_shift"](spark, "").orderBy("tick_ns").collect()] == [rows[0][3], rows[1][3]]
    assert [(r.kind, r.tick_ns) for r in base.QUERIES["debounce"](spark, "").collect()] == [("latency_shift", rows[1][3])]
    assert ">= 50000000 *" in base.SQL["latency_shift"] and ">= 50000000 *" in base.SQL["debounce"]


def test_fired_sorts_each_window_once(spark):
    """What fires is what the debounced verdicts give, for any order of breaches, and no detector has its own sorted rows."""
    import random

    from spanlake.operators import anomaly as detectors

    rng = random.Random(5)
    rows = [("t", f"s{rng.randrange(3)}", "op", at * 30, rng.choice(["cold", "global", "warm"]), rng.randrange(1, 60), rng.randrange(8), rng.choice([10**7, 10**8, 10**9]), 10**7, 0.01, 0.3) for at in range(300)]
    rows = list({(r[1], r[3]): r for r in rows}.values())
    table = spark.createDataFrame(rows, "tenant string, service string, name string, tick_ns long, state string, calls long, errors long, p95_ns long, base_p95_ns long, base_error_rate double, base_rps double")
    asked = detectors.latency_shift(min_calls=10), detectors.error_burst(min_calls=10), detectors.throughput_drop()
    for ticks in (1, 2, 3):
        want = detectors.debounced(detectors.verdicts(table, *asked), ticks=ticks)
        got = detectors.fired(table, *asked, ticks=ticks)
        assert got.columns == want.columns and want.count() > 5
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_faulted_spans_build_no_attributes(spark):
    from spanlake.plans.anomaly import faulted_spans

    assert "map_from_arrays" not in faulted_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
