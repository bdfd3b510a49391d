"""Incident grouping against a brute-force search over all pairs."""

import random

from pyspark.sql import functions as F

from spanlake.operators import incidents


def brute(events, near, same_ns, near_ns):
    root = {e[0]: e[0] for e in events}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in events:
        for b in events:
            if a[1] != b[1] or a[0] == b[0]:
                continue
            gap = abs(a[4] - b[4])
            linked = a[3] == b[3] and gap <= same_ns
            linked |= gap <= near_ns and (a[2] == b[2] or (a[1], a[2], b[2]) in near)
            if linked:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {e[0]: find(e[0]) for e in events}


def test_group(spark):
    r = random.Random(7)
    events = []
    for k in range(150):
        tenant, service = f"t{r.randrange(2)}", f"s{r.randrange(5)}"
        events.append((f"e{k:03}", tenant, service, f"{service}-{r.randrange(2)}", r.randrange(0, 20_000) // 10 * 10))
    near = {(f"t{t}", a, b) for t in range(2) for a, b in (("s0", "s1"), ("s1", "s0"), ("s2", "s3"), ("s3", "s2"))}
    table = spark.createDataFrame(events, "event_id string, tenant string, service string, fingerprint string, at_ns long")
    hops = spark.createDataFrame(sorted(near), "tenant string, service string, other string")
    got = {x.event_id: x.incident for x in incidents.group(table, hops, same_ns=300, near_ns=60).collect()}
    assert got == brute(events, near, 300, 60) and len(set(got.values())) > 20
    assert incidents.group(table.limit(0), hops).count() == 0


EVENT = "event_id string, tenant string, service string, fingerprint string, at_ns long, score double, provisional boolean"
MINUTE = 60 * incidents.SECOND


def assigned(spark, events, hops=(), **options):
    """``events`` (service, kind, score, minute) in order, as letters of the incident that each goes to."""
    rows = [(f"e{k:02}", "t", s, f"{s}-{kind}", int(at * MINUTE), score, False) for k, (s, kind, score, at) in enumerate(events)]
    near = spark.createDataFrame([("t", a, b) for a, b in hops], "tenant string, service string, other string")
    closings = options.pop("closed", None)
    if closings:
        options["closings"] = spark.createDataFrame([("t", i, int(at * MINUTE)) for i, at in closings], "tenant string, incident string, at_ns long")
    out = incidents.assign(spark.createDataFrame(rows, EVENT), near, **options).orderBy("at_ns", "event_id").collect()
    return [r.incident for r in out], [r.suppressed for r in out], [r.expired for r in out], [r.opened for r in out]


BOTH = (("A", "B"), ("B", "A"))


def test_assign(spark):
    near = assigned(spark, [("A", 1, 0.8, 0), ("B", 2, 0.7, 1)], BOTH)
    assert near[0] == ["e00", "e00"] and near[1] == [False, False] and near[3] == [True, False]
    assert assigned(spark, [("A", 1, 0.8, 0), ("D", 2, 0.7, 1)], BOTH)[0] == ["e00", "e01"]  # out of hops
    assert assigned(spark, [("A", 1, 0.8, 0), ("B", 2, 0.7, 5)], BOTH)[0] == ["e00", "e00"]
    assert assigned(spark, [("A", 1, 0.8, 0), ("B", 2, 0.7, 5.1)], BOTH)[0] == ["e00", "e01"]  # out of the window
    assert assigned(spark, [("A", 1, 0.8, 0), ("A", 1, 0.9, 500)])[:2] == (["e00", "e00"], [False, True])  # an open one keeps its fingerprint
    closed = [("e00", 0)]
    assert assigned(spark, [("A", 1, 0.8, 0), ("A", 1, 0.9, 30)], closed=closed)[:2] == (["e00", "e00"], [False, True])
    assert assigned(spark, [("A", 1, 0.8, 0), ("A", 1, 0.9, 31)], closed=closed)[0] == ["e00", "e01"]
    assert assigned(spark, [("A", 1, 0.8, 0), ("A", 2, 0.9, 1)], closed=closed)[0] == ["e00", "e01"]  # a closed one takes no other fingerprint
    assert assigned(spark, [("A", 1, 0.56, 0), ("B", 1, 0.7, 0), ("C", 1, 0.9, 0)], most=2)[2] == [None, None, "e00"]
    assert assigned(spark, [("B", 1, 0.56, 0), ("A", 1, 0.56, 0), ("C", 1, 0.4, 0)], most=2)[2] == [None, None, "e02"]
    # a chain A - B - C - D of one hop: B's event links what comes after it, not A's incident to D
    chain = [(x, y) for a, b in ("AB", "BC", "CD") for x, y in ((a, b), (b, a))]
    assert assigned(spark, [("A", 1, 0.8, 0), ("D", 1, 0.8, 1), ("B", 1, 0.8, 2), ("C", 1, 0.8, 3)], chain)[0] == ["e00", "e01", "e00", "e01"]
    star = [(x, y) for s in "123" for x, y in (("H", s), (s, "H"))]
    assert len(set(assigned(spark, [("H", 1, 0.8, 0), ("1", 1, 0.7, 1), ("2", 1, 0.7, 2), ("3", 1, 0.7, 3)], star)[0])) == 1
    assert assigned(spark, [])[0] == []


def replayed(events, near, window, dedupe, most):
    """The same, an incident a time, with plain lists."""
    found, went, out = [], {}, {}
    for e, tenant, service, fp, at, score, prov in sorted(events, key=lambda e: (e[4], e[0])):
        hit = went.get((tenant, fp))
        if not (hit and (hit["closed"] is None or at - hit["closed"] <= dedupe)):
            reach = [(i["places"].index(service), k) for k, i in enumerate(found) if i["tenant"] == tenant and i["closed"] is None and service in i["places"] and at - i["at"] <= window]
            hit = min((found[k] for _, k in reach), key=lambda i: i["since"][service]) if reach else None
            if hit is None:
                hit = {"id": e, "tenant": tenant, "closed": None, "places": [], "since": {}, "best": {}, "prov": False}
                found.append(hit)
                fresh = True
            else:
                fresh = False
            went[tenant, fp] = hit
        else:
            fresh = False
        if service not in hit["best"] and hit["closed"] is None:
            for s in [service, *sorted(b for t, a, b in near if (t, a) == (tenant, service))]:
                if s not in hit["places"]:
                    hit["places"].append(s)
                    hit["since"][s] = len(out), len(hit["places"])
        hit["best"][service] = max(score, hit["best"].get(service, 0))
        hit["prov"] |= prov
        hit["at"] = at
        out[e] = hit["id"]
        still = [i for i in found if i["tenant"] == tenant and i["closed"] is None]
        if fresh and most and len(still) > most:
            value = lambda i: (lambda raw: min(raw, 0.69) if i["prov"] else raw)(min(1.0, max(i["best"].values()) * (1 + 0.05 * (len(i["best"]) - 1))))
            min(still, key=value)["closed"] = at
    return out


def test_assign_many(spark):
    r = random.Random(11)
    events = [(f"e{k:03}", f"t{r.randrange(2)}", s := f"s{r.randrange(9)}", f"{s}-{r.randrange(3)}", r.randrange(0, 90_000), round(r.random(), 3), r.random() < 0.1) for k in range(400)]
    near = {(f"t{t}", x, y) for t in range(2) for a, b in (("s0", "s1"), ("s1", "s2"), ("s3", "s4"), ("s5", "s6")) for x, y in ((a, b), (b, a))}
    table = spark.createDataFrame(events, EVENT)
    hops = spark.createDataFrame(sorted(near), "tenant string, service string, other string")
    for most in (None, 4):
        got = {x.event_id: x.incident for x in incidents.assign(table, hops, window_ns=300, dedupe_ns=2000, most=most).collect()}
        assert got == replayed(events, near, 300, 2000, most) and len(set(got.values())) > 20
        if most is None:
            apart = table.join(incidents.areas(hops), ["tenant", "service"], "left").fillna({"area": ""}).withColumn("area", F.when(F.col("area") == "", F.col("service")).otherwise(F.col("area")))
            again = incidents.assign(apart, hops, window_ns=300, dedupe_ns=2000, most=None, by=("tenant", "area"))
            assert {x.event_id: x.incident for x in again.collect()} == got
    table = incidents.summarize(incidents.assign(table, hops, window_ns=300, dedupe_ns=2000), hops, latest=2).collect()
    assert all(x.score <= 0.69 for x in table if x.provisional) and all(len(x.event_ids) == min(2, x.events) for x in table)


def test_timeout_mismatches(spark):
    from spanlake.operators import incidents

    slow = [0] * 16
    slow[9] = 100  # half a second
    red = spark.createDataFrame([("t", "db", slow), ("t", "idle", [0] * 16)], "tenant string, service string, hist array<long>")
    rows = [("t", "2", "a", "op", "db", 100_000_000, True), ("t", "1", "a", "op", "db", 100_000_000, True), ("t", "3", "a", "op", "db", 100_000_000, False), ("t", "4", "a", "op", "db", 9_000_000_000, True), ("t", "5", "a", "op", None, 1, True), ("t", "6", "a", "op", "db", None, True), ("t", "7", "a", "op", "idle", 1, True), ("u", "8", "a", "op", "db", 1, True)]
    clients = spark.createDataFrame(rows, "tenant string, trace_id string, service string, name string, callee string, timeout_ns long, exceeded boolean")
    got = [(r.callee, r.timeout_ns, r.calls, r.trace_id) for r in incidents.timeout_mismatches(clients, red).collect()]
    assert got == [("db", 100_000_000, 2, "1")]


def test_group_over_blocks(spark):
    """Components that reach over many blocks of time are found whole, in rounds that grow with the logarithm of their number."""
    events = [(f"e{(k * 37) % 600:03}", f"t{k % 2}", f"s{k % 3}", f"f{k % 6}", 50 * k + (2000 if k > 400 else 0)) for k in range(600)]
    near = {(t, a, b) for t in ("t0", "t1") for a, b in (("s0", "s1"), ("s1", "s0"))}
    table = spark.createDataFrame(events, "event_id string, tenant string, service string, fingerprint string, at_ns long")
    hops = spark.createDataFrame(sorted(near), "tenant string, service string, other string")
    kept, calls = incidents.cut, []
    incidents.cut = lambda df: calls.append(1) or kept(df)
    try:
        got = {x.event_id: x.incident for x in incidents.group(table, hops, same_ns=320, near_ns=100, block_ns=400, widen=8).collect()}
    finally:
        incidents.cut = kept
    assert got == brute(events, near, 320, 100) and len(set(got.values())) > 2
    assert len(calls) <= 11  # two inputs, the links, and two for each of four rounds at most


def test_series_without_exemplars(spark):
    """Where no exemplar is shown, the rollup, its quantiles and windows need no sort, and spans are dealt once before the dedupe."""
    from spanlake.functions import latency
    from spanlake.operators import anomaly, graph, red, spans

    r = random.Random(2)
    rows = [("t", f"{k:04}", f"{i}", f"s{r.randrange(3)}", "op", 10**9 * k, int(10 ** r.uniform(3, 11)), r.random() < 0.2) for k in range(120) for i in range(3)]
    table = spark.createDataFrame(rows, "tenant string, trace_id string, span_id string, service string, name string, received_ns long, duration_ns long, is_error boolean")
    plain = red.rollup(table, exemplars=0)
    assert "exemplars" not in plain.columns
    series = latency.with_quantiles(plain)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan(anomaly.window_groups(series)) and "WindowGroupLimit" not in plan(spans.dedupe(table))
    q = latency.quantiles(F.col("hist"))
    every = [x for x in series.withColumn("q", q).collect()]
    assert every and all((x.p50_ns, x.p95_ns, x.p99_ns) == (x.q.p50, x.q.p95, x.q.p99) for x in every)
    empty = spark.createDataFrame([([0] * 16,)], "hist array<long>")
    assert latency.with_quantiles(empty).first()[1:] == (0, 0, 0)
    calls = [("t", "1", "c", None, "a", "op", 3, 5, 10, 1, {}), ("t", "1", "s1", "c", "b", "op", 2, 20, 9, 1, {}), ("t", "1", "s2", "c", "b", "op", 2, 20, 9, 2, {}), ("t", "1", "s3", None, "b", "op", 2, 20, 9, 1, {}), ("t", "1", "p", "c", "a", "op", 3, 7, 9, 1, {"peer.service": "z"}), ("t", "1", "s4", "p", "b", "op", 2, 8, 9, 1, {})]
    own = spark.createDataFrame(calls, "tenant string, trace_id string, span_id string, parent_span_id string, service string, name string, kind int, received_ns long, duration_ns long, status_code int, attrs map<string, string>")
    got = {(x.span_id, x.caller, x.callee, x.failed) for x in graph.calls(own, within_ns=100).collect()}
    assert got == {("s1", "a", "b", False), ("s2", "external", "b", True), ("s3", "external", "b", False), ("p", "a", "z", False), ("s4", "external", "b", False)}
    assert plan(graph.calls(own.repartition("tenant", "trace_id"))).count("Scan") == 1 and "Join" not in plan(graph.calls(own))


def test_faulted_spans_shuffle_no_attributes(spark):
    from spanlake.operators import red
    from spanlake.plans.anomaly import faulted_spans

    plan = red.rollup(faulted_spans(spark, "/root/testdata/sf0.001"), exemplars=0)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "attrs#" not in plan


def test_series_are_counted_before_slots(spark):
    """Baselines hand counts of an hour to its slots, not every bucket, and sort few; verdicts that don't breach and deploys aren't
    sorted or multiplied. Values are those of the definition, over days and with fewer and more buckets than the window."""
    from spanlake.operators import anomaly, baseline

    r, hour = random.Random(3), 3600 * 10**9
    rows = [("t", "s", f"op{k}", 40 * 24 * hour + h * hour + b * 10 * 10**9, r.randrange(1, 9), r.randrange(2), *sorted(10**6 << r.randrange(6) for _ in range(3))) for k in range(2) for h in (0, 1, 5, 24, 25, 49, 7 * 24, 9 * 24) for b in sorted(r.sample(range(360), 9))]
    rows = [(*x[:5], min(x[5], x[4]), *x[6:]) for x in rows]
    table = spark.createDataFrame(rows, "tenant string, service string, name string, bucket_ns long, calls long, errors long, p50_ns long, p95_ns long, p99_ns long")
    for window in (5, 12, 200):
        slots = {}
        for x in rows:
            for slot in (-1, x[3] // hour % 24, (x[3] // hour // 24 + 3) % 7 + 24):
                slots.setdefault((x[2], slot), []).append(x)
        got = {(x.name, x.slot): x for x in baseline.build(table, window=window).collect()}
        assert got.keys() == slots.keys()
        for key, own in slots.items():
            own.sort(key=lambda x: -x[3])
            for i, c in enumerate(("p50_ns", "p95_ns", "p99_ns")):
                ordered = sorted(x[6 + i] for x in own)
                assert got[key][c] == (ordered[(len(own) - 1) // 2] + ordered[len(own) // 2]) / 2
            latest = list(enumerate(own[:window]))
            assert abs(got[key].error_rate - sum(0.2 * 0.8**k * x[5] / x[4] for k, x in latest)) < 1e-12
            assert abs(got[key].rps - sum(0.2 * 0.8**k * x[4] / 10 for k, x in latest)) < 1e-12
            assert (got[key].n, got[key].first_ns) == (len(own), own[-1][3])
    plan = lambda df: [x.strip(" :+-*") for x in df._jdf.queryExecution().sparkPlan().toString().splitlines()]
    lines = plan(baseline.build(table))
    handed = [lines[i + 1] for i, x in enumerate(lines) if x.startswith("Generate")]
    assert handed and all(x.startswith("HashAggregate") for x in handed)
    lines = plan(anomaly.debounced(spark.createDataFrame([], "tenant string, service string, name string, kind string, tick_ns long, breach boolean")))
    inner = [i for i, x in enumerate(lines) if x.startswith("Window")]
    assert len(inner) == 2 and any(x.startswith("Filter") and "breach" in x for x in lines[inner[0] : inner[1]])
    deploys = spark.createDataFrame([("t", "s", "d1", 100), ("t", "s", "d2", 300), ("t", "u", "d3", 100)], "tenant string, service string, deploy_id string, at_ns long")
    events = spark.createDataFrame([("t", "s", 199), ("t", "s", 200), ("t", "s", 401)], "tenant string, service string, ns long")
    near = anomaly.deploys_near(events, deploys, at="ns", within_ns=100)
    assert sorted((x.ns, x.deploy_id) for x in near.collect()) == [(199, "d1"), (200, "d1"), (200, "d2")]


def test_queries_take_areas_apart(spark):
    """The queries' events are assigned area by area, so that a tenant isn't one task, with the incidents of whole tenants."""
    import random

    from spanlake.plans import incidents as plans

    rng = random.Random(3)
    rows = [(f"e{k:04}", f"t{rng.randrange(2)}", f"s{(s := rng.randrange(8))}", f"f{s}-{rng.randrange(4)}", rng.randrange(400) * 10**10, rng.random(), rng.random() < 0.2) for k in range(600)]
    table = spark.createDataFrame(rows, EVENT)
    hops = spark.createDataFrame([(t, a, b) for t in ("t0", "t1") for a, b in (("s0", "s1"), ("s1", "s0"), ("s2", "s3"), ("s3", "s2"), ("s0", "s0"))], "tenant string, service string, other string")
    got, want = plans.assigned(table, hops), incidents.assign(table, hops, most=None)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = plans.assigned(table, hops)._jdf.queryExecution().optimizedPlan().toString()
    assert "area" in next(line for line in plan.split("\n") if "RepartitionByExpression" in line)


def test_evidence_of_traces_in_one_pass(spark):
    """Three rules and the calls come from one pass over spans dealt by trace, without joins, as by the rules one by one; conclude reads traces once."""
    from spanlake.operators import anomaly, graph, spans
    from spanlake.plans import fixtures
    from spanlake.plans import incidents as plans

    r = random.Random(5)
    rows = [("t", f"{k // 3:03}", f"{i}", f"{p}" if (p := r.choice([None, 0, 1, 2, 9, i])) is not None else None, f"s{r.randrange(4)}", f"op{r.randrange(2)}", r.choice([0, 1, 80, 100, 125, 1000]), 10 * k + i, r.random() < 0.1) for k in range(90) for i in range(8) if k % 3 == i % 3]
    table = spark.createDataFrame(rows, "tenant string, trace_id string, span_id string, parent_span_id string, service string, name string, duration_ns long, received_ns long, is_error boolean")
    kind = F.abs(F.xxhash64("trace_id", "span_id")) % 6
    attrs = F.when(F.xxhash64("span_id", "trace_id") % 3 == 0, F.create_map(F.lit("peer.service"), F.lit("s1"))).otherwise(F.create_map(F.lit("http.method"), F.lit("GET")))
    table = table.withColumns({"kind": kind, "attrs": attrs, "status_code": F.when(F.col("is_error"), 2).otherwise(1)}).withColumn("signature", F.when(F.col("is_error"), anomaly.signature()))
    own = lambda rows: spans.once(graph.family_calls(spans.families(graph.prepared(rows), "received_ns", "kind", "_peer", "_protocol"), within_ns=3))
    got = {(x.rule, x.service, x.signature): (x.confidence, x.first_ns) for x in incidents.from_traces(incidents.counted_traces(own(table)), threshold=2).collect()}
    pairs = spans.parent_child(table)
    totals = table.select("tenant", "trace_id", F.col("span_id").alias("parent_span_id"), F.col("duration_ns").alias("total_ns"))
    want = {("downstream_latency", x.parent_service, None): (0.8, None) for x in incidents.downstream_latency(pairs, totals).collect()}
    want |= {("n_plus_one", x.service, None): (x.c, None) for x in incidents.repeated_siblings(pairs, threshold=2).groupBy("service").agg(F.max("confidence").alias("c")).collect()}
    want |= {("error", x.service, x.signature): (None, x.first_ns) for x in anomaly.error_signatures(table).collect()}
    assert got == want and {k[0] for k in got} == {"downstream_latency", "n_plus_one", "error"}
    edge = lambda rows: sorted(map(str, rows.select("trace_id", "span_id", "caller", "callee", "protocol").collect()))
    calls = edge(graph.calls(table, within_ns=3))
    assert calls == edge(own(table).where("caller is not null")) and len({x.split("caller=")[1] for x in calls}) > 8
    plan = incidents.counted_traces(own(table.repartition("tenant", "trace_id")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2  # the dealing, and the result

    kept, read = fixtures.raw_spans, []
    fixtures.raw_spans = lambda *a, **k: read.append(k.get("attrs", True)) or kept(*a, **k)
    try:
        plans.conclude(spark, "/root/testdata/sf0.001")
    finally:
        fixtures.raw_spans = kept
    assert len(read) == 2 and read.count(True) == 1  # traces, series


def test_deploy_errors_leave_deploys_as_they_are(spark):
    signatures = spark.createDataFrame([("t", "s", "x", 199), ("t", "s", "y", 200), ("t", "s", "z", 301), ("t", "u", "x", 100)], "tenant string, service string, signature string, first_ns long")
    deploys = spark.createDataFrame([("t", "s", "d1", 99), ("t", "s", "d2", 200), ("t", "u", "d3", 100), ("t", "s", "d4", 201)], "tenant string, service string, deploy_id string, at_ns long")
    found = incidents.deploy_errors(signatures, deploys, within_ns=100)
    assert sorted((x.signature, x.deploy_id, x.after_ns) for x in found.collect()) == [("x", "d1", 100), ("z", "d4", 100)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Generate" not in plan


def test_epicenter_keeps_all_edges(spark):
    """Hops of the query go over every edge between services, in code and SQL; those of the others over the busiest."""
    from spanlake.plans import incidents as plans
    from spanlake.plans import registry

    chain = [("t", f"s{k}", f"s{k + 1}", "http", 100 - k, 0, 0) for k in range(7)] + [("t", "external", "s0", "unknown", 900, 0, 0), ("t", "s0", "db:pg", "db", 900, 0, 0)]
    edge = spark.createDataFrame(chain, "tenant string, caller string, callee string, protocol string, calls long, first_ns long, last_ns long")
    kept, asked, near = plans.base_edges, [], plans.near
    plans.base_edges = lambda *a: edge
    try:
        got = {(x.service, x.other) for x in near(spark, "", None).collect()}
        few = {(x.service, x.other) for x in near(spark, "").collect()}
    finally:
        plans.base_edges = kept
    assert got == {(f"s{a}", f"s{b}") for a in range(8) for b in range(8) if abs(a - b) <= 2}
    assert few == {(f"s{a}", f"s{b}") for a in range(5) for b in range(5) if abs(a - b) <= 2}
    plans.near = lambda *a: asked.append(a[2]) or near(*a)
    try:
        plans.epicenter(spark, "/root/testdata/sf0.001")
    finally:
        plans.near = near
    assert asked == [None] and f"protocol) <= {plans.STRONG}" not in registry.SQL["epicenter"]


def test_assign_reads_few_in_order(spark):
    """Without a cap, only the first events of fingerprints, and the last ones before these, are read in order, also where a tenant is one area."""
    r = random.Random(17)
    rows = [(f"e{k:05}", f"t{r.randrange(2)}", s := f"s{r.randrange(6)}", f"{s}-{r.randrange(3)}" if r.random() < 0.99 else f"x{k % 3}", 1000 * r.randrange(0, k // 40 + 1) * 40, r.random(), False) for k in range(4000)]
    table = spark.createDataFrame(rows, EVENT)
    hops = spark.createDataFrame([(t, a, b) for t in ("t0", "t1") for a, b in (("s0", "s1"), ("s1", "s0"), ("s1", "s2"), ("s2", "s1"))], "tenant string, service string, other string")
    read, kept = [], incidents._walked
    incidents._walked = lambda rows, *a: read.append(rows) or kept(rows, *a)
    try:
        got = incidents.assign(table, hops, window_ns=30_000, most=None)
    finally:
        incidents._walked = kept
    want = incidents._walked(table, hops, 30_000, 0, None, ("tenant",))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len({x.incident for x in got.collect()}) > 2
    kinds = table.select("tenant", "fingerprint", "service").distinct().count()
    assert len(read) == 1 and kinds <= read[0].count() <= kinds * (kinds + 4) // 4 < 1200
