"""Streaming forms give the rows of the batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.operators import anomaly, baseline, red, spans
from spanlake.plans import fixtures
from spanlake.sources import files, payloads
from spanlake.streaming import spans as streaming

SF = "/root/testdata/sf0.001"


def _run(spark, df, path, name):
    df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/{name}")


def test_rollup(spark, tmp_path):
    raw = fixtures.raw_spans(spark, SF).drop("tie1", "tie2").dropDuplicates(["tenant", "trace_id", "span_id"])
    raw.write.parquet(f"{tmp_path}/in")
    # One more span far ahead closes all windows; it is in none that is sent.
    later = raw.limit(1).withColumn("received_ns", F.col("received_ns") + 10**14)
    later.write.parquet(f"{tmp_path}/later")
    (tmp_path / "all").mkdir()
    for part in ("in", "later"):
        spark.read.parquet(f"{tmp_path}/{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    out = _run(spark, streaming.rollup(streaming.dedupe(streaming.timed(stream, delay="1 hour"))), tmp_path, "out")
    columns = ["tenant", "service", "name", "bucket_ns", "calls", "errors", "duration_sum_ns", "hist"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(out) == rows(red.rollup(spans.features(raw)))


def test_ndjson(spark, tmp_path):
    (tmp_path / "tenant=a").mkdir()
    (tmp_path / "tenant=a" / "x.ndjson").write_text('{"ts": "2024-01-01T00:00:00Z", "service": "s", "body": "b"}\n\nnot json\n')
    rows = files.read_ndjson(spark, str(tmp_path)).collect()
    assert [(r["tenant"], r["service"], r["body"]) for r in rows] == [("a", "s", "b")]
    assert files.read_ndjson(spark, f"{tmp_path}/none").count() == 0


def test_limits(spark):
    df = spark.createDataFrame([({"a": "x" * 9, "b" * 5: "y", "c": "z"},), ({},), (None,)], "attrs map<string,string>")
    out = payloads.apply_limits(df, attrs=2, key_bytes=4, value_bytes=4).collect()
    assert [(r["attrs"], r["truncated"]) for r in out[:2]] == [({"a": "xxxx"}, True), ({}, False)]
    assert out[0]["dropped_attrs"] == 2


def test_zipkin(spark):
    one = '{"traceId": "00000000000000ab", "id": "0000000000000001", "kind": "CLIENT", "timestamp": 5, "duration": 2, "debug": true}'
    rows = payloads.normalize_zipkin(spark.createDataFrame([("t", one), ("t", f"[{one},{one}]"), ("t", "junk"), ("t", None)], "tenant string, payload string"))
    out = rows.where("trace_id is not null").collect()
    assert len(out) == 3 and out[0]["trace_id"] == "ab".rjust(32, "0") and (out[0]["start_ns"], out[0]["end_ns"], out[0]["flags"], out[0]["kind"]) == (5000, 7000, 1, 3)


def test_blocks(spark, tmp_path):
    rows = spans.dedupe(fixtures.raw_spans(spark, SF), order=("received_ns", "tie1", "tie2"))
    kept = rows.groupBy("tenant", "trace_id").agg(F.min("start_ns").alias("start_ns")).where("trace_id like '%0'").withColumn("tier", F.lit(1))
    files.write_blocks(rows, kept, f"{tmp_path}/blocks")
    found = files.manifest(spark.read.parquet(f"{tmp_path}/blocks")).agg(F.sum("traces"), F.sum("spans")).first()
    assert tuple(found) == (kept.count(), rows.where("trace_id like '%0'").count())


def _feed(spark, rows, path, parts):
    """``rows`` as a stream of files, in the order of arrival, and one row far ahead that closes everything."""
    from pyspark.sql import Window

    dealt = rows.withColumn("part", F.ntile(parts).over(Window.orderBy("received_ns")))
    for k in range(1, parts + 1):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    for jump in (10**14, 2 * 10**14):
        rows.limit(1).withColumns({"received_ns": F.col("received_ns") + jump, "trace_id": F.lit(f"ahead{jump}")}).coalesce(1).write.mode("append").parquet(path)
    return streaming.timed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), delay="0 seconds")


def _own_spans(spark):
    return spans.dedupe(fixtures.raw_spans(spark, SF), order=("received_ns", "tie1", "tie2")).drop("tie1", "tie2").where("trace_id like '%1'")


def test_assemble(spark, tmp_path):
    from spanlake.operators import traces

    rows = _own_spans(spark).select("tenant", "trace_id", "span_id", "received_ns")
    out = _run(spark, streaming.assemble(_feed(spark, rows, f"{tmp_path}/in", 4), idle_ns=200_000_000, hard_ns=400_000_000), tmp_path, "out")
    got = sorted(tuple(r) for r in out.where("trace_id not like 'ahead%'").select("tenant", "trace_id", "first_ns", "last_ns", "span_count").collect())
    batch = traces.assemble(rows, idle_ns=200_000_000, hard_ns=400_000_000).groupBy("tenant", "trace_id", "fragment").agg(F.min("received_ns"), F.max("received_ns"), F.count("*")).drop("fragment")
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 100


def test_edges(spark, tmp_path):
    rows = _own_spans(spark).select("tenant", "trace_id", "span_id", "parent_span_id", "kind", "service", "received_ns")
    out = _run(spark, streaming.edges(_feed(spark, rows, f"{tmp_path}/in", 2)), tmp_path, "out").where("trace_id not like 'ahead%'")
    c = rows.where("kind in (3, 4)").select("tenant", "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("caller"))
    want = rows.where("kind in (2, 5)").join(c, ["tenant", "trace_id", "parent_span_id"], "left").select("tenant", "trace_id", F.coalesce("caller", F.lit("external")).alias("caller"), F.col("service").alias("callee"))
    assert sorted(map(str, out.drop("at").collect())) == sorted(map(str, want.collect()))


def test_edge_changes(spark, tmp_path):
    second = 10**9
    sightings = [("a", "b", t) for t in (0, 5, 8, 300, 301, 900)] + [("b", "c", 2)]
    rows = spark.createDataFrame([("t", x, y, f"{k}", (1_704_067_200 + t) * second) for k, (x, y, t) in enumerate(sightings)], "tenant string, caller string, callee string, trace_id string, received_ns long")
    out = _run(spark, streaming.edge_changes(_feed(spark, rows, f"{tmp_path}/in", 7), quiet_ns=200 * second, vanish_ns=100 * second), tmp_path, "out")
    got = sorted((r.caller, r.kind, r.at_ns // second - 1_704_067_200) for r in out.where(f"at_ns < {(1_704_067_200 + 10_000) * second}").collect())
    assert got == [("a", "new_edge", 0), ("a", "new_edge", 300), ("a", "new_edge", 900), ("a", "vanished_edge", 8), ("a", "vanished_edge", 301), ("a", "vanished_edge", 900), ("b", "new_edge", 2), ("b", "vanished_edge", 2)]


def test_merge(spark, tmp_path):
    """Rollups merged batch by batch are those of all spans."""
    from spanlake.functions import latency

    every = red.rollup(spans.features(_own_spans(spark))).drop("exemplars")
    every.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = streaming.merge_into(f"{tmp_path}/table", key=["tenant", "service", "name"], add=("calls", "errors"), add_each={"hist": 16}, first=("bucket_ns",))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start().awaitTermination()
    got = streaming.merged(spark, f"{tmp_path}/table")
    want = every.groupBy("tenant", "service", "name").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), latency.merged("hist").alias("hist"), F.min("bucket_ns").alias("bucket_ns"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def _red(spark):
    from spanlake.functions import latency

    every = red.rollup(spans.features(_own_spans(spark))).withColumn("q", latency.quantiles(F.col("hist")))
    return every.select("tenant", "service", "name", "bucket_ns", "calls", "errors", *(F.col(f"q.{p}").alias(f"{p}_ns") for p in ("p50", "p95", "p99"))).cache()


def _split(spark, rows, path, cuts, by_time):
    """``rows`` in ``cuts`` files, read one a batch: in order of time, or dealt out; then one far ahead, which closes all windows."""
    part = F.ntile(cuts).over(Window.orderBy("bucket_ns")) if by_time else F.pmod(F.xxhash64("tenant", "service", "bucket_ns"), F.lit(cuts)) + 1
    cut = rows.withColumn("_p", part).cache()
    for k in range(1, cuts + 1):
        cut.where(F.col("_p") == k).drop("_p").coalesce(1).write.mode("append").parquet(path)
    rows.limit(1).withColumns({"bucket_ns": F.col("bucket_ns") + 10**14, "tenant": F.lit("end")}).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return streaming.timed(stream, "bucket_ns", delay="0 seconds" if by_time else "2 hours")


def test_detect(spark, tmp_path):
    """What fires doesn't depend on the batches: three and seven files in order, five files that mix all times."""
    rows = _red(spark)
    base = baseline.build(rows).withColumns({"n": F.lit(500), "rps": F.lit(0.25), "p95_ns": F.lit(2e8)}).cache()
    asked = anomaly.throughput_drop(), anomaly.latency_shift(min_calls=1), anomaly.error_burst(min_calls=1)
    want = anomaly.debounced(anomaly.verdicts(baseline.lookup(anomaly.window_groups(rows), base, at="tick_ns"), *asked))
    plain = lambda df: sorted(map(str, df.select("tenant", "service", "name", "kind", "tick_ns", "state", F.round("score", 9)).collect()))
    want = plain(want)
    assert len(want) > 20 and len({w.split("kind=")[1].split(",")[0] for w in want}) == 3
    for k, (cuts, by_time) in enumerate(((3, True), (7, True), (5, False))):
        stream = streaming.windows(_split(spark, rows, f"{tmp_path}/in{k}", cuts, by_time))
        sink = streaming.detect(base, f"{tmp_path}/out{k}", *asked)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state{k}").trigger(availableNow=True).start().awaitTermination()
        assert plain(spark.read.parquet(f"{tmp_path}/out{k}/events").where("tenant <> 'end'")) == want


def test_baselines(spark, tmp_path):
    """Learnt bucket by bucket, in any order, a baseline is that of the whole table."""
    rows = _red(spark)
    columns = ["tenant", "service", "name", "slot", "p50_ns", "p95_ns", "p99_ns", F.round("error_rate", 9).alias("error_rate"), F.round("rps", 9).alias("rps"), "n", "first_ns"]
    for window in (200, 5):
        want = sorted(map(str, baseline.build(rows, window=window).select(*columns).collect()))
        for k, by_time in enumerate((True, False)):
            path = f"{tmp_path}/{window}-{k}"
            stream = streaming.baselines(_split(spark, rows, f"{path}/in", 4, by_time), window=window)
            sink = lambda batch, number, path=path: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
            stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
            out = spark.read.parquet(f"{path}/out").where("tenant <> 'end'")
            latest = out.groupBy("tenant", "service", "name", "slot").agg(F.max_by(F.struct(*(c for c in out.columns if c.endswith("_ns") or c in ("error_rate", "rps", "n"))), "n").alias("v")).select("tenant", "service", "name", "slot", "v.*")
            assert sorted(map(str, latest.select(*columns).collect())) == want


def test_late_rows(spark, tmp_path):
    rows = _own_spans(spark).select("tenant", "trace_id", "span_id", "received_ns").limit(50).cache()
    path = f"{tmp_path}/in"
    for jump in (10**14, 10**14 + 10**12, 0):
        rows.withColumn("received_ns", F.col("received_ns") + jump).coalesce(1).write.mode("append").parquet(path)
    stream = streaming.timed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), delay="1 second")
    counts = stream.groupBy(F.window("at", "10 seconds"), "tenant").count()
    q = counts.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert streaming.late_rows(q.recentProgress) > 0
