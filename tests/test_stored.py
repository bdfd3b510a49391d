"""Tables that grow batch by batch, and blocks under a manifest, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanlake.sources import blocks, stored, versions

ROW = "k string, n long, h array<long>, a long, z long, v string"
RULES = dict(key=["k"], parts=8, add=("n",), add_each={"h": 2}, first=("a",), last=("z",), latest=("v",))


def batches(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [[(f"k{rng.randint(0, 30)}", rng.randint(0, 9), [rng.randint(0, 9), 1], rng.randint(0, 99), rng.randint(0, 99), None) for _ in range(n)] for n in sizes]
    # A value that the last batch wins with is the same in all of a batch's rows of a key.
    rows = [[(*r[:5], f"{r[0]}-{i}") for r in b] for i, b in enumerate(rows)]
    return rows, [spark.createDataFrame(b, ROW) for b in rows]


def wanted(rows):
    out = {}
    for k, n, h, a, z, v in (r for b in rows for r in b):
        o = out.get(k)
        out[k] = (n, h, a, z, v) if o is None else (o[0] + n, [x + y for x, y in zip(o[1], h)], min(o[2], a), max(o[3], z), v)
    return out


def state(table):
    rows = table.read()
    return {} if rows is None else {r.k: (r.n, r.h, r.a, r.z, r.v) for r in rows.collect()}


def test_rules(spark, tmp_path):
    rows, frames = batches(spark, [20, 0, 30, 5, 40])
    table = stored.Table(spark, f"{tmp_path}/t", **RULES)
    assert table.read() is None and table.compact() == []
    for i, frame in enumerate(frames):
        table.add(frame, i)
        table.add(frame, i)  # comes again
        assert state(table) == wanted(rows[: i + 1])
        if i in (1, 3):
            assert table.compact()
            assert state(table) == wanted(rows[: i + 1])
            table.add(frames[0], 0)  # comes again when it is in the base
            assert state(table) == wanted(rows[: i + 1])
    table.vacuum()
    assert state(table) == wanted(rows)
    assert len(versions.complete(spark, f"{tmp_path}/t/manifest", "version")) == 1


def test_only_touched_parts_are_written(spark, tmp_path):
    table = stored.Table(spark, f"{tmp_path}/t", key=["k"], parts=16, add=("n",))
    table.add(spark.range(5000).selectExpr("cast(id as string) as k", "id as n"), 0)
    assert len(table.compact()) == 16
    table.add(spark.createDataFrame([("7", 1)], "k string, n long"), 1)
    size = lambda folder: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    home = versions.place(f"{tmp_path}/t/delta", "batch", 1)
    assert size(home) < size(versions.place(f"{tmp_path}/t/delta", "batch", 0)) / 10
    touched = table.compact()
    assert len(touched) == 1
    assert [n for n in os.listdir(versions.place(f"{tmp_path}/t/base", "version", 2)) if n.startswith("part=")] == [f"part={touched[0]}"]
    assert table.read().where("k = '7'").first()["n"] == 8 and table.read().count() == 5000
    table.vacuum()
    assert table.read().agg(F.sum("n")).first()[0] == 5000 * 4999 // 2 + 1


def test_broken_compaction_changes_nothing(spark, tmp_path):
    rows, frames = batches(spark, [20, 30])
    table = stored.Table(spark, f"{tmp_path}/t", **RULES)
    for i, frame in enumerate(frames):
        table.add(frame, i)
    # The driver was lost after it wrote a part of the base, before the manifest.
    frames[0].withColumn("part", F.lit(3)).write.partitionBy("part").parquet(versions.place(f"{tmp_path}/t/base", "version", 1))
    os.makedirs(versions.place(f"{tmp_path}/t/manifest", "version", 1))
    assert state(table) == wanted(rows)
    assert table.compact()
    assert state(table) == wanted(rows)


def test_ignored_duplicates(spark, tmp_path):
    table = stored.Table(spark, f"{tmp_path}/t", key=["k", "b"], parts=4)
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), (None, 3)], "k string, b long")
    table.add(rows, 0)
    table.compact()
    table.add(rows.unionByName(spark.createDataFrame([("y", 1)], "k string, b long")), 1)
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([("x", 1), ("x", 2), (None, 3), ("y", 1)], key=str)


def test_as_sink(spark, tmp_path):
    rows, frames = batches(spark, [20, 30, 10])
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = stored.Table(spark, f"{tmp_path}/t", key=["k"], parts=4, add=("n",))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.select("k", "n").writeStream.foreachBatch(table.add).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.k: r.n for r in table.read().collect()} == {k: v[0] for k, v in wanted(rows).items()}


SPAN = "tenant string, trace_id string, span_id string, start_ns long, end_ns long"
HOUR = 3600 * 10**9


def spans(spark, start, n, tenant):
    rows = [(tenant, f"{start}-{i}", s, start + i, start + i + 5) for i in range(n) for s in "ab"]
    own = spark.createDataFrame(rows, SPAN)
    return own, own.groupBy("tenant", "trace_id").agg(F.min("start_ns").alias("start_ns")).withColumn("tier", F.lit("sampled"))


@pytest.mark.parametrize("tenant", ["t", "a b%2F=ö"])
def test_blocks(spark, tmp_path, tenant):
    path = f"{tmp_path}/b"
    assert blocks.read(spark, path) is None and blocks.compact(spark, path) == 0
    blocks.expire(spark, path, retention_ns=1, now_ns=1)
    starts = [0, 1000, HOUR, HOUR + 500, HOUR + 1000]
    for start in starts:
        blocks.append(*spans(spark, start, 12, tenant), path)
    ids = lambda: sorted((r.tenant, r.hour, r.trace_id, r.span_id) for r in blocks.read(spark, path).collect())
    every = sorted((tenant, s // HOUR, f"{s}-{i}", x) for s in starts for i in range(12) for x in "ab")
    assert ids() == every
    before = blocks.manifest(spark, path).count()
    assert blocks.compact(spark, path) == before
    assert ids() == every and blocks.manifest(spark, path).count() == 2
    assert blocks.compact(spark, path) == 0
    blocks.expire(spark, path, retention_ns=100, now_ns=HOUR)
    late = [r for r in every if r[1] == 1]
    assert ids() == late
    blocks.vacuum(spark, path)
    assert ids() == late
    # A write that never came to its manifest is not seen.
    own, _ = spans(spark, 5, 3, tenant)
    own.selectExpr("*", "'sampled' as tier", "0 as hour").write.partitionBy(*blocks.BLOCK).parquet(versions.place(f"{path}/files", "write", 99))
    assert ids() == late
    assert blocks.manifest(spark, path).agg(F.sum("spans")).first()[0] == len(late)


def test_bins(spark):
    rng = random.Random(3)
    files = [(f"t{rng.randint(0, 2)}", "sampled", 0, f"f{i}", rng.choice([1, 5, 20, 60, 99, 100, 300])) for i in range(80)] + [("alone", "sampled", 0, "g", 3)]
    got = {r.path: (r.tenant, r.bin) for r in blocks.bins(spark.createDataFrame(files, "tenant string, tier string, hour int, path string, bytes long"), target=100).collect()}
    found, size = {}, {}
    for t, _, _, path, b in sorted(files, key=lambda f: (f[0], f[4], f[3])):
        if b < 100:
            found.setdefault((t, size.get(t, 0) // 100), []).append((path, b))
            size[t] = size.get(t, 0) + b
    assert got == {p: k for k, own in found.items() if len(own) > 1 for p, _ in own}
    assert all(sum(b for _, b in own) < 200 for own in found.values())


def test_files_of_blocks(spark, tmp_path):
    """Many blocks aren't cut into a file for each task; a trace stays in one file, whichever way spans are dealt."""
    from spanlake.sources import files

    rows = spark.range(6000).selectExpr("concat('t', id div 2 % 2) AS tenant", "cast(id div 2 AS string) AS trace_id", "cast(id AS string) AS span_id", f"(id div 2 % 40) * {files.HOUR} AS start_ns")
    kept = rows.groupBy("tenant", "trace_id").agg(F.min("start_ns").alias("start_ns"), F.lit("hot").alias("tier"))
    files.write_blocks(rows, kept, f"{tmp_path}/a")
    files.write_placed(rows.repartition("tenant", "trace_id").withColumns({"tier": F.lit("hot"), "hour": files.hour("start_ns")}), f"{tmp_path}/b")
    for name in ("a", "b"):
        back = spark.read.parquet(f"{tmp_path}/{name}").withColumn("file", F.input_file_name())
        assert back.count() == 6000 and back.groupBy("trace_id").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
        assert back.select("file").distinct().count() <= 40 + spark.sparkContext.defaultParallelism
