"""Hash chains over audit events, and scores of root-cause results."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _link(before: Column) -> Column:
    """SHA-256 over the hash before, seq, tenant, actor, action, payload and time; the numbers as 8 bytes, the highest first."""
    number = lambda c: F.unhex(F.lpad(F.hex(F.col(c)), 16, "0"))
    text = lambda c: F.col(c).cast("binary")
    return F.sha2(F.concat(F.unhex(before), number("seq"), text("tenant"), text("actor"), text("action"), text("payload"), number("at_ns")), 256)


def chained(events: DataFrame) -> DataFrame:
    """``events`` (tenant, seq, actor, action, payload, at_ns) with ``hash``, each over the one before it; the first over nothing.

    A chain can only be made in order: a tenant's events are sorted and read once, none is held.
    """

    def chain(batches):
        import pyarrow as pa

        tenant, last = None, b""
        for batch in batches:
            out = []
            for t, seq, actor, action, payload, at in zip(*(batch.column(c).to_pylist() for c in ("tenant", "seq", "actor", "action", "payload", "at_ns"))):
                if t != tenant:
                    tenant, last = t, b""
                body = last + seq.to_bytes(8, "big") + t.encode() + actor.encode() + action.encode() + payload.encode() + at.to_bytes(8, "big")
                last = hashlib.sha256(body).digest()
                out.append(last.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", hash string"
    return events.repartition("tenant").sortWithinPartitions("tenant", "seq").mapInArrow(chain, fields)


def verified(events: DataFrame, *, block: int = 65_536) -> DataFrame:
    """(tenant, events, broken_seq): the first event of each tenant whose hash isn't that of its chain, or null.

    Each event needs the stored hash before it only. A tenant is read in blocks of ``block`` numbers, so all its tasks take part; the first event of a
    block gets its hash from the last ones of all blocks, a row each. Numbers are unique in a tenant.
    """
    own = Window.partitionBy("tenant", "_block").orderBy("seq")
    rows = events.withColumn("_block", F.floor(F.col("seq") / F.lit(block)))
    last = rows.groupBy("tenant", "_block").agg(F.max_by("hash", "seq").alias("hash"))
    ends = last.select("tenant", "_block", F.lag("hash").over(Window.partitionBy("tenant").orderBy("_block")).alias("_end"))
    rows = rows.withColumns({"_before": F.lag("hash").over(own), "_first": F.row_number().over(own) == 1}).join(ends, ["tenant", "_block"])
    before = F.coalesce(F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_before")), F.lit(""))
    return rows.groupBy("tenant").agg(F.count("*").alias("events"), F.min(F.when(~_link(before).eqNullSafe(F.col("hash")), F.col("seq"))).alias("broken_seq"))


def anchors(events: DataFrame) -> DataFrame:
    """The last seq of each tenant, and its hash."""
    return events.groupBy("tenant").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def matched(hypotheses: DataFrame, expectations: DataFrame) -> DataFrame:
    """Hypotheses (scenario, category, component, score, seq) with ``exact`` and ``same_category`` against the scenario's
    expected category and component."""
    want = expectations.select("scenario", F.col("category").alias("want_category"), F.col("component").alias("want_component"))
    same = F.col("category") == F.col("want_category")
    return hypotheses.join(want, "scenario").withColumns({"same_category": same, "exact": same & (F.col("component") == F.col("want_component"))}).drop("want_category", "want_component")


def root_cause_scores(hypotheses: DataFrame, expectations: DataFrame) -> DataFrame:
    """(scenario, top1, top3, partial): whether the best, or one of the best three, is right; partial is 1 if the best is, 0.5
    if one of three has the category, else 0. Equal scores keep the order of seq; scenarios without hypotheses score 0."""
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("score"), "seq"))
    best = matched(hypotheses.withColumn("rank", rank).where(F.col("rank") <= 3), expectations)
    own = best.groupBy("scenario").agg(F.max(F.col("exact") & (F.col("rank") == 1)).alias("top1"), F.max("exact").alias("top3"), F.max("same_category").alias("near"))
    none = F.lit(False)
    rows = expectations.select("scenario").join(own, "scenario", "left").select("scenario", *(F.coalesce(c, none).alias(c) for c in ("top1", "top3", "near")))
    return rows.select("scenario", "top1", "top3", F.when(F.col("top1"), 1.0).when(F.col("near"), 0.5).otherwise(0.0).alias("partial"))


def evidence_scores(surfaced: DataFrame, expected: DataFrame) -> DataFrame:
    """(scenario, precision, recall) of the distinct categories in ``surfaced`` against the array ``categories`` of
    ``expected``: 1 and 1 where nothing is expected, else 0 and 0 where nothing was surfaced."""
    own = surfaced.groupBy("scenario").agg(F.collect_set("category").alias("own"))
    rows = expected.select("scenario", F.array_distinct("categories").alias("want")).join(own, "scenario", "left")
    hit = F.size(F.array_intersect("own", "want"))
    empty, none = F.size("want") == 0, F.col("own").isNull()
    return rows.select("scenario", *(F.when(empty, 1.0).when(none, 0.0).otherwise(hit / F.size(over)).alias(name) for name, over in (("precision", "own"), ("recall", "want"))))


def report(results: DataFrame) -> DataFrame:
    """One row: scenarios, accuracy of the best and of the best three, means of time, precision and recall, the largest cost,
    and its median, a whole number: the mean of the middle two."""
    accuracy = lambda c: F.avg(F.col(c).cast("int"))
    return results.agg(F.count("*").alias("scenarios"), accuracy("top1").alias("top1"), accuracy("top3").alias("top3"), F.avg("seconds").alias("seconds"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.floor(F.percentile("cost", 0.5)).cast("bigint").alias("median_cost"), F.max("cost").alias("max_cost"))


def gates(own: DataFrame, baseline: DataFrame, *, floor: float = 0.4, seconds: float = 180, median_cost: int = 80_000, max_cost: int = 500_000, drop: float = 0.05, ratio: float = 1.25) -> DataFrame:
    """One row of booleans: which gates a report passes, by itself and against a baseline report."""
    old = baseline.select(F.col("top1").alias("old_top1"), F.col("seconds").alias("old_seconds"), F.lit(1).alias("one"))
    rows, e = own.withColumn("one", F.lit(1)).join(old, "one"), 1e-9
    passed = {
        "accuracy": F.col("top1") >= floor - e, "time": F.col("seconds") <= seconds + e, "median": F.col("median_cost") <= median_cost, "most": F.col("max_cost") <= max_cost,
        "no_drop": F.col("old_top1") - F.col("top1") <= drop + e, "no_slower": F.col("seconds") <= F.col("old_seconds") * ratio + e,
    }
    out = rows.select(*(c.alias(k) for k, c in passed.items()))
    return out.withColumn("passed", F.expr(" and ".join(passed)))
