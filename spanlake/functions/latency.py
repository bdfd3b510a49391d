"""Latency histograms: 16 log-2 buckets of milliseconds, merged by addition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16
MS = 1_000_000
#: What a quantile in the last bucket reads as, in ms (fixed value).
TOP_MS = 32_000


def bucket(duration_ns: Column) -> Column:
    """floor(log2(ms)) within 0..15; 0 is what takes under 2 ms."""
    ms = F.greatest(F.floor(duration_ns / F.lit(MS)).cast("bigint"), F.lit(1).cast("bigint"))
    return F.least(F.length(F.bin(ms)) - 1, F.lit(BUCKETS - 1))


def hist(duration_ns: Column) -> Column:
    """Aggregate: the histogram of a column of durations."""
    return counted(bucket(duration_ns))


def counted(b: Column) -> Column:
    """Aggregate: the histogram of a column of buckets."""
    return F.array(*(F.count_if(b == i) for i in range(BUCKETS)))


def merged(column: str) -> Column:
    """Aggregate: the sum of histograms."""
    return F.array(*(F.sum(F.col(column)[i]) for i in range(BUCKETS)))


def quantile(column: Column, p: float) -> Column:
    """Lower edge, in ns, of the first bucket whose running count reaches trunc(p * total); 0 for an empty histogram."""
    total = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)
    target = F.floor(total * F.lit(p)).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("i"), F.lit(-1).alias("at"), target.alias("target"))  # once, not at each bucket

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + x
        return F.struct(n.alias("n"), (a["i"] + 1).alias("i"), F.when((a["at"] < 0) & (n >= a["target"]), a["i"]).otherwise(a["at"]).alias("at"), a["target"].alias("target"))

    at = F.aggregate(column, start, step, lambda a: a["at"])
    edge = F.when(at >= BUCKETS - 1, F.lit(TOP_MS)).otherwise(F.pow(F.lit(2), at))
    return F.when(total == 0, F.lit(0).cast("bigint")).otherwise((edge * MS).cast("bigint"))


def quantiles(column: Column) -> Column:
    """p50, p95, p99 and max; the last is the histogram's upper end whenever it is not empty."""
    total = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)
    top = F.when(total == 0, F.lit(0)).otherwise(F.lit(TOP_MS * MS)).cast("bigint")
    return F.struct(quantile(column, 0.5).alias("p50"), quantile(column, 0.95).alias("p95"), quantile(column, 0.99).alias("p99"), top.alias("max"))


def with_quantiles(rows: DataFrame, column: str = "hist", ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``rows`` with p50_ns and so on, as by ``quantile``, for series of many rows: running counts and targets are columns, each computed once
    from the one before, in compiled code."""
    for i in range(BUCKETS):
        n = F.get(column, F.lit(i))
        rows = rows.withColumn(f"_n{i}", n if i == 0 else F.col(f"_n{i - 1}") + n)
    total = F.col(f"_n{BUCKETS - 1}")
    rows = rows.withColumns({f"_t{k}": F.floor(total * F.lit(p)).cast("bigint") for k, p in enumerate(ps)})
    for k, p in enumerate(ps):
        out = F.when(total == 0, F.lit(0).cast("bigint"))
        for i in range(BUCKETS - 1):
            out = out.when(F.col(f"_n{i}") >= F.col(f"_t{k}"), F.lit((1 << i) * MS).cast("bigint"))
        rows = rows.withColumn(f"p{round(p * 100)}_ns", out.otherwise(F.lit(TOP_MS * MS).cast("bigint")))
    return rows.drop(*(f"_n{i}" for i in range(BUCKETS)), *(f"_t{k}" for k in range(len(ps))))
