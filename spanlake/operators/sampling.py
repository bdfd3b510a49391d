"""Keep or drop decisions on whole traces."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.fold import fold

SECOND = 1_000_000_000
#: Reasons (fixed values).
ERROR, SLOW, RARE, INTEREST, FLOOR, PROBABILISTIC, DROPPED, SHED, TRUNCATED = 1, 2, 3, 4, 5, 6, 7, 8, 9


def rare_candidates(traces: DataFrame, *, quiet_ns: int = 7 * 86400 * SECOND) -> DataFrame:
    """Traces with ``rare``: their path signature is new in the tenant, or was last seen over ``quiet_ns`` ago.

    Only the first trace of a signature in a bucket of that width can be rare, so the commonest signature costs a row for
    each bucket.
    """
    own = F.struct("start_ns", "trace_id")
    buckets = traces.groupBy("tenant", "path_signature", F.floor(F.col("start_ns") / F.lit(quiet_ns)).alias("bucket")).agg(F.min(own).alias("first"), F.max("start_ns").alias("last_ns"))
    before = F.lag("last_ns").over(Window.partitionBy("tenant", "path_signature").orderBy("bucket"))
    new = buckets.withColumn("before", before).where(F.col("before").isNull() | (F.col("first.start_ns") - F.col("before") > quiet_ns))
    found = new.select("tenant", F.col("first.trace_id").alias("trace_id"), F.lit(True).alias("rare"))
    return traces.join(found, ["tenant", "trace_id"], "left").withColumn("rare", F.coalesce("rare", F.lit(False)))


def per_minute(rows: DataFrame, *, by: list[str], rate: int, when: Column, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: among those where ``when`` holds, the first ``rate`` of each key and minute."""
    minute = F.floor(F.col("start_ns") / F.lit(60 * SECOND))
    rank = F.row_number().over(Window.partitionBy(*by, "_minute", "_asks").orderBy("start_ns", "trace_id"))
    asked = rows.withColumn("_minute", minute).withColumn("_asks", when)
    return asked.withColumn(name, F.col("_asks") & (rank <= rate)).drop("_minute", "_asks")


def token_bucket(rows: DataFrame, *, by: list[str], rate: int) -> DataFrame:
    """``rows`` with ``taken``: an exact bucket of ``rate`` tokens that starts full and refills at rate / 60 a second.

    A key is read in order of (start_ns, trace_id), batch by batch: its rows are sorted on disk, not held together.
    """
    places = [rows.columns.index(c) for c in by]

    def work(batches):
        import pyarrow as pa

        key, tokens, last = None, 0.0, 0
        for batch in batches:
            taken = []
            for at, *own in zip(batch.column("start_ns").to_pylist(), *(batch.column(i).to_pylist() for i in places)):
                if own != key:
                    key, tokens, last = own, float(rate), at
                tokens, last = min(float(rate), tokens + (at - last) / SECOND * rate / 60), at
                ok = tokens >= 1
                tokens -= ok
                taken.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names=[*batch.schema.names, "taken"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", taken boolean"
    return rows.repartition(*by).sortWithinPartitions(*by, "start_ns", "trace_id").mapInArrow(work, fields)


def probabilistic(*, rate: Column) -> Column:
    """A pure function of the trace id: its md5's first 8 hex digits mod 10000, under trunc(rate * 10000)."""
    return F.conv(F.substring(F.md5("trace_id"), 1, 8), 16, 10).cast("bigint") % 10_000 < F.floor(rate * 10_000)


def interest(traces: DataFrame, predicates: DataFrame, *, most: int = 32) -> DataFrame:
    """``traces`` with ``predicate``: the first one of their tenant that they match, by ``seq``, or null.

    A predicate asks for a least duration, for errors, and then for a trace id or a path signature or a service out of lists;
    empty lists ask for nothing, and one without lists matches. Predicates are few (``most`` of a tenant are looked at).
    """
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("hits"), F.desc("expires_ns"), "seq"))
    few = predicates.withColumn("_r", rank).where(F.col("_r") <= most)
    own = few.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("seq", "predicate", "min_duration_ns", "errors_only", "trace_ids", "signatures", "services"))).alias("asked"))

    def matches(p: Column) -> Column:
        some = (F.size(p["trace_ids"]) > 0) | (F.size(p["signatures"]) > 0) | (F.size(p["services"]) > 0)
        hit = F.array_contains(p["trace_ids"], F.col("trace_id")) | F.array_contains(p["signatures"], F.col("path_signature")) | F.arrays_overlap(p["services"], F.col("services"))
        return (F.col("duration_ns") >= p["min_duration_ns"]) & (~p["errors_only"] | (F.col("error_count") > 0)) & (~some | hit)

    found = F.get(F.filter("asked", matches), F.lit(0))["predicate"]
    return traces.join(own, "tenant", "left").withColumn("predicate", found).drop("asked")


def active_predicates(predicates: DataFrame, *, now_ns: int, most: int = 32) -> DataFrame:
    """Predicates that have not expired; over ``most`` of a tenant, those of the fewest hits, then soonest to expire, go."""
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("hits"), F.desc("expires_ns"), "seq"))
    live = predicates.where((F.col("expires_ns") == 0) | (F.col("expires_ns") > now_ns))
    return live.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def decide(traces: DataFrame, *, rate: float = 0.01, floor_rate: int = 6, rare_rate: int = 60, slow_ns: int = 250_000_000) -> DataFrame:
    """Reasons and flags for ``traces`` with columns base_p99_ns, warmed, rare, predicate, truncated.

    Precedence: error, slow, rare (within its tokens), interest, floor, probabilistic, dropped. Token buckets are counted by
    minute. ``also`` has a bit (1 << reason) for each of the first four classes that held besides the reason.
    """
    error = F.col("error_count") > 0
    slow = F.coalesce(F.col("warmed") & (F.col("duration_ns") > F.col("base_p99_ns")) & (F.col("duration_ns") > slow_ns), F.lit(False))
    rows = traces.withColumn("_error", error).withColumn("_slow", slow)
    rows = per_minute(rows, by=["tenant"], rate=rare_rate, when=~F.col("_error") & ~F.col("_slow") & F.col("rare"), name="_rare")
    left = ~F.col("_error") & ~F.col("_slow") & ~F.col("_rare") & F.col("predicate").isNull()
    rows = per_minute(rows, by=["tenant", "root_service"], rate=floor_rate, when=left, name="_floor")
    reason = F.when(F.col("_error"), ERROR).when(F.col("_slow"), SLOW).when(F.col("_rare"), RARE).when(F.col("predicate").isNotNull(), INTEREST).when(F.col("_floor"), FLOOR).when(probabilistic(rate=F.lit(rate)), PROBABILISTIC).otherwise(DROPPED)
    rows = rows.withColumn("class", reason)
    flags = sum((F.when(c & (F.col("class") != n), 1 << n).otherwise(0) for c, n in ((F.col("_slow"), SLOW), (F.col("rare"), RARE), (F.col("predicate").isNotNull(), INTEREST))), F.when(F.col("_error") & (F.col("class") != ERROR), 1 << ERROR).otherwise(0))
    rows = rows.withColumn("keep", F.col("class") != DROPPED).withColumn("also", flags)
    return rows.withColumn("reason", F.when(F.col("keep") & F.col("truncated"), TRUNCATED).otherwise(F.col("class"))).drop("_error", "_slow", "_rare", "_floor", "class")


def shed(decisions: DataFrame, *, share: float = 0.25) -> DataFrame:
    """Decisions within a budget of kept traces by tenant and minute: errors and truncated ones stay; of the rest the highest
    classes (slow, rare, interest, floor, probabilistic) fill floor(share n)."""
    minute = F.floor(F.col("start_ns") / F.lit(60 * SECOND))
    rank = F.create_map(*(F.lit(x) for pair in ((ERROR, 9), (TRUNCATED, 9), (SLOW, 4), (RARE, 3), (INTEREST, 2), (FLOOR, 1), (PROBABILISTIC, 0)) for x in pair))
    rows = decisions.withColumn("_minute", minute).withColumn("_rank", F.when(F.col("keep"), F.try_element_at(rank, F.col("reason"))).otherwise(-1))
    place = F.row_number().over(Window.partitionBy("tenant", "_minute").orderBy(F.desc("_rank"), "trace_id"))
    total = F.count("*").over(Window.partitionBy("tenant", "_minute"))
    over = F.col("keep") & (F.col("_rank") < 9) & (place > F.floor(total * share))
    return rows.withColumn("_over", over).withColumn("keep", F.col("keep") & ~F.col("_over")).withColumn("reason", F.when(F.col("_over"), SHED).otherwise(F.col("reason"))).drop("_minute", "_rank", "_over")


#: Classes in the order in which they are shed (fixed values); others are never shed.
SHED_ORDER = (PROBABILISTIC, FLOOR, INTEREST, RARE, SLOW)


def _governor(share: float, window_ns: int):
    """A function that takes a tenant's decisions in order; it holds those of the last ``window_ns``, and their counts."""
    recent: deque = deque()
    standing = dict.fromkeys((-1, *range(len(SHED_ORDER))), 0)  # kept decisions by their place in the order

    def step(at, keep, reason, protected) -> tuple:
        while recent and recent[0][0] < at - window_ns:
            place = recent.popleft()[1]
            if place is not None:
                standing[place] -= 1
        place = SHED_ORDER.index(reason) if reason in SHED_ORDER and not protected else -1
        over = bool(recent) and sum(standing.values()) / len(recent) > share
        gone = bool(keep and place >= 0 and over and not any(standing[p] for p in range(place)))
        stays = keep and not gone
        # A protected decision of a class that may be shed stands for its class all the same.
        stands = SHED_ORDER.index(reason) if reason in SHED_ORDER else -1
        recent.append((at, stands if stays else None))
        if stays:
            standing[stands] += 1
        return stays, SHED if gone else reason

    return step


def govern(decisions: DataFrame, *, share: float = 0.25, window_ns: int = 60 * SECOND, protected: Column | None = None) -> DataFrame:
    """``decisions`` in order of (start_ns, trace_id) with ``keep`` and ``reason`` after the rolling cap.

    If over ``share`` of a tenant's decisions in the ``window_ns`` before one (of its time too, if they come first) were kept,
    it is shed, unless it is an error, truncated or ``protected`` (matches of an investigation), or a class that goes
    before its own still has a kept decision in that time. What is shed counts as dropped from then on.

    A tenant is read in order by one task; its state are the decisions of the window. ``shed`` is the form without an order.
    """
    rows = decisions.withColumn("_protected", F.coalesce(protected if protected is not None else F.lit(False), F.lit(False)))
    out = fold(rows, by=["tenant"], order=["start_ns", "trace_id"], reads=["start_ns", "keep", "reason", "_protected"], start=lambda: _governor(share, window_ns), adds="_keep boolean, _reason int")
    return out.withColumn("keep", F.col("_keep")).withColumn("reason", F.col("_reason")).drop("_keep", "_reason", "_protected")


def tier(reason: str = "reason") -> Column:
    """1 for what is kept as an error, slow, rare or of interest, else 2."""
    return F.when(F.col(reason).isin(ERROR, SLOW, RARE, INTEREST), 1).otherwise(2)


def apply(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans of kept traces, with reason and tier."""
    kept = decisions.where("keep").select("tenant", "trace_id", "reason", tier().alias("tier"))
    return spans.join(kept, ["tenant", "trace_id"])


def keep_rates(decisions: DataFrame) -> DataFrame:
    """Decisions and their share by tenant and reason."""
    total = F.sum("n").over(Window.partitionBy("tenant"))
    return decisions.groupBy("tenant", "reason").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def rolling_rates(decisions: DataFrame, *, window_ns: int = 60 * SECOND, tick_ns: int = 10 * SECOND) -> DataFrame:
    """At each tick, by tenant and reason: the decisions of the ``window_ns`` before it and their share of the tenant's.

    Decisions are counted by tick first and handed to the ticks whose windows hold them, so that no tenant is read in order.
    """
    tick = F.col("start_ns") - F.pmod("start_ns", F.lit(tick_ns)) + tick_ns
    counts = decisions.groupBy("tenant", "reason", tick.alias("first")).agg(F.count("*").alias("n"))
    ticks = F.transform(F.sequence(F.lit(0), F.lit(window_ns // tick_ns - 1)), lambda i: F.col("first") + i * tick_ns)
    rows = counts.withColumn("tick_ns", F.explode(ticks)).groupBy("tenant", "tick_ns", "reason").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("tenant", "tick_ns"))
    return rows.withColumn("share", F.col("n") / total)


def cost_signal(bytes_used: DataFrame, *, budget: float, floor: float = 0.01, band: float = 0.15, least: float = 0.0001) -> DataFrame:
    """By tenant: used over budget, the next sampling floor (halved above the band, raised by half below it, within
    [least, 1]), and the watermark."""
    ratio = F.col("used") / F.lit(float(budget))
    step = F.greatest(F.lit(0.5 * floor), F.lit(least))
    moved = F.when(ratio > 1 + band, F.lit(floor) - step).when(ratio < 1 - band, F.lit(floor) + step).otherwise(F.lit(floor))
    mark = F.when(ratio >= 0.95, "critical").when(ratio >= 0.85, "high").when(ratio >= 0.8, "warn").otherwise("ok")
    used = bytes_used.groupBy("tenant").agg(F.sum("bytes").alias("used"))
    return used.select("tenant", "used", ratio.alias("ratio"), F.greatest(F.lit(least), F.least(F.lit(1.0), moved)).alias("floor"), mark.alias("watermark"))
