"""Incidents from events: grouping, score, severity, epicenter, caps; and rules for their causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import latency
from spanlake.operators.fold import fold
from spanlake.operators.lineage import BROADCAST_ROWS, cut, small

SECOND = 1_000_000_000


def group(events: DataFrame, near: DataFrame, *, same_ns: int = 1800 * SECOND, near_ns: int = 300 * SECOND, block_ns: int | None = None, widen: int = 64) -> DataFrame:
    """``events`` (event_id, tenant, service, fingerprint, at_ns) with ``incident``: the smallest event id that it is linked to.

    Linked are consecutive events of one fingerprint at most ``same_ns`` apart, and events of services within the hops of
    ``near`` (tenant, service, other) at most ``near_ns`` apart, time buckets making that an equi-join. A service's own
    events are linked in a chain, and only the first of its events at one time is linked to other services, to the latest of each:
    those before that are in its chain. Components are found block by block of time (see ``_blocks``).
    """
    events, near = cut(events), cut(near)  # both are read several times
    b = lambda order, c: F.lag(c).over(order).alias("b" if c == "event_id" else "b_ns")
    chained = lambda by, gap: events.select("tenant", F.col("event_id").alias("a"), F.col("at_ns").alias("a_ns"), *(b(Window.partitionBy("tenant", by).orderBy("at_ns", "event_id"), c) for c in ("event_id", "at_ns"))).where(F.col("a_ns") - F.col("b_ns") <= gap)
    # Of a service's events at one time the first stands for all: they are linked in its chain.
    heads = events.groupBy("tenant", "service", "at_ns").agg(F.min("event_id").alias("event_id")).withColumn("_b", F.floor(F.col("at_ns") / F.lit(near_ns)))
    others = heads.select("tenant", F.col("service").alias("other"), F.col("event_id").alias("b"), F.col("at_ns").alias("b_ns"), F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_b"))
    hops = near.where("service <> other").select("tenant", "service", "other").distinct()
    across = heads.join(hops, ["tenant", "service"]).join(others, ["tenant", "other", "_b"]).where((F.col("at_ns") >= F.col("b_ns")) & (F.col("at_ns") - F.col("b_ns") <= near_ns))
    across = across.groupBy("tenant", F.col("event_id").alias("a"), F.col("at_ns").alias("a_ns"), "other").agg(F.max(F.struct("b_ns", "b")).alias("m")).select("tenant", "a", "a_ns", "m.b", "m.b_ns")
    pairs = chained("fingerprint", same_ns).unionByName(chained("service", near_ns)).unionByName(across)
    return _blocks(events, pairs, block_ns or 16 * max(same_ns, near_ns), widen)


def _forest(batches):
    """(tenant, node, node_ns, root, root_ns) of the nodes of links (tenant, block, a, a_ns, b, b_ns), which come sorted by tenant and
    block: the least node of a block that each is linked to, by a union-find over the links of one block."""
    import pyarrow as pa

    now, root, at = None, {}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def done():
        tops = [find(n) for n in root]
        columns = [[now[0]] * len(root), list(root), [at[n] for n in root], tops, [at[t] for t in tops]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["tenant", "node", "node_ns", "root", "root_ns"])

    for batch in batches:
        for tenant, block, a, a_ns, b, b_ns in zip(*(batch.column(c).to_pylist() for c in ("tenant", "block", "a", "a_ns", "b", "b_ns"))):
            if (tenant, block) != now:
                if root:
                    yield done()
                now, root, at = (tenant, block), {}, {}
            for n, t in ((a, a_ns), (b, b_ns)):
                root.setdefault(n, n)
                at[n] = t
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    if root:
        yield done()


def _blocks(events: DataFrame, pairs: DataFrame, width: int, widen: int) -> DataFrame:
    """``events`` with ``incident``, the least event of each component of ``pairs`` (tenant, a, a_ns, b, b_ns), links of near times.

    The components within a block of time become one node each, the least of their events; the links between blocks, which
    only reach from a block's end to the next one's begin, join these nodes, in blocks ``widen`` times as wide, until no link is left.
    So a task holds the links of one tenant's block, and the rounds grow with the logarithm of the time.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(width)).alias("block")
    now = events.withColumn("incident", F.col("event_id"))
    pairs = cut(pairs)
    while not pairs.isEmpty():
        own = pairs.where(block("a_ns") == block("b_ns")).select("tenant", block("a_ns"), "a", "a_ns", "b", "b_ns")
        roots = cut(own.repartition("tenant", "block").sortWithinPartitions("tenant", "block").mapInArrow(_forest, "tenant string, node string, node_ns long, root string, root_ns long"))
        to = roots.where("node <> root").select("tenant", F.col("node").alias("incident"), F.col("root").alias("_root"))
        now = now.join(to, ["tenant", "incident"], "left").withColumn("incident", F.coalesce("_root", "incident")).drop("_root")
        left = pairs.where(block("a_ns") != block("b_ns"))
        for c in ("a", "b"):
            moved = roots.select("tenant", F.col("node").alias(c), F.col("root").alias("_root"), F.col("root_ns").alias("_ns"))
            left = left.join(moved, ["tenant", c], "left").select("tenant", *(x for x in ("a", "a_ns", "b", "b_ns") if not x.startswith(c)), F.coalesce("_root", c).alias(c), F.coalesce("_ns", f"{c}_ns").alias(f"{c}_ns"))
        pairs = cut(left.distinct())
        width *= widen
    return now.select(*events.columns, "incident")


def _labels(nodes: DataFrame, pairs: DataFrame, node: str, label: str, rounds: int) -> DataFrame:
    """(node, label): the least node that each is linked to by ``pairs`` (a, b), which is passed on until nothing changes."""
    pairs = pairs.distinct()
    links = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = cut(nodes.select(node, F.col(node).alias(label)))
    seen = None
    for _ in range(rounds):
        least = links.join(now, links["b"] == now[node]).groupBy("a").agg(F.min(label).alias("m"))
        new = now.join(least, now[node] == least["a"], "left").select(node, F.least(label, "m").alias(label))
        jumped = new.select(F.col(node).alias(label), F.col(label).alias("root"))
        now = cut(new.join(jumped, label, "left").select(node, F.least(label, "root").alias(label)))
        mark = now.agg(F.sum(F.xxhash64(node, label).cast("decimal(38,0)"))).first()[0]
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError(f"labels still change after {rounds} rounds")


def areas(near: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(tenant, service, area) of the services in ``near``: those of different areas never share an incident, so that ``assign`` may
    take areas apart (``by`` tenant and area)."""
    name = lambda c: F.to_json(F.struct("tenant", F.col(c).alias("service")))
    pairs = near.select(name("service").alias("a"), name("other").alias("b"))
    nodes = near.select("tenant", "service", name("service").alias("node")).distinct()
    return nodes.join(_labels(nodes.select("node"), pairs, "node", "area", rounds), "node").select("tenant", "service", "area")


def _assigner(window_ns: int, dedupe_ns: int, most: int | None):
    """A function that takes events and closings of a tenant in order."""
    incidents: dict[str, list] = {}  # id: [last update, closed at, best score by service, provisional]
    by_service: dict[str, list[str]] = {}
    by_fingerprint: dict[str, str] = {}

    def close(name: str, at: int) -> None:
        incidents[name][1] = at
        for around in by_service.values():
            if name in around:
                around.remove(name)

    def score(incident: list) -> float:
        raw = min(1.0, max(incident[2].values()) * (1 + 0.05 * (len(incident[2]) - 1)))
        return min(raw, 0.69) if incident[3] else raw

    def step(event, service, fingerprint, at, points, provisional, around, closes) -> tuple:
        if closes is not None:
            if closes in incidents and incidents[closes][1] is None:
                close(closes, at)
            return None, False, False, None
        target, new, suppressed, expired = by_fingerprint.get(fingerprint), False, False, None
        if target in incidents and (incidents[target][1] is None or at - incidents[target][1] <= dedupe_ns):
            suppressed = True
        else:
            target = next((i for i in by_service.get(service, ()) if at - incidents[i][0] <= window_ns), None)
            if target is None:
                for i in [i for i, x in incidents.items() if x[1] is not None and at - x[1] > dedupe_ns]:
                    del incidents[i]
                target, new = event, True
                incidents[target] = [at, None, {}, False]
            by_fingerprint[fingerprint] = target
        incident = incidents[target]
        if service not in incident[2]:
            incident[2][service] = 0.0
            if incident[1] is None:
                for s in (service, *(around or ())):
                    if target not in by_service.setdefault(s, []):
                        by_service[s].append(target)
        incident[0], incident[2][service], incident[3] = at, max(incident[2][service], points), incident[3] or provisional
        if new and most is not None:
            still = [i for i, x in incidents.items() if x[1] is None]
            if len(still) > most:
                expired = min(still, key=lambda i: score(incidents[i]))
                close(expired, at)
        return target, new, suppressed, expired

    return step


def assign(events: DataFrame, near: DataFrame, *, window_ns: int = 300 * SECOND, dedupe_ns: int = 1800 * SECOND, most: int | None = 200, closings: DataFrame | None = None, by: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """``events`` (event_id, tenant, service, fingerprint, at_ns, score, provisional) in order of (at_ns, event_id), each with its ``incident``, named after its first event.

    An event goes to the incident that its fingerprint went to last, if that is open or was closed at most ``dedupe_ns`` ago
    (``suppressed``); else to the first open one of its service or of one in whose hops (``near``: tenant, service, other) it is, if
    that was updated at most ``window_ns`` ago; else it begins one (``opened``). If over ``most`` are open then, that with the lowest score, of equal ones
    the oldest, expires (``expired``). ``closings`` (tenant, incident, at_ns) end incidents from outside, after the events of their time.

    A tenant is read in order by one task. Without ``most``, a column of ``areas`` in ``by`` splits it, with the same result. The state is that of the incidents which are open or were closed at most ``dedupe_ns`` ago.
    Without ``most`` and ``closings``, few events are read in order (see ``_leading``), and the others follow their fingerprint. Event ids must be unique then.
    """
    if most is None and closings is None:
        events = cut(events)  # read three times
        heads, rows = _leading(events, list(by), window_ns)
        return _followed(events, heads, _walked(rows, near, window_ns, dedupe_ns, None, by), list(by))
    return _walked(events, near, window_ns, dedupe_ns, most, by, closings)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Whether ``keys`` of ``a`` are those of ``b``, there with a leading underscore; nulls are alike."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def _leading(events: DataFrame, by: list[str], window_ns: int) -> tuple[DataFrame, DataFrame]:
    """Of ``events`` without cap and closings: the first of each fingerprint and service, and these with all others that decide where one goes.

    Where nothing closes, a fingerprint keeps its incident, so only firsts are decided; what they ask is whether an incident was updated at most ``window_ns``
    before, which the last event in that time of each of its fingerprints and services answers. These are found by a join on time buckets, and are
    at most as many as pairs of fingerprints, however many events there are.
    """
    bucket = lambda c: F.floor(c / F.lit(max(window_ns, 1))).alias("_w")
    kind, place = [*by, "fingerprint", "service"], F.struct("at_ns", "event_id")
    heads = small(events.groupBy(*kind).agg(F.min(place).alias("m")).select(*kind, "m.*"))
    asked = heads.select(*(F.col(k).alias(f"_{k}") for k in by), F.struct("at_ns", "event_id").alias("_m"), F.explode(F.array(bucket(F.col("at_ns")), bucket(F.col("at_ns")) - 1)).alias("_w"))
    asked = small(asked)
    timed = events.select(*kind, "at_ns", "event_id", bucket(F.col("at_ns")))
    met = timed.join(asked, _same(timed, asked, by) & (timed["_w"] == asked["_w"])).where((place < F.col("_m")) & (F.col("_m.at_ns") - F.col("at_ns") <= window_ns))
    last = met.groupBy(*kind, "_m").agg(F.max(place).alias("m")).select(*kind, "m.*", F.lit(False).alias("_head"))
    rows = heads.withColumn("_head", F.lit(True)).unionByName(last).groupBy(*kind, "at_ns", "event_id").agg(F.max("_head").alias("_head"))
    return heads, rows.withColumns({"score": F.lit(0.0), "provisional": F.lit(False)})  # which only a cap reads


def _followed(events: DataFrame, heads: DataFrame, walked: DataFrame, by: list[str]) -> DataFrame:
    """``events`` with the incident of the first of their fingerprint and service, from ``walked``."""
    kind = [*by, "fingerprint", "service"]
    to = walked.where("_head").select(*(F.col(k).alias(f"_{k}") for k in kind), F.col("event_id").alias("_event_id"), *(F.col(c).alias(f"_{c}") for c in ("incident", "opened", "suppressed")))
    to = F.broadcast(to) if heads.count() <= BROADCAST_ROWS else to
    first = F.col("event_id") == F.col("_event_id")
    rows = events.join(to, _same(events, to, kind))
    own = ["tenant", "service", *(c for c in events.columns if c not in ("tenant", "service"))]  # as a join by these two gives them
    return rows.select(*own, F.col("_incident").alias("incident"), (first & F.col("_opened")).alias("opened"), (~first | F.col("_suppressed")).alias("suppressed"), F.lit(None).cast("string").alias("expired"))


def _walked(events: DataFrame, near: DataFrame, window_ns: int, dedupe_ns: int, most: int | None, by: tuple[str, ...], closings: DataFrame | None = None) -> DataFrame:
    """``assign`` of all ``events`` in order."""
    around = near.where("service <> other").groupBy("tenant", "service").agg(F.array_sort(F.collect_set("other")).alias("_around"))
    none = F.lit(None).cast("string")
    rows = events.join(around, ["tenant", "service"], "left").withColumn("_closes", none)
    if closings is not None:
        ends = closings.select("tenant", "at_ns", F.col("incident").alias("_closes"))
        if by != ("tenant",):
            raise ValueError("closings are known by tenant only")
        rows = rows.unionByName(ends, allowMissingColumns=True)
    rows = rows.withColumn("_end", F.col("_closes").isNotNull())
    reads = ["event_id", "service", "fingerprint", "at_ns", "score", "provisional", "_around", "_closes"]
    out = fold(rows, by=list(by), order=["at_ns", "_end", "event_id"], reads=reads, start=lambda: _assigner(window_ns, dedupe_ns, most), adds="incident string, opened boolean, suppressed boolean, expired string")
    return out.where("not _end").drop("_around", "_closes", "_end")


def severity(score: str = "score", services: str = "n_services") -> Column:
    s = F.col(score)
    return F.when(s < 0.55, "unknown").when(s <= 0.69, F.when(F.col(services) >= 2, "medium").otherwise("low")).when(s <= 0.84, "high").otherwise("critical")


def summarize(grouped: DataFrame, near: DataFrame, *, exemplars: int = 4, latest: int = 200) -> DataFrame:
    """By incident: services, score (the best, 5 % more for each further service, at most 1, or 0.69 if any of it is provisional),
    severity, epicenter (best score, then name), blast radius (its services within the hops of ``near`` of the epicenter), the
    ``latest`` event ids, the exemplars of the first events and the deploys, where the events have such columns."""
    key = ["tenant", "incident"]
    best = grouped.groupBy(*key, "service").agg(F.max("score").alias("score"), F.min("at_ns").alias("first_ns"), F.max("at_ns").alias("last_ns"), F.count("*").alias("n"), F.max("provisional").alias("provisional"))
    rows = best.groupBy(*key).agg(F.array_sort(F.collect_set("service")).alias("services"), F.max("score").alias("top"), F.min_by("service", F.struct(-F.col("score"), F.col("service"))).alias("epicenter"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.sum("n").alias("events"), F.max("provisional").alias("provisional"))
    raw = F.least(F.lit(1.0), F.col("top") * (1 + 0.05 * (F.size("services") - 1)))
    rows = rows.withColumn("n_services", F.size("services")).withColumn("score", F.when(F.col("provisional"), F.least(F.lit(0.69), raw)).otherwise(raw)).withColumn("severity", severity())
    around = near.groupBy("tenant", F.col("service").alias("epicenter")).agg(F.collect_set("other").alias("around"))
    out = rows.join(around, ["tenant", "epicenter"], "left")
    blast = F.array_sort(F.filter("services", lambda s: (s == F.col("epicenter")) | F.array_contains(F.coalesce("around", F.array().cast("array<string>")), s)))
    out = out.withColumn("blast_radius", blast).drop("around", "top")
    listed = lambda rows, n, *order: rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= n)
    inner = lambda c, name: F.transform(F.array_sort(F.collect_list(F.struct("_k", c))), lambda x: x[c]).alias(name)
    out = out.join(listed(grouped, latest, F.desc("at_ns"), F.desc("event_id")).groupBy(*key).agg(inner("event_id", "event_ids")), key, "left")  # there are some: a left join goes where no one asks for them
    if "exemplar" in grouped.columns:
        out = out.join(listed(grouped.where("exemplar is not null"), exemplars, "at_ns", "event_id").groupBy(*key).agg(inner("exemplar", "exemplars")), key, "left")
    if "deploys" in grouped.columns:
        out = out.join(grouped.select(*key, F.explode("deploys").alias("d")).groupBy(*key).agg(F.array_sort(F.collect_set("d")).alias("deploys")), key, "left")
    return out


def active(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("status").between(1, 4)).orderBy("incident")


def capped(incidents: DataFrame, *, most: int = 200) -> DataFrame:
    """Incidents with the status: of a tenant's open ones over ``most``, those of the lowest score expire (7)."""
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("score"), "incident"))
    return incidents.withColumn("status", F.when(rank > most, 7).otherwise(1))


def suppressed(incidents: DataFrame, reasons: DataFrame) -> DataFrame:
    """Incidents with status 6 and the reason where ``reasons`` (incident, reason) has one."""
    return incidents.join(reasons, "incident", "left").withColumn("status", F.when(F.col("reason").isNotNull(), 6).otherwise(F.col("status")))


def deploy_errors(signatures: DataFrame, deploys: DataFrame, *, within_ns: int = 1800 * SECOND, confidence: float = 0.85) -> DataFrame:
    """Signatures first seen at most ``within_ns`` after a deploy of their service. Signatures, which are few, meet the bucket before theirs
    too, and go to the deploys by broadcast."""
    bucket = lambda c: F.floor(c / F.lit(within_ns)).cast("bigint")
    d = deploys.select("tenant", "service", "deploy_id", "at_ns").withColumn("_b", bucket(F.col("at_ns")))
    gap = F.col("first_ns") - F.col("at_ns")
    few = small(signatures.select("tenant", "service", "signature", "first_ns").withColumn("_b", F.explode(F.array(bucket(F.col("first_ns")), bucket(F.col("first_ns")) - 1))))
    rows = d.join(few, ["tenant", "service", "_b"]).where((gap > 0) & (gap <= within_ns))
    return rows.select("tenant", "service", "signature", "deploy_id", gap.alias("after_ns"), F.lit(confidence).alias("confidence"))


def downstream_latency(pairs: DataFrame, totals: DataFrame, *, share: float = 0.8) -> DataFrame:
    """Spans whose slowest child in another service takes at least ``share`` of their time.

    ``pairs`` are parents with children, ``totals`` (tenant, trace_id, parent_span_id, total_ns) the parents' durations.
    """
    other = F.col("service") != F.col("parent_service")
    rows = pairs.groupBy("tenant", "trace_id", "parent_span_id", "parent_service", "parent_name").agg(F.sum("duration_ns").alias("children_ns"), F.max(F.when(other, F.struct("duration_ns", "service"))).alias("slowest"))
    rows = rows.where("slowest is not null").join(totals, ["tenant", "trace_id", "parent_span_id"])
    return rows.where((F.col("total_ns") > 0) & (F.col("slowest.duration_ns") / F.col("total_ns") >= share)).select("tenant", "trace_id", "parent_span_id", "parent_service", "parent_name", F.col("slowest.service").alias("child_service"), F.col("slowest.duration_ns").alias("child_ns"), "total_ns", (F.col("total_ns") - F.col("children_ns")).alias("self_ns"))


def repeated_siblings(pairs: DataFrame, *, threshold: int = 10, statement: Column | None = None) -> DataFrame:
    """Siblings of one service, operation and statement (literals masked) that are at least ``threshold``."""
    template = F.regexp_replace(statement if statement is not None else F.lit(""), r"'[^']*'|\b\d+\b", "?")
    rows = pairs.groupBy("tenant", "trace_id", "parent_span_id", "service", "name", template.alias("template")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") >= threshold).withColumn("confidence", _repeated(F.col("n")))


def _repeated(n: Column) -> Column:
    return F.least(F.lit(0.95), 0.7 + 0.02 * (n - 10))


def counted_traces(rows: DataFrame, *, share: float = 0.8) -> DataFrame:
    """What rules and edges read of spans with calls (``graph.family_calls``), each ``once`` of its families: by service, ``signature`` (null where a span didn't fail),
    parent of which it takes at least ``share`` (``slowed``, of another service) and call, the spans, the most ``siblings``, the first and last arrival.

    Spans are counted where they are, so that few rows are shuffled.
    """
    total = F.col("parent.duration_ns")
    slowed = F.when((F.col("service") != F.col("parent.service")) & (total > 0) & (F.col("duration_ns") / total >= share), F.col("parent.service"))
    alike = F.max(F.when(F.col("parent").isNotNull(), F.col("siblings"))).alias("siblings")
    rows = rows.groupBy("tenant", "service", "signature", slowed.alias("slowed"), "caller", "callee", "protocol")
    return rows.agg(F.count("*").alias("calls"), alike, F.min("received_ns").alias("first_ns"), F.max("received_ns").alias("last_ns"))


def from_traces(counted: DataFrame, *, threshold: int = 10, slow: float = 0.8) -> DataFrame:
    """(tenant, rule, service, signature, confidence, first_ns): by service, what ``downstream_latency`` (with the confidence ``slow``) and
    ``repeated_siblings`` find, and as ``error`` the first sighting of each signature, from ``counted_traces``."""
    none, never = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    told = lambda when, rule, service, signature, confidence, first: F.when(when, F.struct(F.lit(rule).alias("rule"), F.col(service).alias("service"), signature.alias("signature"), confidence.cast("double").alias("confidence"), first.alias("first_ns")))
    found = F.array_compact(F.array(
        told(F.col("signature").isNotNull(), "error", "service", F.col("signature"), F.lit(None), F.col("first_ns")),
        told(F.col("slowed").isNotNull(), "downstream_latency", "slowed", none, F.lit(slow), never),
        told(F.col("siblings") >= threshold, "n_plus_one", "service", none, _repeated(F.col("siblings")), never),
    ))
    return counted.select("tenant", F.inline(found)).groupBy("tenant", "rule", "service", "signature").agg(F.max("confidence").alias("confidence"), F.min("first_ns").alias("first_ns"))


def pool_exhaustion(logs: DataFrame, waits: DataFrame, *, pattern: str = r"(?i)pool.*(exhaust|timeout)|too many connections", confidence: float = 0.8) -> DataFrame:
    """Services whose waits (ts_ns, value) grow over the window and whose logs tell of an exhausted pool."""
    hits = logs.where(F.col("body").rlike(pattern)).groupBy("tenant", "service").agg(F.count("*").alias("matches"))
    seconds = (F.col("ts_ns") - F.lit(1_704_067_200 * SECOND)) / F.lit(SECOND)
    slope = waits.groupBy("tenant", "service").agg(F.regr_slope("value", seconds).alias("slope"))
    return slope.join(hits, ["tenant", "service"]).where("slope > 0").withColumn("confidence", F.lit(confidence))


#: Rules in the order in which they are asked, with the cause that each shows (fixed values).
CAUSES = (("deploy_error", "deploy_regression"), ("downstream_latency", "dependency_failure"), ("n_plus_one", "data_skew"), ("pool_exhaustion", "resource_exhaustion"))


def timeout_mismatches(clients: DataFrame, red: DataFrame) -> DataFrame:
    """Client spans that gave up while what they called takes longer than they wait (tenant, service, name, callee, timeout_ns,
    p95_ns, calls, trace_id): ``clients`` (tenant, trace_id, service, name, callee, timeout_ns, exceeded) with ``exceeded`` and a timeout below the p95
    of the callee's spans, of which ``red`` has the histograms. Both sides are aggregated before they meet.
    """
    own = clients.where(F.col("exceeded") & F.col("callee").isNotNull() & F.col("timeout_ns").isNotNull())
    own = own.groupBy("tenant", "service", "name", "callee", "timeout_ns").agg(F.count("*").alias("calls"), F.min("trace_id").alias("trace_id"))
    slow = red.groupBy("tenant", F.col("service").alias("callee")).agg(latency.merged("hist").alias("hist")).select("tenant", "callee", latency.quantile(F.col("hist"), 0.95).alias("p95_ns"))
    return own.join(slow, ["tenant", "callee"]).where(F.col("timeout_ns") < F.col("p95_ns")).select("tenant", "service", "name", "callee", "timeout_ns", "p95_ns", "calls", "trace_id")


def conclude(incidents: DataFrame, evidence: DataFrame, *, least: float = 0.75) -> DataFrame:
    """By incident, from ``evidence`` (tenant, service, rule, confidence) about its epicenter: the first rule in order with
    enough confidence; else the best one, inconclusive."""
    place = F.create_map(*(F.lit(x) for k, (rule, _) in enumerate(CAUSES) for x in (rule, k)))
    cause = F.create_map(*(F.lit(x) for pair in CAUSES for x in pair))
    best = evidence.groupBy("tenant", "service", "rule").agg(F.max("confidence").alias("confidence"))
    per = best.groupBy("tenant", F.col("service").alias("epicenter")).agg(F.min(F.when(F.col("confidence") >= least, F.struct(place[F.col("rule")].alias("k"), "rule", "confidence"))).alias("sure"), F.max(F.struct("confidence", "rule")).alias("top"))
    rows = incidents.join(per, ["tenant", "epicenter"], "left")
    rule = F.coalesce("sure.rule", "top.rule")
    return rows.select("tenant", "incident", "epicenter", rule.alias("rule"), F.try_element_at(cause, rule).alias("category"), F.coalesce("sure.confidence", "top.confidence").alias("confidence"), F.when(F.col("sure").isNotNull(), "concluded").otherwise("inconclusive").alias("outcome"))


def merge_hypotheses(updates: DataFrame) -> DataFrame:
    """The latest state of each hypothesis of an incident, by ``seq``."""
    values = [c for c in updates.columns if c not in ("incident", "hypothesis")]
    return updates.groupBy("incident", "hypothesis").agg(F.max_by(F.struct(*values), "seq").alias("v")).select("incident", "hypothesis", "v.*")


def corrupt_steps(steps: DataFrame) -> DataFrame:
    """Steps (step_id, body, hash) whose body has another SHA-256 than recorded."""
    return steps.where(F.sha2("body", 256) != F.col("hash"))


def drifted(before: DataFrame, after: DataFrame, *, key: str = "step_id") -> DataFrame:
    """Steps whose result differs between two runs, or is in one of them only."""
    a, b = before.select(key, F.sha2("body", 256).alias("h1")), after.select(key, F.sha2("body", 256).alias("h2"))
    return a.join(b, key, "full").where(~F.col("h1").eqNullSafe(F.col("h2"))).select(key, F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "new").otherwise("changed").alias("drift"))
