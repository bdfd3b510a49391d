"""The service graph: edges from peers and from joined spans, their changes, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import latency
from spanlake.operators.lineage import cut

SECOND = 1_000_000_000
#: Span kinds (fixed values): 2 server, 3 client, 4 producer, 5 consumer.
CALLERS, CALLEES = (3, 4), (2, 5)
#: Attribute that shows a protocol, in order of precedence (fixed values).
PROTOCOLS = (("rpc.system", "grpc"), ("http.request.method", "http"), ("http.method", "http"), ("db.system", "db"), ("messaging.system", "messaging"))
EDGE = ["tenant", "caller", "callee", "protocol"]


def _attr(key: str) -> Column:
    return F.nullif(F.try_element_at("attrs", F.lit(key)), F.lit(""))


def protocol() -> Column:
    out = None
    for key, name in PROTOCOLS:
        has = F.map_contains_key("attrs", key)
        out = F.when(has, name) if out is None else out.when(has, name)
    return out.otherwise("unknown")


def peer() -> Column:
    """struct<callee, protocol> of a client span's attributes; callee is null without a peer."""
    named = F.coalesce(_attr("peer.service"), _attr("server.address"))
    db, topic = _attr("db.system"), _attr("messaging.destination.name")
    callee = F.coalesce(named, F.concat(F.lit("db:"), db), topic)
    return F.struct(callee.alias("callee"), F.when(named.isNotNull(), protocol()).when(db.isNotNull(), "db").when(topic.isNotNull(), "messaging").alias("protocol"))


def _calls(rows: DataFrame, caller: Column, callee: Column, kind: Column) -> DataFrame:
    return rows.select("tenant", caller.alias("caller"), callee.alias("callee"), F.when((caller != "") & (caller == callee), "internal").otherwise(kind).alias("protocol"), F.col("name").alias("operation"), "trace_id", "span_id", "received_ns", "duration_ns", (F.col("status_code") == 2).alias("failed"))


def prepared(spans: DataFrame) -> DataFrame:
    """Spans with what calls read of their attributes instead of these, which needn't be shuffled then."""
    return spans.withColumns({"_peer": peer(), "_protocol": protocol()}).drop("attrs")


def peer_calls(spans: DataFrame) -> DataFrame:
    """A call for every client or producer span that names its peer."""
    rows = spans.where(F.col("kind").isin(*CALLERS)).withColumn("peer", peer()).where("peer.callee is not null")
    return _calls(rows, F.col("service"), F.col("peer.callee"), F.col("peer.protocol"))


def _met(spans: DataFrame, within_ns: int, strict_arrival: bool) -> DataFrame:
    """Client and server spans with ``named`` (a client with a peer), ``own`` (the first server child of a client without one, near it) and that
    ``client``. A span id is there once.

    A client and its children meet in one window, not in a join, so that spans dealt by trace need no further shuffle.
    """
    rows = spans if "_peer" in spans.columns else prepared(spans)
    calling, called = F.col("kind").isin(*CALLERS), F.col("kind").isin(*CALLEES)
    rows = rows.where(calling | called).withColumns({"named": calling & F.col("_peer.callee").isNotNull(), "_key": F.when(calling, F.col("span_id")).otherwise(F.col("parent_span_id"))})
    group = Window.partitionBy("tenant", "trace_id", "_key")
    rows = rows.withColumn("client", F.max(F.when(calling & ~F.col("named"), F.struct(F.col("service").alias("service"), F.col("_protocol").alias("protocol"), F.col("received_ns").alias("received_ns")))).over(group))
    gap = F.col("received_ns") - F.col("client.received_ns")
    rows = rows.withColumn("_near", F.when(called & gap.between(0 if strict_arrival else -within_ns, within_ns), F.struct("received_ns", "span_id")))
    return rows.withColumn("own", F.coalesce(F.col("_near") == F.min("_near").over(group), F.lit(False)))


def joined_calls(spans: DataFrame, *, within_ns: int = 30 * SECOND, strict_arrival: bool = False) -> DataFrame:
    """A call for every server or consumer span: from the client span that is its parent, else from ``external``.

    Clients with a peer are not asked. A client belongs to its first server child (by arrival, span id) within ``within_ns``,
    before or after it; with ``strict_arrival``, only after it.
    """
    rows = _met(spans, within_ns, strict_arrival).where(F.col("kind").isin(*CALLEES))
    return _calls(rows, F.when(F.col("own"), F.col("client.service")).otherwise("external"), F.col("service"), F.when(F.col("own"), F.col("client.protocol")).otherwise("unknown"))


def calls(spans: DataFrame, *, within_ns: int = 30 * SECOND, strict_arrival: bool = False) -> DataFrame:
    """Those of ``peer_calls`` and ``joined_calls``, in one pass."""
    rows = _met(spans, within_ns, strict_arrival).where(F.col("named") | F.col("kind").isin(*CALLEES))
    caller = F.when(F.col("named"), F.col("service")).when(F.col("own"), F.col("client.service")).otherwise("external")
    callee = F.when(F.col("named"), F.col("_peer.callee")).otherwise(F.col("service"))
    return _calls(rows, caller, callee, F.when(F.col("named"), F.col("_peer.protocol")).when(F.col("own"), F.col("client.protocol")).otherwise("unknown"))


def family_calls(rows: DataFrame, *, within_ns: int = 30 * SECOND) -> DataFrame:
    """``rows``, the ``families`` of ``prepared`` spans that carry received_ns, kind, _peer and _protocol, with the caller, callee and protocol of the call that
    ``calls`` gives a span, null for none. That of the row which ``once`` keeps counts. The window is that of the families."""
    calling, called = F.col("kind").isin(*CALLERS), F.col("kind").isin(*CALLEES)
    named = calling & F.col("_peer.callee").isNotNull()
    client = F.col("child") & F.col("parent.kind").isin(*CALLERS) & F.col("parent._peer.callee").isNull()
    near = client & (F.col("received_ns") - F.col("parent.received_ns")).between(-within_ns, within_ns)
    rows = rows.withColumn("_near", F.when(called & near, F.struct("received_ns", "span_id")))
    own = F.coalesce(F.col("_near") == F.min("_near").over(Window.partitionBy("tenant", "trace_id", "family")), F.lit(False))
    caller = F.when(named, F.col("service")).when(called & own, F.col("parent.service")).when(called, "external")
    callee = F.when(named, F.col("_peer.callee")).when(called, F.col("service"))
    kind = F.when(named, F.col("_peer.protocol")).when(called & own, F.col("parent._protocol")).when(called, "unknown")
    rows = rows.withColumns({"caller": caller, "callee": callee})
    return rows.withColumn("protocol", F.when((F.col("caller") != "") & (F.col("caller") == F.col("callee")), "internal").otherwise(kind)).drop("_near")


def edges(called: DataFrame, *, width_ns: int | None = None) -> DataFrame:
    """Calls, errors (by status only), durations, histogram, first and last sighting of each edge, whole or by bucket."""
    key = list(EDGE)
    if width_ns:
        called, key = called.withColumn("bucket_ns", F.col("received_ns") - F.pmod("received_ns", F.lit(width_ns))), [*EDGE, "bucket_ns"]
    return called.groupBy(*key).agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.sum("duration_ns").alias("duration_sum_ns"), latency.hist(F.col("duration_ns")).alias("hist"), F.min("received_ns").alias("first_ns"), F.max("received_ns").alias("last_ns"))


def edge_operations(called: DataFrame, *, n: int = 5) -> DataFrame:
    """The n most called operations of each edge: calls, errors, longest duration, and an approximate p99."""
    ops = called.groupBy(*EDGE, "operation").agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.max("duration_ns").alias("max_ns"), F.percentile_approx("duration_ns", 0.99).alias("p99_ns"))
    rank = F.row_number().over(Window.partitionBy(*EDGE).orderBy(F.desc("calls"), "operation"))
    return ops.withColumn("rank", rank).where(F.col("rank") <= n)


def edges_in_window(edge: DataFrame, *, start_ns: int, end_ns: int) -> DataFrame:
    return edge.where((F.col("last_ns") >= start_ns) & (F.col("first_ns") <= end_ns))


def new_edges(called: DataFrame, *, quiet_ns: int = 24 * 3600 * SECOND) -> DataFrame:
    """Sightings of an edge that are its first, or follow more than ``quiet_ns`` of silence.

    In a bucket of that width there is no such silence, so the first and the last sighting in each are enough: the busiest
    edge costs a row for each bucket.
    """
    buckets = called.groupBy(*EDGE, F.floor(F.col("received_ns") / F.lit(quiet_ns)).alias("bucket")).agg(F.min("received_ns").alias("at_ns"), F.max("received_ns").alias("last_ns"))
    rows = buckets.withColumn("before_ns", F.lag("last_ns").over(Window.partitionBy(*EDGE).orderBy("bucket")))
    return rows.where(F.col("before_ns").isNull() | (F.col("at_ns") - F.col("before_ns") > quiet_ns)).select(*EDGE, "at_ns", "before_ns")


def vanished_edges(edge: DataFrame, *, now_ns: int, after_ns: int = 3600 * SECOND) -> DataFrame:
    return edge.where(F.lit(now_ns) - F.col("last_ns") > after_ns)


def capped(edge: DataFrame, *, most: int = 20_000) -> DataFrame:
    """The hottest edges of each tenant: most calls, then latest, then latest to appear."""
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("calls"), F.desc("last_ns"), F.desc("first_ns"), "caller", "callee", "protocol"))
    return edge.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def snapshot(edge: DataFrame) -> DataFrame:
    """Edges, services and calls of each tenant's graph."""
    ends = edge.select("tenant", F.explode(F.array("caller", "callee")).alias("service"), F.lit(0).alias("edges"), F.lit(0).cast("bigint").alias("calls"))
    own = edge.select("tenant", F.lit(None).cast("string").alias("service"), F.lit(1).alias("edges"), "calls")
    return ends.unionByName(own).groupBy("tenant").agg(F.sum("edges").alias("edges"), F.count_distinct("service").alias("services"), F.sum("calls").alias("calls"))


def between_services(edge: DataFrame) -> DataFrame:
    """Edges from one service to another: ``external``, databases and topics, which many services share, carry no hops."""
    return edge.where((F.col("caller") != "external") & (F.col("caller") != F.col("callee")) & ~F.col("protocol").isin("db", "messaging"))


def _links(edge: DataFrame, direction: str) -> DataFrame:
    down = edge.select("tenant", F.col("caller").alias("a"), F.col("callee").alias("b"))
    up = edge.select("tenant", F.col("callee").alias("a"), F.col("caller").alias("b"))
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction].distinct()


def neighbours(edge: DataFrame) -> DataFrame:
    """(tenant, service, around): the services next to each, in either direction, in order."""
    return _links(edge, "both").groupBy("tenant", F.col("a").alias("service")).agg(F.array_sort(F.collect_set("b")).alias("around"))


def distances(edge: DataFrame, *, hops: int = 2, direction: str = "both", start: DataFrame | None = None) -> DataFrame:
    """(tenant, service, other, hops): the fewest hops, up to ``hops``, from each service, or from those in ``start``."""
    links = cut(_links(edge, direction))  # read at every hop
    seen = (start if start is not None else links.select("tenant", F.col("a").alias("service")).distinct()).select("tenant", "service", F.col("service").alias("other"), F.lit(0).alias("hops"))
    frontier = seen
    for k in range(1, hops + 1):
        step = frontier.join(links, (frontier["tenant"] == links["tenant"]) & (frontier["other"] == links["a"])).select(frontier["tenant"], "service", F.col("b").alias("other")).distinct()
        frontier = step.join(seen, ["tenant", "service", "other"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def neighbors(edge: DataFrame, *, tenant: str, service: str, hops: int = 1, direction: str = "both") -> DataFrame:
    """Services within ``hops`` of a service, the nearest first."""
    own = edge.where(F.col("tenant") == tenant)
    start = own.select(F.lit(tenant).alias("tenant"), F.lit(service).alias("service")).limit(1)
    return distances(own, hops=hops, direction=direction, start=start).where("hops > 0").select("other", "hops")


def export(edge: DataFrame) -> DataFrame:
    """Lines of a DOT graph, an edge each."""
    return edge.select("tenant", F.format_string('"%s" -> "%s" [protocol=%s calls=%d]', "caller", "callee", "protocol", "calls").alias("line"))
