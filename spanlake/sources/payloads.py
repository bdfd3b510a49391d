"""Span payloads to span rows, and the limits that delivered spans keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Zipkin v2 span. Times are microseconds.
ZIPKIN = "traceId string, id string, parentId string, name string, kind string, timestamp bigint, duration bigint, debug boolean, localEndpoint struct<serviceName: string>, tags map<string, string>"
#: Span kinds by Zipkin's name (fixed values); others are 0.
KINDS = (("SERVER", 2), ("CLIENT", 3), ("PRODUCER", 4), ("CONSUMER", 5))
#: Attributes of a span, bytes of a key and of a value (fixed values).
MAX_ATTRS, MAX_KEY, MAX_VALUE = 128, 256, 4096
#: Spans and bytes of a batch (fixed values).
MAX_SPANS, MAX_BYTES = 10_000, 4 * 1024 * 1024
_ATTRS = "array<struct<key: string, value: variant>>"
_SPAN = (
    "traceId: string, spanId: string, parentSpanId: string, traceState: string, flags: int, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, "
    f"attributes: {_ATTRS}, droppedAttributesCount: int, events: array<struct<timeUnixNano: string, name: string, attributes: {_ATTRS}>>, droppedEventsCount: int, "
    f"links: array<struct<traceId: string, spanId: string, attributes: {_ATTRS}>>, droppedLinksCount: int, status: struct<code: int, message: string>"
)
#: An OTLP trace request in JSON. Times are nanoseconds, as strings.
OTLP = f"struct<resourceSpans: array<struct<resource: struct<attributes: {_ATTRS}>, scopeSpans: array<struct<scope: struct<name: string, version: string, attributes: {_ATTRS}>, spans: array<struct<{_SPAN}>>>>>>>"
#: Resource attributes that become columns (fixed values).
PROMOTED = (("service", "service.name"), ("service_version", "service.version"), ("namespace", "service.namespace"), ("env", "deployment.environment.name"))


def normalize_zipkin(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Span rows of JSON payloads, each an array of Zipkin spans or a single one; payloads that don't parse give no rows.

    Trace ids of 16 characters are padded to 32, microseconds become nanoseconds, ``debug`` is bit 0 of the flags, tags are
    attributes. The status stays 0: the format has none.
    """
    body = F.trim(F.col(column))
    wrapped = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    z = payloads.select(*keep, F.explode(F.from_json(wrapped, f"array<struct<{ZIPKIN}>>")).alias("z"))
    kind = F.lit(0)
    for name, number in KINDS:
        kind = F.when(F.upper("z.kind") == name, number).otherwise(kind)
    start = F.coalesce("z.timestamp", F.lit(0)) * 1000
    return z.select(
        *keep,
        F.lpad(F.lower("z.traceId"), 32, "0").alias("trace_id"),
        F.lower("z.id").alias("span_id"),
        F.lower("z.parentId").alias("parent_span_id"),
        F.coalesce("z.localEndpoint.serviceName", F.lit("")).alias("service"),
        F.col("z.name").alias("name"),
        kind.alias("kind"),
        start.alias("start_ns"),
        (start + F.coalesce("z.duration", F.lit(0)) * 1000).alias("end_ns"),
        F.lit(0).alias("status_code"),
        F.coalesce("z.debug", F.lit(False)).cast("int").alias("flags"),
        F.coalesce("z.tags", F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def apply_limits(spans: DataFrame, *, attrs: int = MAX_ATTRS, key_bytes: int = MAX_KEY, value_bytes: int = MAX_VALUE, strict: bool = False) -> DataFrame:
    """``spans`` with at most ``attrs`` attributes, the first in the order of their keys; keys that are too long go, values are cut.

    Adds ``dropped_attrs`` (attributes that went) and ``truncated`` (whether anything was cut or went). With ``strict`` such
    spans are left out instead. A cut inside a character leaves a replacement character.
    """
    keys = F.filter(F.slice(F.array_sort(F.map_keys("attrs")), 1, attrs), lambda k: F.octet_length(k) <= key_bytes)

    def value(k):
        v = F.element_at("attrs", k)
        return F.when(F.octet_length(v) > value_bytes, F.make_valid_utf8(F.substring(v.cast("binary"), 1, value_bytes).cast("string"))).otherwise(v)

    long = F.exists(F.map_values("attrs"), lambda v: F.octet_length(v) > value_bytes)
    kept = spans.withColumn("_keys", keys).withColumn("dropped_attrs", F.size("attrs") - F.size("_keys"))
    kept = kept.withColumn("truncated", (F.col("dropped_attrs") > 0) | F.coalesce(long, F.lit(False)))
    if strict:
        return kept.where("not truncated").drop("_keys")
    return kept.withColumn("attrs", F.map_from_arrays("_keys", F.transform("_keys", value))).drop("_keys")


def _attributes(pairs) -> Column:
    """A map of attributes, each a variant with its type as written ({"stringValue": ...}); of a key that repeats, the last."""
    own = F.coalesce(pairs, F.array().cast(_ATTRS))
    last = F.filter(own, lambda x, i: ~F.exists(F.slice(own, i + 2, F.greatest(F.size(own), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.filter(last, lambda x: x["key"].isNotNull()))


def text_of(value: Column) -> Column:
    """An attribute's value as text, whatever its type."""
    kinds = ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue")
    return F.coalesce(*(F.try_variant_get(value, f"$.{k}", "string") for k in kinds), F.to_json(value))


def _bad_id(column: str, size: int) -> Column:
    c = F.col(column)
    return F.coalesce(~c.rlike(f"^[0-9a-fA-F]{{{size}}}$") | c.rlike("^0*$"), F.lit(True))


def otlp_spans(batches: DataFrame, column: str = "payload", keep: tuple[str, ...] = ("tenant", "batch_id")) -> DataFrame:
    """Rows of all spans in OTLP requests, with ``malformed``: an id of a wrong length or of zeros only. A batch that doesn't
    parse, or has no span, is one row without ids."""
    parsed = batches.select(*keep, F.octet_length(column).alias("batch_bytes"), F.from_json(column, OTLP, {"mode": "PERMISSIVE"}).alias("r"))
    resources = parsed.select(*keep, "batch_bytes", F.explode_outer("r.resourceSpans").alias("rs"))
    scopes = resources.select(*keep, "batch_bytes", "rs.resource", F.explode_outer("rs.scopeSpans").alias("ss"))
    s = scopes.select(*keep, "batch_bytes", "resource", "ss.scope", F.explode_outer("ss.spans").alias("s"))
    s = s.withColumn("resource_attrs", _attributes(F.col("resource.attributes")))
    parent = F.nullif("s.parentSpanId", F.lit(""))
    rows = s.select(
        *keep, "batch_bytes",
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.lower(parent).alias("parent_span_id"),
        F.col("s.traceState").alias("trace_state"), F.coalesce("s.flags", F.lit(0)).alias("flags"), F.col("s.name").alias("name"), F.coalesce("s.kind", F.lit(0)).alias("kind"),
        F.coalesce(F.col("s.startTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("start_ns"), F.coalesce(F.col("s.endTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("end_ns"),
        F.coalesce("s.status.code", F.lit(0)).alias("status_code"), F.col("s.status.message").alias("status_message"),
        *(text_of(F.try_element_at("resource_attrs", F.lit(key))).alias(name) for name, key in PROMOTED),
        _attributes(F.col("s.attributes")).alias("attrs"), "resource_attrs",
        F.struct(F.col("scope.name").alias("name"), F.col("scope.version").alias("version"), _attributes(F.col("scope.attributes")).alias("attrs")).alias("scope"),
        F.transform("s.events", lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].try_cast("bigint").alias("time_ns"), _attributes(e["attributes"]).alias("attrs"))).alias("events"),
        F.transform("s.links", lambda x: F.struct(x["traceId"].alias("trace_id"), x["spanId"].alias("span_id"), _attributes(x["attributes"]).alias("attrs"))).alias("links"),
        *(F.coalesce(f"s.dropped{n}Count", F.lit(0)).alias(f"dropped_{k}") for k, n in (("attrs", "Attributes"), ("events", "Events"), ("links", "Links"))),
    )
    bad = _bad_id("trace_id", 32) | _bad_id("span_id", 16) | (F.col("parent_span_id").isNotNull() & _bad_id("parent_span_id", 16))
    return rows.withColumn("malformed", bad)


def verdicts(spans: DataFrame, *, keep: tuple[str, ...] = ("tenant", "batch_id"), max_spans: int = MAX_SPANS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row for each batch of ``otlp_spans``: spans received, and the reason for which it is rejected as a whole, or null."""
    large = (F.max("batch_bytes") > max_bytes) | (F.count("span_id") > max_spans)
    return spans.groupBy(*keep).agg(F.count("span_id").alias("received"), F.when(large, "oversize").when(F.max("malformed"), "malformed").alias("reason"))


def normalize_otlp(batches: DataFrame, column: str = "payload", keep: tuple[str, ...] = ("tenant", "batch_id"), **limits) -> DataFrame:
    """Span rows of OTLP requests in JSON: resource, scope and span flattened, attributes of any type kept as they are. One bad
    span, too many spans or too many bytes reject the whole batch."""
    rows = otlp_spans(batches, column, keep)
    good = verdicts(rows, keep=keep, **limits).where("reason is null").select(*keep)
    return rows.join(good, list(keep), "left_semi").drop("malformed", "batch_bytes")


def reject_report(verdicts: DataFrame, *by: str) -> DataFrame:
    """Batches and spans by ``by`` and reason, ``accepted`` being one."""
    return verdicts.groupBy(*by, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("batches"), F.sum("received").alias("spans"))


def b3_to_traceparent(headers: str = "headers") -> Column:
    """``00-trace-span-flags`` of a map of b3 headers (names in lower case): the single header, else the X-B3 ones. Flags are
    01 for a sampled value of 1 or true; trace ids of 16 digits are padded. Null where ids are missing or malformed."""
    value = lambda k: F.lower(F.try_element_at(headers, F.lit(k)))
    single = F.split(value("b3"), "-")
    trace = F.coalesce(F.get(single, F.lit(0)), value("x-b3-traceid"))
    span = F.when(value("b3").isNotNull(), F.get(single, F.lit(1))).otherwise(value("x-b3-spanid"))
    sampled = F.when(value("b3").isNotNull(), F.get(single, F.lit(2))).otherwise(value("x-b3-sampled"))
    sound = trace.rlike("^([0-9a-f]{16}|[0-9a-f]{32})$") & span.rlike("^[0-9a-f]{16}$") & ~trace.rlike("^0*$") & ~span.rlike("^0*$")
    flags = F.when(sampled.isin("1", "true"), "01").otherwise("00")
    return F.when(sound, F.concat_ws("-", F.lit("00"), F.lpad(trace, 32, "0"), span, flags))


def envoy_edges(logs: DataFrame, column: str = "line", keep: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """(keep, caller, callee, status, duration_ms) of access-log lines with fields caller, upstream_cluster, response_code and
    duration, as ``name=value``; lines without both services give no row."""
    field = lambda k: F.regexp_extract(column, rf"\b{k}=([^\s]+)", 1)
    rows = logs.select(*keep, field("caller").alias("caller"), field("upstream_cluster").alias("callee"), field("response_code").try_cast("int").alias("status"), field("duration").try_cast("bigint").alias("duration_ms"))
    return rows.where("caller <> '' and callee <> ''")
