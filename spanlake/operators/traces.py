"""Operators on whole traces."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(spans: DataFrame, *, arrival: str = "received_ns") -> DataFrame:
    """One row per trace: services, errors, root, longest span, first and last arrival, spans.

    The root is the first span without a parent, else the first span; the duration is that of the longest span.
    """
    order = F.struct((~F.col("is_root")).alias("child"), F.col(arrival), F.col("span_id"))
    root = F.min_by(F.struct("service", "name"), order)
    return spans.groupBy("tenant", "trace_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("service") != "", F.col("service")))).alias("services"), F.count_if("is_error").alias("error_count"),
        root["service"].alias("root_service"), root["name"].alias("root_name"), F.max("duration_ns").alias("duration_ns"),
        F.min(arrival).alias("start_ns"), F.max(arrival).alias("end_ns"), F.count("*").alias("span_count"),
    )


def _signature(spans) -> str:
    """md5 over the edges of one trace in depth-first order: caller service, operation, callee service, operation. ``spans``:
    (span_id, parent_span_id, service, name) by start and span id."""
    own = {s[0]: s for s in spans}
    children, roots = {}, []
    for s in own.values():
        (children.setdefault(s[1], []) if s[1] in own else roots).append(s)
    digest, stack, seen = hashlib.md5(), [(None, r) for r in reversed(roots)], set()
    while stack:
        above, s = stack.pop()
        if s[0] in seen:
            continue
        seen.add(s[0])
        if above is not None:
            digest.update(f"{above[2]}\0{above[3]}\0{s[2]}\0{s[3]}\0".encode())
        stack.extend((s, c) for c in reversed(children.get(s[0], [])))
    return digest.hexdigest()


def path_signature(spans: DataFrame, *, whole_traces: bool = False) -> DataFrame:
    """(tenant, trace_id, path_signature). Orphans are further roots, sorted with the real ones by (start, span id); spans in
    a parent cycle are not visited; a trace without edges has the hash of the empty string.

    Spans are dealt by trace, unless ``whole_traces`` says that they are, sorted, and read once; a worker holds those of one trace, all of them.
    """

    def sign(batches):
        import pyarrow as pa

        def rows(out):
            return pa.RecordBatch.from_pydict({"tenant": [x[0] for x in out], "trace_id": [x[1] for x in out], "path_signature": [x[2] for x in out]}, schema)

        schema = pa.schema([("tenant", pa.string()), ("trace_id", pa.string()), ("path_signature", pa.string())])
        key, own = None, []
        for batch in batches:
            out = []
            for tenant, trace, *span in zip(*(batch.column(c).to_pylist() for c in ("tenant", "trace_id", "span_id", "parent_span_id", "service", "name"))):
                if (tenant, trace) != key:
                    if own:
                        out.append((*key, _signature(own)))
                    key, own = (tenant, trace), []
                own.append(span)
            yield rows(out)
        if own:
            yield rows([(*key, _signature(own))])

    dealt = spans.select("tenant", "trace_id", "start_ns", "span_id", "parent_span_id", "service", "name")
    dealt = dealt if whole_traces else dealt.repartition("tenant", "trace_id")
    return dealt.sortWithinPartitions("tenant", "trace_id", "start_ns", "span_id").mapInArrow(sign, "tenant string, trace_id string, path_signature string")


def signature_stats(signed: DataFrame, *, time_col: str = "start_ns") -> DataFrame:
    """First and last sighting of each path signature of a tenant, and its traces."""
    return signed.groupBy("tenant", "path_signature").agg(F.min(time_col).alias("first_ns"), F.max(time_col).alias("last_ns"), F.count("*").alias("traces"))


def search(traces: DataFrame, *, tenant: str, path_signature: str | None = None, errors_only: bool = False, root_service: str | None = None, min_duration_ns: int = 0, start_ns: int | None = None, end_ns: int | None = None, limit: int = 100) -> DataFrame:
    """By signature, else errors in the window, else root service and duration (longest first, window ignored), else window."""
    rows = traces.where(F.col("tenant") == tenant)
    window = F.lit(True)
    window = window & (F.col("start_ns") >= start_ns) if start_ns is not None else window
    window = window & (F.col("start_ns") <= end_ns) if end_ns is not None else window
    order = [F.desc("start_ns"), "trace_id"]
    if path_signature is not None:
        rows = rows.where(F.col("path_signature") == path_signature)
    elif errors_only:
        rows = rows.where(window & (F.col("error_count") > 0))
    elif root_service is not None:
        rows, order = rows.where((F.col("root_service") == root_service) & (F.col("duration_ns") >= min_duration_ns)), [F.desc("duration_ns"), "trace_id"]
    else:
        rows = rows.where(window)
    return rows.orderBy(*order).limit(limit)


def read(spans: DataFrame, *, tenant: str, trace_id: str, tombstones: DataFrame | None = None) -> DataFrame:
    """The spans of one trace, unless it is erased."""
    rows = spans.where((F.col("tenant") == tenant) & (F.col("trace_id") == trace_id))
    return rows.join(tombstones, ["tenant", "trace_id"], "left_anti") if tombstones is not None else rows


def visible(traces: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of traces that are not erased."""
    return traces.join(tombstones.select("tenant", "trace_id"), ["tenant", "trace_id"], "left_anti")


def assemble(spans: DataFrame, *, idle_ns: int = 8_000_000_000, hard_ns: int = 30_000_000_000, arrival: str = "received_ns") -> DataFrame:
    """Spans with the number of their fragment, from 1: a fragment ends after ``idle_ns`` without arrivals, or ``hard_ns``
    after its first span. Spans are dealt by trace, sorted by arrival and span id, and numbered as they are read, batch by
    batch: no trace is held as a whole."""

    def number(batches):
        import pyarrow as pa

        key, first, last, n = None, 0, 0, 0
        for batch in batches:
            out = []
            for tenant, trace, at in zip(*(batch.column(c).to_pylist() for c in ("tenant", "trace_id", arrival))):
                if (tenant, trace) != key:
                    key, first, n = (tenant, trace), at, 1
                elif at - last >= idle_ns or at - first >= hard_ns:
                    first, n = at, n + 1
                last = at
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "fragment"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields if f.name != "fragment") + ", fragment int"
    return spans.drop("fragment").repartition("tenant", "trace_id").sortWithinPartitions("tenant", "trace_id", arrival, "span_id").mapInArrow(number, fields)
