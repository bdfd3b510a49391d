"""Logs and exemplars from line-delimited JSON, and blocks of kept traces as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "ts timestamp, trace_id string, span_id string, service string, level string, body string, attrs map<string, string>"
EXEMPLAR = "ts timestamp, trace_id string, span_id string, service string, operation string, value double, labels map<string, string>"
HOUR = 3600 * 1_000_000_000


def read_ndjson(spark: SparkSession, folder: str, schema: str = LOG, *, pattern: str = "*.ndjson") -> DataFrame:
    """Rows of ``folder/tenant=<tenant>/*.ndjson``, or other names, with their tenant. Blank and malformed lines are skipped; no folder gives no rows."""
    try:
        rows = spark.read.schema(f"{schema}, tenant string").option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, tenant string")
    return rows


def write_blocks(spans: DataFrame, kept: DataFrame, path: str) -> None:
    """Spans of the traces in ``kept`` (tenant, trace_id, tier, start_ns), as zstd Parquet by tenant, tier and hour of the trace's start."""
    place = kept.select("tenant", "trace_id", "tier", hour("start_ns").alias("hour"))
    write_placed(spans.join(place, ["tenant", "trace_id"]), path, whole_traces=False)


def hour(start: str) -> Column:
    return F.floor(F.col(start) / HOUR).cast("long")


def write_placed(rows: DataFrame, path: str, *, whole_traces: bool = True) -> None:
    """Spans with tier and hour as blocks. A busy hour goes to several tasks, so that no task holds a whole block, a trace stays in one
    file, and there are about as many files as blocks and tasks together.

    With ``whole_traces``, spans that are dealt by trace already, they are dealt by block, and what is too large is split between
    the tasks that the spans come from; else they are dealt by ranges of block and trace, for which they are read twice.
    """
    rows = rows.hint("rebalance", "tenant", "tier", "hour") if whole_traces else rows.repartitionByRange("tenant", "tier", "hour", "trace_id")
    rows.sortWithinPartitions("tenant", "tier", "hour", "trace_id", "start_ns").write.partitionBy("tenant", "tier", "hour").option("compression", "zstd").parquet(path)


def manifest(blocks: DataFrame) -> DataFrame:
    """A row for each block: traces, spans, time range, and a checksum that doesn't depend on the rows' order."""
    return blocks.groupBy("tenant", "tier", "hour").agg(F.count_distinct("trace_id").alias("traces"), F.count("*").alias("spans"), F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"), F.bit_xor(F.xxhash64("trace_id", "span_id", "start_ns", "end_ns")).alias("checksum"))
