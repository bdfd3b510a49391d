"""Queries that search spans over stored postings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanlake.operators import postings
from spanlake.operators.lineage import folder
from spanlake.plans import fixtures
from spanlake.plans.base import NS, S, base_spans, query

_SHOWN = "trace_id, span_id, service, name, start_ns"
_LATEST = "ORDER BY start_ns DESC, trace_id, span_id LIMIT 100"


def _stored(spark, sf_dir) -> str:
    path = f"{folder(spark)}/postings-{uuid.uuid4().hex}"
    postings.write(base_spans(spark, sf_dir), path)
    return path


_POSTINGS = """listed AS (SELECT 'attr' AS kind, tenant, start_ns, 'peer.service' AS key, peer AS value FROM spans UNION ALL SELECT 'attr', tenant, start_ns, 'http.request.method', http FROM spans
  UNION ALL SELECT 'attr', tenant, start_ns, 'db.system', db FROM spans UNION ALL SELECT 'attr', tenant, start_ns, 'retry.count', retries FROM spans UNION ALL SELECT 'name', tenant, start_ns, '', name FROM spans
  UNION ALL SELECT 'service', tenant, start_ns, '', service FROM spans UNION ALL SELECT 'time', tenant, start_ns, '', '' FROM spans
  UNION ALL SELECT 'error', tenant, start_ns, '', md5(service || chr(1) || name || chr(1)) FROM spans WHERE is_error)"""


@query("SELECT kind, tenant, key, value, start_ns - start_ns % 10000000000 AS bucket_ns, count(*) AS spans, min(start_ns) AS first_ns FROM listed WHERE value IS NOT NULL GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY kind, tenant, key, value, start_ns - start_ns % 10000000000"), views=(fixtures.SPANS_SQL, _POSTINGS))
def span_postings(spark, sf_dir):
    """Spans under each value and bucket of ten seconds, of postings that were written and read again."""
    rows = spark.read.parquet(f"{_stored(spark, sf_dir)}/postings")
    return rows.groupBy("kind", "tenant", "key", "value", "bucket_ns").agg(F.count("*").alias("spans"), F.min("start_ns").alias("first_ns"))


@query(f"SELECT {_SHOWN} FROM spans WHERE tenant = 'tenant-1' AND peer = 'svc-4' {_LATEST}")
def search_by_attribute(spark, sf_dir):
    return postings.search(spark, _stored(spark, sf_dir), tenant="tenant-1", attribute=("peer.service", "svc-4"), start_ns=2**62)


@query(f"SELECT {_SHOWN} FROM spans WHERE tenant = 'tenant-1' AND is_error AND service = 'svc-3' AND name = 'op-1' {_LATEST}")
def search_by_signature(spark, sf_dir):
    """The signature is looked up among those of the service's errors."""
    from spanlake.operators import anomaly

    own = base_spans(spark, sf_dir).where("tenant = 'tenant-1' and service = 'svc-3' and name = 'op-1' and is_error").select(anomaly.signature().alias("s")).first()
    return postings.search(spark, _stored(spark, sf_dir), tenant="tenant-1", error=own["s"] if own else "")


@query(f"SELECT {_SHOWN} FROM spans WHERE tenant = 'tenant-2' AND start_ns BETWEEN {NS + 10 * S} AND {NS + 1800 * S} AND (name ILIKE '%VC-_%' OR peer ILIKE '%VC-_%' OR http ILIKE '%VC-_%' OR db ILIKE '%VC-_%' OR retries ILIKE '%VC-_%') {_LATEST}")
def search_by_text(spark, sf_dir):
    """Any case, with a wildcard, in names and attributes."""
    return postings.search(spark, _stored(spark, sf_dir), tenant="tenant-2", text="VC-_", start_ns=NS + 10 * S, end_ns=NS + 1800 * S)


@query(f"SELECT {_SHOWN} FROM spans WHERE tenant = 'tenant-2' AND service = 'svc-7' AND name = 'op-0' AND start_ns >= {NS + 10 * S} {_LATEST}")
def search_by_service(spark, sf_dir):
    return postings.search(spark, _stored(spark, sf_dir), tenant="tenant-2", service="svc-7", operation="op-0", start_ns=NS + 10 * S)


@query(f"SELECT {_SHOWN} FROM spans WHERE tenant = 'tenant-0' AND start_ns BETWEEN {NS + 15 * S} AND {NS + 95 * S} {_LATEST}")
def search_by_time(spark, sf_dir):
    return postings.search(spark, _stored(spark, sf_dir), tenant="tenant-0", start_ns=NS + 15 * S, end_ns=NS + 95 * S)
