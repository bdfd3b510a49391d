"""Span search over postings: a row for each span under each of its values, stored sorted, and trigrams of the values.

A posting has the columns kind, tenant, key, value, bucket_ns, start_ns, trace_id, span_id, service, name: all that a page of
results shows, so that a search reads no spans. Kinds are ``attr`` (by key), ``name``, ``service``, ``error`` (the signature of
a failed span) and ``time``. Postings are made of spans without duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.operators.anomaly import signature

BUCKET = 10_000_000_000
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Values that are put into a scan's filter; more are joined. Either way the same rows.
PUSHED = 200


def _fold(text: Column) -> Column:
    return F.translate(text, _A, _Z)


def rows(spans: DataFrame, *, keys: tuple[str, ...] | None = None, time_col: str = "start_ns") -> DataFrame:
    """Postings of ``spans``; with ``keys``, of these attributes only. A null value gives none."""
    one = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    none = F.lit("")
    attrs = F.transform(F.map_entries("attrs"), lambda e: one("attr", e["key"], e["value"]))
    fixed = [one("name", none, F.coalesce("name", none)), one("service", none, F.coalesce("service", none)), one("time", none, none), one("error", none, F.when(F.col("is_error"), signature()))]
    listed = F.concat(F.coalesce(attrs, F.array().cast("array<struct<kind:string,key:string,value:string>>")), F.array(*fixed))
    at = F.col(time_col)
    out = spans.select("tenant", F.explode(listed).alias("p"), (at - F.pmod(at, F.lit(BUCKET))).alias("bucket_ns"), at.alias("start_ns"), "trace_id", "span_id", "service", "name")
    out = out.select("p.kind", "tenant", "p.key", "p.value", "bucket_ns", "start_ns", "trace_id", "span_id", "service", "name").where("value is not null")
    return out.where((F.col("kind") != "attr") | F.col("key").isin(*keys)) if keys else out


def grams(values: DataFrame) -> DataFrame:
    """(tenant, gram, kind, key, value): every run of three characters of a value, A-Z in lower case."""
    low = _fold(F.col("value"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("value") - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return values.where(F.char_length("value") >= 3).select("tenant", F.explode(F.array_distinct(cut)).alias("gram"), "kind", "key", "value")


def write(spans: DataFrame, folder: str, *, mode: str = "append", **options) -> None:
    """Postings, the distinct values of names and attributes, and their trigrams, in ``folder``.

    Postings are dealt out by ranges of value, bucket and trace, so that a value that most spans have is spread over as many
    files as it needs; sorted within, so that a search skips what it doesn't ask for. Batches may be appended.
    """
    own = rows(spans, **options)
    order = ["kind", "tenant", "key", "value", "bucket_ns", "trace_id"]
    own.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("kind").parquet(f"{folder}/postings")
    spark = spans.sparkSession
    # The batch's values are read back from its postings: two columns of two kinds, not the spans again.
    found = values(own)
    found.write.mode(mode).parquet(f"{folder}/values")
    grams(values(spark.read.parquet(f"{folder}/values"))).repartitionByRange("tenant", "gram", "value").sortWithinPartitions("tenant", "gram", "value").write.mode("overwrite").parquet(f"{folder}/grams")


def values(postings: DataFrame) -> DataFrame:
    """Distinct values that text search looks at."""
    return postings.where("kind in ('attr', 'name')").select("tenant", "kind", "key", "value").distinct()


def matching(spark: SparkSession, folder: str, *, tenant: str, text: str) -> DataFrame:
    """(kind, key, value): values that hold ``text``, whatever the case of A-Z; ``%`` and ``_`` are wildcards.

    A value must have all trigrams of the text's literal parts; those that do are compared. A text without a part of three
    characters is compared with all distinct values.
    """
    low = text.translate(str.maketrans(_A, _Z))
    parts = low.replace("_", "%").split("%")
    wanted = sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})
    if wanted:
        held = spark.read.parquet(f"{folder}/grams").where((F.col("tenant") == tenant) & F.col("gram").isin(*wanted))
        found = held.groupBy("kind", "key", "value").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).drop("n")
    else:
        found = spark.read.parquet(f"{folder}/values").where(F.col("tenant") == tenant).select("kind", "key", "value").distinct()
    return found.where(_fold(F.col("value")).like("%" + low.replace("\\", "\\\\") + "%"))


def search(spark: SparkSession, folder: str, *, tenant: str, attribute: tuple[str, str] | None = None, error: str | None = None, text: str | None = None, service: str | None = None, operation: str | None = None, start_ns: int | None = None, end_ns: int | None = None, limit: int = 100) -> DataFrame:
    """The latest ``limit`` spans by attribute, else error signature, else text, else service, else time (trace_id, span_id,
    service, name, start_ns). The attribute's path ignores the window; only that of a service looks at ``operation``."""
    at = spark.read.parquet(f"{folder}/postings").where(F.col("tenant") == tenant)
    if attribute is None:
        at = at.where((F.col("start_ns") >= start_ns) & (F.col("bucket_ns") > start_ns - BUCKET)) if start_ns is not None else at
        at = at.where((F.col("start_ns") <= end_ns) & (F.col("bucket_ns") <= end_ns)) if end_ns is not None else at
    if attribute is not None:
        at = at.where((F.col("kind") == "attr") & (F.col("key") == attribute[0]) & (F.col("value") == attribute[1]))
    elif error is not None:
        at = at.where((F.col("kind") == "error") & (F.col("value") == error))
    elif text is not None:
        at = at.where("kind in ('attr', 'name')")
        hits = matching(spark, folder, tenant=tenant, text=text)
        few = hits.limit(PUSHED + 1).collect()
        if len(few) <= PUSHED:
            at = at.where(F.col("value").isin(*{r["value"] for r in few}))
        else:
            at = at.join(hits, ["kind", "key", "value"], "left_semi")
        # A span may have several such values. The latest of all are among the latest of each.
        latest = F.row_number().over(Window.partitionBy("kind", "key", "value").orderBy(F.desc("start_ns"), "trace_id", "span_id"))
        at = at.withColumn("place", latest).where(F.col("place") <= limit).dropDuplicates(["trace_id", "span_id"])
    elif service is not None:
        at = at.where((F.col("kind") == "service") & (F.col("value") == service))
        at = at.where(F.col("name") == operation) if operation else at
    else:
        at = at.where("kind = 'time'")
    return at.select("trace_id", "span_id", "service", "name", "start_ns").orderBy(F.desc("start_ns"), "trace_id", "span_id").limit(limit)
