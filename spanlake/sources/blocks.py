"""Blocks of kept traces as files under a manifest: appended, expired as wholes, and small ones put together.

The manifest has a row for each file: tenant, tier, hour, path, bytes, spans, first_ns, last_ns, sealed_ns. Every change writes
the next version of it, so readers see the blocks before or after it and never between. Files themselves never change; the
driver handles their names and sizes, not their rows.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.operators import lifecycle
from spanlake.sources.files import hour, write_placed
from spanlake.sources.versions import complete, delete, names, place

BLOCK = ["tenant", "tier", "hour"]
#: A block's wanted size in bytes.
TARGET = 512 * 1024 * 1024


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    numbers = complete(spark, f"{folder}/manifest", "version")
    return spark.read.parquet(place(f"{folder}/manifest", "version", numbers[-1])) if numbers else None


def append(spans: DataFrame, kept: DataFrame, folder: str) -> None:
    """Spans of the traces in ``kept`` (as for ``write_blocks``), as files of their own."""
    append_placed(spans.join(kept.select("tenant", "trace_id", "tier", hour("start_ns").alias("hour")), ["tenant", "trace_id"]), folder, whole_traces=False)


def append_placed(rows: DataFrame, folder: str, *, whole_traces: bool = True) -> None:
    """Spans with tier and hour (as for ``write_placed``), as files of their own."""
    spark, number = rows.sparkSession, _next(rows.sparkSession, folder)
    home = place(f"{folder}/files", "write", number)
    write_placed(rows, home, whole_traces=whole_traces)
    old, new = manifest(spark, folder), _files(spark, folder, home)
    if new is not None:
        _swap(new if old is None else old.unionByName(new), folder, number)


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """All spans of the blocks that count; None without any."""
    rows = manifest(spark, folder)
    return _open(spark, folder, [r["path"] for r in rows.select("path").collect()]) if rows is not None else None


def expire(spark: SparkSession, folder: str, *, retention_ns: int, now_ns: int) -> None:
    """Lets blocks go as wholes that were sealed ``retention_ns`` ago or longer; ``vacuum`` deletes their files."""
    rows = manifest(spark, folder)
    if rows is not None:
        gone = lifecycle.expired_blocks(rows, retention_ns=retention_ns, now_ns=now_ns).select("path")
        _swap(rows.join(gone, "path", "left_anti"), folder, _next(spark, folder))


def bins(files: DataFrame, *, target: int = TARGET) -> DataFrame:
    """``files`` that are to be put together, with the number of their ``bin`` within their block.

    Files under ``target`` bytes are filled into bins by size; a bin begins with the first file after each multiple of ``target``,
    so none reaches twice the target. A file that is large enough, or alone in its bin, stays as it is.
    """
    own = Window.partitionBy(*BLOCK).orderBy("bytes", "path")
    before = F.coalesce(F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.where(F.col("bytes") < target).withColumn("bin", F.floor(before / F.lit(target)).cast("int"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*BLOCK, "bin"))).where("n > 1").drop("n")


def compact(spark: SparkSession, folder: str, *, target: int = TARGET) -> int:
    """Puts small files of a block together, a bin a file; the number of files that went in."""
    rows = manifest(spark, folder)
    planned = bins(rows, target=target).select("path", "bin") if rows is not None else None
    paths = [r["path"] for r in planned.collect()] if planned is not None else []
    if not paths:
        return 0
    number = _next(spark, folder)
    home = place(f"{folder}/files", "write", number)
    own = _open(spark, folder, paths, F.col("_metadata.file_path").alias("path")).join(planned, "path").drop("path")
    own = own.repartition(*BLOCK, "bin").sortWithinPartitions(*BLOCK, "bin", "trace_id", "start_ns")
    own.drop("bin").write.mode("overwrite").partitionBy(*BLOCK).option("compression", "zstd").parquet(home)
    _swap(rows.join(planned, "path", "left_anti").unionByName(_files(spark, folder, home)), folder, number)
    return len(paths)


def vacuum(spark: SparkSession, folder: str) -> None:
    """Deletes files and manifests that the latest manifest doesn't need; no reader may be at work with an older one."""
    numbers = complete(spark, f"{folder}/manifest", "version")
    if not numbers:
        return
    live = {unquote(r["path"]).split("/write=")[-1] for r in manifest(spark, folder).select("path").collect()}
    used = {p.split("/")[0] for p in live}
    for n in names(spark, f"{folder}/files"):
        if int(n.removeprefix("write=")) <= numbers[-1] and n.removeprefix("write=") not in used:
            delete(spark, f"{folder}/files/{n}")
    for n in numbers[:-1]:
        delete(spark, place(f"{folder}/manifest", "version", n))


def _next(spark: SparkSession, folder: str) -> int:
    return max(complete(spark, f"{folder}/manifest", "version"), default=0) + 1


def _open(spark: SparkSession, folder: str, paths: list[str], *more) -> DataFrame | None:
    if not paths:
        return None
    rows = spark.read.option("basePath", f"{folder}/files").parquet(*map(unquote, paths))
    return rows.select("*", *more).drop("write")


def _files(spark: SparkSession, folder: str, home: str) -> DataFrame | None:
    """A row for each file of one write: its size, and of its rows only the times. A write seals a block as a whole, with its last span."""
    if not any("=" in n for n in names(spark, home)):
        return None
    rows = spark.read.option("basePath", f"{folder}/files").parquet(home)
    each = rows.groupBy(*BLOCK, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    each = each.agg(F.count("*").alias("spans"), F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"))
    return each.withColumn("sealed_ns", F.max("last_ns").over(Window.partitionBy(*BLOCK)))


def _swap(rows: DataFrame, folder: str, number: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(place(f"{folder}/manifest", "version", number))
