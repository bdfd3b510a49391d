"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast: at most this many rows of under 100 bytes each; beyond it the operators shuffle instead.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session in local mode may lack it: one machine runs everything there, so a temporary folder is shared too.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spanlake.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanlake-shared-")
        spark.conf.set("spanlake.shared.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The session's own folder in the shared one; all that it stores is in there."""
    folder = spark.conf.get("spanlake.run.dir", None)
    if not folder:
        folder = f"{shared_folder(spark)}/spanlake-{uuid.uuid4().hex}"
        spark.conf.set("spanlake.run.dir", folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete what this session has stored; frames that read it can't be used any more."""
    folder = spark.conf.get("spanlake.run.dir", None)
    if folder:
        _delete(spark, folder)
        spark.conf.unset("spanlake.run.dir")


def discard(*frames: DataFrame) -> None:
    """Delete ``stored`` frames that nothing will read again."""
    spark = frames[0].sparkSession
    for folder in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        _delete(spark, folder)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs restart from there when executors are lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most ``rows`` rows (they are counted first); else Spark chooses a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_group(rows: DataFrame, large: DataFrame, others: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined to groups with one row for each ``key``: to the few ``large`` ones by broadcast, so that a key which holds much
    of the table is not shuffled; to the others by a shuffle. The caller bounds the number of large ones by their share of the rows."""
    few = F.broadcast(large)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(others, key, how)
    return rows.join(few, key).unionByName(rest)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a null text as an empty one; other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_kind(rows: DataFrame) -> tuple[str, str]:
    """The type of ``id``, and the one that it has in Python workers. Whole numbers go there as text: pandas would make floats
    of a batch with a null, and alter ids over 2^53."""
    kind = rows.schema["id"].dataType.simpleString()
    return kind, "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def sent(rows: DataFrame) -> DataFrame:
    """``rows`` with the id as workers take it."""
    return rows.withColumn("id", F.col("id").cast(id_kind(rows)[1]))


def returned(rows: DataFrame, kind: str, *names: str) -> DataFrame:
    """``rows`` from workers with the ids of type ``kind`` again."""
    return rows.withColumns({n: F.col(n).cast(kind) for n in ("id", *names)})
