"""Exact duplicates: group by a 128-bit content hash, compare the bytes inside groups, keep one stable row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import small, stored, texts

#: Characters that don't count when texts are compared: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for every row of ``docs``.

    Texts are equal if they are identical without ``BLANKS``; a null text is an empty one and equals other empty ones. Of
    equal texts that with the most code points in the original stays, then that with the smallest id; a null id comes last, and
    stays, as null, only before other null ones. Rows that share an id, a length and an equal text can't be told apart: they
    stay or go together, and count each. An empty table gives an empty result; other columns are not read.

    Only hashes and lengths of all rows are shuffled; where very many rows share a hash, Spark splits the join's skewed
    partition. Texts are shuffled where a hash occurs twice, first reduced to the
    smallest and largest text of a hash in each task, so a group of copies that holds much of the table stays small.
    """
    plain = texts(docs, id_col, text_col).withColumn("norm", F.translate("text", BLANKS, ""))
    rows = stored(plain.select("id", F.char_length("text").alias("n"), F.md5("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256")), "hashes")
    again = rows.groupBy("hash").count().where("count > 1").select("hash")
    members = plain.select(F.md5("norm").alias("hash"), "norm").join(small(again), "hash", "left_semi")
    clash = members.groupBy("hash").agg((F.min("norm") != F.max("norm")).alias("differ")).where("differ").select("hash")
    rows = rows.withColumn("part", F.lit(""))
    if not clash.isEmpty():  # different bytes under one hash: there the text itself tells the groups apart
        own = plain.select("id", F.char_length("text").alias("n"), F.md5("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256"), F.col("norm").alias("part"))
        rows = rows.join(clash, "hash", "left_anti").unionByName(own.join(clash, "hash", "left_semi"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id")))
    groups = rows.groupBy("hash", "part").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    out = rows.join(groups, ["hash", "part"], "left")
    alone = F.col("best").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n")))
    return out.select("id", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), "text_sha256")
