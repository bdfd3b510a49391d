"""A pipeline over documents: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import lines, packing, quality, simhash, toxicity
from spanlake.llm.common import stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    score = toxicity.scorer(spark, toxicity.fit(docs, _labels(spark, sf_dir)))
    return docs.where(score(F.coalesce("text", F.lit(""))) < 0.5)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rules nor the learnt list rejects."""
    rules = quality.fit(docs, _labels(spark, sf_dir))
    return quality.passed(docs, rules)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those that lose all their lines go. n_chars is the new text's length."""
    out = lines.dedup_lines(docs, grow=True).where("_lines = 0 or _lines > _exact + _near")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest id."""
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("quality rules", good), ("line dedup", fresh_lines), ("simhash near-dedup", first_copies), ("packing", packed)]

#: Models, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents in ``sf_dir``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
