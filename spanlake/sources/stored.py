"""Tables that grow batch by batch under a rule for each column, without being rewritten for each batch.

A table is a base in hash parts of its key and the batches since. A batch is merged within itself and written beside the base,
so what it writes follows its own size. ``compact`` folds the batches into those parts of the base that they touch; the others
stay where they are. The manifest says which version of each part counts and up to which batch it goes; it changes as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import lifecycle
from spanlake.sources.versions import complete, delete, names, place


class Table:
    """``rules`` are those of ``lifecycle.merge``; without any, rows that exist are ignored. ``parts`` must not change.

    ``latest`` columns without a column ``version`` in the batch take the batch's number: the last batch wins.
    """

    def __init__(self, spark: SparkSession, folder: str, *, key: list[str], parts: int = 64, **rules) -> None:
        self.spark, self.folder, self.key, self.parts, self.rules = spark, folder, key, parts, rules

    def add(self, batch: DataFrame, number: int) -> None:
        """A batch, also as a function for ``foreachBatch``. One that comes again replaces itself, or does nothing if it is in the base."""
        if number <= self._manifest()[1]:
            return
        if self.rules.get("latest") and "version" not in batch.columns:
            batch = batch.withColumn("version", F.lit(number).cast("bigint"))
        rows = self._merge(batch, batch.limit(0))
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(place(f"{self.folder}/delta", "batch", number))

    def read(self) -> DataFrame | None:
        """The table; None before the first batch with rows. Parts that no batch has touched since aren't merged again."""
        _, upto, base = self._manifest()
        batches, touched = self._since(upto)
        still, old = self._base({p: v for p, v in base.items() if p not in touched}), self._base({p: v for p, v in base.items() if p in touched})
        if batches:
            new = self._deltas(batches)
            merged = self._merge(old if old is not None else new.limit(0), new).drop("part")
            return merged if still is None else still.unionByName(merged)
        return still

    def compact(self) -> list[int]:
        """Folds all batches into the base; the numbers of the parts that were written."""
        version, upto, base = self._manifest()
        batches, touched = self._since(upto)
        if not batches:
            return []
        new = self._deltas(batches)
        old = self._base({p: v for p, v in base.items() if p in touched})
        rows = self._merge(old if old is not None else new.limit(0), new)
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(place(f"{self.folder}/base", "version", version + 1))
        entries = [(-1, version + 1, batches[-1]), *((p, v, batches[-1]) for p, v in {**base, **dict.fromkeys(touched, version + 1)}.items())]
        manifest = self.spark.createDataFrame(entries, "part int, version long, upto long").coalesce(1)
        manifest.write.mode("overwrite").parquet(place(f"{self.folder}/manifest", "version", version + 1))
        return touched

    def vacuum(self) -> None:
        """Deletes what the latest manifest doesn't need; no reader may be at work with an older one."""
        version, upto, base = self._manifest()
        for n in complete(self.spark, f"{self.folder}/delta", "batch"):
            if n <= upto:
                delete(self.spark, place(f"{self.folder}/delta", "batch", n))
        for n in complete(self.spark, f"{self.folder}/base", "version"):
            home = place(f"{self.folder}/base", "version", n)
            own = [p for p in names(self.spark, home) if p.startswith("part=")]
            for p in own:
                if n <= version and base.get(int(p.removeprefix("part="))) != n:
                    delete(self.spark, f"{home}/{p}")
        for n in complete(self.spark, f"{self.folder}/manifest", "version"):
            if n < version:
                delete(self.spark, place(f"{self.folder}/manifest", "version", n))

    def _merge(self, old: DataFrame, new: DataFrame) -> DataFrame:
        rows = lifecycle.merge(old, new, key=self.key, **self.rules)
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))

    def _manifest(self) -> tuple[int, int, dict[int, int]]:
        """Version, last batch in the base, and the version of each part (as many entries as parts)."""
        numbers = complete(self.spark, f"{self.folder}/manifest", "version")
        if not numbers:
            return 0, -1, {}
        rows = self.spark.read.parquet(place(f"{self.folder}/manifest", "version", numbers[-1])).collect()
        return numbers[-1], rows[0]["upto"], {r["part"]: r["version"] for r in rows if r["part"] >= 0}

    def _since(self, upto: int) -> tuple[list[int], list[int]]:
        """Batches with rows after ``upto``, and the parts they touch."""
        found = {n: [int(p.removeprefix("part=")) for p in names(self.spark, place(f"{self.folder}/delta", "batch", n)) if p.startswith("part=")] for n in complete(self.spark, f"{self.folder}/delta", "batch") if n > upto}
        return [n for n, parts in found.items() if parts], sorted({p for parts in found.values() for p in parts})

    def _deltas(self, batches: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/delta").parquet(*(place(f"{self.folder}/delta", "batch", n) for n in batches)).drop("batch", "part")

    def _base(self, parts: dict[int, int]) -> DataFrame | None:
        paths = [f"{place(f'{self.folder}/base', 'version', v)}/part={p}" for p, v in sorted(parts.items())]
        return self.spark.read.parquet(*paths) if paths else None
