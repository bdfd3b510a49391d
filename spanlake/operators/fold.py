"""Decisions that depend on those before them: a pass over the rows of each key in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def fold(rows: DataFrame, *, by: list[str], order: list[str], reads: list[str], start: Callable[[], Callable[..., tuple]], adds: str) -> DataFrame:
    """``rows`` with the columns ``adds``, a schema. ``start`` gives a function for each key of ``by``, which is called with the columns
    ``reads`` of each row in ``order`` and returns the new values.

    Keys are read batch by batch, sorted on disk by Spark: a task holds one batch and the state of one key. A key is one task.
    """
    names, places, keys = [a.split()[0] for a in adds.split(", ")], [rows.columns.index(c) for c in reads], [rows.columns.index(c) for c in by]
    kinds = [a.split()[1] for a in adds.split(", ")]

    def work(batches):
        import pyarrow as pa

        types = [{"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k] for k in kinds]
        now, step = None, None
        for batch in batches:
            out = []
            own = zip(*(batch.column(i).to_pylist() for i in keys))
            for key, values in zip(own, zip(*(batch.column(i).to_pylist() for i in places))):
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(*values))
            new = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[] for _ in types], types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(work, f"{fields}, {adds}")
