"""The rolling cap, one decision after another, against a plain replay."""

import random

from pyspark.sql import functions as F

from spanlake.operators import sampling

S = sampling.SECOND


def replayed(rows, share):
    past, out = {}, {}
    for tenant, trace, at, keep, reason, asked in sorted(rows, key=lambda r: (r[2], r[1])):
        seen = [x for x in past.get(tenant, []) if x[0] >= at - 60 * S]
        rank = {6: 0, 5: 1, 4: 2, 3: 3, 2: 4}.get(reason, -1)
        gone = keep and rank >= 0 and not asked and bool(seen) and sum(x[1] for x in seen) / len(seen) > share and not any(x[1] and 0 <= x[2] < rank for x in seen)
        past[tenant] = [*seen, (at, keep and not gone, rank)]
        out[tenant, trace] = (keep and not gone, 8 if gone else reason)
    return out


def test_govern(spark):
    r = random.Random(4)
    rows = []
    for k in range(1500):
        reason = r.choice([1, 2, 3, 4, 5, 6, 7, 7, 7, 9])
        rows.append((f"t{r.randrange(2)}", f"{k:04}", r.randrange(900) * S, reason != 7, reason, reason == 4 and r.random() < 0.5))
    table = spark.createDataFrame(rows, "tenant string, trace_id string, start_ns long, keep boolean, reason int, asked boolean")
    for share in (0.0, 0.25, 0.6):
        got = {(x.tenant, x.trace_id): (x.keep, x.reason) for x in sampling.govern(table, share=share, protected=F.col("asked")).collect()}
        assert got == replayed(rows, share)
        assert all(got[x[0], x[1]] == (True, x[4]) for x in rows if x[4] in (1, 9) or x[5])  # errors, truncated ones and investigations stay
        assert any(reason == 8 for _, reason in got.values())
    assert sampling.govern(table.limit(0)).count() == 0
