"""Audit chains, read in blocks, against a plain pass over each tenant."""

import hashlib
import random

from spanlake.operators import audit


def test_verified(spark):
    r = random.Random(5)
    rows = [(f"t{k % 3}", seq, f"u{r.randrange(9)}", "act", f"p{seq}", seq * 7) for k, seq in enumerate(sorted(r.sample(range(2000), 700)))]
    chain = audit.chained(spark.createDataFrame(rows, "tenant string, seq long, actor string, action string, payload string, at_ns long")).collect()
    for altered in ((), (5,), (0, 699), tuple(range(0, 700, 50)), (333,)):
        now = [tuple(x) if k not in altered else (*tuple(x)[:4], "other", *tuple(x)[5:]) for k, x in enumerate(chain)]
        if 333 in altered:
            now[333] = (*now[333][:6], None)  # no hash: it and its follower are broken
        want = {}
        for tenant in ("t0", "t1", "t2"):
            last, broken = "", None
            for t, seq, actor, action, payload, at, h in sorted((x for x in now if x[0] == tenant), key=lambda x: x[1]):
                own = hashlib.sha256(bytes.fromhex(last) + seq.to_bytes(8, "big") + t.encode() + actor.encode() + action.encode() + payload.encode() + at.to_bytes(8, "big")).hexdigest()
                broken = seq if own != h and broken is None else broken
                last = h or ""
            want[tenant] = (sum(x[0] == tenant for x in now), broken)
        table = spark.createDataFrame(now, "tenant string, seq long, actor string, action string, payload string, at_ns long, hash string").repartition(5)
        for block in (1, 64, 65_536):
            assert {x.tenant: (x.events, x.broken_seq) for x in audit.verified(table, block=block).collect()} == want
