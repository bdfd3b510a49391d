"""Candidates of memory and span search over postings, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import memory, postings


@pytest.mark.parametrize("most,hot", [(3, 0.02), (5, 0.2), (7, 2.0), (1000, 0.1)])
def test_nearest_is_exact(spark, most, hot):
    rng = random.Random(most)
    words = [f"w{i}" for i in range(12)] + ["all", "most"]
    make = lambda i: (i, f"t{i % 2}", ["all"] * (i % 10 > 0) + sorted(rng.sample(words[:12], rng.randint(0, 4))) + ["most"] * (rng.random() < 0.7))
    held = [make(i) for i in range(120)] + [(500, "t0", None), (501, "t0", [])]
    asked = [make(i) for i in range(30)] + [(900, "t1", ["none"]), (901, "t9", ["all"])]
    wanted = set()
    for q, tenant, tokens in asked:
        ranked = sorted((-len(set(tokens) & set(t or [])), r) for r, own, t in held if own == tenant)
        wanted |= {(q, r, -n) for n, r in ranked[:most] if n}
    schema = "record_id long, tenant string, tokens array<string>"
    got = memory.nearest(spark.createDataFrame(asked, schema.replace("record_id", "query_id")), spark.createDataFrame(held, schema), most=most, hot=hot)
    assert {(r.query_id, r.record_id, r.n) for r in got.collect()} == wanted


def test_common_tokens_are_not_joined(spark):
    """A token of all records pairs no query with more than ``most`` of them."""
    rows = spark.range(5000).select(F.col("id").alias("record_id"), F.lit("t").alias("tenant"), F.array(F.lit("all")).alias("tokens"))
    asked = rows.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id")
    got = memory.nearest(asked, rows, most=10).collect()
    assert len(got) == 1000 and {r.record_id for r in got} == set(range(10))


def test_similar_meets_few_words(spark):
    """Records that ``top`` others are sure to stand above don't meet a query's words, and the result is that of all pairs."""
    rng = random.Random(3)
    held, ids = [], range(0, 400)
    for i in ids:
        of = i - 3 if i % 20 == 13 else i
        text = " ".join(rng.sample([f"w{k}" for k in range(40)], rng.randint(0, 30))) if i % 7 else ""
        held.append((i, "t", [f"a{of % 4}", f"b{of % 6}", f"c{of % 9}"], text, 1.0, 0 if rng.random() < 0.5 else -rng.randrange(900) * memory.DAY, None, i - 3 if i % 20 == 13 else None))
    schema = "record_id long, tenant string, tokens array<string>, body string, weight double, created_ns long, last_used_ns long, supersedes_id long"
    rows = spark.createDataFrame(held, schema)
    asked = rows.where("record_id % 10 = 0").withColumnRenamed("record_id", "query_id")
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    wanted, fixed = set(), {r[7] for r in held if r[7] is not None}
    for q in held[::10]:
        near = sorted(held, key=lambda r: (-len(set(q[2]) & set(r[2])), r[0]))[:100]
        found = []
        for r in (r for r in near if set(q[2]) & set(r[2])):
            alike = share(set(q[2]), set(r[2]))
            score = 0.7 * alike + 0.3 * share(set(q[3].split()), set(r[3].split())) if q[3] else alike
            if score >= memory.LEAST:
                found.append((r, score, score * (1 + 0.5 ** (-r[5] / memory.DAY / 90))))
        above = {}
        for r, _, worth in found:
            above[r[7]] = max(worth, above.get(r[7], 0))
        ranked = sorted((-min(worth, above.get(r[0], 9)), r[0] in fixed, r[0]) for r, _, worth in found if r[0] not in fixed or r[0] in above)
        wanted |= {(q[0], r, k + 1) for k, (_, _, r) in enumerate(ranked[:5])}
    got = memory.similar(asked, rows, now_ns=0, top=5, candidates=100)
    assert {(r.query_id, r.record_id, r.rank) for r in got.collect()} == wanted
    assert memory._promising(asked, rows, 0, 5, 100, memory.LEAST).count() < 0.5 * 100 * asked.count()


def test_candidates_of_equal_tokens_are_found_once(spark):
    """Queries of one set of tokens share their candidates."""
    rows = spark.range(2000).select(F.col("id").alias("record_id"), F.lit("t").alias("tenant"), F.array(F.concat(F.lit("a"), F.col("id") % 100), F.lit("all")).alias("tokens"))
    asked = rows.where("record_id % 10 = 0").withColumnRenamed("record_id", "query_id")
    assert memory._candidates(asked, rows, 30, 0.02).count() == 10 * 30
    assert memory.nearest(asked, rows, most=30).count() == 200 * 30


SPANS = "tenant string, trace_id string, span_id string, service string, name string, start_ns long, is_error boolean, attrs map<string, string>"


def fixture(spark, tmp_path, batches=1):
    rng = random.Random(5)
    rows = [("t", f"{i:04}", "a", rng.choice(["cart", "", None]), rng.choice(["GET /a_b", "get 100%", "x\\y", "ab"]), 10**10 * (i % 40) + i, i % 5 == 0, rng.choice([None, {}, {"k": "GET /a_b"}, {"k": "Öl", "m": "oil GET"}])) for i in range(200)]
    rows.append(("other", "9999", "a", "cart", "GET /a_b", 5, False, {}))
    for n in range(batches):
        postings.write(spark.createDataFrame(rows[n::batches], SPANS), f"{tmp_path}/p")
    return rows, f"{tmp_path}/p"


def like(text, value):
    import re

    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text)
    return value is not None and re.search(f"(?s)^.*{pattern}.*$", value, re.I | re.A) is not None


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """One batch, and three."""
    return {n: fixture(spark, tmp_path_factory.mktemp("postings"), n) for n in (1, 3)}


@pytest.mark.parametrize("text", ["get", "GET /A_B", "t_/a", "a%b", "x\\y", "ö", "Öl", "", "zzz", "1", "oil g", "get%oil"])
@pytest.mark.parametrize("pushed", [0, 200])
def test_text(spark, stored, monkeypatch, text, pushed):
    monkeypatch.setattr(postings, "PUSHED", pushed)
    rows, path = stored[1 if pushed else 3]
    wanted = sorted((-r[5], r[1]) for r in rows if r[0] == "t" and any(like(text, v) for v in [r[4], *(r[7] or {}).values()]))[:15]
    got = postings.search(spark, path, tenant="t", text=text, limit=15).collect()
    assert [(-r.start_ns, r.trace_id) for r in got] == wanted


def test_paths(spark, tmp_path):
    rows, path = fixture(spark, tmp_path)
    ids = lambda keep: [r[1] for r in sorted(rows, key=lambda r: (-r[5], r[1])) if r[0] == "t" and keep(r)]
    found = lambda **kw: [r.trace_id for r in postings.search(spark, path, tenant="t", limit=500, **kw).collect()]
    assert found(attribute=("k", "Öl"), text="get", start_ns=2**60) == ids(lambda r: (r[7] or {}).get("k") == "Öl")
    assert found(service="cart", operation="ab") == ids(lambda r: r[3] == "cart" and r[4] == "ab")
    assert found(service="") == ids(lambda r: not r[3])
    window = dict(start_ns=10**10 * 3 + 7, end_ns=10**10 * 20 + 20)
    assert found(**window) == ids(lambda r: window["start_ns"] <= r[5] <= window["end_ns"])
    assert found(**window, operation="ab") == found(**window)


def test_search_reads_postings_only(spark, tmp_path):
    _, path = fixture(spark, tmp_path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = postings.search(spark, path, tenant="t", attribute=("k", "Öl"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(kind" in plan and "EqualTo(value,Öl)" in plan and "Exchange" not in plan


def test_no_spans(spark, tmp_path):
    postings.write(spark.createDataFrame([], SPANS), f"{tmp_path}/p")
    assert spark.read.schema("value string").parquet(f"{tmp_path}/p/values").count() == 0


def test_parsed_lines(spark):
    lines = ['{"record_id":7,"tenant":"t","kind":"incident","created_at":"2024-01-01T00:00:01Z","tokens":["a"],"weight":1.5}', '{"schema":"9","record_id":"x","tenant":"t"}', "", "  ", "no json", '{"tenant":"t"}', '{"schema":"1","record_id":"y","tenant":"t","created_at":"then","extra":1}']
    got = {(r.record_id, r.created_ns, r.error) for r in memory.parsed(spark.createDataFrame([(x,) for x in [*lines, None]], "line string")).collect()}
    assert got == {("7", 1_704_067_201_000_000_000, None), ("x", None, "schema"), (None, None, "malformed"), ("y", None, None)}
