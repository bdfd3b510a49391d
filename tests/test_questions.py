"""Time ranges that are named by a deploy."""

from pyspark.sql import functions as F

from spanlake.operators import questions


def test_since_deploys(spark):
    now, minute = 10**18, 60 * 10**9
    asked = ["what changed since the checkout-svc deploy", "what changed since the chekot-svc deploy", "since the unknown-thing deploy", "since the payment-svc deploy, over the last 5 minutes", "since the cart-svc deploy", "hello"]
    rows = spark.createDataFrame(list(enumerate(asked)), "question_id long, text string")
    deploys = spark.createDataFrame([("checkout-svc", now - 180 * minute), ("checkout-svc", now - 45 * minute), ("checkout-svc", now + minute), ("payment-svc", now - minute)], "service string, at_ns long")
    found = questions.since_deploys(rows, questions.catalog(spark, ["checkout-svc", "payment-svc", "cart-svc"]), deploys, now_ns=now)
    got = {r.question_id: (now - r.t.start_ns, r.t.rule) for r in found.select("question_id", questions.time_range(F.col("text"), now, deploy_ns=F.col("deploy_ns")).alias("t")).collect()}
    assert got == {0: (45 * minute, "deploy"), 1: (45 * minute, "deploy"), 2: (30 * minute, "default"), 3: (5 * minute, "last"), 4: (30 * minute, "default"), 5: (30 * minute, "default")}
