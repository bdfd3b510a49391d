"""URL filters: rules by host and path, and a ratio of character language models for what no rule fits.

Two variable-order Markov models, of accepted and of rejected urls, give each character's probability after up to ``ORDER``
characters before it; each order is smoothed with the next lower one, and a place takes the longest order whose characters
were seen. The mean over a url of the log of both models' ratio is compared with a threshold that is calibrated on urls of
either kind that the models have not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import small, stored

#: Characters before a character that count; weight of the lower order; characters of an alphabet, for order 0.
ORDER, WEIGHT, ALPHABET = 3, 2.0, 256
#: One url in so many, by its hash, is held out from the models and calibrates the threshold.
HELD_OUT = 5
#: (rule, verdict): host, then path, which begins with "/" (fixed values).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _A, _Z), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path. Else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def _grams(rows: DataFrame, *keep: str, orders) -> DataFrame:
    """(keep, order, before, char) of every place of ``line``, ends included."""
    framed = rows.withColumn("framed", F.concat(F.lit("^" * ORDER), F.regexp_replace("line", r"\d", "0"), F.lit("$")))
    placed = framed.withColumn("place", F.explode(F.sequence(F.lit(ORDER), F.char_length("framed") - 1)))
    return placed.select(*keep, "place", F.expr("substring(framed, place + 1, 1)").alias("char"), *(F.expr(f"substring(framed, place + 1 - {k}, {k})").alias(f"before{k}") for k in orders))


def ratios(lines: DataFrame) -> list[DataFrame]:
    """For each order, (before, char, ratio) from ``lines`` (line, accepted): log P(char | before) of accepted over rejected."""
    orders = range(ORDER + 1)
    seen = stored(_grams(lines, "accepted", orders=orders).groupBy("accepted", f"before{ORDER}", "char").agg(F.count("*").alias("n")), "grams")
    both = lambda name: [F.coalesce(F.sum(F.when(F.col("accepted") == side, F.col("n"))), F.lit(0)).alias(f"{name}{int(side)}") for side in (True, False)]
    out, lower = [], None
    for k in orders:
        grams = seen.withColumn("before", F.expr(f"right(before{ORDER}, {k})")).groupBy("before", "char").agg(*both("n"))
        sums = grams.groupBy("before").agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
        table = grams.join(sums, "before")
        if lower is None:
            p = [f"(n{s} + {WEIGHT / ALPHABET}D) / (s{s} + {WEIGHT}D) as p{s}" for s in (1, 0)]
        else:
            table = table.withColumn("shorter", F.expr(f"right(before, {k - 1})")).join(lower, ["shorter", "char"])
            p = [f"(n{s} + {WEIGHT}D * q{s}) / (s{s} + {WEIGHT}D) as p{s}" for s in (1, 0)]
        table = stored(table.selectExpr("before", "char", *p), f"order{k}")
        lower = table.select(F.col("before").alias("shorter"), "char", F.col("p1").alias("q1"), F.col("p0").alias("q0"))
        out.append(table.select("before", "char", F.log(F.col("p1") / F.col("p0")).alias("ratio")))
    return out


def scored(lines: DataFrame, tables: list[DataFrame], *keep: str) -> DataFrame:
    """(keep, score) for distinct ``lines``: the mean over places, the end included, of the longest seen order's ratio."""
    rows = _grams(lines, *keep, orders=range(ORDER + 1))
    for k in reversed(range(ORDER + 1)):
        table = tables[k].select(F.col("before").alias(f"before{k}"), "char", F.col("ratio").alias(f"ratio{k}"))
        rows = rows.join(small(table), [f"before{k}", "char"], "left")
    return rows.groupBy(*keep).agg(F.avg(F.coalesce(*(F.col(f"ratio{k}") for k in reversed(range(ORDER + 1))), F.lit(0.0))).alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row; score is null where a rule decides.

    Rules look at host and path, the models at the whole url, its query and fragment included.
    The models learn from the urls that a rule decides, but for one in ``HELD_OUT``; those that no rule fits are allowed if
    their score reaches the threshold, halfway between the mean scores of accepted and of rejected urls among those held out
    (among all, where one kind has none there or none elsewhere). Without urls of both kinds all are allowed.
    Null urls and those without ``://`` have an empty host and path and are scored like others, null as an empty url. Rows that repeat an id count
    each; an empty table gives an empty result.
    """
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), F.coalesce(pages[url_col], F.lit("")).alias("line"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    accepted = F.lit(None).cast("boolean")
    for rule, verdict in rules:
        accepted = F.when(F.col("rule") == rule, F.lit(verdict == "allow")).otherwise(accepted)
    rows = rows.withColumn("accepted", accepted)
    taught = rows.where("accepted is not null").select("line", "accepted").distinct()
    held = F.pmod(F.xxhash64("line", F.lit("held out")), F.lit(HELD_OUT)) == 0
    taught = stored(taught.withColumn("held", held), "taught")
    sides = {(r["accepted"], r["held"]) for r in taught.groupBy("accepted", "held").count().collect()}
    if len({side for side, _ in sides}) < 2:
        verdict = F.when(F.col("accepted") == F.lit(False), "block").otherwise("allow")
        return rows.select("id", "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    learnt, judges = (taught.where("not held"), taught.where("held")) if len(sides) == 4 else (taught, taught)
    tables = ratios(learnt)
    means = {r["accepted"]: r["mean"] for r in scored(judges, tables, "line", "accepted").groupBy("accepted").agg(F.avg("score").alias("mean")).collect()}
    threshold = (means[True] + means[False]) / 2
    asked = scored(rows.where("accepted is null").select("line").distinct(), tables, "line")
    out = rows.join(asked, "line", "left").withColumn("score", F.when(F.col("accepted").isNull(), F.col("score")))
    verdict = F.when(F.coalesce(F.col("accepted"), F.col("score") >= threshold, F.lit(True)), "allow").otherwise("block")
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), "score")
