"""Questions in words: their intent, the service, time range and ids that they name, and what follow-ups take over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
#: Intents by number, and patterns by intent with their priority (fixed values; case doesn't matter).
INTENTS = ("unknown", "explain_trace", "trace_search", "service_health", "topology_question", "incident_status", "investigation_ask", "memory_lookup", "start_investigation", "compare_windows", "remediate")
PATTERNS = (
    ("explain_trace", r"\bexplain\s+trace\b", 9),
    ("explain_trace", r"\bwhat happened in trace\b", 9),
    ("explain_trace", r"\bwalk me through trace\b", 9),
    ("explain_trace", r"\bwhy did trace\b.*\bfail\b", 9),
    ("explain_trace", r"\btrace\s+[0-9a-fA-F]{32}\b", 6),
    ("trace_search", r"\bfind\s+traces\b", 5),
    ("trace_search", r"\bshow\s+me\s+traces\b", 5),
    ("trace_search", r"\bsearch\s+traces\b", 5),
    ("trace_search", r"\b(list|show)\s+(slow|error(ing)?)\s+traces\b", 5),
    ("trace_search", r"\btraces\s+(with|for|in)\b", 3),
    ("service_health", r"\bhow\s+is\b.*\bdoing\b", 6),
    ("service_health", r"\bhealth\s+of\b", 6),
    ("service_health", r"\bis\b.*\bhealthy\b", 6),
    ("service_health", r"\bstatus\s+of\b.*\bservice\b", 6),
    ("service_health", r"\berror\s+rate\s+for\b", 6),
    ("service_health", r"\bwhat\s+is\s+the\s+error\s+rate\b", 6),
    ("topology_question", r"\bwhat\s+calls\b", 6),
    ("topology_question", r"\bwho\s+depends\s+on\b", 6),
    ("topology_question", r"\btopology\s+for\b", 6),
    ("topology_question", r"\bservice\s+map\s+for\b", 6),
    ("topology_question", r"\bwhat\s+does\b.*\bcall\b", 6),
    ("topology_question", r"\bshow\s+topology\b", 6),
    ("incident_status", r"\bactive\s+incidents\b", 6),
    ("incident_status", r"\bopen\s+incidents\b", 6),
    ("incident_status", r"\bincidents?\s+(are\s+)?(currently\s+)?active\b", 6),
    ("incident_status", r"\bany\s+incidents\b", 6),
    ("incident_status", r"\bincident\s+status\b", 6),
    ("incident_status", r"\blist\s+.*\bincidents\b", 6),
    ("investigation_ask", r"\b(what\s+did|find(ings)?\s+for)\s+investigation\b", 7),
    ("investigation_ask", r"\bstatus\s+of\s+investigation\b", 7),
    ("investigation_ask", r"\btell\s+me\s+about\s+investigation\b", 7),
    ("investigation_ask", r"\bfindings\s+for\s+investigation\b", 7),
    ("investigation_ask", r"\binvestigation\s+inv-\S+\b", 4),
    ("memory_lookup", r"\bhave\s+we\s+seen\s+this\s+before\b", 6),
    ("memory_lookup", r"\bsimilar\s+incidents?\b", 6),
    ("memory_lookup", r"\brecall\b.*\bsimilar\b", 6),
    ("memory_lookup", r"\bpast\s+investigations?\s+like\b", 6),
    ("memory_lookup", r"\bseen\s+this\s+error\s+before\b", 6),
    ("start_investigation", r"\bwhy\s+is\b.*\b(slow|down|failing|erroring)\b", 7),
    ("start_investigation", r"\binvestigate\b", 7),
    ("start_investigation", r"\bstart\s+an?\s+investigation\b", 7),
    ("start_investigation", r"\broot\s+cause\s+of\b", 7),
    ("start_investigation", r"\bfind\s+the\s+root\s+cause\b", 7),
    ("compare_windows", r"\bcompare\b", 6),
    ("compare_windows", r"\bdiff\s+between\b", 6),
    ("compare_windows", r"\bwhat\s+changed\s+since\b", 6),
    ("compare_windows", r"\bbefore\s+and\s+after\b", 6),
    ("remediate", r"\brestart\b", 6),
    ("remediate", r"\brollback\b", 6),
    ("remediate", r"\bscale\b.*\breplicas?\b", 6),
    ("remediate", r"\btoggle\b.*\bfeature\s+flag\b", 6),
    ("remediate", r"\bremediate\b", 6),
)
#: Seconds of a unit of time (fixed values).
UNITS = (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800))
_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})"


def intents(text: Column, patterns=PATTERNS, *, apart: float = 0.15) -> Column:
    """struct<intent, confidence, candidates> of a question. A pattern gives 0.5 and 0.05 for each priority, within 0.5 and
    0.95; the best one of an intent counts. The first two intents within ``apart`` leave it unknown, with both as candidates;
    of equal ones the intent of the smaller number is first."""
    best = []
    for number, name in enumerate(INTENTS[1:], 1):
        hits = [F.when(text.rlike("(?i)" + p), F.lit(min(0.95, max(0.5, 0.5 + 0.05 * priority)))) for intent, p, priority in patterns if intent == name]
        if hits:
            top = F.greatest(*hits) if len(hits) > 1 else hits[0]
            best.append(F.when(top.isNotNull(), F.struct((-top).alias("c"), F.lit(number).alias("k"), F.lit(name).alias("name"))))
    ranked = F.array_sort(F.array_compact(F.array(*best)))

    def chosen(r: Column) -> Column:
        first, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        close = second.isNotNull() & (F.round(second["c"] - first["c"], 9) < apart)
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(F.size(r) == 0, "unknown").when(close, "unknown").otherwise(first["name"]).alias("intent"),
            F.when((F.size(r) > 0) & ~close, -first["c"]).otherwise(0.0).alias("confidence"),
            F.when(close, F.array(first["name"], second["name"])).otherwise(none).alias("candidates"),
        )

    return F.transform(F.array(ranked), chosen)[0]


def services(questions: DataFrame, catalog: DataFrame, *, most: int = 2) -> DataFrame:
    """``questions`` (question_id, text) with ``service`` and ``distance``: the entry of ``catalog`` (service, seq) that is
    nearest to a word, or to two words with a hyphen, in letters changed, ``most`` at most; of equal ones the first by seq.

    The catalog is small and is broadcast; different words are compared once, whatever the number of questions.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]+"), 0)
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws("-", F.get("w", i), F.get("w", i + 1)))
    asked = questions.select("question_id", words.alias("w")).select("question_id", F.explode(F.array_distinct(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))))).alias("word"))
    # Words of about a service's length only can be near: that makes it an equi-join.
    entries = catalog.select("service", "seq", F.lower("service").alias("low")).withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), F.length("service") - most), F.length("service") + most)))
    found = asked.select("word").distinct().withColumn("size", F.length("word")).join(F.broadcast(entries), "size")
    near = found.withColumn("distance", F.levenshtein("word", "low", most)).where("distance >= 0").groupBy("word").agg(F.min(F.struct("distance", "seq", "service")).alias("best"))
    best = asked.join(near, "word").groupBy("question_id").agg(F.min("best").alias("best"))
    return questions.join(best, "question_id", "left").select(questions["*"], F.col("best.service").alias("service"), F.col("best.distance").alias("distance"))


def _instant(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 time, or null."""
    return F.unix_micros(F.try_to_timestamp(F.when(text.rlike(f"^{_ISO}$"), text))) * 1000


def time_range(text: Column, now_ns: int, *, default_ns: int = 1800 * SECOND, deploy_ns: Column | None = None) -> Column:
    """struct<start_ns, end_ns, rule>: last n units, between two times, since a time, yesterday, today, a bare time, since
    ``deploy_ns`` (from ``since_deploys``), in that order, else the last ``default_ns``. Days are UTC days."""
    now, day = F.lit(now_ns), 86400 * SECOND
    midnight = now_ns - now_ns % day
    number, unit = F.regexp_extract(text, r"(?i)\blast\s+(\d+)\s*(second|minute|hour|day|week)s?\b", 1), F.lower(F.regexp_extract(text, r"(?i)\blast\s+(\d+)\s*(second|minute|hour|day|week)s?\b", 2))
    length = F.create_map(*(F.lit(x) for pair in UNITS for x in pair))
    ago = F.try_multiply(F.try_multiply(number.try_cast("bigint"), F.try_element_at(length, unit)), F.lit(SECOND))
    a, b = (_instant(F.regexp_extract(text, r"(?i)\bbetween\s+(\S+)\s+and\s+(\S+)\b", k)) for k in (1, 2))
    since = _instant(F.regexp_extract(text, r"(?i)\bsince\s+(\S+)\b", 1))
    bare = _instant(F.regexp_extract(text, f"({_ISO})", 1))
    found = lambda start, end, rule: F.struct(start.cast("bigint").alias("start_ns"), end.cast("bigint").alias("end_ns"), F.lit(rule).alias("rule"))
    return (
        F.when(ago.isNotNull(), found(now - ago, now, "last"))
        .when(a.isNotNull() & b.isNotNull(), found(F.least(a, b), F.greatest(a, b), "between"))
        .when(since.isNotNull(), found(since, now, "since"))
        .when(text.rlike(r"(?i)\byesterday\b"), found(F.lit(midnight - day), F.lit(midnight), "yesterday"))
        .when(text.rlike(r"(?i)\btoday\b"), found(F.lit(midnight), now, "today"))
        .when(bare.isNotNull(), found(bare, now, "time"))
        .when(F.lit(None) if deploy_ns is None else deploy_ns.isNotNull(), found(F.lit(None) if deploy_ns is None else deploy_ns, now, "deploy"))
        .otherwise(found(now - default_ns, now, "default"))
    )


#: How a question asks for the time since a deploy (fixed value).
SINCE_DEPLOY = r"(?i)\bsince\s+the\s+([a-zA-Z0-9_-]+)\s+deploy\b"


def since_deploys(questions: DataFrame, catalog: DataFrame, deploys: DataFrame, *, now_ns: int, most: int = 2) -> DataFrame:
    """``questions`` (question_id, text) with ``deploy_ns``: the latest deploy, up to ``now_ns``, of the service in "since the ... deploy", which
    is the entry of ``catalog`` nearest to what is written, as in ``services``. Null without such words, service or deploy."""
    word = F.nullif(F.regexp_extract("text", SINCE_DEPLOY, 1), F.lit(""))
    asked = questions.select("question_id", word.alias("text")).where("text is not null")
    named = services(asked, catalog, most=most).where("service is not null").select("question_id", "service")
    latest = deploys.where(F.col("at_ns") <= now_ns).groupBy("service").agg(F.max("at_ns").alias("deploy_ns"))
    return questions.join(named.join(latest, "service").drop("service"), "question_id", "left")


def ids(text: Column) -> Column:
    """struct<trace_id, error_text>: 32 hex digits in lower case; a quoted string, or what follows ``error:``, of at most 128
    characters. Null where there is none."""
    trace = F.nullif(F.lower(F.regexp_extract(text, r"\b([0-9a-fA-F]{32})\b", 1)), F.lit(""))
    quoted, after = F.regexp_extract(text, '"([^"]{1,128})"', 1), F.trim(F.regexp_extract(text, r"(?i)\berror:\s*(.{1,128})", 1))
    return F.struct(trace.alias("trace_id"), F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(after, F.lit(""))).alias("error_text"))


def conversation(turns: DataFrame, *, idle_ns: int = 1800 * SECOND, kept: int = 5) -> DataFrame:
    """``turns`` (thread, turn, at_ns, intent, service) with ``service`` filled from the turn before where that has the same
    intent (what was filled goes on), and ``recent``, the intents of the last ``kept`` turns. A pause of over ``idle_ns``
    begins anew."""
    own = Window.partitionBy("thread").orderBy("at_ns", "turn")
    fresh = F.coalesce(F.col("at_ns") - F.lag("at_ns").over(own) > idle_ns, F.lit(True))
    rows = turns.withColumn("_fresh", fresh).withColumn("_island", F.sum((F.col("_fresh") | ~F.coalesce(F.col("intent") == F.lag("intent").over(own), F.lit(False))).cast("int")).over(own)).withColumn("_session", F.sum(F.col("_fresh").cast("int")).over(own))
    filled = F.last("service", ignorenulls=True).over(Window.partitionBy("thread", "_island").orderBy("at_ns", "turn"))
    recent = F.collect_list("intent").over(Window.partitionBy("thread", "_session").orderBy("at_ns", "turn").rowsBetween(-kept + 1, 0))
    return rows.withColumns({"service": filled, "recent": recent}).drop("_fresh", "_island", "_session")


def catalog(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "seq int, service string")
