"""Quality rules: statistics of whole texts as Spark expressions, and decision lists learnt from labels.

Sequential covering: a rule is a conjunction of threshold tests on the statistics. It is grown on two thirds of the labelled
rows, test by test, by information gain, pruned on the last third by dropping tests from its end, and taken if it is precise
enough there; rows that it covers are set aside, and the next rule is grown. The list becomes one ordered conditional
expression: the first rule that holds rejects a text, and a text that no rule covers is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import fresh, texts

#: Characters between words: \x20 and \x09-\x0D. Characters counted as symbols. Words of a repeated window.
BLANKS, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 8
#: Labelled texts that a list is learnt from at most, those with the smallest hash of their id.
SAMPLE = 8000
#: Rules, tests of a rule, candidate thresholds of a statistic; precision and rows that a rule needs where it is pruned.
RULES, TESTS, CUTS, PRECISION, COVER = 12, 3, 40, 0.97, 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ"


def _let(value: Column, body) -> Column:
    """body(x) with x bound to ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    line = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " +"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that stand twice or more in the text. Windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twice(k: Column) -> Column:
                own = F.get(s, k)["h"]
                return F.coalesce(own == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(own == F.get(s, k + 1)["h"], F.lit(False))

            found = F.filter(F.transform(s, lambda x, k: F.when(twice(k), x["i"])), lambda x: x.isNotNull())
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end"))
            return F.aggregate(F.sort_array(found), start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, places))

    def hashed(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))
        return F.when(n < window, F.lit(0).cast("long")).otherwise(_let(hashes, covered))

    return _let(words, hashed)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and a struct column ``_q`` of statistics of the whole text; a null text is an empty one, whose counts are 0.
    A column of that name is replaced; all others stay, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, n = fresh(df, "_qw"), fresh(df, "_ql")
    counts = df.withColumn(w, words).withColumn(n, lines).withColumn("_q", F.struct(
        F.size(w).cast("long").alias("n_words"),
        _without(text, BLANKS).cast("long").alias("word_chars"),
        (F.char_length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(w)).alias("n_repeat_words"),
        F.size(n).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        (F.char_length(text) - _without(text, _UPPER)).cast("long").alias("n_upper"),
        (F.char_length(text) - _without(text, "0123456789")).cast("long").alias("n_digits"),
        (F.char_length(text) - _without(text, "!?")).cast("long").alias("n_marks"),
        (F.char_length(text) - _without(text, ".,;:")).cast("long").alias("n_points"),
    ))
    return counts.drop(w, n)


#: Statistics that rules test, as expressions over ``_q``.
FEATURES = {
    "words": "_q.n_words",
    "word_length": "_q.word_chars / greatest(_q.n_words, 1)",
    "symbols": "_q.n_symbols / greatest(_q.word_chars, 1)",
    "duplicate_lines": "_q.n_dup_lines / greatest(_q.n_lines, 1)",
    "repeated_words": "_q.n_repeat_words / greatest(_q.n_words, 1)",
    "distinct_words": "_q.n_distinct / greatest(_q.n_words, 1)",
    "upper": "_q.n_upper / greatest(_q.word_chars, 1)",
    "digits": "_q.n_digits / greatest(_q.word_chars, 1)",
    "marks": "_q.n_marks / greatest(_q.n_words, 1)",
    "points": "_q.n_points / greatest(_q.n_words, 1)",
    "line_words": "_q.n_words / greatest(_q.n_lines, 1)",
}
#: Texts that fail whatever is learnt (fixed values).
BASE = "_q.n_words < 20 or 100 * _q.n_repeat_words > 30 * _q.n_words"


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.threshold!r}D"


def verdict(rules: list[tuple[Test, ...]]) -> Column:
    """True where a text is kept: the ordered conditional expression of a decision list."""
    out = None
    for rule in rules:
        condition = F.expr(" and ".join(f"({t.sql()})" for t in rule))
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(columns: dict, bad) -> list[tuple[Test, ...]]:
    """A decision list for ``bad`` (booleans) from numpy columns by feature; the last third of the rows prunes."""
    import numpy as np

    names, n = list(columns), len(bad)
    if n == 0:
        return []
    prunes = np.arange(n) % 3 == 2
    tests, holds = [], []
    for name in names:
        x = columns[name]
        for t in np.unique(np.round(np.quantile(x, np.linspace(0, 1, CUTS)), 6)):
            for above in (True, False):
                tests.append(Test(name, above, float(t)))
                holds.append(x >= t if above else x <= t)
    holds = np.array(holds)
    left, rules = np.ones(n, bool), []

    def precise(rows) -> tuple[int, int]:
        return int((rows & bad).sum()), int((rows & ~bad).sum())

    while len(rules) < RULES and (left & bad & ~prunes).sum() >= COVER:
        rows, rule = left & ~prunes, []
        while len(rule) < TESTS:
            p, q = precise(rows)
            if q == 0:
                break
            good, wrong = (holds[:, rows & bad]).sum(1), (holds[:, rows & ~bad]).sum(1)
            gain = good * (np.log2((good + 1e-9) / (good + wrong + 1e-9)) - np.log2(p / (p + q)))
            best = int(gain.argmax())
            if gain[best] <= 1e-6:
                break
            rule.append(best)
            rows = rows & holds[best]
        worth = []
        for k in range(1, len(rule) + 1):
            p, q = precise(left & prunes & holds[rule[:k]].all(0))
            worth.append(((p - q) / (p + q) if p + q else -1, -k, p, q))
        if not worth:
            break
        value, k, p, q = max(worth)
        taken = holds[rule[:-k]].all(0)
        own, other = precise(left & taken)
        if p + q < COVER // 2 or own / max(1, own + other) < PRECISION or p / max(1, p + q) < PRECISION - 0.02:
            break
        rules.append(tuple(tests[i] for i in rule[:-k]))
        left = left & ~taken
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[tuple[Test, ...]]:
    """A decision list from the ``sample`` labelled texts (1 good, 0 bad) of the smallest hash that pass ``BASE``."""
    import numpy as np

    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # One text of an id, and statistics of the chosen texts only: a filter on them would be moved before the join.
    own = texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_statistics(own).select("id", "label", F.expr(BASE).alias("failed"), *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
    found = sorted((r for r in rows.collect() if not r["failed"]), key=lambda r: str(r["id"]))
    return learn({k: np.array([r[k] for r in found], float) for k in FEATURES}, np.array([r["label"] == 0 for r in found], bool))


def judged(df: DataFrame, rules: list[tuple[Test, ...]], text_col: str = "text") -> DataFrame:
    """``df``, ``_q``, and booleans ``_base_failed`` and ``_kept``; columns of these names are replaced."""
    out = with_statistics(df, text_col).withColumn("_base_failed", F.expr(BASE))
    return out.withColumn("_kept", ~F.col("_base_failed") & verdict(rules))


def passed(df: DataFrame, rules: list[tuple[Test, ...]], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, whatever their names."""
    rows = df.select(F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in df.columns)).alias("row"))
    return judged(rows, rules).where("_kept").select("row.*")
