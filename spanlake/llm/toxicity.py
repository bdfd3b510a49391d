"""Toxicity scores: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its own bucket and of the buckets of its character n-grams, so an unseen spelling shares
vectors with those it resembles; a text is the mean of its distinct words; a linear layer and a softmax over two labels follow. As all
is linear before the softmax, a trained model is one number for each bucket, and a text's score is the sigmoid of the mean of
its words' numbers.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import id_kind, sent, texts

#: Buckets, vector length, n-gram lengths.
BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Words with a vector of zeros that every text has besides its own, so that few words say little.
NEUTRAL = 32
#: Labelled texts of each label that are learnt from at most, those with the smallest hash of their id.
SAMPLE = 1500
#: Passes over them, batch, Adam's rate, weight decay of the vectors.
EPOCHS, BATCH, RATE, DECAY = 14, 128, 0.3, 1e-6
#: Words a worker remembers.
MEMORY = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def buckets(word: str, n: int = BUCKETS, grams=GRAMS) -> list[int]:
    """Buckets of a lower-cased word: its own and those of its n-grams, ``<`` and ``>`` being its ends."""
    full = f"<{word}>"
    found = [zlib.crc32(full.encode("utf-8", "surrogatepass")) % n]
    for k in grams:
        found += [zlib.crc32(full[i : i + k].encode("utf-8", "surrogatepass"), k) % n for i in range(len(full) - k + 1)]
    return found


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bag(text: str) -> dict[int, float]:
    """Weights of buckets; with those of ``NEUTRAL`` words without a vector they add up to 1."""
    own, out = set(words(text)), {}
    for word in own:
        found = buckets(word)
        share = 1 / (len(own) + NEUTRAL) / len(found)
        for b in found:
            out[b] = out.get(b, 0.0) + share
    return out


def train(bags: list[tuple], seed: int = 7):
    """(numbers of buckets, bias) from (label, buckets, weights); classes count alike, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    matrix = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    labels = np.array([b[0] for b in bags], np.int64)
    share = np.bincount(labels, minlength=2)
    if len(bags) == 0 or not share.all():
        return np.zeros(BUCKETS, np.float32), float(np.log((share[1] + 1) / (share[0] + 1)))
    cost = (len(bags) / 2 / share)[labels].astype(np.float32)
    params = [vectors, matrix, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = np.array([len(bags[r][1]) for r in rows])
            index = np.concatenate([bags[r][1] for r in rows])
            weight = np.concatenate([bags[r][2] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            used, place = np.unique(index, return_inverse=True)
            local = vectors[used]
            mean = np.stack([np.bincount(owner, weight * local[place, d], len(rows)) for d in range(WIDTH)], 1).astype(np.float32)
            scores = mean @ matrix + bias
            scores -= scores.max(1, keepdims=True)
            odds = np.exp(scores)
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(rows)), labels[rows]] -= 1
            odds *= (cost[rows] / len(rows))[:, None]
            back = odds @ matrix.T
            inner = np.stack([np.bincount(place, weight * back[owner, d], len(used)) for d in range(WIDTH)], 1).astype(np.float32)
            step += 1
            for p, m, v, g, where in zip(params, first, second, (inner + DECAY * local, mean.T @ odds, odds.sum(0)), (used, slice(None), slice(None))):
                m[where] = 0.9 * m[where] + 0.1 * g
                v[where] = 0.999 * v[where] + 0.001 * g * g
                p[where] -= rate * (m[where] / (1 - 0.9**step)) / (np.sqrt(v[where] / (1 - 0.999**step)) + 1e-8)
    line = matrix[:, 1] - matrix[:, 0]
    return (vectors @ line).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE):
    """A model from rows of ``labels`` (0 or 1) whose crc32(id as text) mod 5 is not 0; whole texts, ``sample`` of each label at most."""
    learnt = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    learnt = learnt.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    known = texts(docs, id_col, text_col).select("id").distinct().join(learnt, "id")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Of an id that repeats, the text with the least hash.
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = id_kind(rows)[1]

    def work(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            bags = [bag(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "size": [len(b) for b in bags], "b": [np.fromiter(b.keys(), np.int32).tobytes() for b in bags], "w": [np.fromiter(b.values(), np.float32).tobytes() for b in bags]})

    import numpy as np

    found = sent(rows).mapInPandas(work, f"id {kind}, label int, size int, b binary, w binary").collect()
    found.sort(key=lambda r: str(r["id"]))
    return train([(r["label"], np.frombuffer(r["b"], np.int32), np.frombuffer(r["w"], np.float32)) for r in found if r["size"]])


_words: dict = {}


def scorer(spark, model):
    """A function from a text column to its score, 0 to 1. A text without words, null or empty, has the score of the bias."""
    numbers, bias = model
    shared = spark.sparkContext.broadcast((numbers, bias, f"{zlib.crc32(numbers.tobytes())}/{bias}"))

    @F.pandas_udf("double")
    def score_of(column):
        import numpy as np
        import pandas as pd

        numbers, bias, name = shared.value
        if _words.get("model") != name:
            _words.clear()
            _words.update(model=name, known={})
        known = _words["known"]
        out = np.empty(len(column))
        for k, text in enumerate(column):
            own = dict.fromkeys(words(text or ""))
            total = 0.0
            for w in own:
                x = known.get(w)
                if x is None:
                    x = float(numbers[buckets(w)].mean())
                    if len(known) >= MEMORY:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = x
                total += x
            out[k] = bias + total / (len(own) + NEUTRAL)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return score_of


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; rows that repeat an id are scored each, a null id isn't held out."""
    rows = texts(docs, id_col, text_col)
    scored = rows.select("id", scorer(docs.sparkSession, model)("text").alias("score"))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return scored.select("id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` with a model fitted on ``docs`` and ``labels``. Without texts of both labels the score is that of their shares."""
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
