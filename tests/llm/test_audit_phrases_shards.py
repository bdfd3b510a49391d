"""Filter audit, phrases and shards against brute force, on the small tables and on odd cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from spanlake.llm import audit, phrases, sharding

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, id string, hash string, bits int, mask int, words string, w1 string, f long, n long, size int, shard int, part string, quality int"


def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    say = "big red dog, Big red\tdog! big red dog runs home; red dog runs " * 9
    body = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (3, "", None, "a"), (4, say, "en", "b"), (4, say, "en", "b"), (5, say, None, "a"), (None, say, "de", None), (None, None, "", "a"),
        (6, "x" * 50_000, "en", "a"), (7, "word " * 3000 + "$", "en", "b"), (8, "A B C d e f " * 20, "fr", "b"), (9, "é\x1cü\xa0中文 big red dog", "en", "a"), (10, "a.b" * 900 + " a.b c", "en", "a"),
    ]
    rest = ("i", "h", 7, 7, "w", "w", 7, 7, 7, 7, "p", 1)
    return spark.createDataFrame([(*r, *rest) for r in body], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def audited(rows, labels):
    """Failure masks of rows, then every order step by step."""
    marks = defaultdict(lambda: [False, False])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id][0] |= quality == 1
            marks[doc_id][1] |= toxic == 1
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    parts = defaultdict(list)
    for r in rows:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(name for name, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t) is not None, r.doc_id is not None and r.doc_id > least[t])) if x)
        parts[r.source or ""].append((fails, *(marks[r.doc_id] if r.doc_id is not None else (False, False))))
    out = []
    for part, own in parts.items():
        every, some = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                every[f] += len(gone)
                late = sum(f in x[0] for x in own) - len(gone)
                some.append((part, "".join(order), step, len(left), len(gone), late, sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*x, every[x[1][x[2] - 1]]) for x in some]
    return sorted(out)


def test_audit(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = [(4, 1, None), (4, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (1, None, 1)]
    for df, marks in ((docs, labels), (odd_docs(spark), labels_of(spark, odd))):
        want = audited(df.collect(), [tuple(r[c] for c in ("doc_id", "quality", "toxic")) for r in marks.collect()])
        assert sorted(map(tuple, audit.interactions(df, marks).collect())) == want
    assert audit.interactions(docs.limit(0), labels).count() == 0
    for heavy in (1, 10**9):  # every copy joined by a shuffle, or by broadcast
        got = audit.masks(odd_docs(spark), labels_of(spark, odd), heavy=heavy)
        assert sum(r["n"] for r in got.collect()) == odd_docs(spark).count()


def test_diagram():
    """119 swaps lead through all orders; equal sub-diagrams are one node."""
    orders, now = {tuple(range(5))}, list(range(5))
    for k in audit.plain_changes(5):
        now[k], now[k + 1] = now[k + 1], now[k]
        orders.add(tuple(now))
    assert len(orders) == 120
    diagram = audit.Diagram({m: (1, 0, 0) for m in range(32)}, "ABCDE")
    assert [len(t) for t in diagram.tables] == [1] * 5
    rng = random.Random(1)
    weights = {m: (rng.randrange(3), 0, 0) for m in range(32)}
    diagram = audit.Diagram(weights, "ABCDE")
    for k in audit.plain_changes(5):
        diagram.swap(k)
        fresh = audit.Diagram({sum(1 << diagram.order.index("ABCDE"[b]) for b in range(5) if m >> b & 1): w for m, w in weights.items()}, "".join(diagram.order))
        assert [len(t) for t in diagram.tables] == [len(t) for t in fresh.tables]
        assert list(diagram.steps()) == list(fresh.steps())


def mined(rows, least, top, share):
    count, total = Counter(), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            count.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + m]) for p, a in found.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if 100 * a >= share * count[(p[0], *p[i : i + m])]}
    out = defaultdict(list)
    for p, a in found.items():
        if p not in gone:
            cuts = [(2_000_000 * a // (count[p[:k]] + count[(p[0], *p[k:])]), k, count[p[:k]], count[(p[0], *p[k:])]) for k in range(2, len(p))]
            score, _, l, r = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, k, ph.decode(), -a, l, r, total[lang], -s) for lang, own in out.items() for k, (s, a, ph, l, r) in enumerate(sorted(own)[:top], 1))


def test_phrases(spark, docs):
    for df, least, top, share, bits in ((docs, 5, 2000, 80, 24), (docs, 3, 50, 50, 8), (odd_docs(spark), 2, 2000, 80, 24)):
        got = phrases.collocations(df, least=least, top=top, share=share, bits=bits)
        assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == mined(df.collect(), least, top, share)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_segments(monkeypatch):
    """Texts in segments, and words longer than one, give the counts of whole texts."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 40, "d.", "e\te", ""]) for _ in range(200)) for _ in range(5)] + ["z" * 99, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y", "", "x", "x", "x"]), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["lang", "text"])

    def counted():
        out = Counter()
        for b in phrases._short(iter([batch])):
            for row in b.to_pylist():
                out[row["key"]] += row["f"]
        return out

    whole = counted()
    monkeypatch.setattr(phrases, "SEGMENT", 16)
    assert counted() == whole


def test_difference():
    """Parts keep their items, and the spread is that of differencing two numbers at a time."""
    for items in ([8, 7, 6, 5, 4], [10, 10, 1], [5], [0, 0, 0]):
        left = sorted(items)
        while len(left) > 1:
            b, a = left.pop(), left.pop()
            left = sorted([*left, b - a])
        sums = [0, 0]
        for x, to in zip(items, sharding.difference([[x, 0] for x in items])):
            assert sorted(to) == [0, 1]
            sums[to[0]] += x
        assert abs(sums[0] - sums[1]) == left[0]
    assert sharding.difference([]) == []


def test_shards(spark, docs):
    rng = random.Random(3)
    many = spark.createDataFrame([(k, "t" * rng.randrange(400) + str(k % 900)) for k in range(3000)] + [(k, "hot") for k in range(1500)], "doc_id long, text string")
    for df, sizes in ((docs, {}), (odd_docs(spark), {}), (many, {"block": 16, "blocks": 64, "heavy": 20, "cell": 100}), (many, {"block": 64, "cell": 100})):
        rows, got = df.collect(), sharding.shards(df, **sizes).collect()
        assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == Counter((r.id, r["size"], r.text_crc32) for r in got)
        where, slots, total, group = defaultdict(set), defaultdict(list), Counter(), Counter()
        for r in got:
            assert r["size"] > 0
            where[r.text_crc32, r["size"]].add(r.shard)
            slots[r.shard].append(r.slot)
            total[r.shard] += r["size"]
            group[r.text_crc32, r["size"]] += r["size"]
        assert all(len(s) == 1 for s in where.values()) and set(slots) <= set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
        if df is many:
            assert max(total.values()) - min(total.values()) <= 50
        assert max(total.values()) <= max(max(group.values()), math.ceil(sum(total.values()) / 8) + sorted(group.values())[-2])
    first = sorted(tuple(map(str, r)) for r in sharding.shards(many).collect())
    assert sorted(tuple(map(str, r)) for r in sharding.shards(many.repartition(7)).collect()) == first
    assert sharding.shards(docs.limit(0)).count() == 0
