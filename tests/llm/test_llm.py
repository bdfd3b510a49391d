"""Operators of spanlake.llm against brute-force versions, on small tables and on odd cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import exact, licenses, lines, packing, quality, queries, simhash, tokens, toxicity, urls, warc

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, mark string, hash string, line int, component string"


def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    long_run, long_text = "abc" * 3000, "The quick brown fox jumps over the lazy dog. " * 2500
    body = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three"), (6, "A b c d e f g h."), (7, "a b c d e f g h."),
        (8, "x\ny\nx\n\ny"), (8, "x\ny\nx\n\ny"), (9, long_run), (10, long_text), (10, long_text), (11, long_text + "!"),
        (12, "é ü 中文 😀 <|endoftext|> it's we're !'s don't"), (13, "all rights reserved cc by cc by general public license"),
        (14, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (15, "w1 w2 w3 w4 XX w6 w7 w8 w9 w10"), (16, "w1 w2 w3 w4 w6 w7 w8 w9 w10"), (None, "no id"), (17, "a" * 70000),
    ]
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "clash", "m", "h", 3, "c") for k, t in body], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark)


def both(docs, odd):
    return [docs.collect(), odd.collect()], [docs, odd]


def key(x):
    return tuple((v is None, str(v)) for v in x)


def test_exact(docs, odd):
    for rows, df in zip(*both(docs, odd)):
        groups = {}
        for r in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
        want = []
        for norm, own in groups.items():
            best = min(own, key=lambda r: (-len(r.text or ""), (r.doc_id is not None, r.doc_id or 0)))
            want += [(r.doc_id, len(own), hashlib.sha256(norm.encode()).hexdigest()) for r in own]
            assert best
        got = exact.exact_groups(df).collect()
        assert sorted(((r.id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
        for r in got:
            if r.id is not None:
                own = groups[next(n for n in groups if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)]
                if all(o.doc_id is not None for o in own):
                    assert r.keep_id == min(own, key=lambda o: (-len(o.text or ""), o.doc_id)).doc_id


def test_simhash(docs, odd):
    import xxhash

    def fp(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for rows, df in zip(*both(docs, odd)):
        rows = [r for r in rows if r.doc_id is not None]
        fps = [fp(r.text) for r in rows]
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in itertools.combinations(range(len(rows)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(j)] = root(i)
        least = {}
        for i, r in enumerate(rows):
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
        want = sorted((r.doc_id, fps[i], least[root(i)]) for i, r in enumerate(rows))
        for dense in (simhash.DENSE, 1):
            got = simhash.near_groups(df.where("doc_id is not null"), dense=dense).collect()
            assert sorted((r.id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_links_dense(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 150:
        x = centre
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(1 << 62, size=50)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4}
    plain = {frozenset((r.a, r.b)) for r in simhash.links(nodes).collect()}
    assert plain == want
    near = simhash.components(simhash.links(nodes, dense=5)).collect()
    far = simhash.components(simhash.links(nodes)).collect()
    assert sorted(near) == sorted(far)


def test_tokens(docs, odd):
    path = tokens.vocabulary()
    lib = tokens.Encoder(path)
    for rows, df in zip(*both(docs, odd)):
        want = []
        for r in rows:
            ids = lib.ids(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
        for segment in (tokens.SEGMENT, 1000):
            got = [tuple(r) for r in tokens.round_trips(df, segment=segment).collect()]
            assert sorted(got, key=key) == sorted(want, key=key)


def test_tokens_white_space(spark):
    """Units of white space alone have no ids, and leave nothing between the ids and words of others."""
    body = ["foo \u00a0 bar", "foo\n\x0c\nbar", "\u3000 foo", "foo \u2028", " \u0085 ", "foo \x0b \u00a0 bar", "a \u00a0. b", ("foo \u00a0 bar\n\x0c\n" * 200)]
    lib = tokens.Encoder(tokens.vocabulary())
    want = []
    for k, t in enumerate(body):
        ids = lib.ids(t)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    df = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    for segment in (tokens.SEGMENT, 1000):
        assert sorted(tuple(r) for r in tokens.round_trips(df, segment=segment).collect()) == want


def test_tree_joins():
    import random

    rng, path = random.Random(5), tokens.vocabulary()
    lib = tokens.Encoder(path)
    pieces = ["the", "a", "ing", "'s", "!'", "é", "é", "9", "!!", "<|endoftext|>", "ß", "中", "😀", "x", "Z", " ", "\n", "\x1c", "\u00a0", "İ", "Σ", "."]
    for k in range(150):
        text = "".join(rng.choice(pieces[:15] if k % 2 else pieces) for _ in range(rng.randint(1, 800)))
        enc = tokens.Encoder(path, leaf=rng.choice([5, 17, 64, 200]), long=rng.choice([4, 16, 100]))
        ids = [i for u in enc.tree(text) for i in (enc.known[u] if isinstance(u, str) else u.ids)]
        assert ids == lib.ids(text)


def test_packing(docs, odd):
    lib = tokens.Encoder(tokens.vocabulary())
    for rows, df in zip(*both(docs, odd)):
        df = df.where("doc_id is not null").dropDuplicates(["doc_id"])
        ids = {r.doc_id: lib.ids(r.text or "") + [2] for r in df.collect()}
        got = packing.pack(df, block=20000).collect()
        sequences = {}
        for doc, own in ids.items():
            pieces = sorted((r for r in got if r.id == doc), key=lambda r: r.start)
            at = 0
            for p in pieces:
                assert p.start == at and p.doc_tokens == len(own) and p.length > 0
                assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes())
                at += p.length
                sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
            assert at == len(own)
        padding = total = 0
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
            padding += 0 if at & (at - 1) == 0 else 4096 - at
            total += at
        assert padding < 0.02 * total


def test_best_cuts():
    rng = np.random.default_rng(1)
    for _ in range(30):
        steps = rng.integers(1, 9, 12)
        places = [0, *np.cumsum(steps).tolist()]
        penalties = [0, *rng.integers(0, 6, 11).tolist(), 0]

        def price(cuts):
            return sum(20 - (places[b] - places[a]) + penalties[b] for a, b in zip(cuts, cuts[1:]))

        ways = ([0, *c, 12] for n in range(12) for c in itertools.combinations(range(1, 12), n))
        best = min(price(c) for c in ways if all(places[b] - places[a] <= 20 for a, b in zip(c, c[1:])))
        assert price(packing.best_cuts(places, penalties, 20)) == best


def test_lines(docs, odd):
    for rows, df in zip(*both(docs, odd)):
        own = sorted({(r.doc_id, k, " ".join(lines.line_words(x))) for r in rows if r.doc_id is not None for k, x in enumerate((r.text or "").split("\n")) if lines.line_words(x)})
        first, equal, near = {}, set(), set()
        for doc, k, words in own:
            if words in first:
                equal.add((doc, k))
            else:
                first[words] = (doc, k)
        unique = [(at, w.split(" ")) for w, at in first.items() if len(w.split(" ")) >= lines.MIN_WORDS]
        for (a, x), (b, y) in itertools.combinations(unique, 2):
            if abs(len(x) - len(y)) <= 1 and lines.one_edit(x, y):
                near.add(max(a, b))
        got = lines.dropped_lines(df).collect()
        assert {(r.id, r.line) for r in got if not r.near} == equal
        assert {(r.id, r.line) for r in got if r.near} == near
        out = {r.doc_id: r for r in lines.dedup_lines(df.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
        assert len(out) == len({r.doc_id for r in rows if r.doc_id is not None})


def distance(a, b):
    """Word edits between a and b, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def test_lines_grow(spark, docs):
    """One edit, and one more for every 20 words of the shorter line, whatever the edits and wherever they are."""
    import random

    rng, made = random.Random(3), []
    for n in (8, 19, 20, 21, 39, 40, 41, 54, 60, 61, 79, 80, 130, 199, 200, 203, 300, 700):
        base = [f"v{rng.randrange(10**6)}" if rng.random() < 0.7 else rng.choice(["the", "of"]) for _ in range(n)]
        made.append(base)
        for extra in (0, 0, 0, 1, 2):
            words = list(base)
            for _ in range(n // 20 + 1 + extra):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                words[at : at + (kind != 1)] = [] if kind == 2 else [f"z{rng.randrange(10**6)}"]
            made.append(words)
    made += [["same"] * 30, ["same"] * 32, ["same"] * 35]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(made)], "doc_id long, text string")
    for rows, table in ((df.collect(), df), (docs.select("doc_id", "text").collect(), docs)):
        first = {}
        for doc, k, words in sorted((r.doc_id, k, " ".join(x.lower().split())) for r in rows for k, x in enumerate((r.text or "").split("\n"))):
            first.setdefault(words, (doc, k))
        unique = [(at, w.split(" ")) for w, at in first.items() if len(w.split(" ")) >= lines.MIN_WORDS]
        want = set()
        for (a, x), (b, y) in itertools.combinations(unique, 2):
            most = min(len(x), len(y)) // 20 + 1
            if abs(len(x) - len(y)) <= most and len(set(x) ^ set(y)) <= 2 * most and distance(x, y) <= most:
                want.add(max(a, b))
        assert {(r.id, r.line) for r in lines.dropped_lines(table, grow=True).collect() if r.near} == want


def test_lines_short(spark):
    """One edit in lines of four words or more, also where the other line has a word more."""
    body = ["a b c d", "a b x d", "a b c d e", "p q r", "p q s", "p q r t", "k l m n o p q", "k l m n o p q r", "k l x n o p q r", "y a b c d", "one two", "one two three four", "g h i j", "h i j w"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(body)], "doc_id long, text string")
    want = {b for a, b in itertools.combinations(range(len(body)), 2) for x, y in [(body[a].split(), body[b].split())] if min(len(x), len(y)) >= 4 and distance(x, y) <= 1}
    for grow in (False, True):
        assert {r.id for r in lines.dropped_lines(df, grow=grow).collect()} == want == {1, 2, 7, 8, 9}


def test_quality_base(docs, odd):
    for rows, df in zip(*both(docs, odd)):
        got = {(r.doc_id, r.text): r for r in quality.judged(df, []).collect()}
        for r in rows:
            text = r.text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
            counts = {}
            for g in grams:
                counts[g] = counts.get(g, 0) + 1
            hit = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(8)}
            own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            q = got[(r.doc_id, r.text)]
            assert (q._q.n_words, q._q.word_chars, q._q.n_symbols, q._q.n_dup_lines, q._q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(hit))
            assert q._base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and q._kept == (not q._base_failed)


def test_quality_learns():
    rng = np.random.default_rng(2)
    columns = {k: rng.random(600) for k in quality.FEATURES}
    bad = (columns["symbols"] > 0.8) & (columns["upper"] > 0.3)
    rules = quality.learn(columns, bad)
    found = np.zeros(600, bool)
    for rule in rules:
        found |= np.logical_and.reduce([columns[t.feature] >= t.threshold if t.above else columns[t.feature] <= t.threshold for t in rule])
    assert (found == bad).mean() > 0.97
    assert quality.learn({k: v[:0] for k, v in columns.items()}, bad[:0]) == []


def test_licenses(docs, odd):
    for rows, df in zip(*both(docs, odd)):
        got = licenses.scan(df).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.id, []).append(r)
        for r in rows:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            places, labels = [], set()
            for phrase, label in licenses.PHRASES:
                p = phrase.split()
                at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
                places += at
                labels |= {label} if at else set()
            want = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
            assert any((x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == want and labels <= set(x.labels.split(",")) and 0 <= x.score <= 1 for x in by[r.doc_id])


def test_license_spans(spark):
    text = "some words before. permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files (the software), to deal in the software without any restriction. words after"
    df = spark.createDataFrame([(1, text), (2, "the software without restriction"), (3, "Released under the MIT License.")], "doc_id long, text string")
    assert {(r.id, r.label) for r in licenses.spans(df).collect()} == {(1, "mit"), (3, "mit")}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme.net/"), (4, "http://A.Example.NET/en/1?x"), (5, "https://net/"), (6, "http://b.net"), (7, "http://x.org/fr/a#b"), (8, "http://example.com/de/"), (9, "http://notexample.com/de/"), (10, "http://x.org?/fr/"), (11, "a://b://c.net/d"), (11, "a://b://c.net/d")]
    got = {r.id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[3].host) == ("", "", "")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[5].rule, got[6].rule, got[6].path) == ("net/", None, "")
    assert (got[7].rule, got[8].rule, got[9].rule, got[10].rule) == ("org/fr/", "example.com/de/", None, None)
    assert (got[11].host, got[11].path) == ("b:", "//c.net/d")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model(spark):
    good = [(k, f"http://a{k}.org/fr/news-article-{k}") for k in range(60)]
    bad = [(100 + k, f"http://b{k}.net/xxqqzz{k}") for k in range(60)]
    new = [(300, "http://c.info/news-article-7"), (301, "http://c.info/xxqqzz7")]
    got = {r.id: r.verdict for r in urls.judge(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert (got[300], got[301]) == ("allow", "block")


def test_url_query(spark):
    """Urls that differ only in query or fragment, or that have no ``://``, get scores of their own."""
    rows = [(k, f"http://{'a.net' if k % 2 else 'a.org/fr'}/x?q={'spam' if k % 2 else 'news'}#{'zzz' if k % 2 else 'top'}") for k in range(20)]
    rows += [(20, "http://a.info/x?q=news#top"), (21, "http://a.info/x?q=spam#zzz"), (22, "http://a.info/x"), (23, "spam"), (24, "news"), (25, None)]
    got = {r.id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[20].verdict == "allow" and got[21].verdict == "block" and (got[20].host, got[20].path) == (got[21].host, got[21].path) == ("a.info", "/x")
    assert len({got[k].score for k in range(20, 26)}) == 6 and got[0].rule == "org/fr/" and got[1].rule == "net/"


def test_warc(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3000
    rows = [(1, None, None), (2, "http://x", ""), (3, "u", "é" * 700), (4, "u", "é" * 700), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "bad url\r\nX: y", tricky), (8, "u", "\r\n\r\n"), (9, "u", "end\r\n"), (10, "u", tricky), (11, "u", "\r" * 70000), (12, "u", "z" * 32768)]
    got = {r.id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        same = [x[0] for x in rows if x[2] == html and len(data) >= 1000]
        to = max(same) if same and max(same) != k else None
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to)


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    rows = [(k, ("you stupid idiot " if k % 2 else "a kind friend ") + f"w{k % 7} and more") for k in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(train, marks)
    new = spark.createDataFrame([(1, "what a stupidd idiott"), (2, "kindly friends"), (3, None), (4, "")], "doc_id long, text string")
    s = {r.id: r.score for r in toxicity.score(new, model).collect()}
    assert s[1] > 0.5 > s[2] and s[3] == s[4]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert exact.exact_groups(docs).count() == simhash.near_groups(docs).count() == tokens.round_trips(docs).count() == 0
    assert packing.pack(docs).count() == lines.dropped_lines(docs).count() == lines.dedup_lines(docs).count() == 0
    assert toxicity.scores(docs, labels).count() == quality.judged(docs, quality.fit(docs, labels)).count() == 0
    assert licenses.scan(docs).count() == warc.round_trip(pages).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    last = p.STAGES[-1][1](spark, kept, SMALL)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids and 0 < len(ids) < docs.count()
    assert set(queries.QUERIES) == {n for n in queries.QUERIES if n.startswith("op")} and len(queries.QUERIES) == 13


BIG = 2**53


def test_big_ids(spark):
    """Ids that no float holds, beside a null one, keep their values."""
    rows = [(BIG + 1, "one two three four five"), (BIG + 3, "six seven eight"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {BIG + 1, BIG + 3, None}
    assert {r.id for r in packing.pack(df).collect()} == want
    assert {r.id for r in tokens.round_trips(df).collect()} == {r.id for r in tokens.round_trips(df, segment=4).collect()} == want
    assert {r.id for r in simhash.near_groups(df).collect()} == want
    assert {r.id for r in exact.exact_groups(df).collect()} == {r.id for r in licenses.scan(df).collect()} == want


def test_exact_ties(spark):
    rows = [(1, "a b"), (1, "ab"), (2, "ab "), (None, "a  b"), (3, ""), (3, None), (4, "x"), (4, "x"), (None, "y"), (None, "y")]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault((r.id, r.keep_id, r.group_size), []).append(r.kept)
    assert by[(None, None, 4)] == [True] and by[(1, None, 4)] == [False, False] and by[(2, None, 4)] == [False]
    assert by[(3, 3, 2)] == by[(4, 4, 2)] == by[(None, None, 2)] == [True, True]


def test_chains(spark):
    """Keys of three segments give the links that keys of two give."""
    assert [len(simhash._turns(i, 2)) for i in range(5)] == [14, 14, 14, 13, 14] and len(simhash._turns(0, 3)) == 1 + 26 + 13 * 13 + 13 * 12 // 2
    rng = np.random.default_rng(4)
    fps = set()
    for x in rng.integers(1 << 62, size=60):
        fps |= {int(x), int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False))}
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 4}
    for chain in (2, 3):
        assert {frozenset((r.a, r.b)) for r in simhash.links(nodes, chain=chain).collect()} == want
        assert simhash._keys(nodes, False, chain).select("key").distinct().count() > 2 * len(fps)


def test_tree_ids():
    """Ids come from the joins: leaves and windows, for a tokenizer that drops white space and one that keeps it."""
    import random

    import public_tokenizers

    rng = random.Random(8)
    lib = tokens.Encoder(tokens.vocabulary())
    words = ["alpha", "Beta", "gamma's", "x" * 40, "été", "12345", "...", "don't", "中文字", "a-b-c"]
    for n in (10**4, 10**5):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "", "\t "]) for _ in range(n // 6))
        units = lib.tree(text)
        assert any(isinstance(u, tokens.Run) for u in units)
        assert [i for u in units for i in (u.ids if isinstance(u, tokens.Run) else lib.ids(u))] == lib.ids(text)
    keeps = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), leaf=300)
    assert lib.splits and not keeps.splits
    text = " ".join(rng.choice(words) for _ in range(3000)) + "\n\n  end"
    assert [i for u in keeps.tree(text) for i in u.ids] == keeps.ids(text) == [i for p in keeps.all(text) for i in p]


def test_lines_left(spark, docs):
    """The text that is left, line by line, and the counts; columns with odd names stay."""
    rows = [r for r in docs.select("doc_id", "text").collect()]
    gone = {}
    for r in lines.dropped_lines(docs, grow=True).collect():
        gone.setdefault(r.id, {})[r.line] = r.near
    odd = docs.withColumns({c: F.lit(c) for c in ("_gone", "gone", "near", "_near", "words", "key", "_q", "_kept")})
    out = lines.dedup_lines(odd, grow=True)
    assert {"_gone", "gone", "near", "words", "key", "_q", "_kept"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    got = {r.doc_id: r for r in out.collect()}
    for r in rows:
        own, lost = (r.text or "").split("\n"), gone.get(r.doc_id, {})
        left = "\n".join(x for k, x in enumerate(own) if k not in lost) if lost else r.text
        g = got[r.doc_id]
        assert (g.text, g._near, g._exact, g._lines) == (left, sum(lost.values()), len(lost) - sum(lost.values()), sum(bool(x.strip()) for x in own)) and g._gone == "_gone"


def test_class_keys():
    """Two lines of up to ``edits`` edits share a key of both kinds, words that repeat and hash classes without a word included."""
    import random

    rng = random.Random(6)
    for _ in range(400):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 5, 40, 10**6]))]
        a = [rng.choice(vocabulary) for _ in range(rng.choice([20, 21, 25, 39, 40, 41, 60, 63, 120, 300]))]
        b = list(a)
        for _ in range(rng.randint(0, lines.edits(len(a)))):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(vocabulary)]
        if min(len(a), len(b)) >= lines.STEP and lines.near(a, b):
            for made in (lines.class_keys, lines.deletion_keys):
                owners, keys = made([a, b])
                assert set(keys[owners == 0]) & set(keys[owners == 1])


def test_quality_list(spark, docs):
    """What is fitted on a table: each row's verdict is that of its list, applied in plain Python; odd columns stay."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality.fit(docs, labels)
    odd = docs.withColumns({c: F.lit(c) for c in ("_q", "_kept", "_base_failed", "_qw", "_ql", "row")})
    kept = quality.passed(odd, rules)
    assert kept.columns == odd.columns and {r._kept for r in kept.collect()} <= {"_kept"}
    ids = {r.doc_id for r in kept.collect()}
    rejected = 0
    for r in quality.judged(docs, rules).collect():
        q = r._q.asDict()
        value = lambda f: eval(re.sub(r"_q\.(\w+)", r"q['\1']", quality.FEATURES[f]).replace("greatest", "max"), {"q": q, "max": max})  # noqa: B023,E731
        hit = any(all(value(t.feature) >= t.threshold if t.above else value(t.feature) <= t.threshold for t in rule) for rule in rules)
        base = q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"]
        assert r._kept == (not base and not hit) == (r.doc_id in ids)
        rejected += hit
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(known[i] for i in ids if i in known) >= 0.9 * sum(v for v in known.values() if v)


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def test_license_order(spark):
    """Spans are verified in the order of words, also with words put between, and rows without an id have labels too."""
    notice = licenses.TEMPLATES[0][1]
    w = notice.split()
    broken = " ".join(w[:16] + ["one", "two", "three", "four", "five"] + w[16:])
    mixed = " ".join(" ".join(w[i : i + 3]) for i in sorted(range(0, len(w), 3), key=lambda i: (i * 7) % 11))
    df = spark.createDataFrame([(1, notice), (2, broken), (3, mixed), (None, notice), (5, "plain text"), (6, None)], "doc_id long, text string")
    got = {r.id: r for r in licenses.scan(df).collect()}
    assert all("apache-2.0" in got[k].labels for k in (1, 2, None)) and got[1].score == 1.0 and got[5].labels == ""
    plain = re.findall(r"[a-z0-9]+", notice.lower())
    for r in licenses.spans(df).where("id is not null").collect():
        text = re.findall(r"[a-z0-9]+", {1: notice, 2: broken, 3: mixed}[r.id].lower())
        own, template = text[r.start : r.start + r.length], re.findall(r"[a-z0-9]+", licenses.TEMPLATES[r.template][1].lower())
        assert r.score == pytest.approx(_subsequence(template, own) / len(template)) and r.score >= licenses.SHARE
    assert plain


def test_url_ratios(spark):
    """The models' probabilities, place by place, against counts in plain Python."""
    import math

    good, bad = ["http://a.org/fr/ab", "http://b.org/fr/abc"], ["http://x.net/zz9", "http://y.net/zz"]
    rows = [(x, True) for x in good] + [(x, False) for x in bad]
    df = spark.createDataFrame(rows, "line string, accepted boolean")
    counts = {True: {}, False: {}}
    for line, side in rows:
        framed = "^^^" + re.sub(r"\d", "0", line) + "$"
        for i in range(3, len(framed)):
            for k in range(4):
                key = (framed[i - k : i], framed[i])
                counts[side][key] = counts[side].get(key, 0) + 1
    seen = set(counts[True]) | set(counts[False])

    def p(side, before, char):
        own = counts[side].get((before, char), 0)
        total = sum(n for (b, _), n in counts[side].items() if b == before)
        lower = p(side, before[1:], char) if before else 1 / 256
        return (own + 2.0 * lower) / (total + 2.0)

    asked = ["http://c.org/abz", "q", ""]
    got = {r.line: r.score for r in urls.scored(spark.createDataFrame([(x,) for x in asked], "line string"), urls.ratios(df), "line").collect()}
    for line in asked:
        framed, total = "^^^" + re.sub(r"\d", "0", line) + "$", 0.0
        for i in range(3, len(framed)):
            k = next((k for k in (3, 2, 1, 0) if (framed[i - k : i], framed[i]) in seen), None)
            total += 0.0 if k is None else math.log(p(True, framed[i - k : i], framed[i]) / p(False, framed[i - k : i], framed[i]))
        assert got[line] == pytest.approx(total / (len(framed) - 3))


def _plain_train(bags, seed=7):
    """The training of ``toxicity.train``, example by example, with dense gradients."""
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.WIDTH)).astype(np.float32).astype(float)
    m = rng.normal(0, 0.5, (toxicity.WIDTH, 2)).astype(np.float32).astype(float)
    bias = np.zeros(2)
    share = [sum(b[0] == k for b in bags) for k in (0, 1)]
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in (v, m, bias)], 0
    for epoch in range(toxicity.EPOCHS):
        order, rate = rng.permutation(len(bags)), toxicity.RATE * (1 - epoch / toxicity.EPOCHS)
        for at in range(0, len(order), toxicity.BATCH):
            rows = order[at : at + toxicity.BATCH]
            gv, gm, gb, used = np.zeros_like(v), np.zeros_like(m), np.zeros(2), set()
            for r in rows:
                label, index, weight = bags[r]
                mean = sum(w * v[i] for i, w in zip(index, weight))
                e = np.exp(mean @ m + bias)
                d = e / e.sum()
                d[label] -= 1
                d *= len(bags) / 2 / share[label] / len(rows)
                gm += np.outer(mean, d)
                gb += d
                for i, w in zip(index, weight):
                    gv[i] += w * (m @ d)
                    used.add(int(i))
            step += 1
            used = sorted(used)
            gv[used] += toxicity.DECAY * v[used]
            for p, g, (a, b), where in zip((v, m, bias), (gv, gm, gb), moments, (used, slice(None), slice(None))):
                a[where] = 0.9 * a[where] + 0.1 * g[where]
                b[where] = 0.999 * b[where] + 0.001 * g[where] ** 2
                p[where] -= rate * (a[where] / (1 - 0.9**step)) / (np.sqrt(b[where] / (1 - 0.999**step)) + 1e-8)
    return v @ (m[:, 1] - m[:, 0]), bias[1] - bias[0]


def test_toxicity_training(spark):
    """Training against the plain one, scores against sums over bags, and one text for an id that repeats."""
    body = ["bad awful mean", "bad ugly", "kind good nice", "good day", "nice walk today"]
    bags = []
    for k, text in enumerate(body):
        own = toxicity.bag(text)
        bags.append((int(k < 2), np.fromiter(own.keys(), np.int32), np.fromiter(own.values(), np.float32)))
    numbers, bias = toxicity.train(bags)
    plain, plain_bias = _plain_train(bags)
    assert np.abs(numbers - plain).max() < 0.02 * np.abs(plain).max() and abs(bias - plain_bias) < 0.02
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*body, "badd kindness", ""])], "doc_id long, text string")
    for r in toxicity.score(df, (numbers, bias)).collect():
        total = bias + sum(w * numbers[b] for b, w in toxicity.bag([*body, "badd kindness", ""][r.id]).items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-4)
    twice = spark.createDataFrame([(k, t) for k, t in enumerate(body)] + [(0, "quite other words")], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 2)) for k in range(5)], "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit(twice, marks)[0], toxicity.fit(twice.orderBy("text").repartition(3), marks)[0])


def _warc_records(data):
    """Records of an archive by the standard alone: named fields, then a block of Content-Length, then two line ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *fields = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        h = dict(x.split(": ", 1) for x in fields)
        assert {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= set(h)
        n = int(h["Content-Length"])
        block, at = data[end + 4 : end + 4 + n], end + 4 + n
        assert len(block) == n and data[at : at + 4] == b"\r\n\r\n"
        at += 4
        yield h, block


def test_warc_ids(spark, tmp_path):
    """Large, repeated and null ids, and what an independent parser makes of the archives."""
    import glob
    import gzip

    x, y, z = "x" * 2000, "y\r\n\r\n" * 500, "zé" * 40000
    rows = [(1, "http://a", x), (2, "http://b", x), (1, "http://c", y), (BIG + 1, "u", z), (BIG + 3, "u", z), (None, "u", z), (None, "u", "w" * 1500), (7, None, None), (2, "http://b", x)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, hash string, n int").repartition(2)
    got = sorted(((r.page_id if "page_id" in r else r.id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=key)
    want = [(1, 2000, "revisit", 2), (2, 2000, "response", None), (2, 2000, "response", None), (1, 2500, "response", None), (BIG + 1, 120000, "revisit", BIG + 3), (BIG + 3, 120000, "response", None), (None, 120000, "revisit", BIG + 3), (None, 1500, "response", None), (7, 0, "response", None)]
    assert got == sorted(want, key=key)
    warc.write(df, f"file://{tmp_path}/out")
    payloads, referred, names = {}, set(), set()
    for path in glob.glob(f"{tmp_path}/out/*.gz"):
        found = list(_warc_records(gzip.open(path).read()))
        assert not found or found[0][0]["WARC-Type"] == "warcinfo"
        for h, block in found:
            kind, name = h["WARC-Type"], h["WARC-Record-ID"]
            names.add(name)
            if kind == "response":
                head, _, body = block.partition(b"\r\n\r\n")
                assert head.startswith(b"HTTP/1.1 200") and h["Content-Type"] == "application/http;msgtype=response"
                payloads[name] = body
            elif kind == "continuation":
                assert int(h["WARC-Segment-Number"]) > 1
                payloads[h["WARC-Segment-Origin-ID"]] += block
            elif kind == "revisit":
                referred.add(h["WARC-Refers-To"])
    assert sorted(payloads.values()) == sorted(p.encode() for p in {x, y, z, "w" * 1500, ""}) and referred <= set(payloads)


def test_clear(spark):
    from spanlake.llm import common

    df = common.stored(spark.range(3), "three")
    assert df.count() == 3 and (folder := common.run_folder(spark))
    common.clear(spark)
    assert common.run_folder(spark) != folder


def test_near_bags():
    """Ruling pairs out by the words that each lacks loses none that are near: moved, changed, added and lost words."""
    import random

    rng, found = random.Random(5), 0
    for _ in range(600):
        a = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(4, 90))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b))
            kind = rng.randrange(4)
            if kind == 0:
                b[at] = f"w{rng.randrange(40)}"
            elif kind == 1:
                b.insert(at, f"w{rng.randrange(40)}")
            elif kind == 2 and len(b) > 4:
                del b[at]
            else:
                b.append(b.pop(at))
        want = lines.within(a, b, lines.edits(min(len(a), len(b))))
        assert lines.near(a, b) == want == lines.near(b, a)
        found += want
    assert 50 < found < 550
