"""Line dedup of rows that share an id."""

import itertools
import random
from collections import Counter

from spanlake.llm import lines


def test_shared_ids(spark):
    """Lines go only where the same words stand earlier, whatever the ids: nothing unique is lost."""
    body = [
        (1, "alpha beta gamma delta\nepsilon zeta eta theta", "a"), (2, "alpha beta gamma delta\nx", "b"), (2, "unique words only here\nx y", "c"),
        (2, "unique words only here\nx y", "d"), (3, "x\nalpha beta gamma other\nlast line of all", "e"), (None, "alpha beta gamma delta", "f"), (3, None, "g"), (3, "", "h"),
    ]
    for grow in (False, True):
        out = lines.dedup_lines(spark.createDataFrame(body, "doc_id long, text string, number string"), grow=grow)
        assert out.columns == ["doc_id", "text", "number", "_lines", "_exact", "_near"]
        got = {r["number"]: r for r in out.collect()}
        assert len(got) == len(body) and got["a"].text == body[0][1] and got["c"].text == got["d"].text == "unique words only here\nx y"
        assert (got["b"].text, got["b"]._exact) == ("x", 1) and got["f"].text == body[5][1] and got["g"].text is None and got["h"].text == ""
        assert (got["e"].text, got["e"]._exact, got["e"]._near) == ("last line of all", 1, 1)
        left = Counter(x for r in got.values() for x in set((r.text or "").split("\n")))
        assert all(left[x] for x in ("epsilon zeta eta theta", "unique words only here", "x y", "last line of all", "alpha beta gamma delta"))


def test_key_counts():
    """Keys grow with a line's words, not with their square."""
    rng = random.Random(8)
    for n in (20, 400, 5000, 500_000):
        line = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        assert len(lines.class_keys([line])[1]) <= 3 * n and len(lines.deletion_keys([line])[1]) <= 12 * n


def test_long_line(spark):
    """A line of 200 000 words meets its near copy; one with an edit too many for a short line doesn't."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**5)}" for _ in range(200_000)]
    other = [f"x{k}" if k % 20_000 == 7 else w for k, w in enumerate(words)]
    body = [(1, " ".join(words)), (2, "short one\n" + " ".join(other)), (3, " ".join(reversed(words[: 100_000])))]
    got = lines.dropped_lines(spark.createDataFrame(body, "doc_id long, text string"), grow=True).collect()
    assert [(r.id, r.line, r.near) for r in got] == [(2, 1, True)]


def test_hot_key(spark, monkeypatch):
    """Lines of one template that are no near copies share keys: held in blocks, each still meets all earlier ones."""
    monkeypatch.setattr(lines, "HELD", 8)
    rng = random.Random(10)
    base, made = [f"t{k}" for k in range(24)], []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(24), 4):
            words[at] = f"v{rng.randrange(10**6)}"
        made.append(words)
        if k % 9 == 8:
            near = list(rng.choice(made))
            near[rng.randrange(24)] = "edited"
            made.append(near)
    want = {b for a, b in itertools.combinations(range(len(made)), 2) if lines.within(made[a], made[b], 2)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(made)], "doc_id long, text string")
    assert {r.id for r in lines.dropped_lines(df, grow=True).collect()} == want and len(want) >= 10


def test_shuffles_are_released(spark, monkeypatch):
    """Shuffles of settled short lines and of keys are let go before the next ones are written, and ids are compared only under keys of several lines."""
    kept, release, seen = lines.stored, lines.release, []
    plans = {}

    def stored(df, name):
        seen.append(name)
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return kept(df, name)

    monkeypatch.setattr(lines, "stored", stored)
    monkeypatch.setattr(lines, "release", lambda spark: seen.append("release") or release(spark))
    words = [f"w{k}" for k in range(60)]
    body = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :]) + "\nalpha beta gamma delta") for k in range(3)]
    out = lines.dropped_lines(spark.createDataFrame(body, "doc_id long, text string"), grow=True)
    assert {(x.id, x.line, x.near) for x in out.collect()} == {(1, 0, True), (2, 0, True), (1, 1, False), (2, 1, False)}
    assert all(seen[seen.index(name) + 1] == "release" for name in ("settled", "variants"))
    windows = [k for k, x in enumerate(plans["shared"]) if "Window [" in x]
    assert len(windows) == 2 and any("Filter (n#" in x for x in plans["shared"][windows[0] : windows[1]])


def test_plain_lines():
    """Lines whose words needn't be split to be normalised, and those where they must: every kind of white space, at any place."""
    import sys

    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    made = [a + f"Ab{c}c d" + b for c in spaces for a in ("", c, "\n", "x\n") for b in ("", c, "\n", c + "\nY")] + ["", "\n", "ΑΣ\nΑΣ Σ", "a b\nc", "\ud800 A"]
    for text in made:
        assert lines.plain_lines(text) == [" ".join(lines.line_words(x)) for x in text.split("\n")]


def test_keys_of_bags():
    """Keys depend on a line's words, not on their order or on the other lines, and repeated words are told apart."""
    rng = random.Random(11)
    for n in (20, 47, 130, 900):
        line = [f"w{rng.randrange(n // 2)}" for _ in range(n)]
        mixed = rng.sample(line, n)
        others = [[f"v{rng.randrange(50)}" for _ in range(rng.randrange(20, 90))] for _ in range(30)]
        for made in (lines.class_keys, lines.deletion_keys):
            alone = sorted(made([line])[1].tolist())
            owners, keys = made([*others, mixed, *others])
            assert sorted(keys[owners == 30].tolist()) == alone
            assert set(made([line + ["more"]])[1].tolist()) & set(alone) and set(made([line[:-1] * 2])[1].tolist()) != set(alone)


def test_repeated_rows_share_no_key(spark):
    """Whole rows that come twice: a near copy of two lines is found under keys where the others stand twice."""
    words = [f"w{k}" for k in range(60)]
    near = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    rows = [(1, near()), (1, near()), (2, near(5)), (2, near(5)), (3, near(50, 51)), (4, near(5, 50, 51))]
    got = {(r.id, r.near) for r in lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string"), grow=True).collect()}
    assert got == {(2, True), (3, True), (4, True)}
