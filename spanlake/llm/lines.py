"""Line dedup: of lines that are equal or a few word edits apart, the earliest stays.

A line is its words, lower-cased, between white space; an edit inserts, deletes or replaces one word. How many edits apart two
lines may be grows with the shorter one's length (``edits``). Both searches below join hashes of deletion variants, and both
are exact.

Short lines, one edit: two lines are at most one edit apart if they are equal, if one is the other without a word, or if both
are the same without their word at one and the same place. So every line emits the hashes of all its variants without one
word, joins equal ones, and the partner that is found is verified on the words themselves. The variants are emitted only by
lines that can have a partner: of two lines one edit apart, the first or the last half of the words is equal, and those
halves, as hashed keys, are compared first.

Longer lines, k edits: all variants without up to k words would be far too many. So a line is taken as the bag of its words,
each with its how manieth it is of that word; an edit takes one of these away at most and adds one at most, so k edits alter
2 k of them. Bags are dealt to classes by hash, and the lines emit

- first, for each of 2 k + 1 classes, the variant that has lost the words of all other classes (``class_keys``): one class at
  least is left alone by k edits. Only lines that share such a key go on.
- then, for each of k + 1 classes, that class as it is and all its variants without one word (``deletion_keys``): in one class
  at least, k edits alter one word at most.

Keys of both kinds are as many as the words, whatever the length; a key of fewer words than ``_least`` is emitted together with those of
another dealing. What shares a key is verified word by word.
"""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import discard, fresh, release, stored, texts

#: Words from which a line has near copies. An edit of a line of three words or fewer leaves too little in common; those are
#: compared as they are.
MIN_WORDS = 4
#: Words for each of which a line may have an edit more, and from which it may have two.
STEP = 20
#: Words, and lines under the same keys, that are looked at together; lines of a key that a task holds at once, about.
CHUNK, SOME, HELD = 200_000, 128, 2048

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1


def edits(words: int) -> int:
    """Word edits that two lines may be apart, the shorter one of which has ``words`` words (``MIN_WORDS`` at least)."""
    return words // STEP + 1


def line_words(line: str) -> list[str]:
    return line.lower().split()


#: White space, but for the two that stand between plain words and lines.
_ODD = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def plain_lines(text: str) -> list[str]:
    """The lines of ``text``, their ``line_words`` joined by one space each. Most texts need but be cut at their newlines for it: one
    that has no other white space than single spaces between words."""
    text = text.lower()
    own = text.split("\n")
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _ODD):
        return [" ".join(x.split()) for x in own]
    return own


_powers: dict = {}


def _power(base: int, n: int):
    """base^0 .. base^(n - 1), kept by the worker."""
    import numpy as np

    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def word_hashes(lines: list[list[str]]):
    """64-bit hashes of the words of all ``lines``, one after another: polynomials over their bytes."""
    return text_hashes(map(" ".join, lines))


def text_hashes(texts):
    import numpy as np

    data = np.frombuffer(" ".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_BACK, len(data))[starts]
    return _mixed(_mixed(own) + (ends - starts).astype(np.uint64))


def _mixed(keys):
    import numpy as np

    keys = keys ^ (keys >> np.uint64(31))
    keys = keys * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(29))


def halves(words: list[str]) -> list[int]:
    """Even keys of the first and the last half, for the line's own length and for that of a line of one word fewer."""
    import xxhash

    out = []
    for size in {len(words) // 2, (len(words) - 1) // 2}:
        for side, part in enumerate((words[:size], words[len(words) - size :])):
            out.append(xxhash.xxh64_intdigest(f"{side} {size} {' '.join(part)}".encode("utf-8", "surrogatepass")) & ~1)
    return out


def variants(own):
    """Keys (int64) of the line of words with hashes ``own``, without each of its words in turn, then of the line as it is."""
    import numpy as np

    n = len(own)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(own * _power(_BASE, n), out=sums[1:])
    keys = np.concatenate([sums[:n] + (sums[n] - sums[1:]) * np.uint64(_BACK), sums[n:]])
    keys += np.array([n - 1] * n + [n], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _mixed(keys).view(np.int64)


def _bound(k: int) -> int:
    """k, or the next number over it that has three binary digits and then zeros: lines within a quarter share their dealings."""
    step = 1 << max(k.bit_length() - 3, 0)
    return -(-k // step) * step


@functools.lru_cache(100_000)
def _families(n: int) -> list[int]:
    """Bounds, rounded up, that a line of n words has with lines of its own length or more, and with shorter ones."""
    m = max(STEP, (n - 1) * STEP // (STEP + 1) - 1)
    while n - m > edits(m):
        m += 1
    return sorted({_bound(k) for k in range(edits(m), edits(n) + 1)})


def _least(k: int) -> int:
    """Words that a key of bound k has at least, where another dealing can give them. Classes of longer lines are rarely
    smaller, and the longest lines have so many that an empty one tells enough by its number."""
    return 3 if k < 16 else 1 if k < 1024 else 0


#: Dealings that are taken together for a key of few words.
DEALINGS = 4


def _bags(place, h):
    """The words of lines, those of a line together, each with its how manieth it is of that word in its line: (lines, hashes).
    40 bits tell words apart here, so that line and word are sorted as one number."""
    import numpy as np

    if len(place) and int(place[-1]) >> 24:
        raise ValueError("too many lines at once")
    both = np.sort((place.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    ranks = np.arange(len(both)) - np.repeat(starts, np.diff(np.r_[starts, len(both)]))
    return (both >> np.uint64(40)).astype(np.int64), _mixed(_mixed(both << np.uint64(24)) + ranks.astype(np.uint64) * np.uint64(_BASE))


def _spans(starts, counts):
    """All places from each of ``starts`` on, as many as ``counts`` says."""
    import numpy as np

    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _dealt(h, lengths, touched: int, drop: bool):
    """(lines, odd keys) of lines of ``lengths`` words with hashes ``h``, one after another, from classes so many that ``edits`` leave
    one with fewer than ``touched`` altered words; with ``drop``, of each class the variants without one word too. Classes carry sums of
    their words' hashes, so nothing needs sorting but the words of each line."""
    import numpy as np

    families: dict[int, list[int]] = {}
    for n in np.unique(lengths).tolist():
        for k in _families(n):
            families.setdefault(k, []).append(n)
    _, h = _bags(np.repeat(np.arange(len(lengths)), lengths), h)
    starts = np.cumsum(lengths) - lengths
    owners, keys = [], []
    for k, sizes_ in families.items():
        p, least = 2 * k // touched + 1, _least(k)
        members = np.flatnonzero(np.isin(lengths, sizes_))
        line = np.arange(len(members))  # of which keys are still open: the line, what the dealings before gave, and of how many words
        sums, sizes = np.full(len(line), ((k << 32) * _BASE + touched) & _ALL, np.uint64), np.zeros(len(line), np.int64)
        for dealing in range(DEALINGS):
            if dealing:
                asked, line = np.unique(line, return_inverse=True)
                members = members[asked]
            n = lengths[members]
            own = _mixed((h if len(members) == len(lengths) else h[_spans(starts[members], n)]) + np.uint64((dealing + 1) * _BACK & _ALL))
            place = np.repeat(np.arange(len(members)), n)
            group = place * p + (((own >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)).astype(np.int64)
            size = np.bincount(group, minlength=len(members) * p)
            key, of_line = np.zeros(len(size), np.uint64), np.full(len(members), p)
            np.add.at(key, group, own)
            salt = np.tile(np.arange(p, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), len(members))
            if drop:  # the classes of a line, then its variants
                total, count, of_line = key, size, n + p
                whole = _spans(np.cumsum(of_line) - of_line, np.full(len(members), p))
                part = np.arange(len(own)) + (place + 1) * p
                key, size = np.empty(len(total) + len(own), np.uint64), np.empty(len(total) + len(own), np.int64)
                key[whole], key[part] = total + salt, total[group] - own + salt[group]
                size[whole], size[part] = count, count[group] - 1
            else:
                key += salt
            key = _mixed(key + size.astype(np.uint64))
            before = of_line[line]
            each = _spans((np.cumsum(of_line) - of_line)[line], before)
            line = np.repeat(line, before)
            sums, sizes = _mixed(np.repeat(sums, before) * np.uint64(_BASE) + key[each]), np.repeat(sizes, before) + size[each]
            done = (sizes >= least) | (dealing == DEALINGS - 1)
            owners.append(members[line[done]])
            keys.append(sums[done])
            line, sums, sizes = line[~done], sums[~done], sizes[~done]
            if not len(line):
                break
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), (np.concatenate(keys) | np.uint64(1)).view(np.int64)


def _hashed(lines: list[list[str]]):
    import numpy as np

    return word_hashes(lines), np.array([len(w) for w in lines], np.int64)


def class_keys(lines: list[list[str]]):
    """(places in ``lines``, odd keys) of lines of ``STEP`` words or more; one key at least is shared by any two of them that
    are at most ``edits`` apart."""
    return _dealt(*_hashed(lines), 1, False)


def deletion_keys(lines: list[list[str]]):
    """The same, of fewer and larger classes, with all their variants without one word."""
    return _dealt(*_hashed(lines), 2, True)


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether a and b are at most ``most`` word edits apart: the furthest place on each diagonal, edit by edit."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    last: dict[int, int] = {}
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):
            i = min(max(last.get(d, -2) + 1, last.get(d - 1, -2), last.get(d + 1, -2) + 1), n, m - d) if e else 0
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            if i == n and i + d == m:
                return True
            now[d] = i
        last = now
    return False


def near(a: list[str], b: list[str]) -> bool:
    """Whether a and b, of ``MIN_WORDS`` words at least, are at most ``edits`` apart. An edit takes one word at most from each
    side, so lines with more words that the other one lacks needn't be compared place by place."""
    most, least = edits(min(len(a), len(b))), min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), least)  # equal ends take no edit
    j = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), least)
    j = min(j, least - i)
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= most:
        return True
    words, others = Counter(a), Counter(b)
    return max((words - others).total(), (others - words).total()) <= most and within(a, b, most)


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether a and b are at most one word edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


class Earlier:
    """The lines under one key, or in one block of it, as they come; ``has_near`` asks whether one that came before is near. Counts of words by hash
    rule out most of them: an edit raises and lowers one of those counts by one at most."""

    BUCKETS = 128

    def __init__(self):
        import numpy as np

        self.texts, self.size = [], 0
        self.counts, self.lengths = np.zeros((16, self.BUCKETS), np.int16), np.zeros(16, np.int32)

    def has_near(self, words: list[str], counts) -> bool:
        import numpy as np

        lengths = self.lengths[: self.size]
        most = np.minimum(lengths, len(words)) // STEP + 1
        left = 2 * most - np.abs(lengths - len(words))
        at = np.flatnonzero(left >= most)
        at = at[np.abs(self.counts[at] - counts).sum(1) <= left[at]]
        return any(near(words, self.texts[i].split(" ")) for i in at)

    def add(self, text: str, length: int, counts) -> None:
        import numpy as np

        if self.size == len(self.lengths):
            self.counts, self.lengths = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.counts[self.size], self.lengths[self.size] = counts, length
        self.texts.append(text)
        self.size += 1


def word_counts(lines: list[list[str]]):
    """A row of counts of words, by their hash, for each of ``lines``."""
    import numpy as np

    place = np.repeat(np.arange(len(lines)) * Earlier.BUCKETS, [len(w) for w in lines])
    found = place + (word_hashes(lines) & np.uint64(Earlier.BUCKETS - 1)).astype(np.int64)
    return np.bincount(found, minlength=len(lines) * Earlier.BUCKETS).reshape(len(lines), Earlier.BUCKETS).astype(np.int16)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, grow: bool = False) -> DataFrame:
    """(id, line, near): the lines, counted from 0 in a document, that go. ``near``: no equal line is earlier, but one that is
    one edit apart, or with ``grow`` up to ``edits``. Earlier is the smaller id, then the smaller line; a row's repetition
    counts as the same document.

    A line without words always stays. A line of fewer than ``min_words`` words goes only for an equal one. A line goes
    whether or not the earlier one goes for a still earlier one. Rows without an id keep their lines, and no line goes for
    theirs. Null and empty texts have no lines; an empty table gives an empty result.

    What is shuffled of every line is a hash, and of every different line its keys. Words are fetched only of lines that share
    a key. A line that stands in very many documents meets itself in one join, whose skewed partitions Spark splits.
    """
    rows = texts(docs, id_col, text_col).where(F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()

    def split(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, n_words = batch.column("id"), 0
            doc, line, marks, pending, sizes = [], [], [], [], []

            def ready():
                counts = np.array(sizes, np.int64)
                long = np.flatnonzero((counts >= max(min_words, STEP)) & grow)
                owners, keys = _dealt(text_hashes([pending[i] for i in long.tolist()]), counts[long], 1, False)
                owners = long[owners]
                short, half = [], []
                for i in np.flatnonzero((counts >= min_words) & ((counts <= STEP) | (not grow))).tolist():
                    found = halves(pending[i].split(" "))
                    short += [i] * len(found)
                    half += found
                owners, keys = np.concatenate([owners, np.array(short, np.int64)]), np.concatenate([keys, np.array(half, np.uint64).view(np.int64)])
                order = np.argsort(owners, kind="stable")
                ends = np.searchsorted(owners[order], np.arange(len(pending) + 1))
                arrays = [ids.take(pa.array(doc, pa.int64())), pa.array(line, pa.int32()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order], pa.int64()))]
                return pa.RecordBatch.from_arrays(arrays, names=["id", "line", "mark", "keys"])

            for d, text in enumerate(batch.column("text")):
                for k, own in enumerate(plain_lines(text.as_py())):
                    if own:
                        doc.append(d)
                        line.append(k)
                        marks.append(xxhash.xxh3_128_digest(own.encode("utf-8", "surrogatepass")))
                        pending.append(own)
                        sizes.append(own.count(" ") + 1)
                        n_words += sizes[-1]
                        if n_words >= CHUNK:
                            yield ready()
                            n_words = 0
                            for x in (doc, line, marks, pending, sizes):
                                x.clear()
            if pending:
                yield ready()

    lines = stored(rows.mapInArrow(split, f"id {kind}, line int, mark binary, keys array<long>"), "lines")
    places = lines.select("id", "line", "mark")
    own = F.struct("id", "line")
    # Marks are counted first: few are there twice, so that few places need their least one, and none but those are sorted.
    often = places.groupBy("mark").count().where("count > 1").select("mark")
    equal = stored(places.join(often.hint("shuffle_hash"), "mark"), "equal")
    unique = equal.groupBy("mark").agg(F.min(own).alias("first"))
    again = stored(equal.join(unique, "mark").where("first.id != id or first.line != line").select("id", "line", F.lit(False).alias("near")).distinct(), "again")
    discard(equal)  # and the shuffled marks

    # ``again`` has no frequent key, whatever lines are frequent; a task holds its share of it. Rows repeated as wholes come twice.
    firsts = lines.where("size(keys) > 0").select("id", "line", "keys").join(again.select("id", "line").hint("shuffle_hash"), ["id", "line"], "left_anti")
    keys = firsts.select(F.explode("keys").alias("key"), "id", "line")
    all_ = Window.partitionBy("key")
    several = keys.withColumn("n", F.count("*").over(all_)).where("n > 1").drop("n").distinct()  # few are, so ids are compared after it
    shared = stored(several.withColumns({"least": F.min(own).over(all_), "most": F.max(own).over(all_)}).where("least != most").drop("most"), "shared")
    discard(lines)

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            doc, line, words = [], [], []
            for d, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted").to_pylist())):
                own = text.as_py().split("\n")
                for k in wanted:
                    if k < len(own):
                        doc.append(d)
                        line.append(k)
                        words.append(" ".join(line_words(own[k])))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc, pa.int64())), pa.array(line, pa.int32()), pa.array(words, pa.string())], names=["id", "line", "words"])

    wanted = shared.select("id", "line").distinct().groupBy("id").agg(F.collect_list("line").alias("wanted"))
    picked = stored(rows.join(wanted.hint("shuffle_hash"), "id").mapInArrow(pick, f"id {kind}, line int, words string").dropDuplicates(["id", "line"]), "picked")
    release(docs.sparkSession)  # the shuffled documents

    def emit(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            lines = [w.split(" ") for w in batch["words"]]
            if not lines:
                continue
            ends, hashes = np.cumsum([0, *map(len, lines)]), word_hashes(lines)
            keys = [variants(hashes[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            sizes = np.array([len(k) for k in keys], np.int64)
            place = np.concatenate([np.r_[np.arange(n - 1), -1] for n in sizes])
            yield pd.DataFrame({"key": np.concatenate(keys), "place": place.astype(np.int32), "id": np.repeat(batch["id"].to_numpy(), sizes), "line": np.repeat(batch["line"].to_numpy(), sizes)})

    short = shared.where("key % 2 = 0").select("id", "line").distinct().join(picked, ["id", "line"])
    emitted = short.select("id", "line", "words").mapInPandas(emit, f"key long, place int, id {kind}, line int").select("key", "place", F.struct("id", "line").alias("own"))
    least = emitted.groupBy("key", "place").agg(F.min("own").alias("least"), F.max("own").alias("most"))
    # Of the variants under a key: the same place joins to the earliest line there, a whole line to the earliest one with a
    # word more, those with a word more to the whole line.
    by_key = least.groupBy("key").agg(F.count("*").alias("places"), F.min(F.when(F.col("place") == -1, F.col("least"))).alias("whole"), F.min(F.when(F.col("place") != -1, F.col("least"))).alias("longer"))
    by_key = by_key.where("places > 1").select("key", "whole", "longer")
    same = emitted.join(least.where("least != most"), ["key", "place"]).select("own", F.col("least").alias("other"))
    other = emitted.join(by_key, "key").select("own", F.when(F.col("place") == -1, F.col("longer")).otherwise(F.col("whole")).alias("other"))
    # Of longer lines that share a key, first each with the earliest one.
    first = shared.where("key % 2 <> 0").select(own.alias("own"), F.col("least").alias("other"))
    found = same.unionByName(other).unionByName(first).where("other < own").distinct()
    found = found.select(F.col("own.id").alias("id"), F.col("own.line").alias("line"), F.col("other.id").alias("other_id"), F.col("other.line").alias("other_line"))

    def verify(batches):
        import numpy as np

        for batch in batches:
            good = []
            for at in range(0, len(batch), SOME):
                a, b = ([x.split(" ") for x in batch[c].iloc[at : at + SOME]] for c in ("words", "other_words"))
                apart = np.abs(word_counts(a) - word_counts(b)).sum(1)
                good += [n <= 2 * edits(min(len(x), len(y))) and (near if grow else one_edit)(x, y) for x, y, n in zip(a, b, apart)]
            yield batch.loc[good, ["id", "line"]]

    sides = found.join(picked, ["id", "line"]).join(picked.select(F.col("id").alias("other_id"), F.col("line").alias("other_line"), F.col("words").alias("other_words")), ["other_id", "other_line"])
    close = sides.select("id", "line", "words", "other_words").mapInPandas(verify, f"id {kind}, line int").distinct()
    settled = []
    if grow:
        close = stored(close, "settled")
        settled.append(close)
        release(docs.sparkSession)  # the shuffled variants of short lines, and the pairs with their words

        def emit_long(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                lines = [x.split(" ") for x in batch.column("words").to_pylist()]
                sizes, at = np.cumsum([0, *map(len, lines)]), 0
                while at < len(lines):
                    end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK // 4)) - 1)
                    owners, keys = deletion_keys(lines[at:end])
                    order = np.lexsort((keys, owners))
                    order = order[np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(owners[order]) != 0)]] if len(order) else order
                    owners, keys = owners[order], keys[order]
                    for i in range(0, len(keys), CHUNK):
                        own = batch.take(pa.array(owners[i : i + CHUNK] + at))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + CHUNK]), own.column("id"), own.column("line"), own.column("open")], names=["key", "id", "line", "open"])
                    at = end

        def later(batches):
            import pyarrow as pa

            now, group = None, None
            for batch in batches:  # sorted by key and block, then in the order of lines
                good = []
                for at in range(0, batch.num_rows, SOME):
                    part = batch.slice(at, SOME)
                    texts_ = part.column("words").to_pylist()
                    lines = [x.split(" ") for x in texts_]
                    counts = word_counts(lines)
                    for i, (k, b, open_, held) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "block", "open", "held")))):
                        if (k, b) != now:
                            now, group = (k, b), Earlier()
                        if open_ and group.has_near(lines[i], counts[i]):
                            good.append(at + i)
                        if held:
                            group.add(texts_[i], len(lines[i]), counts[i])
                yield batch.select(["id", "line"]).take(pa.array(good, pa.int64()))

        def asked(rows):
            """Keys with open lines and the number of their lines; of keys with the same lines one is enough, and near copies share many."""
            members = [F.bit_xor(F.xxhash64(*c)).alias(n) for n, c in (("one", ("id", "line")), ("two", ("line", "id")))]
            out = rows.groupBy("key").agg(F.max("open").alias("any"), F.count("*").alias("n"), *members).where("any and n > 1")
            return out.groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key", "n")

        # Then those that aren't settled by it, with the lines before them that share a variant, up to the first that is near.
        rest = shared.where("key % 2 <> 0").join(close.withColumn("gone", F.lit(True)), ["id", "line"], "left").withColumn("open", F.col("gone").isNull() & (own != F.col("least")))
        some = rest.join(asked(rest).where("n > 2"), "key").groupBy("id", "line").agg(F.max("open").alias("open"))
        long_ = stored(some.join(picked, ["id", "line"]).select("id", "line", "open", "words").mapInArrow(emit_long, f"key long, id {kind}, line int, open boolean"), "variants")
        settled.append(long_)
        release(docs.sparkSession)  # the keys of longer lines
        # Lines of a large key are held in blocks, and its open ones come to each block.
        blocks = F.ceil(F.col("n") / HELD).cast("int")
        rest = long_.join(asked(long_), "key").withColumn("own_block", F.pmod(F.xxhash64("id", "line"), blocks).cast("int"))
        rest = rest.withColumn("block", F.explode(F.when(F.col("open"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own_block"))))
        rest = rest.join(picked, ["id", "line"]).select("key", "block", "id", "line", "open", (F.col("block") == F.col("own_block")).alias("held"), "words")
        more = rest.repartition("key", "block").sortWithinPartitions("key", "block", "id", "line").mapInArrow(later, f"id {kind}, line int")
        close = close.unionByName(more).distinct()
    out = stored(again.unionByName(close.withColumn("near", F.lit(True))), "dropped")
    discard(again, shared, picked, *settled)
    return out


def _numbered(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with a number ``name`` for each different pair of id and text, in the order of ids; null where the id is."""
    keyed = docs.select("*", F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias(fresh(docs, "mark")))
    mark = keyed.columns[-1]
    pairs = keyed.where(F.col(id_col).isNotNull()).select(id_col, mark).distinct().orderBy(id_col, mark)
    return keyed.join(stored(pairs.withColumn(name, F.monotonically_increasing_id()), "numbers"), [id_col, mark], "left").select(*docs.columns, name)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, grow: bool = False) -> DataFrame:
    """``docs`` and columns _lines, _exact, _near (lines with words; those that went for an equal one, for a near one); the
    text is what is left of it, lines in order. A text that loses no line, null included, stays as it is.

    Columns of ``docs`` with those three names are replaced; all others stay, whatever their names. Rows that share an id keep
    their own lines: where ids occur twice, each pair of id and text is a document of its own, in the order of ids.
    Only rows that share both can't be told apart; they lose the same lines. Rows without an id lose none.
    """
    if not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        number = fresh(docs, "number")
        out = _dedup(_numbered(docs, id_col, text_col, number), number, text_col, min_words, grow)
        return out.select(*(c for c in docs.columns if c not in ("_lines", "_exact", "_near")), "_lines", "_exact", "_near")
    return _dedup(docs, id_col, text_col, min_words, grow)


def _dedup(docs: DataFrame, id_col: str, text_col: str, min_words: int, grow: bool) -> DataFrame:
    gone, near_ = fresh(docs, "gone"), fresh(docs, "near")
    lost = dropped_lines(docs, id_col, text_col, min_words, grow)
    by_doc = lost.groupBy(F.col("id").alias(id_col)).agg(F.sort_array(F.collect_list("line")).alias(gone), F.count_if("near").cast("int").alias(near_))

    @F.pandas_udf("string")
    def rest(text, gone):
        import pandas as pd

        return pd.Series([t if g is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in s) for t, g in zip(text, gone) for s in [set(g) if g is not None else ()]])

    joined = docs.join(by_doc.hint("shuffle_hash"), id_col, "left")  # a short list for each document, next to whole texts
    text, n_near = F.col(text_col), F.coalesce(near_, F.lit(0))
    count = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"(?U)\S[^\n]*"))).cast("int")
    left = F.when(F.col(gone).isNull(), text).otherwise(rest(F.when(F.col(gone).isNotNull(), text), F.col(gone)))
    kept = [left.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("_lines", "_exact", "_near")]
    return joined.select(*kept, count.alias("_lines"), (F.coalesce(F.size(gone), F.lit(0)) - n_near).alias("_exact"), n_near.alias("_near"))
