"""Phrases that stand together more often than their parts do: count streams in prefix and in suffix order, merged in step."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import stored

#: Characters that end a piece (and no word contains).
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Words of the longest phrase.
LONGEST = 4
#: Bits of the table that rules out phrases with a rare pair of words: 2 MB, whatever the input.
BITS = 24
#: Bytes of text that a task cuts into words and counts at a time.
SEGMENT = 4 << 20

_ONE_END = bytes.maketrans(ENDS, b"." * len(ENDS))
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
#: The words of a phrase, blanks between them, then a tab and the language.
_COUNTS = "key string, f long"


def _segments(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a text, cut at blanks or ends, and whether a part goes on from the one before it."""
    at = 0
    while at < len(text):
        to = at + SEGMENT
        if to < len(text):
            cut = max(text.rfind(b" ", at, to), text.rfind(b".", at, to), text.rfind(b"\t", at, to))
            while cut < at and to < len(text):  # a word longer than a segment
                to += SEGMENT
                cut = max(text.rfind(b" ", at, to), text.rfind(b".", at, to), text.rfind(b"\t", at, to))
            to = cut + 1 if cut >= at else len(text)
        yield text[at:to], at > 0
        at = to


class Block:
    """Some texts, or a part of a long one: words by number, 0 between pieces; for each place the language, and whether it was in the block before."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[b"."]
        self.tongue: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.parts: list[tuple[np.ndarray, int, int]] = []
        self.size = 0

    def add(self, lang: bytes, before: list[bytes], tokens: list[bytes], size: int) -> None:
        whole = before + tokens
        ids = np.fromiter(map(self.number.__getitem__, whole), np.int64, len(whole))
        self.parts.append((np.append(ids, 0), self.tongue[lang], len(before)))
        self.size += size

    def close(self) -> Block:
        self.ids = np.concatenate([p[0] for p in self.parts])
        self.langs = np.repeat([p[1] for p in self.parts], [len(p[0]) for p in self.parts])
        self.seen = np.concatenate([np.arange(len(p[0])) < p[2] for p in self.parts])
        self.words, self.tongues = list(self.number), list(self.tongue)
        return self

    def starts(self, n: int) -> np.ndarray:
        """Starts of the phrases of n words within a piece that were not all in the block before."""
        if len(self.ids) < n:
            return np.zeros(0, np.int64)
        inside = ~self.seen[n - 1 :]
        for k in range(n):
            inside &= self.ids[k : len(self.ids) - n + 1 + k] != 0
        return np.flatnonzero(inside)

    def counted(self, at: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        """The phrases of n words that start at the places, each once, with the times that it does."""
        if not len(at):
            return
        many, tables, code = len(self.words), [], self.langs[at]
        for k in range(n):
            if k == 2 or k == 3:  # two words and a language fit into a number; before more, they become one number below the count of places
                table, code = np.unique(code, return_inverse=True)
                tables.append(table)
            code = code * many + self.ids[at + k]
        code, counts = np.unique(code, return_counts=True)
        columns = []
        for k in range(n - 1, -1, -1):
            code, word = np.divmod(code, many)
            columns.append(word)
            if k == 2 or k == 3:
                code = tables.pop()[code]
        names = pa.array(self.words, pa.binary())
        key = pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in reversed(columns)), b" ")
        key = pc.binary_join_element_wise(key, pa.array(self.tongues, pa.binary()).take(pa.array(code)), b"\t")
        yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(counts, pa.int64())], names=["key", "f"])


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """(lang, text as bytes) in blocks of bounded size, whatever the length of a text."""
    block = Block()
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            lang, before = langs[k].as_py().encode(), []
            for part, goes_on in _segments((texts[k].as_py() or b"").lower().translate(_ONE_END)):
                tokens = part.replace(b".", b" . ").split()
                block.add(lang, before if goes_on else [], tokens, len(part))
                before = (before + tokens)[-(LONGEST - 1) :] if goes_on else tokens[-(LONGEST - 1) :]
                if block.size >= SEGMENT:
                    yield block.close()
                    block = Block()
    if block.parts:
        yield block.close()


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs of words with the times that they stand in a block."""
    for block in blocks(batches):
        for n in (1, 2):
            yield from block.counted(block.starts(n), n)


def slots(first: np.ndarray, second: np.ndarray, lang: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs of words in the table, from 64-bit hashes of the words and the language; see ``_slot``."""
    turned = [(h << np.uint64(k)) | (h >> np.uint64(64 - k)) for k, h in ((1, second), (2, lang))]
    return ((first ^ turned[0] ^ turned[1]) >> np.uint64(64 - bits)).astype(np.int64)


def _slot(bits: int) -> Column:
    """``slots`` as a Spark column."""
    turn = lambda c, k: F.shiftleft(c, k).bitwiseOR(F.shiftrightunsigned(c, 64 - k))
    mixed = F.xxhash64("w1").bitwiseXOR(turn(F.xxhash64("w2"), 1)).bitwiseXOR(turn(F.xxhash64("lang"), 2))
    return F.shiftrightunsigned(mixed, 64 - bits)


def _frequent(pairs: DataFrame, bits: int) -> np.ndarray:
    """A table of bits, as long as 2 ** bits, in which all of ``pairs`` are set. It only rules phrases out before they are counted."""
    slot = _slot(bits)
    sets = pairs.select(F.shiftright(slot, 6).alias("row"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("k"))
    rows = sets.groupBy("row").agg(F.expr("bit_or(shiftleft(one, k))").alias("set"))
    table = np.zeros(1 << bits - 6, np.int64)
    for r in rows.toLocalIterator():
        table[r["row"]] = r["set"]
    return table


def _long(table, bits: int):
    """Phrases of three words and more, all of whose pairs may be frequent, with the times that they stand in a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value.view(np.uint64)
        for block in blocks(batches):
            word, tongue = (np.array([xxhash.xxh64_intdigest(w, 42) for w in some], np.uint64) for some in (block.words, block.tongues))
            slot = slots(word[block.ids[:-1]], word[block.ids[1:]], tongue[block.langs[:-1]], bits)
            ok = (frequent[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            for n in range(3, LONGEST + 1):
                at = block.starts(n)
                for k in range(n - 1):
                    at = at[ok[at + k]]
                yield from block.counted(at, n)

    return count


def count_streams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 30, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words; and (lang, w1 .. w4, f): the words and phrases that stand at least ``least`` times, each once.

    A phrase can't be more frequent than the pairs of words in it, so phrases of three and four words are counted only where all their pairs are frequent.
    """
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), docs[text_col].cast("binary").alias("text"))
    often = F.col("f") >= least
    short = rows.mapInArrow(_short, _COUNTS).groupBy("key").agg(F.sum("f").alias("f")).where(often | (F.instr("key", " ") == 0) | (F.instr("key", " ") > F.instr("key", "\t")))
    short = stored(_words(short), "short-counts")
    totals = short.where("w2 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    short = short.where(often)
    table = docs.sparkSession.sparkContext.broadcast(_frequent(short.where("w2 is not null"), bits))
    long = rows.mapInArrow(_long(table, bits), _COUNTS).groupBy("key").agg(F.sum("f").alias("f")).where(often)
    return totals, stored(short.unionByName(_words(long)), "counts")


def _words(counts: DataFrame) -> DataFrame:
    """(lang, w1 .. w4, f) of counted keys; no word contains a blank or a tab."""
    rows = counts.withColumn("phrase", F.substring_index("key", "\t", 1))
    words = F.split("phrase", " ")
    return rows.select(F.expr("substr(key, length(phrase) + 2)").alias("lang"), *(F.get(words, F.lit(k)).alias(w) for k, w in enumerate(WORDS)), "f")


def _side(stream: DataFrame, words: list[str], name: str) -> DataFrame:
    """``stream`` with the counts of each phrase's first one, two and three words in the order of ``words`` (name1 .. name3), and the
    highest count of a phrase that has one word more after it (name_more).

    The phrases are dealt by their first two words and sorted word by word, a shorter one before those that it begins, and are read
    once in that order: what a phrase begins with has just been read, what extends it follows. The counts of single words are merged in from a
    stream in the same order.
    """
    single = stream.where("w2 is null").select("lang", F.col("w1").alias(words[0]), F.col("f").alias(f"{name}1"))
    out = stream.where("w2 is not null").join(single.hint("merge"), ["lang", words[0]])
    for k in (2, 3):
        group = Window.partitionBy("lang", *words[:k]).orderBy(*(F.asc_nulls_first(w) for w in words[k:]))
        whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumn(f"{name}{k}", F.first("f").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = out.withColumn(f"_more{k}", F.max(F.when(F.col("n") == k + 1, F.col("f"))).over(whole))
    return out.withColumn(f"{name}_more", F.when(F.col("n") == 2, F.col("_more2")).when(F.col("n") == 3, F.col("_more3"))).drop("_more2", "_more3")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 30, top: int = 2000, share: int = 80, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): by language, the ``top`` phrases of two to four words that hang together most.

    Texts are lower-cased (A-Z only) and cut into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs. a is how
    often a phrase stands in pieces, at least ``least``; a cut after its first words gives l and r, the counts of both parts, and the score floor(2 000 000 a / (l + r)).
    Of all cuts that with the lowest score counts, of equal ones the first. A phrase goes if a longer one that contains it has at least ``share`` % of
    its count; since no phrase is more frequent than a part of it, it is enough to look at those with one word more, before or after. n is the number of words in
    the language, ``und`` if it is null. Ties of the score go to the higher a, then to the smaller phrase in bytes. A null
    text is an empty one; languages without words have no rows; an empty table gives an empty result.

    Counts are exact. Long texts are read in bounded segments, and counts are added up in each task before they are shuffled.
    """
    totals, counts = count_streams(docs, text_col, lang_col, least=least, bits=bits)
    n = F.size(F.array_compact(F.array(*WORDS)))
    turned = [F.when(F.col("n") >= k, F.element_at(F.array(*WORDS), F.greatest(F.col("n") - k + 1, F.lit(1)))).alias(f"v{k}") for k in range(1, LONGEST + 1)]
    stream = counts.withColumn("n", n).select("*", *turned)
    first = _side(stream, WORDS, "l")
    last = _side(stream, [f"v{k}" for k in range(1, LONGEST + 1)], "r").select("lang", *WORDS, "r1", "r2", "r3", "r_more")
    same = [first[c].eqNullSafe(last[c]) for c in WORDS[2:]]
    both = first.join(last.hint("merge"), [first[c] == last[c] for c in ("lang", *WORDS[:2])] + same).select(*(first[c] for c in first.columns), "r1", "r2", "r3", "r_more")
    cuts = []
    for k in range(1, LONGEST):
        rest = F.expr(f"case n - {k} when 1 then r1 when 2 then r2 when 3 then r3 end")
        score = F.expr(f"cast(2000000 * cast(f as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + case n - {k} when 1 then r1 when 2 then r2 else r3 end) as bigint)")
        cuts.append(F.when(F.col("n") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), rest.alias("r"))))
    more = F.coalesce(F.greatest("l_more", "r_more"), F.lit(0)).cast("decimal(20,0)")
    kept = both.where(more * 100 < F.col("f").cast("decimal(20,0)") * share).withColumn("cut", F.array_min(F.array(*cuts)))
    scored = kept.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
