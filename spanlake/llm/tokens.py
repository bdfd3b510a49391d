"""BPE encoding with tree concatenation, and decoding.

A long text is cut in halves again and again, anywhere, down to leaves; leaves are encoded on their own, and neighbours are
joined from the leaves up: a window around each join is encoded anew, and grows until its tokens agree exactly with those on
both sides; then the tokens inside the window replace those at the join. Leaves of one segment are encoded in one task; a text
of several segments is dealt to several tasks.

Where the tokenizer drops white space, no token crosses it, and a leaf is a list of units, the runs without white space. A
unit's tokens don't depend on its neighbours, so each distinct short unit is encoded by the tokenizers library once per worker
(the cache has a fixed bound). A join inside white space leaves both sides as they are; one inside a run takes the ids of the
run from the window in which the units before and after it have the ids that they had. Runs too long for that (``LONG``), and
all text of tokenizers that keep white space, hold their tokens' places, and their joins agree on tokens: an encoding in
which every two neighbours also stand together in the encoding of some part is that of the whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import id_kind, returned, sent, texts

#: Code points of a leaf, and of a segment: texts beyond a segment are encoded by several tasks.
LEAF, SEGMENT = 4096, 32768
#: Code points from which a run without white space is joined token by token.
LONG = 512
#: Units that a worker remembers in each of two generations.
CACHE = 300_000


def vocabulary() -> str:
    """The default tokenizer file, from the folder of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Run:
    """A run: its text, token ids, and, of a long one, each token's place (start, end)."""

    def __init__(self, text: str, ids: list[int], spans: list[tuple[int, int]] | None):
        self.text, self.ids, self.spans = text, ids, spans


#: How the default tokenizer normalises and splits, and marks that end most words. The former lets a unit of
#: letters with marks behind it be encoded as two words, without the normaliser.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?|"


class Memory(dict):
    """What is kept for a unit, made when it is first asked for. Two generations: of ``most`` units each at most."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, unit: str):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= 64:
            self[unit] = value
        return value


class Encoder:
    """Units of text to what ``keep(ids)`` makes of their ids; ``add`` joins what is kept of two neighbours."""

    def __init__(self, path: str, keep=None, add=None, leaf: int = LEAF, long: int = LONG, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.add, self.leaf, self.long = keep or tuple, add or (lambda a, b: a + b), leaf, long
        self.known = Memory(self._kept, cache)
        shape = json.loads(self.tokenizer.to_str())
        normal, split = shape["normalizer"] or {}, shape["pre_tokenizer"] or {}
        kinds = [x["type"] for x in normal.get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in split.get("pretokenizers", [])]
        self.words = None
        if kinds == NORMAL and patterns == [SPLIT, None] and not any(x["content"].isalpha() for x in shape["added_tokens"]):
            self.words = Tokenizer(self.tokenizer.model)  # for words in lower case and NFC
            self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Units are encoded alone only by tokenizers for which white space separates and leaves nothing behind.
        probe = ("a", "The", "x9", ".", "caf\u00e9", "it's")
        self.splits = not any(self.ids(x) for x in (" ", "\n", "\t\r ")) and all(self.ids(f"{x}{gap}{y}") == self.ids(x) + self.ids(y) for x in probe for y in probe for gap in (" ", " \n\t"))

    def _kept(self, unit: str):
        if len(unit) > self.long:
            return self.keep([i for u in self._tree(unit, 0, len(unit)) for i in (u.ids if isinstance(u, Run) else self.ids(u))])
        if self.words:
            word = unit.rstrip(MARKS)
            # Letters up to U+024F, each of which is itself in NFC, and the lower case of which is one letter.
            if word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word):
                lower = word.lower()
                if lower == unit:
                    return self.keep(self.words.encode(unit, add_special_tokens=False).ids)
                return self.known[lower] if word == unit else self.add(self.known[lower], self.known[unit[len(word) :]])
        return self.keep(self.ids(unit))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def run(self, text: str) -> Run:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return Run(text, found.ids, found.offsets)

    @staticmethod
    def blank(text: str) -> str:
        """The text with the commonest white space as blanks. Other kinds stay inside the units, and the tokenizer's own."""
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def all(self, text: str):
        """What is kept of each unit of ``text``, in order, without a tree over it: long runs alone have one."""
        if not self.splits:
            return [self.keep(u.ids) for u in self.tree(text)]
        return map(self.known.__getitem__, filter(None, self.blank(text).split(" ")))

    def tree(self, text: str) -> list:
        """The units of ``text``: a string (at most ``long`` code points), or a Run with its ids."""
        return self._tree(self.blank(text) if self.splits else text, 0, len(text))

    def _tree(self, text: str, low: int, high: int) -> list:
        if high - low <= self.leaf:
            if not self.splits:
                return [self.run(text[low:high])] if high > low else []
            units = text[low:high].split(" ")
            return [u if len(u) <= self.long else self.run(u) for u in units if u]
        middle = (low + high) // 2
        inside = not self.splits or (text[middle - 1] != " " and text[middle] != " ")
        return self.join(self._tree(text, low, middle), self._tree(text, middle, high), inside)

    def join(self, left: list, right: list, inside: bool) -> list:
        """Both lists as one. ``inside``: the cut is inside a run, whose parts end ``left`` and begin ``right``."""
        if not inside or not left or not right:
            left.extend(right)
            return left
        a, b = left.pop(), right[0]
        if all(isinstance(x, str) or x.spans is None for x in (a, b)) and len(_text(a)) + len(_text(b)) <= self.long:
            merged = self.agreed(left, _text(a) + _text(b), right)
        else:
            merged = self.merged(*(x if isinstance(x, Run) and x.spans is not None else self.run(_text(x)) for x in (a, b)))
        left.append(merged)
        left.extend(right[1:])
        return left

    def agreed(self, left: list, unit: str, right: list) -> Run:
        """``unit`` with its ids in a window around it, which is grown until its neighbours on both sides have their own ids."""
        width = 1
        while True:
            before, after = left[-width:], right[1 : 1 + width]
            window = self.ids(" ".join([*map(_text, before), unit, *map(_text, after)]))
            head, tail = (sum((list(x.ids) if isinstance(x, Run) else self.ids(x) for x in part), []) for part in (before, after))
            if len(head) + len(tail) <= len(window) and window[: len(head)] == head and window[len(window) - len(tail) :] == tail:
                return Run(unit, window[len(head) : len(window) - len(tail)], None)
            if width >= max(len(left), len(right)):
                return Run(unit, self.ids(unit), None)
            width *= 2

    def merged(self, a: Run, b: Run, same: int = 2) -> Run:
        """The run of a and b: tokens of a, of a window around the join, and of b, changing over where ``same`` tokens agree."""
        width, edge = 64, len(a.text)
        while True:
            low, high = max(0, edge - width), min(edge + len(b.text), edge + width)
            if low == 0 and high == edge + len(b.text):
                return self.run(a.text + b.text)
            window = self.run(a.text[low:] + b.text[: high - edge])
            spans = [(x + low, y + low) for x, y in window.spans]
            first = self._common(a.ids, a.spans, window.ids, spans, 0, edge, same) if low else (0, 0)
            last = self._common(b.ids, [(x + edge, y + edge) for x, y in b.spans], window.ids, spans, edge, high, same, last=True) if high < edge + len(b.text) else (len(b.ids), len(spans))
            if first and last and first[1] <= last[1]:
                (i, j), (m, n) = first, last
                return Run(a.text + b.text, a.ids[:i] + window.ids[j:n] + b.ids[m:], a.spans[:i] + spans[j:n] + [(x + edge, y + edge) for x, y in b.spans[m:]])
            width *= 2

    @staticmethod
    def _common(ids, spans, other_ids, other_spans, low: int, high: int, same: int, last: bool = False):
        """Places (in ids, in other_ids) of ``same`` tokens that both have between low and high, each with a span of its own."""
        at = {s: k for k, s in enumerate(spans) if low <= s[0] and s[1] <= high}
        order = range(len(other_spans) - same, -1, -1) if last else range(len(other_spans) - same + 1)
        for j in order:
            i = at.get(other_spans[j])
            if i is None or i + same > len(ids):
                continue
            alone = all(spans[i + k][1] <= spans[i + k + 1][0] for k in range(same - 1)) and (i == 0 or spans[i - 1][1] <= spans[i][0]) and (i + same == len(ids) or spans[i + same - 1][1] <= spans[i + same][0])
            if alone and all(other_spans[j + k] == spans[i + k] and other_ids[j + k] == ids[i + k] and spans[i + k][1] <= high for k in range(same)):
                return (i + same // 2, j + same // 2)
        return None


def _text(unit: str | Run) -> str:
    return unit if isinstance(unit, str) else unit.text


_encoders: dict[tuple, Encoder] = {}


def encoder(kind: str, path: str, keep=None, add=None, **sizes) -> Encoder:
    """The worker's encoder of this kind, kept between batches and tasks."""
    key = (kind, path, *sorted(sizes.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(path, keep, add, **sizes)
    return _encoders[key]


def id_bytes(ids) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def parts(enc: Encoder, units: list) -> list:
    """What is kept of each unit, in order."""
    known = enc.known
    return [known[u] if isinstance(u, str) else enc.keep(u.ids) for u in units]


def _summary(kept: list, enc: Encoder) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
    kept = [p for p in kept if p[0]]  # a unit of white space that isn't a blank has no ids
    ids = " ".join([p[1] for p in kept])
    if enc.tokenizer.decoder is None:  # then a decoded text is its tokens with a blank between each two
        decoded = " ".join([p[2] for p in kept])
    else:
        decoded = enc.decode([int(x) for x in ids.split()])
    return sum([p[0] for p in kept]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _digest_encoder(path: str, leaf: int, long: int) -> Encoder:
    """Keeps (number of ids, decimal ids, decoded text)."""
    enc = encoder("digest", path, None, lambda a, b: (a[0] + b[0], f"{a[1]} {b[1]}", f"{a[2]} {b[2]}"), leaf=leaf, long=long)
    enc.keep = lambda ids: (len(ids), " ".join(map(str, ids)), enc.decode(ids))
    return enc


def round_trips(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, segment: int = SEGMENT, long: int = LONG) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row: whole texts encoded without special tokens added, and decoded.

    The ids are hashed as decimal numbers with a blank between each two. A null or empty text, or one of white space, has no
    tokens, and hashes of the empty string. Rows that repeat an id and a text give equal rows; those of one id with different
    texts of over a segment are told apart by a hash of the text. An empty table gives an empty result.

    Texts of up to ``segment`` code points are encoded where they are read, without a shuffle. Longer ones are cut into
    segments, dealt to all tasks by (row, segment), and their encodings are joined in order; what is shuffled is their text.
    """
    path = path or vocabulary()
    rows = texts(docs, id_col, text_col)
    given, kind = id_kind(rows)
    rows = sent(rows)
    result = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batches):
        import pandas as pd

        enc = _digest_encoder(path, leaf, long)
        for batch in batches:
            out = [_summary(parts(enc, enc.tree(t)), enc) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": [x[0] for x in out], "ids_sha256": [x[1] for x in out], "decoded_sha256": [x[2] for x in out]})

    def cut(batches):
        import pandas as pd

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                mark, n = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), -(-len(text) // segment)
                for k in range(n):
                    yield pd.DataFrame({"id": [key], "mark": [mark], "k": [k], "part": [text[k * segment : (k + 1) * segment]]})

    def units(batches):
        import pandas as pd

        enc = _digest_encoder(path, leaf, long)
        for batch in batches:
            out = [_pack_units(enc.tree(t)) for t in batch["part"]]
            edges = [(t[:1] not in ("", *" \t\n\r"), t[-1:] not in ("", *" \t\n\r")) for t in batch["part"]]
            yield pd.DataFrame({"id": batch["id"], "mark": batch["mark"], "k": batch["k"], "units": out, "open": [x[0] for x in edges], "close": [x[1] for x in edges]})

    def joined(key, group):
        import pandas as pd

        enc = _digest_encoder(path, leaf, long)
        group = group.sort_values("k").drop_duplicates("k")
        spans = [(_unpack_units(u), o, c) for u, o, c in zip(group["units"], group["open"], group["close"])]
        while len(spans) > 1:  # the upper levels of the tree
            spans = [(enc.join(x[0], y[0], x[2] and y[1]), x[1], y[2]) for x, y in zip(spans[::2], spans[1::2])] + spans[len(spans) // 2 * 2 :]
        return pd.DataFrame([(key[0], *_summary(parts(enc, spans[0][0]), enc))], columns=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    size = F.char_length("text")
    near = rows.where(size <= segment).mapInPandas(whole, result)
    pieces = rows.where(size > segment).mapInPandas(cut, f"id {kind}, mark string, k long, part string")
    dealt = pieces.repartition("id", "mark", "k").mapInPandas(units, f"id {kind}, mark string, k long, units binary, open boolean, close boolean")
    far = dealt.groupBy("id", "mark").applyInPandas(joined, result)
    copies = rows.where(size > segment).groupBy("id", F.md5("text").alias("mark")).agg(F.count("*").alias("n")).where("n > 1")
    if not copies.isEmpty():  # rows that repeat an id and a text: as many results
        far = dealt.groupBy("id", "mark").applyInPandas(lambda key, g: joined(key, g).assign(mark=key[1]), result + ", mark string")
        far = far.join(copies, ["id", "mark"], "left").withColumn("x", F.explode(F.expr("sequence(1, coalesce(n, 1))"))).select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    return returned(near.unionByName(far), given)


def _pack_units(units: list) -> bytes:
    import pickle

    return pickle.dumps([u if isinstance(u, str) else (u.text, u.ids, u.spans) for u in units], 5)


def _unpack_units(data: bytes) -> list:
    import pickle

    return [u if isinstance(u, str) else Run(*u) for u in pickle.loads(data)]
