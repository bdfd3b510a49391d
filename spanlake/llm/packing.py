"""Packing token sequences: order-preserving dynamic programming over cuts at document and sentence ends.

The documents of a partition stand one after another. A window is what goes into one sequence. Of all ways to cut the row of
tokens into windows of at most ``size`` tokens, the one with the least padding plus truncation penalties is taken: a cut at a
document's end is free, one at a sentence's end and one inside a sentence have a price in tokens of padding. With b the
places of possible cuts, the best price up to b[j] is the least over i of price[i] + b[i], plus size - b[j] + penalty[j], for
b[j] - b[i] <= size: a sliding minimum, kept in a monotone queue.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from spanlake.llm.common import id_kind, returned, sent, texts
from spanlake.llm.tokens import encoder, id_bytes, vocabulary

SIZE = 4096
#: Prices, in tokens of padding, of a cut at a sentence's end and of one inside a sentence.
SENTENCE, INSIDE = 8, 48
#: Tokens after which a sentence without an end may be cut.
STEP = 48
#: Tokens of a block: memory of a task is bounded by it and by the longest document.
BLOCK = 1 << 19


def best_cuts(places, penalties, size: int, last=None) -> list[int]:
    """Indices into ``places`` (ascending from 0, steps of at most ``size``) of the cuts of least padding plus penalties.
    ``last(n)`` is the price of a last window of n tokens, by default its padding."""
    n = len(places)
    key, before = [0] * n, [0] * n
    queue, head = [0] * n, 0
    tail = 1
    key[0] = places[0]
    for j in range(1, n):
        place = places[j]
        low = place - size
        while places[queue[head]] < low:
            head += 1
        i = queue[head]
        before[j] = i
        k = key[i] + size + penalties[j]
        key[j] = k
        while tail > head and key[queue[tail - 1]] >= k:
            tail -= 1
        queue[tail] = j
        tail += 1
    end, last = places[-1], last or (lambda n: size - n)
    ends, i = [], n - 2
    while i >= 0 and end - places[i] <= size:
        ends.append(i)
        i -= 1
    cuts = [n - 1, min(ends, key=lambda i: (key[i] - places[i] + last(end - places[i]), i))]
    while cuts[-1]:
        cuts.append(before[cuts[-1]])
    return cuts[::-1]


def possible_cuts(ids, ends, closing, step: int):
    """(places, penalties) of a block: document ends, sentence ends (after ids in ``closing``), and every ``step`` tokens of
    what is longer without one."""
    import numpy as np

    at_end = np.zeros(len(ids) + 1, np.int8)
    at_end[1:][closing[ids]] = 1
    at_end[ends] = 2
    at_end[0] = at_end[-1] = 2
    places = np.flatnonzero(at_end)
    gaps = np.diff(places)
    extra = (gaps - 1) // step
    rank = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    places = np.sort(np.concatenate([places, np.repeat(places[:-1], extra) + rank * step]))
    penalties = np.array([INSIDE, SENTENCE, 0])[at_end[places]]
    return places.tolist(), penalties.tolist()


class Packer:
    """Packs documents as they come; ``add`` and ``close`` return the pieces of windows that are settled."""

    def __init__(self, closing, first: int, size: int = SIZE, block: int = BLOCK, step: int = STEP):
        self.closing, self.sequence, self.size, self.block, self.step = closing, first, size, block, step
        self.docs: list[tuple] = []  # (id, ids, tokens before them, tokens in all)
        self.tokens = 0

    def add(self, doc, ids) -> list[tuple]:
        self.docs.append((doc, ids, 0, len(ids)))
        self.tokens += len(ids)
        return self._settle(False) if self.tokens >= self.block else []

    def close(self) -> list[tuple]:
        return self._settle(True) if self.docs else []

    def _settle(self, last: bool) -> list[tuple]:
        import numpy as np

        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        places, penalties = possible_cuts(ids, ends, self.closing, self.step)
        # What isn't the end goes on in the next block, so its last window has no padding yet.
        cuts = [places[k] for k in best_cuts(places, penalties, self.size, self._tail_price if last else lambda n: 0)]
        if last:
            cuts = cuts[:-2] + self._tail(cuts[-2], cuts[-1])
        else:
            cuts = cuts[:-1]  # the last window goes on in the next block
        out, starts = [], ends - [len(d[1]) for d in self.docs]
        for low, high in zip(cuts, cuts[1:]):
            k = int(np.searchsorted(ends, low, "right"))
            place = low
            while place < high:
                doc, own, shift, total = self.docs[k]
                end = min(high, int(ends[k]))
                a, b = place - int(starts[k]), end - int(starts[k])
                out.append((doc, shift + a, b - a, zlib.crc32(own[a:b].tobytes()), total, self.sequence, place - low))
                place, k = end, k + 1
            self.sequence += 1
        done = cuts[-1]
        k = int(np.searchsorted(ends, done, "right"))
        rest = self.docs[k:]
        if rest:
            doc, own, shift, total = rest[0]
            a = done - int(starts[k])
            rest[0] = (doc, own[a:], shift + a, total)
        self.docs, self.tokens = rest, int(len(ids) - done)
        return out

    def _tail_price(self, n: int) -> int:
        return min(self.size - n, INSIDE * (n.bit_count() - 1))

    def _tail(self, low: int, high: int) -> list[int]:
        """Cuts of the very last window: powers of two, which need no padding, if that costs less than padding."""
        n = high - low
        if self.size - n <= INSIDE * (n.bit_count() - 1):
            return [low, high]
        cuts = [low]
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                cuts.append(cuts[-1] + (1 << k))
        return cuts


_tables: dict = {}


def sentence_ends(tokenizer, path: str):
    """By id: whether a token ends a sentence, that is, consists of ``.``, ``!`` and ``?`` (fixed values), at a word's end.
    The worker keeps the table of a tokenizer's ``path``."""
    import numpy as np

    if path not in _tables:
        known = tokenizer.get_vocab()
        table = np.zeros(max(known.values()) + 1, bool)
        for token, k in known.items():
            body = token.removesuffix("</w>")
            table[k] = bool(body) and body != token and not body.strip(".!?")
        _tables[path] = table
    return _tables[path]


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block: int = BLOCK, end_id: int = 2) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, packed into sequences.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone. Every id lies in exactly
    one piece; pieces of a sequence follow each other without gaps. A sequence is padded to ``size`` unless its length is a
    power of two. Documents of any length are cut over as many sequences as they need; repeated rows are packed each.

    Each partition packs its own documents in their order and shuffles nothing: sequence ids start at the partition's number
    times 2^32. Only the very last sequence of a partition can have much padding. The same partition gives the same rows
    again when a task is repeated.
    """
    path = path or vocabulary()
    rows = texts(docs, id_col, text_col)
    given, kind = id_kind(rows)
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(batches) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        enc = encoder("ids", path, id_bytes)
        packer = Packer(sentence_ends(enc.tokenizer, path), TaskContext.get().partitionId() << 32, size, block)
        end = id_bytes([end_id])
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"].tolist(), batch["text"]):
                out += packer.add(doc, np.frombuffer(b"".join([*enc.all(text), end]), "<u4"))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(packer.close(), columns=columns)

    return returned(sent(rows).mapInPandas(work, schema), given)
