"""How filters interact: what each removes in every order, read off decision diagrams of their failures."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import by_group, small, stored

#: Failure conditions of the five filters, in the order of their bits.
FILTERS = "ABCDE"
#: A text is one of at most so many that hold this share of all rows: those are joined by broadcast.
HEAVY = 4096


class Diagram:
    """A decision diagram over failure masks, weighted by counts.

    A node of level i decides the filter that stands at i: its low edge leads to the documents that pass, its high edge to
    those that fail. Equal sub-diagrams are one node, so that a node may be reached by several paths; no level is left out.
    A node weighs as much as the documents of one path through it.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], filters: str):
        self.order = list(filters)
        self.none = (0,) * len(next(iter(weights.values())))
        self.edges: dict[int, tuple[int, int]] = {}
        self.weight: dict[int, tuple[int, ...]] = {}
        self.leaves: dict[tuple[int, ...], int] = {}
        self.tables: list[dict[tuple[int, int], int]] = [{} for _ in filters]
        self.fresh = itertools.count()
        self.root = self._build(weights, 0, 0)

    def _build(self, weights, level: int, mask: int) -> int:
        if level == len(self.order):
            leaf = weights.get(mask, self.none)
            if leaf not in self.leaves:
                self.leaves[leaf] = next(self.fresh)
                self.weight[self.leaves[leaf]] = leaf
            return self.leaves[leaf]
        return self._node(level, self._build(weights, level + 1, mask), self._build(weights, level + 1, mask | 1 << level))

    def _node(self, level: int, low: int, high: int) -> int:
        table = self.tables[level]
        if (low, high) not in table:
            node = table[low, high] = next(self.fresh)
            self.edges[node] = (low, high)
            self.weight[node] = tuple(a + b for a, b in zip(self.weight[low], self.weight[high]))
        return table[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of two adjacent levels; nodes above and below stay as they are."""
        upper, lower = self.tables[level], self.tables[level + 1]
        self.tables[level], self.tables[level + 1] = {}, {}
        for (low, high), node in upper.items():
            (f00, f01), (f10, f11) = self.edges[low], self.edges[high]
            pair = self._node(level + 1, f00, f10), self._node(level + 1, f01, f11)
            self.edges[node] = pair
            self.tables[level][pair] = node
        for node in lower.values():
            del self.edges[node], self.weight[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple]:
        """(filter, weight kept, weight removed, weight failing though removed earlier), level by level; afterwards ``only`` holds the
        weights of the documents that fail the filter of each level and no other."""
        paths, node, alone = {self.root: 1}, self.root, []
        for name in self.order:
            low, high = self.edges[node]
            fails, below = [0] * len(self.none), {}
            for n, times in paths.items():
                for to in self.edges[n]:
                    below[to] = below.get(to, 0) + times
                fails = [x + times * y for x, y in zip(fails, self.weight[self.edges[n][1]])]
            removed = self.weight[high]
            alone = [self.edges[n][0] for n in alone] + [high]
            yield name, self.weight[low], removed, tuple(x - y for x, y in zip(fails, removed))
            paths, node = below, low
        self.only = [self.weight[n] for n in alone]


def plain_changes(n: int) -> Iterator[int]:
    """Places i of the swaps of i and i + 1 that lead through all orders of n things."""
    if n < 2:
        return
    inner, left = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if left else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if left else step
        left = not left


def tables(weights: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, weight kept, weight removed, n failing though removed earlier, n failing only this filter, n removed in all orders) of every order."""
    diagram, seen = Diagram(weights, filters), []

    def read() -> None:
        steps = list(diagram.steps())
        name = "".join(diagram.order)
        seen.extend((name, k + 1, f, kept, removed, late[0], only[0]) for k, ((f, kept, removed, late), only) in enumerate(zip(steps, diagram.only)))

    read()
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        read()
    every = dict.fromkeys(filters, 0)
    for row in seen:
        every[row[2]] += row[4][0]
    return [(name, step, kept, removed, late, only, every[f]) for name, step, f, kept, removed, late, only in seen]


def failures(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and the bits of the failures that a text shows by itself: A 1, B 2, C 4, D 8."""
    blank = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    rows = rows.withColumn("words", F.array_remove(F.split(blank, " "), ""))
    n, distinct, points = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long"), F.char_length("text").cast("long")
    conditions = (n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * points, F.col("text").rlike("[#$%&*|]"))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)]
    return rows.withColumn("bits", sum(bits[1:], bits[0])).drop("words")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", *, heavy: int = HEAVY) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the bits of the filters that they fail."""
    body = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), body.alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    rows = stored(failures(rows).select("id", "part", F.sha2("text", 256).alias("hash"), "bits"), "failures")
    n = rows.count()
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copies = stored(rows.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("copies")).where("first < last").select("hash", "first", "copies"), "copies")
    often = F.col("copies") >= math.ceil(max(n, 1) / heavy)
    told = by_group(rows, copies.where(often).drop("copies"), copies.where(~often).drop("copies"), "hash", "left")
    told = told.select("id", "part", (F.col("bits") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    marked = told.join(small(marks), "id", "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.coalesce("good", F.lit(False))).alias("good"), F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"))


_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for every part,
    order of the five filters and step in it.

    A part is a value of ``part_col``; a null one is the empty string. A null text is an empty one. A document fails A with
    fewer than 50 words, B if under 65 % of its words are distinct, C if over 5 % of its code points are ``A-Z``, D with one of
    ``#$%&*|``, E if a smaller id has the same text (compared by SHA-256) anywhere in the table; a null id is smaller and larger
    than none, and rows that share id and text don't fail by each other. Labels are ``quality = 1`` and ``toxic = 1`` of an id;
    an id labelled twice counts as good or toxic if one of its labels says so. An empty table gives an empty result; other
    columns are not read.

    Rows are shuffled as hashes and bits. A text that very many rows hold is joined by broadcast, of which there can only be a bounded number.
    By part, at most 32 masks are left, in one row each part: its diagram is built from them, and 119 swaps of adjacent levels
    lead through all 120 orders.
    """
    counts = masks(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, found in zip(batch["part"], batch["masks"]):
                rows = tables({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in found})
                yield pd.DataFrame([(part, name, step, kept[0], gone[0], late, only, gone[1], gone[2], every) for name, step, kept, gone, late, only, every in rows], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return parts.mapInPandas(read, _SCHEMA)
