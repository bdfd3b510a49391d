"""Shards of near equal bytes, groups of equal texts whole: Karmarkar-Karp differencing, in blocks and then over their parts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import by_group, small, stored, texts

#: Light groups that are differenced together in one task.
BLOCK = 4096
#: Blocks whose parts are differenced on the driver; where there are more, blocks are merged first.
BLOCKS = 512
#: A group with at least this share of all bytes or rows is heavy: one of at most 2 x 4096.
HEAVY = 4096
#: Rows of a shard that are numbered together.
CELL = 65_536


def difference(partitions: Iterable[Sequence[int]]) -> list[list[int]]:
    """For each partial partition (its parts' sizes), the final part that each of its parts goes to.

    The two with the largest spread (largest part less smallest) are combined, the largest part of one with the smallest of
    the other, and so on, until one is left. All have the same number of parts; a single item is (size, 0, ..., 0). Ties go
    to the partition that came first.
    """
    nodes: list[tuple] = []  # (places of the parts by size, None) or (order of the sums, (node, node))
    heap: list[tuple] = []
    for sizes in partitions:
        order = sorted(range(len(sizes)), key=lambda p: -sizes[p])
        parts = [sizes[p] for p in order]
        heap.append((parts[-1] - parts[0], len(nodes), parts))
        nodes.append((order, None))
    count = len(nodes)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(len(sums)), key=lambda p: -sums[p])
        parts = [sums[p] for p in order]
        heapq.heappush(heap, (parts[-1] - parts[0], len(nodes), parts))
        nodes.append((order, (a, b)))
    final: list = [None] * len(nodes)
    if nodes:
        final[-1] = list(range(len(nodes[-1][0])))  # the final part of each part, the largest first
    for k in range(len(nodes) - 1, -1, -1):
        order, pair = nodes[k]
        placed = [0] * len(order)
        for place, p in enumerate(order):
            placed[p] = final[k][place]
        if pair is None:
            final[k] = placed
        else:
            final[pair[0]], final[pair[1]], final[k] = placed, placed[::-1], None
    return final[:count]


def _items(sizes: Iterable[int], parts: int) -> list[list[int]]:
    return [[int(s)] + [0] * (parts - 1) for s in sizes]


def _blocks(dealt: DataFrame, parts: int) -> DataFrame:
    """(hash, bytes, block, part) of light groups: those of a block are differenced in one task."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "hash"], ascending=[False, True])
        return rows.assign(part=[p[0] for p in difference(_items(rows["bytes"], parts))])[["hash", "bytes", "block", "part"]]

    return dealt.groupBy("block").applyInPandas(split, "hash binary, bytes long, block long, part int")


def _merged(labelled: DataFrame, blocks: int, parts: int) -> DataFrame:
    """The light groups with the parts of blocks that are merged into ``blocks`` larger ones, each in one task."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="small_block", columns="part", values="bytes").reindex(columns=range(parts)).fillna(0).astype("int64").sort_index()
        places = difference(wide.to_numpy().tolist())
        at = [(b, p, to, int(rows["block"].iloc[0])) for b, row in zip(wide.index, places) for p, to in enumerate(row)]
        return pd.DataFrame(at, columns=["small_block", "part", "to", "block"])

    sums = labelled.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
    wider = sums.select(F.col("block").alias("small_block"), F.pmod(F.xxhash64("block"), F.lit(blocks)).alias("block"), "part", "bytes")
    places = wider.groupBy("block").applyInPandas(split, "small_block long, part int, to int, block long")
    return labelled.withColumnRenamed("block", "small_block").join(places, ["small_block", "part"]).select("hash", "bytes", "block", F.col("to").alias("part"))


def shards(docs: DataFrame, parts: int = 8, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK, blocks: int = BLOCKS, heavy: int = HEAVY, cell: int = CELL) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), a row for every row of ``docs``: near equal bytes in each shard.

    The size of a row is the UTF-8 bytes of its text and one more; a null text counts as an empty one. Rows with equal texts
    are a group, told by a 128-bit hash, and go to one shard; so a group over an even share has a shard that stays over it,
    and the others share the rest evenly. ``slot`` numbers a shard's rows from 0 in an order that the rows alone decide;
    rows that share id and text can't be told apart. ``law`` is ``bytes``, ``grown_shard`` null. An empty table gives an
    empty result, other columns are not read, and ids may be null.

    Differencing needs all groups in one heap, which no task can hold. Groups are therefore dealt by their hash to blocks of about
    ``block`` groups, and each block is differenced in a task of its own; if there are more than ``blocks`` of these, their
    partial partitions are combined in the same way in ``blocks`` tasks. Three kinds of single items are then differenced on
    the driver: the parts that come out, at most ``blocks * parts``; the heavy groups, at most 2 ``heavy``; and the groups of one block,
    which fill what the larger items leave uneven. Unless a group is over an even share, shards differ by no more than such a part, and mostly
    by a few bytes. Only heavy groups are broadcast, so a group with a third of all rows isn't shuffled.
    """
    plain = texts(docs, id_col, text_col)
    rows = stored(plain.select("id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.md5("text")).alias("hash")), "sizes")
    groups = stored(rows.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    is_heavy = (F.col("bytes") >= F.lit(math.ceil((total["bytes"] or 0) / heavy))) | (F.col("n") >= F.lit(math.ceil((total["n"] or 0) / heavy)))
    large = sorted(groups.where(is_heavy).select("hash", "bytes").collect(), key=lambda g: (-g["bytes"], bytes(g["hash"])))
    now = max(1, math.ceil((total["groups"] - len(large)) / block))
    dealt = groups.where(~is_heavy).select("hash", "bytes", F.pmod(F.xxhash64("hash"), F.lit(now)).alias("block"))
    large += dealt.where("block = 0").orderBy("hash").collect()
    light = stored(_blocks(dealt.where("block > 0"), parts), "parts")
    if now > blocks + 1:
        light = stored(_merged(light, blocks, parts), "merged-parts")
    bundles = light.groupBy("block", "part").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "block", "part").collect()
    to = [p[0] for p in difference(_items([g["bytes"] for g in large] + [b["bytes"] for b in bundles], parts))]
    spark = docs.sparkSession
    singles = spark.createDataFrame([(bytes(g["hash"]), s) for g, s in zip(large, to)], "hash binary, shard int")
    places = spark.createDataFrame([(b["block"], b["part"], s) for b, s in zip(bundles, to[len(large) :])], "block long, part int, shard int")
    lights = light.join(F.broadcast(places), ["block", "part"]).select("hash", "shard")
    dealt = by_group(rows, singles, lights, "hash", "inner")
    cells = max(1, math.ceil((total["n"] or 0) / cell))
    placed = stored(dealt.withColumn("cell", F.pmod(F.xxhash64("id", "hash"), F.lit(cells))), "shards")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "hash"))
    out = placed.withColumn("rank", rank).join(small(starts), ["shard", "cell"])
    return out.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
