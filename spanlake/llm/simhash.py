"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits in a ring of five segments. If two fingerprints differ in at most four bits, then from some
segment on, every chain of l consecutive segments has at most floor(4 l / 5) differing bits: none in the first, at most 1 in
the first two, 2 in three, 3 in four. The first two links of the chain are looked up with equi-joins (the first segment as it
is, the second with at most one bit turned; of very many fingerprints the third too), the further ones prune candidates before
the full Hamming check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import id_kind, returned, sent, small, stored, texts
from spanlake.llm.components import components

#: Segment i of the ring: (lowest bit, width).
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Differing bits that link two fingerprints.
BITS = 4
SHINGLE = 4
#: Segments of a key, and the fingerprints from which keys have three: with so many, a key of two is shared by several.
CHAIN, MANY = 2, 1 << 28
#: Fingerprints under one key from which their pairs are found over midpoints instead.
DENSE = 512


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint: bit b is 1 if it is set in over half of the XXH64 (seed 42) of all word shingles.

    Words are separated by \\x20 and \\x09-\\x0D after A-Z are lower-cased. A text of fewer words has one shingle of them all;
    a text without words has fingerprint 0.
    """
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. A null text has fingerprint 0."""

    def work(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps})

    rows = texts(docs, id_col, text_col)
    given, kind = id_kind(rows)
    return returned(sent(rows).mapInPandas(work, f"id {kind}, fp long"), given)


def _segment(column: str, i: int):
    low, width = RING[i % 5]
    return F.shiftrightunsigned(F.col(column), low).bitwiseAND(F.lit((1 << width) - 1))


def _mask(i: int, length: int) -> int:
    mask = 0
    for k in range(i, i + length):
        low, width = RING[k % 5]
        mask |= ((1 << width) - 1) << low
    return mask - (1 << 64) if mask >> 63 else mask


def _turns(i: int, chain: int) -> list[int]:
    """What the bits of a chain's key may differ by: none in its first segment, and at most k in the first k + 1."""
    out = [0]
    for k in range(1, chain):
        bits = [1 << (13 * (chain - 1 - k) + b) for b in range(RING[(i + k) % 5][1])]
        for _ in range(k):  # one more at a time
            out = sorted({x ^ b if x.bit_count() < k else x for x in out for b in [0, *bits]})
    return out


def _turned(head, turns):
    return F.transform(turns, lambda t: head.bitwiseXOR(t))


def _keys(nodes: DataFrame, turned: bool, chain: int = CHAIN) -> DataFrame:
    """(key, fp): start and first ``chain`` segments of each chain; with ``turned``, also all that they may differ by."""
    keys = []
    for i in range(5):
        head = F.lit(i)
        for k in range(chain):
            head = F.shiftleft(head.cast("long"), 13).bitwiseOR(_segment("fp", i + k))
        turns = F.lit(_turns(i, chain) if turned else [0]).cast("array<bigint>")
        keys.append(_turned(head, turns))
    return nodes.select("fp", F.explode(F.flatten(F.array(*keys))).alias("key"))


def _passes(a: str, b: str, chain: int = CHAIN):
    """The rest of the chain that starts at the segment in the key's upper bits, then all 64 bits."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    found = F.lit(False)
    for i in range(5):
        held = [F.bit_count(differ.bitwiseAND(F.lit(_mask(i, n)))) <= most for n, most in ((3, 2), (4, 3))]
        found = found | ((F.shiftright(F.col("key"), 13 * chain) == i) & held[0] & held[1])
    return found & (F.bit_count(differ) <= BITS)


def links(nodes: DataFrame, dense: int = DENSE, chain: int = CHAIN) -> DataFrame:
    """Edges (a, b) that connect what pairs of ``nodes`` (distinct fp) of at most ``BITS`` differing bits connect.

    ``chain``: segments of a key, 2 or 3. Three emit twenty times the keys, each of which 2^13 times fewer fingerprints share:
    the form for over some hundred million fingerprints, with the same links. Keys with over ``dense`` fingerprints would give
    pairs by the square. Fingerprints there are linked over midpoints: two differ in at most 4 bits exactly if turning at most
    2 bits of each can give the same value, and all that give it are linked to the smallest of them.
    """
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = _keys(nodes, False, chain)
    full = small(index.groupBy("key").count().where(F.col("count") > dense).select("key"))
    a, b = _keys(nodes, True, chain).withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    good = _passes("a", "b", chain) & (F.col("a") != F.col("b"))
    if full.isEmpty():
        return a.join(b, "key").where(good).select("a", "b").distinct()
    pairs = a.join(full, "key", "left_anti").join(b, "key").where(good).select("a", "b").distinct()
    crowd = _keys(nodes, True, chain).join(full, "key", "left_semi").select("fp").distinct()
    one, two = (f"if({x} = 64, 0L, shiftleft(1L, {x}))" for x in "ij")
    halfway = crowd.withColumn("i", F.explode(F.expr("sequence(0, 64)"))).withColumn("j", F.explode(F.expr("if(i = 64, array(64), sequence(i + 1, 64))"))).select("fp", F.expr(f"fp ^ {one} ^ {two}").alias("mid"))
    least = halfway.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.unionByName(halfway.join(least, "mid").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """(id, fp, component_id), a row for every row of ``docs``; component_id is the smallest id reachable over links.

    Equal fingerprints are one node, so copies are never paired with each other. A null or empty text has fingerprint 0 and
    is linked like any other; repeated rows share their component; an empty table gives an empty result. Whole texts count,
    however long. The fingerprints are written to the shared folder once.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    found = components(links(nodes.select("fp"), dense, CHAIN if nodes.count() < MANY else 3))
    grouped = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id; all columns stay as they are.

    Texts without a word say nothing about being copies: they stay. Rows that repeat an id stay together.
    """
    groups = near_groups(docs.where(docs[text_col].rlike(r"[^\x20\x09-\x0D]")), id_col, text_col)
    gone = groups.where("id != component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
