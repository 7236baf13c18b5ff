"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, connected components.

Fingerprints of 64 bits lie in 6 blocks. Two that differ in at most 3 bits agree on 3 whole blocks
at least, so they meet under one of the 20 choices of 3 blocks. Distinct fingerprints only are
compared: a group of copies is one of them. A bucket gives a spanning forest of its links, found
in its one task, never its pairs. Buckets beyond a size are cut by the 560 choices of 13 of 16
blocks, which leave 12 bits free and so hold at most 4096 distinct fingerprints, whatever the input.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, over_batches, text_of

SEED = 42
#: Block edges of the first pigeonhole and of the one for large buckets.
EDGES = (0, 11, 22, 32, 43, 54, 64)
FINE = tuple(range(0, 65, 4))
#: A fingerprint of more than one row in so many is hot; there are fewer hot ones than this, so that they can be broadcast.
HOT = 1000


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64, repeats included; zero without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id, fp long (the fingerprint's 64 bits) for each row; null texts count as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return over_batches(docs, [F.col(doc_id), text_of(text)], work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def masks(edges: tuple[int, ...], free: int) -> list[int]:
    """Signed 64-bit masks of all choices of blocks that leave out ``free`` of them."""
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(blocks, len(blocks) - free)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (root, other) that join just those of the distinct ``fps`` that a chain of links within ``most`` bits joins."""
    left, links = np.sort(fps), []
    while len(left) > 1:
        root, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= most
            if near.any():
                queue += list(left[near])
                links += [(int(root), int(x)) for x in left[near]]
                left = left[~near]
    return links


def in_buckets(keyed: DataFrame, most: int) -> DataFrame:
    """Links a, b of the buckets (choice, key) of fingerprints; buckets come sorted and whole, each of bounded size."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            choice, value, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero((choice[1:] != choice[:-1]) | (value[1:] != value[:-1])) + 1
            out = []
            for a, b in zip([0, *edges], [*edges, len(fp)], strict=True):
                if (choice[a], value[a]) != key:
                    out += forest(np.concatenate(held), most) if held else []
                    held, key = [], (choice[a], value[a])
                held.append(fp[a:b])
            if out:
                yield _links(out)
        if held and (out := forest(np.concatenate(held), most)):
            yield _links(out)

    n = F.count(F.lit(1)).over(Window.partitionBy("choice", "key"))
    several = keyed.withColumn("n", n).filter("n > 1").select("choice", "key", "fp")
    return several.sortWithinPartitions("choice", "key").mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def keys(fps: DataFrame, choices: list[int]) -> DataFrame:
    """choice, key and fp for each choice of blocks."""
    each = F.posexplode(F.array(*(F.lit(m) for m in choices))).alias("choice", "mask")
    return fps.select("fp", each).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(fps: DataFrame, most: int = 3, largest: int = 32_768) -> DataFrame:
    """Links a, b between the distinct fingerprints ``fps``: enough of those within ``most`` = 3 bits to join every chain.

    largest: distinct fingerprints of a bucket that one task compares; the members of larger buckets
    are compared in the fine buckets, which hold 4096 at most.
    """
    if most != 3:
        raise ValueError("the blocks are cut for 3 bits")
    choices = masks(EDGES, 3)
    large = cut(keys(fps, choices).groupBy("choice", "key").count().filter(F.col("count") > largest).select("choice", "key"))
    coarse = keys(fps, choices)
    if large.isEmpty():
        return in_buckets(coarse, most)
    hot = coarse.join(large, ["choice", "key"], "left_semi").select("fp").distinct()
    return in_buckets(coarse.join(large, ["choice", "key"], "left_anti"), most).unionByName(in_buckets(keys(hot, masks(FINE, 3)), most))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is its component's smallest node.

    Alternates large-star and small-star steps until the edges no longer change. Each step shuffles its edges once, by
    node, where they are made distinct and meet the smallest neighbour.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    least = F.min("b").over(Window.partitionBy("a"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    of_node = lambda rows: rows.repartition("a").distinct()
    before = None
    for _ in range(rounds):
        low = of_node(edges.select(both).select("e.*")).withColumn("m", F.least("a", least))
        # the larger of each pair goes to the node's smallest neighbour
        large = low.select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).filter("a > b")
        small = of_node(large).withColumn("m", least)
        edges = cut(of_node(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, most: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id (the smallest doc_id reachable by links).

    Documents link if their fingerprints differ in ``most`` bits or fewer. Null and empty texts have
    fingerprint zero and link like any other. A null doc_id is never a component's id unless all of
    its documents have null; repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """
    marked = cut(fingerprints(docs, text, doc_id, width))
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    by_fp = cut(named_components(first, links(first.select("fp"), most)).select("fp", F.col("low").alias("component_id"), "n"))
    return with_components(marked, by_fp)


def named_components(first: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``first`` (fp, first) with low: the smallest ``first`` of the fingerprints that ``edges`` join."""
    roots = components(edges)
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    named = members.join(first.select("fp", "first"), "fp")
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    return first.join(named.join(lowest, "root").select("fp", "low"), "fp", "left").withColumn("low", F.coalesce("low", "first"))


def with_components(marked: DataFrame, by_fp: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``marked`` with the component_id of their fingerprint (fp, component_id, n: rows of it).

    Rows of hot fingerprints, those of over one row in ``hot``, never meet in one task: these
    fingerprints, fewer than ``hot``, are broadcast.
    """
    total = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.broadcast(by_fp.filter(F.col("n") * hot > total).select("fp", "component_id"))
    rest = marked.join(often, "fp", "left_anti").join(by_fp.filter(F.col("n") * hot <= total), "fp")
    return marked.join(often, "fp").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


def hexadecimal(column: str):
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
