"""SimHash near-dedup for a given similarity: wide fingerprints in pigeonhole blocks find the pairs, whole sets of shingles verify them.

Sets of a similarity such as 0.8 differ in far more bits of 64 than any split into blocks can stand. So
fingerprints are wide: signs of 768 random projections of the hashed set, in 48 blocks of 16 bits.
Pairs of the similarity share a block in 97 cases of 100. Under a block fingerprints are compared by
the Hamming distance of 512 bits, which gives a forest of pairs that may be near; what chains of these
join is a group, whose whole sets meet as in ``metric_join``, and no link rests on fingerprints. Few
shingles make no good fingerprint: small sets meet under their first shingles instead, which misses no pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metric_join as join
from .common import cut, over_batches, table, text_of
from .simhash import named_components

SEED = 42
#: Hash buckets of shingles, bits of a block, blocks, and 64-bit words that are compared.
BUCKETS, BLOCK_BITS, BLOCKS, WORDS = 2048, 16, 48, 8
#: Sets of at most so many shingles have no fingerprint; they meet under their first shingles.
SMALL = 64
#: Sets of a block's value that are compared in one task; if there are more, they are one group without a comparison.
LARGEST = 32_768
#: Texts whose sets are held at once when fingerprints are made.
SLICE = 1024


@lru_cache(maxsize=1)
def projections() -> np.ndarray:
    """Random signs, the same everywhere."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (BUCKETS, BLOCKS * BLOCK_BITS))


def wide_bits(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set of shingles as a row of bytes."""
    out = np.zeros((len(sets), BLOCKS * BLOCK_BITS // 8), np.uint8)
    for at in range(0, len(sets), 512):
        own = sets[at : at + 512]
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(own)) * BUCKETS, [len(s) for s in own]) + (every % np.uint64(BUCKETS)).astype(np.int64)
        sums = np.bincount(place, (every >> np.uint64(63)).astype(np.float32) * 2 - 1, len(own) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)
        out[at : at + 512] = np.packbits(sums @ projections() > 0, axis=1)
    return out


def most_bits(similarity: float) -> int:
    """The most of the compared bits in which sets of equal size and this similarity differ, but for one pair in twenty."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = WORDS * 64
    return int(n * share + 1.65 * (n * share * (1 - share)) ** 0.5)


def fingerprints(docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash long, at (hashes of id and text), fp binary (128 bits that stand for the set), n long (its size), h binary (its histogram), bits binary or null, keys array<long> or null for each row.

    Sets of more than SMALL shingles have bits; those of no more than their nearest larger ones have keys.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.Table.from_batches([few(batch.slice(at, SLICE)) for at in range(0, batch.num_rows, SLICE)])
        return rows.combine_chunks().to_batches()[0]

    def few(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = join.shingle_sets(batch.column(2).to_pylist(), width)
        large = np.array([len(s) > SMALL for s in sets], bool)
        rows = iter(wide_bits([s for s in sets if len(s) > SMALL]))
        bits = pa.array([next(rows).tobytes() if x else None for x in large], pa.binary())
        keys = pa.array([s[: join.prefix_length(len(s), percent)].view(np.int64) if len(s) * percent <= SMALL * 100 else None for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *join.digest_of(sets), bits, keys], ["doc_id", "at", *join.DIGEST, "bits", "keys"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, at {join.AT}, fp binary, n long, h binary, bits binary, keys array<long>"
    return over_batches(docs, [F.col(doc_id), join.place_of(text, doc_id), text_of(text)], work, schema).withColumn("text_hash", F.col("at.text"))


def near_pairs(sets: DataFrame, most: int) -> DataFrame:
    """a, b: of the sets that have bits, enough pairs that share a block and differ in ``most`` bits or fewer to join all that chains of such pairs join."""
    keyed = _keyed(sets)
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    crowded = None
    if sets.count() > LARGEST:
        crowds = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("fp").alias("low")).filter(F.col("held") > LARGEST))
        if not crowds.isEmpty():
            crowded = join.dealt_join(keyed.select("key", "fp"), crowds, "key", "held").filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
            keyed = keyed.join(crowds, "key", "left_anti")
    found = keyed.withColumn("__n", n).filter("__n > 1").select("key", "fp", "bits").sortWithinPartitions("key").mapInArrow(lambda batches: _near(batches, most), "a binary, b binary")
    return (found if crowded is None else found.unionByName(crowded)).distinct()


def small_keys(sets: DataFrame) -> DataFrame:
    """key, fp, n: the first shingles that several of the sets that have keys hold."""
    small = sets.filter("keys is not null").select(F.explode("keys").alias("key"), "fp", "n")
    return join.dealt_join(small, cut(join.shared_keys(small).select("key", "held")), "key", "held").select("key", "fp", "n")


def _keyed(sets: DataFrame) -> DataFrame:
    """key, fp and the compared bits for each block of the sets that have bits."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        parts = rows.view("<u2").astype(np.int64) + (np.arange(BLOCKS, dtype=np.int64) << 16)
        own = pa.array([r.tobytes() for r in np.ascontiguousarray(rows[:, : WORDS * 8])], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), own, pa.array(list(parts), pa.list_(pa.int64()))], ["fp", "bits", "keys"])

    rows = over_batches(sets.filter("bits is not null"), [F.col("fp"), F.col("bits")], work, "fp binary, bits binary, keys array<long>")
    return rows.select(F.explode("keys").alias("key"), "fp", "bits")


def _near(batches, most: int):
    """Links a, b that join the rows of a key that chains of near ones join; keys come sorted, each in one task and of bounded size."""
    fps, bits, key = [], [], None

    def flush():
        if not fps:
            return None
        fp, words = np.concatenate(fps), np.concatenate(bits)
        left, a, b = np.arange(len(fp)), [], []
        while len(left) > 1:  # one after another leaves with all that are near it; what is near one of those is found through it
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                near = np.bitwise_count(words[left] ^ words[queue.pop()]).sum(axis=1) <= most
                if near.any():
                    queue += left[near].tolist()
                    a += [root] * int(near.sum())
                    b += left[near].tolist()
                    left = left[~near]
        return pa.RecordBatch.from_arrays([pa.array(fp[x].tolist(), pa.binary()) for x in (a, b)], ["a", "b"]) if a else None

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fp = np.array(batch.column(1).to_pylist(), object)
        words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(fp), WORDS)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *edges], [*edges, len(fp)], strict=True):
            if keys[a] != key:
                if (out := flush()) is not None:
                    yield out
                fps, bits, key = [], [], keys[a]
            fps.append(fp[a:b])
            bits.append(words[a:b])
    if (out := flush()) is not None:
        yield out


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of documents whose sets of ``width``-word shingles have a similarity of ``percent`` / 100 or more, chains of them joined.

    Every link is verified by the whole sets. The row with the smallest doc_id stays, of rows that repeat
    it one with the smallest hash of its text, then of all its columns. Texts without words are one group,
    null texts among them. Rows without doc_id stay. An empty table gives no rows; all columns are kept,
    whatever their names.
    """
    known = docs.filter(F.col(doc_id).isNotNull())
    marked = table(fingerprints(known, text, doc_id, width, percent))
    best = F.min(F.struct("doc_id", "text_hash")).alias("first")
    first = marked.groupBy("fp").agg(best, F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("n", "h", "bits", "keys")))
    first = table(first)
    pairs = table(near_pairs(first.select("fp", "n", "bits"), most_bits(percent / 100)))
    keys = table(small_keys(first.select("fp", "n", "keys")))
    sets = join.Sets(first, known.select(join.place_of(text, doc_id).alias("at"), text_of(text).alias("text")), width)
    edges = cut(join.group_links(sets, pairs.unionByName(join.possible_links(first, keys, percent)), percent))
    low = named_components(first.select("fp", F.struct("first.*", "fp").alias("first")), edges)
    chosen = low.filter("first = low").select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    times = marked.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count(F.lit(1)).alias("__n"))
    kept = cut(chosen.join(times, ["__id", "__hash"]))
    same = (F.col(f"d.`{doc_id}`") == F.col("k.__id")) & (F.xxhash64(text_of(f"d.`{text}`")) == F.col("k.__hash"))
    # ids are hashed in each partition, so the texts are shuffled once and never sorted
    alone = docs.alias("d").join(kept.filter("__n = 1").alias("k").hint("shuffle_hash"), same, "left_semi")
    again = docs.alias("d").join(kept.filter("__n > 1").alias("k").hint("shuffle_hash"), same, "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = again.groupBy(F.col(doc_id).alias("__id")).agg(F.min_by(row, F.xxhash64(row)).alias("__row")).select("__row.*")
    return alone.unionByName(one).unionByName(docs.filter(F.col(doc_id).isNull()))
