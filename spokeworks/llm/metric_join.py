"""Exact near-duplicate join of shingle sets in the metric space of the Jaccard distance.

Nearly all pairs of texts share nothing and lie at distance 1, where no pivot leaves a pair out. So sets
meet only where they can be near: a pair of a given similarity shares one among the first few shingles of
each document in any order of all shingles. The order puts shingles that several documents hold last, so
that common passages are hardly ever among the first. It is a heuristic that changes no result. Sets under
a shingle are joined by a forest of pairs that their histograms leave possible, never by all such pairs;
what chains of these join is a group, and no link leaves a group.

Groups meet by whole sets, one task each, or are dealt to several tasks, and pivots make regions there: sets
within r of a pivot are its region's and are linked through it. By the triangle inequality a set outside
links only to members whose distance to the pivot differs from its own by r at most, so it meets these
only, and what is in no region goes on to the next pivot. A task gives a forest of links, not all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, over_batches, table, text_of
from .simhash import components, named_components

SEED = 42
#: Bits of the bitmaps, and shingles marked in one at most: the most frequent.
BITMAP_BITS = 26
MOST_MARKED = 1 << 23
#: A key of more than one row in so many is hot; fewer keys than this are. Fewer rows than DEALT are no load for one task.
HOT, DEALT = 1000, 100_000
#: Tasks that share a hot key, sets of a group in one task, and keys in an Arrow batch.
SHARES, TILE, SLICE = 64, 1024, 1 << 19
#: Classes of the histograms that bound a pair's overlap, sets of a bucket that meet in one task, and one set in so many of a dealt group meets all of its parts.
BINS, LARGEST, LARGE = 64, 8192, 8
#: Shingles of a group's sets in one task, on average.
HELD = 1 << 19
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
#: Of the words' hashes: a random number for each byte, and the powers of an odd number and of its inverse modulo 2^64.
_BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Bytes whose words are hashed at once, unless one word is longer.
BLOCK = 1 << 18


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` between ASCII white space, and where they begin."""
    every = np.frombuffer(data, np.uint8)
    hashes, starts, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while low < len(every):
        high, size = min(low + BLOCK, len(every)), BLOCK
        while high < len(every) and not (space := np.flatnonzero(_SPACE[every[low:high]])).size:
            size *= 2
            high = min(low + size, len(every))
        if high < len(every):
            high = low + int(space[-1]) + 1
        b = every[low:high]
        up, down = _powers(max(BLOCK, 1 << int(len(b) - 1).bit_length()))
        word = np.concatenate([[False], ~_SPACE[b], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)])
        hashes.append(_mixed((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]]))
        starts.append(edges[::2] + low)
        low = high
    return np.concatenate(hashes), np.concatenate(starts)


def _joined(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    h = np.zeros(len(w) - width + 1, np.uint64)
    for i in range(width):
        h = _mixed(h * np.uint64(3) + w[i : i + len(h)] + np.uint64(_BASE))
    return h


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Of each text the distinct ``width``-word shingles as sorted 64-bit hashes; the whole sequence where it is shorter; none without words."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    for k, t in enumerate(texts):
        held.append(t.encode("utf-8", "replace").translate(_LOWER))
        if sum(map(len, held[-1:])) > BLOCK or len(held) == 64 or k == len(texts) - 1:
            out += _sets_of(held, width)
            held = []
    return out


def _sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    w, starts = word_hashes(b"\n".join(texts))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    every = _joined(w, width) if len(w) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = every[a : b - width + 1] if b - a >= width else _joined(w[a:b], b - a) if b > a else every[:0]
        out.append(np.unique(own))
    return out


def shingles(text: str, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def prefix_length(n: int, percent: int) -> int:
    """How many of n shingles, the first in any order, hold a common one of each pair with a similarity of ``percent`` or more; 0 where no other set can be as near."""
    return n - (percent * n + 99) // 100 + 1 if 100 * n >= percent * (n + 1) else 0


def first_shingles(s: np.ndarray, count: int, marked: np.ndarray | None) -> np.ndarray:
    """The first ``count`` in the order of all shingles: those that ``marked`` holds last, then by hash."""
    if marked is not None and count:
        on = _holds(marked, s)
        s = np.concatenate([s[~on], s[on]])
    return s[:count]


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """The 64-bit values of ``column`` as 2^26 bits (8 MB, whatever their number), set by their highest bits; others may be set, too."""
    at = F.shiftrightunsigned(column, 64 - BITMAP_BITS)
    words = df.select(F.shiftright(at, 6).cast("int").alias("word"), (at.bitwiseAND(F.lit(63))).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # 2^20 rows at most
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def frequent(docs: DataFrame, text: str, width: int, percent: int) -> Broadcast:
    """Broadcast bitmap of shingles that several different sets hold among twice their first ones by hash; the most frequent, if they are too many for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for s in shingle_sets(batch.column(0).slice(at, 64).to_pylist(), width):
                    keys.append((s[: 2 * prefix_length(len(s), percent)] >> np.uint64(32)).astype(np.uint32))
                    owners.append(np.full(len(keys[-1]), xxhash.xxh32_intdigest(s.tobytes()), np.uint32))
                    held += len(keys[-1])
                if held >= SLICE:
                    yield _columns(["key", "owner"], np.concatenate(keys).view(np.int32), np.concatenate(owners).view(np.int32))
                    keys, owners, held = [], [], 0
        if held:
            yield _columns(["key", "owner"], np.concatenate(keys).view(np.int32), np.concatenate(owners).view(np.int32))

    # 32 bits of a shingle are enough here, as the order changes no result
    rows = docs.select(text_of(text)).mapInArrow(run, "key int, owner int")
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low <> high")
    several = cut(held.select(F.shiftleft(F.col("key").cast("long"), 32).alias("key"), F.floor(F.log2("n")).cast("int").alias("level")))
    at, marked = None, 0
    for level, n in sorted(((r["level"], r["count"]) for r in several.groupBy("level").count().collect()), reverse=True):  # 64 levels at most
        marked += n
        if marked > MOST_MARKED:
            break
        at = level
    return docs.sparkSession.sparkContext.broadcast(bitmap(several.filter(F.col("level") >= (at if at is not None else 64)), "key"))  # 8 MB


def _columns(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def digests(docs: DataFrame, text: str, doc_id: str, width: int, percent: int, marked: Broadcast) -> DataFrame:
    """doc_id, at (hashes of id and text), fp binary (128 bits that stand for the set), n long (its size), h binary (its histogram), keys array<long> (its first shingles) for each row."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2).to_pylist(), width)
        keys = [first_shingles(s, prefix_length(len(s), percent), marked.value).view(np.int64) for s in sets]
        return _columns(["doc_id", "at", *DIGEST, "keys"], batch.column(0), batch.column(1), *digest_of(sets), pa.array(keys, pa.list_(pa.int64())))

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, at {AT}, fp binary, n long, h binary, keys array<long>"
    return over_batches(docs, [F.col(doc_id), place_of(text, doc_id), text_of(text)], work, schema)


DIGEST, AT = ("fp", "n", "h"), "struct<id: bigint, text: bigint>"


def place_of(text: str, doc_id: str) -> Column:
    """Tells a row of a table by its id and text."""
    return F.struct(F.xxhash64(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("text"))


def digest_of(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """fp, n and h of sets. h: how many of a set's shingles lie in each of BINS classes, 127 at most."""
    n = np.array([len(s) for s in sets], np.int64)
    h = np.zeros((len(sets), BINS), np.int8)
    for low in range(0, len(sets), 512):
        own = sets[low : low + 512]
        at = np.repeat(np.arange(len(own)) * BINS, n[low : low + 512]) + (np.concatenate(own) % np.uint64(BINS)).astype(np.int64)
        h[low : low + 512] = np.minimum(np.bincount(at, minlength=len(own) * BINS), 127).reshape(-1, BINS)
    return pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary()), pa.array(n), pa.array([x.tobytes() for x in h], pa.binary())


def dealt_join(many: DataFrame, one: DataFrame, key: str, held: str | None = None) -> DataFrame:
    """Inner join of many rows a key with one row a key. Hot keys of over DEALT rows, fewer than HOT by their definition, are dealt to several tasks each.

    held: the column of ``one`` that tells the rows of its key in ``many``, where they are counted already.
    """
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("__n")) if held is None else one.select(key, F.col(held).alias("__n"))
    total = many.count() if held is None else counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    if total <= DEALT:
        return many.join(one, key)
    hot = F.broadcast(cut(counts.filter(F.col("__n") * HOT > total).select(key, F.lit(True).alias("__hot"))))
    share = F.when(F.col("__hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SHARES))).otherwise(0)
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, key, "left").withColumn("__share", share.cast("int")).drop("__hot")
    return left.join(one.join(hot, key, "left").withColumn("__share", F.explode(each)).drop("__hot"), [key, "__share"]).drop("__share")


def shared_keys(keys: DataFrame) -> DataFrame:
    """key, low (the smallest fp), held (rows) of the keys (key, fp) that several sets hold."""
    return keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("held")).filter("low <> high").drop("high")


def candidates(marks: DataFrame) -> DataFrame:
    """key, fp, n of the first shingles that several sets hold."""
    part = F.xxhash64("fp")  # tells sets under one shingle apart
    several = shared_keys(marks.select(F.explode("keys").alias("key"), part.alias("fp"))).select("key")
    maybe = marks.sparkSession.sparkContext.broadcast(bitmap(several, "key"))  # 8 MB

    def holding(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = batch.column(2).flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
        on = np.flatnonzero(_holds(maybe.value, keys.to_numpy().view(np.uint64)))
        whose = pa.array(owner[on])
        return _columns(["key", "fp", "n"], keys.take(pa.array(on)), batch.column(0).take(whose), batch.column(1).take(whose)) if len(on) else None

    return over_batches(marks, [F.col("fp"), F.col("n"), F.col("keys")], holding, "key long, fp binary, n long").distinct()


class Sets(NamedTuple):
    """Sets whose shingles are made anew of the texts where they meet. first: fp, n, h and at, the place of a row that has the set; docs: at and text."""

    first: DataFrame
    docs: DataFrame
    width: int

    def texts(self, members: DataFrame) -> DataFrame:
        """``members`` (fp and others), one row an fp, with the size n and a text of each.

        Other rows' texts, told by a bitmap, are not shuffled.
        """
        wanted = cut(members.join(self.first.select("fp", "n", "at"), "fp"))
        rows = wanted.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("at").alias("h")), "h"))  # 8 MB

        def holding(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            on = np.flatnonzero(_holds(rows.value, batch.column(0).to_numpy().view(np.uint64)))
            return _columns(["id", "hash", "text"], *(batch.column(k).take(pa.array(on)) for k in (1, 2, 3))) if len(on) else None

        few = over_batches(self.docs, [F.xxhash64("at"), F.col("at.id"), F.col("at.text"), F.col("text")], holding, "id long, hash long, text string")
        both = few.join(wanted.withColumns({"id": F.col("at.id"), "hash": F.col("at.text")}).drop("at"), ["id", "hash"])
        return both.groupBy("id", "hash").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in (*members.columns, "n"))).drop("id", "hash")


def shingles_of(t: pa.Table, width: int) -> list[np.ndarray]:
    return shingle_sets(t.column("text").to_pylist(), width)


def possible_links(bins: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all sets of ``keys`` (key, fp, n) that chains of pairs join which share a key and may have the similarity by their histograms.

    Each key gives a forest, found in its one task, and of keys with the same sets one is met. Keys with more
    than LARGEST sets are cut into tiles of that size.
    """
    held = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("fp")).alias("all")).filter("low <> high")
    once = held.groupBy("low", "high", "held", "all").agg(F.min("key").alias("key"))
    several = cut(once.select("key", "held", F.ceil(F.col("held") / LARGEST).cast("int").alias("tiles")))
    rows = dealt_join(keys, several, "key", "held").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # each pair of chunks i <= j of a key is a tile
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi"))))
    rows = rows.select("key", "fp", "n", "i", tiles.alias("tile")).select("key", "tile.lo", "tile.hi", "fp", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            at = np.flatnonzero(_new_tiles(t))
            if len(at) and (out := _possible_forest(t.slice(0, int(at[-1]) + 1), percent)) is not None:
                yield out
            rest = t.slice(int(at[-1]) + 1) if len(at) else t
        if rest is not None and (out := _possible_forest(rest, percent)) is not None:
            yield out

    by = ["key", "lo", "hi"]
    met = rows.join(bins.select("fp", "h"), "fp").select(*by, "fp", "n", "h").repartition(*by).sortWithinPartitions(*by)
    return met.mapInArrow(run, "a binary, b binary").distinct()


def _new_tiles(t: pa.Table) -> np.ndarray:
    """Whether each row's tile (key, lo, hi) is another than the next row's."""
    key = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")])
    return (key[:, 1:] != key[:, :-1]).any(axis=0)


def _possible_forest(t: pa.Table, percent: int) -> pa.RecordBatch | None:
    """Links a, b of the tiles (key, lo, hi, fp, n, h), which come sorted."""
    n, h = t.column("n").to_numpy(), np.frombuffer(b"".join(t.column("h").to_pylist()), np.int8).reshape(t.num_rows, BINS).astype(np.int16)
    edges = np.flatnonzero(_new_tiles(t)) + 1
    a, b = [], []
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), t.num_rows], strict=True):
        left = np.arange(low + 1, high)
        queue, root = [low], low
        while len(left):
            if not queue:
                queue, root, left = [int(left[0])], int(left[0]), left[1:]
                continue
            x = queue.pop()
            both, apart = n[left] + n[x], np.abs(h[left] - h[x]).sum(axis=1, dtype=np.int64)
            # the sets share (both - apart) / 2 at most
            on = 100 * (both - apart) >= percent * (both + apart)
            if on.any():
                found = left[on].tolist()
                queue += found
                a += [root] * len(found)
                b += found
                left = left[~on]
    fp = t.column("fp").combine_chunks()
    return _columns(["a", "b"], fp.take(pa.array(a, pa.int64())), fp.take(pa.array(b, pa.int64()))) if a else None


class Postings:
    """Sets by their shingles: how much of each another set shares."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.size, self.every, self.owner = len(sets), every[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def same(self, s: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.every, s, "left"), np.searchsorted(self.every, s, "right")
        count = b - a
        at = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=self.size)


def near_forest(sets: list[np.ndarray], percent: int, rounds: int) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that join just those that a chain of links joins; the first ``rounds`` pivots' windows leave sets out."""
    n, r = np.array([len(s) for s in sets], np.int64), 1 - percent / 100
    met, left, links = Postings(sets), np.argsort(-n, kind="stable"), []
    while len(left) > 1:
        pivot, left = int(left[0]), left[1:]
        queue, apart = [pivot], None
        while queue and len(left):
            x = queue.pop()
            # the distances to the pivot of what links to x differ by r at most
            window = left if apart is None else left[np.abs(apart[left] - apart[x]) <= r + 1e-9]
            window = window[(100 * n[window] >= percent * n[x]) & (100 * n[x] >= percent * n[window])] if apart is not None else window
            if not len(window):
                continue
            same = met.same(sets[x])
            if apart is None and rounds > 0:
                apart, rounds = 1 - same / (n[x] + n - same), rounds - 1
            same = same[window]
            found = window[100 * same >= percent * (n[x] + n[window] - same)]
            if len(found):
                queue += found.tolist()
                links += [(x, int(y)) for y in found]
                left = left[~np.isin(left, found)]
    return links


def _named_links(fp: pa.Array, pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.table({"a": fp.take(pa.array(a)), "b": fp.take(pa.array(b))})


def group_links(sets: Sets, possible: DataFrame, percent: int, rounds: int = 20) -> DataFrame:
    """a, b: enough links between the ``sets`` of each group that chains of ``possible`` (a, b) join to join all that chains of links join, and no other.

    A group of over TILE sets or HELD shingles is dealt to several tasks. One set in LARGE * parts meets all of
    them, so that a part's sets are joined to others through it. Whatever isn't joined to most of
    its group by then meets the whole group in tiles.
    """
    roots = components(possible)
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = table(sets.texts(members))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / HELD)).cast("int")
    sizes = cut(members.groupBy("root").agg(parts.alias("parts")).filter("parts > 1"))
    some = not sizes.isEmpty()
    dealt = members.join(F.broadcast(sizes), "root", "left") if some else members.withColumn("parts", F.lit(None).cast("int"))
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    everywhere = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts") * LARGE) == 0
    each = F.explode(F.when((F.col("parts") > 1) & everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))

    arrays = partial(shingles_of, width=sets.width)

    def solve(t: pa.Table) -> pa.Table:
        return _named_links(t.column("fp").combine_chunks(), near_forest(arrays(t), percent, rounds))

    found = dealt.select("root", "fp", "text", each.alias("part")).groupBy("root", "part").applyInArrow(solve, "a binary, b binary")
    if not some:
        return found
    found = cut(found)
    return found.unionByName(_links_across(dealt.filter("parts > 1").select("fp", "root", "parts", "text"), found, percent, arrays))


def _links_across(members: DataFrame, found: DataFrame, percent: int, arrays: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """a, b: links of the dealt groups' ``members`` (fp, root, parts, text) that ``found`` doesn't join, enough to join all that chains of links join."""
    joined = components(found.join(members.select(F.col("fp").alias("a")), "a", "left_semi"))
    named = joined.select(F.col("node").alias("fp"), F.col("root").alias("part")).unionByName(joined.select(F.col("root").alias("fp"), F.col("root").alias("part")).distinct())
    marked = table(members.join(named, "fp", "left").withColumn("part", F.coalesce("part", "fp")))
    most = marked.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
    rest = marked.join(F.broadcast(most), "root").filter("part <> most").drop("most")
    sizes = cut(rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    chunk = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    both = lambda rows: rows.join(F.broadcast(sizes), "root")
    left = both(marked).withColumn("i", chunk("parts")).withColumn("j", upto("tiles")).withColumn("inside", F.lit(True))
    right = both(rest).withColumn("j", chunk("tiles")).withColumn("i", upto("parts")).withColumn("inside", F.lit(False))
    rows = left.unionByName(right).select("root", "i", "j", "inside", "fp", "part", "text")

    def tile(t: pa.Table) -> pa.Table:
        own, inside = arrays(t), t.column("inside").to_numpy()
        part = np.unique(np.array(t.column("part").to_pylist(), object), return_inverse=True)[1]
        at = np.flatnonzero(inside)
        n, met, pairs = np.array([len(s) for s in own], np.int64), Postings([own[k] for k in at]), []
        for x in np.flatnonzero(~inside):
            same = met.same(own[x])
            near_ones = at[(100 * same >= percent * (n[at] + n[x] - same))]
            for y in near_ones[part[near_ones] != part[x]]:
                if part[x] != part[y]:  # one link joins two parts
                    pairs.append((int(x), int(y)))
                    part[part == part[y]] = part[x]
        return _named_links(t.column("fp").combine_chunks(), pairs)

    return rows.groupBy("root", "i", "j").applyInArrow(tile, "a binary, b binary")


def rest_links(sets: Sets, bins: DataFrame, keys: DataFrame, percent: int, rounds: int = 20) -> DataFrame:
    """a, b: enough links between the sets of ``keys`` (key, fp, n) to join all that chains of links join, and no other."""
    return group_links(sets, possible_links(bins, keys, percent), percent, rounds)


def links(sets: Sets, keys: DataFrame, percent: int, rounds: int = 20) -> DataFrame:
    """As ``rest_links``. rounds: pivots of a task that make regions; whatever is left after the last one is compared without regions."""
    return rest_links(sets, sets.first, keys, percent, rounds)


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles long, component_id (the smallest doc_id reachable by links).

    Documents link if the sets of their distinct shingles have a Jaccard similarity of ``percent`` / 100
    or more. Texts without words, null ones among them, have no shingles and are linked with nothing. A
    null doc_id is never a component's id unless all of its documents have null; repeated rows give
    repeated rows; an empty table gives none; other columns are not read. Sets are told apart by 128-bit
    hashes, shingles by 64-bit hashes.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    marked = frequent(docs, text, width, percent)
    marks = table(digests(docs, text, doc_id, width, percent, marked))
    first = table(marks.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("h").alias("h")))
    sets = Sets(first, docs.select(place_of(text, doc_id).alias("at"), text_of(text).alias("text")), width)
    low = named_components(first, cut(links(sets, table(candidates(marks.filter("n > 0"))), percent)))
    found = dealt_join(marks.filter("n > 0").select("fp", "doc_id", "n"), low.select("fp", "low"), "fp").select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))
    return found.unionByName(marks.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
