"""Exact top-k search by inner product with a KD-tree per shard.

A coarse tree over a bounded sample cuts space into regions at medians; a region's rows are dealt to
shards of bounded size, so that vectors that a third of all rows share make more shards, not larger
ones. A shard's tree splits at medians and keeps tight bounding boxes. A query first searches the
region whose box promises most; its kth score goes along to the other regions, of which those whose
box can't reach it are left out before any vector is shuffled, and a shard's best-first traversal
leaves every node whose box can't beat it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TREE = "region int, shard long, dim int, ids binary, rows binary, vectors binary, left binary, right binary, start binary, stop binary, low binary, high binary, first binary"
HITS = "query_row long, query_id long, vec_id long, score long"
#: Rows that the coarse tree is fitted on, and its regions, at most; every row is indexed.
SAMPLE, REGIONS = 16_384, 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """row long (a number of the row's own), vec_id long, v array<double>: floor(scale * x) of each component.

    Rows whose id or vector is null, or whose vector is empty or holds null, NaN or infinity (before or
    after scaling), take no part. Rows that repeat an id all take part.
    """
    x = F.transform(F.col(embedding), lambda c: c.cast("double") * F.lit(scale))
    good = F.size(x).between(1, 2**31 - 1) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # whole doubles; those beyond 2**53 have no fraction to cut, and floor would take them through a long
    v = F.transform(x, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column of lists of one length."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def exact_kind(size: float, dim: int) -> type:
    """In which numbers products of ``dim`` components, each at most ``size`` in amount, are exact."""
    return np.float64 if size * dim < 1 << 53 else np.int64 if size * dim < 1 << 63 else object


def exact(a: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape) if kind is object else a.astype(kind)


def saturated(scores: np.ndarray) -> np.ndarray:
    """Scores as they are compared and returned: those beyond a long are its nearest value."""
    return np.clip(scores, _LEAST, _MOST) if scores.dtype == object else scores


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each query's inner product with a vector of each box can be, exactly."""
    size = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0), 1.0) * max(np.abs(queries).max(initial=0), 1.0)
    kind = exact_kind(size, queries.shape[1])
    q, low, high = (exact(a, kind) for a in (queries, low, high))
    return saturated(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)


class Tree:
    """Nodes in arrays; node 0 is the root. left is -1 at leaves. rows: the numbers of the rows beside their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = 64):
        self.order, nodes = np.arange(len(ids)), []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            start, stop, parent, side = stack.pop()
            own = vectors[self.order[start:stop]]
            low, high = own.min(axis=0), own.max(axis=0)
            k = len(nodes)
            nodes.append([-1, -1, start, stop, low, high, ids[self.order[start:stop]].min()])
            if parent >= 0:
                nodes[parent][side] = k
            if stop - start > leaf and (spread := high - low).any():
                axis, middle = int(spread.argmax()), (stop - start) // 2
                part = np.argpartition(own[:, axis], middle)
                self.order[start:stop] = self.order[start:stop][part]
                stack += [(start, start + middle, k, 0), (start + middle, stop, k, 1)]
        self.ids, self.rows, self.vectors = ids[self.order], rows[self.order], vectors[self.order]
        self.left, self.right, self.start, self.stop = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
        self.low, self.high = (np.stack([n[i] for n in nodes]) for i in (4, 5))
        self.first = np.array([n[6] for n in nodes], np.int64)

    FIELDS = ("ids", "rows", "vectors", "left", "right", "start", "stop", "low", "high", "first")
    WIDE = ("vectors", "low", "high")

    @classmethod
    def load(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        for name in cls.FIELDS:
            wide = name in cls.WIDE
            a = np.frombuffer(row[name], np.float64 if wide else np.int64)
            setattr(tree, name, a.reshape(-1, row["dim"]) if wide else a)
        return tree

    def fields(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), np.float64 if k in self.WIDE else np.int64).tobytes() for k in self.FIELDS}

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int, least: list[tuple[int, int] | None]) -> Iterator[tuple[int, int, int]]:
        """(query's place, id, score) of up to k best rows of each query, without its own, that can be among its k best of all.

        least: a query's kth score and id so far, None before there are k.
        """
        limits = upper_bounds(queries, self.low, self.high)
        size = max(np.abs(self.vectors).max(initial=0), 1.0) * max(np.abs(queries).max(initial=0), 1.0)
        kind = exact_kind(size, queries.shape[1])
        vectors, queries = exact(self.vectors, kind), exact(queries, kind)
        for i, (own, q) in enumerate(zip(query_rows.tolist(), queries, strict=True)):
            best: list[tuple[int, int]] = []  # (score, -id), the worst first
            floor = (least[i][0], -least[i][1]) if least[i] else None
            limit = limits[i]
            heap = [(-limit[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if floor and (-bound, -int(self.first[node])) < floor:
                    if -bound < floor[0]:
                        break  # nor can any other node
                    continue
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        heapq.heappush(heap, (-limit[child], int(child)))
                    continue
                a, b = self.start[node], self.stop[node]
                scores = saturated(vectors[a:b] @ q)
                at = np.flatnonzero(scores >= floor[0]) if floor else np.arange(b - a)
                if len(at) > k + 1:  # the own row may be among them
                    order = np.lexsort((self.ids[a:b][at], -scores[at])) if kind is not object else sorted(range(len(at)), key=lambda j: (-scores[at[j]], self.ids[a + at[j]]))
                    at = at[order[: k + 1]]
                for j in at.tolist():
                    entry = (int(scores[j]), -int(self.ids[a + j]))
                    if self.rows[a + j] == own or floor and entry < floor:
                        continue
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, entry)
                    if len(best) == k and (floor is None or best[0] > floor):
                        floor = best[0]
            yield from ((i, -negative, value) for value, negative in best)


@dataclass(frozen=True)
class Regions:
    """By vector length: cuts (axis, value, left, right) of a coarse tree; negative children are regions, -1 - region."""

    cuts: dict[int, list[tuple[int, float, int, int]]]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        cuts = self.cuts.get(vectors.shape[1])
        if not cuts:
            return np.zeros(len(vectors), np.int32)
        axis, value, left, right = (np.array(c) for c in zip(*cuts, strict=True))
        at = np.zeros(len(vectors), np.int64)
        while (going := np.flatnonzero(at >= 0)).size:
            node = at[going]
            at[going] = np.where(vectors[going, axis[node]] < value[node], left[node], right[node])
        return (-1 - at).astype(np.int32)


def fit_regions(rows: DataFrame, shards: int, sample: int = SAMPLE, most: int = REGIONS) -> Regions:
    """Median splits of the ``sample`` rows with the smallest hashes, into as many regions as shards, ``most`` at most."""
    table = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("v").toArrow()  # bounded by ``sample``
    by_dim: dict[int, list] = {}
    for v in table["v"].to_pylist():
        by_dim.setdefault(len(v), []).append(v)
    cuts = {}
    for dim, vectors in by_dim.items():
        x, made, regions = np.array(vectors), [], 1
        parts = [(np.arange(len(x)), None)]
        while parts and regions < min(shards, most):
            own, place = parts.pop(0)
            spread = np.ptp(x[own], axis=0)
            axis = int(spread.argmax())
            value = float(np.median(x[own][:, axis]))
            low = x[own][:, axis] < value
            if not low.any():  # the least value is the median: cut above it
                above = x[own][:, axis][x[own][:, axis] > value]
                if not len(above):
                    continue
                value = float(above.min())
                low = x[own][:, axis] < value
            made.append([axis, value, -1, -1])
            if place:
                made[place[0]][place[1]] = len(made) - 1
            parts += [(own[low], (len(made) - 1, 2)), (own[~low], (len(made) - 1, 3))]
            regions += 1
        free = iter(range(regions))
        cuts[dim] = [(a, v, *(c if c >= 0 else -1 - next(free) for c in ends)) for a, v, *ends in made]
    return Regions(cuts)


def placed(rows: DataFrame, regions: Regions) -> DataFrame:
    """``rows`` with dim and region."""
    shared = rows.sparkSession.sparkContext.broadcast(regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            region = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                region[at] = shared.value.of(matrix(batch.column(2).take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(region)], ["row", "vec_id", "v", "dim", "region"])

    return rows.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<double>, dim int, region int")


def build(candidates: DataFrame, sizes: DataFrame, leaf: int = 64) -> DataFrame:
    """One tree per shard and vector length, as rows of TREE. sizes: dim, region and shards, how many the region is dealt to by hash."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        tree = Tree(rows["vec_id"].to_numpy(), rows["row"].to_numpy(), matrix(rows["v"]), leaf)
        out = {"region": key[0].as_py(), "shard": key[1].as_py(), "dim": key[2].as_py()} | tree.fields()
        return pa.Table.from_pylist([out], pa.schema([("region", pa.int32()), ("shard", pa.int64()), ("dim", pa.int32()), *((n, pa.binary()) for n in Tree.FIELDS)]))

    dealt = candidates.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    return dealt.groupBy("region", "shard", "dim").applyInArrow(one, TREE)


def boxes(trees: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: regions, with the low and high corner of the box around all their trees."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                low, high = (np.frombuffer(r[k], np.float64)[: r["dim"]] for k in ("low", "high"))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]] * r["dim"], pa.int32()), "region": pa.array([r["region"]] * r["dim"], pa.int32()), "axis": pa.array(range(r["dim"]), pa.int32()), "low": low, "high": high})

    ends = trees.select("dim", "region", "low", "high").mapInArrow(corners, "dim int, region int, axis int, low double, high double")
    rows = ends.groupBy("dim", "region", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow().to_pandas()  # bounded by REGIONS
    out = {}
    for dim, part in rows.sort_values(["dim", "region", "axis"]).groupby("dim"):
        out[int(dim)] = (part["region"].to_numpy()[::dim], *(part[c].to_numpy().reshape(-1, dim) for c in ("low", "high")))
    return out


def reachable(queries: DataFrame, box: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """Pairs of queries and regions (the queries' columns and to_region).

    first: the region whose box promises most; otherwise all whose box can reach the query's kth score.
    """
    shared, names = queries.sparkSession.sparkContext.broadcast(box), ["query_row", "query_id", "v", "dim", "kth_score", "kth_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                region, low, high = shared.value[int(d)]
                limit = upper_bounds(matrix(own.column(2)), low, high)
                if first:
                    at, to = np.arange(own.num_rows), limit.argmax(axis=1)
                else:
                    least = np.array([_LEAST if s is None else s for s in own.column(4).to_pylist()], object if limit.dtype == object else limit.dtype)
                    at, to = np.nonzero(limit >= least[:, None])
                for a in range(0, len(at), 4096):
                    part = own.take(pa.array(at[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region[to[a : a + 4096]], pa.int32())], [*names, "to_region"])

    return queries.select(*names).mapInArrow(run, "query_row long, query_id long, v array<double>, dim int, kth_score long, kth_id long, to_region int")


def visit(queries: DataFrame, trees: DataFrame, k: int, blocks: int) -> DataFrame:
    """Search each query (query_row, query_id, v, dim, kth_score, kth_id) in the tree of its region and shard.

    blocks: hash shares of the queries. A group is one tree and one share of its queries; a tree is
    repeated for the shares that have queries for it.
    """

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for tree in map(Tree.load, right.to_pylist()):
            for at in range(0, left.num_rows, 1024):
                block = left.slice(at, 1024)
                least = [None if s is None else (s, i) for s, i in zip(block["kth_score"].to_pylist(), block["kth_id"].to_pylist(), strict=True)]
                rows = list(tree.search(block["query_row"].to_numpy(), matrix(block["v"]), k, least))
                if rows:
                    place, ids, scores = zip(*rows, strict=True)
                    mine = block.select(["query_row", "query_id"]).take(pa.array(place))
                    parts.append(pa.table([*mine.columns, pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_row", "query_id", "vec_id", "score"]))
        none = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")])
        return pa.concat_tables(parts) if parts else none.empty_table()

    by = ["region", "shard", "dim", "block"]
    left = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("query_row")), F.lit(blocks).cast("long")))
    asked = left.select(*(F.col(c).alias(f"__{c}") for c in by)).distinct()
    right = trees.join(asked, [F.col(c) == F.col(f"__{c}") for c in by[:3]]).withColumnRenamed("__block", "block").select(*trees.columns, "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(one, HITS)


def best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by integer inner product, ties to the smaller id.

    is_query: SQL condition on vec_id. Every row that fits it is a query of its own, and every other
    row is a candidate, rows that repeat an id among them; a query has hits among vectors of its own
    length only. Sums are exact; scores beyond a long count as its nearest value. shard_rows: rows of
    a shard on average; the number of shards follows the input. block_rows: queries on average that
    meet a shard's tree in one task. Invalid rows take no part (see ``quantise``); fewer candidates
    give fewer hits; an empty table gives none; other columns are not read.
    """
    rows = cut(quantise(vectors, vec_id, embedding))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = cut(placed(rows, fit_regions(rows, shards)))
    sizes = rows.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("shards"))  # bounded by REGIONS
    trees = cut(build(rows, sizes))
    box = boxes(trees)
    none = F.lit(None).cast("long")
    queries = rows.filter(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", "dim", none.alias("kth_score"), none.alias("kth_id"))
    blocks = max(1, -(-queries.count() // block_rows))
    own = F.pmod(F.xxhash64(F.lit("home"), F.col("query_row")), F.col("shards"))
    here = lambda pairs: pairs.withColumnRenamed("to_region", "region").join(F.broadcast(sizes), ["dim", "region"])
    homes = cut(here(reachable(queries, box, first=True)).withColumn("shard", own).drop("shards"))
    first = cut(best(visit(homes, trees, k, blocks), k))
    if shards > 1:
        kth = first.filter(F.col("rank") == k).select("query_row", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
        home = homes.select("query_row", F.col("region").alias("home"), F.col("shard").alias("home_shard"))
        known = queries.drop("kth_score", "kth_id").join(kth, "query_row", "left")
        rest = here(reachable(known, box, first=False)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
        rest = rest.join(home, "query_row").filter((F.col("region") != F.col("home")) | (F.col("shard") != F.col("home_shard"))).drop("home", "home_shard")
        first = best(first.drop("rank").unionByName(visit(rest, trees, k, blocks)), k)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
