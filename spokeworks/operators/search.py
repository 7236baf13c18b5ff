"""Route searches over many requests at once: walks, shortest paths, strategies, and whole requests.

Edges hold gap candidates up to the widest tolerance; a request uses those of its own. Searches work
on starts (request_id, node, cand_ord, max_gap_m, min_distance_m, max_distance_m and, one-way,
end_node) and give steps (request_id, cand_ord, attempt, seg_idx, src, dst, edge_id, distance_m, is_gap).

Each search is a table of states that lie at a node. The graph is cut into the leaves of a quadtree of
at most HOPS_OF_BLOCK hops each; a state meets the hops in and around its block in one task and goes on there until
it leaves them; then it is shuffled to the block that it has come to. It has crossed a margin by then, so ways
to and fro over a border stay in one task, and rounds follow lengths, not crossings. Graphs of at most
MOST_HOPS hops are one block, which is broadcast.

Gaps of a wide tolerance are hundreds a node. They aren't rows: a block holds the nodes in and around it,
and a node's gaps are found among these when a search meets it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut, new_path
from . import network
from .requests import nearest_node, request_mode, start_candidates

ATTEMPTS = 80
WIDE_GAP_M = 1000.0
ENOUGH_ROUTES = 3
#: Hops of a graph that is broadcast at most (about 60 MB).
MOST_HOPS = 500_000
#: Cells of network.REACH_CELL that the box around one search may span; for larger ones all of the graph is widened.
MOST_CELLS = 10_000
#: Hops of a block at most, but for a single node with more of them (about 60 bytes a hop in a Python worker).
HOPS_OF_BLOCK = 100_000
#: A block holds the hops of a margin around it, its side divided by this wide, unless they are over so many times HOPS_OF_BLOCK then.
MARGIN, MOST_WITH_MARGIN = 4, 3
#: Sides of blocks are two to these powers of the node ids' cells: from about a metre to 18 km.
LEVELS = range(0, 15, 2)
#: Blocks of a graph that are broadcast at most, 8 bytes each.
MOST_BLOCKS = 200_000
#: Nodes whose hops a worker holds as tuples at once.
MOST_NEAR = 50_000
#: Hops that a worker holds as tuples at once, but for those of the node that was met last (about 300 bytes each).
MOST_HELD = 500_000
#: States of a block that one task moves, on average; each task gets a copy of the block's hops.
STATES = 50_000
#: States that a search for shortest ways stands for when it begins, so that some 100 begin in a task, whose ways it holds at once.
STATES_OF_SEARCH = 500
#: Shortest paths are looked for within these parts of the longest way, one after another, until all starts are reached.
PARTS = (8, 2, 1)
HOP = ["src", "dst", "edge_id", "distance_m", "is_gap", "dlon", "dlat"]
PATH = "array<struct<src: bigint, dst: bigint, edge_id: string, distance_m: double, is_gap: boolean>>"
WALKER = ["request_id", "cand_ord", "attempt"]
ROUTE = WALKER

Strategy = Callable[[DataFrame, DataFrame], DataFrame]


def block_of(node: Column, level: int) -> Column:
    """The square of a level that holds a node, whose id holds its cell."""
    return (F.shiftright(node, 25 + level) * (1 << 25) + F.shiftright(node.bitwiseAND((1 << 25) - 1), level)) * 32 + level


def in_block(node: int, block: int, wide: bool = False) -> bool:
    """Whether ``block_of`` of the block's level gives the block; wide: or the node lies in its margin."""
    return inside_of(block, wide)(node)


def inside_of(block: int, wide: bool) -> Callable[[int], bool]:
    level, low = block & 31, (1 << 25) - 1
    margin = margin_of(level, wide)
    side, west, south = (1 << level) + 2 * margin, (block >> 30 << level) - margin, ((block >> 5 & low) << level) - margin
    return lambda node: 0 <= (node >> 25) - west < side and 0 <= (node & low) - south < side


def margin_of(level: int, wide: bool) -> int:
    """The margin of a block in cells."""
    return (1 << level) // MARGIN if wide else 0


def squares_near(x: tuple[Column, Column], y: tuple[Column, Column], level: int, wide: bool) -> Column:
    """The squares of a level (block, wide) that the cells from x[0] to x[1] and from y[0] to y[1] touch, the squares' margins included if wide."""
    margin = margin_of(level, wide)
    span = lambda at: F.sequence(*(F.shiftright(c, level) for c in (at[0] - margin, at[1] + margin)))
    square = lambda i, j: F.struct(((i * (1 << 25) + j) * 32 + level).alias("block"), F.lit(wide).alias("wide"))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: square(i, j))))


def cells_at(node: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    x, y = F.shiftright(node, 25), node.bitwiseAND((1 << 25) - 1)
    return (x, x), (y, y)


class Hops:
    """The hops of a block as columns in the order of their first nodes; a node's hops become tuples when it is met.

    Rows without dst are points (see ``as_hops``), between which there are gaps of up to ``gap_m`` as
    ``network.gap_candidates`` and ``exclude_connected`` give them. They lie in cells of the size of the degree
    box, by row, so that a node's gaps lie in three runs of points.
    """

    def __init__(self, table: pa.Table, gap_m: float = 0.0):
        self.gap_m, self.held = gap_m, 0
        if gap_m > 0:
            points = table.filter(pc.is_null(table["dst"]))
            table = table.filter(pc.is_valid(table["dst"]))
            node, lon, lat = (points[c].to_numpy() for c in ("src", "dlon", "dlat"))
            cells = self.cell(lon, lat, 0)
            order = np.argsort(cells, kind="stable")
            self.points, self.cells, self.lon, self.lat = node[order], cells[order], lon[order], lat[order]
            own = points["is_gap"].to_numpy(zero_copy_only=False).astype(bool)[order]
            self.sources = {n: k for n, k in zip(self.points[own].tolist(), np.flatnonzero(own).tolist(), strict=True)}
        src = table["src"].to_numpy()
        order = np.argsort(src, kind="stable")
        self.nodes, first = np.unique(src[order], return_index=True)
        self.ends = np.append(first, len(src))
        self.columns = [table[c].combine_chunks().take(pa.array(order)) for c in HOP[1:]]
        self.near: dict[int, tuple[list[tuple], list[tuple]]] = {}
        self.fits: dict[tuple[int, float], tuple[list[tuple], list[tuple]]] = {}

    def fit(self, node: int, gap: float) -> tuple[list[tuple], list[tuple]] | tuple[()]:
        """As ``get``, of the hops that are usable with a tolerance."""
        if (known := self.fits.get((node, gap))) is not None:
            return known
        near = self.get(node)
        out = tuple([h for h in hops if usable(h, gap)] for hops in near)
        if len(self.fits) >= MOST_NEAR:
            self.fits.clear()
        self.fits[node, gap] = out
        return out

    def cell(self, lon: np.ndarray | float, lat: np.ndarray | float, row: int) -> np.ndarray:
        """The number of the cell that lies ``row`` rows above that of a place; cells of one row follow each other."""
        reach = self.gap_m / 111_000.0 * 1.5
        return (np.floor(lat / reach).astype(np.int64) + row) * (1 << 32) + np.floor(lon / (2 * reach)).astype(np.int64)

    def gaps(self, node: int, joined: set[int]) -> list[tuple]:
        """The gaps from a node to others than those that lane edges join it with."""
        k = self.sources.get(node)
        if k is None:
            return []
        lon, lat = self.lon[k], self.lat[k]
        middle = [int(self.cell(lon, lat, row)) for row in (-1, 0, 1)]
        runs = [slice(*np.searchsorted(self.cells, [cell - 1, cell + 2])) for cell in middle]
        dst, dlon, dlat = (np.concatenate([x[run] for run in runs]) for x in (self.points, self.lon, self.lat))
        mean = np.radians((lat + dlat) / 2)
        dlon, dlat = dlon - lon, dlat - lat
        reach = self.gap_m / 111_000.0 * 1.5
        near = np.flatnonzero((np.abs(dlat) <= reach) & (np.abs(dlon) <= reach * 2) & (dst != node))
        dst, dlon, dlat = dst[near], dlon[near], dlat[near]
        wide = np.radians(dlon) * np.array([math.cos(x) for x in mean[near].tolist()])
        high = np.radians(dlat)
        metres = geo.FLAT_RADIUS_M * np.sqrt(high * high + wide * wide)
        close = np.flatnonzero(metres <= self.gap_m)
        rows = zip(*(x[close].tolist() for x in (dst, metres, dlon, dlat)), strict=True)
        return [(to, f"{min(node, to)}-{max(node, to)}", m, True, x, y) for to, m, x, y in rows if to not in joined]

    def get(self, node: int) -> tuple[list[tuple], list[tuple]] | tuple[()]:
        """Neighbours of a node: lanes and gaps, each as (dst, edge_id, distance_m, is_gap, dlon, dlat)."""
        if (known := self.near.get(node)) is not None:
            return known
        k = int(np.searchsorted(self.nodes, node))
        out: tuple[list[tuple], list[tuple]] = ([], [])
        if k < len(self.nodes) and self.nodes[k] == node:
            at, n = int(self.ends[k]), int(self.ends[k + 1] - self.ends[k])
            for hop in zip(*(c.slice(at, n).to_pylist() for c in self.columns), strict=True):
                out[bool(hop[3])].append(hop)
        elif not self.gap_m:
            return ()
        if self.gap_m:
            out[1].extend(self.gaps(node, {h[0] for h in out[0]}))
        if len(self.near) >= MOST_NEAR or self.held >= MOST_HELD:
            self.near.clear()
            self.fits.clear()
            self.held = 0
        self.near[node] = out
        self.held += len(out[0]) + len(out[1])
        return out


def usable(hop: tuple, gap: float) -> bool:
    """As ``network.usable``."""
    reach = gap / 111_000.0 * 1.5
    return not hop[3] or hop[2] <= gap and abs(hop[5]) <= reach and abs(hop[4]) <= reach * 2


@lru_cache(maxsize=1)
def _kept() -> dict[str, Hops]:
    return {}


def whole_hops(name: str, table: pa.Table, gap_m: float) -> Hops:
    """The hops of a broadcast graph, which the tasks of one worker share."""
    kept = _kept()
    if name not in kept:
        kept.clear()
        kept[name] = Hops(table, gap_m)
    return kept[name]


def as_hops(points: DataFrame) -> DataFrame:
    """Points (node, lon, lat, inside) as rows of HOP without dst; is_gap tells whether gaps are looked for from a point, dlon and dlat are its place."""
    none = lambda kind: F.lit(None).cast(kind)
    return points.select(F.col("node").alias("src"), none("long").alias("dst"), none("string").alias("edge_id"), none("double").alias("distance_m"), F.col("inside").alias("is_gap"), F.col("lon").alias("dlon"), F.col("lat").alias("dlat"))


class Blocks:
    """A graph's hops, broadcast as one block where they are few, or by block.

    Blocks are the coarsest squares of at most HOPS_OF_BLOCK hops, so dense and thin parts of a graph make
    tasks of like size. Hops are counted by square and placed once; nodes are placed by joins with the
    squares, broadcast up to MOST_BLOCKS, beyond which each node's block is looked up by its id.

    Hops are copied to the blocks in whose margin they begin, see MARGIN.

    points: nodes (node, lon, lat, inside) between which there are gaps of up to gap_m besides, from those
    inside. They count as hops; each is copied to the blocks that its degree box touches, or whose margin it touches.
    """

    def __init__(self, adj: DataFrame, points: DataFrame | None = None, gap_m: float = 0.0):
        self.name, self.gap_m = uuid4().hex, gap_m if points is not None else 0.0
        hops = adj.select(*HOP)
        spots = as_hops(points) if self.gap_m > 0 else None
        rows = hops if spots is None else hops.unionByName(spots)
        few = rows.count() <= MOST_HOPS
        self.whole = adj.sparkSession.sparkContext.broadcast(rows.toArrow()) if few else None
        if few:
            return
        counted = cut(rows.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")))
        leaves = cut(quadtree(counted, levels_for(self.gap_m)))
        self.few_blocks = leaves.count() <= MOST_BLOCKS
        self.blocks = leaves
        self.levels = sorted(r[0] for r in leaves.select(F.col("block").bitwiseAND(31)).distinct().collect())
        if not self.few_blocks:
            self.blocks = cut(counted.select("node", F.explode(F.array(*(block_of(F.col("node"), k) for k in self.levels))).alias("block")).join(leaves, "block"))
        # all blocks with their margins, to count the hops; then those whose margin isn't too full
        self.kinds = [(k, True) for k in self.levels]
        self.leaves = leaves.withColumn("wide", F.lit(True))
        held = self.around(counted, *cells_at(F.col("node"))).groupBy("__block").agg(F.sum("n").alias("n"))
        self.leaves = cut(held.select(F.col("__block").alias("block"), (F.col("n") <= MOST_WITH_MARGIN * HOPS_OF_BLOCK).alias("wide")))
        self.kinds = sorted(map(tuple, self.leaves.select(F.col("block").bitwiseAND(31), "wide").distinct().collect()))
        near = self.around(hops, *cells_at(F.col("src")))
        if spots is not None:
            high = geo.near_degrees(F.lit(self.gap_m))
            span = lambda c, reach, zero: tuple(geo.cell(F.col(c) + x) + zero for x in (-reach, reach))
            near = near.unionByName(self.around(spots, span("dlon", high * 2, 18_000_000), span("dlat", high, 9_000_000)))
        self.hops = cut(near)

    def around(self, rows: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
        """``rows`` with __block and __wide, a row for each block that the cells from x[0] to x[1] and y[0] to y[1] touch, with its margin if it has one."""
        near = F.explode(F.concat(*(squares_near(x, y, k, wide) for k, wide in self.kinds))).alias("__near")
        spread = rows.select("*", near).select(*rows.columns, F.col("__near.block").alias("__block"), F.col("__near.wide").alias("__wide"))
        leaves = self.leaves.select(F.col("block").alias("__block"), F.col("wide").alias("__wide"))
        return spread.join(F.broadcast(leaves) if self.few_blocks else leaves, ["__block", "__wide"]).select(*spread.columns)

    def placed(self, rows: DataFrame, at: str) -> DataFrame:
        """``rows`` with __block, the block of the node in column ``at``; a node without hops is a block of its own."""
        alone = block_of(F.col(at), 0)
        if not self.few_blocks:
            home = self.blocks.select(F.col("node").alias("__node"), F.col("block").alias("__home"))
            return rows.join(home, F.col(at) == F.col("__node"), "left").withColumn("__block", F.coalesce("__home", alone)).drop("__node", "__home")
        own = []
        for k in self.levels:
            own.append(f"__at{k}")
            squares = self.blocks.filter(F.col("block").bitwiseAND(31) == k).select(F.col("block").alias(own[-1]))
            rows = rows.join(F.broadcast(squares), block_of(F.col(at), k) == F.col(own[-1]), "left")
        return rows.withColumn("__block", F.coalesce(*own, alone)).drop(*own)

    def apply(self, states: DataFrame, work: Callable[[list[dict], Hops, Callable[[int], bool]], Iterator[pa.RecordBatch]], schema: str, key: list[str], at: str = "cur", weight: Column | None = None) -> DataFrame:
        """The batches that ``work`` gives for the states at the nodes of one block, its hops, and the test for its nodes.

        states: with __block where that isn't the one that holds their node. work's test is true for the block's margin, too.
        key: columns that tell states apart; those of a crowded block are dealt to several tasks by them.
        weight: how many states a row stands for.
        """
        kind = _arrow(states.sparkSession, schema)
        if self.whole is not None:
            shared, name, gap_m = self.whole, self.name, self.gap_m

            def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                hops = None
                for batch in batches:
                    hops = whole_hops(name, shared.value, gap_m) if hops is None else hops
                    yield from work(batch.to_pylist(), hops, lambda node: True)

            # a number that is named isn't lowered for rows that are few and small, as these are before the search
            return states.repartition(4 * states.sparkSession.sparkContext.defaultParallelism, *key).mapInArrow(move, schema)

        gap_m = self.gap_m

        def meet(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.drop_columns(["__block", "__share"]).to_pylist()
            inside = inside_of(left["__block"][0].as_py(), bool(right.num_rows) and right["__wide"][0].as_py()) if rows else None
            return pa.Table.from_batches(work(rows, Hops(right, gap_m), inside), kind)

        # a block that few states lie in is met in one task, a crowded one in as many as its states need
        placed = states if "__block" in states.columns else self.placed(states, at)
        crowds = placed.groupBy("__block").agg(F.ceil(F.sum(F.lit(1) if weight is None else weight) / STATES).cast("long").alias("__tasks"))
        left = placed.join(crowds, "__block").withColumn("__share", F.pmod(F.xxhash64(*key), F.col("__tasks"))).drop("__tasks")
        tasks = left.select(F.col("__block").alias("__b"), F.col("__share").alias("__s")).distinct()
        right = self.hops.join(tasks, F.col("__block") == F.col("__b")).drop("__b").withColumnRenamed("__s", "__share")
        by = ["__block", "__share"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def levels_for(gap_m: float) -> range:
    """LEVELS, without those of squares so small that the box of a gap touches tens of them."""
    reach = gap_m / 111_000.0 * 1.5 * geo.CELL
    return range(next((k for k in LEVELS if 2 << k >= reach), LEVELS[-1]), LEVELS.stop, LEVELS.step)


def quadtree(counted: DataFrame, levels: range = LEVELS) -> DataFrame:
    """block: the coarsest squares of at most HOPS_OF_BLOCK hops that hold all nodes (node, n hops); a square of the lowest level, by default a node, may have more.

    The squares of all levels are counted at once; a square is a leaf if it is small enough and the one around it isn't.
    """
    node, top = F.col("node"), levels[-1]
    around = lambda k: block_of(node, k + levels.step) if k < top else F.lit(None).cast("long")
    squares = F.explode(F.array(*(F.struct(block_of(node, k).alias("block"), around(k).alias("outer")) for k in levels))).alias("s")
    sized = cut(counted.select(squares, "n").groupBy("s.block", "s.outer").agg(F.sum("n").alias("n")))
    large = sized.filter(F.col("n") > HOPS_OF_BLOCK).select(F.col("block").alias("outer"), F.lit(True).alias("split"))
    small = (F.col("n") <= HOPS_OF_BLOCK) | (F.col("block").bitwiseAND(31) == levels[0])
    return sized.join(large, "outer", "left").filter(small & (F.col("outer").isNull() | F.col("split"))).select("block")


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batches(rows: Iterator[dict], kind: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, kind)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def walkers(starts: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """The states of ``attempts`` walks from each start."""
    empty = F.array().cast(PATH)
    return starts.select("request_id", "cand_ord", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"), F.col("node").alias("start"), F.col("node").alias("cur"), "max_gap_m", "min_distance_m", "max_distance_m", F.lit(0.0).alias("total"), empty.alias("path"), F.lit(False).alias("done"))


def free_hops(near: list[tuple], met: set, loop: bool) -> list[tuple]:
    """Of hops that a walker can use those that it may take: to nodes that it hasn't met, or for loops by edges that it hasn't used."""
    used = 1 if loop else 0
    return [h for h in near if h[used] not in met]


def met_by(walker: dict, loop: bool) -> set:
    return {s["edge_id"] for s in walker["path"]} if loop else {walker["start"], *(s["dst"] for s in walker["path"])}


def walk(walker: dict, hops: Hops, inside: Callable[[int], bool], loop: bool, seed: int) -> dict | None:
    """The walker when it is done or has left the block; none if it is lost.

    Lane edges go before gaps; among equals the one with the smallest md5 of seed, step, walker and node.
    """
    met, path, who = met_by(walker, loop), walker["path"], "|".join(str(walker[c]) for c in WALKER)
    while True:
        if not loop and walker["total"] >= walker["max_distance_m"]:
            return None
        if not inside(walker["cur"]):
            return walker
        for near in hops.fit(walker["cur"], walker["max_gap_m"]):
            if free := free_hops(near, met, loop):
                break
        else:
            return None
        draw = f"{seed}|{len(path)}|{who}|"
        dst, edge, length, gap, *_ = min(free, key=lambda h: md5((draw + str(h[0])).encode()).digest()) if len(free) > 1 else free[0]
        path.append({"src": walker["cur"], "dst": dst, "edge_id": edge, "distance_m": length, "is_gap": gap})
        met.add(edge if loop else dst)
        walker["cur"], walker["total"] = dst, walker["total"] + length
        long_enough = walker["total"] >= walker["min_distance_m"]
        if not loop:
            walker["done"] = long_enough
        elif walker["total"] > walker["max_distance_m"] or dst == walker["start"] and not long_enough:
            return None
        else:
            walker["done"] = dst == walker["start"]
        if walker["done"]:
            return walker


def walks(adj: DataFrame | Blocks, starts: DataFrame, loop: bool, attempts: int = ATTEMPTS, seed: int = 1, repeats: bool = True) -> DataFrame:
    """Steps of random walks from each start, ``attempts`` each.

    Without ``loop`` a walk never meets a node twice and ends when it is min_distance_m long. With it,
    no edge is used twice; it ends on return to the start, which must not come before min_distance_m,
    and dies on a step beyond max_distance_m. Choices are uniform by hash and the same in each run.
    The search goes on until no walker is left: as nodes or edges are used up, every walk ends. A round
    moves the walkers until they leave their block. The walks of a start begin in one task as one row.

    repeats: without them, walks that a task finds to repeat the route of an earlier attempt are left out,
    as ``distinct_routes`` would do; others that repeat one may remain.
    """
    blocks = blocks_of(adj)
    state = cut(walkers(starts, 1).withColumn("attempt", F.lit(0)))  # 0: all of them
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    kind = _arrow(state.sparkSession, schema)
    out = None

    def each(rows: list[dict]) -> Iterator[dict]:
        for row in rows:
            if row["attempt"]:
                yield row
            else:
                yield from (row | {"attempt": k, "path": []} for k in range(1, attempts + 1))

    def moved_on(rows: list[dict], hops: Hops, inside: Callable[[int], bool]) -> Iterator[dict]:
        seen: set[tuple] = set()
        for row in each(rows):
            if (w := walk(row, hops, inside, loop, seed)) is None:
                continue
            if w["done"] and not repeats:
                route = (w["request_id"], w["cand_ord"], *(s["src"] for s in w["path"]))
                if route in seen:
                    continue
                if len(seen) >= MOST_NEAR:
                    seen.clear()
                seen.add(route)
            yield w

    def work(rows: list[dict], hops: Hops, inside: Callable[[int], bool]) -> Iterator[pa.RecordBatch]:
        return _batches(moved_on(sorted(rows, key=lambda row: row["attempt"]), hops, inside), kind)

    while True:
        weight = F.when(F.col("attempt") == 0, attempts).otherwise(1)
        moved = cut(blocks.apply(state, work, schema, WALKER, weight=weight))
        done = steps_of(moved.filter("done"))
        out = done if out is None else out.unionByName(done)
        state = moved.filter("not done")
        if blocks.whole is not None or state.isEmpty():
            return out


def blocks_of(adj: DataFrame | Blocks) -> Blocks:
    return adj if isinstance(adj, Blocks) else Blocks(adj)


def unvisited(adj: DataFrame, state: DataFrame, loop: bool = False) -> DataFrame:
    """The hops (WALKER, dst, edge_id) that each walker (as ``walkers`` gives them, with a path) may take from its node."""

    schema = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in WALKER) + ", dst bigint, edge_id string"
    kind = _arrow(adj.sparkSession, schema)

    def taken(rows: list[dict], hops: Hops) -> Iterator[dict]:
        for w in rows:
            met = met_by(w, loop)
            for near in hops.fit(w["cur"], w["max_gap_m"]):
                yield from ({c: w[c] for c in WALKER} | {"dst": h[0], "edge_id": h[1]} for h in free_hops(near, met, loop))

    def work(rows: list[dict], hops: Hops, inside: Callable[[int], bool]) -> Iterator[pa.RecordBatch]:
        return _batches(taken(rows, hops), kind)

    return Blocks(adj).apply(state, work, schema, WALKER)


def steps_of(paths: DataFrame) -> DataFrame:
    return paths.select(*ROUTE, F.posexplode("path").alias("seg_idx", "s")).select(*ROUTE, "seg_idx", "s.*")


SEARCH = ["end_node", "max_gap_m", "most"]
TREE = "end_node bigint, max_gap_m double, most double, node bigint, dist double, hops int, next bigint, edge_id string, distance_m double, is_gap boolean"


def rank(way: tuple) -> tuple:
    """Ways (dist, hops, next, edge of the hop to next) are compared by length, then hops, then next node."""
    return way[0], way[1], -1 if way[2] is None else way[2]


def settle(best: dict[int, tuple], news: list[tuple[int, tuple]], hops: Hops, inside: Callable[[int], bool], gap: float, most: float) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """Shortest ways of one search within a block, from known ones and new ones: (ways that got better, ways to nodes outside)."""
    better: dict[int, tuple] = {}
    beyond: dict[int, tuple] = {}
    heap = [(*rank(way), node, way) for node, way in news]
    heapq.heapify(heap)
    found = {node: rank(way) for node, way in best.items()}  # the best rank so far, settled or in the heap
    for node, way in news:
        if node not in found or rank(way) < found[node]:
            found[node] = rank(way)
    none = (float("inf"),)
    while heap:
        dist, n, following, node, way = heapq.heappop(heap)
        if node in better or (dist, n, following) > found[node]:
            continue
        known = best.get(node)
        if known is not None and rank(known) <= (dist, n, following):
            continue
        better[node] = way
        if known and known[:2] == way[:2]:
            continue  # a tie changes the next node only
        for near in hops.fit(node, gap):
            for h in near:
                far, to = dist + h[2], h[0]
                if far > most:
                    continue
                new = (far, n + 1, node)
                if new >= found.get(to, none):
                    continue
                found[to] = new
                if inside(to):
                    heapq.heappush(heap, (*new, to, (*new, h[1:4])))
                else:
                    beyond[to] = (*new, h[1:4])
    return better, beyond


def shortest_trees(adj: DataFrame | Blocks, ends: DataFrame) -> DataFrame:
    """Shortest ways from every node to each end (end_node, max_gap_m, max_distance_m): TREE without most, with the hop to next.

    The graph is undirected, so one search per distinct end serves all starts. A round settles each
    search in the blocks that it has reached and hands the ways that leave them to their neighbours;
    known ways are read again only for blocks that are reached anew, from one table that each round adds
    to, so that plans are as large in the last round as in the second. A search that never leaves its
    first block is whole and isn't met again. Ties take fewer hops, then the smaller next node.
    """
    blocks = blocks_of(adj)
    spark = ends.sparkSession
    bounds = ends.groupBy("end_node", "max_gap_m").agg(F.max("max_distance_m").alias("most"))
    news = bounds.select(*SEARCH, F.col("end_node").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("double").alias("distance_m"), F.lit(None).cast("boolean").alias("is_gap"), F.lit("new").alias("state"))
    schema = TREE + ", state string"
    kind = _arrow(spark, schema)

    def work(rows: list[dict], hops: Hops, inside: Callable[[int], bool]) -> Iterator[pa.RecordBatch]:
        searches: dict[tuple, tuple[dict, list]] = {}
        for r in rows:
            best, fresh = searches.setdefault(tuple(r[c] for c in SEARCH), ({}, []))
            way = (r["dist"], r["hops"], r["next"], (r["edge_id"], r["distance_m"], r["is_gap"]))
            if r["state"] == "new":
                fresh.append((r["node"], way))
            elif r["node"] not in best or rank(way) < rank(best[r["node"]]):
                best[r["node"]] = way
        for key, (best, fresh) in searches.items():
            better, beyond = settle(best, fresh, hops, inside, key[1], key[2])
            first = len(fresh) == 1 and fresh[0][1][2] is None  # the end itself, so nothing was known
            for state, ways in (("whole" if first and not beyond else "known", better), ("new", beyond)):
                if ways:
                    dist, n, following, edge = zip(*ways.values(), strict=True)
                    columns = [*([k] * len(ways) for k in key), list(ways), dist, n, following, *zip(*edge, strict=True), [state] * len(ways)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], schema=kind)

    begun = F.when(F.col("next").isNull(), STATES_OF_SEARCH).otherwise(1)
    if blocks.whole is not None:
        return cut(blocks.apply(news, work, schema, SEARCH, at="node", weight=begun)).drop("most", "state")
    folder, rounds = new_path(spark, "trees"), 0
    table = lambda part, state: spark.read.schema(schema).parquet(f"{folder}/{part}").filter(F.col("state") == state)
    rows = blocks.placed(news, "node")
    while True:
        blocks.apply(rows, work, schema, SEARCH, at="node", weight=begun).write.parquet(f"{folder}/{rounds}")
        news = table(rounds, "new")
        if news.isEmpty():
            break
        rounds += 1
        placed = blocks.placed(news, "node")
        reached = placed.select(*SEARCH, "__block").distinct()
        known = blocks.around(table("*", "known"), *cells_at(F.col("node"))).join(reached, [*SEARCH, "__block"], "left_semi")
        rows = placed.unionByName(known.drop("__wide"))
    whole, parts = table("*", "whole").drop("most", "state"), table("*", "known")
    if not rounds:
        return whole
    rest = ["dist", "hops", "next", "edge_id", "distance_m", "is_gap"]
    least = F.min_by(F.struct(*rest), F.struct("dist", "hops", "next")).alias("b")
    return whole.unionByName(cut(parts.groupBy("end_node", "max_gap_m", "node").agg(least).select("end_node", "max_gap_m", "node", "b.*")))


def shortest_paths(adj: DataFrame | Blocks, starts: DataFrame) -> DataFrame:
    """Steps of the shortest path from each start to its end_node if its length is within the start's bounds; none from the end itself.

    Ends are searched within an eighth of the longest way first, then, for starts that aren't reached, within
    half and all of it: what lies within a bound is settled by a search of that bound, so the trees are
    no larger than the paths ask for. Paths are read off the trees by doubling: after round k a row of
    the table spans up to 2**k hops, so the longest path takes as many rounds as its length has binary digits.
    """
    blocks, by = blocks_of(adj), ["end_node", "max_gap_m"]
    left = cut(starts.filter("end_node is not null and node <> end_node"))
    columns = [*by, "node", "request_id", "cand_ord", "dist", "hops"]
    reached = trees = None
    for part in PARTS:
        bound = F.col("max_distance_m") / part
        found = shortest_trees(blocks, left.select(*by, bound.alias("max_distance_m")))
        met = cut(left.join(found.select(*by, "node", "dist", "hops"), [*by, "node"]))
        own = met.filter("dist between min_distance_m and max_distance_m").select(*columns, F.lit(part).alias("part"))
        tree = found.filter("next is not null").join(own.select(*by).distinct(), by, "left_semi").withColumn("part", F.lit(part))
        reached = own if reached is None else reached.unionByName(own)
        trees = tree if trees is None else trees.unionByName(tree)
        left = cut(left.join(met.select("request_id", "cand_ord"), ["request_id", "cand_ord"], "left_anti"))
        if left.isEmpty():
            break
    by = [*by, "part"]
    trees = cut(trees)
    # the nodes of all wanted paths: each round adds those that lie as many hops on as are known already
    jumps = trees.select(*by, "node", F.col("next").alias("to"))
    own = cut(reached.select(*by, "node", "request_id", "cand_ord", F.lit(0).alias("seg_idx"), "hops"))
    span = 1
    longest = own.agg(F.max("hops")).first()[0] or 0
    while span < longest:
        ahead = own.join(jumps, [*by, "node"]).select(*by, F.col("to").alias("node"), "request_id", "cand_ord", (F.col("seg_idx") + span).alias("seg_idx"), "hops").filter("seg_idx < hops")
        own = cut(own.unionByName(ahead))
        twice = jumps.withColumnRenamed("to", "mid").join(jumps.select(*by, F.col("node").alias("mid"), "to"), [*by, "mid"]).select(*by, "node", "to")
        jumps = cut(twice)
        span *= 2
    hops = trees.select(*by, "node", F.col("next").alias("dst"), "edge_id", "distance_m", "is_gap")
    return own.join(hops, [*by, "node"]).select("request_id", "cand_ord", F.lit(1).alias("attempt"), "seg_idx", F.col("node").alias("src"), "dst", "edge_id", "distance_m", "is_gap")


def with_signature(steps: DataFrame) -> DataFrame:
    """Routes (request_id, cand_ord, attempt) with total_m, n_segments and signature: the segments' first nodes, so not the last node."""
    seg = F.sort_array(F.collect_list(F.struct("seg_idx", "src", "distance_m")))
    rows = steps.groupBy(*ROUTE).agg(seg.alias("segs"))
    total = F.aggregate("segs", F.lit(0.0), lambda s, x: s + x["distance_m"])
    return rows.select(*ROUTE, total.alias("total_m"), F.size("segs").alias("n_segments"), F.array_join(F.transform("segs", lambda x: x["src"].cast("string")), "|").alias("signature"))


def distinct_routes(steps: DataFrame) -> DataFrame:
    """The steps of the first route of each request and signature, by start candidate, then attempt."""
    first = with_signature(steps).groupBy("request_id", "signature").agg(F.min(F.struct("cand_ord", "attempt")).alias("r")).select("request_id", "r.*")
    return steps.join(first, ROUTE, "left_semi")


def explore(adj: DataFrame | Blocks, starts: DataFrame) -> DataFrame:
    return walks(adj, starts, loop=False, repeats=False)


def round_trip(adj: DataFrame | Blocks, starts: DataFrame) -> DataFrame:
    return walks(adj, starts, loop=True, repeats=False)


#: Strategies by request mode; ``register_strategy`` gives a table with more.
STRATEGIES: dict[str, Strategy] = {"explore": explore, "round_trip": round_trip, "one_way": shortest_paths}


def register_strategy(mode: str, strategy: Strategy, strategies: dict[str, Strategy] | None = None) -> dict[str, Strategy]:
    """The strategies (by default STRATEGIES) with ``strategy(adj, starts) -> steps`` for requests of ``mode``."""
    return {**(STRATEGIES if strategies is None else strategies), mode: strategy}


def run_walks(adj: DataFrame, starts: DataFrame, loop: bool = False, attempts: int = ATTEMPTS, seed: int = 1) -> DataFrame:
    """Steps of the distinct routes of all attempts from each start."""
    return distinct_routes(cut(walks(adj, starts, loop, attempts, seed, repeats=False)))


def no_steps(starts: DataFrame) -> DataFrame:
    kinds = {c: starts.schema[c].dataType.simpleString() for c in ("request_id", "cand_ord")} | {"attempt": "int", "seg_idx": "int"}
    empty = starts.limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("double").alias("distance_m"), F.lit(None).cast("boolean").alias("is_gap"))
    return empty


def routes_from_candidates(adj: DataFrame, starts: DataFrame, strategies: dict[str, Strategy] | None = None, make: Callable[[], Blocks] | None = None) -> DataFrame:
    """Steps of the distinct routes of each request by the strategy of its mode, over all its start candidates.

    Requests of a mode without a strategy have no routes; without requests there are no steps. make: gives
    the blocks of the strategies in STRATEGIES, those of ``adj`` by default.
    """
    out, blocks = no_steps(starts), None
    for mode, strategy in (strategies or STRATEGIES).items():
        own = cut(starts.filter(F.col("mode") == mode))
        if own.isEmpty():
            continue
        if strategy in STRATEGIES.values():  # these share the blocks
            blocks = blocks or (make() if make else Blocks(adj))
            out = out.unionByName(strategy(blocks, own))
        else:
            out = out.unionByName(strategy(adj, own))
    return cut(distinct_routes(cut(out)))


def routes_per_request(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """request_id, n_routes, too_few: none at all for one-way, fewer than three otherwise."""
    n = steps.select(*ROUTE).distinct().groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    rows = requests.select("request_id", "mode").join(n, "request_id", "left").withColumn("n_routes", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("request_id", "n_routes", (F.col("n_routes") < F.when(F.col("mode") == "one_way", 1).otherwise(ENOUGH_ROUTES)).alias("too_few"))


def shortest_route(steps: DataFrame, one_way: Column) -> DataFrame:
    """Of one-way requests only the steps of the shortest route, the earlier candidate's on ties; others as they are."""
    routes = with_signature(steps.filter(one_way))
    best = routes.groupBy("request_id").agg(F.min_by(F.struct("cand_ord", "attempt"), F.struct("total_m", "cand_ord", "attempt")).alias("b")).select("request_id", "b.*")
    return steps.filter(~one_way).unionByName(steps.join(best, ROUTE, "left_semi"))


def find_routes(graph: network.Graph, requests: DataFrame, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """Steps of the routes of each request (all preferences filled), with its gap_m and mode.

    graph: with gap candidates up to the widest request. Requests with too few routes and a tolerance
    below 1000 m are searched again at 1000 m, whose routes replace the first ones; gaps of that size are
    looked for only from the nodes that the searches of these requests meet; a strategy that isn't built in gets
    a table of hops around the nodes that the requests can reach, which is made when it is read. mode: a column of the requests, if they
    have it; where it is null or missing it follows from the end and round_trip. Requests of a mode
    without a strategy have no routes, so they aren't searched again.
    """
    nodes = cut(graph.nodes)
    ends = requests.filter("end_lon is not null and end_lat is not null").select("request_id", F.col("end_lon").alias("lon"), F.col("end_lat").alias("lat"))
    snapped = nearest_node(ends, nodes).select("request_id", F.col("node").alias("end_node"))
    usual = request_mode(F.col("end_node"), F.col("round_trip"))
    known = requests.join(snapped, "request_id", "left").withColumn("mode", F.coalesce("mode", usual) if "mode" in requests.columns else usual)
    columns = ["request_id", "mode", "end_node", "max_gap_m", "min_distance_m", "max_distance_m"]
    known = cut(known)
    starts = cut(start_candidates(known, nodes).join(known.select(*columns), "request_id"))
    widest = known.agg(F.max("max_gap_m")).first()[0] or 0.0
    adj = cut(network.neighbors(network.edges_for_gap(graph.edges, F.lit(float(widest)))))
    first = routes_from_candidates(adj, starts, strategies)
    flagged = routes_per_request(known, first).filter("too_few").join(known.filter((F.col("max_gap_m") < WIDE_GAP_M) & F.col("mode").isin(*(strategies or STRATEGIES))).select("request_id"), "request_id", "left_semi").select("request_id")
    flagged = cut(flagged)
    steps = first.join(flagged, "request_id", "left_anti").join(known.select("request_id", F.col("max_gap_m").alias("gap_m")), "request_id")
    if not flagged.isEmpty():
        again = cut(starts.join(flagged, "request_id", "left_semi").withColumn("max_gap_m", F.lit(WIDE_GAP_M)))
        wide, make = widened(network.Graph(nodes, cut(graph.edges.filter(~F.col("is_gap")).select(*network.EDGE))), again)
        steps = steps.unionByName(routes_from_candidates(wide, again, strategies, make).withColumn("gap_m", F.lit(WIDE_GAP_M)))
    moded = steps.join(known.select("request_id", "mode"), "request_id")
    return shortest_route(moded, F.col("mode") == "one_way")


def widened(graph: network.Graph, starts: DataFrame) -> tuple[DataFrame, Callable[[], Blocks]]:
    """The hops, with gaps up to 1000 m, from all nodes that searches from ``starts`` can reach within their bounds, and what makes their blocks.

    A search leaves no node that lies farther off than the longest way allows: one-way searches start at
    their end, strategies that aren't built in may begin at either. If one request's bounds span too
    many cells, or a lane edge has no length, which leaves a way's reach open, the whole graph is widened.
    """
    longest = network.stretch(graph.nodes, graph.edges) * 1.01
    boxes = None
    if longest < float("inf"):
        places = graph.nodes.select("node", "lon", "lat")
        begun = starts.filter("mode <> 'one_way'").select("node", "max_distance_m").unionByName(starts.filter("end_node is not null").select(F.col("end_node").alias("node"), "max_distance_m"))
        points = begun.groupBy("node").agg(F.max("max_distance_m").alias("most")).join(places, "node")
        boxes = cut(network.boxes_within(points, F.col("most") * longest))
        if (boxes.agg(F.max((F.col("e") - F.col("w") + 1) * (F.col("n") - F.col("s") + 1))).first()[0] or 0) > MOST_CELLS:
            boxes = None

    def make() -> Blocks:
        points = cut(network.nodes_around(graph.nodes, boxes, WIDE_GAP_M))
        lanes = network.neighbors(graph.edges).join(points.filter("inside").select(F.col("node").alias("src")), "src", "left_semi")
        return Blocks(lanes, points, WIDE_GAP_M)

    return network.hops_around(graph, boxes, WIDE_GAP_M), make
