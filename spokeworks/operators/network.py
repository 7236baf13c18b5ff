"""Lanes to a network: nodes (node, cx, cy, lon, lat, node_ord) and edges (edge_id, u, v, distance_m, is_gap, dlon, dlat, lane_seq)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.order import running_sum
from ..session import cut
from ..sources.areas import cell_degrees

#: Cells in degrees of the part of a graph that requests can reach.
REACH_CELL = 0.03
#: Nodes of a cell in one task when gaps are looked for, on average.
CELL_NODES = 2000
#: What searches need of an edge.
EDGE = ["edge_id", "u", "v", "distance_m", "is_gap", "dlon", "dlat"]
#: The cells, as steps from a cell, whose nodes meet the cell's.
MEETS = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def lane_ends(lanes: DataFrame) -> DataFrame:
    """Two rows a lane, the start (end_no 0) and the end (1), in the order in which nodes are met: seq."""
    points = F.array(geo.start_of(F.col("geometry")), geo.end_of(F.col("geometry")))
    rows = lanes.select("lane_seq", F.posexplode(points).alias("end_no", "p")).select("lane_seq", "end_no", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    rows = rows.withColumns({"cx": geo.cell(F.col("lon")), "cy": geo.cell(F.col("lat")), "seq": F.col("lane_seq") * 2 + F.col("end_no")})
    return rows.withColumn("node", geo.node_id(F.col("cx"), F.col("cy")))


def build_nodes(lanes: DataFrame) -> DataFrame:
    """Distinct ends by cell: order of the first sighting, coordinates of the last, the largest where several have one seq."""
    last = F.max_by(F.struct("lon", "lat"), F.struct("seq", "lon", "lat")).alias("p")
    rows = lane_ends(lanes).groupBy("node", "cx", "cy").agg(F.min("seq").alias("node_ord"), last)
    return rows.select("node", "cx", "cy", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "node_ord")


def node_places(nodes: DataFrame) -> DataFrame:
    """``nodes`` with place: from 1, in the order in which they are met."""
    return running_sum(nodes, ["node_ord", "node"], F.lit(1), "place")


def edge_id(u: Column, v: Column) -> Column:
    return F.concat_ws("-", F.least(u, v).cast("string"), F.greatest(u, v).cast("string"))


def build_lane_edges(lanes: DataFrame) -> DataFrame:
    """One edge per unordered pair of nodes, the first lane's; lanes whose ends share a node give none.

    Of lanes with one lane_seq, such as those of a way in two areas, the smallest hash of the content
    comes first. A pair's lanes are one group, whose first lane is found in each task before the shuffle, so
    that the geometry of one lane a pair and task is shuffled, and the lanes are made once.
    """
    at = lambda p: geo.node_id(geo.cell(p["lon"]), geo.cell(p["lat"]))
    ends = lanes.select("lane_seq", at(geo.start_of(F.col("geometry"))).alias("u"), at(geo.end_of(F.col("geometry"))).alias("v"), "geometry", "lane_type").filter("u <> v")
    order = F.struct("lane_seq", F.xxhash64("geometry", "lane_type"))
    rows = ends.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min_by(F.struct(*ends.columns), order).alias("e")).select("e.*")
    none = F.lit(0.0)
    return rows.select(edge_id(F.col("u"), F.col("v")).alias("edge_id"), "u", "v", geo.line_length_m(F.col("geometry")).alias("distance_m"), F.lit(False).alias("is_gap"), none.alias("dlon"), none.alias("dlat"), "lane_seq", "geometry", "lane_type")


def gap_candidates(nodes: DataFrame, max_gap_m: float, inside: Column | None = None) -> DataFrame:
    """Unordered pairs of nodes within ``max_gap_m``, u before v in node order, with distance_m, dlon and dlat.

    inside: a condition on nodes; pairs of which it holds for neither are left out.

    A grid join: each cell's nodes meet those of the cell itself and of four of its neighbours, which
    brings every pair together once. Cells that hold or meet over CELL_NODES nodes are dealt to tasks of
    about CELL_NODES by five times as many: their nodes into parts by one hash, those that they meet
    into parts by the same hash, each copied to the other's parts. Nodes of one place in the order, as where
    lane_seq repeats, go by their ids.
    """
    x, y = cell_degrees(max_gap_m) if max_gap_m > 0 else (1.0, 1.0)
    at = lambda c, size: F.floor(F.col(c) / F.lit(size)).cast("long")
    placed = nodes.select(F.struct("node_ord", "node", "lon", "lat", (F.lit(True) if inside is None else inside).alias("inside")).alias("a"), at("lon", x).alias("gx"), at("lat", y).alias("gy"))
    meets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in MEETS))).alias("d")
    spread = lambda rows: rows.select("*", meets).withColumns({"gx": F.col("gx") - F.col("d.i"), "gy": F.col("gy") - F.col("d.j")})
    parts = crowds(placed.select("gx", "gy"), spread)
    part = lambda row, n: F.pmod(F.xxhash64(F.col(f"{row}.node")), F.col(n))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda rows: rows.join(parts, ["gx", "gy"], "left").withColumns({n: F.coalesce(n, F.lit(1).cast("long")) for n in ("own", "met")})
    left = dealt(placed).select("gx", "gy", "a", part("a", "own").alias("__own"), copies("met").alias("__met"))
    right = dealt(spread(placed.withColumnRenamed("a", "b"))).select("gx", "gy", "b", ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("same"), copies("own").alias("__own"), part("b", "met").alias("__met"))
    pairs = left.join(right, ["gx", "gy", "__own", "__met"]).filter((~F.col("same") | (F.struct("a.node_ord", "a.node") < F.struct("b.node_ord", "b.node"))) & (F.col("a.inside") | F.col("b.inside")))
    first = F.struct("a.node_ord", "a.node") < F.struct("b.node_ord", "b.node")
    pairs = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    pairs = pairs.select("a.node", "a.lon", "a.lat", F.col("b.node").alias("v"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"))
    pairs = pairs.withColumns({"dlon": F.col("lon2") - F.col("lon"), "dlat": F.col("lat2") - F.col("lat")})
    near = pairs.filter(geo.in_degree_box(F.col("dlon"), F.col("dlat"), F.lit(float(max_gap_m))))
    near = near.withColumn("distance_m", geo.equirect_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).filter(F.col("distance_m") <= float(max_gap_m))
    line = F.array(F.struct("lon", "lat"), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))
    rows = near.select(edge_id(F.col("node"), F.col("v")).alias("edge_id"), F.col("node").alias("u"), "v", "distance_m", F.lit(True).alias("is_gap"), "dlon", "dlat", F.lit(None).cast("long").alias("lane_seq"), line.alias("geometry"), F.lit(None).cast("string").alias("lane_type"))
    return rows if max_gap_m > 0 else rows.limit(0)


def crowds(cells: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """gx, gy, own, met: parts into which a cell's nodes and those that it meets are dealt, for cells with more than one part.

    cells: gx and gy of each node; spread: copies of a cell for all cells that meet it.
    """
    full = cells.groupBy("gx", "gy").agg(F.ceil(F.count(F.lit(1)) / CELL_NODES).cast("long").alias("n")).filter("n > 1")
    rows = spread(full).groupBy("gx", "gy").agg(F.max(F.when((F.col("d.i") == 0) & (F.col("d.j") == 0), F.col("n"))).alias("own"), F.max("n").alias("met"))
    return rows.select("gx", "gy", F.coalesce("own", F.lit(1).cast("long")).alias("own"), "met")


def exclude_connected(gaps: DataFrame, lane_edges: DataFrame) -> DataFrame:
    """Gaps between nodes that no lane edge joins."""
    return gaps.join(lane_edges.select("edge_id"), "edge_id", "left_anti")


def stretch(nodes: DataFrame, lane_edges: DataFrame) -> float:
    """The largest ratio of the distance between a lane edge's nodes to its length; infinite if an edge has no length.

    A node lies at its last sighting, so an edge may span a little more than its lane is long. Within a way
    of some length no node lies farther off than this many times the length.
    """
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}"))
    both = lane_edges.select("u", "v", "distance_m").join(at("u"), "u").join(at("v"), "v")
    span = geo.equirect_m(F.col("lon_u"), F.col("lat_u"), F.col("lon_v"), F.col("lat_v"))
    ratio = F.when(F.col("distance_m") > 0, span / F.nullif(F.col("distance_m"), F.lit(0.0))).otherwise(float("inf"))
    return max(1.0, both.agg(F.max(ratio)).first()[0] or 1.0)


def boxes_within(points: DataFrame, reach_m: Column) -> DataFrame:
    """Boxes (w, e, s, n) of cells of REACH_CELL degrees that hold all nodes within ``reach_m`` of one of ``points`` (lon, lat)."""
    high = F.least(reach_m / 110_000.0, F.lit(90.0))
    wide = F.least(high / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + high, F.lit(89.0)))), F.lit(0.01)), F.lit(360.0))
    at = lambda c: F.floor(c / F.lit(REACH_CELL)).cast("long")
    return points.select(at(F.col("lon") - wide).alias("w"), at(F.col("lon") + wide).alias("e"), at(F.col("lat") - high).alias("s"), at(F.col("lat") + high).alias("n")).distinct()


def nodes_around(nodes: DataFrame, boxes: DataFrame | None, max_gap_m: float) -> DataFrame:
    """``nodes`` with inside, of those in the boxes of cells and, with inside false, in the cells around them; all are inside without boxes."""
    if boxes is None:
        return nodes.withColumn("inside", F.lit(True))
    if 3 * max_gap_m / 111_000.0 > REACH_CELL:
        raise ValueError("the cells are too small for the tolerance")
    at = lambda c: F.floor(F.col(c) / F.lit(REACH_CELL)).cast("long")
    step = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    cells = boxes.select(F.explode(F.sequence("w", "e")).alias("gx"), "s", "n").select("gx", F.explode(F.sequence("s", "n")).alias("gy")).distinct()
    around = cells.select(step("gx"), "gy").select("gx", step("gy")).distinct().join(cells.withColumn("inside", F.lit(True)), ["gx", "gy"], "left")
    return nodes.withColumn("gx", at("lon")).withColumn("gy", at("lat")).join(around, ["gx", "gy"]).withColumn("inside", F.coalesce("inside", F.lit(False))).drop("gx", "gy")


def hops_around(graph: Graph, boxes: DataFrame | None, max_gap_m: float) -> DataFrame:
    """Both directions of the lane edges and gaps up to ``max_gap_m``, as ``neighbors``, from the nodes in the boxes of cells; from all nodes without boxes.

    Only nodes in the boxes and around them meet each other; elsewhere no gap is looked for. Nothing is made
    before it is read, and no gaps are for a reader of lane edges only.
    """
    lane_edges = graph.edges.filter(~F.col("is_gap")).select(*EDGE)
    near = nodes_around(graph.nodes, boxes, max_gap_m)
    # gaps first: lane edges that join none of these nodes are met by id only
    gaps = exclude_connected(gap_candidates(near, max_gap_m, F.col("inside")), lane_edges).select(*EDGE)
    return neighbors(lane_edges.unionByName(gaps)).join(near.filter("inside").select(F.col("node").alias("src")), "src", "left_semi")


def edges_for_gap(edges: DataFrame, max_gap_m: Column) -> DataFrame:
    """Of edges with candidates for a wider tolerance, those of the given one."""
    return edges.filter(usable(max_gap_m))


def usable(max_gap_m: Column) -> Column:
    """Whether an edge may be used with this tolerance."""
    return ~F.col("is_gap") | (F.col("distance_m") <= max_gap_m) & geo.in_degree_box(F.col("dlon"), F.col("dlat"), max_gap_m)


def build_graph(lanes: DataFrame, max_gap_m: float) -> Graph:
    """Nodes and lane edges are made once, however often they are met."""
    nodes, lane_edges = cut(build_nodes(lanes)), cut(build_lane_edges(lanes))
    return Graph(nodes, lane_edges.unionByName(exclude_connected(gap_candidates(nodes, max_gap_m), lane_edges)))


def neighbors(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: src, dst, edge_id, distance_m, is_gap, dlon, dlat. The edges are read once."""
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.select(F.explode(F.array(ends("u", "v"), ends("v", "u"))).alias("e"), *EDGE).select("e.src", "e.dst", *(c for c in EDGE if c not in ("u", "v")))


def graph_stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, gap edges, lane metres."""
    e = graph.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("is_gap").alias("n_gaps"), F.round(F.sum(F.when(~F.col("is_gap"), F.col("distance_m"))), 1).alias("lane_m"))
    return graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(e, F.lit(True))


def degrees(edges: DataFrame) -> DataFrame:
    return neighbors(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def check_graph(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """Edges that are missing, extra or of the wrong kind against expected (u, v, is_gap): edge_id, problem."""
    want = expected.select(edge_id(F.col("u"), F.col("v")).alias("edge_id"), F.col("is_gap").alias("want_gap")).distinct()
    both = edges.select("edge_id", "is_gap").join(want, "edge_id", "full_outer")
    problem = F.when(F.col("is_gap").isNull(), "missing").when(F.col("want_gap").isNull(), "extra").when(F.col("is_gap") != F.col("want_gap"), "wrong flag")
    return both.withColumn("problem", problem).filter("problem is not null").select("edge_id", "problem")
