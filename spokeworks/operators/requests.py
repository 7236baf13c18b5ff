"""Route requests: defaults, modes, start candidates and nearest nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut

DEFAULTS = {"start_lon": 0.0, "start_lat": 0.0, "max_gap_m": 200.0, "start_proximity_m": 200.0, "min_distance_m": 10_000.0, "max_distance_m": 30_000.0, "round_trip": False}
#: Grid cell of point searches in degrees.
POINT_CELL = 0.01
#: Smallest cells of the pyramid in degrees; each level's cells are four times as wide as those of the one below.
LEAST_CELL, FOLD, PYRAMID = 0.0025, 4, 11
#: Cells of the level from which a search starts, at most, and cells of a level that are broadcast at most (about 60 bytes each).
TOP_CELLS, MOST_CELLS = 256, 200_000


def with_default_preferences(requests: DataFrame, patch: DataFrame | None = None) -> DataFrame:
    """Absent preferences take defaults; those of ``patch`` (request_id, ...) come first."""
    columns = [*DEFAULTS, "end_lon", "end_lat"]
    base = requests
    if patch is not None:
        named = [c for c in columns if c in patch.columns]
        base = base.join(patch.select("request_id", *(F.col(c).alias(f"__{c}") for c in named)), "request_id", "left")
        own = [c for c in named if c in requests.columns]
        base = base.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in own else F.col(f"__{c}") for c in named}).drop(*(f"__{c}" for c in named))
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in base.columns else F.lit(v) for c, v in DEFAULTS.items()}
    ends = {c: F.lit(None).cast("double") for c in ("end_lon", "end_lat") if c not in base.columns}
    return base.withColumns(filled | ends)


def resolve_start(requests: DataFrame) -> DataFrame:
    """start_lon and start_lat: the device's position if both its coordinates are known, else the view's centre."""
    known = F.col("device_lon").isNotNull() & F.col("device_lat").isNotNull()
    return requests.withColumns({f"start_{c}": F.when(known, F.col(f"device_{c}")).otherwise(F.col(f"view_{c}")) for c in ("lon", "lat")})


def request_mode(end: Column, round_trip: Column) -> Column:
    return F.when(end.isNotNull(), "one_way").when(round_trip, "round_trip").otherwise("explore")


def nodes_within(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, node, node_ord for nodes within start_proximity_m of each point (request_id, lon, lat, start_proximity_m).

    Each point is copied to the grid cells that its degree box touches.
    """
    at = lambda c: F.floor(c / F.lit(POINT_CELL)).cast("long")
    reach = geo.near_degrees(F.col("start_proximity_m"))
    span = lambda c, r, name: F.explode(F.sequence(at(F.col(c) - r), at(F.col(c) + r))).alias(name)
    spread = points.select("request_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), "start_proximity_m", span("lon", reach * 2, "gx")).select("*", F.explode(F.sequence(at(F.col("plat") - reach), at(F.col("plat") + reach))).alias("gy"))
    pairs = nodes.select("node", "lon", "lat", "node_ord", at(F.col("lon")).alias("gx"), at(F.col("lat")).alias("gy")).join(spread, ["gx", "gy"])
    near = geo.in_degree_box(F.col("lon") - F.col("plon"), F.col("lat") - F.col("plat"), F.col("start_proximity_m"))
    close = geo.equirect_m(F.col("plon"), F.col("plat"), F.col("lon"), F.col("lat")) <= F.col("start_proximity_m")
    return pairs.filter(near & close).select("request_id", "node", "node_ord")


def cells_of(nodes: DataFrame) -> DataFrame:
    """The pyramid: level, gx, gy and the box (w, e, s, n) of the nodes in each occupied cell, of all levels at once."""
    at = lambda c, k: F.floor(F.col(c) / F.lit(LEAST_CELL * FOLD**k)).cast("long")
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), at("lon", k).alias("gx"), at("lat", k).alias("gy")) for k in range(PYRAMID)))).alias("c")
    box = [F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")]
    return nodes.select("lon", "lat", cells).groupBy("c.level", "c.gx", "c.gy").agg(*box)


def box_bounds(x: Column, y: Column, box: Callable[[str], Column]) -> tuple[Column, Column]:
    """Squared degrees within which no node of a box lies, and within which one does, as each side of the box touches a node."""
    near = lambda p, low, high: F.greatest(low - p, p - high, F.lit(0.0))
    far = lambda p, low, high: F.greatest(F.abs(p - low), F.abs(p - high))
    side = lambda p, low, high: F.least(F.abs(p - low), F.abs(p - high))
    lon, lat = (x, box("w"), box("e")), (y, box("s"), box("n"))
    square = lambda c: c * c
    return square(near(*lon)) + square(near(*lat)), F.least(square(side(*lon)) + square(far(*lat)), square(far(*lon)) + square(side(*lat)))


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, node: the closest by squared degrees, the first node on ties; none for an empty graph or a point without finite coordinates.

    Points go down a pyramid of occupied cells. A cell is left out if its nodes' box lies farther off than
    some other cell has a node, so a point far from all nodes meets about as many cells as a near one, and
    only the nodes of the smallest cells that are left. The search starts from the finest level of at
    most TOP_CELLS cells; levels of up to MOST_CELLS are broadcast.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    known = nodes.filter(finite("lon") & finite("lat")).select("node", "lon", "lat", "node_ord")
    asked = points.filter(finite("lon") & finite("lat")).select("request_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    pyramid = cut(cells_of(known))
    sizes = dict(tuple(r) for r in pyramid.groupBy("level").count().collect())
    if not sizes:
        return asked.limit(0).select("request_id", F.lit(None).cast("long").alias("node"))
    level = min((k for k, n in sizes.items() if n <= TOP_CELLS), default=None)
    if level is None:
        raise ValueError("the coordinates aren't degrees")
    names = ["gx", "gy", "w", "e", "s", "n"]
    x, y = F.col("plon"), F.col("plat")
    top = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in names)) for r in pyramid.filter(F.col("level") == level).select(*names).collect()))
    within = F.array_min(F.transform(top, lambda c: box_bounds(x, y, lambda side: c[side])[1])).alias("within")
    near = lambda c: box_bounds(x, y, lambda side: c[side])[0] <= F.col("within") * (1 + 1e-12)
    left = asked.select("*", within).select("request_id", "plon", "plat", F.explode(F.filter(top, near)).alias("c")).select("request_id", "plon", "plat", "c.gx", "c.gy")
    for k in range(level - 1, -1, -1):
        inner = pyramid.filter(F.col("level") == k).select(*names).withColumns({"px": F.floor(F.col("gx") / FOLD).cast("long"), "py": F.floor(F.col("gy") / FOLD).cast("long")})
        inner = F.broadcast(inner) if sizes[k] <= MOST_CELLS else inner
        met = left.withColumnsRenamed({"gx": "px", "gy": "py"}).join(inner, ["px", "py"])
        least, most = box_bounds(x, y, F.col)
        bounds = met.withColumns({"least": least, "within": most}).withColumn("within", F.min("within").over(Window.partitionBy("request_id")))
        left = bounds.filter(F.col("least") <= F.col("within") * (1 + 1e-12)).select("request_id", "plon", "plat", "gx", "gy")
        left = cut(left) if k % 3 == 0 else left
    at = lambda c: F.floor(F.col(c) / F.lit(LEAST_CELL)).cast("long")
    squared = F.pow(F.col("lon") - x, 2) + F.pow(F.col("lat") - y, 2)
    pairs = known.select("*", at("lon").alias("gx"), at("lat").alias("gy")).join(left, ["gx", "gy"])
    return pairs.groupBy("request_id").agg(F.min_by("node", F.struct(squared, "node_ord")).alias("node"))


def start_candidates(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, node, cand_ord: nodes near each start in node order, or the nearest where none is."""
    points = requests.select("request_id", F.col("start_lon").alias("lon"), F.col("start_lat").alias("lat"), "start_proximity_m")
    near = nodes_within(points, nodes)
    lone = nearest_node(points.join(near.select("request_id").distinct(), "request_id", "left_anti"), nodes)
    rows = near.unionByName(lone.withColumn("node_ord", F.lit(0).cast("long")))
    order = Window.partitionBy("request_id").orderBy("node_ord", "node")
    return rows.select("request_id", "node", (F.row_number().over(order) - 1).alias("cand_ord"))
