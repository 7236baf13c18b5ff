"""Map tables derived from the star schema by whole-number rules, alike in Spark and in SQL.

Every customer is a place on a jittered grid, every order a way from its customer's place to a
neighbouring one or none, suppliers are route requests, events are snapshots of areas and a log of requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network
from ..sources import areas, osm

GAP_M = 120.3
AS_OF = "2024-01-25 00:00:00"
BOX = (20.91, 52.285, 20.94, 52.31)

div = lambda a, b, spark: f"({a} div {b})" if spark else f"({a} // {b})"


def qx(k: str) -> str:
    return f"(2090000 + ({k} % 40) * 150 + ({k} * 7919) % 41)"


def qy(k: str, spark: bool) -> str:
    return f"(5228000 + {div(k, 40, spark)} * 100 + ({k} * 104729) % 31)"


def way_columns(spark: bool) -> dict[str, str]:
    """Of orders: ok, k, k2 (null: no way), t, m and the ends in 1e-7 degrees."""
    ok, k = "o_orderkey", "o_custkey"
    turn = f"({div(ok, 16, spark)} % 8)"
    k2 = f"(case {turn} when 0 then {k} + 1 when 1 then {k} + 40 when 2 then {k} + 41 when 3 then {k} end)"
    jitter = f"(({ok} % 7) - 3) * 10"
    ends = {f"{axis}{i}": f"{q} * 100 + {jitter}" for i, at in ((1, k), (2, k2)) for axis, q in (("x", qx(at)), ("y", qy(at, spark)))}
    return {"ok": ok, "k": k, "k2": k2, "t": f"({ok} % 16)", "m": f"({ok} % 3)", "name": f"case when {ok} % 5 = 0 then null else o_orderpriority end"} | ends


#: Tags by t.
TAGS = [
    {"highway": "cycleway"}, {"highway": "residential", "cycleway": "track"}, {"highway": "primary", "cycleway:left": "lane"}, {"highway": "residential", "cycleway": "shared_lane"},
    {"highway": "path", "bicycle": "designated"}, {"cycleway": "opposite_lane"}, {"cycleway:right": "track"}, {"highway": "residential", "bicycle": "designated"},
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_seq, k, t, geometry_type, geometry, properties."""
    ways = read(spark, sf_dir, "orders").select(*(F.expr(e).alias(c) for c, e in way_columns(True).items()))
    ways = ways.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k2")), "k2")
    inner = "transform(sequence(0, cast(m as int)), i -> named_struct('lon', ((x1 * (m + 1 - i) + x2 * i) div (m + 1) + 70 * i) / 1e7D, 'lat', ((y1 * (m + 1 - i) + y2 * i) div (m + 1) - 50 * i) / 1e7D))"
    line = F.concat(F.expr(inner), F.expr("array(named_struct('lon', x2 / 1e7D, 'lat', y2 / 1e7D))"))
    tags = F.lit(None).cast("map<string,string>")
    for t, pairs in enumerate(TAGS):
        tags = F.when(F.col("t") == t, F.create_map(*(F.lit(x) for p in pairs.items() for x in p))).otherwise(tags)
    tags = F.coalesce(tags, F.create_map(F.lit("highway"), F.lit("residential")))
    own = F.create_map(F.lit("id"), F.concat(F.lit("way/"), F.col("ok").cast("string")))
    named = F.when(F.col("name").isNotNull(), F.create_map(F.lit("name"), F.col("name"))).otherwise(F.create_map().cast("map<string,string>"))
    return ways.select(F.col("ok").alias("feature_seq"), "k", "t", F.lit("LineString").alias("geometry_type"), line.alias("geometry"), F.map_concat(own, named, tags).alias("properties"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.filter_bike_ways(raw_ways(spark, sf_dir))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.to_lanes(features(spark, sf_dir))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's lanes, in order, taken as a route of the supplier's request that 15 customers share; paths are gaps."""
    rows = osm.to_lanes(features(spark, sf_dir), keep=("k",))
    order = F.expr("row_number() over (partition by k order by lane_seq) - 1")
    at = lambda p: geo.node_id(geo.cell(p["lon"]), geo.cell(p["lat"]))
    return rows.select(
        F.expr("k div 15").alias("request_id"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("route_id"), order.alias("seg_idx"), at(geo.start_of(F.col("geometry"))).alias("src"), at(geo.end_of(F.col("geometry"))).alias("dst"),
        "geometry", F.when(F.col("lane_type") == "path", "gap").otherwise("bike_lane").alias("type"), geo.line_length_m(F.col("geometry")).alias("distance_m"), "lane_seq",
    )


def request_columns(spark: bool) -> dict[str, str]:
    n, k, e = "s_suppkey", "(s_suppkey * 14)", "(s_suppkey * 14 + 41)"
    f = "1e5D" if spark else "1e5"
    end = lambda q: f"case when {n} % 3 = 0 then {q} / {f} end"
    number = lambda x: f"cast({x} as double)"
    return {
        "request_id": n, "start_lon": f"{qx(k)} / {f} + cast(0.0001 as double)", "start_lat": f"{qy(k, spark)} / {f}", "end_lon": end(qx(e)), "end_lat": end(qy(e, spark)), "max_gap_m": number(GAP_M), "start_proximity_m": number("150.2"),
        "min_distance_m": f"case when {n} % 3 = 0 then {number(0)} else {number(300)} end", "max_distance_m": number(2500), "round_trip": f"({n} % 3 = 1)",
    }


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(*(F.expr(e).alias(c) for c, e in request_columns(True).items()))


def area_columns(spark: bool) -> dict[str, str]:
    f = "1e5D" if spark else "1e5"
    w, s = "(2090000 + (user_id % 8) * 700)", "(5228000 + (user_id % 5) * 400)"
    return {"west": f"{w} / {f}", "south": f"{s} / {f}", "east": f"({w} + 600) / {f}", "north": f"({s} + 300) / {f}", "fetched_at": "cast(ts as timestamp)"}


def area_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per event: id, west, south, east, north, fetched_at."""
    rows = read(spark, sf_dir, "events").select(*(F.expr(e).alias(c) for c, e in area_columns(True).items()))
    return rows.withColumn("id", geo.bbox_id(*(F.col(c) for c in ("west", "south", "east", "north"))))


def area_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.extract_areas(lanes(spark, sf_dir), areas.latest_areas(area_saves(spark, sf_dir)))


def graph(spark: SparkSession, sf_dir: str, gap_m: float = GAP_M) -> network.Graph:
    return network.build_graph(lanes(spark, sf_dir), gap_m)
