"""Routes from steps: segments with geometry, metrics, exports, and the rotation that serves repeated requests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.order import running_sum
from ..sources.osm import line_json

ROUTE = ["request_id", "route_id"]
# Fixed value: the frame of a GPX 1.1 track.
GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="spokeworks" xmlns="http://www.topografix.com/GPX/1/1">\n  <trk>\n    <name>'


def attach_path_edges(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments: the steps with geometry in travel order, type and route_id (md5 of the request and the nodes met).

    The ends of an edge are told apart by node, not by coordinates.
    """
    order = Window.partitionBy("request_id", "cand_ord", "attempt")
    nodes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "src", "dst")).over(order)), lambda s: F.concat_ws(">", s["src"].cast("string"), s["dst"].cast("string"))), "|")
    named = steps.withColumn("route_id", F.md5(F.concat_ws("|", F.col("request_id").cast("string"), nodes)))
    shapes = edges.select("edge_id", "u", "geometry", F.col("distance_m").alias("edge_m"))
    rows = named.join(shapes, "edge_id")
    line = geo.oriented(F.col("geometry"), F.col("src") == F.col("u"))
    return rows.select(*ROUTE, "seg_idx", "src", "dst", "edge_id", line.alias("geometry"), F.when(F.col("is_gap"), "gap").otherwise("bike_lane").alias("type"), "distance_m")


def ordered_segments(segments: DataFrame) -> DataFrame:
    """One row a route: segments array<struct<seg_idx, geometry, type, distance_m, src, dst>> in path order."""
    return segments.groupBy(*ROUTE).agg(F.sort_array(F.collect_list(F.struct("seg_idx", "geometry", "type", "distance_m", "src", "dst"))).alias("segments"))


def route_metrics(segments: DataFrame) -> DataFrame:
    """total_m, lane_m, coverage (0 for no length), gap_count, n_segments and signature of each route, summed in path order."""
    rows = ordered_segments(segments)
    total = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["distance_m"])
    lane = F.aggregate("segments", F.lit(0.0), lambda s, x: s + F.when(x["type"] == "bike_lane", x["distance_m"]).otherwise(0.0))
    gaps = F.size(F.filter("segments", lambda x: x["type"] == "gap"))
    rows = rows.withColumns({"total_m": total, "lane_m": lane, "gap_count": gaps, "n_segments": F.size("segments"), "signature": geo.signature(F.transform("segments", lambda s: s["geometry"]))})
    return rows.withColumn("coverage", F.when(F.col("total_m") > 0, F.col("lane_m") / F.col("total_m")).otherwise(0.0)).drop("segments")


def node_sequence(segments: DataFrame) -> DataFrame:
    """nodes: the start node of each segment and the last one's end."""
    s = ordered_segments(segments)
    return s.select(*ROUTE, F.concat(F.transform("segments", lambda x: x["src"]), F.array(F.element_at("segments", -1)["dst"])).alias("nodes"))


def cumulative_distance(segments: DataFrame) -> DataFrame:
    along = Window.partitionBy(*ROUTE).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segments.withColumn("along_m", F.sum("distance_m").over(along))


def connectors(segments: DataFrame) -> DataFrame:
    """Straight lines from each segment's last vertex to the next one's first; none after the last."""
    following = F.lead(geo.start_of(F.col("geometry"))).over(Window.partitionBy(*ROUTE).orderBy("seg_idx"))
    rows = segments.select(*ROUTE, "seg_idx", geo.end_of(F.col("geometry")).alias("a"), following.alias("b")).filter("b is not null")
    return rows.select(*ROUTE, F.lit("connector").alias("kind"), F.col("seg_idx").alias("index"), F.lit(None).cast("string").alias("type"), F.array("a", "b").alias("geometry"))


def route_features(segments: DataFrame) -> DataFrame:
    """Lane features and connector features of each route: kind, index, type, geometry."""
    lanes = segments.select(*ROUTE, F.lit("lane").alias("kind"), F.col("seg_idx").alias("index"), "type", "geometry")
    return lanes.unionByName(connectors(segments))


def features_of_kind(features: DataFrame, kind: str) -> DataFrame:
    return features.filter(F.col("kind") == kind)


def routes_to_geojson(segments: DataFrame) -> DataFrame:
    """One FeatureCollection a route, lanes before connectors."""
    rows = route_features(segments)
    properties = F.when(F.col("kind") == "lane", F.to_json(F.struct("kind", "index", "type"))).otherwise(F.to_json(F.struct("kind", "index")))
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.to_json(line_json(F.col("geometry"))), F.lit(',"properties":'), properties, F.lit("}"))
    item = F.struct((F.col("kind") != "lane").alias("late"), "index", text.alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), ",")
    return rows.groupBy(*ROUTE).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("geojson"))


def routes_to_gpx(segments: DataFrame, name: Column | None = None) -> DataFrame:
    """One GPX 1.1 document a route: all vertices of all segments in order, joints repeated; the name is escaped."""
    lines = F.flatten(F.transform("segments", lambda s: F.transform(s["geometry"], geo.track_point)))
    title = geo.xml_text(name if name is not None else F.lit("Cycle Route"))
    text = F.concat(F.lit(GPX_HEAD), title, F.lit("</name>\n    <trkseg>\n"), F.array_join(lines, "\n"), F.lit("\n    </trkseg>\n  </trk>\n</gpx>"))
    return ordered_segments(segments).select(*ROUTE, text.alias("gpx"))


def route_summary(metrics: DataFrame) -> DataFrame:
    """distance_text in km with one decimal, coverage_percent whole."""
    return metrics.select(*ROUTE, F.concat(geo.fixed(F.col("total_m") / 1000, 1), F.lit(" km")).alias("distance_text"), F.floor(F.col("coverage") * 100 + 0.5).cast("int").alias("coverage_percent"))


def closed_routes(segments: DataFrame) -> DataFrame:
    first = geo.start_of(F.element_at("segments", 1)["geometry"])
    last = geo.end_of(F.element_at("segments", -1)["geometry"])
    return ordered_segments(segments).select(*ROUTE, geo.is_closed(first, last).alias("closed"))


def within_distance_bounds(metrics: DataFrame, requests: DataFrame) -> DataFrame:
    bounds = requests.select("request_id", "min_distance_m", "max_distance_m")
    return metrics.join(bounds, "request_id").filter(F.col("total_m").between(F.col("min_distance_m"), F.col("max_distance_m"))).select(metrics.columns)


def shuffle_routes(routes: DataFrame, key: str = "request_id", seed: int = 1) -> DataFrame:
    """shuffled: a route's place, from 0, in the random order of its key."""
    order = Window.partitionBy(key).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("route_id"))), "route_id")
    return routes.withColumn("shuffled", F.row_number().over(order) - 1)


def route_violations(segments: DataFrame, requests: DataFrame, tolerance_m: float = 1e-6) -> DataFrame:
    """Routes that break rules: bounds (explore walks may end beyond the maximum), type, no lane, not closed."""
    metrics, closed = route_metrics(segments), closed_routes(segments)
    odd = segments.groupBy(*ROUTE).agg(F.count_if(~F.col("type").isin("bike_lane", "gap")).alias("odd"))
    wanted = requests.select("request_id", "min_distance_m", "max_distance_m", F.col("mode").alias("asked"))
    rows = metrics.join(closed, ROUTE).join(odd, ROUTE).join(wanted, "request_id")
    short = F.col("total_m") < F.col("min_distance_m") - tolerance_m
    far = (F.col("asked") != "explore") & (F.col("total_m") > F.col("max_distance_m") + tolerance_m)
    broken = F.array_compact(F.array(F.when(short | far, "bounds"), F.when(F.col("odd") > 0, "type"), F.when(F.col("lane_m") <= 0, "no_lane"), F.when((F.col("asked") == "round_trip") & ~F.col("closed"), "not_closed")))
    return rows.select(*ROUTE, broken.alias("broken")).filter(F.size("broken") > 0)


def scenario_report(metrics: DataFrame, sequences: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per scenario (request_id and expectations, null where there are none): ok and the checks that fail.

    Expectations: min_routes, max_routes, min_coverage, has_gap, max_gaps, routes (all must be found)
    and any_route (one must be), as arrays of node names.
    """
    found = metrics.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("coverage").alias("least"), F.max("gap_count").alias("most_gaps"))
    named = sequences.groupBy("request_id").agg(F.collect_set("nodes").alias("sequences"))
    rows = scenarios.join(found, "request_id", "left").join(named, "request_id", "left")
    n, seqs = F.coalesce("n", F.lit(0)), F.coalesce("sequences", F.array().cast("array<array<string>>"))
    fails = {
        "min_routes": n < F.col("min_routes"), "max_routes": n > F.col("max_routes"), "min_coverage": F.col("least") < F.col("min_coverage"),
        "has_gap": F.col("has_gap") != (F.coalesce("most_gaps", F.lit(0)) > 0), "max_gaps": F.col("most_gaps") > F.col("max_gaps"),
        "routes": F.size(F.array_except("routes", seqs)) > 0, "any_route": ~F.arrays_overlap("any_route", seqs),
    }
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in fails.items())))
    return rows.select("request_id", (F.size(failed) == 0).alias("ok"), failed.alias("failed"))


class Rotation(NamedTuple):
    """What later logs need of earlier ones.

    keys: cache_key, epoch, leader and taken, the requests that got a route of the leader's; one row with a null
    key and leader holds the number of refreshes so far. turns: leader, route_id and turn of the leaders in keys.
    """

    keys: DataFrame
    turns: DataFrame


def save_rotation(state: Rotation, path: str) -> None:
    """Into a new folder."""
    state.keys.write.mode("errorifexists").parquet(f"{path}/keys")
    state.turns.write.mode("errorifexists").parquet(f"{path}/turns")


def load_rotation(spark: SparkSession, path: str) -> Rotation:
    return Rotation(spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/turns"))


def serve_routes(log: DataFrame, routes: DataFrame, state: Rotation | None = None) -> DataFrame:
    """The route that each request of a log gets, in rotation.

    log: request_id, ts, cache_key and refresh (whether the lanes changed just before it). routes:
    request_id, route_id of what a search for that request finds. state: what ``rotation_after`` gave for the
    log before this one. Within a key, and until the next refresh of any, the first request that finds routes
    leads: its routes are shuffled once, and it and later requests of the key get them in turn. Requests
    before it find none: status no_route. Refreshes and ranks are counted over ranges of the log, so
    neither a day nor a popular key lies in one task.
    """
    rows, placed, _ = _turns(log, routes, state)
    served = rows.join(placed, ["leader", "turn"], "left")
    return served.select("request_id", "cache_key", "epoch", F.when(F.col("route_id").isNull(), "no_route").otherwise("served").alias("status"), "route_id", "turn")


def rotation_after(log: DataFrame, routes: DataFrame, state: Rotation | None = None) -> Rotation:
    """The state after a log, for the next one: the leaders since the last refresh and how often they were served.

    It holds the keys since the last refresh only. A null key of a log's own is none that leads.
    """
    rows, placed, before = _turns(log, routes, state)
    epoch = before + (log.agg(F.count_if("refresh")).first()[0] or 0)
    own = rows.filter((F.col("epoch") == epoch) & F.col("turn").isNotNull()).groupBy("cache_key", "epoch", "leader").agg(F.max("taken").alias("taken"))
    mark = log.sparkSession.range(1).select(F.lit(None).cast(log.schema["cache_key"].dataType).alias("cache_key"), F.lit(epoch).cast("long").alias("epoch"), F.lit(None).cast(log.schema["request_id"].dataType).alias("leader"), F.lit(0).cast("long").alias("taken"))
    keys = own.filter("cache_key is not null")
    if state is not None:
        keys = keys.unionByName(state.keys.filter(F.col("leader").isNotNull() & (F.col("epoch") == epoch)).join(own.select("cache_key"), "cache_key", "left_anti"))
    return Rotation(keys.unionByName(mark), placed.join(keys.select("leader"), "leader", "left_semi"))


def _turns(log: DataFrame, routes: DataFrame, state: Rotation | None) -> tuple[DataFrame, DataFrame, int]:
    """The log with epoch, leader, taken (requests of the key that were served so far) and turn; turns of all leaders; refreshes before the log."""
    key = ["cache_key", "epoch"]
    before = 0 if state is None else state.keys.agg(F.max("epoch")).first()[0] or 0
    epochs = running_sum(log, ["ts", "request_id"], F.col("refresh").cast("int"), "epoch").withColumn("epoch", F.col("epoch") + before)
    some = routes.select("request_id").distinct().withColumn("some", F.lit(True))
    rows = running_sum(epochs.join(some, "request_id", "left"), [*key, "ts", "request_id"], F.lit(1), "rank")  # over all keys; only differences count
    leads = F.when(F.col("some"), F.struct(F.col("rank").alias("first"), F.col("request_id").alias("leader")))
    leader = rows.groupBy(*key).agg(F.min(leads).alias("l"), F.min("rank").alias("least")).select(*key, "l.first", "l.leader", "least", F.lit(0).cast("long").alias("earlier"))
    placed = shuffle_routes(routes).select(F.col("request_id").alias("leader"), "route_id", F.col("shuffled").cast("long").alias("turn"))
    if state is not None:
        old = state.keys.filter("leader is not null").select(*key, F.col("leader").alias("old"), "taken")
        carried = F.col("old").isNotNull()
        leader = leader.join(old, key, "left").select(*key, F.when(carried, F.col("least")).otherwise(F.col("first")).alias("first"), F.when(carried, F.col("old")).otherwise(F.col("leader")).alias("leader"), F.coalesce("taken", F.lit(0).cast("long")).alias("earlier"))
        placed = placed.unionByName(state.turns.select("leader", "route_id", "turn"))
    sizes = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    led = rows.join(leader.select(*key, "first", "leader", "earlier").join(sizes, "leader"), key, "left").withColumn("taken", F.when(F.col("rank") >= F.col("first"), F.col("rank") - F.col("first") + 1 + F.col("earlier")))
    return led.withColumn("turn", F.pmod(F.col("taken") - 1, F.col("n"))), placed, before
