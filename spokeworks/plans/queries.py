"""One query per operator, over tables derived from the star schema, with SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network, requests, routes, search
from ..session import cut, new_path
from ..sources import areas, osm
from . import derived as d
from .sql import equirect, fixed, haversine, length_of, near, node, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col
r3 = lambda x, name: F.round(x, 3).alias(name)
as_of = lambda: F.to_timestamp(F.lit(d.AS_OF))
_AS_OF = f"timestamp '{d.AS_OF}'"
_WEEK = "7 * 24 * 60 * 60 * 1000"
_AGE = f"epoch_ms({_AS_OF}) - epoch_ms(fetched_at)"
_WSEN = ("west", "south", "east", "north")
_LANE = "lane_seq, osm_id, lane_type, name, len(g) as n_points, round(g[1].lon, 7) as lon, round(g[1].lat, 7) as lat"


def add(name: str, check: str | None = None, *tables: str):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if check is not None:
            SQL[name] = sql(check, *tables)
        return f

    return keep


def lane_columns(lanes: DataFrame, *more: str) -> DataFrame:
    first = geo.start_of(c("geometry"))
    return lanes.select(*more, "lane_seq", "osm_id", "lane_type", "name", F.size("geometry").alias("n_points"), F.round(first["lon"], 7).alias("lon"), F.round(first["lat"], 7).alias("lat"))


# Sources and sinks


def _documents(rows, name, item, groups):
    """Writes ``item`` of the rows (feature_seq and others) as documents of about 200 elements, in ``groups`` files in order."""
    several = rows.select(c("feature_seq"), F.expr("feature_seq div 800").alias("doc"), item.alias("item"))
    docs = several.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("feature_seq", "item"))).alias("items"))
    text = F.concat(F.lit('{"type": "FeatureCollection", "bbox": [{"features": 0}], "' + name + '": ['), F.array_join(F.transform("items", lambda x: x["item"]), ",\n"), F.lit("]}"))
    path = new_path(rows.sparkSession, name)
    docs.select("doc", text.alias("value")).repartitionByRange(groups, "doc").sortWithinPartitions("doc").select("value").write.text(path)
    return path


@add("s1_read_osm_ways", f"select {_LANE} from lanes", "lanes")
def s1(spark, sf):
    """Ways written as extract documents in several files and read again, as lanes."""
    rows = d.raw_ways(spark, sf)
    tags = F.map_filter("properties", lambda k, v: k != "id")
    points = F.transform("geometry", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    element = F.to_json(F.struct(F.lit("way").alias("type"), c("feature_seq").alias("id"), tags.alias("tags"), points.alias("geometry")))
    return lane_columns(osm.to_lanes(osm.filter_bike_ways(osm.read_osm_ways(spark, _documents(rows, "elements", element, 3)))))


@add("s2_read_geojson", f"select {_LANE.replace('lane_seq', 'row_number() over (order by lane_seq) - 1 as lane_seq', 1)} from lanes", "lanes")
def s2(spark, sf):
    """Lanes' features written as collections in several files and read again, counted in order over all of them."""
    rows = d.features(spark, sf)
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), osm.line_json(c("geometry")).alias("geometry"), c("properties")))
    return lane_columns(osm.to_lanes(osm.read_geojson(spark, _documents(rows, "features", feature, 4))))


@add("s3_save_areas", "select id, west, south, east, north, fetched_at from areas", "areas")
def s3(spark, sf):
    path, saves = new_path(spark, "areas"), d.area_saves(spark, sf)
    half = F.to_timestamp(F.lit("2024-01-15"))
    areas.save_areas(saves.filter(c("fetched_at") < half), saves.filter(c("fetched_at") >= half), path)
    return areas.load_all_areas(spark, path).select("id", *_WSEN, "fetched_at")


@add("s4_load_area", "select id, fetched_at from areas where id = '20.900,52.280,20.906,52.283'", "areas")
def s4(spark, sf):
    path, saves = new_path(spark, "areas"), d.area_saves(spark, sf)
    areas.save_areas(saves.limit(0), saves, path)
    return areas.load_area(spark, path, "20.900,52.280,20.906,52.283").select("id", "fetched_at")


_COORDS = "'[' || array_to_string(list_transform(g, lambda p: '[' || p.lon || ',' || p.lat || ']'), ',') || ']'"
_LINE = "'{\"type\":\"LineString\",\"coordinates\":' || " + _COORDS + " || '}'"


@add("s6_lanes_to_geojson", "select lane_seq, '{\"type\":\"Feature\",\"geometry\":' || " + _LINE + " || ',\"properties\":{\"id\":\"' || osm_id || '\",\"laneType\":\"' || lane_type || '\",\"name\":' || coalesce('\"' || name || '\"', 'null') || '}}' as feature from lanes", "lanes")
def s6(spark, sf):
    return osm.lanes_to_geojson(d.lanes(spark, sf))


_FEATURES = "select request_id, route_id, 'lane' as kind, seg_idx as index, type, g from segments union all select request_id, route_id, 'connector', seg_idx, null, [g[-1], following] from (select *, lead(g[1]) over (partition by route_id order by seg_idx) as following from segments) where following is not null"


@add("s7_routes_to_geojson", "select request_id, route_id, '{\"type\":\"FeatureCollection\",\"features\":[' || string_agg('{\"type\":\"Feature\",\"geometry\":' || " + _LINE + " || ',\"properties\":{\"kind\":\"' || kind || '\",\"index\":' || index || coalesce(',\"type\":\"' || type || '\"', '') || '}}', ',' order by kind <> 'lane', index) || ']}' as geojson from (" + _FEATURES + ") group by 1, 2", "segments")
def s7(spark, sf):
    return routes.routes_to_geojson(d.segments(spark, sf))


_NUM = lambda x: f"regexp_replace(cast(cast({x} as decimal(12,9)) as varchar), '\\.?0+$', '')"
_POINTS = "array_to_string(list_transform(flatten(list(g order by seg_idx)), lambda p: '    <trkpt lat=\"' || " + _NUM("p.lat") + " || '\" lon=\"' || " + _NUM("p.lon") + " || '\"></trkpt>'), chr(10))"


@add("s8_routes_to_gpx", "select request_id, route_id, '" + routes.GPX_HEAD + "Cycle Route</name>\n    <trkseg>\n' || " + _POINTS + " || '\n    </trkseg>\n  </trk>\n</gpx>' as gpx from segments group by 1, 2", "segments")
def s8(spark, sf):
    return routes.routes_to_gpx(d.segments(spark, sf))


# Projections, filters and predicates


@add("p1_filter_bike_ways", "select ok as feature_seq from ways where t <= 6", "ways")
def p1(spark, sf):
    return d.features(spark, sf).select("feature_seq")


_W, _S, _E, _N = d.BOX
_CROSS = lambda w, s, e, n: f"len(list_filter(range(1, len(g)), lambda i: greatest(0.0, case when g[i+1].lon <> g[i].lon then least(({w} - g[i].lon) / nullif(g[i+1].lon - g[i].lon, 0), ({e} - g[i].lon) / nullif(g[i+1].lon - g[i].lon, 0)) else 0 end, case when g[i+1].lat <> g[i].lat then least(({s} - g[i].lat) / nullif(g[i+1].lat - g[i].lat, 0), ({n} - g[i].lat) / nullif(g[i+1].lat - g[i].lat, 0)) else 0 end) <= least(1.0, case when g[i+1].lon <> g[i].lon then greatest(({w} - g[i].lon) / nullif(g[i+1].lon - g[i].lon, 0), ({e} - g[i].lon) / nullif(g[i+1].lon - g[i].lon, 0)) else 1 end, case when g[i+1].lat <> g[i].lat then greatest(({s} - g[i].lat) / nullif(g[i+1].lat - g[i].lat, 0), ({n} - g[i].lat) / nullif(g[i+1].lat - g[i].lat, 0)) else 1 end) and (g[i+1].lon <> g[i].lon or g[i].lon between {w} and {e}) and (g[i+1].lat <> g[i].lat or g[i].lat between {s} and {n}))) > 0"
_MEETS = lambda w, s, e, n: f"(len(list_filter(g, lambda p: p.lon between {w} and {e} and p.lat between {s} and {n})) > 0 or {_CROSS(w, s, e, n)})"


@add("p2_filter_bbox", f"select ok as feature_seq from ways where {_MEETS(_W, _S, _E, _N)}", "ways")
def p2(spark, sf):
    return osm.filter_bbox(d.raw_ways(spark, sf), *d.BOX).select("feature_seq")


@add("p3_filter_linestrings", "select ok as feature_seq from ways where t <> 0", "ways")
def p3(spark, sf):
    """Ways of one tag rule are taken as polygons here, so that there is something to drop."""
    mixed = d.raw_ways(spark, sf).withColumn("geometry_type", F.when(c("t") == 0, "Polygon").otherwise(c("geometry_type")))
    return osm.filter_linestrings(mixed).select("feature_seq")


@add("p4_lane_type", "select lane_type, count(*) as n from lanes group by 1", "lanes")
def p4(spark, sf):
    return d.features(spark, sf).groupBy(geo.lane_type(c("properties")).alias("lane_type")).agg(F.count(F.lit(1)).alias("n"))


@add("p5_to_lanes", f"select md5(osm_id || '#' || lane_seq) as id, {_LANE} from lanes", "lanes")
def p5(spark, sf):
    return lane_columns(d.lanes(spark, sf), "id")


@add("p6_fresh_areas", f"select id, fetched_at, {_AGE} > {_WEEK} as stale, {_AGE} < {_WEEK} as fresh from areas", "areas")
def p6(spark, sf):
    latest = areas.latest_areas(d.area_saves(spark, sf))
    fresh = areas.fresh_areas(latest, as_of()).select("id", F.lit(True).alias("fresh"))
    return latest.join(fresh, "id", "left").select("id", "fetched_at", areas.is_area_stale(as_of()).alias("stale"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


_WIDE = "(select user_id, west, south, west + user_id / 100.0 as east, south + user_id / 200.0 as north from (select user_id, (2090000 + (user_id % 8) * 700) / 1e5 as west, (5228000 + (user_id % 5) * 400) / 1e5 as south from (select distinct user_id from events)))"
_WIDTH = "(east - west) * 3.141592653589793 / 180 * 6371.0 * cos((south + north) / 2 * 3.141592653589793 / 180)"
_HEIGHT = "(north - south) * 3.141592653589793 / 180 * 6371.0"


def _wide(spark, sf):
    users = d.read(spark, sf, "events").select("user_id").distinct()
    at = users.select("user_id", *(F.expr(d.area_columns(True)[k]).alias(k) for k in ("west", "south")))
    return at.withColumns({"east": c("west") + c("user_id") / 100.0, "north": c("south") + c("user_id") / 200.0})


@add("p7_area_too_large", f"select user_id, {_WIDTH} > 50 or {_HEIGHT} > 50 as too_large from {_WIDE}")
def p7(spark, sf):
    return _wide(spark, sf).select("user_id", areas.area_too_large(*map(c, _WSEN)).alias("too_large"))


@add("p8_edges_for_gap", f"select e.edge_id, e.is_gap from edges e join nodes a on a.node = e.u join nodes b on b.node = e.v where not is_gap or (distance_m <= 80.2 and {near('a.lon - b.lon', 'a.lat - b.lat', '80.2')})", "edges", "nodes")
def p8(spark, sf):
    return network.edges_for_gap(d.graph(spark, sf).edges, F.lit(80.2)).select("edge_id", "is_gap")


@add("p9_within_distance_bounds", "select request_id, route_id, round(total_m, 3) as total_m from metrics join requests using (request_id) where total_m between min_distance_m and max_distance_m", "metrics", "requests")
def p9(spark, sf):
    kept = routes.within_distance_bounds(routes.route_metrics(d.segments(spark, sf)), d.requests(spark, sf))
    return kept.select("request_id", "route_id", r3(c("total_m"), "total_m"))


@add("p10_with_default_preferences", "select c_custkey as request_id, c_acctbal as start_lon, 0.0::double as start_lat, coalesce(case when c_custkey % 2 = 0 then 77.0 end, case when c_custkey % 3 = 0 then 300.0 end, 200.0)::double as max_gap_m, 10000.0::double as min_distance_m, 30000.0::double as max_distance_m, coalesce(case when c_custkey % 2 = 0 then true end, false) as round_trip, 200.0::double as start_proximity_m, null::double as end_lon, null::double as end_lat from customer")
def p10(spark, sf):
    rows = d.read(spark, sf, "customer").select(c("c_custkey").alias("request_id"), c("c_acctbal").alias("start_lon"), F.when(c("c_custkey") % 3 == 0, 300.0).alias("max_gap_m"))
    patch = rows.select("request_id", F.when(c("request_id") % 2 == 0, 77.0).alias("max_gap_m"), F.when(c("request_id") % 2 == 0, True).alias("round_trip"))
    return requests.with_default_preferences(rows, patch)


@add("p11_request_mode", "select request_id, case when end_lon is not null then 'one_way' when round_trip then 'round_trip' else 'explore' end as mode from requests", "requests")
def p11(spark, sf):
    return d.requests(spark, sf).select("request_id", requests.request_mode(c("end_lon"), c("round_trip")).alias("mode"))


@add("p12_features_of_kind", f"select request_id, route_id, index from ({_FEATURES}) where kind = 'connector'", "segments")
def p12(spark, sf):
    return routes.features_of_kind(routes.route_features(d.segments(spark, sf)), "connector").select("request_id", "route_id", "index")


@add("p13_resolve_start", "select c_custkey, case when c_custkey % 3 > 0 and c_custkey % 5 > 0 then c_acctbal else 1.5 end::double as start_lon, case when c_custkey % 3 > 0 and c_custkey % 5 > 0 then c_acctbal / 2 else 2.5 end::double as start_lat from customer")
def p13(spark, sf):
    rows = d.read(spark, sf, "customer").select("c_custkey", F.when(c("c_custkey") % 3 > 0, c("c_acctbal")).alias("device_lon"), F.when(c("c_custkey") % 5 > 0, c("c_acctbal") / 2).alias("device_lat"), F.lit(1.5).alias("view_lon"), F.lit(2.5).alias("view_lat"))
    return requests.resolve_start(rows).select("c_custkey", "start_lon", "start_lat")


# Joins


@add("j1_gap_candidates", "select edge_id, u, v, round(distance_m, 3) as distance_m from pairs", "pairs")
def j1(spark, sf):
    return network.gap_candidates(network.build_nodes(d.lanes(spark, sf)), d.GAP_M).select("edge_id", "u", "v", r3(c("distance_m"), "distance_m"))


@add("j2_exclude_connected", "select edge_id from edges where is_gap", "edges")
def j2(spark, sf):
    lanes = d.lanes(spark, sf)
    return network.exclude_connected(network.gap_candidates(network.build_nodes(lanes), d.GAP_M), network.build_lane_edges(lanes)).select("edge_id")


_START_NEAREST = "select r.request_id, arg_min(n.node, struct_pack(s := pow(n.lon - r.start_lon, 2) + pow(n.lat - r.start_lat, 2), o := n.node_ord)) as node from requests r, nodes n group by 1"


@add("j3_start_candidates", f"select request_id, node, row_number() over (partition by request_id order by node_ord, node) - 1 as cand_ord from (select * from close union all select request_id, node, 0 from ({_START_NEAREST}) where request_id not in (select request_id from close))", "close")
def j3(spark, sf):
    return requests.start_candidates(d.requests(spark, sf), network.build_nodes(d.lanes(spark, sf))).withColumn("cand_ord", c("cand_ord").cast("long"))


@add("j4_nearest_node", _START_NEAREST, "requests", "nodes")
def j4(spark, sf):
    points = d.requests(spark, sf).select("request_id", c("start_lon").alias("lon"), c("start_lat").alias("lat"))
    return requests.nearest_node(points, network.build_nodes(d.lanes(spark, sf)))


@add("j5_split_cached_areas", f"select distinct id, id in (select id from saves where fetched_at < timestamp '2024-01-01 03:00:00') as cached from saves", "saves")
def j5(spark, sf):
    saves = d.area_saves(spark, sf)
    return areas.split_cached(saves.select("id").distinct(), saves.filter(c("fetched_at") < F.to_timestamp(F.lit("2024-01-01 03:00:00")))).select("id", "cached")


_AREA_LANES = f"(select a.id as area_id, l.* from lanes l join areas a on {_MEETS('a.west', 'a.south', 'a.east', 'a.north')})"


@add("s5_prune_stale_areas", f"select s.id, fetched_at, count(lane_seq) as n_lanes from areas s left join {_AREA_LANES} l on l.area_id = s.id where {_AGE} <= {_WEEK} group by 1, 2", "areas", "lanes")
def s5(spark, sf):
    kept, lanes = areas.prune_stale_areas(areas.latest_areas(d.area_saves(spark, sf)), d.area_lanes(spark, sf), as_of())
    return kept.join(lanes.select(c("area_id").alias("id"), "lane_seq"), "id", "left").groupBy("id", "fetched_at").agg(F.count("lane_seq").alias("n_lanes"))


@add("j6_extract_areas", f"select area_id, lane_seq from {_AREA_LANES}", "lanes", "areas")
def j6(spark, sf):
    return d.area_lanes(spark, sf).select("area_id", "lane_seq")


@add("j7_neighbors", "select src, dst, edge_id, is_gap, round(distance_m, 3) as distance_m from adj", "adj")
def j7(spark, sf):
    return network.neighbors(d.graph(spark, sf).edges).select("src", "dst", "edge_id", "is_gap", r3(c("distance_m"), "distance_m"))


@add("j8_attach_path_edges", "select s.request_id, s.seg_idx, s.src, s.dst, e.lane_seq, round((case when s.src = e.u then e.g[1] else e.g[-1] end).lon, 7) as lon from segments s join lane_edges e on e.edge_id = least(s.src, s.dst) || '-' || greatest(s.src, s.dst)", "segments", "lane_edges")
def j8(spark, sf):
    """A customer's lanes as steps, with the geometry of the edge that stands for each pair of nodes."""
    steps = d.segments(spark, sf).select("request_id", c("route_id").alias("cand_ord"), F.lit(1).alias("attempt"), "seg_idx", "src", "dst", network.edge_id(c("src"), c("dst")).alias("edge_id"), "distance_m", F.lit(False).alias("is_gap"))
    edges = network.build_lane_edges(d.lanes(spark, sf))
    rows = routes.attach_path_edges(steps, edges).join(edges.select("edge_id", "lane_seq"), "edge_id")
    return rows.select("request_id", "seg_idx", "src", "dst", "lane_seq", F.round(geo.start_of(c("geometry"))["lon"], 7).alias("lon"))


@add("j9_check_graph", "select edge_id, 'extra' as problem from edges where not is_gap and v % 7 = 0 union all select edge_id, 'wrong flag' from edges where is_gap and v % 5 = 0", "edges")
def j9(spark, sf):
    """The graph against an expectation that lacks some lane edges and takes some gaps for lanes."""
    edges = d.graph(spark, sf).edges
    want = edges.filter("is_gap or v % 7 <> 0").select("u", "v", (c("is_gap") & (c("v") % 5 != 0)).alias("is_gap"))
    return network.check_graph(edges, want)


# Aggregations


@add("a1_build_nodes", "select node, node_ord, round(lon, 7) as lon, round(lat, 7) as lat from nodes", "nodes")
def a1(spark, sf):
    return network.build_nodes(d.lanes(spark, sf)).select("node", "node_ord", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@add("a2_build_lane_edges", "select edge_id, u, v, lane_seq, round(distance_m, 3) as distance_m from lane_edges", "lane_edges")
def a2(spark, sf):
    return network.build_lane_edges(d.lanes(spark, sf)).select("edge_id", "u", "v", "lane_seq", r3(c("distance_m"), "distance_m"))


@add("a3_line_length", f"select lane_seq, round({length_of('g')}, 3) as length_m from lanes", "lanes")
def a3(spark, sf):
    return d.lanes(spark, sf).select("lane_seq", r3(geo.line_length_m(c("geometry")), "length_m"))


@add("a4_route_metrics", "select request_id, route_id, round(total_m, 3) as total_m, round(lane_m, 3) as lane_m, round(case when total_m > 0 then lane_m / total_m else 0 end, 6) as coverage, gap_count, n_segments from metrics", "metrics")
def a4(spark, sf):
    m = routes.route_metrics(d.segments(spark, sf))
    return m.select("request_id", "route_id", r3(c("total_m"), "total_m"), r3(c("lane_m"), "lane_m"), F.round("coverage", 6).alias("coverage"), c("gap_count").cast("long").alias("gap_count"), c("n_segments").cast("long").alias("n_segments"))


@add("a5_graph_stats", "select (select count(*) from nodes) as n_nodes, (select count(*) from edges) as n_edges, (select count(*) from edges where is_gap) as n_gaps, (select round(sum(distance_m), 1) from edges where not is_gap) as lane_m", "edges", "nodes")
def a5(spark, sf):
    return network.graph_stats(d.graph(spark, sf))


@add("a5_degrees", "select src as node, count(*) as degree from adj group by 1", "adj")
def a5_degrees(spark, sf):
    return network.degrees(d.graph(spark, sf).edges)


@add("a6_routes_per_request", "select request_id, count(distinct route_id) as n_routes, count(distinct route_id) < case when end_lon is not null then 1 else 3 end as too_few from requests left join segments using (request_id) group by request_id, end_lon", "segments", "requests")
def a6(spark, sf):
    asked = d.requests(spark, sf).select("request_id", requests.request_mode(c("end_lon"), c("round_trip")).alias("mode"))
    steps = d.segments(spark, sf).select("request_id", c("route_id").alias("cand_ord"), F.lit(1).alias("attempt"))
    return search.routes_per_request(asked, steps)


@add("a7_lane_counts", f"select area_id, count(*) as n_lanes from {_AREA_LANES} group by 1", "lanes", "areas")
def a7(spark, sf):
    return areas.lane_counts(d.area_lanes(spark, sf))


def _steps(spark, sf):
    s = d.segments(spark, sf)
    return s.select("request_id", F.expr("cast(substring(route_id, 2) as bigint)").alias("cand_ord"), F.lit(1).alias("attempt"), "seg_idx", "src", "dst", network.edge_id(c("src"), c("dst")).alias("edge_id"), "distance_m", (c("type") == "gap").alias("is_gap"))


_SIGNED = "(select request_id, cast(substring(route_id, 2) as bigint) as cand_ord, string_agg(src, '|' order by seg_idx) as signature, sum(distance_m) as total_m, count(*) as n from segments group by all)"
_FIRST = f"(select *, row_number() over (partition by request_id, signature order by cand_ord) as place from {_SIGNED})"


@add("a8_distinct_routes", f"select request_id, cand_ord, n as n_segments, round(total_m, 3) as total_m from {_FIRST} where place = 1", "segments")
def a8(spark, sf):
    kept = search.with_signature(search.distinct_routes(_steps(spark, sf)))
    return kept.select("request_id", "cand_ord", c("n_segments").cast("long").alias("n_segments"), r3(c("total_m"), "total_m"))


# Windows, order and sets


@add("w1_node_order", "select node, row_number() over (order by node_ord, node) as place from nodes", "nodes")
def w1(spark, sf):
    return network.node_places(network.build_nodes(d.lanes(spark, sf))).select("node", "place")


@add("w2_connectors", f"select request_id, route_id, index, round(g[1].lon, 7) as lon1, round(g[2].lat, 7) as lat2 from ({_FEATURES}) where kind = 'connector'", "segments")
def w2(spark, sf):
    return routes.connectors(d.segments(spark, sf)).select("request_id", "route_id", "index", F.round(geo.start_of(c("geometry"))["lon"], 7).alias("lon1"), F.round(geo.end_of(c("geometry"))["lat"], 7).alias("lat2"))


@add("w3_first_by_signature", f"select request_id, md5(signature) as signature, min(cand_ord) as cand_ord, count(*) as n from {_SIGNED} group by request_id, signature", "segments")
def w3(spark, sf):
    all_routes = search.with_signature(_steps(spark, sf))
    kept = search.with_signature(search.distinct_routes(_steps(spark, sf)))
    n = all_routes.groupBy("request_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(n, ["request_id", "signature"]).select("request_id", F.md5("signature").alias("signature"), "cand_ord", "n")


@add("w4_cumulative_distance", "select route_id, seg_idx, round(sum(distance_m) over (partition by route_id order by seg_idx), 3) as along_m from segments", "segments")
def w4(spark, sf):
    return routes.cumulative_distance(d.segments(spark, sf)).select("route_id", c("seg_idx").cast("long").alias("seg_idx"), r3(c("along_m"), "along_m"))


_LOG = "(select event_id as request_id, user_id * 2 // 3 as asked, ts, event_id % 997 = 996 as refresh from events)"
_SERVE = f"""
, keyed as (
  select l.*, {fixed('start_lon', 3)} || ',' || {fixed('start_lat', 3)} || ',' || cast(max_gap_m as integer) as cache_key, sum(l.refresh::int) over (order by ts, l.request_id) as epoch
  from {_LOG} l join requests r on r.request_id = l.asked),
ranked as (select *, row_number() over (partition by cache_key, epoch order by ts, request_id) as rank, asked % 5 > 0 as leads from keyed),
leader as (select cache_key, epoch, arg_min(request_id, rank) as leader, arg_min(asked, rank) as its, min(rank) as first from ranked where leads group by all),
turns as (select distinct request_id as asked, route_id from segments),
placed as (select leader, cache_key, epoch, first, route_id, row_number() over (partition by leader order by md5('1|' || route_id), route_id) - 1 as turn, count(*) over (partition by leader) as n from leader join turns on turns.asked = its)
select r.request_id, r.cache_key, r.epoch::bigint as epoch, case when p.route_id is null then 'no_route' else 'served' end as status, p.route_id, p.turn
from ranked r left join placed p on p.cache_key = r.cache_key and p.epoch = r.epoch and r.rank >= p.first and (r.rank - p.first) % p.n = p.turn"""


def _asked(spark, sf):
    """Events ask for the routes of a supplier's request; those of every fifth request find none themselves."""
    log = d.read(spark, sf, "events").select(c("event_id").alias("request_id"), F.expr("user_id * 2 div 3").alias("asked"), "ts", (c("event_id") % 997 == 996).alias("refresh"))
    asked = d.requests(spark, sf).select(c("request_id").alias("asked"), geo.route_cache_key(c("start_lon"), c("start_lat"), c("max_gap_m")).alias("cache_key"))
    log = log.join(asked, "asked")
    found = d.segments(spark, sf).select(c("request_id").alias("asked"), "route_id").distinct()
    own = log.filter("asked % 5 > 0").join(found, "asked").select("request_id", "route_id")
    return log.drop("asked"), own


def _served(spark, sf):
    return routes.serve_routes(*_asked(spark, sf))


@add("w5_serve_round_robin", "with requests as (select * from (" + sql("select * from requests", "requests") + ")), segments as (select * from (" + sql("select * from segments", "segments") + "))" + _SERVE.replace("select r.request_id, r.cache_key", "select r.cache_key").replace("r.epoch::bigint as epoch, case when p.route_id is null then 'no_route' else 'served' end as status, p.route_id, p.turn", "p.turn, count(*) as n") + " group by all")
def w5(spark, sf):
    return _served(spark, sf).groupBy("cache_key", "turn").agg(F.count(F.lit(1)).alias("n"))


@add("g8_serve_routes", "with requests as (select * from (" + sql("select * from requests", "requests") + ")), segments as (select * from (" + sql("select * from segments", "segments") + "))" + _SERVE)
def g8(spark, sf):
    return _served(spark, sf)


@add("g8_serve_in_parts", "with requests as (select * from (" + sql("select * from requests", "requests") + ")), segments as (select * from (" + sql("select * from segments", "segments") + "))" + _SERVE)
def g8_parts(spark, sf):
    """The log as two logs, the second from the middle of the time on, with the state that the first leaves."""
    log, own = _asked(spark, sf)
    middle = log.agg(F.timestamp_micros(F.expr("(unix_micros(min(cast(ts as timestamp))) + unix_micros(max(cast(ts as timestamp)))) div 2")).alias("middle"))
    halves = cut(log.join(F.broadcast(middle), F.lit(True)).withColumn("later", c("ts").cast("timestamp") >= c("middle")))
    parts = [halves.filter(c("later") == later).drop("later", "middle") for later in (False, True)]
    found = [cut(own.join(part.select("request_id"), "request_id", "left_semi")) for part in parts]
    state = routes.Rotation(*map(cut, routes.rotation_after(parts[0], found[0])))
    return routes.serve_routes(parts[0], found[0]).unionByName(routes.serve_routes(parts[1], found[1], state))


@add("w6_choose_next_hop", "select src, arg_min(dst, struct_pack(g := is_gap, h := md5('1|0|' || src || '|0|1|' || dst))) as dst from adj group by 1", "adj")
def w6(spark, sf):
    """Walks from every node that are long enough after one hop."""
    g = d.graph(spark, sf)
    starts = g.nodes.select(c("node").alias("request_id"), "node", F.lit(0).alias("cand_ord"), F.lit(d.GAP_M).alias("max_gap_m"), F.lit(0.0).alias("min_distance_m"), F.lit(1.0).alias("max_distance_m"))
    return search.walks(cut(network.neighbors(g.edges)), starts, loop=False, attempts=1).select("src", "dst")


@add("w7_latest_area", "select id, fetched_at from areas", "areas")
def w7(spark, sf):
    return areas.latest_areas(d.area_saves(spark, sf)).select("id", "fetched_at")


@add("t1_shuffle_routes", "select request_id, route_id, row_number() over (partition by request_id order by md5('1|' || route_id), route_id) - 1 as shuffled from (select distinct request_id, route_id from segments)", "segments")
def t1(spark, sf):
    return routes.shuffle_routes(d.segments(spark, sf).select("request_id", "route_id").distinct()).withColumn("shuffled", c("shuffled").cast("long"))


@add("t2_shortest_route", f"select request_id, arg_min(cand_ord, struct_pack(t := total_m, c := cand_ord)) as cand_ord, round(min(total_m), 3) as total_m from {_SIGNED} group by 1", "segments")
def t2(spark, sf):
    best = search.with_signature(search.shortest_route(_steps(spark, sf), F.lit(True)))
    return best.select("request_id", "cand_ord", r3(c("total_m"), "total_m"))


@add("t3_attempts", "select request_id, attempt from requests, (select unnest(range(1, 81)) as attempt)", "requests")
def t3(spark, sf):
    asked = d.requests(spark, sf).withColumns({"node": c("request_id"), "cand_ord": F.lit(0)})
    return search.walkers(asked).select("request_id", c("attempt").cast("long").alias("attempt"))


@add("t4_ordered_segments", "select route_id, string_agg(src, '|' order by seg_idx) as sources from segments group by 1", "segments")
def t4(spark, sf):
    return routes.ordered_segments(d.segments(spark, sf)).select("route_id", F.array_join(F.transform("segments", lambda s: s["src"].cast("string")), "|").alias("sources"))


@add("u1_all_edges", "select edge_id, u, v, is_gap, round(distance_m, 3) as distance_m from edges", "edges")
def u1(spark, sf):
    return d.graph(spark, sf).edges.select("edge_id", "u", "v", "is_gap", r3(c("distance_m"), "distance_m"))


@add("u2_lanes_of_areas", f"select area_id, lane_seq from {_AREA_LANES} where area_id in (select id from areas where {_AGE} < {_WEEK})", "lanes", "areas")
def u2(spark, sf):
    fresh = areas.fresh_areas(areas.latest_areas(d.area_saves(spark, sf)), as_of())
    return areas.lanes_of_areas(fresh, d.area_lanes(spark, sf)).select("area_id", "lane_seq")


@add("u3_route_features", f"select route_id, kind, index, type, len(g) as n_points from ({_FEATURES})", "segments")
def u3(spark, sf):
    return routes.route_features(d.segments(spark, sf)).select("route_id", "kind", "index", "type", F.size("geometry").alias("n_points"))


_LAST = "(select route_id, arg_max(dst, seg_idx) as cur, [arg_min(src, seg_idx)] || list(dst) as met, list(least(src, dst) || '-' || greatest(src, dst)) as used from segments group by 1)"


@add("u4_unvisited", f"select route_id, false as loop, dst from {_LAST} s join adj a on a.src = s.cur where not list_contains(met, dst) union all select route_id, true, dst from {_LAST} s join adj a on a.src = s.cur where not list_contains(used, edge_id)", "segments", "adj")
def u4(spark, sf):
    """What a walker that has come along a route may do next: neighbours that it hasn't met, or that it reaches by edges it hasn't used."""
    path = F.sort_array(F.collect_list(F.struct("seg_idx", "src", "dst", network.edge_id(c("src"), c("dst")).alias("edge_id"), "distance_m", F.lit(False).alias("is_gap"))))
    met = d.segments(spark, sf).groupBy("route_id").agg(path.alias("path"))
    steps = F.transform("path", lambda x: F.struct(*(x[k].alias(k) for k in ("src", "dst", "edge_id", "distance_m", "is_gap"))))
    state = met.select(c("route_id").alias("request_id"), F.lit(0).alias("cand_ord"), F.lit(1).alias("attempt"), F.element_at("path", 1)["src"].alias("start"), F.element_at("path", -1)["dst"].alias("cur"), F.lit(d.GAP_M).alias("max_gap_m"), steps.alias("path"))
    adj = cut(network.neighbors(d.graph(spark, sf).edges))
    hops = [search.unvisited(adj, state, loop).select(c("request_id").alias("route_id"), F.lit(loop).alias("loop"), "dst") for loop in (False, True)]
    return hops[0].unionByName(hops[1])


# Scalar functions


@add("f1_coord_key", f"select lane_seq, {fixed('g[1].lon', 5)} || ',' || {fixed('g[1].lat', 5)} as key, {node('g[1]')} as node from lanes", "lanes")
def f1(spark, sf):
    p = geo.start_of(c("geometry"))
    return d.lanes(spark, sf).select("lane_seq", geo.coord_key(p["lon"], p["lat"]).alias("key"), geo.node_id(geo.cell(p["lon"]), geo.cell(p["lat"])).alias("node"))


@add("f2_bbox_id", "select id, count(*) as n from saves group by 1", "saves")
def f2(spark, sf):
    return d.area_saves(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@add("f3_route_cache_key", f"select request_id, {fixed('start_lon', 3)} || ',' || {fixed('start_lat', 3)} || ',' || cast(max_gap_m as integer) as key from requests", "requests")
def f3(spark, sf):
    return d.requests(spark, sf).select("request_id", geo.route_cache_key(c("start_lon"), c("start_lat"), c("max_gap_m")).alias("key"))


@add("f4_haversine", f"select lane_seq, round({haversine('g[1]', 'g[-1]')}, 3) as metres from lanes", "lanes")
def f4(spark, sf):
    a, b = geo.start_of(c("geometry")), geo.end_of(c("geometry"))
    return d.lanes(spark, sf).select("lane_seq", r3(geo.haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]), "metres"))


@add("f5_equirect", f"select lane_seq, round({equirect('g[1].lon', 'g[1].lat', 'g[-1].lon', 'g[-1].lat')}, 3) as metres from lanes", "lanes")
def f5(spark, sf):
    a, b = geo.start_of(c("geometry")), geo.end_of(c("geometry"))
    return d.lanes(spark, sf).select("lane_seq", r3(geo.equirect_m(a["lon"], a["lat"], b["lon"], b["lat"]), "metres"))


@add("f6_degree_prefilter", f"select lane_seq, {near('g[-1].lon - g[1].lon', 'g[-1].lat - g[1].lat', '120.3')} as near from lanes", "lanes")
def f6(spark, sf):
    a, b = geo.start_of(c("geometry")), geo.end_of(c("geometry"))
    return d.lanes(spark, sf).select("lane_seq", geo.in_degree_box(b["lon"] - a["lon"], b["lat"] - a["lat"], F.lit(120.3)).alias("near"))


@add("f7_orient_geometry", "select lane_seq, round((case when lane_seq % 2 = 0 then g[1] else g[-1] end).lon, 7) as lon from lanes", "lanes")
def f7(spark, sf):
    line = geo.oriented(c("geometry"), c("lane_seq") % 2 == 0)
    return d.lanes(spark, sf).select("lane_seq", F.round(geo.start_of(line)["lon"], 7).alias("lon"))


@add("f8_route_signature", "select route_id, signature from metrics", "metrics")
def f8(spark, sf):
    return routes.route_metrics(d.segments(spark, sf)).select("route_id", "signature")


@add("f9_bbox_dimensions", f"select user_id, round({_WIDTH}, 6) as width_km, round({_HEIGHT}, 6) as height_km from {_WIDE}")
def f9(spark, sf):
    size = geo.bbox_dimensions_km(*map(c, _WSEN))
    return _wide(spark, sf).select("user_id", F.round(size["width_km"], 6).alias("width_km"), F.round(size["height_km"], 6).alias("height_km"))


@add("f10_route_summary", f"select route_id, {fixed('total_m / 1000', 1)} || ' km' as distance_text, cast(floor(case when total_m > 0 then lane_m / total_m else 0 end * 100 + 0.5) as integer) as coverage_percent from metrics", "metrics")
def f10(spark, sf):
    return routes.route_summary(routes.route_metrics(d.segments(spark, sf))).select("route_id", "distance_text", "coverage_percent")


@add("f11_gpx_point", "select lane_seq, '    <trkpt lat=\"' || " + _NUM("g[1].lat") + " || '\" lon=\"' || " + _NUM("g[1].lon") + " || '\"></trkpt>' as point from lanes", "lanes")
def f11(spark, sf):
    return d.lanes(spark, sf).select("lane_seq", geo.track_point(geo.start_of(c("geometry"))).alias("point"))


@add("f12_line_ends", "select lane_seq, round(g[1].lon, 7) as lon1, round(g[-1].lat, 7) as lat2 from lanes", "lanes")
def f12(spark, sf):
    return d.lanes(spark, sf).select("lane_seq", F.round(geo.start_of(c("geometry"))["lon"], 7).alias("lon1"), F.round(geo.end_of(c("geometry"))["lat"], 7).alias("lat2"))


@add("f13_tag", "select ok as feature_seq, name, case t when 1 then 'track' when 3 then 'shared_lane' when 5 then 'opposite_lane' end as cycleway from ways", "ways")
def f13(spark, sf):
    return d.raw_ways(spark, sf).select("feature_seq", geo.tag(c("properties"), "name").alias("name"), geo.tag(c("properties"), "cycleway").alias("cycleway"))


@add("f14_is_closed_route", "select route_id, abs(a.lon - b.lon) < 1e-9 and abs(a.lat - b.lat) < 1e-9 as closed from (select route_id, arg_min(g[1], seg_idx) as a, arg_max(g[-1], seg_idx) as b from segments group by 1)", "segments")
def f14(spark, sf):
    return routes.closed_routes(d.segments(spark, sf)).select("route_id", "closed")


@add("f15_route_node_sequence", "select route_id, array_to_string(list(src order by seg_idx) || [arg_max(dst, seg_idx)], '|') as nodes from segments group by 1", "segments")
def f15(spark, sf):
    return routes.node_sequence(d.segments(spark, sf)).select("route_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), "|").alias("nodes"))


# Searches


@add("g1_build_graph", "select is_gap, count(*) as n_edges, round(sum(distance_m), 1) as metres from edges group by 1", "edges")
def g1(spark, sf):
    """How many lane edges and gap edges there are, and their length."""
    return d.graph(spark, sf).edges.groupBy("is_gap").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("distance_m"), 1).alias("metres"))


_BY_AREA = f"(select *, row_number() over (order by area_id, own) - 1 as lane_seq from (select area_id, l.lane_seq as own, g from {_AREA_LANES} l where area_id in (select id from areas where {_AGE} < {_WEEK})))"


@add("g1_graph_of_areas", f"select edge_id, area_id, lane_seq, u, v, round(distance_m, 3) as distance_m from (select least(u, v) || '-' || greatest(u, v) as edge_id, area_id, lane_seq, u, v, {length_of('g')} as distance_m, row_number() over (partition by least(u, v), greatest(u, v) order by lane_seq) as n from (select *, {node('g[1]')} as u, {node('g[-1]')} as v from {_BY_AREA}) where u <> v) where n = 1", "lanes", "areas")
def g1_areas(spark, sf):
    """The lane edges of all fresh areas' lanes together, though areas overlap: one edge a pair, of the first area's lane."""
    fresh = areas.fresh_areas(areas.latest_areas(d.area_saves(spark, sf)), as_of())
    lanes = cut(areas.in_area_order(areas.lanes_of_areas(fresh, d.area_lanes(spark, sf))))
    edges = network.build_graph(lanes, 0.0).edges
    return edges.join(lanes.select("lane_seq", "area_id"), "lane_seq").select("edge_id", "area_id", "lane_seq", "u", "v", r3(c("distance_m"), "distance_m"))


def _starts(spark, sf, nodes):
    """One start per request, its nearest node."""
    asked = d.requests(spark, sf)
    points = asked.select("request_id", c("start_lon").alias("lon"), c("start_lat").alias("lat"))
    at = requests.nearest_node(points, nodes)
    return at.join(asked.select("request_id", "max_gap_m", "min_distance_m", "max_distance_m"), "request_id").withColumn("cand_ord", F.lit(0))


def _summed(steps):
    rows = search.with_signature(steps)
    return rows.select("request_id", *(c(k).cast("long").alias(k) for k in ("cand_ord", "attempt", "n_segments")), r3(c("total_m"), "total_m"), F.md5("signature").alias("signature"))


def _adj(spark, sf, gap_m=d.GAP_M):
    g = d.graph(spark, sf, gap_m)
    return cut(network.neighbors(g.edges)), cut(g.nodes)


def _recursive(query: str, *tables: str) -> str:
    return sql(query, *tables).replace("with ", "with recursive ", 1)


_AT_NEAREST = f"select n.request_id, n.node, 0 as cand_ord, min_distance_m as mn, max_distance_m as mx from ({_START_NEAREST}) n join requests using (request_id)"


def _walk(name: str, loop: bool, starts: str, adj: str = "hops") -> str:
    """Walks of ``starts`` (request_id, node, cand_ord, mn, mx) over the edges of ``adj`` as a recursive table."""
    new = "not list_contains(w.edges, a.edge_id)" if loop else "not list_contains(w.nodes, a.dst) and w.total < w.mx"
    kept = "total + hop.d <= mx and (hop.dst <> start or total + hop.d >= mn)" if loop else "true"
    done = "hop.dst = start" if loop else "total + hop.d >= mn"
    pick = "arg_min(struct_pack(dst := a.dst, d := a.distance_m, e := a.edge_id), struct_pack(g := a.is_gap, h := md5('1|' || (len(w.nodes) - 1) || '|' || w.request_id || '|' || w.cand_ord || '|' || w.attempt || '|' || a.dst)))"
    return f"""{name} as (
  select request_id, cand_ord, attempt, node as start, node as cur, mn, mx, 0.0::double as total, [node] as nodes, []::varchar[] as edges, false as done from ({starts}), (select unnest(range(1, 81)) as attempt)
  union all
  select request_id, cand_ord, attempt, start, hop.dst, mn, mx, total + hop.d, nodes || [hop.dst], edges || [hop.e], {done}
  from (select w.request_id, w.cand_ord, w.attempt, any_value(w.start) as start, any_value(w.mn) as mn, any_value(w.mx) as mx, any_value(w.total) as total, any_value(w.nodes) as nodes, any_value(w.edges) as edges, {pick} as hop
    from {name} w join {adj} a on a.src = w.cur where not w.done and {new} group by 1, 2, 3)
  where {kept})"""


def _shortest(name: str, ends: str, adj: str = "hops") -> str:
    """Shortest distances and hops to ``ends`` (end_node) within 2500 m as a recursive table."""
    return f"""{name}(end_node, node, way) using key (end_node, node) as (
  select end_node, end_node, struct_pack(dist := 0.0::double, hops := 0) from ({ends})
  union
  select n.end_node, a.dst, min(struct_pack(dist := n.way.dist + a.distance_m, hops := n.way.hops + 1))
  from {name} n join {adj} a on a.src = n.node left join recurring.{name} r on r.end_node = n.end_node and r.node = a.dst
  where n.way.dist + a.distance_m <= 2500 and (r.way is null or n.way.dist + a.distance_m < r.way.dist - 1e-9)
  group by n.end_node, a.dst)"""


_ROUTES_OF = "select request_id, cand_ord::bigint as cand_ord, attempt::bigint as attempt, len(nodes) - 1 as n_segments, round(total, 3) as total_m, md5(array_to_string(nodes[:-2], '|')) as signature from {} where done"
_DISTINCT = "select request_id, cand_ord, attempt, n_segments, total_m, signature from (select *, row_number() over (partition by request_id, signature order by cand_ord, attempt) as n from ({})) where n = 1"
_HOPS = "\n, hops as materialized (select * from adj), "


@add("g2_explore_walks", _recursive(_HOPS + _walk("walk", False, _AT_NEAREST) + "\n" + _ROUTES_OF.format("walk"), "adj", "requests", "nodes"))
def g2(spark, sf):
    adj, nodes = _adj(spark, sf)
    return _summed(search.walks(adj, _starts(spark, sf, nodes), loop=False))


@add("g3_round_trip_walks", _recursive(_HOPS + _walk("walk", True, _AT_NEAREST) + "\n" + _ROUTES_OF.format("walk"), "adj", "requests", "nodes"))
def g3(spark, sf):
    adj, nodes = _adj(spark, sf)
    return _summed(search.walks(adj, _starts(spark, sf, nodes), loop=True))


_END_NEAREST = _START_NEAREST.replace("r.start_lon", "r.end_lon").replace("r.start_lat", "r.end_lat").replace("group by", "where r.end_lon is not null and r.end_lat is not null group by")


@add("g4_shortest_distances", _recursive(_HOPS + _shortest("near", f"select distinct node as end_node from ({_START_NEAREST})") + "\nselect end_node, node, round(min(way.dist), 3) as dist from near group by all", "adj", "requests", "nodes"))
def g4_distances(spark, sf):
    """Shortest distances of all nodes within the requests' 2500 m of the nodes nearest to their starts."""
    adj, nodes = _adj(spark, sf)
    ends = _starts(spark, sf, nodes).select(c("node").alias("end_node"), "max_gap_m", "max_distance_m")
    return search.shortest_trees(adj, ends).select("end_node", "node", r3(c("dist"), "dist"))


@add("g4_shortest_paths", _recursive(_HOPS + f"goals as materialized ({_END_NEAREST}), " + _shortest("near", "select distinct node as end_node from goals") + f"\nselect s.request_id, s.node as src, e.node as dst, round(n.way.dist, 3) as total_m, n.way.hops::bigint as n_segments, 0::bigint as breaks from ({_AT_NEAREST}) s join goals e using (request_id) join near n on n.end_node = e.node and n.node = s.node where s.node <> e.node and n.way.dist between s.mn and s.mx", "adj", "requests", "nodes"))
def g4(spark, sf):
    """The shortest path of each request with an end, from the nearest node; breaks: steps that don't begin where the one before ended."""
    adj, nodes = _adj(spark, sf)
    asked = d.requests(spark, sf)
    ends = requests.nearest_node(asked.filter("end_lon is not null").select("request_id", c("end_lon").alias("lon"), c("end_lat").alias("lat")), nodes)
    starts = _starts(spark, sf, nodes).join(ends.withColumnRenamed("node", "end_node"), "request_id")
    steps = search.shortest_paths(adj, starts).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "src", "dst", "distance_m"))).alias("s"))
    breaks = F.size(F.filter(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: a["dst"] != b["src"]), lambda x: x)).cast("long")
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["distance_m"])
    return steps.select("request_id", F.element_at("s", 1)["src"].alias("src"), F.element_at("s", -1)["dst"].alias("dst"), r3(total, "total_m"), F.size("s").cast("long").alias("n_segments"), breaks.alias("breaks"))


@add("g5_run_walks", _recursive(_HOPS + _walk("walk", False, _AT_NEAREST) + "\n" + _DISTINCT.format(_ROUTES_OF.format("walk")), "adj", "requests", "nodes"))
def g5(spark, sf):
    adj, nodes = _adj(spark, sf)
    return _summed(search.run_walks(adj, _starts(spark, sf, nodes)))


_CANDIDATES = f"select request_id, node, row_number() over (partition by request_id order by node_ord, node) - 1 as cand_ord from (select * from close union all select request_id, node, 0 from ({_START_NEAREST}) where request_id not in (select request_id from close))"
_FROM = lambda where, of="": f"select s.request_id, s.node, s.cand_ord, r.min_distance_m as mn, r.max_distance_m as mx from starts s join requests r using (request_id) {of} where {where}"
_STARTS = f"starts as materialized ({_CANDIDATES}), "


@add("g6_routes_from_candidates", _recursive(_HOPS + _STARTS + _walk("forth", False, _FROM("not r.round_trip")) + ",\n" + _walk("round", True, _FROM("r.round_trip")) + "\n" + _DISTINCT.format(_ROUTES_OF.format("forth") + " union all " + _ROUTES_OF.format("round")), "adj", "requests", "nodes", "close"))
def g6(spark, sf):
    adj, nodes = _adj(spark, sf)
    asked = d.requests(spark, sf).withColumn("end_node", F.lit(None).cast("long")).withColumn("mode", requests.request_mode(c("end_node"), c("round_trip")))
    starts = requests.start_candidates(asked, nodes).join(asked.select("request_id", "mode", "end_node", "max_gap_m", "min_distance_m", "max_distance_m"), "request_id")
    return _summed(search.routes_from_candidates(adj, starts))


_EXPLORE, _ROUND = "r.end_lon is null and not r.round_trip", "r.end_lon is null and r.round_trip"
_ONE_WAY = lambda near, where: f"select s.request_id, s.cand_ord::bigint as cand_ord, 1::bigint as attempt, n.way.hops::bigint as n_segments, round(n.way.dist, 3) as total_m, null::varchar as signature from starts s join requests r using (request_id) join goals e using (request_id) join {near} n on n.end_node = e.node and n.node = s.node where s.node <> e.node and n.way.dist between r.min_distance_m and r.max_distance_m and {where}"
_WIDE_PAIRS = f"select least(a.node, b.node) || '-' || greatest(a.node, b.node) as edge_id, a.node as u, b.node as v, {equirect('a.lon', 'a.lat', 'b.lon', 'b.lat')} as distance_m from nodes a join nodes b on a.node_ord < b.node_ord and {near('a.lon - b.lon', 'a.lat - b.lat', '1000.0')} and {equirect('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1000"
_WIDE_HOPS = f"""wide as materialized (select u as src, v as dst, edge_id, distance_m, is_gap from both_ways union all select v, u, edge_id, distance_m, is_gap from both_ways), """
_BOTH = f"both_ways as materialized (select edge_id, u, v, distance_m, false as is_gap from lane_edges union all select edge_id, u, v, distance_m, true from ({_WIDE_PAIRS}) where edge_id not in (select edge_id from lane_edges)), "
_FIND = (
    _HOPS + _STARTS + f"goals as materialized ({_END_NEAREST}), " + _walk("forth1", False, _FROM(_EXPLORE)) + ",\n" + _walk("round1", True, _FROM(_ROUND)) + ",\n" + _shortest("near1", "select distinct node as end_node from goals") + ",\n"
    + "found1 as materialized (" + _DISTINCT.format(_ROUTES_OF.format("forth1") + " union all " + _ROUTES_OF.format("round1")) + " union all " + _ONE_WAY("near1", "true") + "),\n"
    + "few as materialized (select request_id from requests r left join (select request_id, count(*) as n from found1 group by 1) using (request_id) where coalesce(n, 0) < case when r.end_lon is not null then 1 else 3 end),\n"
    + _BOTH + _WIDE_HOPS + _walk("forth2", False, _FROM(_EXPLORE, "join few using (request_id)"), "wide") + ",\n" + _walk("round2", True, _FROM(_ROUND, "join few using (request_id)"), "wide") + ",\n"
    + _shortest("near2", "select distinct node as end_node from goals join few using (request_id)", "wide") + ",\n"
    + "found2 as (" + _DISTINCT.format(_ROUTES_OF.format("forth2") + " union all " + _ROUTES_OF.format("round2")) + " union all " + _ONE_WAY("near2", "request_id in (select request_id from few)") + "),\n"
    + f"found as (select *, {d.GAP_M}::double as gap_m from found1 where request_id not in (select request_id from few) union all select *, 1000.0::double from found2)\n"
    + "select * from found where signature is not null union all select * exclude (n) from (select *, row_number() over (partition by request_id order by total_m, cand_ord) as n from found where signature is null) where n = 1"
)


@add("g7_find_routes", _recursive(_FIND, "adj", "requests", "nodes", "close", "lane_edges"))
def g7(spark, sf):
    """Routes of all requests, with the tolerance at which they were found; one-way routes without signature."""
    found = search.find_routes(d.graph(spark, sf), d.requests(spark, sf))
    about = found.groupBy("request_id").agg(F.first("gap_m").alias("gap_m"), F.first("mode").alias("mode"))
    return _summed(found).join(about, "request_id").withColumn("signature", F.when(c("mode") != "one_way", c("signature"))).drop("mode")


def single(adj: DataFrame, starts: DataFrame) -> DataFrame:
    hops = starts.join(adj, c("node") == c("src")).filter("not is_gap")
    order = Window.partitionBy("request_id", "cand_ord").orderBy("edge_id")
    return hops.select("request_id", "cand_ord", F.row_number().over(order).alias("attempt"), F.lit(0).alias("seg_idx"), "src", "dst", "edge_id", "distance_m", "is_gap")


@add("x1_register_strategy", _recursive(f"\n, first as (select s.request_id, min(a.edge_id) as edge_id from ({_START_NEAREST}) s join adj a on a.src = s.node and not a.is_gap group by 1)\nselect f.request_id, 0::bigint as cand_ord, 1::bigint as attempt, 1::bigint as n_segments, round(e.distance_m, 3) as total_m, md5(cast(n.node as varchar)) as signature from first f join edges e using (edge_id) join ({_START_NEAREST}) n using (request_id)", "adj", "requests", "nodes"))
def x1(spark, sf):
    """A strategy of the caller's own: each lane edge at a start is a route, the first one stays, as all begin at one node."""
    adj, nodes = _adj(spark, sf)
    strategies = search.register_strategy("single", single)
    return _summed(search.routes_from_candidates(adj, _starts(spark, sf, nodes).withColumn("mode", F.lit("single")), strategies))


_CANDIDATES = f"select request_id, node, row_number() over (partition by request_id order by node_ord, node) - 1 as cand_ord from (select * from close union all select request_id, node, 0 from ({_START_NEAREST}) where request_id not in (select request_id from close))"


@add("x1_modes_of_requests", f"select request_id, c.cand_ord, md5(cast(node as varchar)) as signature, round(distance_m, 3) as total_m, case when count(*) over (partition by request_id) < 3 then 1000.0 else {d.GAP_M} end as gap_m from ({_CANDIDATES}) c join (select src, arg_min(distance_m, edge_id) as distance_m from adj where not is_gap group by src) on src = node where request_id % 4 = 1", "close", "adj")
def x1_modes(spark, sf):
    """Whole requests, some of a mode of the caller's own, others of one without a strategy, which have no routes."""
    asked = d.requests(spark, sf).withColumn("mode", F.when(c("request_id") % 4 == 1, "single").otherwise("unknown"))
    found = search.find_routes(d.graph(spark, sf), asked, search.register_strategy("single", single))
    return found.select("request_id", "cand_ord", F.md5(c("src").cast("string")).alias("signature"), r3(c("distance_m"), "total_m"), "gap_m")


# Checks


@add("v1_route_violations", "select request_id, route_id, array_to_string(list_filter([case when total_m < min_distance_m - 1e-6 or (mode <> 'explore' and total_m > max_distance_m + 1e-6) then 'bounds' end, case when lane_m <= 0 then 'no_lane' end, case when mode = 'round_trip' and not closed then 'not_closed' end], lambda x: x is not null), ',') as broken from (select m.*, r.min_distance_m, r.max_distance_m, case when r.end_lon is not null then 'one_way' when r.round_trip then 'round_trip' else 'explore' end as mode, abs(f.a.lon - f.b.lon) < 1e-9 and abs(f.a.lat - f.b.lat) < 1e-9 as closed from metrics m join requests r using (request_id) join (select route_id, arg_min(g[1], seg_idx) as a, arg_max(g[-1], seg_idx) as b from segments group by 1) f using (route_id)) where broken <> ''", "metrics", "requests")
def v1(spark, sf):
    asked = d.requests(spark, sf).withColumn("mode", requests.request_mode(c("end_lon"), c("round_trip")))
    return routes.route_violations(d.segments(spark, sf), asked).withColumn("broken", F.array_join("broken", ","))


@add("v2_scenario_report", "select r.request_id, n >= 12 and n <= 15 and (r.request_id % 2 = 0) = (most > 0) and most <= 2 as ok from requests r join (select request_id, count(*) as n, max(gap_count) as most from metrics group by 1) m on m.request_id = r.request_id", "metrics", "requests")
def v2(spark, sf):
    s = d.segments(spark, sf)
    want = d.requests(spark, sf).select("request_id", F.lit(12).alias("min_routes"), F.lit(15).alias("max_routes"), F.lit(None).cast("double").alias("min_coverage"), (c("request_id") % 2 == 0).alias("has_gap"), F.lit(2).alias("max_gaps"), F.lit(None).cast("array<array<string>>").alias("routes"), F.lit(None).cast("array<array<string>>").alias("any_route"))
    named = routes.node_sequence(s).select("request_id", F.transform("nodes", lambda x: x.cast("string")).alias("nodes"))
    return routes.scenario_report(routes.route_metrics(s), named, want).select("request_id", "ok")
