"""Readers of map extracts and writers of lanes and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .documents import read_elements

POINTS = "array<struct<lon: double, lat: double>>"
WAY = "struct<type: string, id: bigint, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>"
FEATURE = "struct<geometry: string, properties: map<string, string>>"
FEATURES = f"features array<{FEATURE}>"


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways of JSON extracts (``elements`` with inline geometry) as features; large documents are read by several tasks.

    feature_seq is the way's id, since an extract has no order of its own. A way that several extracts
    hold comes once for each.
    """
    rows = read_elements(spark, path, "elements").select(F.from_json("element", WAY).alias("e"))
    points = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    tags = F.map_concat(F.create_map(F.lit("id"), F.concat(F.lit("way/"), F.col("e.id").cast("string"))), F.map_filter(F.coalesce("e.tags", F.create_map().cast("map<string,string>")), lambda k, v: k != "id"))
    return rows.filter("e.type = 'way'").select(F.col("e.id").alias("feature_seq"), F.lit("LineString").alias("geometry_type"), points.alias("geometry"), tags.alias("properties"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of the collections in files, a folder or a pattern; large documents are read by several tasks.

    feature_seq counts from 0 over all files in the order of their paths and of the features in them, as
    if they were one collection.
    """
    return _features(read_elements(spark, path, "features").select(F.col("seq").alias("feature_seq"), F.from_json("element", FEATURE).alias("f")))


def features_of(collections: DataFrame) -> DataFrame:
    """The features of collections that are read already, such as those of a stream; feature_seq counts within each."""
    return _features(collections.select(F.posexplode("features").alias("feature_seq", "f")))


def _features(rows: DataFrame) -> DataFrame:
    kind = F.get_json_object("f.geometry", "$.type")
    lines = F.from_json(F.when(kind == "LineString", F.get_json_object("f.geometry", "$.coordinates")), "array<array<double>>")
    points = F.transform(lines, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return rows.select(F.col("feature_seq").cast("long").alias("feature_seq"), kind.alias("geometry_type"), points.alias("geometry"), F.col("f.properties").alias("properties"))


def filter_linestrings(features: DataFrame) -> DataFrame:
    return features.filter("geometry_type = 'LineString' and geometry is not null")


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(geo.tag(tags, key).isin(*values), F.lit(False))


def is_bike_way(tags: Column) -> Column:
    """Whether any of the five tag rules holds."""
    return (
        _is(tags, "highway", "cycleway")
        | _is(tags, "cycleway", "lane", "track", "shared_lane", "opposite_lane", "opposite_track")
        | _is(tags, "cycleway:left", "lane", "track")
        | _is(tags, "cycleway:right", "lane", "track")
        | _is(tags, "bicycle", "designated") & _is(tags, "highway", "path", "track", "footway")
    )


def filter_bike_ways(ways: DataFrame, tags: str = "properties") -> DataFrame:
    return ways.filter(is_bike_way(F.col(tags)))


def box_of(line: Column) -> Column:
    """struct<west, south, east, north> around a polyline."""
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def meets_box(line: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a vertex lies in the box (edges included) or a leg crosses it."""
    inside = F.exists(line, lambda p: p["lon"].between(west, east) & p["lat"].between(south, north))
    legs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(leg: Column) -> Column:
        """Both ends of the leg's clipped parameter range exist: the slab test."""
        a, b = leg["a"], leg["b"]
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        low, high = [F.lit(0.0)], [F.lit(1.0)]
        fits = F.lit(True)
        for start, d, lo, hi in ((a["lon"], dx, west, east), (a["lat"], dy, south, north)):
            one, two = F.when(d != 0, (lo - start) / F.nullif(d, F.lit(0.0))), F.when(d != 0, (hi - start) / F.nullif(d, F.lit(0.0)))
            low.append(F.coalesce(F.least(one, two), F.lit(0.0)))
            high.append(F.coalesce(F.greatest(one, two), F.lit(1.0)))
            fits = fits & ((d != 0) | start.between(lo, hi))
        return fits & (F.greatest(*low) <= F.least(*high))

    return inside | (F.size(line) > 1) & F.exists(legs, crosses)


def filter_bbox(ways: DataFrame, west: float, south: float, east: float, north: float, geometry: str = "geometry") -> DataFrame:
    box, edges = box_of(F.col(geometry)), [F.lit(float(x)) for x in (west, south, east, north)]
    overlap = (box["west"] <= edges[2]) & (box["east"] >= edges[0]) & (box["south"] <= edges[3]) & (box["north"] >= edges[1])
    return ways.filter(overlap & meets_box(F.col(geometry), *edges))


def to_lanes(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lanes of line features, with the columns ``keep`` of theirs. Lines with fewer than two vertices or null coordinates are left out."""
    tags = F.col("properties")
    whole = (F.size("geometry") >= 2) & ~F.exists("geometry", lambda p: p["lon"].isNull() | p["lat"].isNull())
    osm_id = F.coalesce(geo.tag(tags, "id"), geo.tag(tags, "@id"), F.lit(""))
    rows = filter_linestrings(features).filter(whole)
    return rows.select(
        F.md5(F.concat_ws("#", osm_id, F.col("feature_seq").cast("string"))).alias("id"), osm_id.alias("osm_id"), F.col("feature_seq").alias("lane_seq"), "geometry",
        geo.lane_type(tags).alias("lane_type"), geo.tag(tags, "name").alias("name"), geo.tag(tags, "surface").alias("surface"), tags.alias("tags"), *keep,
    )


def line_json(line: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def lanes_to_geojson(lanes: DataFrame) -> DataFrame:
    """lane_seq, feature: one GeoJSON feature a row; name is null where absent."""
    properties = F.struct(F.col("osm_id").alias("id"), F.col("lane_type").alias("laneType"), "name")
    feature = F.struct(F.lit("Feature").alias("type"), line_json(F.col("geometry")).alias("geometry"), properties.alias("properties"))
    return lanes.select("lane_seq", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
