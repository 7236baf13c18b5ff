"""Column expressions on coordinates, polylines, tags and routes. Geometry is array<struct<lon double, lat double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEAN_RADIUS_M = 6_371_008.8
FLAT_RADIUS_M = 6_371_000.0
CELL = 100_000  # cells per degree


def cell(degrees: Column) -> Column:
    """Index of the 1e-5 degree grid line nearest to a coordinate."""
    return F.floor(degrees * CELL + 0.5).cast("long")


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, halves rounded up."""
    power = float(10**digits)
    return F.format_string(f"%.{digits}f", F.floor(x * power + 0.5) / power)


def coord_key(lon: Column, lat: Column) -> Column:
    return F.concat_ws(",", fixed(lon, 5), fixed(lat, 5))


def node_id(cx: Column, cy: Column) -> Column:
    """One long for a pair of cells."""
    return (cx + 18_000_000) * (1 << 25) + cy + 9_000_000


def bbox_id(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.concat_ws(",", *(fixed(c, 3) for c in (west, south, east, north)))


def route_cache_key(lon: Column, lat: Column, max_gap: Column) -> Column:
    return F.concat_ws(",", fixed(lon, 3), fixed(lat, 3), max_gap.cast("int").cast("string"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def line_length_m(line: Column) -> Column:
    """Great-circle metres along a polyline, leg after leg; 0 for fewer than two vertices."""
    n = F.size(line)
    legs = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def equirect_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Flat approximation with the cosine of the mean latitude."""
    dlon = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return FLAT_RADIUS_M * F.sqrt(F.pow(F.radians(lat2 - lat1), 2) + F.pow(dlon, 2))


def near_degrees(metres: Column) -> Column:
    """Latitude degrees of the prefilter for a distance; longitudes may differ by twice as many."""
    return metres / 111_000.0 * 1.5


def in_degree_box(dlon: Column, dlat: Column, metres: Column) -> Column:
    return (F.abs(dlat) <= near_degrees(metres)) & (F.abs(dlon) <= near_degrees(metres) * 2)


def start_of(line: Column) -> Column:
    return F.element_at(line, 1)


def end_of(line: Column) -> Column:
    return F.element_at(line, -1)


def oriented(line: Column, same_way: Column) -> Column:
    return F.when(same_way, line).otherwise(F.reverse(line))


def tag(tags: Column, key: str) -> Column:
    """A tag's value, null where missing."""
    return F.try_element_at(tags, F.lit(key))


def lane_type(tags: Column) -> Column:
    """cycleway, track, lane, shared or path, by the first rule that holds."""
    way = [tag(tags, k) for k in ("cycleway", "cycleway:left", "cycleway:right")]
    has = lambda v: F.coalesce(F.greatest(*(F.coalesce(w == v, F.lit(False)) for w in way)), F.lit(False))
    return F.when(tag(tags, "highway") == "cycleway", "cycleway").when(has("track"), "track").when(has("lane"), "lane").when(way[0] == "shared_lane", "shared").otherwise("path")


def bbox_dimensions_km(west: Column, south: Column, east: Column, north: Column) -> Column:
    """struct<width_km, height_km> with the cosine of the mean latitude."""
    width = F.radians(east - west) * 6371.0 * F.cos(F.radians((south + north) / 2))
    return F.struct(width.alias("width_km"), (F.radians(north - south) * 6371.0).alias("height_km"))


def signature(lines: Column) -> Column:
    """First vertices of a route's segments as text; the last segment's end isn't part of it."""
    return F.array_join(F.transform(lines, lambda g: F.concat_ws(",", g[0]["lon"].cast("string"), g[0]["lat"].cast("string"))), "|")


def number_text(x: Column) -> Column:
    """Shortest decimal text without trailing zeros."""
    return F.regexp_replace(x.cast("decimal(12,9)").cast("string"), r"\.?0+$", "")


def track_point(p: Column) -> Column:
    return F.concat(F.lit('    <trkpt lat="'), number_text(p["lat"]), F.lit('" lon="'), number_text(p["lon"]), F.lit('"></trkpt>'))


def xml_text(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_closed(line_first: Column, line_last: Column, tolerance: float = 1e-9) -> Column:
    return (F.abs(line_first["lon"] - line_last["lon"]) < tolerance) & (F.abs(line_first["lat"] - line_last["lat"]) < tolerance)
