"""Snapshots of areas: areas (id, west, south, east, north, fetched_at) and area_lanes (area_id and the lane's columns)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.order import running_sum
from . import osm

STALE_AFTER_MS = 7 * 24 * 60 * 60 * 1000
MOST_KM = 50.0
#: Levels of the grids on which ways and boxes meet; the coarsest has cells wider than any map.
LEVELS = 12


def latest_areas(areas: DataFrame) -> DataFrame:
    """The last saved snapshot of each id."""
    best = F.max_by(F.struct(*areas.columns), F.struct("fetched_at", F.xxhash64(*areas.columns)))
    return areas.groupBy("id").agg(best.alias("a")).select("a.*")


def save_areas(old: DataFrame, new: DataFrame, path: str) -> None:
    """Upsert by id into a new folder."""
    latest_areas(old.unionByName(new)).write.mode("errorifexists").parquet(path)


def load_area(spark: SparkSession, path: str, area_id: str) -> DataFrame:
    return load_all_areas(spark, path).filter(F.col("id") == area_id)


def load_all_areas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def age_ms(as_of: Column) -> Column:
    return F.unix_millis(as_of) - F.unix_millis(F.col("fetched_at"))


def is_area_stale(as_of: Column) -> Column:
    return age_ms(as_of) > STALE_AFTER_MS


def fresh_areas(areas: DataFrame, as_of: Column) -> DataFrame:
    """Areas younger than seven days; one of just that age is neither fresh nor stale."""
    return areas.filter(age_ms(as_of) < STALE_AFTER_MS)


def prune_stale_areas(areas: DataFrame, area_lanes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    kept = areas.filter(~is_area_stale(as_of))
    return kept, area_lanes.join(kept.select(F.col("id").alias("area_id")), "area_id", "left_semi")


def area_too_large(west: Column, south: Column, east: Column, north: Column) -> Column:
    size = geo.bbox_dimensions_km(west, south, east, north)
    return (size["width_km"] > MOST_KM) | (size["height_km"] > MOST_KM)


def split_cached(requested: DataFrame, areas: DataFrame, force_refresh: bool = False) -> DataFrame:
    """``requested`` (id, ...) with cached: whether a snapshot exists; all miss if forced."""
    if force_refresh:
        return requested.withColumn("cached", F.lit(False))
    known = areas.select("id").distinct().withColumn("__known", F.lit(True))
    return requested.join(known, "id", "left").withColumn("cached", F.coalesce("__known", F.lit(False))).drop("__known")


def cover(box: dict[str, Column], cell: float) -> tuple[Column, Callable[[Column], Column]]:
    """The finest level at which a box lies in at most four by four cells, and the cells (x, y) that it touches on a level.

    Cells are ``cell`` degrees wide on level 0 and four times as wide on each further one.
    """
    at = lambda x, level: F.floor(x / (F.lit(cell) * F.pow(F.lit(4.0), level))).cast("long")
    wide = lambda k: F.greatest(*(at(box[high], F.lit(k)) - at(box[low], F.lit(k)) for low, high in (("west", "east"), ("south", "north")))) > 3
    finest = F.coalesce(*(F.when(~wide(k), F.lit(k)) for k in range(LEVELS)))
    along = lambda low, high, level: F.sequence(at(box[low], level), at(box[high], level))
    cells = lambda level: F.flatten(F.transform(along("west", "east", level), lambda x: F.transform(along("south", "north", level), lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))
    return finest, cells


def extract_areas(ways: DataFrame, boxes: DataFrame, cell: float = 0.05) -> DataFrame:
    """area_id and the way's columns for each way that meets a box (id, west, south, east, north).

    Ways and boxes lie on grids of several levels, each in at most sixteen cells of the finest level that
    allows it, and are copied to the coarser levels on which the other table has rows. So a way across a
    continent makes tens of rows, and a way and a box meet on the coarser one's level, at the first cell
    that they share.
    """
    sides = ["west", "south", "east", "north"]
    named = boxes.select(F.col("id").alias("area_id"), *(F.col(c).alias(f"b_{c}") for c in sides))
    b = {c: F.col(f"b_{c}") for c in sides}
    own = {c: F.col(f"__box.{c}") for c in sides}
    way_level, way_cells = cover(own, cell)
    box_level, box_cells = cover(b, cell)
    left = ways.withColumn("__box", osm.box_of(F.col("geometry"))).withColumn("__way_level", way_level)
    right = named.withColumn("__box_level", box_level)
    # at most LEVELS numbers; a level that the other table doesn't use needs no copies
    used = lambda rows, c: F.array(*(F.lit(k) for k in sorted(r[0] for r in rows.select(c).distinct().collect() if r[0] is not None))).cast("array<int>")
    of_ways, of_boxes = used(left, "__way_level"), used(right, "__box_level")
    spread = lambda rows, c, others, cells: rows.select("*", F.explode(F.flatten(F.transform(F.array_distinct(F.concat(F.array(F.col(c)), F.filter(others, lambda k: k > F.col(c)))), cells))).alias("__c")).select("*", "__c.*").drop("__c")
    left, right = spread(left, "__way_level", of_boxes, way_cells), spread(right, "__box_level", of_ways, box_cells)
    left, right = (t.withColumnsRenamed({"level": "__level", "x": "__x", "y": "__y"}) for t in (left, right))
    at = lambda x: F.floor(x / (F.lit(cell) * F.pow(F.lit(4.0), F.col("__level")))).cast("long")
    first = (F.col("__x") == at(F.greatest(own["west"], b["west"]))) & (F.col("__y") == at(F.greatest(own["south"], b["south"])))
    overlap = (own["west"] <= b["east"]) & (own["east"] >= b["west"]) & (own["south"] <= b["north"]) & (own["north"] >= b["south"])
    once = F.col("__level") == F.greatest("__way_level", "__box_level")
    pairs = left.join(right, ["__level", "__x", "__y"]).filter(once & overlap & first)
    return pairs.filter(osm.meets_box(F.col("geometry"), *b.values())).select("area_id", *ways.columns)


def lanes_of_areas(areas: DataFrame, area_lanes: DataFrame, dedupe_ways: bool = False) -> DataFrame:
    """Lanes of all given areas, one after another; lanes of several areas come once for each unless deduped by osm_id."""
    lanes = area_lanes.join(areas.select(F.col("id").alias("area_id")), "area_id", "left_semi")
    if not dedupe_ways:
        return lanes
    row = F.row_number().over(Window.partitionBy("osm_id").orderBy("lane_seq", "area_id"))
    return lanes.withColumn("__row", row).filter("__row = 1").drop("__row")


def in_area_order(lanes: DataFrame) -> DataFrame:
    """``lanes`` of areas with lane_seq counted from 0 over all areas: by area id, then by their own lane_seq.

    This is the order of one list of lanes made of the areas' lists, which tells which of parallel lanes is an edge.
    """
    placed = running_sum(lanes.withColumn("__own", F.col("lane_seq")).withColumn("__hash", F.xxhash64("geometry", "lane_type")), ["area_id", "__own", "__hash"], F.lit(1), "__place")
    return placed.withColumn("lane_seq", F.col("__place") - 1).drop("__own", "__hash", "__place")


def lane_counts(area_lanes: DataFrame) -> DataFrame:
    return area_lanes.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_lanes"))


def cell_degrees(metres: float) -> tuple[float, float]:
    """Longitude and latitude size of grid cells of which a node's nine hold all nodes within so many metres."""
    return 3 * metres / 111_000.0, math.nextafter(metres / 111_000.0, math.inf)
