"""Lanes from a stream of features, by the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import osm


def stream_lanes(features: DataFrame) -> DataFrame:
    """Bike lanes of a streaming DataFrame of features; row by row, so without state."""
    return osm.to_lanes(osm.filter_bike_ways(features))
