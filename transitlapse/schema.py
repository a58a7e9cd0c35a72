"""Canonical table layouts: one table per GTFS file for all feeds, text at rest, typed late."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eight files a feed may carry, and the columns the operators read from each.
# ``stop_times`` and ``shapes`` are stored with exactly these columns; the other files keep all theirs.
STEM_COLUMNS: dict[str, list[str]] = {
    "agency": ["agency_id", "agency_name"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["trip_id", "route_id", "service_id", "direction_id", "trip_headsign", "shape_id"],
    "stop_times": ["stop_id", "trip_id", "stop_sequence", "departure_time"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
                 "sunday", "start_date", "end_date"],
    "shapes": ["shape_id", "shape_pt_lon", "shape_pt_lat", "shape_pt_sequence"],
    "feed_info": ["feed_start_date", "feed_end_date"],
}
NARROW_STEMS = ("stop_times", "shapes")
REQUIRED_STEMS = ("stops", "routes", "trips")
WEEKDAYS = STEM_COLUMNS["calendar"][1:8]


def stem_schema(stem: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in ["feed_id", *STEM_COLUMNS[stem]]])


def conform(df: DataFrame, stem: str, keep_extra: bool = False) -> DataFrame:
    """Give ``df`` every canonical column of ``stem`` as text, absent ones as null."""
    have = set(df.columns)
    wanted = ["feed_id", *STEM_COLUMNS[stem]]
    cols = [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in wanted]
    if keep_extra and stem not in NARROW_STEMS:
        cols += [F.col(c).cast("string").alias(c) for c in df.columns if c not in wanted]
    return df.select(*cols)


@dataclass
class Feeds:
    """All feeds of a workspace.

    ``feeds``: one row per release (feed_id, source_name, loaded_at in epoch ms).
    ``files``: which file and which columns each release really had (feed_id, stem, columns array).
    The other members are the GTFS tables, all feeds together.
    """

    feeds: DataFrame
    files: DataFrame
    agency: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    calendar: DataFrame
    shapes: DataFrame
    feed_info: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.feeds.sparkSession


def capabilities(files: DataFrame) -> DataFrame:
    """One row per feed saying which optional files and columns it has."""
    def has(stem: str) -> Column:
        return F.coalesce(F.bool_or(F.col("stem") == stem), F.lit(False))

    def has_col(stem: str, column: str) -> Column:
        return F.coalesce(
            F.bool_or((F.col("stem") == stem) & F.array_contains("columns", column)), F.lit(False))

    return files.groupBy("feed_id").agg(
        has("agency").alias("has_agency"),
        has("stops").alias("has_stops"),
        has("routes").alias("has_routes"),
        has("trips").alias("has_trips"),
        has("stop_times").alias("has_stop_times"),
        has("calendar").alias("has_calendar"),
        has("shapes").alias("has_shapes"),
        has("feed_info").alias("has_feed_info"),
        has_col("routes", "agency_id").alias("has_agency_id"),
        has_col("routes", "route_short_name").alias("has_short_name"),
        has_col("routes", "route_long_name").alias("has_long_name"),
        has_col("trips", "direction_id").alias("has_direction_id"),
        has_col("trips", "trip_headsign").alias("has_headsign"),
        has_col("trips", "shape_id").alias("has_shape_id"),
        has_col("stop_times", "departure_time").alias("has_departure_time"),
    )
