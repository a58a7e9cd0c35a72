"""GeoJSON feature rows, one JSON text per feature, written as lines or collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlapse.functions.geo import fixed
from transitlapse.functions.modes import mode_flags
from transitlapse.operators.geometry import coords_json


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":['), fixed(lon), F.lit(","), fixed(lat), F.lit("]}"))


def line_geometry(coords: Column) -> Column:
    return F.concat(F.lit('{"type":"LineString","coordinates":'), coords_json(coords), F.lit("}"))


def feature(geometry: Column, **properties: Column) -> Column:
    props = F.to_json(F.struct(*[v.alias(k) for k, v in properties.items()]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}"))


def stop_features(stops: DataFrame) -> DataFrame:
    """Point features of ``stop_modes`` rows."""
    flags = {f"is_{m}": c for m, c in zip(("rail", "metro", "tram", "bus", "other"), mode_flags(F.col("modes")))}
    return stops.select("feed_id", "stop_id", feature(
        point_geometry(F.col("lon"), F.col("lat")), stop_id=F.col("stop_id"), stop_name=F.col("stop_name"),
        primary_mode=F.col("primary_mode"), **flags).alias("feature"))


def shape_features(shapes: DataFrame) -> DataFrame:
    """LineString features of ``shape_modes`` rows."""
    flags = {f"is_{m}": c for m, c in zip(("rail", "metro", "tram", "bus", "other"), mode_flags(F.col("modes")))}
    return shapes.select("feed_id", "shape_id", feature(
        line_geometry(F.col("coords")), shape_id=F.col("shape_id"), primary_mode=F.col("primary_mode"),
        **flags).alias("feature"))


def write_features(df: DataFrame, path: str) -> None:
    """One feature per line (newline-delimited GeoJSON)."""
    df.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
