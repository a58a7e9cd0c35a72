"""Trips a week per route, and their change between feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.operators import service as S
from transitlapse.operators.diff import PAIR, route_entry_members
from transitlapse.operators.numbering import nearest_rank
from transitlapse.operators.registry import Registry
from transitlapse.schema import Feeds


def _drawn_routes(feeds: Feeds) -> DataFrame:
    """Routes with at least one drawable shape."""
    shapes = S.shape_points(feeds).select("feed_id", "shape_id").distinct()
    return feeds.trips.where("shape_id IS NOT NULL").select("feed_id", "route_id", "shape_id").distinct().join(
        shapes, ["feed_id", "shape_id"], "left_semi").select("feed_id", "route_id").distinct()


def _drawn_weekly(feeds: Feeds) -> DataFrame:
    routes = feeds.routes.select("feed_id", "route_id").distinct()
    return (
        routes.join(_drawn_routes(feeds), ["feed_id", "route_id"], "left_semi")
        .join(S.route_weekly_trips(feeds), ["feed_id", "route_id"], "left")
        .select("feed_id", "route_id", F.coalesce("trips_per_week", F.lit(0.0)).alias("trips_per_week"))
    )


def frequency_scale(feeds: Feeds) -> DataFrame:
    return nearest_rank(_drawn_weekly(feeds), ["feed_id"], "trips_per_week")


def feed_frequency(feeds: Feeds) -> DataFrame:
    """Trips a week per drawn route, on the feed's own scale, with its fixed class."""
    scaled = _drawn_weekly(feeds).join(frequency_scale(feeds), "feed_id")
    unit = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    return scaled.select(
        "feed_id", "route_id", "trips_per_week", F.col("top").alias("max_weekly"), F.col("scale").alias("scale_weekly"),
        M.clamp(F.col("trips_per_week") / unit, 0.0, 1.0).alias("trips_norm"),
        M.step_class(F.col("trips_per_week"), M.FREQUENCY_BREAKS).alias("class"))


def frequency_diff(feeds: Feeds, registry: Registry, routes: DataFrame) -> DataFrame:
    """Weekly trips of each diffed line on both sides; lines without any drawable shape are left out."""
    raws = route_entry_members(registry, routes).withColumnRenamed("raw_id", "route_id")
    drawn = _drawn_routes(feeds).withColumn("drawn", F.lit(1))
    per = (
        raws.join(S.route_weekly_trips(feeds), ["feed_id", "route_id"], "left")
        .join(drawn, ["feed_id", "route_id"], "left")
        .withColumn("w", F.coalesce("trips_per_week", F.lit(0.0)))
    )
    on = lambda s: F.sum(F.when(F.col("side") == s, F.col("w")).otherwise(0.0))
    sums = per.groupBy(*PAIR, "entry_id").agg(
        on("a").alias("trips_a"), on("b").alias("trips_b"), F.max("drawn").alias("drawn"))
    names = registry.canonical_routes.select(
        F.col("canonical_id").alias("shown_id"), "short_name", "long_name", "mode")
    return (
        routes.withColumn("shown_id", F.coalesce("to_id", "canonical_id")).join(names, "shown_id")
        .withColumnRenamed("canonical_id", "entry_id").join(sums.where("drawn = 1"), [*PAIR, "entry_id"])
        .select(*PAIR, F.col("entry_id").alias("canonical_id"), "short_name", "long_name", "mode", "status",
                "trips_a", "trips_b", (F.col("trips_b") - F.col("trips_a")).alias("delta"))
    )


def with_change_scale(diff: DataFrame) -> DataFrame:
    """Add the pair's scale, normalised and relative change, and both fixed classes."""
    c = F.col
    scale = nearest_rank(diff.withColumn("abs_delta", F.abs("delta")), PAIR, "abs_delta")
    unit = F.when(c("scale") > 0, c("scale")).otherwise(F.lit(1.0))
    raw = F.when(c("trips_a") > 0, c("delta") / c("trips_a")).when(c("trips_b") > 0, F.lit(3.0)).otherwise(F.lit(0.0))
    return (
        diff.join(scale, PAIR).withColumn("delta_norm", M.clamp(c("delta") / unit, -1.0, 1.0))
        .withColumn("percent_delta", M.clamp(raw, -1.0, 3.0))
        .withColumn("relative_class", M.step_class(c("percent_delta"), M.FREQUENCY_PERCENT_BREAKS))
        .withColumn("absolute_class", M.step_class(c("delta"), M.FREQUENCY_DELTA_BREAKS))
        .withColumnRenamed("top", "max_abs_delta").withColumnRenamed("scale", "scale_abs_delta").drop("p_value")
    )


def matched_only(diff: DataFrame) -> DataFrame:
    """Without lines that exist on one side only; rescale afterwards with ``with_change_scale``."""
    return diff.where(~F.col("status").isin("added", "removed"))
