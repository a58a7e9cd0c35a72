"""Single-feed lookups computed for all feeds at once: modes, lines, directions, weekly service, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions import text as X
from transitlapse.functions.geo import haversine_m
from transitlapse.schema import WEEKDAYS, Feeds, capabilities
from transitlapse.session import cut_lineage


def typed_stops(feeds: Feeds) -> DataFrame:
    return (
        feeds.stops.select(
            "feed_id", "stop_id", F.coalesce("stop_name", F.lit("")).alias("stop_name"),
            F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon"))
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


def typed_routes(feeds: Feeds) -> DataFrame:
    """Routes with agency name, integer type and mode.

    A feed whose routes file has no agency column takes its one agency (smallest id when it lists several).
    """
    only = feeds.agency.groupBy("feed_id").agg(
        F.min_by("agency_name", F.coalesce("agency_id", F.lit(""))).alias("only_agency"))
    caps = capabilities(feeds.files).select("feed_id", "has_agency_id")
    agency = feeds.agency.select("feed_id", "agency_id", F.col("agency_name").alias("own_agency"))
    return (
        feeds.routes.join(caps, "feed_id", "left")
        .join(only, "feed_id", "left")
        .join(agency, ["feed_id", "agency_id"], "left")
        .select(
            "feed_id", "route_id", F.col("route_short_name").alias("short_name"),
            F.col("route_long_name").alias("long_name"), "agency_id",
            F.when(F.col("has_agency_id"), F.col("own_agency")).otherwise(F.col("only_agency")).alias("agency_name"),
            F.col("route_type").try_cast("int").alias("route_type"))
        .withColumn("mode", M.route_mode(F.col("route_type")))
    )


def _route_types(feeds: Feeds) -> DataFrame:
    return feeds.routes.select(
        "feed_id", "route_id", F.col("route_type").try_cast("int").alias("route_type")
    ).where("route_type IS NOT NULL").select("feed_id", "route_id", M.route_mode(F.col("route_type")).alias("mode"))


def stop_modes(feeds: Feeds) -> DataFrame:
    """Every located stop with the modes of the routes calling there and the most important of them.

    Trips know their mode before calls are sent, so that a stop's calls are reduced to its few modes where they are.
    """
    of_trip = feeds.trips.select("feed_id", "trip_id", "route_id").join(
        _route_types(feeds), ["feed_id", "route_id"]).select("feed_id", "trip_id", "mode")
    calls = (
        feeds.stop_times.select("feed_id", "trip_id", "stop_id").join(of_trip, ["feed_id", "trip_id"])
        .select("feed_id", "stop_id", "mode").distinct()
        .groupBy("feed_id", "stop_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    )
    return (
        typed_stops(feeds).join(calls, ["feed_id", "stop_id"], "left")
        .withColumn("modes", F.coalesce("modes", F.array().cast("array<string>")))
        .withColumn("primary_mode", M.primary_mode(F.col("modes")))
    )


def shape_points(feeds: Feeds) -> DataFrame:
    """Usable shape vertices: numeric longitude and latitude."""
    return (
        feeds.shapes.select(
            "feed_id", "shape_id",
            F.col("shape_pt_sequence").try_cast("int").alias("seq"),
            F.col("shape_pt_lon").try_cast("double").alias("lon"),
            F.col("shape_pt_lat").try_cast("double").alias("lat"))
        .where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    )


def shape_lines(feeds: Feeds) -> DataFrame:
    """One ordered coordinate array per shape."""
    return collect_lines(shape_points(feeds))


def collect_lines(points: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    return points.groupBy("feed_id", "shape_id").agg(
        F.transform(ordered, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


def _shape_trips(feeds: Feeds) -> DataFrame:
    return feeds.trips.where("shape_id <> ''")


def shape_routes(feeds: Feeds) -> DataFrame:
    """Routes of each shape, most trips first (``rank`` 1 is the owner)."""
    counted = _shape_trips(feeds).groupBy("feed_id", "shape_id", "route_id").agg(F.count("*").alias("trips"))
    order = W.partitionBy("feed_id", "shape_id").orderBy(F.desc("trips"), "route_id")
    return counted.withColumn("rank", F.row_number().over(order))


def routes_of_shapes(feeds: Feeds, clicked: DataFrame) -> DataFrame:
    """Routes behind a list of picked shapes (feed_id, pos, shape_id): each once, in pick then trip order."""
    hits = clicked.join(shape_routes(feeds), ["feed_id", "shape_id"])
    first = hits.groupBy("feed_id", "route_id").agg(F.min(F.struct("pos", "rank")).alias("at"))
    return first.select("feed_id", "route_id", F.col("at.pos").alias("pos"), F.col("at.rank").alias("rank"))


def shape_owner(feeds: Feeds) -> DataFrame:
    counted = _shape_trips(feeds).groupBy("feed_id", "shape_id", "route_id").agg(F.count("*").alias("trips"))
    return counted.groupBy("feed_id", "shape_id").agg(
        F.min_by("route_id", F.struct(-F.col("trips"), F.col("route_id"))).alias("route_id"))


def _direction(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(-1))


def shape_direction(feeds: Feeds) -> DataFrame:
    """Direction most of a shape's trips run in; -1 stands for none."""
    counted = (
        _shape_trips(feeds).withColumn("dir", _direction(F.col("direction_id")))
        .groupBy("feed_id", "shape_id", "dir").agg(F.count("*").alias("trips"))
    )
    return counted.groupBy("feed_id", "shape_id").agg(
        F.min_by("dir", F.struct(-F.col("trips"), F.col("dir"))).alias("direction_id"))


def shape_modes(feeds: Feeds) -> DataFrame:
    """Shapes as polylines with the modes of their routes and their owner route."""
    by_route = _shape_trips(feeds).groupBy("feed_id", "shape_id", "route_id").agg(F.count("*").alias("trips"))
    traits = (
        by_route.join(_route_types(feeds), ["feed_id", "route_id"], "left")
        .groupBy("feed_id", "shape_id").agg(
            F.array_sort(F.collect_set("mode")).alias("modes"),
            F.min_by("route_id", F.struct(-F.col("trips"), F.col("route_id"))).alias("route_id"))
    )
    return (
        shape_lines(feeds).join(traits, ["feed_id", "shape_id"], "left")
        .select("feed_id", "shape_id", "coords",
                F.coalesce("modes", F.array().cast("array<string>")).alias("modes"),
                F.coalesce("route_id", F.lit("")).alias("route_id"))
        .withColumn("primary_mode", M.primary_mode(F.col("modes")))
    )


def _line_columns(df: DataFrame) -> DataFrame:
    """Display names of a route plus the keys lines are listed by."""
    short = F.coalesce("short_name", F.lit(""))
    long = F.coalesce("long_name", F.lit(""))
    return (
        df.withColumn("short_name", short).withColumn("long_name", long)
        .withColumn("agency_name", F.coalesce("agency_name", F.lit("")))
        .withColumn("mode_rank", M.mode_rank(F.col("mode")))
        .withColumn("name_key", X.natural_key(F.coalesce(X.blank_to_null(F.col("short_name")), F.col("long_name"))))
    )


def lines_for_stop(feeds: Feeds) -> DataFrame:
    """Routes calling at each stop with their distinct trips there."""
    counts = (
        feeds.stop_times.select("feed_id", "trip_id", "stop_id")
        .join(feeds.trips.select("feed_id", "trip_id", "route_id"), ["feed_id", "trip_id"])
        .groupBy("feed_id", "stop_id", "route_id").agg(F.count_distinct("trip_id").alias("trip_count"))
    )
    return _line_columns(counts.join(typed_routes(feeds), ["feed_id", "route_id"]))


def route_metas(feeds: Feeds) -> DataFrame:
    """One row per route with names, mode and its total trips."""
    trips = feeds.trips.groupBy("feed_id", "route_id").agg(F.count("trip_id").alias("n"))
    one = typed_routes(feeds).groupBy("feed_id", "route_id").agg(
        *[F.min(c).alias(c) for c in ["short_name", "long_name", "agency_name", "route_type"]])
    joined = one.join(trips, ["feed_id", "route_id"], "left")
    return _line_columns(
        joined.withColumn("mode", M.route_mode(F.col("route_type")))
        .withColumn("trip_count", F.coalesce("n", F.lit(0))).drop("n"))


def _service_weights(feeds: Feeds) -> DataFrame:
    days = sum((F.coalesce(F.col(d).try_cast("int"), F.lit(0)) for d in WEEKDAYS), F.lit(0))
    return feeds.calendar.select("feed_id", "service_id", days.alias("days"))


def _weighted_trips(feeds: Feeds, keys: list[str]) -> DataFrame:
    """Trips a week per ``keys``; counted before the calendar join so no service id is hot."""
    counted = feeds.trips.groupBy(*keys, "service_id").agg(F.count("*").alias("n"))
    caps = capabilities(feeds.files).select("feed_id", "has_calendar")
    weighted = counted.join(caps, "feed_id").join(_service_weights(feeds), ["feed_id", "service_id"], "left")
    return (
        weighted.withColumn("w", F.when(F.col("has_calendar"), F.col("n") * F.col("days")).otherwise(F.col("n")))
        .where("w IS NOT NULL").groupBy(*keys).agg(F.sum("w").cast("double").alias("trips_per_week"))
    )


def route_weekly_trips(feeds: Feeds) -> DataFrame:
    return _weighted_trips(feeds, ["feed_id", "route_id"])


def feed_weekly_trips(feeds: Feeds) -> DataFrame:
    return (
        feeds.feeds.select("feed_id").join(_weighted_trips(feeds, ["feed_id"]), "feed_id", "left")
        .select("feed_id", F.coalesce("trips_per_week", F.lit(0.0)).alias("trips_per_week"))
    )


# The observed window, 06:00 to 20:00 inclusive, in minutes.
WINDOW_MINUTES = (360, 1200)


def stop_departures(feeds: Feeds) -> DataFrame:
    """Departures per stop in the window: on Wednesdays where the feed has a calendar, else all of them."""
    caps = capabilities(feeds.files).where("has_trips AND has_departure_time").select("feed_id", "has_calendar")
    wednesday = (
        feeds.trips.select("feed_id", "trip_id", "service_id")
        .join(feeds.calendar.where(F.col("wednesday").try_cast("int") == 1).select("feed_id", "service_id"),
              ["feed_id", "service_id"])
        .groupBy("feed_id", "trip_id").agg(F.count("*").alias("runs"))
    )
    in_window = feeds.stop_times.where(
        M.minutes_of_day(F.col("departure_time")).between(*WINDOW_MINUTES)).select("feed_id", "trip_id", "stop_id")
    weight = F.when(F.col("has_calendar"), F.col("runs")).otherwise(F.lit(1))
    return (
        in_window.join(caps, "feed_id").join(wednesday, ["feed_id", "trip_id"], "left")
        .withColumn("w", weight).where("w IS NOT NULL")
        .groupBy("feed_id", "stop_id").agg(F.sum("w").alias("departures"))
    )


def route_shapes(feeds: Feeds) -> DataFrame:
    """Distinct shapes of each route that really have points, with their ordered coordinates."""
    owned = feeds.trips.where("shape_id IS NOT NULL").select("feed_id", "route_id", "shape_id").distinct()
    return owned.join(shape_lines(feeds), ["feed_id", "shape_id"])


def trip_patterns(feeds: Feeds) -> DataFrame:
    """Ordered stop pattern of each trip, as text and as a digest to group by."""
    calls = (
        feeds.trips.select(
            "feed_id", "route_id", "trip_id", _direction(F.col("direction_id")).alias("dir"),
            F.coalesce("trip_headsign", F.lit("")).alias("headsign"))
        .join(feeds.stop_times.select("feed_id", "trip_id", "stop_id",
                                      F.col("stop_sequence").try_cast("int").alias("seq")), ["feed_id", "trip_id"])
    )
    stops = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda s: s["stop_id"])
    return (
        calls.groupBy("feed_id", "route_id", "trip_id", "dir", "headsign")
        .agg(F.array_join(stops, "|").alias("pattern"), F.count("*").alias("stop_count"))
    )


def pattern_groups(feeds: Feeds) -> DataFrame:
    """Trips sharing route, direction and stop pattern."""
    return (
        trip_patterns(feeds).withColumn("pattern_key", F.unhex(F.sha2("pattern", 256)))
        .groupBy("feed_id", "route_id", "dir", "pattern_key").agg(
            F.count("*").alias("trip_count"), F.max("stop_count").alias("stop_count"),
            F.min("trip_id").alias("sample_trip_id"), F.min_by("headsign", "trip_id").alias("headsign"))
    )


def representative_patterns(feeds: Feeds) -> DataFrame:
    """Longest pattern per route and direction; ties by trips, then by trip id."""
    best = F.struct(-F.col("stop_count"), -F.col("trip_count"), F.col("sample_trip_id"))
    kept = F.struct("trip_count", "sample_trip_id", "headsign")
    return (
        pattern_groups(feeds).groupBy("feed_id", "route_id", "dir").agg(F.min_by(kept, best).alias("r"))
        .select("feed_id", "route_id", "dir", "r.*")
    )


def route_directions(feeds: Feeds) -> DataFrame:
    """Stops of each route and direction in travel order, from the representative trip.

    The representatives are written out, so that the shuffles of all trips' patterns are gone before calls are sent again.
    """
    chosen = cut_lineage(representative_patterns(feeds))
    calls = feeds.stop_times.select(
        "feed_id", F.col("trip_id").alias("sample_trip_id"), "stop_id",
        F.col("stop_sequence").try_cast("int").alias("seq"))
    per_dir = W.partitionBy("feed_id", "route_id", "dir")
    ordered = per_dir.orderBy("seq", "stop_id")
    return (
        chosen.join(calls, ["feed_id", "sample_trip_id"])
        .join(typed_stops(feeds), ["feed_id", "stop_id"])
        .withColumn("pos", F.row_number().over(ordered))
        .withColumn("last_stop", F.max_by("stop_name", F.struct("seq", "stop_id")).over(per_dir))
        .withColumn("n_stops", F.count("*").over(per_dir))
        .select(
            "feed_id", "route_id",
            F.when(F.col("dir") >= 0, F.col("dir")).when(F.col("dir") < -1, F.col("dir")).alias("direction_id"),
            F.when(F.col("headsign") != "", F.col("headsign")).otherwise(F.col("last_stop")).alias("headsign"),
            "trip_count", "pos", "seq", "stop_id", "stop_name", "lat", "lon", "n_stops")
    )


def shape_lengths(feeds: Feeds) -> DataFrame:
    """Length of each shape in metres."""
    order = W.partitionBy("feed_id", "shape_id").orderBy("seq", "lon", "lat")
    leg = haversine_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return (
        shape_points(feeds).withColumn("leg_m", leg).groupBy("feed_id", "shape_id")
        .agg(F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("length_m"), F.count("*").alias("points"))
    )


def feed_bounds(feeds: Feeds) -> DataFrame:
    """Bounding box of each feed's stops and of its shapes."""
    def box(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("feed_id").agg(
            F.min("lon").alias(f"{prefix}_west"), F.min("lat").alias(f"{prefix}_south"),
            F.max("lon").alias(f"{prefix}_east"), F.max("lat").alias(f"{prefix}_north"))

    return (
        feeds.feeds.select("feed_id").join(box(typed_stops(feeds), "stops"), "feed_id", "left")
        .join(box(shape_points(feeds), "shapes"), "feed_id", "left")
    )


def feed_counts(feeds: Feeds) -> DataFrame:
    """Rows of stops, routes and trips; null where the feed has no such file."""
    out = feeds.feeds.select("feed_id").join(capabilities(feeds.files), "feed_id", "left")
    for stem in ("stops", "routes", "trips"):
        n = getattr(feeds, stem).groupBy("feed_id").agg(F.count("*").alias("n"))
        name = f"{stem[:-1]}_count"
        out = out.join(n, "feed_id", "left").withColumn(
            name, F.when(F.col(f"has_{stem}"), F.coalesce("n", F.lit(0)))).drop("n")
    return out.select("feed_id", "stop_count", "route_count", "trip_count")


def feed_dates(feeds: Feeds) -> DataFrame:
    """Validity dates: feed_info when it states either, else the calendar's span, else none."""
    info = feeds.feed_info.groupBy("feed_id").agg(
        F.min(F.struct(X.blank_to_null(F.col("feed_start_date")).alias("s"),
                       X.blank_to_null(F.col("feed_end_date")).alias("e"))).alias("i"))
    span = feeds.calendar.groupBy("feed_id").agg(F.min("start_date").alias("c_s"), F.max("end_date").alias("c_e"))
    stated = F.col("i.s").isNotNull() | F.col("i.e").isNotNull()
    return (
        feeds.feeds.select("feed_id").join(info, "feed_id", "left").join(span, "feed_id", "left")
        .select("feed_id",
                F.when(stated, F.col("i.s")).otherwise(F.col("c_s")).alias("start_date"),
                F.when(stated, F.col("i.e")).otherwise(F.col("c_e")).alias("end_date"))
    )
