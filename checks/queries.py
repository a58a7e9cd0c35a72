"""Registered queries: each runs one operator over the whole fixture feeds of a data folder."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import archives
from checks.workspace import POP_EXTENT, POP_VIEW, Workspace, workspace
from transitlapse.functions import modes as M
from transitlapse.functions import text as X
from transitlapse.functions.geo import fixed, half_up
from transitlapse.operators import diff as D
from transitlapse.operators import frequency as FQ
from transitlapse.operators import geometry as G
from transitlapse.operators import grades as GR
from transitlapse.operators import inspector as I
from transitlapse.operators import linking as L
from transitlapse.operators import pair_results as PR
from transitlapse.operators import population as P
from transitlapse.operators import pyramid as Y
from transitlapse.operators import registry as R
from transitlapse.operators import service as S
from transitlapse.operators import timeline as T
from transitlapse.schema import STEM_COLUMNS, capabilities
from transitlapse.session import cut_lineage
from transitlapse.sources import geojson, ingest, repair, store, truth
from transitlapse.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    name = fn.__name__.removeprefix("q_")
    QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[half_up(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def joined(c: str) -> Column:
    return F.array_join(c, ",")


# ---- service ----

@query
def q_typed_stops(ws):
    return S.typed_stops(ws.feeds)


@query
def q_typed_routes(ws):
    return S.typed_routes(ws.feeds)


@query
def q_route_modes(ws):
    return S.typed_routes(ws.feeds).groupBy("feed_id", "route_type", "mode").agg(F.count("*").alias("routes"))


@query
def q_stop_modes(ws):
    return S.stop_modes(ws.feeds).withColumn("modes", joined("modes"))


@query
def q_shape_modes(ws):
    df = S.shape_modes(ws.feeds)
    return df.select("feed_id", "shape_id", G.coords_json(F.col("coords")).alias("coords"),
                     joined("modes").alias("modes"), "primary_mode", "route_id")


@query
def q_lines_for_stop(ws):
    return S.lines_for_stop(ws.feeds).select(
        "feed_id", "stop_id", "route_id", "short_name", "long_name", "agency_name", "route_type", "mode",
        "trip_count", "mode_rank", "name_key")


@query
def q_route_metas(ws):
    return S.route_metas(ws.feeds).select(
        "feed_id", "route_id", "short_name", "long_name", "agency_name", "route_type", "mode", "trip_count",
        "mode_rank", "name_key")


@query
def q_route_weekly_trips(ws):
    return S.route_weekly_trips(ws.feeds)


@query
def q_feed_weekly_trips(ws):
    return S.feed_weekly_trips(ws.feeds)


@query
def q_stop_departures(ws):
    return S.stop_departures(ws.feeds)


@query
def q_dep_minutes(ws):
    return ws.feeds.stop_times.groupBy("feed_id", "departure_time").agg(F.count("*").alias("calls")).withColumn(
        "minutes", M.minutes_of_day(F.col("departure_time")))


@query
def q_route_shapes(ws):
    return S.route_shapes(ws.feeds).select(
        "feed_id", "route_id", "shape_id", F.size("coords").alias("points"))


@query
def q_trip_patterns(ws):
    return S.trip_patterns(ws.feeds)


@query
def q_pattern_groups(ws):
    return S.pattern_groups(ws.feeds).select(
        "feed_id", "route_id", "dir", "trip_count", "stop_count", "sample_trip_id", "headsign")


@query
def q_route_directions(ws):
    return S.route_directions(ws.feeds)


@query
def q_shape_routes(ws):
    return S.shape_routes(ws.feeds)


@query
def q_shape_owner(ws):
    return S.shape_owner(ws.feeds)


@query
def q_shape_direction(ws):
    return S.shape_direction(ws.feeds)


@query
def q_clicked_shape_routes(ws):
    clicked = ws.feeds.trips.where("shape_id IS NOT NULL").groupBy("feed_id", "shape_id").agg(
        F.min("trip_id").alias("pos"))
    return S.routes_of_shapes(ws.feeds, clicked)


@query
def q_shape_lengths(ws):
    return rounded(S.shape_lengths(ws.feeds), length_m=3)


@query
def q_feed_bounds(ws):
    return S.feed_bounds(ws.feeds)


@query
def q_feed_capabilities(ws):
    return capabilities(ws.feeds.files)


@query
def q_feed_counts(ws):
    return S.feed_counts(ws.feeds)


@query
def q_feed_dates(ws):
    return S.feed_dates(ws.feeds)


@query
def q_feed_label(ws):
    return T.feed_labels(ws.feeds)


@query
def q_feed_catalog(ws):
    return T.feed_catalog(ws.feeds)


@query
def q_feed_completeness(ws):
    return store.completeness(ws.feeds.files)


@query
def q_stale_schema(ws):
    return store.stale_feeds(ws.feeds.files)


# ---- text ----

@query
def q_norm_stop_name(ws):
    names = ws.feeds.stops.select("stop_name").distinct()
    return names.withColumn("name_key", X.normalize_stop_name(F.col("stop_name")))


@query
def q_norm_route_short(ws):
    names = ws.feeds.routes.select("route_short_name").distinct()
    return names.withColumn("short_key", X.normalize_route_short_name(F.col("route_short_name")))


@query
def q_norm_loose(ws):
    names = ws.feeds.routes.select(F.col("route_long_name").alias("name")).unionByName(
        ws.feeds.agency.select(F.col("agency_name").alias("name"))).distinct()
    return names.withColumn("loose_key", X.normalize_loose(F.col("name")))


# ---- registry ----

@query
def q_stop_spatial_scopes(ws):
    pts = R.raw_stops(ws.feeds).select(
        F.concat_ws("\t", "feed_id", "raw_id").alias("key"), "feed_id", "lat", "lon")
    scopes = L.spatial_scopes(pts, R.SCOPE_M)
    head = scopes.groupBy("scope").agg(F.min("key").alias("scope_head"), F.count("*").alias("members"))
    return scopes.join(head, "scope").select("key", "scope_head", "members")


@query
def q_stop_rawid_components(ws):
    pts = R.raw_stops(ws.feeds).select(
        F.concat_ws("\t", "feed_id", "raw_id").alias("key"), "feed_id", "lat", "lon", "raw_id")
    comp = L.connected_components(L.cross_feed_links(pts, R.RAW_ID_M, "raw_id"))
    members = pts.select("key").join(comp, pts.key == comp.node)
    head = members.groupBy("component").agg(F.min("key").alias("head"))
    return members.join(head, "component").select("key", "head")


@query
def q_stop_assignments(ws):
    return ws.registry.stops.select("feed_id", "raw_id", "canonical_id")


@query
def q_canonical_stops(ws):
    return rounded(ws.registry.canonical_stops, lat=6, lon=6)


@query
def q_components(ws):
    pts = R.raw_stops(ws.feeds)
    edges = pts.select(F.concat(F.lit("c:"), F.floor(F.col("lat") * 50).cast("string")).alias("src"),
                       F.concat(F.lit("n:"), F.col("raw_id")).alias("dst"))
    return L.connected_components(edges)


@query
def q_route_assignments(ws):
    return ws.registry.routes.select("feed_id", "raw_id", "canonical_id")


@query
def q_canonical_routes(ws):
    return ws.registry.canonical_routes


def _overridden(ws: Workspace, kind: str):
    members = ws.registry.stops if kind == "stop" else ws.registry.routes
    canon = ws.registry.canonical_stops if kind == "stop" else ws.registry.canonical_routes
    return R.apply_overrides(members, canon, ws.view("fx_overrides"), kind)


@query
def q_overridden_assignments(ws):
    parts = [_overridden(ws, k)[0].select(F.lit(k).alias("kind"), "feed_id", "raw_id", "canonical_id")
             for k in ("stop", "route")]
    return parts[0].unionByName(parts[1])


@query
def q_overridden_canonicals(ws):
    s = _overridden(ws, "stop")[1].select(F.lit("stop").alias("kind"), "canonical_id", "name", "member_count", "feed_count")
    r = _overridden(ws, "route")[1].select(
        F.lit("route").alias("kind"), "canonical_id", F.col("long_name").alias("name"), "member_count", "feed_count")
    return s.unionByName(r)


@query
def q_truth_parse(ws):
    lines = ws.view("fx_truth").select(
        "kind", F.format_string("%s,%s,%s,%s,%s,%s", "kind", "feed_a", "raw_a", "feed_b", "raw_b",
                                F.when(F.col("same"), "Yes").otherwise("0")).alias("line"))
    stops, routes = (truth.parse_csv_lines(lines.where(F.col("kind") == k).select("line")) for k in ("stop", "route"))
    return stops.unionByName(routes)


@query
def q_match_quality(ws):
    return rounded(R.match_quality(R.evaluate_pairs(ws.registry, ws.view("fx_truth"))),
                   precision=6, recall=6, f1=6, accuracy=6)


@query
def q_match_mistakes(ws):
    return R.match_mistakes(R.evaluate_pairs(ws.registry, ws.view("fx_truth")))


@query
def q_registry_browse(ws):
    return R.browse(ws.registry.canonical_stops, "platz", 2).select(
        "canonical_id", "name", "member_count", "feed_count")


@query
def q_registry_stale(ws):
    loaded = ws.feeds.feeds.where("source_name NOT LIKE 'asia%'").select("feed_id")
    return R.stale_feeds(ws.registry.stops.select("feed_id"), loaded)


# ---- diff ----

def _flat(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "ab" for f in fields])


@query
def q_stop_diff(ws):
    flat = _flat(ws.stop_diff, ["name", "lat", "lon", "raw_count"],
                 [*D.PAIR, "canonical_id", "status", "label", "moved", "renamed", "dist_m"])
    return rounded(flat, dist_m=3, a_lat=6, a_lon=6, b_lat=6, b_lon=6)


@query
def q_route_diff(ws):
    return _flat(ws.route_diff, ["short_name", "long_name", "agency_name", "mode", "raw_count"],
                 [*D.PAIR, "canonical_id", "status", "from_id", "to_id"])


@query
def q_diff_summary(ws):
    return D.diff_summary(ws.stop_diff, ws.route_diff)


@query
def q_kept_pair_summary(ws):
    """The steps are kept first; the second call finds them and computes the remaining pair only."""
    path = archives.scratch(ws.spark, "pairs")
    PR.stored_diffs(ws.registry, ws.steps, path)
    kept = PR.stored_diffs(ws.registry, ws.pairs, path)
    new = kept.computed.withColumn("computed", F.lit(True))
    return D.diff_summary(kept.stops, kept.routes).join(new, D.PAIR, "left").withColumn(
        "computed", F.coalesce("computed", F.lit(False)))


@query
def q_auto_pair(ws):
    return T.auto_pair(ws.feeds)


@query
def q_raw_status(ws):
    return D.raw_status(ws.registry, ws.stop_diff, ws.route_diff)


@query
def q_stop_diff_points(ws):
    return rounded(D.stop_diff_points(ws.stop_diff), lon=6, lat=6)


@query
def q_stop_diff_for_feed(ws):
    return rounded(D.stop_diff_for_feed(ws.stop_diff), lon=6, lat=6)


@query
def q_stop_ghosts(ws):
    return rounded(D.stop_ghosts(ws.stop_diff), lon=6, lat=6)


@query
def q_move_arrows(ws):
    return D.move_arrows(ws.stop_diff)


@query
def q_gtfs_diff_export(ws):
    return D.gtfs_diff_export(ws.registry, ws.stop_diff, ws.route_diff)


@query
def q_stops_on_route(ws):
    busiest = I.served_stops(ws.feeds, ws.registry, ws.route_diff).where(
        "entry_id LIKE '%_tram_%' AND direction_id = 0").select(*D.PAIR, "side", "raw_id").distinct()
    return D.stops_on_routes(ws.registry, ws.stop_diff, busiest).select(*D.PAIR, "canonical_id", "status")


@query
def q_line_list(ws):
    changed = G.rerouted_lines(ws.runs).where("geometry_changed")
    return D.line_list(ws.route_diff, changed).orderBy(*D.PAIR, "sort_key", "long_name")


@query
def q_line_search(ws):
    none = ws.route_diff.select(*D.PAIR, "canonical_id").limit(0)
    return D.search_lines(D.line_list(ws.route_diff, none), " Linie 1", "unchanged")


# ---- frequency ----

@query
def q_feed_frequency(ws):
    return rounded(FQ.feed_frequency(ws.feeds), trips_norm=6)


@query
def q_freq_scale(ws):
    return FQ.frequency_scale(ws.feeds)


@query
def q_freq_classes(ws):
    return FQ.feed_frequency(ws.feeds).groupBy("feed_id", "class").agg(F.count("*").alias("routes"))


@query
def q_freq_diff(ws):
    return rounded(FQ.with_change_scale(ws.freq_diff), delta_norm=6, percent_delta=6)


@query
def q_freq_diff_matched(ws):
    return rounded(FQ.with_change_scale(FQ.matched_only(ws.freq_diff)), delta_norm=6, percent_delta=6)


# ---- timeline ----

@query
def q_feed_years(ws):
    return T.feed_years(ws.feeds).withColumn("rep_date", F.col("rep_date").cast("string")).withColumn(
        "span_start", F.col("span_start").cast("string")).withColumn("span_end", F.col("span_end").cast("string"))


@query
def q_feed_year_labels(ws):
    return T.feed_year_labels(ws.feeds)


@query
def q_year_range(ws):
    return T.year_range(ws.feeds)


@query
def q_feed_for_year(ws):
    return T.feed_for_year(ws.feeds)


@query
def q_feeds_between(ws):
    return T.feeds_between(ws.feeds, ws.pairs.unionByName(
        ws.steps.select(F.col("feed_b").alias("feed_a"), F.col("feed_a").alias("feed_b"))))


@query
def q_feed_steps(ws):
    return T.feed_steps(ws.feeds)


@query
def q_timeline_trend(ws):
    return T.trend(ws.feeds)


@query
def q_trend_since_baseline(ws):
    return T.trend_since_baseline(ws.feeds, ws.pair.select(F.col("feed_a").alias("feed_id")))


@query
def q_step_diffs(ws):
    return D.diff_summary(ws.stop_diff.join(ws.steps, D.PAIR, "left_semi"),
                          ws.route_diff.join(ws.steps, D.PAIR, "left_semi"))


@query
def q_cumulative_stops(ws):
    return T.cumulative_stops(ws.stop_diff, ws.steps)


def _summary(ws: Workspace) -> DataFrame:
    churned = T.cumulative_stops(ws.stop_diff, ws.steps).agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"))
    churn = ws.pair.withColumn("c", churned.agg(F.first(F.struct("added", "removed"))).scalar()).select(
        *D.PAIR, "c.added", "c.removed")
    return T.change_summary(ws.feeds, ws.stop_diff, ws.route_diff, ws.freq_diff, churn)


@query
def q_timeline_summary(ws):
    return _summary(ws)


@query
def q_timeline_narrative(ws):
    return T.narrative(_summary(ws))


@query
def q_entity_history(ws):
    return T.entity_history(ws.feeds, ws.registry.stops)


@query
def q_entity_history_rows(ws):
    return T.entity_rows(ws.feeds, ws.registry.stops)


# ---- grades ----

@query
def q_stop_categories(ws):
    return rounded(ws.ranked_stops, interval_min=6)


@query
def q_grade_grid(ws):
    return rounded(GR.grade_grid(ws.ranked_stops, ws.window), dist_m=3)


@query
def q_grade_cells(ws):
    return GR.grade_cells(ws.grid, ws.window)


@query
def q_grade_summary(ws):
    return GR.grade_summary(ws.grid, ws.ranked_stops, ws.window)


@query
def q_grade_change(ws):
    return GR.grade_change_cells(GR.grade_change(ws.grid, ws.pairs), ws.window)


@query
def q_grade_change_summary(ws):
    return GR.grade_change_summary(GR.grade_change(ws.grid, ws.pairs))


# ---- population ----

@query
def q_pop_pixels(ws):
    return P.pixel_counts(ws.view("fx_pop_pixels")).groupBy("yr").agg(
        F.count("*").alias("pixels"), half_up(F.sum("people"), 2).alias("people"))


@query
def q_pop_year(ws):
    return T.feed_years(ws.feeds).select("feed_id", "year", P.population_year(F.col("year")).alias("pop_year"))


@query
def q_pop_pyramid(ws):
    return rounded(P.population_grid(ws.view("fx_pop_pixels"), ws.pop_extent), people=2)


@query
def q_pop_grid(ws):
    return rounded(Y.stored_grid(ws.spark, ws.pyramid, ws.pop_view), people=2)


@query
def q_pop_grid_level(ws):
    """The view in cells of 8 x 8 pixels, widened to whole ones."""
    return rounded(Y.stored_grid(ws.spark, ws.pyramid, ws.pop_wide), people=2)


@query
def q_pop_levels(ws):
    """What each stored level holds."""
    levels = [ws.pyramid.level_table(ws.spark, x).select(F.lit(x).alias("level"), "yr", "people") for x in ws.pyramid.levels]
    held = functools.reduce(DataFrame.unionByName, levels).groupBy("level", "yr").agg(
        F.count("*").alias("cells"), F.sum("people").cast("double").alias("people"), F.max("people").cast("double").alias("top"))
    return rounded(held, people=2, top=2)


def _density(ws: Workspace) -> DataFrame:
    return P.population_density(ws.view("fx_pop_pixels"), ws.pop_view, ws.pop_extent)


@query
def q_pop_density(ws):
    df = P.population_cells(_density(ws), ws.pop_view)
    return rounded(df.select("yr", "row", "col", "people", "density", "norm", "class", "geometry"),
                   people=2, density=4, norm=4)


@query
def q_pop_scale(ws):
    return rounded(P.density_scale(ws.view("fx_pop_pixels"), ws.pop_extent), p_value=4, top=4, scale=4)


@query
def q_pop_classes(ws):
    return _density(ws).groupBy("yr", "class").agg(F.count("*").alias("cells"))


@query
def q_pop_summary(ws):
    return rounded(P.population_summary(_density(ws), ws.pop_view), max_density=4, scale_density=4)


@query
def q_pop_delta(ws):
    df = P.population_delta(ws.view("fx_pop_pixels"), ws.year_pairs, ws.pop_view, ws.pop_extent)
    return rounded(df, people_a=2, people_b=2, delta=2, density_a=4, density_b=4, delta_ha=4, norm=4)


@query
def q_district_bbox(ws):
    return P.districts_in(ws.view("fx_districts"), POP_VIEW)


@query
def q_district_population(ws):
    df = P.district_population(ws.view("fx_districts"), ws.view("fx_district_pop"), POP_VIEW, POP_EXTENT)
    return rounded(df.select("g_id", "g_name", "geometry", "population", "scale", "norm", "class", "year"), norm=6)


# ---- inspector ----

@query
def q_diff_lines_for_stop(ws):
    return I.diff_lines_for_stop(ws.feeds, ws.registry, ws.route_diff, ws.pairs)


@query
def q_diff_route_stops(ws):
    return I.diff_route_stops(ws.feeds, ws.registry, ws.route_diff, ws.stop_diff)


@query
def q_line_directions(ws):
    return I.line_directions(ws.feeds, ws.registry, ws.route_diff)


# ---- geometry ----

@query
def q_route_pairs(ws):
    return G.route_pairs(ws.registry, ws.route_diff)


@query
def q_direction_buckets(ws):
    df = G.direction_buckets(G.scoped_shapes(ws.feeds, G.route_pairs(ws.registry, ws.route_diff)))
    return df.withColumn("dirs_a", joined("dirs_a")).withColumn("dirs_b", joined("dirs_b"))


def _shape_segments(ws: Workspace) -> DataFrame:
    lines = S.shape_lines(ws.feeds)
    key = ["feed_id", "shape_id"]
    return G.tangents(G.vertices(lines, key), key)


@query
def q_shape_tangents(ws):
    return rounded(_shape_segments(ws).select("feed_id", "shape_id", "i", "lon", "lat", "ux", "uy"), ux=6, uy=6)


@query
def q_geom_samples(ws):
    lines = S.shape_lines(ws.feeds)
    units = G.scoped_shapes(ws.feeds, G.route_pairs(ws.registry, ws.route_diff))
    split = G.direction_buckets(units).where("two_sided").select(*D.PAIR, "canonical_id", "split")
    placed = units.join(split, [*D.PAIR, "canonical_id"]).withColumn(
        "bucket", F.when(F.col("split"), F.col("dir")).otherwise(G.UNION))
    scoped = placed.withColumn("line_no", F.concat_ws("\t", *D.PAIR, "canonical_id", "bucket"))
    geoms = scoped.join(lines, ["feed_id", "shape_id"]).withColumnRenamed("shape_id", "g")
    segs = cut_lineage(G.tangents(G.vertices(geoms, G.GEOM), G.GEOM))
    flagged = G.inside_flags(G.samples_of(G.with_covered(segs, segs, G.SEGMENT_CELL_M), G.GEOM))
    counted = flagged.groupBy(*G.GEOM).agg(
        F.count("*").alias("samples"), F.count_if("inside").alias("inside"),
        F.sum(F.when(F.col("inside"), F.col("i") * 1000 + F.col("s")).otherwise(0)).alias("where_inside"))
    part = lambda i: F.element_at(F.split("line_no", "\t"), i)
    return counted.select(part(1).alias("feed_a"), part(2).alias("feed_b"), part(3).alias("canonical_id"),
                          part(4).cast("int").alias("bucket"), "side", F.col("g").alias("gid"),
                          "samples", "inside", "where_inside")


@query
def q_geom_runs(ws):
    return rounded(ws.runs.select(*[c for c in G.RUN_COLUMNS if c != "coords"],
                                  F.size("coords").alias("points")), length_m=2)


@query
def q_geom_crossings(ws):
    inner = ws.runs.where("run > 0")
    return inner.select(*D.PAIR, "canonical_id", "side", "shape_id", "run", fixed(F.col("coords")[0]["lon"]).alias("lon"),
                        fixed(F.col("coords")[0]["lat"]).alias("lat"))


@query
def q_geom_reroutes(ws):
    return ws.runs.where("status = 'changed'").groupBy(*D.PAIR, "canonical_id", "changed_side").agg(
        F.count("*").alias("runs"), half_up(F.sum("length_m"), 2).alias("length_m"))


@query
def q_geom_diff(ws):
    return ws.runs.groupBy(*D.PAIR, "side", "status").agg(
        F.count("*").alias("runs"), half_up(F.sum("length_m"), 1).alias("length_m"))


@query
def q_geom_diff_feedwide(ws):
    return rounded(G.feedwide_diff(ws.feeds, ws.pairs).select(
        *D.PAIR, "side", "feed_id", "shape_id", "run", "status", "length_m"), length_m=2)


@query
def q_geom_features(ws):
    return rounded(ws.features.select(
        *D.PAIR, "canonical_id", "side", "shape_id", "route_id", "direction_id", "status", "changed_side",
        "line_status", "primary_mode", *[f"is_{m}" for m in M.MODES], "length_m",
        G.coords_json(F.col("coords")).alias("coordinates")), length_m=2)


@query
def q_geom_lengths(ws):
    df = G.geometry_lengths(ws.features)
    return rounded(df, **{c: 1 for c in df.columns if c.endswith("_m")})


@query
def q_route_runs(ws):
    return ws.runs.where("side = 'b' AND direction_id = 0").select(
        *D.PAIR, "canonical_id", "shape_id", "run", "status", half_up(F.col("length_m"), 2).alias("length_m"))


@query
def q_rerouted_routes(ws):
    return G.rerouted_lines(ws.runs).withColumn("directions", joined("directions"))


@query
def q_new_alignments(ws):
    return G.new_alignments(ws.features).select(
        *D.PAIR, "canonical_id", "shape_id", "run", half_up(F.col("length_m"), 2).alias("length_m"))


@query
def q_route_km_delta(ws):
    return rounded(G.route_km_delta(ws.feeds, ws.registry, ws.route_diff), added_km=3, removed_km=3)


@query
def q_stops_near_route(ws):
    members = I.served_stops(ws.feeds, ws.registry, ws.route_diff)
    ids = ws.registry.stops.select("feed_id", "raw_id", F.col("canonical_id").alias("point_id"))
    feed = F.when(F.col("side") == "a", F.col("feed_a")).otherwise(F.col("feed_b"))
    wanted = members.withColumn("feed_id", feed).join(ids, ["feed_id", "raw_id"]).select(
        *D.PAIR, F.col("entry_id").alias("canonical_id"), "point_id").distinct()
    at = D.stop_diff_points(ws.stop_diff).select(*D.PAIR, F.col("canonical_id").alias("point_id"), "lon", "lat")
    points = wanted.join(at, [*D.PAIR, "point_id"])
    near = G.stops_near_lines(points, ws.runs, 60.0)
    return near.select(*D.PAIR, "canonical_id", "point_id")


# ---- feature tables ----

@query
def q_stops_geojson(ws):
    return geojson.stop_features(S.stop_modes(ws.feeds))


@query
def q_shapes_geojson(ws):
    return geojson.shape_features(S.shape_modes(ws.feeds))


# ---- ingest and storage ----

#: Files of the archives come in many ranges, also at small scale.
SMALL_RANGES = 1 << 18

def broken_headsign() -> Column:
    """Headsigns of the archives: with line breaks, quotes and commas inside, so that files need a quoting reader."""
    sign = F.col("trip_headsign")
    return F.when(sign == "", sign).otherwise(F.concat(sign, F.lit('\n"'), F.col("trip_id"), F.lit('",\nvia')))


def _digests(feeds, columns: dict[str, list[str]]) -> DataFrame:
    """Rows of every table and feed, and the sum of a hash of all their values; empty texts count as null."""
    parts = []
    for stem, names in columns.items():
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
        parts.append(getattr(feeds, stem).groupBy("feed_id").agg(
            F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")).alias("digest")).withColumn("stem", F.lit(stem)))
    return functools.reduce(DataFrame.unionByName, parts)


def _archives(ws: Workspace) -> str:
    if not hasattr(ws, "_zips"):
        path = archives.scratch(ws.spark, "archives")
        archives.write_archives(dataclasses.replace(ws.feeds, trips=ws.feeds.trips.withColumn("trip_headsign", broken_headsign())), path)
        ws._zips = f"{path}/zip"
    return ws._zips


def _ingested(ws: Workspace):
    if not hasattr(ws, "_ingest"):
        ws._ingest = ingest.ingest(ws.spark, _archives(ws), archives.scratch(ws.spark, "staging"), 1700000000000, SMALL_RANGES)
    return ws._ingest


def _by_source(feeds, df: DataFrame) -> DataFrame:
    return df.join(feeds.feeds.select("feed_id", "source_name"), "feed_id").drop("feed_id")


@query
def q_ingest_tables(ws):
    feeds, _ = _ingested(ws)
    counts = [getattr(feeds, s).groupBy("feed_id").agg(F.count("*").alias("rows")).withColumn("stem", F.lit(s))
              for s in STEM_COLUMNS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return _by_source(feeds, out)


@query
def q_csv_scan(ws):
    feeds, _ = _ingested(ws)
    return _by_source(feeds, _digests(feeds, STEM_COLUMNS))


@query
def q_parquet_roundtrip(ws):
    path = archives.scratch(ws.spark, "tables")
    store.save_feeds(ws.feeds, path)
    back = store.load_feeds(ws.spark, path)
    back.files = back.files.withColumn("columns", F.array_join("columns", ","))
    return _digests(back, STEM_COLUMNS | {"files": ["stem", "columns"], "feeds": ["source_name", "loaded_at"]})


@query
def q_feed_repair(ws):
    """Tables stored without departure times in one feed and without routes in another, after their repair."""
    feeds, _ = _ingested(ws)
    named = feeds.feeds.select("feed_id", "source_name")
    of = lambda df, source: df.join(named.where(F.col("source_name") == source), "feed_id").drop("source_name")
    rest = lambda df, source: df.join(named.where(F.col("source_name") == source), "feed_id", "left_anti")
    old, short = "america_net.ZIP", "europe_net.ZIP"
    stripped = F.when(F.col("stem") == "stop_times", F.array_remove("columns", "departure_time")).otherwise(F.col("columns"))
    files = rest(feeds.files, old).unionByName(of(feeds.files, old).withColumn("columns", stripped))
    files = rest(files, short).unionByName(of(files, short).where("stem <> 'routes'"))
    times = rest(feeds.stop_times, old).unionByName(of(feeds.stop_times, old).withColumn("departure_time", F.lit(None).cast("string")))
    path = archives.scratch(ws.spark, "repair")
    store.save_feeds(dataclasses.replace(feeds, files=files, stop_times=times, routes=rest(feeds.routes, short)), path)
    raw = ingest.archives(ws.spark, _archives(ws), 1700000000000)
    done = repair.repair(ws.spark, path, raw, archives.scratch(ws.spark, "staging"), SMALL_RANGES)
    back = store.load_feeds(ws.spark, path)
    found = _digests(back, {s: STEM_COLUMNS[s] for s in ("stops", "routes", "stop_times")})
    return _by_source(back, found.join(done.select("feed_id", "stem", "reason", "outcome"), ["feed_id", "stem"], "left"))


@query
def q_stream_ingest(ws):
    path = archives.scratch(ws.spark, "stream")
    watch.watch_archives(ws.spark, _archives(ws), f"{path}/staging", f"{path}/out", f"{path}/ckpt",
                         archives_per_batch=2).awaitTermination()  # three drops
    built = R.load_registry(ws.spark, f"{path}/out/registry")
    return built.canonical_stops.select("canonical_id", "name", "member_count", "feed_count")
