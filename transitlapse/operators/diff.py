"""Entity diff of feed pairs over the registry: stops, routes, summaries, map points, export rows.

All functions take ``pairs`` (feed_a, feed_b), so many comparisons run as one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions import text as X
from transitlapse.functions.geo import exact_sum, fixed, half_up, haversine_m
from transitlapse.operators.numbering import numbered
from transitlapse.operators.registry import Registry, longest
from transitlapse.session import cut_lineage

PAIR = ["feed_a", "feed_b"]
# Fixed value: a stop has moved when its centroids lie further apart than this.
MOVED_M = 15.0


def _both_sides(pairs: DataFrame, sides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of each pair's two feeds, matched on ``key``; ``a`` and ``b`` are null structs where absent."""
    wanted = pairs.select(*PAIR).distinct()
    pick = lambda x: wanted.join(
        sides.select(F.col("feed_id").alias(f"feed_{x}"), key, F.struct(*fields).alias(x)), f"feed_{x}")
    return pick("a").join(pick("b"), [*PAIR, key], "full_outer")


def stop_sides(registry: Registry) -> DataFrame:
    """Per feed and canonical stop: centroid, longest name and number of raw stops."""
    rolled = registry.stops.groupBy("feed_id", "canonical_id").agg(
        exact_sum(F.col("lat")).alias("lat_sum"), exact_sum(F.col("lon")).alias("lon_sum"),
        F.count("*").alias("raw_count"), longest("name").alias("name"))
    return rolled.select(
        "feed_id", "canonical_id", "name", (F.col("lat_sum") / F.col("raw_count")).alias("lat"),
        (F.col("lon_sum") / F.col("raw_count")).alias("lon"), "raw_count")


def stop_diff(registry: Registry, pairs: DataFrame, moved_m: float = MOVED_M) -> DataFrame:
    c = F.col
    both = _both_sides(pairs, stop_sides(registry), "canonical_id", ["name", "lat", "lon", "raw_count"])
    two = c("a").isNotNull() & c("b").isNotNull()
    dist = F.when(two, haversine_m(c("a.lat"), c("a.lon"), c("b.lat"), c("b.lon"))).otherwise(F.lit(0.0))
    renamed = X.normalize_stop_name(c("a.name")) != X.normalize_stop_name(c("b.name"))
    out = both.withColumn("dist_m", dist).withColumn("moved", c("dist_m") > moved_m).withColumn(
        "renamed", F.coalesce(two & renamed, F.lit(False)))
    status = (
        F.when(c("b").isNull(), "removed").when(c("a").isNull(), "added")
        .when(c("moved"), "moved").when(c("renamed"), "renamed").otherwise("unchanged")
    )
    label = F.when((c("status") == "moved") & c("renamed"), "moved + renamed").otherwise(c("status"))
    return out.withColumn("status", status).withColumn("label", label)


def route_sides(registry: Registry) -> DataFrame:
    rolled = registry.routes.groupBy("feed_id", "canonical_id").agg(
        longest("short_name").alias("short_name"), longest("long_name").alias("long_name"),
        longest("agency_name").alias("agency_name"), F.count("*").alias("raw_count"))
    modes = registry.canonical_routes.select("canonical_id", "mode")
    return rolled.join(modes, "canonical_id")


def route_diff(registry: Registry, pairs: DataFrame) -> DataFrame:
    """Routes matched by canonical id; removed and added ones of equal agency, mode and long name pair up
    one to one as renumbered under ``ren__<from>__<to>``."""
    c = F.col
    fields = ["short_name", "long_name", "agency_name", "mode", "raw_count"]
    both = _both_sides(pairs, route_sides(registry), "canonical_id", fields)
    changed = (X.normalize_loose(c("a.long_name")) != X.normalize_loose(c("b.long_name"))) | (
        X.normalize_loose(c("a.agency_name")) != X.normalize_loose(c("b.agency_name")))
    status = F.when(c("b").isNull(), "removed").when(c("a").isNull(), "added").when(
        changed, "modified").otherwise("unchanged")
    base = both.withColumn("status", status)

    side = F.coalesce("a", "b")
    long_key = X.normalize_loose(side["long_name"])
    agency = F.coalesce(X.blank_to_null(X.normalize_loose(side["agency_name"])), F.lit("__none__"))
    lone = c("status").isin("removed", "added")
    base = cut_lineage(base.withColumn(
        "fp", F.when(lone & (long_key != ""), F.concat_ws("|", agency, side["mode"], long_key))))
    ranked = cut_lineage(numbered(
        base.where("fp IS NOT NULL").select(*PAIR, "fp", "status", "canonical_id"),
        [*PAIR, "fp", "status"], ["canonical_id"]))
    gone = ranked.where("status = 'removed'").select(*PAIR, "fp", "n", c("canonical_id").alias("from_id"))
    new = ranked.where("status = 'added'").select(*PAIR, "fp", "n", c("canonical_id").alias("to_id"))
    links = gone.join(new, [*PAIR, "fp", "n"]).select(*PAIR, "from_id", "to_id")
    as_from = links.select(*PAIR, c("from_id").alias("canonical_id"), "from_id", "to_id")
    as_to = links.select(*PAIR, c("to_id").alias("canonical_id"), "from_id", "to_id")
    linked = base.join(as_from.unionByName(as_to), [*PAIR, "canonical_id"], "left")
    # A renumbered pair meets again under its common id: each half brings its own side.
    joint = F.when(c("from_id").isNotNull(), F.concat(F.lit("ren__"), "from_id", F.lit("__"), "to_id"))
    one = linked.where("from_id IS NULL").select(
        *PAIR, "canonical_id", "status", "a", "b", c("from_id"), c("to_id"))
    ren = linked.where("from_id IS NOT NULL").groupBy(*PAIR, joint.alias("canonical_id")).agg(
        F.lit("renumbered").alias("status"), F.first("a", ignorenulls=True).alias("a"),
        F.first("b", ignorenulls=True).alias("b"), F.first("from_id").alias("from_id"),
        F.first("to_id").alias("to_id"))
    return one.unionByName(ren)


def route_entry_members(registry: Registry, diff: DataFrame) -> DataFrame:
    """Raw routes behind each diff entry, per side: the long form of an entry's raw id lists."""
    from_id = F.coalesce("from_id", "canonical_id")
    to_id = F.coalesce("to_id", "canonical_id")
    sides = diff.select(*PAIR, F.col("canonical_id").alias("entry_id"), "status", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("feed_a").alias("feed_id"), from_id.alias("canonical_id")),
        F.struct(F.lit("b").alias("side"), F.col("feed_b").alias("feed_id"), to_id.alias("canonical_id")))).alias("s"))
    raws = registry.routes.select("feed_id", "canonical_id", "raw_id")
    return sides.select(*PAIR, "entry_id", "status", "s.*").join(raws, ["feed_id", "canonical_id"]).select(
        *PAIR, "entry_id", "status", "side", "feed_id", "raw_id")


def stop_entry_members(registry: Registry, diff: DataFrame) -> DataFrame:
    sides = diff.select(*PAIR, F.col("canonical_id").alias("entry_id"), "canonical_id", "status", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("feed_a").alias("feed_id")),
        F.struct(F.lit("b").alias("side"), F.col("feed_b").alias("feed_id")))).alias("s"))
    raws = registry.stops.select("feed_id", "canonical_id", "raw_id")
    return sides.select(*PAIR, "entry_id", "canonical_id", "status", "s.*").join(
        raws, ["feed_id", "canonical_id"]).select(*PAIR, "entry_id", "status", "side", "feed_id", "raw_id")


def diff_summary(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Counts per pair, kind and status with the kind's total and changed entries."""
    rows = stops.select(*PAIR, F.lit("stops").alias("kind"), "status").unionByName(
        routes.select(*PAIR, F.lit("routes").alias("kind"), "status"))
    counted = rows.groupBy(*PAIR, "kind", "status").agg(F.count("*").alias("entries"))
    totals = counted.groupBy(*PAIR, "kind").agg(
        F.sum("entries").alias("total"),
        F.sum(F.when(F.col("status") != "unchanged", F.col("entries")).otherwise(0)).alias("changed"))
    return counted.join(totals, [*PAIR, "kind"])


def stop_diff_points(diff: DataFrame) -> DataFrame:
    """Main map position of each entry: where it is now, or where it was when removed."""
    at = F.when(F.col("status") == "removed", F.col("a")).otherwise(F.coalesce("b", "a"))
    return diff.select(
        *PAIR, "canonical_id", "status", F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"),
        half_up(F.col("dist_m")).alias("dist_m"), at["lon"].alias("lon"), at["lat"].alias("lat"))


def stop_diff_for_feed(diff: DataFrame) -> DataFrame:
    """Each side's own stops at that side's positions."""
    side = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("s")),
                             F.struct(F.lit("b").alias("side"), F.col("b").alias("s")))).alias("x")
    return (
        diff.select(*PAIR, "canonical_id", "status", F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"),
                    half_up(F.col("dist_m")).alias("dist_m"), side).where("x.s IS NOT NULL")
        .select(*PAIR, "canonical_id", "status", "a_name", "b_name", "dist_m", "x.side",
                F.col("x.s.lon").alias("lon"), F.col("x.s.lat").alias("lat"))
    )


def stop_ghosts(diff: DataFrame) -> DataFrame:
    return diff.where("status = 'moved'").select(
        *PAIR, "canonical_id", F.lit("moved-from").alias("status"),
        F.col("a.lon").alias("lon"), F.col("a.lat").alias("lat"))


def move_arrows(diff: DataFrame) -> DataFrame:
    pt = lambda s: F.concat(F.lit("["), fixed(F.col(f"{s}.lon")), F.lit(","), fixed(F.col(f"{s}.lat")), F.lit("]"))
    line = F.concat(F.lit('{"type":"LineString","coordinates":['), pt("a"), F.lit(","), pt("b"), F.lit("]}"))
    return diff.where("status = 'moved'").select(
        *PAIR, "canonical_id", half_up(F.col("dist_m")).alias("dist_m"), line.alias("geometry"))


def line_list(diff: DataFrame, rerouted: DataFrame) -> DataFrame:
    """Lines by display status. ``rerouted``: feed_a, feed_b, canonical_id of lines with changed geometry."""
    flag = rerouted.select(*PAIR, "canonical_id").distinct().withColumn("hit", F.lit(True))
    side = F.coalesce("b", "a")
    status = F.when(F.col("status").isin("added", "removed"), F.col("status")).when(
        F.col("hit"), "rerouted").otherwise("unchanged")
    return diff.join(flag, [*PAIR, "canonical_id"], "left").select(
        *PAIR, "canonical_id", side["short_name"].alias("short_name"), side["long_name"].alias("long_name"),
        side["mode"].alias("mode"), status.alias("status"),
        X.line_sort_key(side["short_name"]).alias("sort_key"))


def search_lines(lines: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    needle = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", "short_name", "long_name"))
    out = lines.where(F.contains(hay, F.lit(needle))) if needle else lines
    return out.where(F.col("status") == status) if status else out


def gtfs_diff_export(registry: Registry, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """GTFS-Diff v1 rows, numbered from 1 within each pair."""
    c = F.col
    keep = F.lit(None).cast("string")
    js = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))

    st = stops.where("status <> 'unchanged'")
    st_raw = stop_entry_members(registry, st).join(
        st.select(*PAIR, c("canonical_id").alias("entry_id"), "moved", "renamed", "a", "b"), [*PAIR, "entry_id"])
    stop_json = lambda s: js(stop_id=c("raw_id"), stop_name=c(f"{s}.name"), stop_lat=fixed(c(f"{s}.lat")),
                             stop_lon=fixed(c(f"{s}.lon")))
    delta = lambda s: js(
        stop_lat=F.when(c("moved"), fixed(c(f"{s}.lat"))), stop_lon=F.when(c("moved"), fixed(c(f"{s}.lon"))),
        stop_name=F.when(c("renamed"), c(f"{s}.name")))
    both = c("status").isin("moved", "renamed")
    stop_rows = st_raw.where((~both) | (c("side") == "a")).select(
        *PAIR, F.lit("stops.txt").alias("file"),
        F.when(both, "update").when(c("side") == "a", "delete").otherwise("add").alias("action"),
        F.when(c("side") == "a", js(stop_id=c("raw_id"))).alias("identifier"),
        F.when(both, delta("a")).when(c("side") == "a", stop_json("a")).alias("initial_value"),
        F.when(both, delta("b")).when(c("side") == "b", stop_json("b")).alias("new_value"),
        F.lit("").alias("note"), "entry_id", "raw_id")

    rt = routes.where("status <> 'unchanged'")
    rt_raw = route_entry_members(registry, rt).join(
        rt.select(*PAIR, c("canonical_id").alias("entry_id"), "a", "b"), [*PAIR, "entry_id"])
    code = lambda s: _route_type_of(c(f"{s}.mode"))
    route_json = lambda s: js(route_id=c("raw_id"), route_short_name=c(f"{s}.short_name"),
                              route_long_name=c(f"{s}.long_name"), agency_id=c(f"{s}.agency_name"),
                              route_type=code(s))
    long_diff, agency_diff = c("a.long_name") != c("b.long_name"), c("a.agency_name") != c("b.agency_name")
    r_delta = lambda s: js(route_long_name=F.when(long_diff, c(f"{s}.long_name")),
                           agency_id=F.when(agency_diff, c(f"{s}.agency_name")))
    mod = c("status") == "modified"
    route_rows = rt_raw.where((~mod) | ((c("side") == "a") & (long_diff | agency_diff))).select(
        *PAIR, F.lit("routes.txt").alias("file"),
        F.when(mod, "update").when(c("side") == "a", "delete").otherwise("add").alias("action"),
        F.when(c("side") == "a", js(route_id=c("raw_id"))).alias("identifier"),
        F.when(mod, r_delta("a")).when(c("side") == "a", route_json("a")).otherwise(keep).alias("initial_value"),
        F.when(mod, r_delta("b")).when(c("side") == "b", route_json("b")).otherwise(keep).alias("new_value"),
        F.when(c("status") == "renumbered", "renumbered").otherwise("").alias("note"), "entry_id", "raw_id")

    rows = stop_rows.withColumn("part", F.lit(1)).unionByName(route_rows.withColumn("part", F.lit(2)))
    out = numbered(rows, PAIR, ["part", "entry_id", "action", "raw_id"], "id")
    return out.select(*PAIR, "id", "file", "action", F.lit("row").alias("target"), "identifier",
                      "initial_value", "new_value", "note")


def _route_type_of(mode):
    expr = None
    for m, code in M.MODE_TO_ROUTE_TYPE.items():
        expr = F.when(mode == m, code) if expr is None else expr.when(mode == m, code)
    return expr


def raw_status(registry: Registry, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Diff entry and status of every raw stop and route of the compared feeds."""
    return stop_entry_members(registry, stops).withColumn("kind", F.lit("stop")).unionByName(
        route_entry_members(registry, routes).withColumn("kind", F.lit("route")))


def stops_on_routes(registry: Registry, diff: DataFrame, served: DataFrame) -> DataFrame:
    """Stop entries really served by a route and direction; all of them where nothing is known to be served.

    ``served``: feed_a, feed_b, side, raw_id (the stop ids of the focused line, per side).
    """
    hit = stop_entry_members(registry, diff).join(served, [*PAIR, "side", "raw_id"], "left_semi").select(
        *PAIR, F.col("entry_id").alias("canonical_id")).distinct()
    known = served.select(*PAIR).distinct()
    return diff.join(hit, [*PAIR, "canonical_id"], "left_semi").unionByName(diff.join(known, PAIR, "left_anti"))
