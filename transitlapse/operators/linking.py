"""Grouping by links: connected components, and links between points closer than a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlapse.functions.geo import haversine_m
from transitlapse.session import cut_lineage, drop_table


#: A node with more edges than this is a hub: its edges are dealt to several join keys. A larger input raises the
#: number, so that there are never more than MOST_HUBS of them.
HUB_EDGES = 500_000
MOST_HUBS = 20_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (src, dst) with the smallest node it is connected to.

    Alternates large-star and small-star steps: each pulls a node's neighbours onto the smallest of them, so
    a hub's neighbour list is never gathered, only its minimum. Every round is written out, and deleted when the next
    one is there.
    """
    e = edges.select("src", "dst").where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e = cut_lineage(e)
    mark = _signature(e)
    while True:
        most = 2 * mark[0]
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = _least(both).withColumn("m", F.least("src", "m"))
        large = join_least(both, low, most).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        pulled = join_least(large, _least(large), most).select(
            F.explode(F.array(F.struct("src", F.col("m").alias("dst")),
                              F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        after = cut_lineage(pulled.select("e.src", "e.dst").where("src <> dst").distinct())
        drop_table(e)
        e, now = after, _signature(after)
        if now == mark:
            break
        mark = now
    roots = e.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour and its number of edges."""
    return edges.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n"))


def join_least(edges: DataFrame, least: DataFrame, most_edges: int) -> DataFrame:
    """``edges`` (src, dst) with ``m`` of their src from ``least`` (src, m, n).

    A hub's edges are dealt by their other end to parts of about ``HUB_EDGES``, each with a copy of the hub's one row.
    Hubs are at most ``MOST_HUBS`` rows: there cannot be more nodes with so large a share of ``most_edges`` edges. Where
    all edges together are no more than one part, no node is a hub.
    """
    part = max(HUB_EDGES, most_edges // MOST_HUBS)
    if most_edges <= part:
        return edges.join(least.drop("n"), "src")
    parts = F.ceil(F.col("n") / part).cast("int")
    hubs = least.where(F.col("n") > part).select("src", parts.alias("parts"))
    dealt = edges.join(F.broadcast(hubs), "src", "left").withColumn(
        "part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = least.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(copies, ["src", "part"]).drop("part")


def _signature(e: DataFrame) -> tuple:
    digest = F.xxhash64("src", "dst").cast("decimal(20,0)")
    return tuple(e.agg(F.count("*"), F.sum(digest), F.sum(digest * digest % 1000003)).first())


# A cell is a little wider than the radius, so one ring of neighbours always suffices.
_SAFE_M_PER_DEG = 111_000.0
_SPLIT = 8
_POLAR_LAT = 89.0
#: Degrees of a tile near a pole, where a cell spans all longitudes.
_POLAR_TILE = 5.625


def _lon_step(row: Column, step: float, eps: float) -> Column:
    """Width in degrees of a cell in latitude row ``row``, wide enough for the rows next to it too; a full turn at a pole."""
    reach = F.greatest(F.abs(row), F.abs(row + 1)) + 1
    cos = F.greatest(F.cos(F.radians(F.least(F.lit(90.0), reach * F.lit(step)))), F.lit(1e-12))
    return F.least(F.lit(360.0), F.lit(eps / _SAFE_M_PER_DEG) / cos)


def _tiles(points: DataFrame, eps: float, group: list[str]) -> DataFrame:
    """Points with the small tile they lie in; a tile's diagonal is far below the radius."""
    step = eps / _SAFE_M_PER_DEG
    placed = points.withColumn("row", F.floor(F.col("lat") / F.lit(step)))
    placed = placed.withColumn("tx", F.floor(F.col("lon") / F.least(_lon_step(F.col("row"), step, eps) / _SPLIT, F.lit(_POLAR_TILE))))
    placed = placed.withColumn("ty", F.floor(F.col("lat") / F.lit(step / _SPLIT)))
    if group:
        return placed.withColumn("tile", F.concat_ws("\u0001", F.lit("tile"), *group, "tx", "ty"))
    return placed.withColumn("tile", F.col("ty") * F.lit(1 << 32) + F.col("tx") + F.lit(1 << 31))


def _tile_pairs(tiles: DataFrame, eps: float, group: list[str], fresh_only: bool = False) -> DataFrame:
    """Neighbouring tiles that may hold points within the radius, and whether they surely do.

    With ``fresh_only`` at least one tile of a pair is ``fresh``.

    Works on one row per occupied tile, so the cost does not depend on how many points share a place. Tiles near
    longitude 180 stand a second time a full turn away, where their neighbours beyond it are; near a pole, a cell
    spans all longitudes and points are compared one by one, so that links across it are found too.
    """
    step = eps / _SAFE_M_PER_DEG
    cell = tiles.withColumn("cx", F.floor(F.col("lon_lo") / _lon_step(F.col("row"), step, eps)))
    edge = 2 * F.least(F.lit(180.0), _lon_step(F.col("row"), step, eps))
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("lon_lo") <= edge - 180, 360.0), F.when(F.col("lon_hi") >= 180 - edge, -360.0)))
    far = tiles.withColumn("turn", F.explode(turns)).withColumn("lon_lo", F.col("lon_lo") + F.col("turn")).withColumn(
        "lon_hi", F.col("lon_hi") + F.col("turn"))
    far = far.withColumn("row", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)))
    width = _lon_step(F.col("row"), step, eps)
    far = far.withColumn("cx", F.explode(F.sequence(
        F.floor(F.col("lon_lo") / width) - 1, F.floor(F.col("lon_hi") / width) + 1)))
    fields = ["tile", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "feed_lo", "feed_hi", *(["fresh"] if fresh_only else [])]
    a = far.select(*group, "row", "cx", *[F.col(c).alias(f"a_{c}") for c in fields])
    b = cell.select(*group, "row", "cx", *[F.col(c).alias(f"b_{c}") for c in fields])
    c = F.col
    pairs = a.join(b, [*group, "row", "cx"]).where("a_tile < b_tile")
    if fresh_only:
        pairs = pairs.where("a_fresh OR b_fresh")
    dlat_max = F.greatest(c("a_lat_hi"), c("b_lat_hi")) - F.least(c("a_lat_lo"), c("b_lat_lo"))
    dlon_max = F.greatest(c("a_lon_hi"), c("b_lon_hi")) - F.least(c("a_lon_lo"), c("b_lon_lo"))
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), c(lo2) - c(hi1), c(lo1) - c(hi2))
    dlat_min = gap("a_lat_lo", "a_lat_hi", "b_lat_lo", "b_lat_hi")
    dlon_min = gap("a_lon_lo", "a_lon_hi", "b_lon_lo", "b_lon_hi")
    lo_abs = F.least(F.abs("a_lat_lo"), F.abs("a_lat_hi"), F.abs("b_lat_lo"), F.abs("b_lat_hi"))
    hi_abs = F.greatest(F.abs("a_lat_lo"), F.abs("a_lat_hi"), F.abs("b_lat_lo"), F.abs("b_lat_hi"))
    lo_abs = F.when(F.least(c("a_lat_lo"), c("b_lat_lo")) * F.greatest(c("a_lat_hi"), c("b_lat_hi")) <= 0,
                    F.lit(0.0)).otherwise(lo_abs)
    plane = lambda dlat, dlon, cos: F.lit(111_194.93) * F.sqrt(dlat * dlat + dlon * cos * dlon * cos)
    at_most = plane(dlat_max, dlon_max, F.cos(F.radians(lo_abs))) * 1.001
    polar = hi_abs > _POLAR_LAT  # a way across the pole is shorter than along a parallel
    at_least = plane(dlat_min, F.when(polar, F.lit(0.0)).otherwise(dlon_min), F.cos(F.radians(hi_abs))) / 1.001
    points = (c("a_lat_lo") == c("a_lat_hi")) & (c("a_lon_lo") == c("a_lon_hi")) & (
        c("b_lat_lo") == c("b_lat_hi")) & (c("b_lon_lo") == c("b_lon_hi"))
    exact = haversine_m(c("a_lat_lo"), c("a_lon_lo"), c("b_lat_lo"), c("b_lon_lo")) <= eps
    sure = F.when(points, exact).otherwise(at_most <= eps)
    maybe = ~points & (at_most > eps) & (at_least <= eps)
    feeds_differ = F.least("a_feed_lo", "b_feed_lo") < F.greatest("a_feed_hi", "b_feed_hi")
    return pairs.where(sure | maybe).select(
        "a_tile", "b_tile", sure.alias("sure"), feeds_differ.alias("feeds_differ"))


def _tile_boxes(placed: DataFrame, group: list[str]) -> DataFrame:
    return placed.groupBy(*group, "row", "tile").agg(
        F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
        F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"),
        F.min("feed_id").alias("feed_lo"), F.max("feed_id").alias("feed_hi"))


def _close_points(maybe: DataFrame, sites: DataFrame, eps: float, extra: Column) -> DataFrame:
    """Check undecided tile pairs point by point. ``sites``: distinct places of each tile."""
    side = lambda x: sites.select(*[F.col(c).alias(f"{x}_{c}") for c in sites.columns])
    near = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= eps
    return maybe.join(side("a"), "a_tile").join(side("b"), "b_tile").where(near & extra)


def spatial_scopes(points: DataFrame, eps: float) -> DataFrame:
    """Label points (key, feed_id, lat, lon) with the cluster they reach by hops of at most ``eps`` metres.

    Exact, yet no pair of points is formed inside a dense spot: tiles stand for their points, most tile pairs
    are decided by their bounding boxes, and only undecided pairs between still separate clusters are checked
    point by point.
    """
    placed = _tiles(points, eps, [])
    pairs = cut_lineage(_tile_pairs(cut_lineage(_tile_boxes(placed, [])), eps, []))
    sure = pairs.where("sure").select(F.col("a_tile").alias("src"), F.col("b_tile").alias("dst"))
    labels = connected_components(sure)
    maybe = pairs.where("NOT sure")
    if not maybe.isEmpty():
        name = lambda x: labels.select(F.col("node").alias(f"{x}_tile"), F.col("component").alias(f"{x}_c"))
        joined = maybe.join(name("a"), "a_tile", "left").join(name("b"), "b_tile", "left").select(
            "a_tile", "b_tile", F.coalesce("a_c", "a_tile").alias("a_c"), F.coalesce("b_c", "b_tile").alias("b_c"))
        apart = joined.where("a_c <> b_c")
        sites = placed.select("tile", "lat", "lon").distinct()
        found = _close_points(apart, sites, eps, F.lit(True)).select(
            F.col("a_c").alias("src"), F.col("b_c").alias("dst")).distinct()
        known = labels.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        labels = connected_components(known.unionByName(found))
    scope = labels.select(F.col("node").alias("tile"), F.col("component"))
    return placed.join(scope, "tile", "left").select(
        "key", F.coalesce("component", "tile").alias("scope"))


def extend_scopes(points: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """``spatial_scopes`` where some points (key, feed_id, lat, lon, scope) have their scope already.

    Only tiles with a point without scope are linked; what they reach is merged by its labels. Returns the scopes of the
    new points (key, scope) and the labels that changed (old, new). Labels are those of linking all points anew.
    """
    placed = cut_lineage(_tiles(points, eps, []))
    boxes = _tile_boxes(placed, []).join(
        placed.groupBy("tile").agg(F.bool_or(F.col("scope").isNull()).alias("fresh")), "tile")
    pairs = cut_lineage(_tile_pairs(boxes, eps, [], fresh_only=True))
    known = placed.where("scope IS NOT NULL").select(F.col("tile").alias("src"), F.col("scope").alias("dst")).distinct()
    met = pairs.select(F.col("a_tile").alias("src")).unionByName(pairs.select(F.col("b_tile").alias("src"))).unionByName(
        placed.where("scope IS NULL").select(F.col("tile").alias("src"))).distinct()
    known = known.join(met, "src", "left_semi")
    sure = pairs.where("sure").select(F.col("a_tile").alias("src"), F.col("b_tile").alias("dst"))
    labels = connected_components(sure.unionByName(known))
    name = lambda x: labels.select(F.col("node").alias(f"{x}_tile"), F.col("component").alias(f"{x}_c"))
    joined = pairs.where("NOT sure").join(name("a"), "a_tile", "left").join(name("b"), "b_tile", "left").select(
        "a_tile", "b_tile", F.coalesce("a_c", "a_tile").alias("a_c"), F.coalesce("b_c", "b_tile").alias("b_c"))
    sites = placed.select("tile", "lat", "lon").distinct()
    found = _close_points(joined.where("a_c <> b_c"), sites, eps, F.lit(True)).select(
        F.col("a_c").alias("src"), F.col("b_c").alias("dst")).distinct()
    found = cut_lineage(found)
    if not found.isEmpty():
        labels = connected_components(labels.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(found))
    labels = labels.select(F.col("node").alias("tile"), "component")
    scopes = placed.where("scope IS NULL").join(labels, "tile", "left").groupBy("key").agg(
        F.min(F.coalesce("component", "tile")).alias("scope"))
    merged = known.select(F.col("dst").alias("tile")).distinct().join(labels, "tile").where("tile <> component").select(
        F.col("tile").alias("old"), F.col("component").alias("new"))
    return scopes, merged


def cross_feed_links(points: DataFrame, eps: float, group: str) -> DataFrame:
    """Edges linking points (key, feed_id, lat, lon, group) of one group, different feeds, within ``eps``.

    A group that lies within the radius as a whole is one star. Of others, tiles whose points all link up stand for them,
    so a group that repeats at one place costs one edge a point.
    """
    # Only groups present in several feeds can link at all.
    shared = points.groupBy(group).agg(
        F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"),
        F.max("lon").alias("lon_hi"), F.min("feed_id").alias("lo"), F.max("feed_id").alias("hi"),
        F.bool_and(F.col("feed_id").isNotNull()).alias("named")).where("lo < hi")
    points = cut_lineage(points.join(shared.select(group, (F.col("named") & _within(eps)).alias("within")), group))
    star = points.where("within").select(
        F.col("key").alias("src"), F.concat_ws("\u0001", F.lit("group"), group).alias("dst"))
    placed = _tiles(points.where("NOT within"), eps, [group])
    boxes = cut_lineage(_tile_boxes(placed, [group]))
    pairs = cut_lineage(_tile_pairs(boxes, eps, [group]).where("feeds_differ"))
    sure = pairs.where("sure").select(F.col("a_tile").alias("src"), F.col("b_tile").alias("dst"))
    whole = boxes.where("feed_lo < feed_hi").select("tile").unionByName(
        sure.select(F.col("src").alias("tile"))).unionByName(sure.select(F.col("dst").alias("tile"))).distinct()
    attach = placed.join(whole, "tile", "left_semi").select(F.col("key").alias("src"), F.col("tile").alias("dst"))
    sites = placed.select("tile", "key", "lat", "lon", "feed_id")
    found = _close_points(pairs.where("NOT sure"), sites, eps, F.col("a_feed_id") != F.col("b_feed_id")).select(
        F.col("a_key").alias("src"), F.col("b_key").alias("dst"))
    return star.unionByName(attach).unionByName(sure).unionByName(found)


def _within(eps: float) -> Column:
    """Whether a box (lat_lo, lat_hi, lon_lo, lon_hi) is surely no wider than ``eps``; never near a pole."""
    far, near = F.greatest(F.abs("lat_lo"), F.abs("lat_hi")), F.least(F.abs("lat_lo"), F.abs("lat_hi"))
    near = F.when(F.col("lat_lo") * F.col("lat_hi") <= 0, F.lit(0.0)).otherwise(near)
    dlat, dlon = F.col("lat_hi") - F.col("lat_lo"), (F.col("lon_hi") - F.col("lon_lo")) * F.cos(F.radians(near))
    return (far <= _POLAR_LAT) & (F.lit(111_194.93) * F.sqrt(dlat * dlat + dlon * dlon) * 1.001 <= eps)
