"""Geometry diff of line shapes: a direction-aware buffer overlay, scoped per line and direction.

Every shape is sampled along its length; a sample is inside when the other feed's shapes of the same line and
direction pass within the tolerance and run the same way (or touch). Stretches of equal samples become runs.

The work is keyed by (pair, line, direction, grid cell), never gathered per line. Shapes with equal vertices
are computed once, and a shape that is drawn identically in both feeds is unchanged without any sampling.
"""

from __future__ import annotations

import heapq
import itertools
import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions.geo import (fixed, half_up, haversine_m, plane_x, plane_y, point_segment_dist_m,
                                        point_segment_dist_sq)
from transitlapse.operators import service as S
from transitlapse.operators.diff import PAIR, route_entry_members
from transitlapse.operators.registry import Registry
from transitlapse.schema import Feeds
from transitlapse.session import cut_lineage, working_tables

# Ship this module's task code with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values in metres (and one cosine): tolerance, sampling step, same-corridor distance, direction gate,
# reroute corridor and coverage, shortest run kept.
TOL_M = 25.0
STEP_M = 12.5
TOUCH_M = 5.0
COS_MIN = math.cos(math.pi / 4)
REROUTE_M = 150.0
REROUTE_COVER = 0.6
MIN_RUN_M = 40.0
CELL_M = 50.0
REROUTE_CELL_M = 300.0
# Grid of an overlay within a line: few segments share a cell there, so wider cells repeat each of them less often.
LINE_CELL_M = 100.0
# Grid on which segments meet whole segments, within a line and in overlays of whole feeds: wide against a segment, so
# that few of them are repeated.
SEGMENT_CELL_M = 400.0
FEED_SEGMENT_CELL_M = 100.0
# Bucket of a line whose feeds disagree on directions: all its shapes together.
UNION = -9

SCOPE = [*PAIR, "canonical_id", "bucket"]
# Inside the overlay a scoped line and a distinct geometry go by short numbers, not by their long ids.
LINE = ["line_no"]
GEOM = ["line_no", "side", "g"]


# ---- which shapes meet which ------------------------------------------------------------------------------

def route_pairs(registry: Registry, routes: DataFrame) -> DataFrame:
    """Raw routes of each diffed line and side; a side without rows has no counterpart."""
    return route_entry_members(registry, routes).select(
        *PAIR, F.col("entry_id").alias("canonical_id"), "side", "feed_id", F.col("raw_id").alias("route_id"))


def scoped_shapes(feeds: Feeds, lines: DataFrame) -> DataFrame:
    """Distinct existing shapes of each line and side with their dominant direction."""
    owned = S.shape_routes(feeds).select("feed_id", "shape_id", "route_id")
    real = S.shape_points(feeds).select("feed_id", "shape_id").distinct()
    return (
        lines.join(owned, ["feed_id", "route_id"]).select(*PAIR, "canonical_id", "side", "feed_id", "shape_id")
        .distinct().join(real, ["feed_id", "shape_id"], "left_semi")
        .join(S.shape_direction(feeds), ["feed_id", "shape_id"], "left")
        .withColumn("dir", F.coalesce("direction_id", F.lit(-1))).drop("direction_id")
    )


def direction_buckets(shapes: DataFrame) -> DataFrame:
    """Per line: directions on each side and whether they may be compared one by one."""
    on = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("dir"))))
    per = shapes.groupBy(*PAIR, "canonical_id").agg(on("a").alias("dirs_a"), on("b").alias("dirs_b"))
    split = (F.size("dirs_a") >= 2) & (F.col("dirs_a") == F.col("dirs_b")) & ~F.array_contains("dirs_a", -1)
    return per.withColumn("split", split).withColumn("two_sided", (F.size("dirs_a") > 0) & (F.size("dirs_b") > 0))


# ---- geometry building blocks -----------------------------------------------------------------------------

#: Vertices dealt to one task: what its sorts hold stays the same however many lines there are.
VERTICES_A_TASK = 500_000


def _dealt(geoms: DataFrame, keys: list[str]) -> DataFrame:
    """``geoms`` dealt by their keys to as many tasks as their vertices ask for.

    Lines are shuffled as arrays and grow many times in the windows behind, so the size of a shuffle block says little.
    """
    geoms = cut_lineage(geoms)
    n = geoms.agg(F.sum(F.size("coords"))).first()[0] or 0
    cores = geoms.sparkSession.sparkContext.defaultParallelism
    return geoms.repartition(max(cores, -(-n // VERTICES_A_TASK)), *keys)


def vertices(geoms: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices of each geometry without immediate repeats, with arc position and neighbours."""
    order = W.partitionBy(*keys).orderBy("i")
    pts = _dealt(geoms.select(*keys, "coords"), keys).select(*keys, F.posexplode("coords").alias("i", "p")).select(
        *keys, "i", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    same = (F.lag("lon").over(order) == F.col("lon")) & (F.lag("lat").over(order) == F.col("lat"))
    pts = pts.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same")).drop("same")
    pts = pts.withColumn("x", plane_x(F.col("lon"))).withColumn("y", plane_y(F.col("lat")))
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    pts = pts.withColumn("leg", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return pts.withColumn("arc", F.sum("leg").over(order)).drop("leg")


def tangents(verts: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the direction at their start: from one step behind it to one step ahead along the line."""
    part = W.partitionBy(*keys)
    fwd, rev = part.orderBy("u"), part.orderBy("v")
    here = verts.withColumn("u", F.col("arc") / STEP_M).withColumn("v", -F.col("u"))
    c = F.col
    for name in ("lon", "lat", "x", "y", "u"):
        here = here.withColumn(f"n_{name}", F.lead(name).over(fwd))
    for name in ("x", "y", "u"):
        here = here.withColumn(f"p_{name}", F.lag(name).over(fwd))
    behind = F.last(F.struct("u", "x", "y", "n_u", "n_x", "n_y")).over(fwd.rangeBetween(W.unboundedPreceding, -1))
    ahead = F.last(F.struct("u", "x", "y", "p_u", "p_x", "p_y")).over(rev.rangeBetween(W.unboundedPreceding, -1))
    here = (
        here.withColumn("behind", behind).withColumn("ahead", ahead)
        .withColumn("first", F.first(F.struct("x", "y")).over(fwd))
        .withColumn("last", F.first(F.struct("x", "y")).over(rev))
    )
    tb = (c("u") - 1 - c("behind.u")) / (c("behind.n_u") - c("behind.u"))
    ta = (c("u") + 1 - c("ahead.p_u")) / (c("ahead.u") - c("ahead.p_u"))
    mix = lambda a, b, t: a + t * (b - a)
    bx, by = (F.when(c("behind").isNull(), c(f"first.{k}")).otherwise(
        mix(c(f"behind.{k}"), c(f"behind.n_{k}"), tb)) for k in "xy")
    ax, ay = (F.when(c("ahead").isNull(), c(f"last.{k}")).otherwise(
        mix(c(f"ahead.p_{k}"), c(f"ahead.{k}"), ta)) for k in "xy")
    out = here.where("n_u IS NOT NULL").select(
        *keys, "i", "lon", "lat", "x", "y", "n_lon", "n_lat", "n_x", "n_y", (ax - bx).alias("tx"), (ay - by).alias("ty"),
        c("p_u").isNull().alias("first"))
    norm = F.sqrt(c("tx") * c("tx") + c("ty") * c("ty"))
    unit = lambda t: F.when(norm == 0, F.lit(0.0)).otherwise(t / norm)
    return out.withColumn("ux", unit(c("tx"))).withColumn("uy", unit(c("ty"))).drop("tx", "ty")


def settle(segments: DataFrame) -> DataFrame:
    """Segments with ``settled``: the other side of their line has the same segment, either way round.

    Every point of such a segment is inside: it lies on the other side's copy.
    """
    ahead = F.struct("x", "y") <= F.struct("n_x", "n_y")
    ends = {f"e_{k}": F.when(ahead, F.col(p)).otherwise(F.col(q)) for k, p, q in (
        ("x", "x", "n_x"), ("y", "y", "n_y"), ("n_x", "n_x", "x"), ("n_y", "n_y", "y"))}
    keyed = segments.withColumns(ends)
    shared = keyed.groupBy(*LINE, *ends).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi")
    return keyed.join(shared.select(*LINE, *ends, F.lit(True).alias("settled")), [*LINE, *ends], "left").withColumn(
        "settled", F.coalesce("settled", F.lit(False))).drop(*ends)


def _steps() -> Column:
    """Number of steps between a segment's samples."""
    length = haversine_m(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    return F.greatest(F.ceil(length / STEP_M), F.lit(1))


def samples_of(segments: DataFrame, keys: list[str], settled: Column | None = None) -> DataFrame:
    """Evenly spaced probe points at most one step apart, each with its segment's direction.

    ``s`` counts within the segment; ``vertex`` marks the line's own vertices. The first vertex is (i, 0). Segments
    that are ``settled`` are alike all along, so their vertices and first step say everything; the rest is left out.
    Samples of segments that know their stretches (``with_covered``) carry them.
    """
    cut = segments.withColumn("n", _steps())
    if "first" not in segments.columns:
        cut = cut.withColumn("first", F.row_number().over(W.partitionBy(*keys).orderBy("i")) == 1)
    start = F.when(F.col("first"), 0).otherwise(1).cast("long")
    steps = F.sequence(start, F.col("n"))
    if settled is not None:
        steps = F.when(settled, F.array_distinct(F.array(start, F.lit(1).cast("long"), F.col("n")))).otherwise(steps)
    cut = cut.withColumn("s", F.explode(steps))
    t = F.col("s") / F.col("n")
    at = lambda c: F.when(F.col("s") == F.col("n"), F.col(f"n_{c}")).otherwise(
        F.col(c) + t * (F.col(f"n_{c}") - F.col(c)))
    out = cut.select(*keys, "i", "s", at("lon").alias("lon"), at("lat").alias("lat"), "ux", "uy",
                     ((F.col("s") == 0) | (F.col("s") == F.col("n"))).alias("vertex"),
                     (F.lit(False) if settled is None else settled).alias("settled"),
                     *(["n", "covered"] if "covered" in segments.columns else []))
    return out.drop("settled") if settled is None else out


def spread(segments: DataFrame, cell: float, reach: float, reach_x: Column | None = None) -> DataFrame:
    """Repeat each segment for every grid cell that may hold a point within ``reach`` of it, once per cell.

    Per grid column only the part of the segment near that column counts, so a long diagonal touches a band of
    cells and not its whole bounding box. ``reach_x`` gives the x axis its own reach.
    """
    c = F.col
    rx = F.lit(reach) if reach_x is None else reach_x
    lo, hi = F.least("x", "n_x") - rx, F.greatest("x", "n_x") + rx
    cols = segments.withColumn("cx", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    dx, dy = c("n_x") - c("x"), c("n_y") - c("y")
    clip = lambda at: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - c("x")) / dx))
    left, right = c("cx") * cell - rx, (c("cx") + 1) * cell + rx
    y_at = lambda at: c("y") + clip(at) * dy
    flat = F.abs(dx) < 1e-12
    y0 = F.when(flat, F.least("y", "n_y")).otherwise(F.least(y_at(left), y_at(right)))
    y1 = F.when(flat, F.greatest("y", "n_y")).otherwise(F.greatest(y_at(left), y_at(right)))
    return cols.withColumn("cy", F.explode(F.sequence(F.floor((y0 - reach) / cell), F.floor((y1 + reach) / cell))))


def same_street(px: Column, py: Column, ux: Column, uy: Column) -> Column:
    """Whether the point with a direction lies on the street of segment ``o_*``."""
    c = F.col
    d = point_segment_dist_sq(px, py, c("o_x"), c("o_y"), c("o_n_x"), c("o_n_y"))
    dot = F.abs(c("o_ux") * ux + c("o_uy") * uy)
    return (d <= TOL_M * TOL_M) & ((d <= TOUCH_M * TOUCH_M) | (dot >= COS_MIN))


def _facing(cells: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Segments renamed ``o_*`` and put under the side they are looked at from."""
    seen_from = F.when(F.col("side") == "a", "b").otherwise("a")
    return cells.select(*[k for k in keys if k != "side"], seen_from.alias("side"), "cx", "cy",
                        *[F.col(f).alias(f"o_{f}") for f in fields])


def inside_flags(samples: DataFrame, cells: DataFrame | None = None, cell: float = CELL_M) -> DataFrame:
    """Samples with ``inside``: some segment of the other side matches. ``cells`` comes from ``spread`` with this ``cell``.

    Samples that carry the stretches of their segment need no cells: they are inside where a stretch holds them.
    """
    if "covered" in samples.columns:
        at, n = F.col("s"), F.col("n")
        held = F.exists("covered", lambda p: (p["lo"] * n <= at) & (at <= p["hi"] * n))
        return samples.withColumn("inside", held).drop("covered", "n")
    x, y = plane_x(F.col("lon")), plane_y(F.col("lat"))  # made anew in the join, so they are not sent to it
    probe = samples.withColumn("cx", F.floor(x / cell)).withColumn("cy", F.floor(y / cell))
    on = [*LINE, "side", "cx", "cy"]
    other = _facing(cells, LINE, ["x", "y", "n_x", "n_y", "ux", "uy"]).select(
        *[F.col(k).alias(f"k_{k}") for k in on], "o_x", "o_y", "o_n_x", "o_n_y", "o_ux", "o_uy")
    cond = same_street(x, y, F.col("ux"), F.col("uy"))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"k_{k}"))
    matched = probe.join(other, cond, "left").select(
        *GEOM, "i", "s", "cx", "cy", "lon", "lat", "ux", "uy", "vertex", F.col("k_side").isNotNull().alias("hit"))
    # Grouping by the join's own keys too keeps a sample's matches where the join left them: no shuffle.
    return matched.groupBy(*GEOM, "i", "s", "cx", "cy").agg(
        *[F.any_value(k).alias(k) for k in ("lon", "lat", "ux", "uy", "vertex")], F.bool_or("hit").alias("inside")
    ).drop("cx", "cy")


def marked_points(flagged: DataFrame) -> DataFrame:
    """Vertices, and samples whose state differs from the one before (``flip``), with their raw run number."""
    order = W.partitionBy(*GEOM).orderBy("i", "s")
    before = flagged.withColumn("before", F.lag(F.struct("lon", "lat", "inside")).over(order))
    flip = F.coalesce(F.col("before.inside") != F.col("inside"), F.lit(False))
    counted = before.withColumn("flip", flip).withColumn("run", F.sum(F.col("flip").cast("int")).over(order).cast("int"))
    return counted.where("vertex OR flip")


# ---- crossings --------------------------------------------------------------------------------------------

def _covered_span(near: DataFrame) -> DataFrame:
    """``near`` with ``lo`` and ``hi``: first and last position, as fractions of the line a-b, at which segment ``o_*`` covers it.

    The covered set is the line cut by a capsule around the segment: two discs and the band between them. Values that
    are needed more than once are columns of their own, worked out once: as one expression the code would be beyond what
    the virtual machine compiles.
    """
    c = F.col
    near = near.withColumns({
        "dx": c("b_x") - c("a_x"), "dy": c("b_y") - c("a_y"), "ex": c("o_n_x") - c("o_x"), "ey": c("o_n_y") - c("o_y"),
        "fx": c("a_x") - c("o_x"), "fy": c("a_y") - c("o_y"), "gx": c("a_x") - c("o_n_x"), "gy": c("a_y") - c("o_n_y"),
        "r": F.when(F.abs(c("o_ux") * c("ux") + c("o_uy") * c("uy")) >= COS_MIN, F.lit(TOL_M)).otherwise(F.lit(TOUCH_M))})
    near = near.withColumns({
        "length": F.sqrt(c("ex") * c("ex") + c("ey") * c("ey")), "sq": c("dx") * c("dx") + c("dy") * c("dy"),
        "half_1": c("dx") * c("fx") + c("dy") * c("fy"), "half_2": c("dx") * c("gx") + c("dy") * c("gy")})
    root = lambda half, fx, fy: c(half) * c(half) - c("sq") * (c(fx) * c(fx) + c(fy) * c(fy) - c("r") * c("r"))
    near = near.withColumns({
        "root_1": root("half_1", "fx", "fy"), "root_2": root("half_2", "gx", "gy"),
        "across": (c("fx") * -c("ey") + c("fy") * c("ex")) / c("length"),
        "across_slope": (c("dx") * -c("ey") + c("dy") * c("ex")) / c("length"),
        "along": (c("fx") * c("ex") + c("fy") * c("ey")) / c("length"),
        "along_slope": (c("dx") * c("ex") + c("dy") * c("ey")) / c("length")})

    def band(name: str, lo: Column, hi: Column) -> dict[str, Column]:
        at, slope = c(name), c(f"{name}_slope")
        flat, inside = F.abs(slope) < 1e-12, (at >= lo) & (at <= hi)
        p, q = (lo - at) / slope, (hi - at) / slope
        return {f"{name}_lo": F.when(flat, F.when(inside, F.lit(-1e9))).otherwise(F.least(p, q)),
                f"{name}_hi": F.when(flat, F.when(inside, F.lit(1e9))).otherwise(F.greatest(p, q))}

    near = near.withColumns(band("across", -c("r"), c("r")) | band("along", F.lit(0.0), c("length")))
    # Where a band is missed altogether, both of its ends are null.
    known = c("across_lo").isNotNull() & c("along_lo").isNotNull()
    near = near.withColumns({
        "band_lo": F.when(known, F.greatest("across_lo", "along_lo")), "band_hi": F.when(known, F.least("across_hi", "along_hi"))})
    strip = c("band_lo") <= c("band_hi")
    disc = lambda half, root, sign: F.when(c(root) >= 0, (-c(half) + sign * F.sqrt(root)) / c("sq"))
    # The three parts overlap, so their union is one stretch; least and greatest skip the empty ones.
    return near.withColumns({
        "lo": F.least(disc("half_1", "root_1", -1), disc("half_2", "root_2", -1), F.when(strip, c("band_lo"))),
        "hi": F.greatest(disc("half_1", "root_1", 1), disc("half_2", "root_2", 1), F.when(strip, c("band_hi")))})


def with_covered(segments: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """``segments`` with ``covered``: the stretches (lo, hi), as fractions of the segment, that ``others`` cover.

    ``others`` are segments too; those of the other side of the same line count. Both meet in the grid cells that the
    segment passes, so what is sent is one row for each segment and cell, not one for each sample. A segment covered as
    a whole has the one stretch (0, 1).
    """
    c = F.col
    kept = [k for k in segments.columns if k not in ("x", "y", "n_x", "n_y", *GEOM, "i")]
    on = [*LINE, "side", "cx", "cy"]
    light = segments.select(*GEOM, "i", *kept)
    planes = lambda df: df.withColumns({
        "x": plane_x(c("lon")), "y": plane_y(c("lat")), "n_x": plane_x(c("n_lon")), "n_y": plane_y(c("n_lat"))})
    # The reach keeps rounding from losing a cell that a segment just touches.
    probe = spread(planes(light), cell, 0.001).select(*GEOM, "i", *kept, "cx", "cy")
    other = _facing(spread(others, cell, TOL_M), LINE, ["x", "y", "n_x", "n_y", "ux", "uy"]).select(
        *[c(k).alias(f"k_{k}") for k in on], *[f"o_{k}" for k in ("x", "y", "n_x", "n_y", "ux", "uy")])
    near = F.lit(True)
    for k, p in (("x", plane_x), ("y", plane_y)):
        here, there = p(c("lon" if k == "x" else "lat")), p(c("n_lon" if k == "x" else "n_lat"))
        near = near & (F.least(here, there) - (TOL_M + 0.001) <= F.greatest(f"o_{k}", f"o_n_{k}")) & (
            F.greatest(here, there) + (TOL_M + 0.001) >= F.least(f"o_{k}", f"o_n_{k}"))
    for k in on:
        near = near & (c(k) == c(f"k_{k}"))
    met = probe.join(other, near, "left").withColumns({
        "a_x": plane_x(c("lon")), "a_y": plane_y(c("lat")), "b_x": plane_x(c("n_lon")), "b_y": plane_y(c("n_lat"))})
    spans = _covered_span(met).select(
        *GEOM, "i", *kept, "lo", "hi", F.coalesce((c("lo") <= 0) & (c("hi") >= 1), F.lit(False)).alias("full"))
    part = F.when(~c("full") & (c("lo") <= 1) & (c("hi") >= 0), F.struct("lo", "hi"))
    found = spans.groupBy(*GEOM, "i").agg(
        *[F.any_value(k).alias(k) for k in kept], F.bool_or("full").alias("full"), F.collect_set(part).alias("parts"))
    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    return found.withColumn("covered", F.when(c("full"), whole).otherwise(c("parts"))).drop("full", "parts")


def even() -> Column:
    """Whether all samples of a segment with ``covered`` are alike: nothing or the whole of it is covered."""
    return (F.size("covered") == 0) | F.exists("covered", lambda p: (p["lo"] <= 0) & (p["hi"] >= 1))


def _spans(flips: DataFrame, stretches: DataFrame) -> DataFrame:
    """Stretches of each flipping step, as fractions of the step, that segments of the other side cover.

    ``stretches``: segments with ``covered``. A segment that is not among them is settled, so covered as a whole.
    """
    c = F.col
    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    known = flips.select(*GEOM, "i", "s").join(
        stretches.select(*GEOM, "i", _steps().alias("n"), "covered"), [*GEOM, "i"], "left")
    each = known.withColumn("p", F.explode(F.coalesce("covered", whole)))
    at = lambda k: F.when(c("covered").isNull(), c(f"p.{k}")).otherwise(c(f"p.{k}") * c("n") - (c("s") - 1))
    return each.select(*GEOM, "i", "s", at("lo").alias("lo"), at("hi").alias("hi")).distinct()


def _narrow(flips: DataFrame, spans: DataFrame) -> DataFrame:
    """One halving round of six steps: which of 64 parts of [t0, t0 + w] holds the crossing.

    Each covered stretch says in one 64-bit mask which of the 63 inner points it holds; the masks are or-ed,
    so nothing is collected, and the six halvings read the bits.
    """
    c = F.col
    key = [*GEOM, "i", "s"]
    near = spans.join(flips.select(*key, "t0", "w"), key)
    first = F.greatest(F.lit(1), F.ceil((c("lo") - c("t0")) / c("w") * 64))
    last = F.least(F.lit(63), F.floor((c("hi") - c("t0")) / c("w") * 64))
    near = near.select(*key, first.cast("int").alias("k0"), last.cast("int").alias("k1")).where("k0 <= k1")
    # Bits k0..k1 set: all bits from k0 up, minus all bits from k1 + 1 up.
    from_bit = lambda k: F.when(k > 63, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("long"), k))
    mask = from_bit(c("k0")).bitwiseXOR(from_bit(c("k1") + 1))
    masks = near.groupBy(*key).agg(F.bit_or(mask).alias("mask"))
    joined = flips.join(masks, key, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))).withColumn(
        "part", F.lit(0))
    for half in (32, 16, 8, 4, 2, 1):
        mid = c("part") + half
        bit = F.call_function("shiftright", c("mask"), mid).bitwiseAND(F.lit(1).cast("long")) == 1
        joined = joined.withColumn("part", F.when(bit == c("a_inside"), mid).otherwise(c("part")))
    return joined.withColumn("t0", c("t0") + c("w") * c("part") / 64.0).withColumn(
        "w", c("w") / 64.0).select(*flips.columns)


def crossings(marked: DataFrame, stretches: DataFrame) -> DataFrame:
    """Where the state changes between two samples, to 1/4096 of their distance. ``stretches``: segments with ``covered``."""
    flips = marked.where("flip").select(
        *GEOM, "i", "s", F.col("before.inside").alias("a_inside"),
        F.col("before.lon").alias("a_lon"), F.col("before.lat").alias("a_lat"),
        F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    spans = cut_lineage(_spans(flips, stretches))
    flips = flips.withColumn("t0", F.lit(0.0)).withColumn("w", F.lit(1.0))
    found = _narrow(_narrow(flips, spans), spans)
    t = F.col("t0") + F.col("w") / 2
    at = lambda c: F.col(f"a_{c}") + t * (F.col(f"b_{c}") - F.col(f"a_{c}"))
    return found.select(*GEOM, "i", "s", at("lon").alias("lon"), at("lat").alias("lat"))


# ---- runs -------------------------------------------------------------------------------------------------

def merge_short(lengths: list[float], inside: list[bool], shortest: float) -> list[tuple[int, bool]]:
    """New run number and state of each run of one shape, once no run is shorter than ``shortest``.

    The shortest run left (the first of equals) joins its longer neighbour, the left one on a tie, until all are long
    enough. A queue holds each run's length; lengths that have changed since are passed over. Every run then has the
    state of the one it ended up in, and a new number starts where the state changes.
    """
    size, joined = list(lengths), list(range(len(lengths)))
    before, after = [k - 1 for k in joined], [k + 1 for k in joined]
    queue = list(zip(size, joined))
    heapq.heapify(queue)
    while queue:
        length, k = heapq.heappop(queue)
        if joined[k] != k or length != size[k]:
            continue
        left, right = before[k], after[k]
        beside = [j for j in (left, right) if 0 <= j < len(size)]
        if length >= shortest or not beside:
            break
        into = max(beside, key=lambda j: size[j])
        joined[k], size[into] = into, size[into] + length
        heapq.heappush(queue, (size[into], into))
        if left >= 0:
            after[left] = right
        if right < len(size):
            before[right] = left

    def state(k: int) -> bool:
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return inside[k]

    states = [state(k) for k in range(len(size))]
    changes = [int(k == 0 or states[k] != states[k - 1]) for k in range(len(size))]
    return [(n - 1, st) for n, st in zip(itertools.accumulate(changes), states)]


def smoothing(shortest: float) -> Callable:
    @F.pandas_udf("array<struct<number:int,inside:boolean>>")
    def smooth(lengths: pd.Series, inside: pd.Series) -> pd.Series:
        return pd.Series([[{"number": n, "inside": bool(st)} for n, st in merge_short(list(ln), list(st_in), shortest)]
                          for ln, st_in in zip(lengths, inside)])
    return smooth


def run_points(marked: DataFrame, crossed: DataFrame, shortest: float = MIN_RUN_M) -> DataFrame:
    """Ordered points of each geometry's runs: own vertices plus one shared point per crossing."""
    state = F.struct("run", "inside")
    own = marked.where("vertex").select(*GEOM, "i", "s", F.lit(1).alias("k"), "lon", "lat", state.alias("r"))
    flips = marked.where("flip").select(*GEOM, "i", "s", F.explode(F.array(
        F.struct(F.col("run"), F.col("inside")),
        F.struct((F.col("run") - 1).alias("run"), (~F.col("inside")).alias("inside")))).alias("r"))
    shared = crossed.join(flips, [*GEOM, "i", "s"]).select(*GEOM, "i", "s", F.lit(0).alias("k"), "lon", "lat", "r")
    points = cut_lineage(own.unionByName(shared).select(*GEOM, "i", "s", "k", "lon", "lat", "r.run", "r.inside"))

    lengths = _run_lengths(points, [*GEOM, "run"]).withColumnRenamed("length_m", "len")
    states = points.groupBy(*GEOM, "run").agg(F.any_value("inside").alias("inside"))
    per = lengths.join(states, [*GEOM, "run"])
    rough = per.groupBy(*GEOM).agg(F.min("len").alias("low"), F.count("*").alias("n")).where(
        (F.col("low") < shortest) & (F.col("n") > 1)).select(*GEOM)
    listed = per.join(rough, GEOM, "left_semi").groupBy(*GEOM).agg(
        F.array_sort(F.collect_list(F.struct("run", "len", "inside"))).alias("runs"))
    smooth = smoothing(shortest)
    merged = (
        listed.withColumn("to", smooth(F.col("runs.len"), F.col("runs.inside")))
        .select(*GEOM, F.posexplode("to").alias("run", "t"))
        .select(*GEOM, "run", F.col("t.number").alias("new_run"), F.col("t.inside").alias("new_inside"))
    )
    joined = points.join(merged, [*GEOM, "run"], "left").select(
        *GEOM, F.coalesce("new_run", "run").alias("run"), F.coalesce("new_inside", "inside").alias("inside"),
        "i", "s", "k", "lon", "lat")
    # A crossing swallowed by a merge appears under both of its old runs: keep it once.
    return joined.distinct()


def _run_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("i", "s", "k")
    leg = haversine_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return points.withColumn("leg", leg).groupBy(*keys).agg(F.coalesce(F.sum("leg"), F.lit(0.0)).alias("length_m"))


def _ordered_coords(points: DataFrame, keys: list[str]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("i", "s", "k", "lon", "lat")))
    return points.groupBy(*keys).agg(F.transform(listed, lambda p: F.struct(
        p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


# ---- reroutes ---------------------------------------------------------------------------------------------

def _run_segments(points: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("i", "s", "k")
    out = points.select(*keys, F.row_number().over(order).alias("j"), "lon", "lat",
                        F.lead("lon").over(order).alias("n_lon"), F.lead("lat").over(order).alias("n_lat"))
    for p in ("", "n_"):
        out = out.withColumn(f"{p}x", plane_x(F.col(f"{p}lon"))).withColumn(f"{p}y", plane_y(F.col(f"{p}lat")))
    return out.where("n_lon IS NOT NULL")


def _near(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Samples with a segment of the other side inside the reroute corridor."""
    cells = spread(segments, REROUTE_CELL_M, REROUTE_M).where("x <> n_x OR y <> n_y")
    on = [*LINE, "side", "cx", "cy"]
    other = _facing(cells, LINE, ["x", "y", "n_x", "n_y"]).select(
        *[F.col(k).alias(f"k_{k}") for k in on], "o_x", "o_y", "o_n_x", "o_n_y")
    probe = samples.withColumn("x", plane_x(F.col("lon"))).withColumn("y", plane_y(F.col("lat")))
    probe = probe.withColumn("cx", F.floor(F.col("x") / REROUTE_CELL_M)).withColumn(
        "cy", F.floor(F.col("y") / REROUTE_CELL_M))
    c = F.col
    cond = point_segment_dist_sq(c("x"), c("y"), c("o_x"), c("o_y"), c("o_n_x"), c("o_n_y")) <= REROUTE_M ** 2
    for k in on:
        cond = cond & (c(k) == c(f"k_{k}"))
    return probe.join(other, cond, "left_semi")


def reroutes(points: DataFrame) -> DataFrame:
    """Lost and new runs that are one reroute: each covers most of its length near the other side, and lies
    near an opposite run that does so too. Returns (GEOM, run)."""
    run = [*GEOM, "run"]
    lone = points.where("NOT inside")
    both = lone.groupBy(*LINE).agg(F.count_distinct("side").alias("n")).where("n = 2").select(*LINE)
    segments = cut_lineage(_run_segments(lone.join(both, LINE, "left_semi"), run))
    length = haversine_m(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    last = F.col("j") == F.max("j").over(W.partitionBy(*run))
    # Each segment gives its start and its inner points; a run's last one gives its end too.
    n = F.greatest(F.ceil(length / STEP_M), F.lit(1))
    cut = segments.withColumn("n", n).withColumn("last", last).withColumn(
        "s", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("last"), F.col("n")).otherwise(F.col("n") - 1))))
    t = F.col("s") / F.col("n")
    at = lambda c: F.col(c) + t * (F.col(f"n_{c}") - F.col(c))
    samples = cut.select(*run, "j", "s", at("lon").alias("lon"), at("lat").alias("lat"))
    total = samples.groupBy(*run).agg(F.count("*").alias("total"))
    covered = _near(samples, segments).groupBy(*run).agg(F.count("*").alias("covered"))
    passing = cut_lineage(total.join(covered, run).where(F.col("covered") / F.col("total") >= REROUTE_COVER).select(*run))
    return _near(samples.join(passing, run, "left_semi"), segments.join(passing, run, "left_semi")).select(*run).distinct()


# ---- the diff ---------------------------------------------------------------------------------------------

def _lines_with_digest(feeds: Feeds, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Coordinate arrays of the wanted shapes with a digest that is equal for equal lines."""
    points = S.shape_points(feeds).join(wanted.select(*key).distinct(), key, "left_semi")
    lines = S.collect_lines(points)
    return cut_lineage(lines.withColumn("digest", F.sha2(F.to_json("coords"), 256)))


def overlay(units: DataFrame, lines: DataFrame, shortest: float = MIN_RUN_M,
            cell: float = FEED_SEGMENT_CELL_M) -> tuple[DataFrame, DataFrame]:
    """Compare the two sides of every line.

    ``units``: SCOPE columns, side, feed_id, shape_id, digest of shapes on two-sided lines.
    Returns the ordered run points of every geometry that needed comparing, and the list of all distinct
    geometries (SCOPE, line_no, side, g, digest, twin).
    """
    with working_tables(units.sparkSession) as keep:
        numbers = cut_lineage(units.select(*SCOPE).distinct().withColumn("line_no", F.monotonically_increasing_id()))
        geoms = units.join(numbers, SCOPE).groupBy(*SCOPE, "line_no", "digest").agg(
            *[F.min(F.when(F.col("side") == s, F.struct("feed_id", "shape_id"))).alias(f"rep_{s}") for s in "ab"])
        twin = F.col("rep_a").isNotNull() & F.col("rep_b").isNotNull()
        reps = geoms.withColumn("twin", twin).select(*SCOPE, "line_no", "digest", "twin", F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("rep_a").alias("rep")),
            F.struct(F.lit("b").alias("side"), F.col("rep_b").alias("rep")))).alias("e")).where("e.rep IS NOT NULL")
        reps = keep(cut_lineage(reps.select(
            *SCOPE, "line_no", "e.side", "digest", "twin", F.col("e.rep.feed_id").alias("feed_id"),
            F.col("e.rep.shape_id").alias("shape_id"), F.monotonically_increasing_id().alias("g"))))
        active = reps.where("NOT twin").select(*LINE).distinct()
        drawn = reps.join(active, LINE, "left_semi").join(lines, ["feed_id", "shape_id"])
        verts = vertices(drawn.select(*GEOM, "twin", "coords"), [*GEOM, "twin"])
        segments = cut_lineage(tangents(verts, [*GEOM, "twin"]))
        asked = cut_lineage(settle(segments).where("NOT twin").drop("twin", "x", "y", "n_x", "n_y"))
        stretches = cut_lineage(with_covered(asked.where("NOT settled").drop("settled"), segments, cell))
        known = samples_of(asked.where("settled"), GEOM, F.lit(True)).withColumn("inside", F.lit(True))
        open_ = inside_flags(samples_of(stretches, GEOM, even()))
        marked = cut_lineage(marked_points(known.unionByName(open_).drop("settled")))
        points = keep(cut_lineage(run_points(marked, crossings(marked, stretches), shortest)))
        return points, reps


def _typed_runs(points: DataFrame, rerouted: DataFrame) -> DataFrame:
    run = [*GEOM, "run"]
    lengths = _run_lengths(points, run)
    coords = _ordered_coords(points, run)
    states = points.groupBy(*run).agg(F.any_value("inside").alias("inside"))
    lost = F.when(F.col("side") == "a", "removed").otherwise("added")
    return (
        lengths.join(coords, run).join(states, run)
        .join(rerouted.withColumn("rerouted", F.lit(True)), run, "left")
        .withColumn("status", F.when(F.col("inside"), "unchanged").when(F.col("rerouted"), "changed").otherwise(lost))
        .withColumn("changed_side", F.when(F.col("rerouted") & ~F.col("inside"),
                                           F.when(F.col("side") == "a", "old").otherwise("new")))
        .select(*run, "status", "changed_side", "length_m", "coords")
    )


def polyline_length(coords: Column) -> Column:
    """Length of an ordered coordinate array in metres."""
    legs = F.zip_with(
        F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))),
        F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))),
        lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda acc, d: acc + d)


RUN_COLUMNS = [*PAIR, "canonical_id", "side", "feed_id", "shape_id", "direction_id", "run", "status", "changed_side",
               "length_m", "coords"]


def _spread_to_shapes(units: DataFrame, reps: DataFrame, typed: DataFrame, lines: DataFrame) -> DataFrame:
    """Give every shape the runs of its geometry; identically drawn shapes are one unchanged run."""
    direction = F.when(F.col("bucket") != UNION, F.col("bucket")).alias("direction_id")
    own = [*SCOPE, "side", "digest"]
    placed = cut_lineage(units.join(reps.select(*own, "g", "twin"), own).drop("digest"))
    moved = placed.where("NOT twin").join(typed.drop("line_no", "side"), "g")
    kept = (
        placed.where("twin")
        .join(lines.select("feed_id", "shape_id", "coords"), ["feed_id", "shape_id"])
        .withColumn("length_m", polyline_length(F.col("coords"))).where("length_m > 0")
        .withColumn("run", F.lit(0)).withColumn("status", F.lit("unchanged"))
        .withColumn("changed_side", F.lit(None).cast("string"))
    )
    return moved.withColumn("direction_id", direction).select(*RUN_COLUMNS).unionByName(
        kept.withColumn("direction_id", direction).select(*RUN_COLUMNS))


def geometry_diff(feeds: Feeds, registry: Registry, routes: DataFrame, shortest: float = MIN_RUN_M) -> DataFrame:
    """Runs of every shape of every diffed line; one-sided lines are whole removed or added shapes."""
    return diff_lines(feeds, route_pairs(registry, routes), shortest)


def diff_lines(feeds: Feeds, line_routes: DataFrame, shortest: float = MIN_RUN_M) -> DataFrame:
    """``geometry_diff`` for given lines: feed_a, feed_b, canonical_id, side, feed_id, route_id."""
    with working_tables(feeds.spark) as keep:
        shapes = cut_lineage(scoped_shapes(feeds, line_routes))
        lines = _lines_with_digest(feeds, shapes, ["feed_id", "shape_id"])
        buckets = direction_buckets(shapes).select(*PAIR, "canonical_id", "split", "two_sided")
        placed = shapes.join(buckets, [*PAIR, "canonical_id"]).withColumn(
            "bucket", F.when(F.col("split"), F.col("dir")).otherwise(UNION))
        units = cut_lineage(placed.where("two_sided").join(
            lines.select("feed_id", "shape_id", "digest"), ["feed_id", "shape_id"]).select(
            *SCOPE, "side", "feed_id", "shape_id", "digest"))
        points, reps = overlay(units, lines, shortest, SEGMENT_CELL_M)
        typed = _typed_runs(points, reroutes(points))
        two = _spread_to_shapes(units, reps, typed, lines)
        alone = (
            placed.where("NOT two_sided").join(lines.select("feed_id", "shape_id", "coords"), ["feed_id", "shape_id"])
            .withColumn("direction_id", F.when(F.col("dir") >= 0, F.col("dir"))).withColumn("run", F.lit(0))
            .withColumn("status", F.when(F.col("side") == "a", "removed").otherwise("added"))
            .withColumn("changed_side", F.lit(None).cast("string"))
            .withColumn("length_m", polyline_length(F.col("coords")))
        )
        return keep(cut_lineage(two.unionByName(alone.select(*RUN_COLUMNS))))


def feedwide_diff(feeds: Feeds, pairs: DataFrame, shortest: float = MIN_RUN_M) -> DataFrame:
    """The same overlay against all shapes of the other feed, whatever their line; no reroutes."""
    with working_tables(feeds.spark) as keep:
        side = lambda s: pairs.select(*PAIR, F.lit(s).alias("side"), F.col(f"feed_{s}").alias("feed_id"))
        lines = _lines_with_digest(feeds, side("a").unionByName(side("b")), ["feed_id"])
        units = side("a").unionByName(side("b")).join(lines.select("feed_id", "shape_id", "digest"), "feed_id").withColumn(
            "canonical_id", F.lit("")).withColumn("bucket", F.lit(UNION)).select(
            *SCOPE, "side", "feed_id", "shape_id", "digest")
        units = cut_lineage(units)
        points, reps = overlay(units, lines, shortest)
        none = points.select(*GEOM, "run").limit(0)
        return keep(cut_lineage(_spread_to_shapes(units, reps, _typed_runs(points, none), lines)))


# ---- what is drawn and counted ----------------------------------------------------------------------------

def run_features(feeds: Feeds, runs: DataFrame, routes: DataFrame, prefer: str = "a",
                 keep_reroutes: bool = True) -> DataFrame:
    """Accepted runs, each drawn once, with line status and mode flags.

    Unchanged stretches exist in both feeds; the ``prefer`` copy is drawn, and both on rerouted lines.
    """
    c = F.col
    accepted = runs.where((c("status") != "unchanged") | (c("side") == prefer))
    if keep_reroutes:
        bent = runs.where("status = 'changed'").select(*PAIR, "canonical_id").distinct()
        other = runs.where((c("status") == "unchanged") & (c("side") != prefer))
        accepted = accepted.unionByName(other.join(bent, [*PAIR, "canonical_id"], "left_semi"))
    ends = [c("coords")[0].alias("head"), F.element_at("coords", -1).alias("tail")]
    once = accepted.select("*", *ends).groupBy(*PAIR, "side", "shape_id", "status", "head", "tail").agg(
        F.min_by(F.struct("canonical_id", "feed_id", "direction_id", "run", "changed_side", "length_m", "coords"),
                 F.struct("canonical_id", "run")).alias("r")).select(*PAIR, "side", "shape_id", "status", "r.*")
    line_status = routes.select(*PAIR, "canonical_id", F.when(
        c("status").isin("removed", "added"), c("status")).otherwise("present").alias("line_status"))
    traits = S.shape_modes(feeds).select("feed_id", "shape_id", "route_id", "modes", "primary_mode")
    return (
        once.join(line_status, [*PAIR, "canonical_id"], "left").join(traits, ["feed_id", "shape_id"], "left")
        .withColumn("line_status", F.coalesce("line_status", F.lit("none")))
        .select("*", *M.mode_flags(c("modes"))).drop("modes")
    )


def geometry_lengths(features: DataFrame) -> DataFrame:
    """Metres per geometry status (unchanged counted on A, reroutes on the new side) and per lost or new line."""
    c = F.col
    counts = F.when(c("status") == "unchanged", c("side") == "a").when(
        c("status") == "changed", c("changed_side") == "new").otherwise(F.lit(True))
    metres = lambda cond: F.coalesce(F.sum(F.when(cond, c("length_m"))), F.lit(0.0))
    return features.groupBy(*PAIR).agg(
        *[metres(counts & (c("status") == s)).alias(f"{s}_m") for s in ("added", "removed", "unchanged", "changed")],
        metres(c("line_status") == "removed").alias("lines_removed_m"),
        metres(c("line_status") == "added").alias("lines_added_m"))


def coords_json(coords: Column) -> Column:
    pair = lambda p: F.concat(F.lit("["), fixed(p["lon"]), F.lit(","), fixed(p["lat"]), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(coords, pair), ","), F.lit("]"))


def rerouted_lines(runs: DataFrame) -> DataFrame:
    """Per line: any run not unchanged, any paired reroute, and the directions that can be shown alone."""
    return runs.groupBy(*PAIR, "canonical_id").agg(
        F.bool_or(F.col("status") != "unchanged").alias("geometry_changed"),
        F.bool_or(F.col("status") == "changed").alias("rerouted"),
        F.array_sort(F.collect_set("direction_id")).alias("directions"))


def new_alignments(features: DataFrame) -> DataFrame:
    return features.where("status = 'changed' AND changed_side = 'new'")


def line_runs(runs: DataFrame, canonical_id: str, direction: int | None = None, side: str | None = None) -> DataFrame:
    """Runs of one line, optionally of one direction or side."""
    out = runs.where(F.col("canonical_id") == canonical_id)
    if direction is not None:
        out = out.where(F.col("direction_id") == direction)
    return out.where(F.col("side") == side) if side else out


def route_km_delta(feeds: Feeds, registry: Registry, routes: DataFrame) -> DataFrame:
    """Kilometres of added and removed lines: the longest shape of each of their routes."""
    lone = routes.where("status IN ('added', 'removed')")
    raws = route_entry_members(registry, lone).select(*PAIR, "status", "feed_id", F.col("raw_id").alias("route_id"))
    owned = feeds.trips.where("shape_id IS NOT NULL").select("feed_id", "route_id", "shape_id").distinct()
    longest = owned.join(S.shape_lengths(feeds), ["feed_id", "shape_id"]).groupBy("feed_id", "route_id").agg(
        (F.max("length_m") / 1000).alias("km"))
    km = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("km"))), F.lit(0.0))
    return raws.join(longest, ["feed_id", "route_id"], "left").groupBy(*PAIR).agg(
        km("added").alias("added_km"), km("removed").alias("removed_km"))


def stops_near_lines(points: DataFrame, runs: DataFrame, tol_m: float) -> DataFrame:
    """Points (feed_a, feed_b, canonical_id, point_id, lon, lat) within ``tol_m`` of that line's runs.

    The grid is in degrees of the point's own scale, so cells are widened by latitude on the segment side.
    """
    order = W.partitionBy(*PAIR, "canonical_id", "side", "shape_id", "run").orderBy("i")
    pts = runs.select(*PAIR, "canonical_id", "side", "shape_id", "run", F.posexplode("coords").alias("i", "p"))
    segs = pts.select(*PAIR, "canonical_id", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"),
                      F.lead("p.lon").over(order).alias("n_x"), F.lead("p.lat").over(order).alias("n_y")
                      ).where("n_x IS NOT NULL").distinct()
    # Degrees that surely hold the tolerance at the latitude of the segment's end nearer to a pole.
    deg = tol_m / 111_320.0
    pole = F.least(F.lit(90.0), F.greatest(F.abs("y"), F.abs("n_y")) + deg)
    wide = F.least(F.lit(360.0), deg / F.greatest(F.cos(F.radians(pole)), F.lit(1e-6)))
    cell = max(deg * 2, 0.0005)
    cells = spread(segs, cell, deg, wide).select(
        *[F.col(k).alias(f"k_{k}") for k in [*PAIR, "canonical_id", "cx", "cy"]],
        *[F.col(k).alias(f"o_{k}") for k in ("x", "y", "n_x", "n_y")])
    probe = points.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    c = F.col
    cond = point_segment_dist_m(c("lon"), c("lat"), c("o_x"), c("o_y"), c("o_n_x"), c("o_n_y")) <= tol_m
    for k in [*PAIR, "canonical_id", "cx", "cy"]:
        cond = cond & (c(k) == c(f"k_{k}"))
    return probe.join(cells, cond, "left_semi").drop("cx", "cy")
