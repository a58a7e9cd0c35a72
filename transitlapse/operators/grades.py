"""Accessibility grades A..G on a fixed raster: stop categories, best grade per cell, change between feeds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlapse.functions.geo import EARTH_RADIUS_M, cell_polygon, half_up, haversine_m
from transitlapse.operators import service as S
from transitlapse.operators.diff import PAIR
from transitlapse.schema import Feeds
from transitlapse.session import cut_lineage

# Fixed values of the grading method and its raster.
GRID_WEST, GRID_NORTH = -20.0, 60.0
PX_PER_DEG = 1 / 0.0008333333300327
WINDOW_MIN = 840.0
MODE_CATEGORY = {"rail": 2, "metro": 2, "tram": 3, "bus": 4, "other": 4}
STOP_CATEGORY = [  # rows: interval class 0..7, columns: mode category 1..4
    [1, 1, 2, 3], [1, 2, 3, 3], [2, 3, 4, 4], [3, 4, 5, 5],
    [4, 5, 6, 6], [5, 6, 7, 7], [None, 7, 8, 8], [None, None, None, None],
]
DISTANCE_BREAKS_M = [300, 500, 750, 1000, 1250]
MAX_RADIUS_M = [1250, 1250, 1250, 1000, 1000, 750, 500, 300]  # by stop category 1..8
GRADE = [  # rows: stop category 1..8, columns: distance class 0..4
    [0, 0, 1, 2, 3], [0, 1, 2, 3, 4], [1, 2, 3, 4, 5], [2, 3, 4, 5, 6],
    [3, 4, 5, 6, 6], [4, 5, 6, None, None], [5, 6, 6, None, None], [6, 6, None, None, None],
]
LETTERS = ["A", "B", "C", "D", "E", "F", "G"]
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII"]


@dataclass(frozen=True)
class CellWindow:
    """A request's cut of the raster: five numbers that become literals in the plan."""

    west: float
    north: float
    cell_x: float
    cell_y: float
    cols: int
    rows: int


def cell_window(bbox: tuple[float, float, float, float]) -> CellWindow:
    """The raster's own cells that a request covers."""
    w, s, e, n = bbox
    px = lambda deg: math.floor(deg * PX_PER_DEG + 0.5)
    left, right, top, bottom = px(w - GRID_WEST), px(e - GRID_WEST), px(GRID_NORTH - n), px(GRID_NORTH - s)
    return CellWindow(GRID_WEST + left / PX_PER_DEG, GRID_NORTH - top / PX_PER_DEG, 1 / PX_PER_DEG, 1 / PX_PER_DEG,
                      max(0, right - left), max(0, bottom - top))


def _lookup(table: list, at: Column) -> Column:
    """Element ``at`` (0-based) of a constant list; holes and positions outside are null."""
    return F.get(F.array(*[F.lit(v) for v in table]), at.cast("int"))


def interval_class(minutes: Column) -> Column:
    return (
        F.when(minutes < 5, 0).when(minutes <= 10, 1).when(minutes < 20, 2).when(minutes <= 40, 3)
        .when(minutes <= 60, 4).when(minutes <= 120, 5).when(minutes <= 210, 6).otherwise(7)
    )


def mode_category(mode: Column) -> Column:
    expr = None
    for m, k in MODE_CATEGORY.items():
        expr = F.when(mode == m, k) if expr is None else expr.when(mode == m, k)
    return expr.otherwise(4)


def grade_at(category: int, metres: Column) -> Column:
    """Grade that a stop of a category gives at a distance; null beyond its reach."""
    expr = None
    for b, grade in zip(DISTANCE_BREAKS_M, GRADE[category - 1]):
        if grade is not None:
            expr = F.when(metres <= b, grade) if expr is None else expr.when(metres <= b, grade)
    return expr


def stop_categories(feeds: Feeds) -> DataFrame:
    """Stops with service enough to rank, in category 1 (best) to 8."""
    # Each of the two is written out: their shuffles of all calls need not be there together.
    modes, departures = cut_lineage(S.stop_modes(feeds).drop("modes")), cut_lineage(S.stop_departures(feeds))
    joined = modes.join(departures, ["feed_id", "stop_id"]).where("departures > 0")
    out = (
        joined.withColumn("interval_min", F.lit(WINDOW_MIN) / (F.col("departures") * 0.5))
        .withColumn("interval_class", interval_class(F.col("interval_min")))
        .withColumn("mode_category", mode_category(F.col("primary_mode")))
    )
    flat = [v for row in STOP_CATEGORY for v in row]
    category = _lookup(flat, F.col("interval_class") * 4 + F.col("mode_category") - 1)
    return out.withColumn("category", category).where("category IS NOT NULL").select(
        "feed_id", "stop_id", "stop_name", "lat", "lon", "departures", "interval_min", "interval_class",
        "mode_category", "category")


#: Columns and rows of one block of the raster: what a place is sent to, and what is grouped together.
BLOCK_COLS = 256
BLOCK_ROWS = 64


def row_intervals(places: DataFrame, win: CellWindow) -> DataFrame:
    """The columns that each place reaches in each raster row, cut at blocks of columns (strip, row, block, c0, c1).

    A place is sent once to each block of the raster (strip of rows, block of columns) that its circle's box meets; its
    rows come into being behind that shuffle. The chord of the circle in a row follows from the haversine formula; it is
    taken a cell wider on either side, the exact test is left to the cells.
    """
    radius = _lookup(MAX_RADIUS_M, F.col("category") - 1)
    d_lat = radius / F.lit(111_000.0)
    d_lon = radius / (F.lit(111_000.0) * F.greatest(F.lit(0.01), F.cos(F.radians("lat"))))

    def span(at: Column, reach: Column, size: float, count: int) -> tuple[Column, Column]:
        lo = F.ceil((at - reach) / F.lit(size) - 0.5)
        hi = F.floor((at + reach) / F.lit(size) - 0.5)
        return F.greatest(F.lit(0), lo).cast("int"), F.least(F.lit(count - 1), hi).cast("int")

    r0, r1 = span(F.lit(win.north) - F.col("lat"), d_lat, win.cell_y, win.rows)
    c0, c1 = span(F.col("lon") - F.lit(win.west), d_lon, win.cell_x, win.cols)
    boxed = lambda df: df.withColumn("radius", radius).withColumn("r0", r0).withColumn("r1", r1).withColumn(
        "box0", c0).withColumn("box1", c1)
    sent = (
        boxed(places).where("r0 <= r1 AND box0 <= box1")
        .withColumn("strip", F.explode(F.sequence(F.expr(f"r0 div {BLOCK_ROWS}").cast("int"), F.expr(f"r1 div {BLOCK_ROWS}").cast("int"))))
        .withColumn("block", F.explode(F.sequence(F.expr(f"box0 div {BLOCK_COLS}").cast("int"), F.expr(f"box1 div {BLOCK_COLS}").cast("int"))))
        .select("feed_id", "strip", "block", "lat", "lon", "category").repartition("feed_id", "strip", "block")
    )
    top = F.greatest(F.col("r0"), F.col("strip") * BLOCK_ROWS)
    bottom = F.least(F.col("r1"), F.col("strip") * BLOCK_ROWS + (BLOCK_ROWS - 1))
    rows = boxed(sent).withColumn("row", F.explode(F.sequence(top, bottom))).withColumn(
        "row_lat", F.lit(win.north) - (F.col("row") + 0.5) * F.lit(win.cell_y))
    square = lambda x: x * x
    left = square(F.sin(F.col("radius") / F.lit(2 * EARTH_RADIUS_M))) - square(F.sin(F.radians(F.col("row_lat") - F.col("lat")) / 2))
    across = F.cos(F.radians("row_lat")) * F.cos(F.radians("lat"))
    # Rounding must not lose a row that the circle just touches.
    reach = F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), left) / across))))
    at = F.col("lon") - F.lit(win.west)
    begin = F.col("block") * BLOCK_COLS
    chord = (
        rows.where(left >= -1e-12)
        .withColumn("c0", F.greatest(F.col("box0"), F.ceil((at - reach) / F.lit(win.cell_x) - 1.5)).cast("int"))
        .withColumn("c1", F.least(F.col("box1"), F.floor((at + reach) / F.lit(win.cell_x) + 0.5)).cast("int"))
    )
    return chord.select("feed_id", "strip", "row", "block", "lat", "lon", "category", "radius", "row_lat",
                        F.greatest("c0", begin).alias("c0"), F.least("c1", begin + (BLOCK_COLS - 1)).alias("c1")).where("c0 <= c1")


def grade_grid(stops: DataFrame, win: CellWindow) -> DataFrame:
    """Best grade of every covered cell per feed, with the distance and category that give it.

    Stops at one place and category count once. What is shuffled is a place for each block of the raster that it reaches;
    rows and cells come into being behind it and are reduced where they are, by a hash aggregate that keeps the nearest
    place of each category. Within a category the nearest place has the best grade.
    """
    if not win.cols or not win.rows:
        win = CellWindow(win.west, win.north, 1.0, 1.0, 0, 0)
    places = stops.select("feed_id", "lat", "lon", "category").distinct()
    keys = ["feed_id", "strip", "block", "row"]
    cells = row_intervals(places, win).withColumn("col", F.explode(F.sequence("c0", "c1")))
    cell_lon = F.lit(win.west) + (F.col("col") + 0.5) * F.lit(win.cell_x)
    near = cells.withColumn("dist_m", haversine_m(F.col("lat"), F.col("lon"), F.col("row_lat"), cell_lon)).where("dist_m <= radius")
    categories = range(1, len(GRADE) + 1)
    nearest = near.groupBy(*keys, "col").agg(*[F.min(F.when(F.col("category") == k, F.col("dist_m"))).alias(f"_{k}") for k in categories])
    # One small projection after another, each value worked out once: as one expression the code is beyond what the
    # virtual machine compiles, and every cell goes through its interpreter.
    graded = nearest.select("feed_id", "row", "col", *[f"_{k}" for k in categories], *[
        grade_at(k, F.col(f"_{k}")).alias(f"g_{k}") for k in categories])
    best = graded.withColumn("grade", F.least(*[F.col(f"g_{k}") for k in categories])).where("grade IS NOT NULL")
    won = lambda k: F.col(f"g_{k}") == F.col("grade")
    best = best.withColumn("dist_m", F.least(*[F.when(won(k), F.col(f"_{k}")) for k in categories]))
    category = F.coalesce(*[F.when(won(k) & (F.col(f"_{k}") == F.col("dist_m")), k) for k in categories])
    return best.select("feed_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"),
                       "grade", "dist_m", category.alias("category"))


def _corners(win: CellWindow) -> tuple[Column, Column, Column, Column]:
    w = F.lit(win.west) + F.col("col") * F.lit(win.cell_x)
    n = F.lit(win.north) - F.col("row") * F.lit(win.cell_y)
    return w, n - F.lit(win.cell_y), w + F.lit(win.cell_x), n


def grade_cells(grid: DataFrame, win: CellWindow) -> DataFrame:
    return grid.select(
        "feed_id", "row", "col", F.col("grade").alias("class"), _lookup(LETTERS, F.col("grade")).alias("class_letter"),
        _lookup(ROMAN, F.col("category") - 1).alias("category"), half_up(F.col("dist_m")).alias("distance_m"),
        cell_polygon(*_corners(win)).alias("geometry"))


def grade_summary(grid: DataFrame, stops: DataFrame, win: CellWindow) -> DataFrame:
    """Cells per grade, cells without any, and ranked stops of each feed."""
    per = grid.groupBy("feed_id").agg(
        *[F.count_if(F.col("grade") == i).alias(f"cells_{x}") for i, x in enumerate(LETTERS)],
        F.count("*").alias("covered"))
    n = stops.groupBy("feed_id").agg(F.count("*").alias("stop_count"))
    return n.join(per, "feed_id", "left").na.fill(0).withColumn("cell_count", F.lit(win.cols * win.rows)).withColumn(
        "no_coverage", F.col("cell_count") - F.col("covered"))


def grade_change(grid: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells covered on either side of each pair and how their grade moved."""
    side = lambda x: pairs.select(*PAIR).join(
        grid.select(F.col("feed_id").alias(f"feed_{x}"), "row", "col", F.col("grade").alias(f"class_{x}")),
        f"feed_{x}")
    change = (
        F.when(F.col("class_a").isNull(), "gained").when(F.col("class_b").isNull(), "lost")
        .when(F.col("class_b") < F.col("class_a"), "improved")
        .when(F.col("class_b") > F.col("class_a"), "degraded").otherwise("unchanged")
    )
    return side("a").join(side("b"), [*PAIR, "row", "col"], "full_outer").withColumn("change", change).na.fill(
        -1, ["class_a", "class_b"])


def grade_change_cells(change: DataFrame, win: CellWindow) -> DataFrame:
    return change.withColumn("geometry", cell_polygon(*_corners(win)))


def grade_change_summary(change: DataFrame) -> DataFrame:
    names = ["improved", "degraded", "unchanged", "gained", "lost"]
    return change.groupBy(*PAIR).agg(
        *[F.count_if(F.col("change") == n).alias(n) for n in names], F.count("*").alias("cell_count"))
