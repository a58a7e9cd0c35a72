"""Population on a fixed pixel lattice: grids, density, change, and districts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions.geo import M_PER_DEG, cell_polygon
from transitlapse.operators.diff import PAIR
from transitlapse.operators.numbering import nearest_rank

# Lattice origin and pitch, year coverage, unit of the yearly series.
ORIGIN_WEST, ORIGIN_NORTH = -180.00041593133002, 89.09208317767579
PX_PER_DEG = 1 / 0.0008333333300327
FIRST_YEAR, LAST_YEARLY, EPOCH_YEAR = 2000, 2021, 2025
YEARLY_UNIT = 1 / 100
DISTRICT_YEAR = 2026

Bbox = tuple[float, float, float, float]


@dataclass(frozen=True)
class PixelWindow:
    left: int
    top: int
    width: int
    height: int
    level: int
    cols: int
    rows: int
    west: float
    north: float
    cell_x: float
    cell_y: float


def pixel_window(bbox: Bbox, level: int = 1) -> PixelWindow:
    """The pixels of a request in cells of ``level`` x ``level`` pixels; the last row and column may be cut off."""
    w, s, e, n = bbox
    px = lambda deg: math.floor(deg * PX_PER_DEG + 0.5)
    left, right = px(w - ORIGIN_WEST), px(e - ORIGIN_WEST)
    top, bottom = px(ORIGIN_NORTH - n), px(ORIGIN_NORTH - s)
    width, height = max(0, right - left), max(0, bottom - top)
    if not width or not height:
        return PixelWindow(left, top, 0, 0, level, 0, 0, w, n, 1.0, 1.0)
    return PixelWindow(left, top, width, height, level, math.ceil(width / level), math.ceil(height / level),
                       ORIGIN_WEST + left / PX_PER_DEG, ORIGIN_NORTH - top / PX_PER_DEG,
                       level / PX_PER_DEG, level / PX_PER_DEG)


def population_year(year: Column) -> Column:
    """Year of data shown for a feed's year: clamped to the yearly series, beyond it the nearer edition."""
    y = F.floor(year + 0.5).cast("int")
    nearer_epoch = F.abs(F.lit(EPOCH_YEAR) - y) <= y - LAST_YEARLY
    return F.when(y <= FIRST_YEAR, FIRST_YEAR).when(y <= LAST_YEARLY, y).when(
        nearer_epoch, EPOCH_YEAR).otherwise(LAST_YEARLY).cast("int")


def pixel_counts(pixels: DataFrame) -> DataFrame:
    """Pixels (yr, px_row, px_col, value) as people: the yearly series stores hundredths."""
    unit = F.when(F.col("yr") == EPOCH_YEAR, F.lit(1.0)).otherwise(F.lit(YEARLY_UNIT))
    return pixels.select("yr", "px_row", "px_col", (F.col("value") * unit).alias("people"))


def population_grid(pixels: DataFrame, win: PixelWindow) -> DataFrame:
    """People per output cell and year, summed over the window's pixels; empty cells have no row."""
    cell = lambda c, first: F.floor((F.col(c) - first) / win.level)
    return (
        pixel_counts(pixels)
        .where((F.col("px_col") >= win.left) & (F.col("px_col") < win.left + win.width)
               & (F.col("px_row") >= win.top) & (F.col("px_row") < win.top + win.height))
        .select("yr", cell("px_row", win.top).alias("row"), cell("px_col", win.left).alias("col"), "people")
        .groupBy("yr", "row", "col").agg(F.sum(F.col("people").cast("decimal(28,6)")).cast("double").alias("people"))
    )


def cell_hectares(win: PixelWindow) -> Column:
    lat = F.lit(win.north) - (F.col("row") + 0.5) * F.lit(win.cell_y)
    return F.lit(win.cell_x * win.cell_y * M_PER_DEG * M_PER_DEG / 10_000) * F.cos(F.radians(lat))


def density_scale(pixels: DataFrame, extent: PixelWindow) -> DataFrame:
    """Per year: 95th percentile and top density over the feed's whole extent."""
    grid = population_grid(pixels, extent).where("people > 0").withColumn(
        "density", F.col("people") / cell_hectares(extent))
    return nearest_rank(grid, ["yr"], "density")


def population_density(pixels: DataFrame, view: PixelWindow, extent: PixelWindow) -> DataFrame:
    grid = population_grid(pixels, view).where("people > 0").withColumn(
        "density", F.col("people") / cell_hectares(view))
    return _with_norm(grid.join(density_scale(pixels, extent), "yr", "left"), "density")


def _with_norm(df: DataFrame, density: str) -> DataFrame:
    unit = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    norm = M.clamp(F.col(density) / unit, 0.0, 1.0)
    return df.withColumn("norm", norm).withColumn("class", M.step_class(F.col("norm"), M.POPULATION_BREAKS))


def population_summary(density: DataFrame, view: PixelWindow) -> DataFrame:
    return density.groupBy("yr").agg(
        F.count("*").alias("cell_count"), F.first("top").alias("max_density"), F.first("scale").alias("scale_density")
    ).withColumn("cell_m", F.lit(math.floor(view.cell_y * M_PER_DEG + 0.5)))


def population_cells(density: DataFrame, view: PixelWindow) -> DataFrame:
    w = F.lit(view.west) + F.col("col") * F.lit(view.cell_x)
    n = F.lit(view.north) - F.col("row") * F.lit(view.cell_y)
    return density.withColumn(
        "geometry", cell_polygon(w, n - F.lit(view.cell_y), w + F.lit(view.cell_x), n))


def population_delta(pixels: DataFrame, year_pairs: DataFrame, view: PixelWindow, extent: PixelWindow) -> DataFrame:
    """Per compared pair (feed_a, feed_b, year_a, year_b): change per cell, or B alone when both feeds show
    the same edition. Cells without change and without people in B are dropped."""
    c = F.col
    years = year_pairs.select(*PAIR, population_year(c("year_a")).alias("yr_a"),
                              population_year(c("year_b")).alias("yr_b"))
    mode = F.when(c("yr_a") == c("yr_b"), "absolute").otherwise("delta")
    grid = population_grid(pixels, view)
    side = lambda x: years.join(
        grid.select(c("yr").alias(f"yr_{x}"), "row", "col", c("people").alias(f"people_{x}")), f"yr_{x}")
    keys = [*PAIR, "yr_a", "yr_b", "row", "col"]
    cells = (
        side("a").join(side("b"), keys, "full_outer").na.fill(0.0, ["people_a", "people_b"])
        .withColumn("mode", mode).withColumn("delta", c("people_b") - c("people_a"))
        .where((c("delta") != 0) | (c("people_b") > 0))
    )
    area = cell_hectares(view)
    scale = density_scale(pixels, extent).select(c("yr").alias("yr_b"), "scale")
    out = cells.join(scale, "yr_b", "left").withColumn("density_b", c("people_b") / area)
    delta_ha = F.when(c("mode") == "delta", c("delta") / area)
    return (
        _with_norm(out, "density_b").drop("scale")
        .withColumn("density_a", c("people_a") / area).withColumn("delta_ha", delta_ha)
        .withColumn("delta_class", F.when(c("mode") == "delta", M.step_class(c("delta_ha"), M.POPULATION_DELTA_BREAKS)))
    )


def districts_in(districts: DataFrame, bbox: Bbox) -> DataFrame:
    """Districts whose box meets the requested one."""
    w, s, e, n = bbox
    return districts.where((F.col("max_lon") >= w) & (F.col("min_lon") <= e)
                           & (F.col("max_lat") >= s) & (F.col("min_lat") <= n))


def district_population(districts: DataFrame, people: DataFrame, view: Bbox, extent: Bbox) -> DataFrame:
    """Populated districts of the view, on the scale of the whole extent."""
    populated = lambda box: districts_in(districts, box).join(people, "g_id").where("population > 0")
    scale = nearest_rank(populated(extent), [], "population").agg(F.max("scale")).scalar()
    shown = populated(view).withColumn("scale", scale)
    return _with_norm(shown.withColumn("population", F.col("population").cast("double")), "population").withColumn(
        "year", F.lit(DISTRICT_YEAR))
