"""Stored population pyramid: sums over square blocks of pixels, kept by level, year and tile.

A level is a table of cells of ``level`` x ``level`` pixels, counted from the lattice's origin, in folders by year and
by tile of ``tile`` x ``tile`` cells. Inside a tile cells lie in the order of a space-filling key, so a window
reads its own tiles and, of these, the row groups it meets. Each level is summed from the coarsest finer level that
divides it, exactly, so pixels are summed once. A year that comes again takes the place of the year stored before; a run
that was lost is repeated as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlapse.operators.population import PixelWindow, pixel_counts, pixel_window

SCHEMA = "row int, col int, people decimal(28,6), yr int, tile_row int, tile_col int"
_TILE = ["yr", "tile_row", "tile_col"]


@dataclass(frozen=True)
class Pyramid:
    path: str
    levels: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64)
    tile: int = 4096

    def folder(self, level: int) -> str:
        return f"{self.path}/level={level}"

    def level_table(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.folder(level))


def source_level(level: int, levels: Sequence[int]) -> int | None:
    """The coarsest of ``levels`` below ``level`` whose cells its cells are made of; None: pixels."""
    return max((x for x in levels if x < level and level % x == 0), default=None)


def space_filling_key(row: Column, col: Column, bits: int) -> Column:
    """Bits of both numbers in turn, the row's first."""
    bit = lambda c, b, to: F.shiftleft(F.shiftright(c.cast("bigint"), b).bitwiseAND(F.lit(1)), to)
    return reduce(Column.bitwiseOR, [bit(c, b, 2 * b + own) for b in range(bits) for own, c in ((1, row), (0, col))])


def _drop_years(spark: SparkSession, folder: str, years: list[int]) -> None:
    """Tiles of these years, also such as the years' new pixels do not reach any more."""
    for year in years:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/yr={year}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _write_level(cells: DataFrame, pyramid: Pyramid, level: int) -> None:
    """Sum (yr, row, col, people) and store it; the shuffle by tile also serves the sum."""
    c, tile = F.col, pyramid.tile
    dealt = cells.select("yr", "row", "col", "people", F.floor(c("row") / tile).cast("int").alias("tile_row"),
                         F.floor(c("col") / tile).cast("int").alias("tile_col")).repartition(*_TILE)
    summed = dealt.groupBy(*_TILE, "row", "col").agg(F.sum("people").cast("decimal(28,6)").alias("people"))
    key = space_filling_key(c("row") - c("tile_row") * tile, c("col") - c("tile_col") * tile, (tile - 1).bit_length())
    (summed.select("row", "col", "people", *_TILE).sortWithinPartitions(*_TILE, key)
     .write.mode("append").option("parquet.block.size", 16 << 20).partitionBy(*_TILE).parquet(pyramid.folder(level)))


def store_pyramid(pixels: DataFrame, pyramid: Pyramid) -> None:
    """Store all levels of pixels (yr, px_row, px_col, value): every year in ``pixels`` is given as a whole.

    Pixels listed twice add up; rows with a null year, place or value count for nothing.
    """
    spark, c = pixels.sparkSession, F.col
    given = pixel_counts(pixels.dropna(subset=["yr", "px_row", "px_col", "value"])).withColumn("yr", c("yr").cast("int"))
    years = [r["yr"] for r in given.select("yr").distinct().collect()]  # a handful, whatever the pixels' number
    for level in sorted(pyramid.levels):
        finer = source_level(level, pyramid.levels)
        if finer is None:
            cells, step = given.select("yr", c("px_row").alias("row"), c("px_col").alias("col"),
                                       c("people").cast("decimal(28,6)").alias("people")), level
        else:
            cells, step = pyramid.level_table(spark, finer).where(c("yr").isin(years)), level // finer
        block = lambda name: F.floor(c(name) / step).cast("int").alias(name)
        _drop_years(spark, pyramid.folder(level), years)
        _write_level(cells.select("yr", block("row"), block("col"), "people"), pyramid, level)


def aligned_window(bbox: tuple[float, float, float, float], level: int) -> PixelWindow:
    """The request widened to whole cells of ``level``, so that a stored level answers it without summing."""
    win = pixel_window(bbox, level)
    left, top = win.left // level * level, win.top // level * level
    cols, rows = math.ceil((win.left + win.width - left) / level), math.ceil((win.top + win.height - top) / level)
    px = win.cell_x / level
    return PixelWindow(left, top, cols * level, rows * level, level, cols, rows, win.west - (win.left - left) * px,
                       win.north + (win.top - top) * px, win.cell_x, win.cell_y)


def serving_level(pyramid: Pyramid, win: PixelWindow) -> int:
    """The coarsest stored level whose cells lie wholly inside or outside of each of the window's cells."""
    edges = (win.level, win.left, win.top, win.width, win.height)
    fit = [x for x in pyramid.levels if all(e % x == 0 for e in edges)]
    if not fit:
        raise ValueError(f"no stored level divides {edges}; store level 1 for windows of any place")
    return max(fit)


def stored_grid(spark: SparkSession, pyramid: Pyramid, win: PixelWindow) -> DataFrame:
    """People per output cell and year, as ``population_grid`` gives them, from the tiles that the window meets."""
    c, level = F.col, serving_level(pyramid, win)
    within = F.lit(True)
    for name, first, size in (("row", win.top, win.height), ("col", win.left, win.width)):
        lo, hi = first // level, (first + size) // level - 1
        within &= c(f"tile_{name}").between(lo // pyramid.tile, hi // pyramid.tile) & c(name).between(lo, hi)
    place = lambda name, first: F.floor((c(name) * level - first) / win.level).alias(name)
    cells = pyramid.level_table(spark, level).where(within).select("yr", place("row", win.top), place("col", win.left), "people")
    if level < win.level:
        cells = cells.groupBy("yr", "row", "col").agg(F.sum("people").alias("people"))
    return cells.withColumn("people", c("people").cast("double"))
