"""Stored pyramid against sums over pixels."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from transitlapse.operators import population as P
from transitlapse.operators import pyramid as Y

SCHEMA = "yr int, px_row bigint, px_col bigint, value bigint, people string"
EDGE = 8


def pixels(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], SCHEMA)


def drawn(seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(rng.choice((2010, 2021, 2025)), rng.randrange(100, 190), rng.randrange(300, 420), rng.randrange(-3, 5000)) for _ in range(n)]
    rows += rows[:50]  # listed twice: they add up
    return rows + [(None, 110, 310, 5), (2010, None, 310, 5), (2010, 110, None, 5), (2010, 110, 310, None)]


def window(left, top, width, height, level=1):
    return P.PixelWindow(left, top, width, height, level, -(-width // level), -(-height // level), 0.0, 0.0, 1.0, 1.0)


def found(df):
    return sorted((r["yr"], r["row"], r["col"], round(r["people"], 6)) for r in df.collect())


def summed(rows, win):
    out = {}
    for yr, row, col, value in rows:
        if None in (yr, row, col, value) or not (0 <= row - win.top < win.height and 0 <= col - win.left < win.width):
            continue
        key = (yr, (row - win.top) // win.level, (col - win.left) // win.level)
        out[key] = out.get(key, 0) + value * (100 if yr == 2025 else 1)
    return sorted((*k, round(v / 100, 6)) for k, v in out.items())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    p = Y.Pyramid(str(tmp_path_factory.mktemp("pyramid")), (1, 2, 4, 6, 8), EDGE)
    Y.store_pyramid(pixels(spark, drawn()), p)
    return p


def test_finer_levels_that_divide():
    assert [Y.source_level(x, (1, 2, 4, 6, 8)) for x in (1, 2, 4, 6, 8)] == [None, 1, 2, 2, 4]
    assert Y.source_level(9, (2, 6)) is None


def test_space_filling_key(spark):
    rows = [(r, c) for r in range(8) for c in range(8)]
    got = spark.createDataFrame(rows, "r int, c int").select("r", "c", Y.space_filling_key(F.col("r"), F.col("c"), 3).alias("k")).collect()
    for r, c, k in got:
        want = "".join(a + b for a, b in zip(f"{r:03b}", f"{c:03b}"))
        assert k == int(want, 2)


@pytest.mark.parametrize("win,level", [
    (window(0, 0, 1000, 1000), 1), (window(303, 101, 57, 41), 1), (window(303, 101, 57, 41, 3), 1), (window(304, 104, 64, 48, 8), 8),
    (window(304, 104, 64, 48, 16), 8), (window(304, 104, 60, 44, 8), 4), (window(300, 102, 60, 48, 6), 6), (window(900, 900, 8, 8, 8), 4)])
def test_windows(spark, stored, win, level):
    assert Y.serving_level(stored, win) == level
    got = found(Y.stored_grid(spark, stored, win))
    assert got == summed(drawn(), win) == found(P.population_grid(pixels(spark, drawn()).dropna(), win))


def test_every_level_holds_all_people(spark, stored):
    sums = {tuple(stored.level_table(spark, x).groupBy("yr").agg(F.sum("people")).orderBy("yr").collect()) for x in stored.levels}
    assert len(sums) == 1


def test_only_tiles_of_the_window_are_read(spark, tmp_path):
    p = Y.Pyramid(str(tmp_path), (1,), EDGE)
    Y.store_pyramid(pixels(spark, drawn()), p)
    win = window(304, 104, 16, 16)
    inside = {(r, c) for r in (13, 14) for c in (38, 39)}
    spoiled = 0
    for name in glob.glob(f"{p.folder(1)}/yr=*/tile_row=*/tile_col=*/*.parquet"):
        tile = tuple(int(x.partition("=")[2]) for x in name.split("/")[-3:-1])
        if tile not in inside:
            open(name, "wb").write(b"not parquet")
            spoiled += 1
    assert spoiled > 100
    grid = Y.stored_grid(spark, p, win)
    assert found(grid) == summed(drawn(), win)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "tile_row" in plan.partition("PartitionFilters")[2].partition("]")[0]


def test_years_are_replaced_singly(spark, tmp_path):
    p = Y.Pyramid(str(tmp_path), (1, 4), EDGE)
    first, second = drawn(2, 400), [r for r in drawn(3, 400) if r[0] == 2021]
    Y.store_pyramid(pixels(spark, first), p)
    Y.store_pyramid(pixels(spark, second), p)
    Y.store_pyramid(pixels(spark, second), p)  # a run that is repeated
    win = window(0, 0, 1000, 1000, 4)
    assert found(Y.stored_grid(spark, p, win)) == summed([r for r in first if r[0] != 2021] + second, win)


def test_no_pixels_and_no_level(spark, tmp_path):
    p = Y.Pyramid(str(tmp_path), (2, 4), EDGE)
    Y.store_pyramid(pixels(spark, []), p)
    assert found(Y.stored_grid(spark, p, window(0, 0, 8, 8, 4))) == []
    with pytest.raises(ValueError):
        Y.stored_grid(spark, p, window(1, 0, 8, 8, 4))


def test_widened_windows():
    win = P.pixel_window((13.2, 47.1, 14.6, 47.7), 8)
    wide = Y.aligned_window((13.2, 47.1, 14.6, 47.7), 8)
    assert all(x % 8 == 0 for x in (wide.left, wide.top, wide.width, wide.height))
    assert wide.left <= win.left < wide.left + 8 and wide.top <= win.top < wide.top + 8
    assert 0 <= wide.left + wide.width - win.left - win.width < 8 and 0 <= wide.top + wide.height - win.top - win.height < 8
    assert abs(wide.west - (P.ORIGIN_WEST + wide.left / P.PX_PER_DEG)) < 1e-9 and abs(wide.north - (P.ORIGIN_NORTH - wide.top / P.PX_PER_DEG)) < 1e-9
