"""Truth tables of the scalar functions, and numbering and percentiles against plain Python."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions import text as X
from transitlapse.operators import grades as GR
from transitlapse.operators import population as P
from transitlapse.operators.numbering import nearest_rank, numbered
from transitlapse.sources import store, truth


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_stop_names(spark):
    cases = {
        "Wien Hauptbahnhof": "wien", "Graz Hbf (ÖBB)": "graz", "Linz/Donau Hbf": "linz donau", "Café Zürich": "cafe zurich",
        "Große Straße": "grosse strasse", "Bahnhof Steig 3": "", "Markt, Gleis 12": "markt", "Ort Bstg. 2a": "ort",
        "Dorf Gleisdorf": "dorf", "Alt - Neu": "alt neu", "Alt-Neu": "alt-neu", "  A   b ": "a b", "A B": "a b",
        "Łódź": "łodz", "Ngã Tư": "nga tu", "été": "ete", None: "",
    }
    assert column(spark, list(cases), X.normalize_stop_name) == list(cases.values())


def test_route_names(spark):
    assert column(spark, ["s 1", "S1 ", "Ü 3", None], X.normalize_route_short_name) == ["S1", "S1", "U3", ""]
    assert column(spark, ["ÖBB-Postbus", "ÖBB  Postbus.", None], X.normalize_loose) == ["obb postbus", "obb postbus", ""]


def test_line_order(spark):
    names = ["101", "N82", "2", "45a", "11", "45", "1", "A2", "A10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(X.line_sort_key(F.col("n"))).collect()] == [
        "1", "2", "11", "45", "45a", "101", "A2", "A10", "N82"]


def test_modes(spark):
    codes = [0, 1, 2, 3, 11, 12, 4, 100, 117, 118, 200, 209, 300, 399, 400, 405, 406, 700, 716, 800, 802, 900, 906, 907, None]
    assert column(spark, codes, M.route_mode, "int") == [
        "tram", "metro", "rail", "bus", "bus", "metro", "other", "rail", "rail", "other", "bus", "bus", "rail", "rail",
        "metro", "metro", "other", "bus", "bus", "bus", "bus", "tram", "tram", "other", "other"]
    assert column(spark, [["bus", "tram"], ["other", "rail"], []], M.primary_mode, "array<string>") == ["tram", "rail", "other"]


def test_times_dates_and_classes(spark):
    assert column(spark, ["6:05:00", "25:10:00", "x", None], M.minutes_of_day) == [365, 1510, None, None]
    assert [str(d) for d in column(spark, ["20240229", " 20240101 ", "20231345", "2024-01-01"], M.gtfs_date)] == [
        "2024-02-29", "2024-01-01", "None", "None"]
    assert column(spark, [4.9, 5.0, 10.0, 19.9, 20.0, 40.0, 60.0, 120.0, 210.0, 211.0], GR.interval_class, "double") == [
        0, 1, 1, 2, 3, 3, 4, 5, 6, 7]
    assert column(spark, [-51.0, -50.0, -10.0, 10.0, 50.0], lambda c: M.step_class(c, M.FREQUENCY_DELTA_BREAKS), "double") == [
        0, 1, 2, 3, 4]
    assert column(spark, [1990, 2000, 2021, 2022, 2023, 2024, 2030], P.population_year, "int") == [
        2000, 2000, 2021, 2021, 2025, 2025, 2025]
    assert column(spark, [None, 2.0], lambda c: M.clamp(c, 0.0, 1.0), "double") == [None, 1.0]


def test_windows():
    win = GR.cell_window((13.0, 47.0, 13.05, 47.05))
    assert (win.cols, win.rows) == (60, 60) and win.cell_x == pytest.approx(1 / GR.PX_PER_DEG)
    wide = P.pixel_window((13.0, 47.0, 14.0, 47.5), 5)
    assert (wide.cols, wide.rows) == (240, 120) and wide.cell_x == pytest.approx(5 / P.PX_PER_DEG)


@pytest.mark.parametrize("values", [[5.0], [0.0] * 99 + [7.0], [1.0] * 50 + [2.0] * 50, None])
def test_nearest_rank(spark, values):
    values = values or [random.Random(9).gauss(0, 5) for _ in range(5000)]
    want = sorted(values)[min(len(values), math.ceil(len(values) * 0.95)) - 1]
    for keys in (["k"], []):
        row = nearest_rank(spark.createDataFrame([("a", v) for v in values], "k string, v double"), keys, "v").first()
        assert (row.p_value, row.top) == (want, max(values))
        assert row.scale == (want if want > 0 else max(values))


def test_numbering_is_dense(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("v"))
    rows = numbered(df, ["k"], ["v"]).groupBy("k").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("d")).collect()
    assert {(r.lo, r.hi, r.d) for r in rows} == {(1, 1000, 1000)}


def test_truth_files(spark, tmp_path):
    csv = tmp_path / "pairs.csv"
    csv.write_text('feedA,rawA,feedB,rawB,same,kind\nA,"x,1",B,y,Yes,\nA,2,B,3,0,route\n')
    rows = {r.raw_a: r for r in truth.read_truth(spark, str(csv)).collect()}
    assert rows["x,1"].same and not rows["2"].same and {r.kind for r in rows.values()} == {"route"}
    mixed = tmp_path / "mixed.csv"
    mixed.write_text("kind,feedA,rawA,feedB,rawB,same\nstop,A,1,B,1,1\nroute,A,1,B,1,1\n")
    with pytest.raises(ValueError, match="mixed"):
        truth.read_truth(spark, str(mixed))
    js = tmp_path / "pairs.json"
    js.write_text('{"kind": "stop", "pairs": [{"feedA": "A", "rawA": 1, "feedB": "B", "rawB": "1", "same": true}]}')
    assert [(r.kind, r.raw_a, r.same) for r in truth.read_truth(spark, str(js)).collect()] == [("stop", "1", True)]


def test_reload_plan(spark):
    files = spark.createDataFrame([
        ("ok", "stops", ["a"]), ("ok", "routes", ["a"]), ("ok", "trips", ["a"]), ("ok", "stop_times", ["departure_time"]),
        ("old", "stops", ["a"]), ("old", "routes", ["a"]), ("old", "trips", ["a"]), ("old", "stop_times", ["stop_id"]),
        ("half", "stops", ["a"]), ("lost", "stops", ["a"])], "feed_id string, stem string, columns array<string>")
    raw = spark.createDataFrame([("old",), ("half",), ("raw",)], "feed_id string")
    plan = {r.feed_id: r.how for r in store.reload_plan(files, raw).collect()}
    assert plan == {"ok": "tables", "old": "archive", "half": "archive", "raw": "archive", "lost": "missing"}


def test_grade_of_a_cell_is_compiled_and_as_in_the_table(spark):
    win = GR.cell_window((13.0, 47.0, 13.05, 47.05))
    places = [("f", 47.02 + 0.0011 * k, 13.02 + 0.0017 * (k % 5), k % 8 + 1) for k in range(12)]
    grid = GR.grade_grid(spark.createDataFrame(places, "feed_id string, lat double, lon double, category int"), win)
    best = {}
    for _, lat, lon, k in places:
        for row, col in itertools.product(range(win.rows), range(win.cols)):
            y, x = win.north - (row + 0.5) * win.cell_y, win.west + (col + 0.5) * win.cell_x
            h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
            d = 2 * 6_371_000.0 * math.asin(math.sqrt(h))
            at = next((i for i, b in enumerate(GR.DISTANCE_BREAKS_M) if d <= b), None)
            if d <= GR.MAX_RADIUS_M[k - 1] and at is not None and GR.GRADE[k - 1][at] is not None:
                found = (GR.GRADE[k - 1][at], round(d, 6), k)
                best[row, col] = min(best.get((row, col), found), found)
    assert {(r.row, r.col): (r.grade, round(r.dist_m, 6), r.category) for r in grid.collect()} == best
    # The virtual machine leaves methods of more than 8,000 bytes to its interpreter.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = GR.grade_grid(spark.createDataFrame(places, "feed_id string, lat double, lon double, category int"), win)
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000
