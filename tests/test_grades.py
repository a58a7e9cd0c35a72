"""Grades on the raster: what is sent, and cells against a walk over all of them."""

import math
import random

from transitlapse.functions.geo import EARTH_RADIUS_M
from transitlapse.operators import grades as GR
from transitlapse.operators import service as S
from transitlapse.schema import STEM_COLUMNS, Feeds, conform, stem_schema


def metres(lat1, lon1, lat2, lon2):
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(
        math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


def test_cells_near_block_edges_and_one_row_a_block_is_sent(spark, monkeypatch):
    """Blocks of a few cells: every place lies near an edge. All cells are those of a walk over places and cells."""
    monkeypatch.setattr(GR, "BLOCK_COLS", 5)
    monkeypatch.setattr(GR, "BLOCK_ROWS", 3)
    win = GR.cell_window((13.0, 47.0, 13.05, 47.04))
    rng = random.Random(3)
    places = [("F", 47 + rng.uniform(-0.01, 0.05), 13 + rng.uniform(-0.01, 0.06), rng.randint(1, 8)) for _ in range(25)]
    stops = spark.createDataFrame(places, "feed_id string, lat double, lon double, category int")
    got = {(r.row, r.col): (r.grade, round(r.dist_m, 6)) for r in GR.grade_grid(stops, win).collect()}
    want = {}
    for row in range(win.rows):
        for col in range(win.cols):
            lat, lon = win.north - (row + 0.5) * win.cell_y, win.west + (col + 0.5) * win.cell_x
            best = []
            for _, p_lat, p_lon, k in places:
                d = metres(p_lat, p_lon, lat, lon)
                step = next((i for i, b in enumerate(GR.DISTANCE_BREAKS_M) if d <= b), None)
                if d <= GR.MAX_RADIUS_M[k - 1] and step is not None and GR.GRADE[k - 1][step] is not None:
                    best.append((GR.GRADE[k - 1][step], round(d, 6)))
            if best:
                want[row, col] = min(best)
    assert got == want and len(got) > 500
    # Rows of the raster come into being behind the one shuffle of places.
    plan = GR.row_intervals(stops, win)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("row_lat") < plan.index("RepartitionByExpression")
    assert "row_lat" not in plan[plan.index("RepartitionByExpression"):]


def test_modes_of_a_stop_are_sent_without_its_routes(spark):
    def table(stem, names, rows):
        return conform(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split())), stem)

    tables = {s: spark.createDataFrame([], stem_schema(s)) for s in STEM_COLUMNS}
    tables["stops"] = table("stops", "feed_id stop_id stop_name stop_lat stop_lon", [("F", s, s, "47", "13") for s in ("a", "b", "c")])
    tables["routes"] = table("routes", "feed_id route_id route_type", [("F", "r1", "0"), ("F", "r1", "0"), ("F", "r2", "3"), ("F", "r3", "x")])
    tables["trips"] = table("trips", "feed_id trip_id route_id", [("F", "t1", "r1"), ("F", "t2", "r2"), ("F", "t3", "r3"), ("F", "t4", None)])
    tables["stop_times"] = table("stop_times", "feed_id trip_id stop_id", [
        ("F", "t1", "a"), ("F", "t2", "a"), ("F", "t1", "a"), ("F", "t3", "b"), ("F", "t4", "b"), ("F", "t2", "c"), ("F", "t9", "c")])
    none = spark.createDataFrame([], "feed_id string, source_name string, loaded_at long")
    files = spark.createDataFrame([], "feed_id string, stem string, columns array<string>")
    df = S.stop_modes(Feeds(feeds=none, files=files, **tables))
    assert {r.stop_id: r.modes for r in df.collect()} == {"a": ["bus", "tram"], "b": [], "c": ["bus"]}
    aggregates = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in x]
    assert aggregates and not any("route_id" in x for x in aggregates)
