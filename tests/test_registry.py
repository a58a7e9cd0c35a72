"""Linking and registry against brute force, with hot spots; overrides, evaluation, snapshots."""

import math
import random

from pyspark.sql import functions as F

from transitlapse.operators import linking as L
from transitlapse.operators import registry as R


def hav(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(
        math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    out = {}
    for i in range(n):
        out.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in out.values()}


def stops(rng, n):
    """Scattered stops, a third piled on one place, and a dense cloud; raw ids shared and repeated."""
    out = []
    for k in range(n):
        kind = k % 3
        if kind == 0:
            lat, lon = 47.5, 14.2
        elif kind == 1:
            lat, lon = 47.501 + rng.gauss(0, 2e-4), 14.2 + rng.gauss(0, 3e-4)
        else:
            lat, lon = 47.6 + rng.randrange(20) * 2.2e-4, 14.3 + rng.randrange(20) * 3.3e-4
        out.append((f"F{rng.randrange(3)}", f"id{rng.randrange(n // 2)}", rng.choice(["Markt", "Markt Hst.", "Bad", ""]), lat, lon))
    return list({(s[0], s[1]): s for s in out}.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "feed_id string, raw_id string, name string, lat double, lon double")


def test_scopes_match_brute_force(spark):
    rng = random.Random(1)
    rows = stops(rng, 400)
    pts = frame(spark, rows).withColumn("key", F.concat_ws("\t", "feed_id", "raw_id")).select("key", "feed_id", "lat", "lon")
    at = {f"{s[0]}\t{s[1]}": i for i, s in enumerate(rows)}
    for eps in (8.0, 25.0, 60.0):
        got = {}
        for r in L.spatial_scopes(pts, eps).collect():
            got.setdefault(r.scope, set()).add(at[r.key])
        want = groups(len(rows), lambda i, j: hav(rows[i][3:], rows[j][3:]) <= eps)
        assert {frozenset(g) for g in got.values()} == want


def test_cross_feed_links_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"F{rng.randrange(3)}", rng.choice(["x", "y"]), "", 47.5 + rng.uniform(0, 0.012), 14.2 + rng.uniform(0, 0.012))
            for _ in range(150)]
    rows += [("F0", "x", "", 47.55, 14.3)] * 40 + [("F1", "x", "", 47.5505, 14.3)] * 40 + [("F2", "z", "", 47.5, 14.2)] * 5
    data = spark.createDataFrame([(str(i).zfill(4), *r) for i, r in enumerate(rows)],
                                 "key string, feed_id string, raw_id string, name string, lat double, lon double")
    comp = {r.node: r.component for r in L.connected_components(L.cross_feed_links(data, 200.0, "raw_id")).collect()}
    got = {}
    for i in range(len(rows)):
        key = str(i).zfill(4)
        got.setdefault(comp.get(key, key), set()).add(i)
    want = groups(len(rows), lambda i, j: rows[i][0] != rows[j][0] and rows[i][1] == rows[j][1]
                  and hav(rows[i][3:], rows[j][3:]) <= 200)
    assert {frozenset(g) for g in got.values()} == want


def test_a_pile_of_stops_forms_no_pairs(spark):
    """Thousands of stops on one spot: the tile pairs stay few because tiles, not stops, are paired."""
    pts = spark.range(3000).select(
        F.col("id").cast("string").alias("key"), F.lit("F").alias("feed_id"),
        (F.lit(47.5) + F.rand(5) * 1e-4).alias("lat"), (F.lit(14.2) + F.rand(6) * 1e-4).alias("lon"))
    pairs = L._tile_pairs(L._tile_boxes(L._tiles(pts, 25.0, []), []), 25.0, [])
    assert pairs.count() < 500
    assert L.spatial_scopes(pts, 25.0).select("scope").distinct().count() == 1


def test_identity_matches_brute_force(spark):
    rng = random.Random(4)
    rows = stops(rng, 300)
    key = lambda n: {"Markt Hst.": "markt", "Markt": "markt", "Bad": "bad", "": ""}[n]
    scope = {}
    for g in groups(len(rows), lambda i, j: hav(rows[i][3:], rows[j][3:]) <= 25):
        for i in g:
            scope[i] = min(g)
    want = groups(len(rows), lambda i, j: (scope[i] == scope[j] and key(rows[i][2]) == key(rows[j][2])) or (
        rows[i][0] != rows[j][0] and rows[i][1] == rows[j][1] and hav(rows[i][3:], rows[j][3:]) <= 200))
    got = {}
    at = {s[:2]: i for i, s in enumerate(rows)}
    for r in R.stop_components(frame(spark, rows)).collect():
        got.setdefault(r.component, set()).add(at[r.feed_id, r.raw_id])
    assert {frozenset(g) for g in got.values()} == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    hub = [("zhub", f"z{i:04}") for i in range(500)]
    comp = {r.node: r.component for r in L.connected_components(
        spark.createDataFrame(chain + hub, "src string, dst string")).collect()}
    assert {comp[f"n{i:03}"] for i in range(61)} == {"n000"} and comp["zhub"] == "z0000"


MEMBERS = "feed_id string, raw_id string, name string, name_key string, lat double, lon double, canonical_id string"


def test_overrides_chain_and_split(spark):
    members = spark.createDataFrame([
        ("A", "1", "One", "one", 47.0, 14.0, "s1"), ("B", "1", "One", "one", 47.0, 14.0, "s1"),
        ("A", "2", "Two", "two", 47.1, 14.1, "s2"), ("B", "3", "Three", "three", 47.2, 14.2, "s3")], MEMBERS)
    ov = spark.createDataFrame([
        ("stop", "unmerge", 0, 0, "B", "1", None),
        ("stop", "merge", 1, 0, "A", "1", "Main"), ("stop", "merge", 1, 1, "A", "2", "Main"),
        ("stop", "merge", 2, 0, "A", "2", None), ("stop", "merge", 2, 1, "B", "3", None),
        ("stop", "merge", 3, 0, "A", "9", None), ("stop", "merge", 3, 1, "B", "1", None)],
        "kind string, op string, group_id int, pos int, feed_id string, raw_id string, label string")
    moved, canon = R.apply_overrides(members, R.canonical_stops(members), ov, "stop")
    ids = {(r.feed_id, r.raw_id): r.canonical_id for r in moved.collect()}
    assert ids == {("A", "1"): "s1", ("A", "2"): "s1", ("B", "3"): "s1", ("B", "1"): "s1__split__B_1"}
    rows = {r.canonical_id: r for r in canon.collect()}
    assert set(rows) == {"s1", "s1__split__B_1"}
    assert (rows["s1"].name, rows["s1"].member_count, rows["s1"].feed_count) == ("Main", 3, 2)


def test_quality_counts_unknowns(spark):
    members = spark.createDataFrame([("A", "1", "", "", 0.0, 0.0, "x"), ("B", "1", "", "", 0.0, 0.0, "x"),
                                     ("B", "2", "", "", 0.0, 0.0, "y")], MEMBERS)
    routes = members.select("feed_id", "raw_id", "canonical_id")
    truth = spark.createDataFrame([("stop", "A", "1", "B", "1", True), ("stop", "A", "1", "B", "2", True),
                                   ("stop", "A", "1", "B", "9", True)],
                                  "kind string, feed_a string, raw_a string, feed_b string, raw_b string, same boolean")
    judged = R.evaluate_pairs(R.Registry(members, routes, members, routes), truth)
    q = R.match_quality(judged).first()
    assert (q.tp, q.fn, q.unknown, q.precision, q.recall) == (1, 1, 1, 1.0, 0.5)
    assert R.match_mistakes(judged).count() == 1


def test_snapshot_roundtrip_and_staleness(spark, tmp_path):
    members = spark.createDataFrame([("A", "1", "One", "one", 47.0, 14.0, "s1")], MEMBERS)
    routes = spark.createDataFrame([("A", "r", "1", "L", None, "Ag", 3, "bus", "r1")],
                                   "feed_id string, raw_id string, short_name string, long_name string, agency_id string,"
                                   "agency_name string, route_type int, mode string, canonical_id string")
    R.save_registry(R.Registry(members, routes, R.canonical_stops(members), R.canonical_routes(routes)), str(tmp_path))
    back = R.load_registry(spark, str(tmp_path))
    assert back.stops.collect() == members.collect()
    loaded = spark.createDataFrame([("A",), ("B",)], "feed_id string")
    assert [r.feed_id for r in R.stale_feeds(back.stops, loaded).collect()] == ["B"]
