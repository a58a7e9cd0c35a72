"""Links across longitude 180 and the poles, and hubs whose edges are dealt to several keys."""

import random

from pyspark.sql import functions as F
from test_registry import groups, hav

from transitlapse.operators import linking as L


def by_label(rows, node, label):
    out = {}
    for r in rows:
        out.setdefault(r[label], set()).add(r[node])
    return {frozenset(g) for g in out.values()}


def places(rng):
    """Stops on both sides of longitude 180 and around both poles, with spots and long hops."""
    out = []
    for lat in (0.0, 51.9, -16.8, 65.5):
        for _ in range(14):
            lon = 180 + rng.uniform(-6e-4, 6e-4)
            out.append((lat + rng.uniform(-3e-4, 3e-4), lon - 360 if lon > 180 else lon))
        out += [(lat, 180.0), (lat, -180.0), (lat, 179.99999), (lat, -179.99999)]
    for pole in (1, -1):
        out += [(pole * (90 - abs(rng.gauss(0, 1.5e-4))), rng.uniform(-180, 180)) for _ in range(30)]
        out += [(pole * 89.9999, 0.0), (pole * 89.9999, 180.0), (pole * 90.0, 77.0), (pole * 89.99, -179.9999), (pole * 89.99, 179.9999)]
    return out + [(47.5, 14.2), (47.5, 14.2001), (47.5, 14.21)]


def test_scopes_on_the_whole_sphere(spark):
    at = places(random.Random(5))
    rows = [(f"k{i:03}", "F1", lat, lon) for i, (lat, lon) in enumerate(at)]
    points = spark.createDataFrame(rows, "key string, feed_id string, lat double, lon double")
    for eps in (5.0, 25.0):
        got = by_label(L.spatial_scopes(points, eps).collect(), "key", "scope")
        want = {frozenset(f"k{i:03}" for i in g) for g in groups(len(at), lambda i, j: hav(at[i], at[j]) <= eps)}
        assert got == want, eps


def test_links_across_feeds_on_the_whole_sphere(spark):
    rng = random.Random(6)
    at = places(rng)
    raw = [(f"F{rng.randrange(3)}", f"id{rng.randrange(4)}") for _ in at]
    rows = [(f"k{i:03}", f, lat, lon, r) for i, ((lat, lon), (f, r)) in enumerate(zip(at, raw))]
    points = spark.createDataFrame(rows, "key string, feed_id string, lat double, lon double, raw_id string")
    found = L.connected_components(L.cross_feed_links(points, 200.0, "raw_id")).where("node LIKE 'k%'").collect()
    linked = lambda i, j: raw[i][0] != raw[j][0] and raw[i][1] == raw[j][1] and hav(at[i], at[j]) <= 200.0
    want = {frozenset(f"k{i:03}" for i in g) for g in groups(len(at), linked) if len(g) > 1}
    assert {g for g in by_label(found, "node", "component") if len(g) > 1} == want


def test_hub_is_dealt_to_parts(spark, monkeypatch):
    """A hub of a million edges: no join key has more than twice a part's rows, and labels stay right."""
    hub = spark.range(1_000_000).select(F.lit(-1).cast("bigint").alias("src"), F.col("id").alias("dst"))
    rest = spark.range(200_000).select((F.col("id") * 2 + 2_000_000).alias("src"), (F.col("id") * 2 + 2_000_001).alias("dst"))
    edges = hub.unionByName(rest)
    monkeypatch.setattr(L, "HUB_EDGES", 20_000)
    low = L._least(edges)
    seen = []
    join = type(edges).join
    monkeypatch.setattr(type(edges), "join", lambda self, other, on=None, how=None: (seen.append(self) if on == ["src", "part"] else None, join(self, other, on, how))[1])
    joined = L.join_least(edges, low, 1_200_000)
    assert joined.count() == 1_200_000 and joined.where("m > dst").isEmpty()
    sizes = [r["n"] for r in seen[0].where("src = -1").groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 50 and max(sizes) < 2 * sorted(sizes)[25]
    labels = L.connected_components(edges)
    assert labels.groupBy("component").count().where("count > 2").collect() == [(-1, 1_000_001)]
    assert labels.count() == 1_400_001 and labels.where("component <> -1 AND component NOT IN (node, node - 1)").isEmpty()


def test_components_of_random_graphs_with_small_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "HUB_EDGES", 4)
    rng = random.Random(7)
    pairs = {(rng.choice([0, 7, rng.randrange(120)]), rng.randrange(120)) for _ in range(130)} | {(200 + i, 199 + i) for i in range(40)}
    found = L.connected_components(spark.createDataFrame(sorted(pairs), "src int, dst int")).collect()
    linked = pairs | {(b, a) for a, b in pairs}
    want = {g for g in groups(260, lambda i, j: (i, j) in linked) if len(g) > 1}
    assert by_label(found, "node", "component") == want and all(r["component"] == min(g) for g in want for r in found if r["node"] in g)


def test_a_group_within_the_radius_is_one_star(spark):
    """One edge a point where a raw id keeps its place, whatever the tiles; wider groups and single feeds as before."""
    rows = [(f"k{i}{f}", f"F{f}", 47.5 + i / 100 + f * 2e-4, 14.2, f"id{i}") for i in range(20) for f in range(3)]
    rows += [("w0", "F0", 47.5, 15.0, "wide"), ("w1", "F1", 47.5, 15.002, "wide"), ("w2", "F2", 47.5, 15.004, "wide")]
    rows += [("s0", "F0", 47.5, 16.0, "one"), ("s1", "F0", 47.5, 16.0, "one"), ("p0", "F0", 89.99999, 0.0, "pole"),
             ("p1", "F1", 89.99999, 180.0, "pole")]
    points = spark.createDataFrame(rows, "key string, feed_id string, lat double, lon double, raw_id string")
    edges = L.cross_feed_links(points, 200.0, "raw_id")
    near = edges.where("src LIKE 'k%' OR dst LIKE 'k%'").collect()
    assert len(near) == 60 and len({r.dst for r in near}) == 20
    found = L.connected_components(edges).where("length(node) < 5").collect()
    got = {g for g in by_label(found, "node", "component")}
    assert got == {frozenset(f"k{i}{f}" for f in range(3)) for i in range(20)} | {
        frozenset({"w0", "w1", "w2"}), frozenset({"p0", "p1"})}
