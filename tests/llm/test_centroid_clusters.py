"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from transitlapse.llm import centroid_clusters
from transitlapse.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, key string, x string"


def plain(rows, k=40, rounds=5, dimensions=64):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, v) for i, v in kept if sum(c * c for c in v) <= 2**60]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((i is not None, i or 0, n, d) for (i, _), (d, n) in zip(kept, assign())), centroids


def vectors(n, seed, dimensions=64):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dimensions)] for _ in range(12)]
    out = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(n)]
    return [(i, [float(int(c * 4096)) / 4096 for c in v]) for i, v in out]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "c", "k", "x") for i, v in rows], SCHEMA).repartition(3)
    found = centroid_clusters.cluster_vectors(df, **options)
    return sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in found.members.collect()), found.centroids.tolist()


def test_equals_plain_version(spark):
    rows = vectors(300, 1)
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [float("nan")] + [0.0] * 63),
           (905, [float("-inf")] + [0.0] * 63), (906, [0.0] * 64), (907, [0.0] * 64), (None, [0.25] * 64), (5, rows[5][1]),
           (5, rows[7][1]), (908, [1e30] + [0.0] * 63), (909, [3e6] + [0.0] * 63), (910, [-70000.0] * 64)]
    assert run(spark, rows + odd) == plain(rows + odd)


def test_ties_and_copies(spark):
    rows = [(i, [float(i % 3 - 1)] * 64) for i in range(90)]  # most first centroids are equal and stay empty
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, n):
    assert run(spark, vectors(n, 3)) == plain(vectors(n, 3))


def test_dot_products_are_exact_in_every_round(spark):
    """The kept products equal those worked out anew, also with other parameters."""
    rows, seen = vectors(80, 4, 6), []
    got = run(spark, rows, k=5, rounds=4, dimensions=6, watch=lambda t: seen.append(t.select("key", "dots", "distance").collect()))
    assert got == plain(rows, 5, 4, 6)
    assert 2 <= len(seen) <= 5
    integers = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    for r in seen[-1]:
        dots = centroid_clusters._matrix(__import__("pyarrow").array([r["dots"]], "binary"), 5)[0].tolist()
        assert dots == [sum(a * b for a, b in zip(integers[r["key"]], c)) for c in got[1]]


def test_query_columns(spark, tmp_path):
    rows = vectors(150, 6)
    spark.createDataFrame([(i, v, 0, "c", "k", "x") for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_centroid_clusters"](spark, str(tmp_path))
    members, centroids = plain(rows)
    inertia = [sum(d for _, _, n, d in members if n == c) for c in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, n, d, inertia[n], sum(inertia), hashes[n]) for _, i, n, d in members]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"),
                          ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert got.where(F.col("distance") < 0).isEmpty()
