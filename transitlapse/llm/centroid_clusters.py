"""Centroid clustering with an incremental distance matrix of exact integers.

A vector's components become integers floor(scale * x). Each vector keeps its exact dot products with all centroids
from round to round; a round changes them only by the components in which a centroid has changed, then takes the
argmin of ``|x|^2 - 2 x.c + |c|^2`` (ties: the smaller number). Sums of clusters change only by vectors that moved.

Every round is one pass over a table (id, components, dot products) that moves no vector; it is written to the shared
folder, so a lost executor repeats its own tasks only, and the table of the round before is then deleted. The driver
gets one sum for each cluster and component: k * dimensions numbers, whatever the size of the input.

Vectors that are null, have another number of components, or hold a null or non-finite one are left out; so are those
whose integers have a norm above 2^30, whose squared distances need not fit into a long. Repeated rows and ids count
as often as they stand there; vectors with a null id are clustered but never become a first centroid. Fewer than k
vectors give fewer centroids, an empty table an empty result. Other columns are not read, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan
from transitlapse.session import cut_lineage, drop_table

#: The largest norm of a kept vector: no squared distance between such vectors or their means exceeds a long.
MOST_NORM = 2.0**30


@dataclass
class Clusters:
    """members: id, cluster, distance (squared); centroids: the final components, by number."""

    members: DataFrame
    centroids: np.ndarray


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows that ``_binary`` packed, as 64-bit integers; a row's bytes tell the size of its numbers."""
    data, offsets = scan.text_bytes(column)
    if not len(column):
        return np.zeros((0, width), np.int64)
    size = int(offsets[1] - offsets[0]) // width
    return data[offsets[0] : offsets[-1]].view(f"<i{size}").reshape(len(column), width).astype(np.int64)


def _packed(rows: np.ndarray) -> pa.Array:
    """Packed in the smallest integers that hold all rows."""
    most = int(np.abs(rows).max(initial=0))
    return _binary(rows.astype("<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"))


def whole_vectors(vectors: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """key, x (packed integers) of every vector that can be clustered."""
    scan.ship(vectors.sparkSession)
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.where((F.size(value) == dimensions) & finite).select(F.col(key).alias("key"), value.cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            x = np.floor(scale * batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            fits = np.square(x).sum(axis=1) <= MOST_NORM**2
            own = batch.column("key").filter(pa.array(fits))
            if len(own):
                yield pa.RecordBatch.from_arrays([own, _packed(x[fits].astype(np.int64))], names=["key", "x"])

    return given.mapInArrow(run, T.StructType([T.StructField("key", given.schema["key"].dataType), T.StructField("x", T.BinaryType())]))


def _assigned(table: DataFrame, before: np.ndarray, centroids: np.ndarray, first: bool) -> DataFrame:
    """The table of the next round: dot products after the change from ``before``, cluster, distance, cluster before."""
    k, dimensions = centroids.shape
    change, own = centroids - before, np.square(centroids).sum(axis=1)
    changed = [(c, np.flatnonzero(change[c])) for c in range(k) if change[c].any()]
    schema = T.StructType([table.schema["key"], *(T.StructField(n, T.BinaryType()) for n in ("x", "dots")),
                           T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("was", T.IntegerType())])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dimensions)
            dots = np.zeros((len(x), k), np.int64) if first else _matrix(batch.column("dots"), k)
            for c, at in changed:
                dots[:, c] += x[:, at] @ change[c, at]
            away = np.square(x).sum(axis=1)[:, None] - 2 * dots + own
            cluster = away.argmin(axis=1)
            was = pa.array(np.full(len(x), -1, np.int32)) if first else batch.column("cluster")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("x"), _packed(dots), pa.array(cluster.astype(np.int32)),
                 pa.array(away[np.arange(len(x)), cluster]), was], names=["key", "x", "dots", "cluster", "distance", "was"])

    return table.mapInArrow(run, schema)


def _moves(table: DataFrame, dimensions: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the moved vectors add to each cluster's sums and count, as Python integers."""
    def run(batches):
        sums, count = np.zeros((k + 1, dimensions), np.int64), np.zeros(k + 1, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dimensions)
            for sign, name in ((1, "cluster"), (-1, "was")):
                to = batch.column(name).to_numpy()
                np.add.at(sums, to, sign * x)
                np.add.at(count, to, sign)
        at = np.flatnonzero(count[:k] | sums[:k].any(axis=1))
        whole = np.concatenate([count[at, None], sums[at]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dimensions + 1).astype(np.int32)), pa.array(np.tile(np.arange(dimensions + 1, dtype=np.int32), len(at))),
             pa.array(whole.ravel())], names=["cluster", "at", "n"])

    moved = table.where(F.col("cluster") != F.col("was")).select("x", "cluster", "was")
    added = moved.mapInArrow(run, "cluster int, at int, n bigint").groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
    out = np.zeros((k, dimensions + 1), object)
    for row in added.collect():  # k * (dimensions + 1) sums
        out[row["cluster"], row["at"]] = int(row["n"])
    return out[:, 1:], out[:, 0]


def first_centroids(table: DataFrame, k: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order; equal ids by their components."""
    picked = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = table.where(F.col("key").isNotNull()).select(picked.alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    found = [np.frombuffer(r["x"], f"<i{len(r['x']) // dimensions}").astype(np.int64) for r in rows]
    return np.array(found, np.int64).reshape(len(found), dimensions)


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
                    dimensions: int = 64, scale: int = 256, seed: int = 2,
                    watch: Callable[[DataFrame], None] | None = None) -> Clusters:
    """``rounds`` times assign and move the centroids, then assign once more; ``watch`` sees each round's table."""
    table = cut_lineage(whole_vectors(vectors, key, vector, dimensions, scale))
    centroids = first_centroids(table, k, seed, dimensions)
    before, n = np.zeros_like(centroids), len(centroids)
    sums, count = np.zeros((n, dimensions), object), np.zeros(n, object)
    if not n:
        nothing = table.where(F.lit(False)).select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return Clusters(nothing, centroids)
    for number in range(rounds + 1):
        if number and (centroids == before).all():
            break  # no component changed, so no distance does
        after = cut_lineage(_assigned(table, before, centroids, first=number == 0))
        drop_table(table)
        table = after
        if watch:
            watch(table)
        if number == rounds:
            break
        more, plus = _moves(table, dimensions, n)
        sums, count, before, centroids = sums + more, count + plus, centroids, centroids.copy()
        for c in np.flatnonzero(count):
            centroids[c] = [s // int(count[c]) for s in sums[c]]
    return Clusters(table.select(F.col("key").alias(key), "cluster", "distance"), centroids)
