"""Stop and route diffs kept at rest: only pairs whose feeds read differently than before are computed again.

A pair's version is a digest of what the registry says of its two feeds (ids, names, places, modes), so a new feed
costs its own steps, a feed whose ids changed costs its pairs, and nothing else is computed. Each pair is a partition
that its next version replaces. A log tells which version of a pair was begun and which is done: what a lost run left
behind counts as missing and is written anew.

The folder has one writer at a time. Pairs of absent feeds are kept like any other (their side is empty).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlapse.operators.diff import MOVED_M, PAIR, route_diff, stop_diff
from transitlapse.operators.registry import Registry
from transitlapse.session import cut_lineage, drop_table
from transitlapse.sources.store import write_table

#: Number of the rules behind the diffs: a change of the rules makes every kept result an old version.
RULES = 1
_LOG = "pair string, feed_a string, feed_b string, version string, number bigint, done boolean"
_STOPS = ["canonical_id", "name", "lat", "lon"]
_ROUTES = ["canonical_id", "short_name", "long_name", "agency_name", "mode"]


@dataclass
class PairResults:
    """Diffs of the pairs asked for, and the pairs (feed_a, feed_b) that had to be computed for them."""

    stops: DataFrame
    routes: DataFrame
    computed: DataFrame


def pair_key() -> Column:
    """The partition of a pair: a digest, as feed ids may hold any character. Never read as a number."""
    return F.concat(F.lit("p_"), F.sha2(F.to_json(F.array(*PAIR)), 256))


def feed_versions(registry: Registry) -> DataFrame:
    """feed_id and a digest of all its members, in any order of rows; equal rows count as often as they are there."""
    modes = registry.canonical_routes.select("canonical_id", "mode")

    def digest(members: DataFrame, columns: list[str], kind: str) -> DataFrame:
        parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]  # a hash alone passes over nulls
        add = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")).cast("string")
        return members.groupBy("feed_id").agg(F.concat_ws(
            ":", F.lit(kind), F.count("*").cast("string"), add(1), add(2)).alias("part"))

    parts = digest(registry.stops, _STOPS, "s").unionByName(
        digest(registry.routes.select("feed_id", *_ROUTES[:-1]).join(modes, "canonical_id"), _ROUTES, "r"))
    return parts.groupBy("feed_id").agg(F.array_join(F.sort_array(F.collect_list("part")), "|").alias("version"))


def _versions(registry: Registry, pairs: DataFrame, moved_m: float) -> DataFrame:
    feeds = cut_lineage(feed_versions(registry))
    side = lambda x: feeds.select(F.col("feed_id").alias(f"feed_{x}"), F.col("version").alias(f"v_{x}"))
    told = F.to_json(F.array(F.lit(f"{RULES} {moved_m!r}"), F.coalesce("v_a", F.lit("")), F.coalesce("v_b", F.lit(""))))
    return pairs.select(*PAIR).where("feed_a IS NOT NULL AND feed_b IS NOT NULL").distinct().join(
        side("a"), "feed_a", "left").join(side("b"), "feed_b", "left").select(
        pair_key().alias("pair"), *PAIR, F.sha2(told, 256).alias("version"))


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _LOG)


def _note(spark: SparkSession, path: str, pairs: DataFrame, done: bool) -> None:
    last = _log(spark, path).agg(F.max("number")).first()[0] or 0
    pairs.select("pair", *PAIR, "version", F.lit(last + 1).cast("bigint").alias("number"), F.lit(done).alias("done")).write.mode(
        "append").parquet(f"{path}/log")


def standing(spark: SparkSession, path: str) -> DataFrame:
    """pair, feed_a, feed_b, version and whether it is done: the last word of the log on each pair."""
    last = F.max_by(F.struct("version", "done"), "number").alias("last")
    return _log(spark, path).groupBy("pair", *PAIR).agg(last).select("pair", *PAIR, "last.*")


def stored_diffs(registry: Registry, pairs: DataFrame, path: str, moved_m: float = MOVED_M) -> PairResults:
    """Diffs of ``pairs`` (feed_a, feed_b): those kept under ``path`` in their present version, the others computed and kept.

    Pairs named twice count once, pairs with a null feed are left out; without pairs all tables are empty.
    """
    spark = registry.stops.sparkSession
    wanted = cut_lineage(_versions(registry, pairs, moved_m))
    kept = standing(spark, path).where("done").select("pair", "version")
    missing = cut_lineage(wanted.join(kept, ["pair", "version"], "left_anti"))
    # Only the feeds of missing pairs are read.
    feeds = missing.select(F.explode(F.array(*PAIR)).alias("feed_id")).distinct()
    part = replace(registry, stops=registry.stops.join(feeds, "feed_id", "left_semi"),
                   routes=registry.routes.join(feeds, "feed_id", "left_semi"))
    some = not missing.isEmpty()
    if some:
        _note(spark, path, missing, done=False)
    tables = {}
    for name, made in (("stops", stop_diff(part, missing, moved_m)), ("routes", route_diff(part, missing))):
        schema = made.withColumn("pair", pair_key()).schema
        if some:
            rows = cut_lineage(made.withColumn("pair", pair_key()))
            # A pair without rows now may have had some: its partition is emptied first.
            _delete(spark, path, name, missing.join(rows, "pair", "left_anti"))
            write_table(rows, f"{path}/{name}", "pair")
            drop_table(rows)
        tables[name] = (schema, f"{path}/{name}")
    if some:
        _note(spark, path, missing, done=True)

    def read(name: str) -> DataFrame:
        schema, at = tables[name]
        try:
            rows = spark.read.schema(schema).parquet(at)
        except AnalysisException as none:  # nothing was ever kept here
            if "PATH_NOT_FOUND" not in str(none):
                raise
            rows = spark.createDataFrame([], schema)
        return rows.join(wanted.select("pair"), "pair", "left_semi").drop("pair")

    return PairResults(read("stops"), read("routes"), missing.select(*PAIR))


def drop_feeds(spark: SparkSession, path: str, feeds: DataFrame) -> None:
    """Delete what is kept of every pair with one of ``feeds`` (feed_id). The driver lists pairs, never rows."""
    gone = feeds.select("feed_id").distinct()
    of = lambda x: standing(spark, path).join(gone.withColumnRenamed("feed_id", x), x, "left_semi")
    lost = cut_lineage(of("feed_a").unionByName(of("feed_b")).distinct())
    if not lost.isEmpty():
        _note(spark, path, lost, done=False)
        for name in ("stops", "routes"):
            _delete(spark, path, name, lost)


def _delete(spark: SparkSession, path: str, name: str, pairs: DataFrame) -> None:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for row in pairs.select("pair").distinct().toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/pair={row['pair']}")
        at.getFileSystem(conf).delete(at, True)
