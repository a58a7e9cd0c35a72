"""Cross-feed registry: stable canonical ids for stops and routes, overrides, evaluation, snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions import text as X
from transitlapse.functions.geo import exact_sum, half_up, haversine_m
from transitlapse.operators import linking
from transitlapse.operators import service as S
from transitlapse.schema import Feeds
from transitlapse.session import cut_lineage, working_tables

# Radii in metres for the same-name scope and for the same-raw-id signal; snapshot version.
SCOPE_M = 25.0
RAW_ID_M = 200.0
REGISTRY_VERSION = 1


def longest(c: str | Column) -> Column:
    """Longest value in a group, the first in byte order on a tie, '' when there is none."""
    v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.min_by(v, F.struct(-F.length(v), v))


def raw_stops(feeds: Feeds) -> DataFrame:
    return S.typed_stops(feeds).select(
        "feed_id", F.col("stop_id").alias("raw_id"), F.col("stop_name").alias("name"), "lat", "lon")


def raw_routes(feeds: Feeds) -> DataFrame:
    return S.typed_routes(feeds).withColumnRenamed("route_id", "raw_id")


def stop_components(stops: DataFrame, eps: float = SCOPE_M, raw_id_m: float = RAW_ID_M) -> DataFrame:
    """Stops with the identity group they fall in.

    Stops merge when they share a normalised name inside one spatial scope, or share a raw id across feeds
    within the wider radius. A (scope, name) group is one node, so only raw-id links need a component search.
    """
    named = stops.withColumn("key", F.concat_ws("\t", "feed_id", "raw_id")).withColumn(
        "name_key", X.normalize_stop_name(F.col("name")))
    named = cut_lineage(named)
    scopes = linking.spatial_scopes(named.select("key", "feed_id", "lat", "lon").distinct(), eps)
    scopes = scopes.groupBy("key").agg(F.min("scope").alias("scope"))
    nodes = named.join(scopes, "key").withColumn(
        "node", F.concat_ws("\u0001", F.lit("name"), F.col("scope").cast("string"), "name_key"))
    # Links are found between nodes: a raw id's first one stands for it where a feed lists it more than once.
    nodes = cut_lineage(nodes.withColumn("first_node", F.min("node").over(W.partitionBy("key"))))
    edges = linking.cross_feed_links(nodes.select(
        F.col("first_node").alias("key"), "feed_id", "lat", "lon", "raw_id"), raw_id_m, "raw_id")
    found = linking.connected_components(edges)
    return nodes.join(found, "node", "left").select(
        "feed_id", "raw_id", "name", "name_key", "lat", "lon", F.coalesce("component", "node").alias("component"))


def _representative_keys(df: DataFrame, by: str) -> DataFrame:
    """Most common name key of each group; an empty key yields to an equally common one, then longest name."""
    per_key = df.groupBy(by, "name_key").agg(
        F.count("*").alias("n"), F.max(F.length("name")).alias("len"))
    score = F.col("n") - F.when(F.col("name_key") == "", F.lit(0.5)).otherwise(F.lit(0.0))
    return per_key.groupBy(by).agg(
        F.min_by("name_key", F.struct(-score, -F.col("len"), F.col("name_key"))).alias("name_key"))


def _stop_summary(df: DataFrame, by: str) -> DataFrame:
    base = df.groupBy(by).agg(
        exact_sum(F.col("lat")).alias("lat_sum"), exact_sum(F.col("lon")).alias("lon_sum"),
        F.count("*").alias("member_count"), F.count_distinct("feed_id").alias("feed_count"),
        longest("name").alias("name"))
    return base.join(_representative_keys(df, by), by).select(
        by, F.coalesce(X.blank_to_null(F.col("name")), F.lit("(unnamed)")).alias("name"), "name_key",
        (F.col("lat_sum") / F.col("member_count")).alias("lat"),
        (F.col("lon_sum") / F.col("member_count")).alias("lon"), "member_count", "feed_count")


def stop_canonical_id(lat: Column, lon: Column, name_key: Column) -> Column:
    lat6, lon6 = half_up(lat * 1e6), half_up(lon * 1e6)
    slug = F.regexp_replace(F.substring(name_key, 1, X.SLUG_LENGTH), X.WS + "+", "-")
    lossy = (F.length(name_key) > X.SLUG_LENGTH) | F.contains(name_key, F.lit("-")) | (name_key == "unnamed")
    return F.concat(
        F.lit("s_"), F.when(lat6 < 0, "S").otherwise("N"), F.abs(lat6).cast("string"),
        F.lit("_"), F.when(lon6 < 0, "W").otherwise("E"), F.abs(lon6).cast("string"),
        F.lit("_"), F.coalesce(X.blank_to_null(slug), F.lit("unnamed")),
        F.when(lossy, F.concat(F.lit("_"), X.digest(name_key))).otherwise(""))


def match_stops(feeds: Feeds, eps: float = SCOPE_M) -> DataFrame:
    """Every raw stop with its canonical id: feed_id, raw_id, name, name_key, lat, lon, canonical_id."""
    return with_canonical_ids(stop_components(raw_stops(feeds), eps))


def with_canonical_ids(grouped: DataFrame) -> DataFrame:
    """Stops of identity groups (column ``component``) with the canonical id of their group."""
    ids = _stop_summary(grouped, "component").select(
        "component", stop_canonical_id(F.col("lat"), F.col("lon"), F.col("name_key")).alias("canonical_id"))
    return grouped.join(ids, "component").drop("component")


def canonical_stops(members: DataFrame) -> DataFrame:
    """Summary per canonical id."""
    return _stop_summary(members, "canonical_id")


def agency_key(name: Column, agency_id: Column) -> Column:
    by_name, by_id = X.normalize_loose(name), F.trim(F.coalesce(agency_id, F.lit("")))
    return F.when(by_name != "", F.concat(F.lit("n:"), by_name)).when(
        by_id != "", F.concat(F.lit("i:"), F.lower(by_id))).otherwise("__none__")


def match_routes(feeds: Feeds) -> DataFrame:
    """Every raw route with its canonical id, a pure function of agency, mode and line name."""
    key = agency_key(F.col("agency_name"), F.col("agency_id"))
    short = X.normalize_route_short_name(F.col("short_name"))
    name = F.when(short != "", short).otherwise(X.normalize_loose(F.col("long_name")))
    or_none = lambda c: F.coalesce(X.blank_to_null(X.slug(c)), F.lit("none"))
    # The readable id is enough where both parts keep their whole key.
    whole = ((key == "__none__") | (key.rlike(r"^[ni]:[a-z0-9 ]{1,23}$") & (X.slug(key) != "none"))) & (
        (name == "") | (name.rlike(r"^[A-Z0-9]{1,24}$") & (name != "NONE")))
    cid = F.concat_ws("_", F.lit("r"), or_none(key), F.col("mode"), or_none(name), F.when(
        ~whole, X.digest(key, F.col("mode"), name)))
    return raw_routes(feeds).withColumn("canonical_id", cid)


def canonical_routes(members: DataFrame) -> DataFrame:
    return members.groupBy("canonical_id").agg(
        longest("short_name").alias("short_name"), longest("long_name").alias("long_name"),
        F.coalesce(X.blank_to_null(longest("agency_name")), F.min("agency_id"), F.lit("")).alias("agency"),
        F.min("mode").alias("mode"), F.count("*").alias("member_count"),
        F.count_distinct("feed_id").alias("feed_count"))


@dataclass
class Registry:
    """Members (raw rows with canonical ids) and canonical summaries of stops and routes."""

    stops: DataFrame
    routes: DataFrame
    canonical_stops: DataFrame
    canonical_routes: DataFrame


def build_registry(feeds: Feeds, overrides: DataFrame | None = None, stops: DataFrame | None = None) -> Registry:
    """The registry of all feeds; ``stops`` may be given as kept from batch to batch, in the form of ``match_stops``."""
    if overrides is None:
        with working_tables(feeds.spark) as keep:
            stops = keep(cut_lineage(match_stops(feeds) if stops is None else stops))
            routes = keep(cut_lineage(match_routes(feeds)))
        return Registry(stops, routes, canonical_stops(stops), canonical_routes(routes))
    stops, routes = match_stops(feeds) if stops is None else stops, match_routes(feeds)
    stops, c_stops = apply_overrides(stops, canonical_stops(stops), overrides, "stop")
    routes, c_routes = apply_overrides(routes, canonical_routes(routes), overrides, "route")
    return Registry(stops, routes, c_stops, c_routes)


def apply_overrides(members: DataFrame, canonicals: DataFrame, overrides: DataFrame,
                    kind: str) -> tuple[DataFrame, DataFrame]:
    """Apply unmerges, then merges in group order; only counts are refreshed, names and places stay.

    ``overrides``: kind, op ('merge'/'unmerge'), group_id, pos, feed_id, raw_id, label. A merge moves its
    other members to wherever its first member is by then, so merges may chain; the chain is a forest of
    groups and its roots come from a component search.
    """
    key = ["feed_id", "raw_id"]
    ours = overrides.where(F.col("kind") == kind)
    split = ours.where("op = 'unmerge'").select(*key).distinct().withColumn("split", F.lit(True))
    base = members.join(split, key, "left").withColumn("old_id", F.col("canonical_id")).withColumn(
        "canonical_id", F.when(F.col("split"), F.concat(
            "canonical_id", F.lit("__split__"), "feed_id", F.lit("_"), "raw_id")).otherwise(F.col("canonical_id")))

    known = base.select(*key, "canonical_id").dropDuplicates(key)
    entries = ours.where("op = 'merge'").join(known, key)
    sized = ours.where("op = 'merge'").groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2")
    firsts = entries.where("pos = 0").join(sized, "group_id", "left_semi").select(
        "group_id", *key, F.col("canonical_id").alias("start"), "label")
    moves = entries.where("pos > 0").join(firsts.select("group_id"), "group_id", "left_semi").select("group_id", *key)
    # A first member that an earlier group moved follows that group: link to the latest such group.
    prior = (
        firsts.select(F.col("group_id").alias("g"), *key).join(moves, key).where("group_id < g")
        .groupBy("g").agg(F.max("group_id").alias("parent"))
    )
    roots = linking.connected_components(prior.select(F.col("g").alias("src"), F.col("parent").alias("dst")))
    starts = firsts.select(F.col("group_id").alias("root"), "start")
    target = (
        firsts.select("group_id", "label").join(roots.select(F.col("node").alias("group_id"), "component"),
                                                "group_id", "left")
        .withColumn("root", F.coalesce("component", "group_id")).join(starts, "root")
        .select("group_id", "label", F.col("start").alias("target"))
    )
    last_move = moves.groupBy(*key).agg(F.max("group_id").alias("group_id")).join(target, "group_id").select(
        *key, "target")
    moved = cut_lineage(
        base.join(last_move, key, "left").withColumn("canonical_id", F.coalesce("target", "canonical_id"))
        .drop("target"))

    counts = moved.groupBy("canonical_id").agg(
        F.count("*").alias("member_count"), F.count_distinct("feed_id").alias("feed_count"))
    traits = [c for c in canonicals.columns if c not in ("canonical_id", "member_count", "feed_count")]
    place = [c for c in ("lat", "lon") if c in traits]
    splits = moved.where("split").withColumn(
        "split_id", F.concat("old_id", F.lit("__split__"), "feed_id", F.lit("_"), "raw_id"))
    from_split = splits.select("split_id", F.col("old_id").alias("canonical_id"),
                               *[F.col(c).alias(f"own_{c}") for c in place]).join(canonicals, "canonical_id").select(
        F.col("split_id").alias("canonical_id"),
        *[(F.col(f"own_{c}") if c in place else F.col(c)).alias(c) for c in traits])
    summary = canonicals.select("canonical_id", *traits).unionByName(from_split).join(counts, "canonical_id")
    if kind == "stop":
        label = target.where("label <> ''").groupBy("target").agg(
            F.max_by("label", "group_id").alias("label")).withColumnRenamed("target", "canonical_id")
        summary = summary.join(label, "canonical_id", "left").withColumn(
            "name", F.coalesce("label", "name")).drop("label")
    return moved.drop("split", "old_id"), cut_lineage(summary)


def evaluate_pairs(registry: Registry, truth: DataFrame) -> DataFrame:
    """Labelled pairs (kind, feed_a, raw_a, feed_b, raw_b, same) with what the registry says of each."""
    ids = registry.stops.select(F.lit("stop").alias("kind"), "feed_id", "raw_id", "canonical_id").unionByName(
        registry.routes.select(F.lit("route").alias("kind"), "feed_id", "raw_id", "canonical_id"))
    ids = ids.groupBy("kind", "feed_id", "raw_id").agg(F.min("canonical_id").alias("canonical_id"))
    side = lambda x: ids.select("kind", F.col("feed_id").alias(f"feed_{x}"), F.col("raw_id").alias(f"raw_{x}"),
                                F.col("canonical_id").alias(f"canonical_{x}"))
    return (
        truth.join(side("a"), ["kind", "feed_a", "raw_a"], "left").join(side("b"), ["kind", "feed_b", "raw_b"], "left")
        .withColumn("predicted", F.col("canonical_a") == F.col("canonical_b"))
    )


def match_quality(evaluated: DataFrame) -> DataFrame:
    p, s = F.col("predicted"), F.col("same")
    ratio = lambda num, den: F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    c = evaluated.groupBy("kind").agg(
        F.count_if(p & s).alias("tp"), F.count_if(p & ~s).alias("fp"), F.count_if(~p & ~s).alias("tn"),
        F.count_if(~p & s).alias("fn"), F.count_if(p.isNull()).alias("unknown"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("total", tp + fp + tn + fn).withColumn("precision", ratio(tp, tp + fp)).withColumn(
        "recall", ratio(tp, tp + fn))
    pr, rc = F.col("precision"), F.col("recall")
    return c.withColumn("f1", ratio(2 * pr * rc, pr + rc)).withColumn("accuracy", ratio(tp + tn, F.col("total")))


def match_mistakes(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("predicted IS NOT NULL AND predicted <> same")


def browse(canonicals: DataFrame, text: str = "", min_feeds: int = 1, limit: int | None = None) -> DataFrame:
    """Search canonicals by name, id (and agency); widest first, all of them unless a ``limit`` is asked for."""
    fields = [c for c in ("name", "short_name", "long_name", "agency", "canonical_id") if c in canonicals.columns]
    q = text.strip().lower()
    hit = F.lit(not q)
    for f in fields:
        hit = hit | F.contains(F.lower(F.col(f)), F.lit(q))
    name = "name" if "name" in canonicals.columns else "short_name"
    found = canonicals.where((F.col("feed_count") >= min_feeds) & hit).orderBy(
        F.desc("feed_count"), F.desc("member_count"), name, "canonical_id")
    return found if limit is None else found.limit(limit)


def stale_feeds(built: DataFrame, loaded: DataFrame) -> DataFrame:
    """Feeds in one list only; any row means the registry must be rebuilt."""
    b, n = built.select("feed_id").distinct(), loaded.select("feed_id").distinct()
    gone = b.join(n, "feed_id", "left_anti").withColumn("change", F.lit("unloaded"))
    new = n.join(b, "feed_id", "left_anti").withColumn("change", F.lit("new"))
    return gone.unionByName(new)


_SNAPSHOTS = "snapshot string, number bigint, saved_at timestamp"


def save_registry(registry: Registry, path: str) -> None:
    """Write a whole new snapshot, then one row that makes it the current one: readers never see half of it."""
    snapshot, spark = uuid.uuid4().hex, registry.stops.sparkSession
    for name in ("stops", "routes", "canonical_stops", "canonical_routes"):
        getattr(registry, name).withColumn("registry_version", F.lit(REGISTRY_VERSION)).write.option(
            "compression", "zstd").parquet(f"{path}/{snapshot}/{name}")
    try:
        last = spark.read.schema(_SNAPSHOTS).parquet(f"{path}/_current").agg(F.max("number")).first()[0]
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last = None
    now = spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.lit((last or 0) + 1).cast("bigint").alias("number"),
                                F.current_timestamp().alias("saved_at"))
    now.write.mode("append").parquet(f"{path}/_current")


def load_registry(spark, path: str) -> Registry | None:
    """The saved registry, or none when it was written by another version. The snapshot of the highest number is current."""
    current = spark.read.schema(_SNAPSHOTS).parquet(f"{path}/_current")
    at = f"{path}/{current.orderBy(F.desc_nulls_last('number'), F.desc('saved_at'), 'snapshot').first()['snapshot']}"
    parts = {n: spark.read.parquet(f"{at}/{n}") for n in ("stops", "routes", "canonical_stops", "canonical_routes")}
    other = parts["stops"].where(F.col("registry_version") != REGISTRY_VERSION)
    if not other.isEmpty():
        return None
    return Registry(**{n: df.drop("registry_version") for n, df in parts.items()})
