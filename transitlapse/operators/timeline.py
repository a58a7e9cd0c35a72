"""Feeds on a time axis: years, labels, chronological steps, trend and change summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transitlapse.functions import modes as M
from transitlapse.functions.geo import half_up
from transitlapse.operators import service as S
from transitlapse.schema import Feeds


def feed_years(feeds: Feeds) -> DataFrame:
    """Representative date and year: midpoint of the validity span, else the load time."""
    dated = feeds.feeds.join(S.feed_dates(feeds), "feed_id", "left")
    d1, d2 = M.gtfs_date(F.col("start_date")), M.gtfs_date(F.col("end_date"))
    lo, hi = F.least(d1, d2), F.greatest(d1, d2)
    known = d1.isNotNull() & d2.isNotNull()
    mid_day = F.floor((F.unix_date(lo) + F.unix_date(hi)) / 2)
    rep_ms = F.when(known, mid_day * F.lit(86_400_000)).otherwise(F.col("loaded_at")).cast("long")
    rep_date = F.date_from_unix_date(F.floor(rep_ms / 86_400_000).cast("int"))
    return dated.select(
        "feed_id", "source_name", "loaded_at", "start_date", "end_date", rep_ms.alias("rep_ms"),
        rep_date.alias("rep_date"), F.year(rep_date).alias("year"),
        F.when(known, lo).alias("span_start"), F.when(known, hi).alias("span_end"), (~known).alias("synthetic"))


def feed_labels(feeds: Feeds) -> DataFrame:
    """``source stem (year)``."""
    stem = F.regexp_replace("source_name", r"(?i)\.zip$", "")
    clean = F.trim(F.regexp_replace(stem, r"\s*\(\d{4}\)\s*$", ""))
    return feed_years(feeds).select(
        "feed_id", F.concat(clean, F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("label"))


def feed_catalog(feeds: Feeds) -> DataFrame:
    """All feeds with counts, dates and a freshly derived label, oldest load first."""
    return (
        feeds.feeds.join(feed_labels(feeds), "feed_id").join(S.feed_counts(feeds), "feed_id")
        .join(S.feed_dates(feeds), "feed_id").orderBy("loaded_at", "feed_id")
    )


def feed_year_labels(feeds: Feeds) -> DataFrame:
    """Shortest unambiguous label of each feed: year, then month, then day."""
    in_year = F.count("*").over(W.partitionBy("year"))
    in_month = F.count("*").over(W.partitionBy("year", F.month("rep_date")))
    return feed_years(feeds).select(
        "feed_id", "year", "rep_ms",
        F.when(in_year <= 1, F.col("year").cast("string"))
        .when(in_month <= 1, F.date_format("rep_date", "yyyy-MM"))
        .otherwise(F.date_format("rep_date", "yyyy-MM-dd")).alias("year_label"))


def year_range(feeds: Feeds) -> DataFrame:
    """First and last year and every year between."""
    span = feed_years(feeds).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return span.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("year"))


def feed_for_year(feeds: Feeds) -> DataFrame:
    """Feed shown for each year in range: that year's last loaded, else the nearest, the later on a tie."""
    years = year_range(feeds).select(F.col("year").alias("asked"))
    have = feed_years(feeds).groupBy("year").agg(
        F.max_by("feed_id", F.struct("loaded_at", "feed_id")).alias("last_loaded"),
        F.min_by("feed_id", F.struct("rep_ms", "feed_id")).alias("first_dated"))
    exact = years.join(have, years.asked == have.year, "left")
    known = F.when(F.col("year").isNotNull(), F.struct("year", "first_dated"))
    back = W.orderBy("asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.orderBy(F.desc("asked")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = (
        exact.withColumn("before", F.last(known, ignorenulls=True).over(back))
        .withColumn("after", F.last(known, ignorenulls=True).over(ahead))
    )
    later = F.col("before").isNull() | (
        F.col("after.year") - F.col("asked") <= F.col("asked") - F.col("before.year"))
    pick = F.when(F.col("year").isNotNull(), F.col("last_loaded")).when(
        F.coalesce(later, F.lit(False)), F.col("after.first_dated")).otherwise(F.col("before.first_dated"))
    return near.select(F.col("asked").alias("year"), pick.alias("feed_id"))


def feeds_between(feeds: Feeds, slots: DataFrame) -> DataFrame:
    """Feeds on the strip bounded by two slots (feed_a, feed_b), in either order."""
    fy = feed_years(feeds).select("feed_id", "rep_ms", "year")
    at = lambda side: fy.select(F.col("feed_id").alias(f"feed_{side}"), F.struct("rep_ms", "feed_id").alias(f"at_{side}"))
    bounds = slots.join(at("a"), "feed_a").join(at("b"), "feed_b").select(
        "feed_a", "feed_b", F.least("at_a", "at_b").alias("lo"), F.greatest("at_a", "at_b").alias("hi"))
    # The feed list is release metadata: one short array, sliced per slot pair.
    strip = fy.agg(F.array_sort(F.collect_list(F.struct("rep_ms", "feed_id", "year"))).alias("all")).scalar()
    at_f = lambda f: F.struct(f["rep_ms"].alias("rep_ms"), f["feed_id"].alias("feed_id"))
    within = F.filter("strip", lambda f: (at_f(f) >= F.col("lo")) & (at_f(f) <= F.col("hi")))
    return bounds.withColumn("strip", strip).select("feed_a", "feed_b", F.explode(within).alias("f")).select(
        "feed_a", "feed_b", "f.feed_id", "f.year", "f.rep_ms")


def feed_steps(feeds: Feeds) -> DataFrame:
    """Each feed with its chronological predecessor."""
    order = W.orderBy("rep_ms", "feed_id")
    return (
        feed_years(feeds).select(F.lag("feed_id").over(order).alias("feed_a"), F.col("feed_id").alias("feed_b"))
        .where("feed_a IS NOT NULL")
    )


def auto_pair(feeds: Feeds) -> DataFrame:
    """Default comparison: oldest feed against newest."""
    at = F.struct("rep_ms", "feed_id")
    return (
        feed_years(feeds).agg(F.min_by("feed_id", at).alias("feed_a"), F.max_by("feed_id", at).alias("feed_b"))
        .where("feed_a <> feed_b")
    )


def trend(feeds: Feeds) -> DataFrame:
    """One row per feed for the trend chart and its CSV."""
    return (
        feed_year_labels(feeds).join(feed_labels(feeds), "feed_id").join(S.feed_counts(feeds), "feed_id")
        .join(S.feed_dates(feeds), "feed_id").join(S.feed_weekly_trips(feeds), "feed_id")
        .select("feed_id", "rep_ms", F.col("year_label").alias("year"), F.col("label").alias("feed"),
                F.col("stop_count").alias("stops"), F.col("route_count").alias("routes"),
                F.col("trip_count").alias("trips"), M.iso_date(F.col("start_date")).alias("service_start"),
                M.iso_date(F.col("end_date")).alias("service_end"),
                F.col("trips_per_week").alias("weekly_trips"))
    )


METRICS = ["stops", "routes", "trips", "weekly_trips"]


def trend_since_baseline(feeds: Feeds, baseline: DataFrame) -> DataFrame:
    """Trend metrics relative to a baseline feed (one-row ``baseline`` with feed_id)."""
    rows = trend(feeds)
    base = rows.join(baseline, "feed_id", "left_semi").agg(F.struct(*[F.min(m).alias(m) for m in METRICS]).alias("b"))
    based = rows.withColumn("b", base.scalar())
    shifted = [F.when(F.col(f"b.{m}").isNotNull(), F.col(m) - F.col(f"b.{m}")).otherwise(F.col(m)).alias(m)
               for m in METRICS]
    return based.select("feed_id", "year", *shifted)


def cumulative_stops(step_diffs: DataFrame, chain: DataFrame) -> DataFrame:
    """Stops ever added or removed along the steps of ``chain`` (feed_a, feed_b): churn, not net."""
    return (
        step_diffs.join(chain, ["feed_a", "feed_b"], "left_semi")
        .where(F.col("status").isin("added", "removed")).select("canonical_id", "status").distinct()
    )


def change_summary(feeds: Feeds, stops: DataFrame, routes: DataFrame, freq: DataFrame,
                   churn: DataFrame | None = None) -> DataFrame:
    """One row per compared pair: entity counts, trips, frequency winners and service windows.

    ``churn`` (feed_a, feed_b, added, removed) replaces the net stop counts where given.
    """
    pair = ["feed_a", "feed_b"]

    def counts(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
        return df.groupBy(*pair).agg(*[F.count_if(F.col("status") == n).alias(f"{prefix}_{n}") for n in names])

    s = counts(stops, "stops", ["added", "removed", "moved", "renamed", "unchanged"])
    r = counts(routes, "routes", ["added", "removed", "renumbered", "modified", "unchanged"])
    f = freq.where(~F.col("status").isin("added", "removed")).groupBy(*pair).agg(
        F.count_if(F.col("delta") > 0).alias("freq_gain"), F.count_if(F.col("delta") < 0).alias("freq_loss"))
    meta = S.feed_counts(feeds).join(S.feed_dates(feeds), "feed_id").select(
        "feed_id", "trip_count", M.iso_date(F.col("start_date")).alias("s"), M.iso_date(F.col("end_date")).alias("e"))
    side = lambda x: meta.select(
        F.col("feed_id").alias(f"feed_{x}"), F.col("trip_count").alias(f"trips_{x}"),
        F.col("s").alias(f"span_start_{x}"), F.col("e").alias(f"span_end_{x}"))
    out = (
        s.join(r, pair, "full_outer").join(f, pair, "left")
        .join(side("a"), "feed_a").join(side("b"), "feed_b")
        .na.fill(0, [c for c in s.columns + r.columns + f.columns if c not in pair])
        .withColumn("net_stops_added", F.col("stops_added")).withColumn("net_stops_removed", F.col("stops_removed"))
        .withColumn("trip_delta", F.col("trips_b") - F.col("trips_a"))
    )
    if churn is not None:
        c = churn.select(*pair, F.col("added").alias("churn_added"), F.col("removed").alias("churn_removed"))
        out = (
            out.join(c, pair, "left")
            .withColumn("stops_added", F.coalesce("churn_added", "stops_added"))
            .withColumn("stops_removed", F.coalesce("churn_removed", "stops_removed"))
            .drop("churn_added", "churn_removed")
        )
    return out


def narrative(summary: DataFrame) -> DataFrame:
    """The summary told in sentences, in order."""
    n = lambda c: F.col(c).cast("string")
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    net_differs = (F.col("net_stops_added") != F.col("stops_added")) | (
        F.col("net_stops_removed") != F.col("stops_removed"))
    lines = [
        say((F.col("stops_added") > 0) | (F.col("stops_removed") > 0), n("stops_added"), " stops added, ",
            n("stops_removed"), " removed since baseline",
            F.when(net_differs, F.concat(F.lit(" ("), n("net_stops_added"), F.lit(" net added, "),
                                         n("net_stops_removed"), F.lit(" net removed)."))).otherwise(".")),
        say((F.col("stops_moved") > 0) | (F.col("stops_renamed") > 0), n("stops_moved"), " stops relocated, ",
            n("stops_renamed"), " renamed."),
        say((F.col("routes_added") > 0) | (F.col("routes_removed") > 0) | (F.col("routes_renumbered") > 0),
            n("routes_added"), " new routes, ", n("routes_removed"), " discontinued, ",
            n("routes_renumbered"), " renumbered."),
        say((F.col("freq_gain") > 0) | (F.col("freq_loss") > 0), n("freq_gain"), " routes gained frequency, ",
            n("freq_loss"), " lost service."),
        say(F.col("trip_delta") != 0, F.abs("trip_delta").cast("string"),
            F.when(F.col("trip_delta") >= 0, " more").otherwise(" fewer"), " scheduled trips overall."),
        say((F.col("span_start_a") != F.col("span_start_b")) | (F.col("span_end_a") != F.col("span_end_b")),
            "Service window: ", F.col("span_start_a"), " → ", F.col("span_end_a"), " to ",
            F.col("span_start_b"), " → ", F.col("span_end_b"), "."),
    ]
    told = F.filter(F.array(*lines), lambda x: x.isNotNull())
    told = F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("No changes detected since baseline.")))
    return summary.select("feed_a", "feed_b", F.posexplode(told).alias("pos", "sentence"))


def entity_history(feeds: Feeds, members: DataFrame) -> DataFrame:
    """Per canonical stop: feeds it appears in, distinct names and places (one member per feed).

    ``members``: canonical_id, feed_id, raw_id, name, lat, lon.
    """
    one = members.groupBy("canonical_id", "feed_id").agg(
        F.max_by(F.struct("name", "lat", "lon"), "raw_id").alias("m"))
    place = F.concat_ws(",", half_up(F.col("m.lat"), 5).cast("string"), half_up(F.col("m.lon"), 5).cast("string"))
    total = feeds.feeds.agg(F.count("*")).scalar()
    return one.groupBy("canonical_id").agg(
        F.count("*").alias("present"), F.count_distinct("m.name").alias("names"),
        F.count_distinct(place).alias("places")).withColumn("feeds_total", total)


def entity_rows(feeds: Feeds, members: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """The history behind ``entity_history``, feed by feed.

    All entities: a row for each feed they are present in. ``pinned`` (canonical_id) entities: a row for each feed,
    present or not.
    """
    one = members.groupBy("canonical_id", "feed_id").agg(
        F.max_by(F.struct("raw_id", "name", "lat", "lon"), "raw_id").alias("m"))
    years = feed_years(feeds).select("feed_id", "year")
    if pinned is None:
        rows = one.join(years, "feed_id")
    else:
        listed = years.agg(F.collect_list(F.struct("feed_id", "year")).alias("f"))  # feeds, one short row each
        ids = pinned.select("canonical_id").distinct().withColumn("f", F.explode(listed.scalar()))
        rows = ids.select("canonical_id", "f.feed_id", "f.year").join(one, ["canonical_id", "feed_id"], "left")
    return rows.select("canonical_id", "feed_id", "year", F.col("m").isNotNull().alias("present"), "m.name", "m.lat", "m.lon")
