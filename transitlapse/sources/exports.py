"""CSV exports of diff rows and the trend table."""

from __future__ import annotations

from pyspark.sql import DataFrame

EXPORT_COLUMNS = ["id", "file", "action", "target", "identifier", "initial_value", "new_value", "note"]
TREND_COLUMNS = ["year", "feed", "stops", "routes", "trips", "service_start", "service_end", "weekly_trips"]
_CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}


def write_gtfs_diff(rows: DataFrame, path: str) -> None:
    """GTFS-Diff v1 files, one folder per compared pair."""
    rows.select("feed_a", "feed_b", *EXPORT_COLUMNS).write.mode("overwrite").options(**_CSV).partitionBy(
        "feed_a", "feed_b").csv(path)


def write_trend(rows: DataFrame, path: str) -> None:
    """The trend table, one row per feed, as one file in chronological order."""
    rows.orderBy("rep_ms", "feed_id").select(*TREND_COLUMNS).coalesce(1).write.mode("overwrite").options(**_CSV).csv(path)
