"""Labelled pair files: CSV with a header or JSON ``{kind, pairs}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["feedA", "rawA", "feedB", "rawB", "same"]
KINDS = ["stop", "route"]


def _shape(df: DataFrame) -> DataFrame:
    return df.select("kind", F.col("feedA").alias("feed_a"), F.col("rawA").alias("raw_a"),
                     F.col("feedB").alias("feed_b"), F.col("rawB").alias("raw_b"), "same")


def _yes(c) -> F.Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike("(?i)^(1|true|yes|y|t)$")


def parse_csv_lines(lines: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Parse CSV rows (``line``) laid out as ``header``; without any kind the pairs are stops."""
    header = header or ["kind", *FIELDS]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    row = F.from_csv("line", ", ".join(f"`{h}` STRING" for h in header), {"quote": '"', "escape": '"'}).alias("r")
    df = lines.where(F.trim("line") != "").select(row).select("r.*")
    assert schema.names == df.columns
    return _typed(df)


def _typed(df: DataFrame) -> DataFrame:
    kind = F.trim("kind") if "kind" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("kind", F.when(kind != "", kind))
    return _shape(df.withColumn("kind", F.coalesce("kind", F.lit("stop"))).withColumn("same", _yes(F.col("same"))))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Read a truth file by its ending; mixed or unknown kinds and missing columns are errors."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option(
            "ignoreLeadingWhiteSpace", True).csv(path)
        lacking = [c for c in FIELDS if c not in df.columns]
        if lacking:
            raise ValueError(f"truth file lacks columns {lacking}")
        stated = df.select(F.trim("kind").alias("kind")).where("kind <> ''") if "kind" in df.columns else None
        out = _typed(df)
        if stated is not None:
            _check_kinds(stated)
            only = stated.agg(F.first("kind")).scalar()
            out = out.withColumn("kind", F.coalesce(only, "kind"))
        return out
    pair = ", ".join(f"{c}: STRING" for c in FIELDS)
    df = spark.read.schema(f"kind STRING, pairs ARRAY<STRUCT<{pair}>>").option("multiLine", True).json(path)
    if not df.where("kind IS NULL OR pairs IS NULL").isEmpty() or df.isEmpty():
        raise ValueError("truth file needs kind and pairs")
    _check_kinds(df.select("kind"))
    return _shape(df.select("kind", F.inline("pairs")).withColumn("same", _yes(F.col("same"))))


def _check_kinds(kinds: DataFrame) -> None:
    found = [r["kind"] for r in kinds.distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"mixed kinds in one truth file: {sorted(found)}")
    if found and found[0] not in KINDS:
        raise ValueError(f"unsupported kind {found[0]!r}")
