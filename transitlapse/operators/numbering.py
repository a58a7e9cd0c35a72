"""Sequential numbers and nearest-rank percentiles without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transitlapse.session import cut_lineage


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1, 2, 3... within ``keys``, in the order of ``order``.

    Rows are cut into ranges of (keys, order), numbered inside their range and shifted by the counts of the ranges
    before, so that a large group is never in one task.
    """
    cut = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_b", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    counts = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return (
        cut.withColumn("_r", F.row_number().over(inside)).join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")
    )


_CUTS = 64


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float = 0.95) -> DataFrame:
    """Per key: ``top`` (maximum), ``p_value`` (exact nearest-rank percentile) and ``scale`` (p, else top).

    Distinct values are counted, spread over ranges cut at approximate quantiles, and only the range that
    holds the wanted rank is walked.
    """
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = vals.groupBy(*keys).agg(
        F.percentile_approx("_v", [i / _CUTS for i in range(1, _CUTS)], 1000).alias("_q"),
        F.sum("_c").alias("_n"), F.max("_v").alias("top"))
    joined = vals.join(cuts, keys) if keys else vals.withColumn("_k", cuts.agg(
        F.first(F.struct("_q", "_n", "top"))).scalar()).select("_v", "_c", "_k.*")
    ranged = joined.withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col("_v")))).drop("_q")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per = ranged.groupBy(*keys, "_b").agg(F.sum("_c").alias("_in"), F.first("_n").alias("_n"))
    rank = F.ceil(F.col("_n") * F.lit(p))
    per = per.withColumn("_o", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    hit = per.where((F.col("_o") < rank) & (F.col("_o") + F.col("_in") >= rank)).select(*keys, "_b", "_o")
    walk = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        ranged.join(hit, [*keys, "_b"]).withColumn("_cum", F.col("_o") + F.sum("_c").over(walk))
        .where(F.col("_cum") >= F.ceil(F.col("_n") * F.lit(p)))
        .groupBy(*keys).agg(F.min("_v").alias("p_value"), F.first("top").alias("top"))
    )
    return found.withColumn("scale", F.when(F.col("p_value") > 0, F.col("p_value")).otherwise(F.col("top")))
