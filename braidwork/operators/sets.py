"""Set operations on keys, peaks, and attention above a moving anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import DATE


def compare_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Every key of either side once, and whether ``both``, ``left`` or ``right`` have it.

    One union and aggregate instead of an intersection and two differences.
    """
    mark = lambda df, a, b: df.select(*on, F.lit(a).alias("l"), F.lit(b).alias("r"))
    sides = mark(left, 1, 0).unionAll(mark(right, 0, 1)).groupBy(*on).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.select(*on, F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def top_peaks(series: DataFrame, share: float = 0.05) -> DataFrame:
    """The highest share of dates of every series, at least one; equal values go by date."""
    whole = W.partitionBy("series_id")
    rank = F.row_number().over(whole.orderBy(F.col("value").desc_nulls_last(), "historical_date"))
    k = F.greatest(F.ceil(share * F.count("*").over(whole)), F.lit(1))
    return series.select(*DATE, "value", rank.alias("rank"), k.alias("k")).where("rank <= k").drop("k")


def abnormal_attention(series: DataFrame, days: int = 28) -> DataFrame:
    """The log of a value over the median of the ``days`` rows before it; null before there are so many.

    Each frame holds at most ``days`` values.
    """
    before = W.partitionBy("series_id").orderBy("historical_date").rowsBetween(-days, -1)
    past = F.sort_array(F.collect_list("value").over(before))
    middle = (F.element_at("past", F.floor((F.size("past") + 1) / 2).cast("int")) + F.element_at("past", F.floor(F.size("past") / 2).cast("int") + 1)) / 2
    rows = series.select(*DATE, "value", past.alias("past")).withColumn("anchor", F.when(F.size("past") == days, middle))
    return rows.select(*DATE, "value", "anchor", F.when((F.col("value") > 0) & (F.col("anchor") > 0), F.ln("value") - F.ln("anchor")).alias("abnormal"))
