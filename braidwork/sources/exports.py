"""Ingesting exported chunk files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File names carry the chunk id and the window: ``...C0001_2024-01-01_2024-06-28...csv``.
NAME = r"(C\d{4})_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})[^/]*\.csv$"
#: What the export writes for positive values under 1, and what it is read as.
CENSORED, CENSORED_VALUE = "<1", 0.5


@dataclass(frozen=True)
class Ingested:
    """Observations and one row per file with its digest and counts."""

    observations: DataFrame
    files: DataFrame


def read_exports(spark: SparkSession, path: str, skip: int = 2) -> Ingested:
    """Parse exported CSV files: ``skip`` lines and a header, then a date and a value per line.

    Whole files are read, so that a file's digest and lines come from the same bytes; an export has a
    line per day of its window. A value of ``<1`` is read as one half and counted.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    part = lambda k: F.regexp_extract("path", NAME, k)
    files = raw.select(
        "path", F.sha2("content", 256).alias("sha256"), part(1).alias("chunk_id"), F.try_to_timestamp(part(2)).cast("date").alias("window_start"), F.try_to_timestamp(part(3)).cast("date").alias("window_end"),
        F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\r", ""), "\n").alias("lines"),
    )
    header = F.element_at("lines", skip + 1)
    lines = files.withColumn("n_columns", F.size(F.split(header, ","))).select("*", F.explode(F.slice("lines", skip + 2, F.greatest(F.size("lines") - skip - 1, F.lit(0)))).alias("line")).where("trim(line) <> ''")
    cell = F.split("line", ",")
    text = F.trim(cell[1])
    value = F.when(text == CENSORED, F.lit(CENSORED_VALUE)).otherwise(F.try_to_number(text, F.lit("999999999.999999")).cast("double"))
    rows = lines.select("path", "sha256", "chunk_id", "window_start", "window_end", "n_columns", F.try_to_timestamp(F.trim(cell[0])).cast("date").alias("historical_date"), value.alias("value"), (text == CENSORED).alias("censored"))
    found = rows.groupBy("path", "sha256", "chunk_id", "window_start", "window_end").agg(
        F.count("*").alias("n_rows"), F.count_if("censored").alias("n_censored"), F.max("n_columns").alias("n_columns"), F.count_if((F.col("historical_date") < F.col("window_start")) | (F.col("historical_date") > F.col("window_end")) | F.col("historical_date").isNull()).alias("n_outside")
    )
    return Ingested(rows.drop("path", "sha256", "n_columns"), found)


def export_issues(ingested: Ingested) -> DataFrame:
    """Files that hold more than one query, name no chunk or window, or have dates outside it; repeated keys."""
    f = ingested.files
    issue = lambda rows, code: rows.select(F.lit(code).alias("code"), "path", F.col("n").cast("long").alias("rows"))
    repeated = ingested.observations.groupBy("chunk_id", "historical_date").agg(F.count("*").alias("n")).where("n > 1").groupBy("chunk_id").agg(F.sum("n").alias("n")).withColumnRenamed("chunk_id", "path")
    return (
        issue(f.where("n_columns <> 2").withColumn("n", F.col("n_rows")), "more_than_one_query")
        .unionAll(issue(f.where("chunk_id = '' or window_start is null").withColumn("n", F.col("n_rows")), "unnamed_chunk"))
        .unionAll(issue(f.where("n_outside > 0").withColumn("n", F.col("n_outside")), "date_outside_window"))
        .unionAll(issue(repeated, "duplicate_keys"))
    )


def append_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The existing rows and those of chunks that a pull does not have yet."""
    have = existing.select("pull_id", "chunk_id").distinct()
    return existing.unionByName(new.join(have, ["pull_id", "chunk_id"], "left_anti"), allowMissingColumns=True)


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key by ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")
