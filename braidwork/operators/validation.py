"""Validation, coercion and audit of raw chunk tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import chunk_windows

REQUIRED = ("series_id", "pull_id", "chunk_id", "historical_date", "value", "collection_day", "stream_id", "replicate_id", "window_start", "window_end")
DATES = ("historical_date", "window_start", "window_end")
KEY = ("series_id", "pull_id", "chunk_id", "historical_date")
ISSUE = "severity string, code string, message string, rows long"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _date(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("date") if df.schema[c].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.try_to_timestamp(_text(c)).cast("date")


def _number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` as double)")


def _listed(counts: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Issue rows of the counters that are not zero; ``rules``: severity, code, message, counter."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(m).alias("message"), F.col(n).cast("long").alias("rows")) for s, c, m, n in rules]))
    return counts.select(rows.alias("issue")).select("issue.*").where("rows > 0")


def validate_raw_chunks(df: DataFrame) -> DataFrame:
    """Issues of a raw table, one row each: ``severity, code, message, rows``.

    One pass of conditional counts; repeated keys come from a partial aggregate, of which all members
    count. Missing columns are the only issue reported if there are any. A null date is invalid, a null
    value is not.
    """
    spark = df.sparkSession
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        return spark.createDataFrame([("error", "missing_columns", f"missing columns: {missing}", 0)], ISSUE)
    v, day, start, end = _number("value"), *(_date(df, c) for c in DATES)
    flags = {
        **{f"invalid_{c}": _date(df, c).isNull() for c in DATES},
        "invalid_value": F.col("value").isNotNull() & v.isNull(),
        "value_outside_0_100": (v < 0) | (v > 100),
        "date_outside_window": (day < start) | (day > end),
    }
    if "is_partial" in df.columns:
        flags["partial_observations"] = F.coalesce(F.col("is_partial").cast("boolean"), F.lit(False))
    counts = df.agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(n) for n, f in flags.items()])
    repeated = df.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_raw_keys"))
    messages = {
        **{f"invalid_{c}": f"{c} is no date" for c in DATES},
        "invalid_value": "values that are no numbers",
        "value_outside_0_100": "values outside 0 to 100",
        "duplicate_raw_keys": "rows that share a key",
        "date_outside_window": "dates outside their window",
        "partial_observations": "partial observations",
    }
    rules = [("warning" if n == "value_outside_0_100" else "error", n, m, n) for n, m in messages.items() if n in flags or n == "duplicate_raw_keys"]
    return _listed(counts.crossJoin(F.broadcast(repeated)), rules)  # two tables of one row


def coerce_raw_chunks(df: DataFrame) -> DataFrame:
    """Typed raw rows: dates, a UTC timestamp, a double value, an int day that must parse, and text ids."""
    out = df
    for c in DATES:
        out = out.withColumn(c, _date(df, c))
    if "retrieved_at" in df.columns:
        out = out.withColumn("retrieved_at", F.try_to_timestamp(_text("retrieved_at")))
    out = out.withColumn("value", F.when(~F.isnan(_number("value")), _number("value"))).withColumn("collection_day", F.col("collection_day").cast("int"))
    for c in ("replicate_id", "stream_id", "pull_id", "chunk_id", "series_id"):
        out = out.withColumn(c, _text(c))
    return out


@dataclass(frozen=True)
class Audit:
    """Issues, and one row of summary counters with ``passed``."""

    issues: DataFrame
    summary: DataFrame


def endpoint_drift(data: DataFrame, start, end) -> DataFrame:
    """Pulls of a series whose first or last date is not the locked one."""
    ends = data.groupBy("series_id", "pull_id").agg(F.min("historical_date").alias("first"), F.max("historical_date").alias("last"))
    return ends.where((F.col("first") != F.lit(str(start)).cast("date")) | (F.col("last") != F.lit(str(end)).cast("date")))


def chunk_drift(data: DataFrame, expected: DataFrame) -> DataFrame:
    """Chunk ids outside the protocol, and declared windows that differ from it."""
    declared = data.select("chunk_id", "window_start", "window_end").distinct()
    locked = expected.select("chunk_id", F.col("window_start").alias("ws"), F.col("window_end").alias("we"))
    both = declared.join(F.broadcast(locked), "chunk_id", "left")
    unknown = both.where("ws is null").select("chunk_id").distinct().withColumn("kind", F.lit("unknown"))
    moved = both.where("ws is not null and (window_start <> ws or window_end <> we)").select("chunk_id").withColumn("kind", F.lit("moved"))
    return unknown.unionAll(moved)


def missing_chunks(data: DataFrame, expected: DataFrame) -> DataFrame:
    """Locked chunks that a pull of a series does not have."""
    have = data.select("series_id", "pull_id", "chunk_id").distinct()
    wanted = have.select("series_id", "pull_id").distinct().crossJoin(F.broadcast(expected.select("chunk_id")))  # the protocol's chunks
    return wanted.join(have, ["series_id", "pull_id", "chunk_id"], "left_anti")


def ambiguous_pulls(data: DataFrame) -> DataFrame:
    """Design rows of pulls of a series that have more than one."""
    rows = data.select("series_id", "pull_id", "collection_day", "stream_id", "replicate_id").distinct()
    return rows.withColumn("n", F.count("*").over(W.partitionBy("series_id", "pull_id"))).where("n > 1").drop("n")


def batch_summary(data: DataFrame) -> DataFrame:
    """Counters of a typed raw table and its sorted design levels, in one row."""
    levels = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return data.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("pull_id").alias("n_pulls"),
        F.count_distinct("chunk_id").alias("n_chunks"),
        F.count_distinct("historical_date").alias("n_dates"),
        F.avg(F.coalesce((F.col("value") == 0).cast("double"), F.lit(0.0))).alias("zero_share"),
        levels("collection_day").alias("collection_days"),
        levels("stream_id").alias("streams"),
        levels("replicate_id").alias("replicates"),
    )


def audit_raw_batch(spark: SparkSession, df: DataFrame, config) -> Audit:
    """Hold a raw table against the locked protocol.

    Validation errors end the audit, with the number of rows as the only counter. Warnings do not fail.
    """
    issues = validate_raw_chunks(df)
    if issues.where("severity = 'error'").head(1):
        return Audit(issues, df.agg(F.count("*").alias("n_rows")).withColumn("passed", F.lit(False)))
    data, q = coerce_raw_chunks(df), config.query
    expected = chunk_windows(spark, q.historical_start, q.historical_end, config.chunking.window_days, config.chunking.step_days)
    count = lambda rows, code: rows.agg(F.count("*").alias(code))
    counts = count(endpoint_drift(data, q.historical_start, q.historical_end), "historical_window_drift")
    counts = counts.crossJoin(count(chunk_drift(data, expected), "chunk_definition_drift")).crossJoin(count(missing_chunks(data, expected), "missing_chunks"))
    locked = {"keyword": q.keyword, "geo": q.geo, "category": q.category, "search_property": q.search_property, "language": q.language}
    flags = {f"query_spec_drift_{c}": ~F.col(c).cast("string").eqNullSafe(F.lit(str(x))) for c, x in locked.items() if c in data.columns}
    if "protocol_hash" in data.columns:
        flags["protocol_hash_mismatch"] = ~F.col("protocol_hash").cast("string").eqNullSafe(F.lit(config.protocol_hash()))
    if flags:
        counts = counts.crossJoin(data.agg(*[F.count_if(f).alias(n) for n, f in flags.items()]))
    counts = counts.crossJoin(count(ambiguous_pulls(data), "ambiguous_pull_metadata"))
    messages = {
        "historical_window_drift": "a pull does not have the locked endpoints",
        "chunk_definition_drift": "chunks differ from the locked protocol",
        "missing_chunks": "a pull lacks locked chunks",
        **{n: f"{n.removeprefix('query_spec_drift_')} differs from the protocol" for n in flags if n.startswith("query")},
        "protocol_hash_mismatch": "rows of another protocol",
        "ambiguous_pull_metadata": "a pull has more than one day, stream or replicate",
    }
    found = _listed(counts, [("error", n, m, n) for n, m in messages.items() if n in counts.columns])
    every = issues.unionByName(found)
    passed = every.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))
    return Audit(every, batch_summary(data).crossJoin(passed))
