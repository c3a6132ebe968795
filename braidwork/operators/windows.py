"""Chunk windows and the balanced collection schedule."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_COLUMNS = ["chunk_id", "window_start", "window_end", "n_calendar_days"]


def _day(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def chunk_windows(spark: SparkSession, start: date | str, end: date | str, window_days: int = 180, step_days: int = 15) -> DataFrame:
    """Overlapping inclusive windows that cover ``start`` to ``end``; the last is anchored to ``end``.

    A window begins at every step as long as it ends before ``end``; one more of full width ends there,
    or the one window is the whole interval where that is shorter.
    """
    a, b = _day(start), _day(end)
    if b < a:
        raise ValueError("end must not precede start")
    if not 0 < step_days < window_days:
        raise ValueError("require 0 < step_days < window_days")
    width = window_days - 1
    regular = -(-max((b - a).days - width, 0) // step_days)
    spans = spark.range(regular).select((F.lit(step_days) * F.col("id")).cast("int").alias("offset"))
    last = spark.range(1).select(F.lit(max(0, (b - a).days - width)).alias("offset"))
    starts = spans.union(last).distinct().select(F.date_add(F.lit(a), F.col("offset")).alias("window_start"))
    ends = F.least(F.date_add("window_start", width), F.lit(b))
    rank = F.row_number().over(W.orderBy("window_start"))  # as many rows as windows
    return starts.select(
        F.format_string("C%04d", rank).alias("chunk_id"),
        "window_start",
        ends.alias("window_end"),
        (F.datediff(ends, "window_start") + 1).alias("n_calendar_days"),
    )


def collection_schedule(spark: SparkSession, config, chunk_ids: Sequence[str], anchor: date | str) -> DataFrame:
    """The locked plan, one row per pull: days by offset, streams in turn, replicates in a slot.

    With balancing, the streams of a day begin one further than those of the day before, and go backward
    on every other round of days; the chunks of a pull begin one further than those of the pull before,
    and every other pull takes them backward. Replicates, where there are several, begin up to four
    minutes late, by a hash of the design's seed. All of a row follows from its number.
    """
    design, query = config.design, config.query
    days, streams, chunks, slots = len(design.day_offsets), len(design.streams), len(chunk_ids), len(design.time_slots)
    strings = lambda items: F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")
    n, replicates = F.col("id"), design.technical_replicates
    day, at = F.floor(n / (streams * replicates)).cast("int"), F.pmod(F.floor(n / replicates), F.lit(streams)).cast("int")
    stream = at
    if design.balance_stream_order:
        back = F.pmod(F.floor(day / streams), F.lit(2)) == 1
        stream = F.pmod(day + F.when(back, -at).otherwise(at), F.lit(streams))
    step = F.sequence(F.lit(0), F.lit(chunks - 1)) if chunks else F.array().cast("array<int>")
    if design.balance_chunk_order and chunks:
        order = F.transform(step, lambda i: F.pmod(n + F.when(n % 2 == 1, chunks - 1 - i).otherwise(i), F.lit(chunks)))
    else:
        order = step
    minute = F.get(F.array(*[F.lit(60 * int(t.split(":")[0]) + int(t.split(":")[1])) for t in design.time_slots]), F.pmod(at, F.lit(slots)))
    late = F.pmod(F.xxhash64(F.lit(design.random_seed), n), F.lit(5)).cast("int") if replicates > 1 else F.lit(0)
    rows = spark.range(days * streams * replicates).select(
        "id", day.alias("day"), at.alias("at"), stream.cast("int").alias("stream"), order.alias("order"), (minute + late).alias("minute"), (n % replicates + 1).alias("replicate"),
        F.get(F.array(*map(F.lit, design.day_offsets)), day).alias("day_offset"),
    )
    when = F.date_add(F.lit(_day(anchor)), F.col("day_offset"))
    begin = F.concat(F.date_add(when, F.floor(F.col("minute") / 1440).cast("int")).cast("string"), F.format_string("T%02d:%02d:00", F.floor(F.pmod("minute", F.lit(1440)) / 60), F.pmod("minute", F.lit(60))))
    return rows.select(
        F.format_string("P%03d", F.col("id") + 1).alias("pull_id"),
        F.lit(query.series_id).alias("series_id"),
        "day_offset",
        F.col("day").alias("collection_day"),
        when.cast("string").alias("planned_collection_date"),
        begin.alias("planned_start_time"),
        F.get(strings(design.streams), F.col("stream")).alias("stream_id"),
        (F.col("at") + 1).alias("stream_order"),
        F.col("replicate").cast("string").alias("replicate_id"),
        F.size("order").alias("chunk_count"),
        F.to_json(F.transform("order", lambda i: F.get(strings(list(chunk_ids)), i.cast("int")))).alias("chunk_order_json"),
        F.lit(query.historical_start.isoformat()).alias("historical_start"),
        F.lit(query.historical_end.isoformat()).alias("historical_end"),
        F.lit(config.protocol_hash()).alias("protocol_hash"),
    )
