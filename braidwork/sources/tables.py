"""Reading and writing tables by file suffix."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXCEL = (".xlsx", ".xls")


def _suffix(path: str) -> str:
    return PurePosixPath(str(path)).suffix.lower()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (with header; types inferred) or Parquet table; Excel through pandas where openpyxl is installed."""
    kind = _suffix(path)
    if kind == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(str(path))
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(str(path))
    if kind in EXCEL:
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"no reader for {kind or 'a path without suffix'}")


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """Write CSV or Parquet as Spark does; Stata (118) and Excel are for small results and go through pandas.

    ``single`` writes one part, for results that are known to be small.
    """
    kind = _suffix(path)
    out = df.coalesce(1) if single else df
    if kind == ".csv":
        out.write.mode("overwrite").option("header", True).csv(str(path))
    elif kind in (".parquet", ".pq"):
        out.write.mode("overwrite").parquet(str(path))
    elif kind == ".dta":
        pandas = df.toPandas()
        for c, t in df.dtypes:
            if t == "date":
                pandas[c] = pandas[c].astype("datetime64[ns]")
            elif t == "boolean":
                pandas[c] = pandas[c].astype("float64")
        pandas.to_stata(path, version=118, write_index=False)
    elif kind in EXCEL:
        df.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"no writer for {kind or 'a path without suffix'}")


def manifest_scan(spark: SparkSession, manifest: str) -> DataFrame:
    """The union of the files that a CSV of ``series_id, path`` lists, each with its series id.

    Relative paths begin at the manifest. The files' columns need not be the same.
    """
    folder = str(manifest).rsplit("/", 1)[0] if "/" in str(manifest) else "."
    rows = read_table(spark, manifest).select("series_id", "path").collect()  # one row per file
    frames = [read_table(spark, p if p.startswith("/") or "://" in p else f"{folder}/{p}").withColumn("series_id", F.lit(str(s))) for s, p in rows]
    if not frames:
        raise ValueError("the manifest lists no files")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def monthly_keys(rows: DataFrame, year: str, month: str, value: str) -> DataFrame:
    """``month_key`` (year * 100 + month) and value of a workbook's rows; the first of a repeated key stays.

    Rows need an ``row_number`` column with their order in the sheet.
    """
    key = (F.col(year).cast("int") * 100 + F.col(month).cast("int")).alias("month_key")
    known = rows.select(key, F.expr(f"try_cast(`{value}` as double)").alias("value"), "row_number").where("month_key is not null")
    first = F.row_number().over(W.partitionBy("month_key").orderBy("row_number"))
    return known.withColumn("r", first).where("r = 1").select("month_key", "value")
