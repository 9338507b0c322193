"""The daily rollup and the sessions as streams; the expressions are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions.columns import flag


def snapshot_stream(spark, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Snapshots as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_stream(snaps: DataFrame, minutes: int, entity: str = "fips_code", ts: str = "ts", customers: str = "customers_out", late: str = "1 day") -> DataFrame:
    """Per entity and UTC day: any_out, minutes_out, customers_out, cust_minute_area. Rows later than `late` are dropped by the
    watermark, which also bounds the state."""
    c = F.col(customers)
    g = snaps.withWatermark(ts, late).groupBy(F.col(entity).alias("fips_code"), F.window(ts, "1 day"))
    return g.agg(F.max(flag(c > 0)).alias("any_out"), (F.lit(minutes) * F.count_if(c > 0)).alias("minutes_out"), F.max(c).alias("customers_out"), F.coalesce(F.sum(c * minutes), F.lit(0)).alias("cust_minute_area")).select("fips_code", F.to_date("window.start").alias("day"), "any_out", "minutes_out", "customers_out", "cust_minute_area")


def session_stream(snaps: DataFrame, entity: str = "fips_code", ts: str = "ts", customers: str = "customers_out", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events per entity: session_start, session_end (with the gap), snapshots, peak."""
    g = snaps.where(F.col(customers) > 0).withWatermark(ts, late).groupBy(F.col(entity).alias("fips_code"), F.session_window(ts, gap).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("snapshots"), F.max(customers).alias("peak")).select("fips_code", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "snapshots", "peak")
