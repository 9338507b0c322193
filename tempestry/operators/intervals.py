"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _marked(df: DataFrame, entity: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """Usable intervals with _b (bucket of the start), _prev (running maximum of all earlier ends of the entity, in
    microseconds) and _new (1 where the interval starts beyond it).

    An entity isn't sorted in one task: intervals are cut into buckets by their start, each bucket gets the maximum end
    of all buckets before it (one row a bucket, aggregated before the shuffle), and only within a bucket is there a sort."""
    x = df.select(F.col(entity).alias("_e"), F.unix_micros(F.col(start).cast("timestamp")).alias("_s"), F.unix_micros(F.col(end).cast("timestamp")).alias("_t"))
    x = x.where(F.col("_e").isNotNull() & (F.col("_t") > F.col("_s"))).distinct()
    x = x.withColumn("_b", F.floor(F.col("_s") / (bucket_seconds * 1_000_000)).cast("bigint"))
    earlier = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = x.groupBy("_e", "_b").agg(F.max("_t").alias("_m")).select("_e", "_b", F.max("_m").over(earlier).alias("_carry"))
    x = x.join(carry, ["_e", "_b"])
    inside = Window.partitionBy("_e", "_b").orderBy("_s", "_t").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_prev", F.greatest(F.max("_t").over(inside), F.col("_carry")))
    return x.withColumn("_new", F.coalesce((F.col("_s") > F.col("_prev")).cast("int"), F.lit(1)))


def gaps(df: DataFrame, entity: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """The time between neighbouring continuous periods: entity, gap_start, gap_end (timestamps).

    Intervals with a null entity, start or end, or an end not after the start, are left out. Intervals that meet leave
    no gap. Repeats and ties change nothing; an entity of one period has no gap."""
    x = _marked(df, entity, start, end, bucket_seconds).where((F.col("_new") == 1) & F.col("_prev").isNotNull())
    return x.select(F.col("_e").alias(entity), F.timestamp_micros("_prev").alias("gap_start"), F.timestamp_micros("_s").alias("gap_end"))


def periods(df: DataFrame, entity: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """The continuous periods: entity, period_no (from 1 in time order), period_start, period_end, intervals (distinct
    ones merged). Rules as for gaps(). The label is the running count of new periods, again in two levels."""
    x = _marked(df, entity, start, end, bucket_seconds)
    counts = x.groupBy("_e", "_b").agg(F.sum("_new").alias("_c"))
    earlier = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_e", "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_e", "_b").orderBy("_s", "_t").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(counts, ["_e", "_b"]).withColumn("_label", F.col("_base") + F.sum("_new").over(inside))
    p = x.groupBy("_e", "_label").agg(F.min("_s").alias("_a"), F.max("_t").alias("_z"), F.count(F.lit(1)).alias("intervals"))
    return p.select(F.col("_e").alias(entity), F.col("_label").alias("period_no"), F.timestamp_micros("_a").alias("period_start"), F.timestamp_micros("_z").alias("period_end"), "intervals")
