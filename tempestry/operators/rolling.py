"""Totals and averages over trailing calendar periods, inactive days included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import denan

EPOCH = "1970-01-01"


def latest_rows(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row per keys: that with the latest `order` (rows tied on it count as identical; the largest is taken). A null
    order comes before all others: such a row counts only where there is no other.

    A plain aggregate, so rows are combined before the shuffle and a hot key can't fill one task."""
    picked = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(order), picked.alias("_p"))).alias("_r")).select(*keys, *[F.col("_r._p")[c].alias(c) for c in columns])


def trailing_totals(df: DataFrame, entity: str, day: str, measures: list[str], periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each entity and calendar day from its first to its last: the total and average of each measure over the
    last n calendar days, this one included, for n in periods.

    Columns: entity, day (date), active (whether the day has a row), measure (the day's own total), and per measure and
    period measure_total_nd and measure_avg_nd. Several rows of one day are added. Null and NaN add nothing; a day
    without a row counts as 0, so an average is the total over n, whatever is there. Nothing lies before an entity's
    first day. Rows with a null entity or day are left out; an empty table gives an empty one.

    One shuffle: daily totals are combined on the map side, calendar rows come from each row's distance to the next,
    and the frames are RANGE frames over day numbers. An entity's group is bounded by the calendar (36,525 rows in a
    hundred years), however many rows it delivers."""
    number = F.datediff(F.col(day).cast("date"), F.lit(EPOCH).cast("date"))
    daily = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("_e"), number.alias("_n"))
        .agg(*[F.coalesce(F.sum(denan(F.col(m).cast("double"))), F.lit(0.0)).alias(f"_m{i}") for i, m in enumerate(measures)])
    )
    # Window partitions by the entity alone, so ask for that distribution once.
    w = Window.partitionBy("_e").orderBy("_n")
    upto = F.coalesce(F.lead("_n").over(w) - 1, F.col("_n"))
    filled = daily.withColumn("_to", upto).select(
        "_e",
        F.explode(F.sequence("_n", "_to")).alias("_d"),
        "_n",
        *[f"_m{i}" for i in range(len(measures))],
    )
    on = F.col("_d") == F.col("_n")
    filled = filled.select("_e", "_d", on.alias("active"), *[F.when(on, F.col(f"_m{i}")).otherwise(0.0).alias(f"_m{i}") for i in range(len(measures))])
    out = [F.col("_e").alias(entity), F.date_add(F.lit(EPOCH).cast("date"), F.col("_d")).alias(day), F.col("active")]
    for i, m in enumerate(measures):
        out.append(F.col(f"_m{i}").alias(m))
        for n in periods:
            total = F.sum(f"_m{i}").over(Window.partitionBy("_e").orderBy("_d").rangeBetween(-(n - 1), 0))
            out += [total.alias(f"{m}_total_{n}d"), (total / n).alias(f"{m}_avg_{n}d")]
    return filled.select(*out)
