"""Joins of panels, dimensions, score tables and event windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.session import small


def left_merge_fill(left: DataFrame, right: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """left with right's columns by keys. Columns of right that left has too are dropped first; the integer columns of fill are 0
    where right has no row. right needs one row per key (see first_rows)."""
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in keys])
    out = left.join(right, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in fill})


def with_dimension(fact: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """fact with a dimension's columns; broadcast only while its estimated size is under the limit."""
    return fact.join(small(dim), keys, "left")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per keys by order (ties: by the remaining columns). An aggregate, so a hot key is combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def top_rows(df: DataFrame, keys: list[str], by: Column, ties: list[str], n: int) -> DataFrame:
    """The n rows per keys that are highest by `by` (ties: by the columns given, ascending), with their rank_no. A ranking filter, which
    Spark pushes below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), *ties)
    return df.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def score_star(tables: dict[str, DataFrame], key: str = "feature", value: str = "score") -> DataFrame:
    """One row per key with a column per method, null where a method has none: a union and one pivot instead of a chain of joins."""
    long = reduce(DataFrame.unionByName, [t.select(F.col(key).alias(key), F.lit(m).alias("_m"), F.col(value).cast("double").alias("_v")) for m, t in tables.items()])
    return long.groupBy(key).agg(*[F.max(F.when(F.col("_m") == m, F.col("_v"))).alias(m) for m in tables])


def map_lookup(code: Column, mapping: dict[str, str], default: str) -> Column:
    """mapping[code], else default."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), F.lit(default))


def event_days(df: DataFrame, entity: str, day: str, driver: str, quantile: float = 0.95, binary: bool = False, fewest: int = 3, most: int = 20) -> DataFrame:
    """entity, day of driver events: days at or above the entity's quantile (linear interpolation), or equal to 1 if binary; where these are
    fewer than `fewest`, the entity's highest days, min(most, max(1, rows // 30)) of them (ties: earlier first)."""
    group = Window.partitionBy(entity)
    hit = (F.col(driver) == 1) if binary else (F.col(driver) >= F.percentile(driver, quantile).over(group))
    x = df.select(entity, day, driver).withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("_n", F.count(F.lit(1)).over(group))
    x = x.withColumn("_hits", F.sum("_hit").over(group)).withColumn("_rank", F.row_number().over(group.orderBy(F.col(driver).desc_nulls_last(), F.col(day))))
    few = (F.col("_hits") < fewest) & (F.col("_rank") <= F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("_n") / 30)))) & F.col(driver).isNotNull()
    return x.where(((F.col("_hits") >= fewest) & (F.col("_hit") == 1)) | few).select(entity, day)


def event_window(df: DataFrame, events: DataFrame, entity: str, day: str, metrics: list[str], reach: int = 7) -> DataFrame:
    """The mean of each metric at lag -reach..reach days from events, and n, the event-days seen. Each event is exploded to its lags and
    joined by equality of (entity, date); days that aren't there are passed over."""
    lags = events.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"))
    x = lags.join(df, (F.col("_e") == df[entity]) & (F.date_add("_d", F.col("lag")) == df[day]))
    return x.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def calendar(df: DataFrame, entity: str, day: str) -> DataFrame:
    """entity and every calendar day from its first to its last."""
    span = df.groupBy(entity).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return span.select(entity, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
