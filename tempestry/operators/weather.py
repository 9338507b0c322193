"""Observations to daily panels: pivot, per-column aggregation rules, union of drifting files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions.columns import denan

# The datatypes of the daily summaries, and how stations are combined to a county-day.
DATATYPES = ("PRCP", "TMAX", "TMIN", "WSF2", "AWND", "WSF5", "WT01", "WT02", "WT03", "WT04", "WT05", "WT06", "WT08", "WT11")
SUMMED, AVERAGED = ("PRCP",), ("TMAX", "TMIN", "AWND")


def pivot_observations(obs: DataFrame, keys: list[str], datatype: str, value: str, order: str, datatypes: tuple[str, ...] = DATATYPES) -> DataFrame:
    """One row per keys with a column per datatype: the first non-null value by `order` (ties: the lower value).

    The column list is fixed, so there is no job for it. Other datatypes are left out; NaN counts as null."""
    x = denan(F.col(value).cast("double"))
    aggs = [F.min_by(F.when(F.col(datatype) == d, x), F.when((F.col(datatype) == d) & x.isNotNull(), F.struct(F.col(order), x))).alias(d) for d in datatypes]
    return obs.groupBy(*keys).agg(*aggs)


def aggregate_rule(name: str, c: Column) -> Column:
    """How one column goes from stations to a county-day: rain is added (0 if all null), temperatures and mean wind are averaged,
    gusts and weather types take the maximum."""
    if name in SUMMED:
        return F.coalesce(F.sum(c), F.lit(0.0))
    return F.avg(c) if name in AVERAGED else F.max(c)


def to_entity_day(wide: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Station rows to one row per keys by aggregate_rule, for the columns that are there."""
    there = [c for c in columns or DATATYPES if c in wide.columns]
    return wide.groupBy(*keys).agg(*[aggregate_rule(c, denan(F.col(c).cast("double"))).alias(c) for c in there])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Outer union by name: columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reporting_stations(obs: DataFrame, day: str, station: str) -> DataFrame:
    """Distinct stations per day."""
    return obs.groupBy(day).agg(F.countDistinct(station).alias("stations"))


def sum_against_mean(wide: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The total and the mean over stations side by side, as one aggregate (no join of two)."""
    c = denan(F.col(column).cast("double"))
    return wide.groupBy(*keys).agg(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{column}_sum"), F.avg(c).alias(f"{column}_mean"), F.count(c).alias("stations"))
