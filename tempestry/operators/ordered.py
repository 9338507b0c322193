"""Order statistics without sorting a group in one task: running totals over value ranges, ranks, exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.session import cut


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with, for each (column -> name) of sums, the total of the column over the rows of the same keys up to and with this one.

    (keys, order) must be unique in df. Rows are range-partitioned by keys and order, so a key's rows may lie in many
    partitions; the result is checkpointed, since ranges are drawn from samples. Totals per partition and key are summed
    first (a few rows), and only rows within one partition are added one by one."""
    if not df.columns:
        return df
    by = [F.col(k) for k in keys] + [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    x = cut(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    totals = x.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{n}") for c, n in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums.values()])
    same = F.col("x.__part") == F.col("t.__part")
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}"))
    joined = x.alias("x").join(F.broadcast(totals.alias("t")) if not keys else totals.alias("t"), same).select("x.*", *[f"t.__{n}" for n in sums.values()])
    inside = Window.partitionBy(*keys, "__part").orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({n: F.col(f"__{n}") + F.sum(c).over(inside) for c, n in sums.items()}).drop("__part", *[f"__{n}" for n in sums.values()])


def value_counts_ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows), upto (rows of the keys with at most this value); nulls left out. Counted on the map side first."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(c, keys, [value], {"n": "upto"})


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with `name`, the rank of value within keys, ties sharing their mean rank; null for null values and null keys."""
    r = value_counts_ranked(df, keys, value).select(*keys, value, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))
    return df.join(r, [*keys, value], "left")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], name: str = "q") -> DataFrame:
    """keys and name, an array of the exact, linearly interpolated quantiles of value; keys without a value are left out.

    No task holds a group's values: they are counted, summed up over ranges, and each quantile takes the one or two values
    whose counts hold its position. A null key gives no row."""
    c = value_counts_ranked(df, keys, value)
    total = c.groupBy(*keys).agg(F.sum("n").alias("__total"))
    c = c.join(total, keys) if keys else c.crossJoin(F.broadcast(total))  # one row
    picks: list[Column] = []
    for i, p in enumerate(probabilities):
        at = (F.col("__total") - 1) * F.lit(float(p))
        for j, pos in enumerate((F.floor(at), F.ceil(at))):
            picks.append(F.min(F.when((F.col("upto") - F.col("n") <= pos) & (pos < F.col("upto")), F.col(value).cast("double"))).alias(f"__{i}_{j}"))
    g = c.groupBy(*keys, "__total").agg(*picks)
    share = lambda p: (F.col("__total") - 1) * F.lit(float(p)) - F.floor((F.col("__total") - 1) * F.lit(float(p)))
    return g.select(*keys, F.array(*[F.col(f"__{i}_0") + (F.col(f"__{i}_1") - F.col(f"__{i}_0")) * share(p) for i, p in enumerate(probabilities)]).alias(name))
