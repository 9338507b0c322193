"""Profiles of a panel: each section is one result table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import bias_corrected_skew, denan, flag, pearson
from tempestry.operators.clean import _long, null_flags
from tempestry.operators.ordered import average_ranks, exact_quantiles
from tempestry.session import ship


def overview(df: DataFrame, entity: str, day: str) -> DataFrame:
    """One row: rows, columns, entities, first_day, last_day."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.countDistinct(entity).alias("entities"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """type, columns."""
    kinds = sorted({t for _, t in df.dtypes})
    rows = [(k, sum(t == k for _, t in df.dtypes)) for k in kinds]
    return df.sparkSession.createDataFrame(rows, "type string, columns int")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: duplicate_rows (beyond the first of whole rows), duplicate_keys (beyond the first per key)."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))
    k = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_keys"))
    return rows.crossJoin(F.broadcast(k))  # one row each


def coverage(df: DataFrame, entity: str, day: str, span: str = "own") -> DataFrame:
    """entity, first_day, last_day, days, expected, missing: expected days over the entity's own span or the whole table's."""
    x = df.groupBy(entity).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("days"))
    if span == "own":
        x = x.withColumn("expected", F.datediff("last_day", "first_day") + 1)
    else:
        one = df.agg((F.datediff(F.max(day), F.min(day)) + 1).alias("expected"))
        x = x.crossJoin(F.broadcast(one))  # one row
    return x.withColumn("missing", F.col("expected") - F.col("days"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n, share; null is a value."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))  # one row


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, sd, min, q25, q50, q75, max; NaN counts as missing."""
    long = _long(df, columns)
    x = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    x = x.join(F.broadcast(exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])), "column", "left")  # one row a column
    return x.select("column", "n", "mean", "sd", "min", *[F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "max")


def scalars(df: DataFrame, column: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: n, min, max, mean, sd and exact quantiles of a column."""
    v = df.select(denan(F.col(column).cast("double")).alias("value"))
    one = v.agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    q = exact_quantiles(v, [], "value", list(quantiles)).select(*[F.col("q")[i].alias(f"q{round(p * 1000):04d}") for i, p in enumerate(quantiles)])
    return one.join(F.broadcast(q), F.lit(True), "left")  # one row each


def distinct_counts(df: DataFrame, columns: list[str], with_null: bool = False) -> DataFrame:
    """column, distinct_values; with_null counts null as one value."""
    flags = null_flags(df)
    clean = {c: F.when(~flags[c], F.col(c)) for c in columns}
    one = df.agg(*[(F.countDistinct(clean[c]) + (F.max(flag(flags[c])) if with_null else F.lit(0))).cast("bigint").alias(f"_{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("distinct_values")) for i, c in enumerate(columns)])).alias("_x")).select("_x.*")


def near_constant(df: DataFrame, columns: list[str], share: float = 0.01) -> DataFrame:
    """column, distinct_values, kind: `constant` (at most one value) or `near` (fewer distinct values than share of the rows)."""
    d = distinct_counts(df, columns)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    kind = F.when(F.col("distinct_values") <= 1, "constant").when(F.col("distinct_values") < share * F.col("_n"), "near")
    return d.crossJoin(F.broadcast(n)).withColumn("kind", kind).where("kind is not null").drop("_n")  # one row


def skews(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, skew (bias-corrected; null without spread)."""
    return _long(df, columns).groupBy("column").agg(bias_corrected_skew(F.col("value")).alias("skew"))


def correlations(df: DataFrame, columns: list[str], few: int = 8) -> DataFrame:
    """a, b, r for each pair of columns in order, over rows that have both; null without spread.

    Up to `few` columns one aggregate of expressions does it. For more, whose pairs would make an expression too large to
    compile, each batch of rows gives the sums of all pairs by matrix products (values less their column's mean, so
    that nothing cancels), and one small aggregate adds them up: one row a pair and task is shuffled."""
    pairs = list(combinations(columns, 2))
    clean = df.select(*[denan(F.col(c).cast("double")).alias(c) for c in columns])
    if len(columns) <= few:
        one = clean.agg(*[pearson(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
        rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
        return one.select(F.explode(rows.cast("array<struct<a:string,b:string,r:double>>")).alias("_x")).select("_x.*")
    ship(df.sparkSession)
    means = [m or 0.0 for m in clean.agg(*[F.avg(c) for c in columns]).first()]
    k = len(columns)
    sums = "n sx sy sxx syy sxy".split()

    def add(batches):
        import numpy as np
        import pandas as pd

        i, j = np.triu_indices(k, 1)
        total = np.zeros((len(sums), len(i)))
        for pdf in batches:
            x = pdf.to_numpy(np.float64) - means
            m = (~np.isnan(x)).astype(np.float64)
            x = np.where(m > 0, x, 0.0)
            sx, sxx = x.T @ m, (x * x).T @ m
            total += np.stack([(m.T @ m)[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], (x.T @ x)[i, j]])
        yield pd.DataFrame({"i": i, "j": j} | dict(zip(sums, total, strict=True)))

    g = clean.mapInPandas(add, "i int, j int, " + ", ".join(f"{c} double" for c in sums)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    names, centre = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(float(m)) for m in means])
    spread = lambda xx, x: F.when(F.col("n") > 0, F.try_divide(F.col(xx), F.col("n")) - F.pow(F.try_divide(F.col(x), F.col("n")), F.lit(2.0)))
    vx, vy = spread("sxx", "sx"), spread("syy", "sy")
    tiny = lambda at: F.greatest(F.lit(1.0), F.pow(F.get(centre, F.col(at)), F.lit(2.0))) * 1e-20  # noqa: E731  (rounding, not spread)
    cov = F.try_divide(F.col("sxy"), F.col("n")) - F.try_divide(F.col("sx"), F.col("n")) * F.try_divide(F.col("sy"), F.col("n"))
    r = F.when((vx > tiny("i")) & (vy > tiny("j")), cov / F.sqrt(vx * vy))
    return g.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))


def high_pairs(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """Pairs with |r| >= least, strongest first."""
    return correlations(df, columns).where(F.abs("r") >= least).orderBy(F.abs("r").desc(), "a", "b")


def target_correlations(df: DataFrame, features: list[str], target: str, spearman: bool = False, fewest: int = 3) -> DataFrame:
    """feature, r, n with the target, over rows that have both (null for fewer than `fewest`)."""
    y = denan(F.col(target).cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), denan(F.col(f).cast("double")).alias("x")) for f in features])).alias("_x")
    long = df.select(y.alias("y"), pairs).select("_x.feature", "_x.x", "y").where("x is not null and y is not null")
    if spearman:
        long = average_ranks(average_ranks(long, ["feature"], "x", "rx"), ["feature"], "y", "ry").select("feature", F.col("rx").alias("x"), F.col("ry").alias("y"))
    g = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r"))
    return g.select("feature", F.when(F.col("n") >= fewest, F.col("r")).alias("r"), "n")


def rate_by(df: DataFrame, label: str, groups: dict[str, Column] | list) -> DataFrame:
    """rate of label = 1 and n per group; a null label counts as not 1."""
    keys = [c.alias(n) for n, c in groups.items()] if isinstance(groups, dict) else groups
    return df.groupBy(*keys).agg(F.avg(flag(F.col(label) == 1).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def threshold_sweep(df: DataFrame, column: str, thresholds: list[float], groups: list[str] | None = None) -> DataFrame:
    """group, threshold, prevalence of column >= threshold (null counts as below), n_over, n: one pass."""
    groups = groups or []
    aggs = [F.sum(flag(F.col(column) >= t)).alias(f"_{i}") for i, t in enumerate(thresholds)]
    one = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n_over")) for i, t in enumerate(thresholds)])).alias("_x")
    return one.select(*groups, "n", rows).select(*groups, "_x.threshold", "_x.n_over", "n", F.try_divide(F.col("_x.n_over").cast("double"), F.col("n").cast("double")).alias("prevalence"))


def cross_correlation(df: DataFrame, entity: str, day: str, driver: str, metric: str, lags: tuple[int, ...] = (-3, -2, -1, 0, 1, 2, 3), spearman: bool = False) -> DataFrame:
    """lag, r, n: the driver `lag` rows before against the metric (negative: after), by rows of one entity."""
    w = Window.partitionBy(entity).orderBy(day)
    x = df.select(F.col(metric).alias("_y"), *[F.lag(driver, k).over(w).alias(f"_{i}") for i, k in enumerate(lags)])
    long = x.select("_y", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{i}").alias("x")) for i, k in enumerate(lags)])).alias("_x")).select("_x.lag", F.col("_x.x").cast("double").alias("x"), F.col("_y").cast("double").alias("y")).where("x is not null and y is not null")
    if spearman:
        long = average_ranks(average_ranks(long, ["lag"], "x", "rx"), ["lag"], "y", "ry").select("lag", F.col("rx").alias("x"), F.col("ry").alias("y"))
    return long.groupBy("lag").agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: rows on which a rule's condition holds (null: doesn't)."""
    one = df.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{i}").alias("violations")) for i, r in enumerate(rules)])).alias("_x")).select("_x.*")


def outage_integrity(labelled: bool = False) -> dict[str, Column]:
    """The integrity rules of a daily outage table; labelled: also those on coverage and unified rates."""
    c = F.col
    more = {
        "pct_out_area_unified outside 0..1": ~c("pct_out_area_unified").between(0, 1),
        "pct_out_area_covered outside 0..1": ~c("pct_out_area_covered").between(0, 1),
        "minutes over the day at full coverage": (c("coverage") >= 1) & (c("minutes_out") > c("minutes_in_local_day")),
    }
    return (more if labelled else {}) | {
        "customers_out over total": c("customers_out") > c("customers_total"),
        "pct_out_max outside 0..1": ~c("pct_out_max").between(0, 1),
        "pct_out_area outside 0..1": ~c("pct_out_area").between(0, 1),
        "minutes without any_out": (c("minutes_out") > 0) & (c("any_out") == 0),
        "minutes over the day": c("minutes_out") > 1500,
    }


def flag_rules() -> dict[str, Column]:
    """What engineered flags imply of one another, as violations."""
    c = F.col
    return {
        "extreme_rain without heavy_rain": (c("extreme_rain") == 1) & (c("heavy_rain") == 0),
        "extreme_heat without heat_wave": (c("extreme_heat") == 1) & (c("heat_wave") == 0),
        "damaging_winds without high_winds": (c("damaging_winds") == 1) & (c("high_winds") == 0),
        "extreme_cold without freezing": (c("extreme_cold") == 1) & (c("freezing") == 0),
        "freeze_thaw_cycle without freezing": (c("freeze_thaw_cycle") == 1) & (c("freezing") == 0),
    }


def identical_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b of columns that agree on every row (nulls with nulls). Columns are first told apart by an order-free hash of (row, value) in one
    pass; only those of equal hash are then compared exactly, in a second pass."""
    row = F.xxhash64(*df.columns)
    sums = df.agg(*[F.sum(F.xxhash64(row, F.col(c).cast("double")).cast("decimal(20,0)")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    same = [(a, b) for (i, a), (j, b) in combinations(list(enumerate(columns)), 2) if sums[f"_{i}"] == sums[f"_{j}"]]
    spark = df.sparkSession
    if not same:
        return spark.createDataFrame([], "a string, b string")
    wrong = df.agg(*[F.count_if(~F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(f"_{i}") for i, (a, b) in enumerate(same)]).first()
    return spark.createDataFrame([p for i, p in enumerate(same) if wrong[f"_{i}"] == 0], "a string, b string")


def yearly_means(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """year and the mean of each column."""
    return df.groupBy(F.year(day).alias("year")).agg(*[F.avg(denan(F.col(c).cast("double"))).alias(c) for c in columns])


def yearly_drift(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """column, year, mean, drift (against the year before that has a mean)."""
    y = yearly_means(df, day, columns)
    long = y.select("year", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean")) for c in columns])).alias("_x")).select("_x.column", "year", "_x.mean")
    return long.withColumn("drift", F.col("mean") - F.lag("mean").over(Window.partitionBy("column").orderBy("year")))


def closest_to_half(df: DataFrame, entity: str, value: str, candidates: list[float]) -> DataFrame:
    """entity, threshold, ratio: of the candidates, the threshold at which the share of the entity's rows with value >= threshold is
    nearest to one half (ties: the lower); null values count as below. One pass over the rows."""
    sweep = threshold_sweep(df, value, candidates, [entity])
    best = F.min(F.struct(F.abs(F.lit(0.5) - F.col("prevalence")).alias("d"), "threshold", "prevalence")).alias("_b")
    return sweep.groupBy(entity).agg(best).select(entity, F.col("_b.threshold").alias("threshold"), F.col("_b.prevalence").alias("ratio"))


def years_of(df: DataFrame, day: str, most: int = 1_000) -> list[int]:
    """The years that occur, in order; over `most` raise."""
    years = sorted(r[0] for r in df.select(F.year(day).alias("y")).where("y is not null").distinct().limit(most + 1).collect())
    if len(years) > most:
        raise ValueError("more years than columns can be made of")
    return years


def prevalence_pivot(df: DataFrame, entity: str, day: str, label: str, years: list[int] | None = None) -> DataFrame:
    """entity and the rate of label = 1 per year of `years` (default: all that occur)."""
    years = years_of(df, day) if years is None else years
    y, f = F.year(day), flag(F.col(label) == 1).cast("double")
    return df.groupBy(entity).agg(*[F.avg(F.when(y == k, f)).alias(f"y{k}") for k in years])


def missing_long(df: DataFrame, entity: str, day: str, columns: list[str]) -> DataFrame:
    """entity, month (yyyy-MM), column, missing_share."""
    flags = null_flags(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), flag(flags[c]).cast("double").alias("m")) for c in columns])).alias("_x")
    x = df.select(entity, F.date_format(day, "yyyy-MM").alias("month"), pairs)
    return x.groupBy(entity, "month", F.col("_x.column").alias("column")).agg(F.avg("_x.m").alias("missing_share"))


def missing_calendar(df: DataFrame, entity: str, day: str, column: str, least_share: float = 0.005) -> DataFrame:
    """entity, month and d01..d31: 1 where the day is absent or the value missing, 0 where it is there, null beyond the month's end or
    the entity's span. Entities with less than least_share missing are left out."""
    from tempestry.operators.merge import calendar

    there = df.where(~null_flags(df)[column]).select(entity, day).distinct().withColumn("_there", F.lit(0))
    x = calendar(df, entity, day).join(there, [entity, day], "left").withColumn("_m", F.coalesce("_there", F.lit(1)))
    x = x.withColumn("_share", F.avg("_m").over(Window.partitionBy(entity))).where(F.col("_share") >= least_share)
    dom = F.dayofmonth(day)
    return x.groupBy(entity, F.date_format(day, "yyyy-MM").alias("month")).agg(*[F.max(F.when(dom == d, F.col("_m"))).alias(f"d{d:02d}") for d in range(1, 32)])


def expected_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """column, present."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in expected], "column string, present boolean")


# Fixed values as published: parts of column names that tell of the outcome or its measurement, with the reason; the first match wins.
LEAKS = (
    *((p, "Operational/measurement timing") for p in ("coverage", "minutes_observed", "snapshots_count", "minutes_in_local_day", "run_start_time_day", "snapshot_minutes")),
    *((p, "Target/derived-from-target") for p in ("pct_out_max", "pct_out_area", "pct_out_area_unified", "pct_out_area_covered", "pct_out_max_unified", "any_out", "minutes_out", "customers_out", "customers_out_mean", "cust_minute_area")),
    *((p, "Engineered/explicit target label") for p in ("label", "target", "outage_label", "y_", "_label", "_target")),
)


def leakage_audit(df: DataFrame) -> DataFrame:
    """column, reason for columns whose name tells of the outcome."""
    rows = [(c, next(r for p, r in LEAKS if p in c.lower())) for c in df.columns if any(p in c.lower() for p, _ in LEAKS)]
    return df.sparkSession.createDataFrame(rows, "column string, reason string")


def changed_by_capping(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column, min_before, max_before, min_after, max_after of columns whose ends moved."""
    ends = lambda d, s: _long(d, columns).groupBy("column").agg(F.min("value").alias(f"min_{s}"), F.max("value").alias(f"max_{s}"))
    x = ends(before, "before").join(ends(after, "after"), "column")
    return x.where(~(F.col("min_before").eqNullSafe(F.col("min_after")) & F.col("max_before").eqNullSafe(F.col("max_after"))))


def processing_summary(df: DataFrame, entity: str, flags: list[str], most: int = 10) -> DataFrame:
    """entity, records and the total of each of the first `most` flags."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(c) for c in flags[:most]])


def decompose(df: DataFrame, entity: str, day: str, value: str, period: int = 365, least: int = 400) -> DataFrame:
    """entity, day, observed, trend (centred mean over a period of rows, null at the ends), seasonal (median of the detrended values of
    that phase, centred), residual, for entities with at least `least` readings. Robust in that phases take medians; built-in
    windows in place of a loess fit."""
    g = Window.partitionBy(entity)
    w = g.orderBy(day)
    half = period // 2
    x = df.where(F.col(value).isNotNull()).select(entity, day, F.col(value).cast("double").alias("observed"))
    x = x.withColumn("_n", F.count(F.lit(1)).over(g)).where(F.col("_n") >= least)
    f = w.rowsBetween(-half, half)
    x = x.withColumns({"trend": F.when(F.count(F.lit(1)).over(f) == 2 * half + 1, F.avg("observed").over(f)), "_p": F.pmod(F.row_number().over(w) - 1, F.lit(period))})
    x = x.withColumn("_s", F.percentile(F.col("observed") - F.col("trend"), 0.5).over(Window.partitionBy(entity, "_p")))
    x = x.withColumn("seasonal", F.col("_s") - F.avg("_s").over(g))
    return x.select(entity, day, "observed", "trend", "seasonal", (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("residual"))


def size_estimate(df: DataFrame) -> DataFrame:
    """One row: the optimizer's estimate of the bytes of df."""
    from tempestry.session import estimated_bytes

    return df.sparkSession.createDataFrame([(estimated_bytes(df),)], "bytes bigint")


def class_balance(df: DataFrame, value: str, thresholds: list[float], eps: float = 1e-10) -> DataFrame:
    """threshold, none, minor, severe, min_share, share_sd, entropy, balance of the classes 0, (0, t), [t, inf); null counts as 0.
    entropy is normalised to 1; balance is the smallest share times (1 - share_sd) times entropy. One pass over the rows."""
    v = F.coalesce(denan(F.col(value).cast("double")), F.lit(0.0))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v <= 0).alias("none"), *[F.count_if((v >= t) & (v > 0)).alias(f"_{i}") for i, t in enumerate(thresholds)])
    x = one.select("n", "none", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("severe")) for i, t in enumerate(thresholds)])).alias("_x")).select("n", "none", "_x.threshold", "_x.severe")
    x = x.withColumn("minor", F.col("n") - F.col("none") - F.col("severe"))
    p = [F.try_divide(F.col(c).cast("double"), F.col("n")) for c in ("none", "minor", "severe")]
    mean = reduce(lambda a, b: a + b, p) / 3
    sd = F.sqrt(reduce(lambda a, b: a + b, [(q - mean) * (q - mean) for q in p]) / 2)
    entropy = reduce(lambda a, b: a + b, [-q * F.log(q + eps) for q in p]) / F.log(F.lit(3.0))
    x = x.withColumns({"min_share": F.least(*p), "share_sd": sd, "entropy": entropy})
    return x.withColumn("balance", F.col("min_share") * (1 - F.col("share_sd")) * F.col("entropy")).select("threshold", "none", "minor", "severe", "min_share", "share_sd", "entropy", "balance")


def best_threshold(balance: DataFrame) -> DataFrame:
    """The threshold with the highest balance, then the highest smallest share."""
    return balance.orderBy(F.desc("balance"), F.desc("min_share"), "threshold").limit(1)
