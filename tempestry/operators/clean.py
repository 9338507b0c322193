"""Imputation, capping, scaling and encoding: fitted to small tables, applied as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import denan, ffill, interpolate, ordered
from tempestry.operators.ordered import exact_quantiles, running_totals

NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, decimals included."""
    return [c for c, t in df.dtypes if (t in NUMBERS or t.startswith("decimal")) and c not in without]


def named(df: DataFrame, prefixes: tuple[str, ...] = (), contains: tuple[str, ...] = ()) -> list[str]:
    """Names that start with one of prefixes or contain one of contains (any case)."""
    return [c for c in df.columns if any(c.startswith(p) for p in prefixes) or any(p.lower() in c.lower() for p in contains)]


def _long(df: DataFrame, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """columns as rows (column, value double, NaN as null)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), denan(F.col(c).cast("double")).alias(value)) for c in columns])
    return df.select(F.explode(pairs.cast(f"array<struct<`{name}`:string,`{value}`:double>>")).alias("_x")).select("_x.*")


def null_flags(df: DataFrame) -> dict[str, Column]:
    """Per column the condition that it is missing (null, or NaN in floating columns)."""
    return {c: (F.col(c).isNull() | F.isnan(c)) if t in ("double", "float") else F.col(c).isNull() for c, t in df.dtypes}


def missingness(df: DataFrame) -> DataFrame:
    """column, missing, percent per column, in one pass over the rows."""
    flags = null_flags(df)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(x).alias(f"_{i}") for i, x in enumerate(flags.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(flags)])).alias("_x")
    return one.select("_n", rows).select("_x.column", "_x.missing", F.coalesce(F.try_divide(F.col("_x.missing") * 100.0, F.col("_n")), F.lit(0.0)).alias("percent"))


def missing_patterns(df: DataFrame, patterns: dict[str, tuple[list[str], str]]) -> DataFrame:
    """pattern, rows: how many rows have `all` or `any` of a pattern's columns missing; patterns without columns are left out."""
    flags = null_flags(df)
    used = {k: ([c for c in cs if c in flags], how) for k, (cs, how) in patterns.items()}
    used = {k: v for k, v in used.items() if v[0]}
    op = {"all": lambda a, b: a & b, "any": lambda a, b: a | b}
    one = df.agg(*[F.count_if(reduce(op[how], [flags[c] for c in cs])).alias(k) for k, (cs, how) in used.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(k).alias("rows")) for k in used])).alias("_x")).select("_x.*")


def fill_constant(df: DataFrame, columns: list[str], value) -> DataFrame:
    """Missing values of columns become value."""
    flags = null_flags(df)
    return df.withColumns({c: F.when(flags[c], F.lit(value)).otherwise(F.col(c)) for c in columns})


def fill_forward(df: DataFrame, columns: list[str], order: list[str], groups: list[str] | None = None) -> DataFrame:
    """The last value so far by order, within groups; leading missing values stay. Without groups the whole table is one
    group, sorted in one task: for small tables only."""
    w = ordered(groups or [], order) if groups else Window.orderBy(*order)
    return df.withColumns({c: ffill(denan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c), w) for c in columns})


def fill_linear(df: DataFrame, columns: list[str], order: list[str], groups: list[str]) -> DataFrame:
    """Linear interpolation by row position within groups; a trailing gap holds the last value, a leading one stays."""
    w = ordered(groups, order)
    x = df.withColumn("_rn", F.row_number().over(w))
    return x.withColumns({c: interpolate(denan(F.col(c).cast("double")), F.col("_rn"), w) for c in columns}).drop("_rn")


@dataclass
class Means:
    """Fitted means per group (or one row without groups), applied by a join."""

    columns: list[str]
    groups: list[str]
    table: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], groups: list[str] | None = None) -> Means:
        groups = groups or []
        return cls(columns, groups, df.groupBy(*groups).agg(*[F.avg(denan(F.col(c).cast("double"))).alias(f"_mean_{c}") for c in columns]))

    def transform(self, df: DataFrame) -> DataFrame:
        x = df.join(self.table, self.groups, "left") if self.groups else df.crossJoin(F.broadcast(self.table))  # one row
        flags = null_flags(df)
        return x.withColumns({c: F.when(flags[c], F.col(f"_mean_{c}")).otherwise(F.col(c)) for c in self.columns}).drop(*[f"_mean_{c}" for c in self.columns])


def mode_of(df: DataFrame, column: str) -> Column:
    """Aggregate: the most frequent non-null value, the smallest on ties."""
    return F.mode(F.col(column), True)


# The columns that each strategy of the standard plan takes, by name.
WIND = ("WSF2", "WSF5", "AWND")
META = ("customers_total", "minutes_in_local_day", "snapshot_minutes", "snapshots_count", "minutes_observed", "coverage", "train_mask")
SMOOTH = ("temp_range_daily", "temp_volatility_3d", "temp_change_1d", "heating_degree_days", "cooling_degree_days", "days_since_rain", "precip_volatility_7d", "wind_acceleration_1d")
STRESS = ("thermal_stress_index", "mechanical_stress_index", "weather_severity_score")


@dataclass
class MissingPlan:
    """The standard plan, by groups of columns: temperatures and their lags interpolated; winds, outage metadata and smooth features carried
    forward; features made of winds and stress indices to their entity's mean; then what is left: numbers (weather types, rain and its lags,
    flags, outage measures and all others) to 0, texts to their mode, booleans to false, and run_start_time_day to the day. fit keeps the entities' means (a table) and the modes (one row)."""

    entity: str
    order: str
    means: Means | None = None
    modes: dict[str, str] = field(default_factory=dict)

    def _split(self, df: DataFrame) -> dict[str, list[str]]:
        there = lambda names: [c for c in names if c in df.columns]
        return {
            "line": there(("TMAX", "TMIN")) + named(df, ("TMAX_lag", "TMIN_lag")),
            "carry": there((*WIND, *META, *SMOOTH)),
            "mean": named(df, (), ("WSF2_", "WSF5_", "AWND_")) + there(STRESS),
        }

    def fit(self, df: DataFrame) -> MissingPlan:
        cols = self._split(df)["mean"]
        texts = [c for c, t in df.dtypes if t == "string" and c != self.entity]
        row = df.agg(*[mode_of(df, c).alias(c) for c in texts]).first() if texts else None
        self.means = Means.fit(df, cols, [self.entity]) if cols else None
        self.modes = {c: row[c] for c in texts} if row else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        plan, types, columns = self._split(df), dict(df.dtypes), df.columns
        w = ordered([self.entity], [self.order])
        clean = lambda c: denan(F.col(c)) if types[c] in ("double", "float") else F.col(c)
        x = self.means.transform(df) if self.means else df
        x = x.withColumn("_rn", F.row_number().over(w)) if plan["line"] else x
        done = {c: interpolate(clean(c).cast("double"), F.col("_rn"), w) for c in plan["line"]} | {c: ffill(clean(c), w) for c in plan["carry"]}
        x = x.withColumns(done).drop("_rn")
        last = {}
        for c in columns:
            v = F.col(c) if c in done else clean(c)
            if types[c] in NUMBERS:
                v = F.coalesce(v, F.lit(0).cast(types[c]))
            elif types[c] == "boolean":
                v = F.coalesce(v, F.lit(False))
            elif types[c] == "string" and self.modes.get(c) is not None:
                v = F.coalesce(v, F.lit(self.modes[c]))
            elif c == "run_start_time_day" and types[c] == types[self.order]:
                v = F.coalesce(v, F.col(self.order))
            last[c] = v.alias(c)
        return x.select(*[last[c] for c in columns])


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, q1, q3 (exact, linearly interpolated); null where a column has no value."""
    q = exact_quantiles(_long(df, columns), ["column"], "value", [0.25, 0.75])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(q), "column", "left").select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))  # one row a column


def outlier_counts(df: DataFrame, columns: list[str], skip_flat: bool = False, k: float = 1.5) -> DataFrame:
    """column, q1, q3, low, high, outliers: values outside [q1 - k iqr, q3 + k iqr]; skip_flat leaves columns without spread out."""
    b = quartiles(df, columns).withColumns({"low": F.col("q1") - k * (F.col("q3") - F.col("q1")), "high": F.col("q3") + k * (F.col("q3") - F.col("q1"))})
    if skip_flat:
        b = b.where(F.col("q3") > F.col("q1"))
    x = _long(df, columns).join(F.broadcast(b), "column")  # one row a column
    return x.groupBy("column", "q1", "q3", "low", "high").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outliers"))


def cap_outliers(df: DataFrame, columns: list[str], k: float = 1.5, skip_binary: bool = False) -> DataFrame:
    """columns held within their fences; one quantile pass returns one row a column. A column whose quartiles agree collapses to
    one value; skip_binary leaves columns of 0 and 1 alone."""
    if skip_binary:
        seen = df.agg(*[F.count_if(~F.col(c).isin(0, 1)).alias(c) for c in columns]).first()
        columns = [c for c in columns if seen[c]]
    rows = {r["column"]: (r["q1"], r["q3"]) for r in quartiles(df, columns).collect()}
    out = {}
    for c in columns:
        q1, q3 = rows.get(c, (None, None))
        if q1 is not None:
            lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
            out[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi)))
    return df.withColumns(out) if out else df


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns less their mean over their sample deviation; null throughout where there is no spread."""
    s = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(s[f"m_{c}"]), F.lit(s[f"s_{c}"])) if s[f"s_{c}"] is not None else F.lit(None).cast("double") for c in columns})


def label_encode(df: DataFrame, column: str, out: str | None = None, missing: str = "nan") -> DataFrame:
    """df with the column's code: the rank of its text among the distinct texts, from 0; null counts as the text `missing`."""
    v = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    codes = running_totals(df.select(v.alias("_v")).distinct().withColumn("_one", F.lit(1)), [], ["_v"], {"_one": "_code"})
    return df.withColumn("_v", v).join(codes, "_v").withColumn(out or f"{column}_encoded", (F.col("_code") - 1).cast("int")).drop("_v", "_code", "_one")


def one_hot(df: DataFrame, column: str, drop_first: bool = True, most: int = 10) -> DataFrame:
    """df with a boolean column per value but the first in order; a null row is false in all. Over `most` values raise."""
    values = sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column).cast("string") == v, F.lit(False)) for v in values[1 if drop_first else 0 :]})


def encode_categories(df: DataFrame, columns: list[str], few: int = 10) -> DataFrame:
    """One-hot for columns of fewer than `few` values, codes for the rest; the columns themselves go."""
    n = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first() if columns else {}
    for c in columns:
        df = one_hot(df, c, most=few) if n[c] < few else label_encode(df, c)
    return df.drop(*columns)


def date_parts(df: DataFrame, day: str) -> DataFrame:
    """day as day_of_week (Monday 0), day_of_year, month, year."""
    return df.withColumns({"day_of_week": F.weekday(day), "day_of_year": F.dayofyear(day), "month": F.month(day), "year": F.year(day)}).drop(day)


def booleans_to_int(df: DataFrame) -> DataFrame:
    """Boolean columns as 0 and 1, null as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c, t in df.dtypes if t == "boolean"})


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value."""
    columns = columns or df.columns
    row = df.agg(*[(F.min(c).isNull() | (F.min(c) == F.max(c))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def features_and_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """features as doubles, missing as 0, and target; raises if one is not there."""
    lost = [c for c in [*features, target] if c not in df.columns]
    if lost:
        raise ValueError(f"columns not there: {lost}")
    return df.select(*[F.coalesce(denan(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features], target)


def check_same(before: DataFrame, after: DataFrame, target: str, classes: int = 2) -> None:
    """Raises if after lost rows, changed the target's distribution or has fewer than `classes` classes."""
    a, b = ({r[target]: r["count"] for r in d.groupBy(target).count().limit(1_000).collect()} for d in (before, after))
    if a != b:
        raise AssertionError(f"rows or target changed: {a} -> {b}")
    if len([k for k in b if k is not None]) < classes:
        raise AssertionError("too few classes")
