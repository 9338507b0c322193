"""Feature selection: scores from few passes over the rows, rules over tables of features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import denan, pearson
from tempestry.operators.profile import LEAKS, correlations

# Kinds of features by parts of their names (prefixes end in *), first match wins.
KINDS = (
    ("weather_base", ("AWND", "PRCP", "TMAX", "TMIN", "WSF2", "WSF5")),
    ("weather_types", ("WT*",)),
    ("temporal", ("lag", "_3d_", "_7d_", "_14d_", "day_of_", "month", "year", "season")),
    ("extreme_indicators", ("extreme", "heavy", "damaging", "high_winds", "freezing", "heat_wave")),
    ("compound_risks", ("ice_storm", "wet_windy", "multiple_extremes", "thermal_stress", "mechanical_stress")),
    ("geographic", ("county", "fips", "state", "climate", "risk_profile")),
)
# Parts of names (any case) of the families within which correlated features are pruned.
FAMILIES = {
    "precip": ("prcp", "precip"),
    "wind": ("wsf", "awnd", "wind"),
    "temp": ("tmax", "tmin", "degree_day", "cooling", "heating", "thermal", "temp_"),
    "flags": ("wt", "heavy_rain", "extreme_rain", "heat_wave", "extreme_heat", "freezing", "extreme_cold", "high_winds", "damaging_winds", "moderate_winds", "strong_winds", "sustained_winds", "rapid_wind_increase", "freeze_thaw_cycle", "wet_period_indicator", "wet_windy_combo", "multiple_extremes", "winter_freeze", "summer_heat", "spring_storms", "ice_storm_risk", "heat_demand_stress", "weather_severity_score"),
}
# Columns never used as features.
EXCLUDED = ("num_out_per_day", "minutes_out", "customers_out", "customers_out_mean", "cust_minute_area", "pct_out_max", "pct_out_area", "pct_out_area_unified", "pct_out_area_covered", "pct_out_max_unified", "train_mask")


def candidates(df: DataFrame, target: str, exclude: tuple[str, ...] = EXCLUDED, strict: bool = True) -> list[str]:
    """Numeric and boolean columns that aren't the target or excluded, nor (strict) found by the leakage audit."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return [c for c, t in df.dtypes if t in kinds and c != target and c not in exclude and not (strict and any(p in c.lower() for p, _ in LEAKS))]


def by_family(columns: list[str]) -> dict[str, list[str]]:
    """The columns of each of FAMILIES (a column may be in several), families of fewer than two left out."""
    found = {k: [c for c in columns if any(p in c.lower() for p in ps)] for k, ps in FAMILIES.items()}
    return {k: cs for k, cs in found.items() if len(cs) > 1}


def mean_filled(df: DataFrame, features: list[str]) -> DataFrame:
    """features as doubles with missing values at their means (0.0 if a column has none), other columns as they are."""
    clean = {c: denan(F.col(c).cast("double")) for c in features}
    means = df.agg(*[F.avg(x).alias(c) for c, x in clean.items()]).first()
    return df.withColumns({c: F.coalesce(x, F.lit(means[c] if means[c] is not None else 0.0)) for c, x in clean.items()})


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, variance (population)."""
    one = df.agg(*[F.var_pop(denan(F.col(c).cast("double"))).alias(f"_{i}") for i, c in enumerate(features)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("variance")) for i, c in enumerate(features)])).alias("_x")).select("_x.*")


def variance_filter(df: DataFrame, features: list[str], over: float = 0.01) -> list[str]:
    """Features with a variance over the limit, in order."""
    v = {r["feature"]: r["variance"] for r in variances(df, features).collect()}
    return [f for f in features if v[f] is not None and v[f] > over]


def correlation_filter(df: DataFrame, features: list[str], over: float = 0.95) -> list[str]:
    """Features without an earlier one that |r| > over ties them to; an earlier one counts even if it goes itself."""
    r = {(x["a"], x["b"]): x["r"] for x in correlations(df, features).where(F.abs("r") > over).collect()}
    return [f for j, f in enumerate(features) if not any((e, f) in r for e in features[:j])]


def family_plan(df: DataFrame, families: dict[str, list[str]], at: float = 0.95) -> DataFrame:
    """family, feature, kept, because_of: within a family, in order, a feature not yet dropped is kept and drops those |r| >= at."""
    names = list(dict.fromkeys(c for cs in families.values() for c in cs))
    r = {(x["a"], x["b"]) for x in correlations(df, names).where(F.abs("r") >= at).collect()}
    rows = []
    for fam, cs in families.items():
        by: dict[str, str | None] = {}
        for c in cs:
            if c in by:
                continue
            by[c] = None
            for o in cs:
                if o not in by and ((c, o) in r or (o, c) in r):
                    by[o] = c
        rows += [(fam, c, b is None, b) for c, b in by.items()]
    return df.sparkSession.createDataFrame(rows, "family string, feature string, kept boolean, because_of string")


def anova_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, f, n: between-class over within-class variance, from counts, sums and squares per class; null where undefined."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), denan(F.col(f).cast("double")).alias("x")) for f in features])).alias("_x")
    long = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), pairs).select("y", "_x.feature", "_x.x").where("x is not null")
    g = long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, k = F.sum("n"), F.count(F.lit(1))
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    within = F.sum(F.col("n") * F.col("v"))
    s = g.groupBy("feature").agg(n.alias("n"), k.alias("k"), between.alias("b"), within.alias("w"))
    return s.select("feature", F.try_divide(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)), F.try_divide(F.col("w"), (F.col("n") - F.col("k")).cast("double"))).alias("f"), "n")


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, f, n: r2 / (1 - r2) (n - 2)."""
    y = denan(F.col(target).cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), denan(F.col(f).cast("double")).alias("x")) for f in features])).alias("_x")
    long = df.select(y.alias("y"), pairs).select("y", "_x.feature", "_x.x").where("x is not null and y is not null")
    g = long.groupBy("feature").agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n"))
    r2 = F.col("r") * F.col("r")
    return g.select("feature", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("f"), "n")


def mutual_information(df: DataFrame, features: dict[str, Column] | list[str], target: str, bins: int = 16) -> DataFrame:
    """feature, mi (nats) of the feature cut at its quantiles against the target's classes: an approximation of the nearest-neighbour
    estimate, bounded by the bins. features may be expressions, such as products. Nulls are left out."""
    cols = features if isinstance(features, dict) else {f: F.col(f) for f in features}
    clean = {f: denan(c.cast("double")) for f, c in cols.items()}
    q = df.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(f"_{i}") for i, c in enumerate(clean.values())]).first()
    binned = []
    for i, (f, c) in enumerate(clean.items()):
        b = reduce(lambda a, e: a + (c > e).cast("int"), sorted(set(q[f"_{i}"] or [])), F.lit(0))  # noqa: B023
        binned.append(F.struct(F.lit(f).alias("feature"), F.when(c.isNotNull(), b).alias("b")))
    long = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*binned)).alias("_x")).select("y", "_x.feature", "_x.b").where("b is not null")
    j = long.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *keys: F.sum("n").over(Window.partitionBy("feature", *keys))  # noqa: E731  (j has bins times classes rows a feature)
    x = j.select("feature", "n", total().alias("t"), total("b").alias("nb"), total("y").alias("ny"))
    return x.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def consensus(selections: DataFrame, least: int = 2) -> DataFrame:
    """feature, methods (count of distinct methods), from rows (method, feature); only with at least `least` methods."""
    return selections.groupBy("feature").agg(F.countDistinct("method").alias("methods")).where(F.col("methods") >= least)


def selections_of(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows (method, feature) of lists by method."""
    return df.sparkSession.createDataFrame([(m, f) for m, fs in chosen.items() for f in fs], "method string, feature string")


def categorise(feature: Column) -> Column:
    """The kind of a feature by KINDS, else other."""
    c = F.lit("other")
    for name, parts in reversed(KINDS):
        hit = [F.startswith(feature, F.lit(p[:-1])) if p.endswith("*") else F.contains(feature, F.lit(p)) for p in parts]
        c = F.when(reduce(lambda a, b: a | b, hit), name).otherwise(c)
    return c


def top_features(scores: DataFrame, by: str, k: int, absolute: bool = False) -> DataFrame:
    """The k features with the highest score (ties by name)."""
    v = F.abs(by) if absolute else F.col(by)
    return scores.where(F.col(by).isNotNull()).orderBy(v.desc(), "feature").limit(k)


def top_features_by_group(df: DataFrame, group: str, features: list[str], target: str, k: int, fewest: int = 3) -> DataFrame:
    """group, feature, r, n, rank_no: the k features of each group whose correlation with the target is strongest (ties: by name)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), denan(F.col(f).cast("double")).alias("x")) for f in features])).alias("_x")
    long = df.select(F.col(group), denan(F.col(target).cast("double")).alias("y"), pairs).select(group, "y", "_x.feature", "_x.x").where("x is not null and y is not null")
    g = long.groupBy(group, "feature").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r")).where((F.col("n") >= fewest) & F.col("r").isNotNull())
    w = Window.partitionBy(group).orderBy(F.abs("r").desc(), "feature")  # one row a feature
    return g.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k).select(group, "feature", "r", "n", "rank_no")
