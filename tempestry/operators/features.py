"""The catalogue of daily weather features, over one window specification.

All windows partition by the entity and order by day and count rows, not calendar days. Thresholds are in `Thresholds`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import days_since, flag, null_greatest, ordered, roll, roll_std, streak_parts


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the flags (mm, deg C, m/s)."""

    heavy_rain: float = 25.4
    extreme_rain: float = 76.2
    light_rain: float = 2.5
    wet_week: float = 50.0
    heat: float = 35.0
    extreme_heat: float = 40.0
    freeze: float = 0.0
    extreme_cold: float = -12.0
    high_wind: float = 17.9
    damaging_wind: float = 25.7
    moderate_wind: float = 8.9
    sustained_wind: float = 13.4
    wind_rise: float = 8.9
    base_temperature: float = 18.3
    demand_heat: float = 32.0
    demand_degrees: float = 10.0


# Lags per column, and (column, statistic, days) of the rolling features.
LAGS = {"PRCP": (1, 2, 3), "TMAX": (1, 2, 3), "TMIN": (1, 2, 3), "WSF2": (1, 2)}
ROLLING = (
    ("PRCP", "sum", (3, 7, 14)), ("PRCP", "max", (3, 7)),
    ("TMAX", "mean", (3, 7)), ("TMAX", "max", (7, 14)), ("TMIN", "mean", (3, 7)), ("TMIN", "min", (7, 14)),
    ("WSF2", "max", (3, 7)), ("WSF2", "mean", (7,)),
)
_STATISTICS = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}

#: Feature names by family, for selection and documentation.
GROUPS = {
    "raw": ["PRCP", "TMAX", "TMIN", "WSF2", "AWND", "WSF5"],
    "lag": [f"{c}_lag{k}d" for c, ks in LAGS.items() for k in ks],
    "rolling": [f"{c}_{n}d_{s}" for c, s, ns in ROLLING for n in ns],
    "extreme": ["heavy_rain", "extreme_rain", "heat_wave", "extreme_heat", "freezing", "extreme_cold", "high_winds", "damaging_winds"],
    "streak": ["consecutive_heat_days", "consecutive_freeze_days", "consecutive_rain_days"],
    "temperature": ["temp_range_daily", "temp_volatility_3d", "temp_change_1d", "heating_degree_days", "cooling_degree_days", "freeze_thaw_cycle"],
    "rain": ["light_rain", "moderate_rain", "days_since_rain", "wet_period_indicator", "precip_volatility_7d"],
    "wind": ["moderate_winds", "strong_winds", "sustained_winds_3d", "wind_acceleration_1d", "rapid_wind_increase"],
    "calendar": ["month", "day_of_year", "season", "winter_freeze", "summer_heat", "spring_storms"],
    "compound": ["ice_storm_risk", "wet_windy_combo", "heat_demand_stress", "multiple_extremes"],
    "stress": ["thermal_stress_index", "mechanical_stress_index", "weather_severity_score"],
}


_ROLLED = re.compile(r"^([A-Z0-9]+)_(\d+)d_(sum|max|min|mean)$")
_LAGGED = re.compile(r"^([A-Z0-9]+)_lag(\d+)d$")
_TEXT, _COUNTS = ("season",), ("days_since_rain", "month", "day_of_year", "multiple_extremes", "weather_severity_score")


def registry(spark: SparkSession) -> DataFrame:
    """What each feature of GROUPS is: feature, family, source (the column it is made of, where it is one), statistic, days (of its window or
    lag), kind (measure, flag, count or text). Made from the names, so it can't fall behind the catalogue."""
    rows = []
    for family, names in GROUPS.items():
        for f in names:
            roll, lag = _ROLLED.match(f), _LAGGED.match(f)
            source, statistic, days = (roll.group(1), roll.group(3), int(roll.group(2))) if roll else (lag.group(1), "lag", int(lag.group(2))) if lag else (f if family == "raw" else None, None, None)
            kind = "text" if f in _TEXT else "count" if f in _COUNTS or family == "streak" else "measure" if roll or lag or family in ("raw", "stress") or f.endswith(("_daily", "_3d", "_7d", "_1d", "_days")) and f != "sustained_winds_3d" else "flag"
            rows.append((f, family, source, statistic, days, kind))
    return spark.createDataFrame(rows, "feature string, family string, source string, statistic string, days int, kind string")


def season(month: Column) -> Column:
    """winter, spring, summer or fall by month."""
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isNotNull(), "fall")


def consecutive(df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column]) -> DataFrame:
    """df with a run counter per flag: 1, 2, ... while the condition holds, else 0. Two windows in the same partitioning."""
    w = ordered(keys, order)
    parts = {n: streak_parts(c, w) for n, c in flags.items()}
    df = df.withColumns({f"_f_{n}": p[0] for n, p in parts.items()} | {f"_c_{n}": p[1] for n, p in parts.items()})
    df = df.withColumns({f"_i_{n}": F.sum(f"_c_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in flags})
    run = lambda n: F.sum(f"_f_{n}").over(Window.partitionBy(*keys, f"_i_{n}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({n: run(n).cast("int") for n in flags})
    return df.drop(*[f"_{k}_{n}" for n in flags for k in "fci"])


def engineer(df: DataFrame, entity: str, day: str, t: Thresholds = Thresholds(), days_since_compat: bool = False) -> DataFrame:  # noqa: B008
    """df with all features of GROUPS.

    Missing base columns are added as nulls. Flags are 0 on null; degree days, ranges and stress indices are null if a part
    is. days_since_rain counts calendar days since the last row with rain, 999 before; with days_since_compat it is 0 once
    there has been rain. sustained_winds_3d looks at the day's wind alone and multiple_extremes means any extreme. Rows need
    one per entity and day; null entities form a group of their own; an empty table gives an empty one."""
    base = ["PRCP", "TMAX", "TMIN", "WSF2", "AWND", "WSF5"]
    df = df.withColumns({c: F.lit(None).cast("double") for c in base if c not in df.columns})
    c = {n: F.col(n) for n in base}
    prcp, tmax, tmin, wind = c["PRCP"], c["TMAX"], c["TMIN"], c["WSF2"]
    w = ordered([entity], [day])
    first = {f"{n}_lag{k}d": F.lag(n, k).over(w) for n, ks in LAGS.items() for k in ks}
    first |= {f"{n}_{d}d_{s}": roll(_STATISTICS[s], c[n], w, d) for n, s, ds in ROLLING for d in ds}
    first |= {
        "temp_volatility_3d": roll_std(tmax, w, 3),
        "precip_volatility_7d": roll_std(prcp, w, 7),
        "temp_change_1d": F.abs(tmax - F.lag(tmax).over(w)),
        "wind_acceleration_1d": wind - F.lag(wind).over(w),
        "days_since_rain": days_since(F.col(day), prcp > 0, w),
    }
    df = df.withColumns(first)
    df = consecutive(df, [entity], [day], {"consecutive_heat_days": tmax >= t.heat, "consecutive_freeze_days": tmin <= t.freeze, "consecutive_rain_days": prcp > 0})
    if days_since_compat:
        df = df.withColumn("days_since_rain", F.when(F.col("days_since_rain") == 999, 999).otherwise(0))
    month = F.month(day)
    df = df.withColumns({
        "heavy_rain": flag(prcp >= t.heavy_rain), "extreme_rain": flag(prcp >= t.extreme_rain),
        "heat_wave": flag(tmax >= t.heat), "extreme_heat": flag(tmax >= t.extreme_heat),
        "freezing": flag(tmin <= t.freeze), "extreme_cold": flag(tmin <= t.extreme_cold),
        "high_winds": flag(wind >= t.high_wind), "damaging_winds": flag(wind >= t.damaging_wind),
        "temp_range_daily": tmax - tmin,
        "heating_degree_days": null_greatest(F.lit(t.base_temperature) - tmax, F.lit(0.0)),
        "cooling_degree_days": null_greatest(tmax - t.base_temperature, F.lit(0.0)),
        "freeze_thaw_cycle": flag((tmin <= t.freeze) & (tmax > t.freeze)),
        "light_rain": flag((prcp > 0) & (prcp < t.light_rain)), "moderate_rain": flag((prcp >= t.light_rain) & (prcp < t.heavy_rain)),
        "wet_period_indicator": flag(F.col("PRCP_7d_sum") > t.wet_week),
        "moderate_winds": flag((wind >= t.moderate_wind) & (wind < t.high_wind)), "strong_winds": flag((wind >= t.high_wind) & (wind < t.damaging_wind)),
        "sustained_winds_3d": flag(wind > t.sustained_wind),
        "rapid_wind_increase": flag(F.col("wind_acceleration_1d") > t.wind_rise),
        "month": month, "day_of_year": F.dayofyear(day), "season": season(month),
        "ice_storm_risk": flag((tmin <= t.freeze) & (tmax > t.freeze) & (prcp > 0)),
        "wet_windy_combo": flag((prcp > 0) & (wind > t.sustained_wind)),
    })
    f = F.col
    df = df.withColumns({
        "winter_freeze": flag((f("season") == "winter") & (f("freezing") == 1)),
        "summer_heat": flag((f("season") == "summer") & (f("heat_wave") == 1)),
        "spring_storms": flag((f("season") == "spring") & (f("high_winds") == 1)),
        "heat_demand_stress": flag((tmax > t.demand_heat) & (f("cooling_degree_days") > t.demand_degrees)),
        "multiple_extremes": F.least(f("extreme_rain") + f("extreme_heat") + f("extreme_cold") + f("damaging_winds"), F.lit(1)),
        "thermal_stress_index": 0.3 * f("temp_range_daily") + 0.4 * f("temp_volatility_3d") + 0.1 * f("heating_degree_days") + 0.2 * f("cooling_degree_days"),
        "mechanical_stress_index": 0.5 * f("WSF2_7d_max") + 0.3 * F.abs("wind_acceleration_1d") + 0.2 * f("consecutive_rain_days"),
        "weather_severity_score": 3 * f("extreme_rain") + 4 * f("damaging_winds") + 2 * f("extreme_cold") + 2 * f("extreme_heat") + 5 * f("ice_storm_risk"),
    })
    return df
