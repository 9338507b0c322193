"""Queries over the test tables for the operators of the weather and outage pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.operators import blockpivot, clean, features, merge, metrics, ml, outages, profile, rolling, select_features, timestamps, weather
from tempestry.plans.problems import _CELLS, _LATEST, _P3, rounded
from tempestry.session import small, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NUMBERS = ["AWND", "PRCP", "TMAX", "TMIN", "WSF2", "WSF5"]
TYPES = ["WT01", "WT02", "WT03", "WT04", "WT05", "WT06", "WT08", "WT11"]
ROWS = "OVER (PARTITION BY county_fips ORDER BY day)"


def query(sql: str | None = None):
    """Registers the query under its name; doubles are rounded to six places on both sides."""

    def add(f):
        def run(spark: SparkSession, root: str) -> DataFrame:
            df = f(spark, root)
            return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def frame(f: str, n: int) -> str:
    return f"{f} OVER (PARTITION BY county_fips ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


R = rounded
WX = "wx AS (SELECT county_fips, day, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in NUMBERS + TYPES) + f", climate_zone, year FROM {_LATEST})"
SNAP = f"""p3 AS ({_P3}),
snap AS (SELECT * FROM (SELECT p.snapshot_id, lpad(regexp_replace(upper(trim(o.fips_code)), '^FIPS\\s*:?\\s*|\\s+', '', 'g'), 5, '0') AS fips_code, p.utc_second, CAST(p.local_day AS DATE) AS local_day, o.customers_out, o.customers_total,
  row_number() OVER (PARTITION BY lpad(regexp_replace(upper(trim(o.fips_code)), '^FIPS\\s*:?\\s*|\\s+', '', 'g'), 5, '0'), p.utc_second ORDER BY p.snapshot_id) AS rn FROM p3 p JOIN outage_snapshots o USING (snapshot_id)) WHERE rn = 1)"""
MCC = "m AS (SELECT lpad(regexp_replace(regexp_replace(upper(county_fips), '\\s+', '', 'g'), '^FIPS:?', ''), 5, '0') AS fips_code, max(customers) AS customers_total FROM mcc WHERE regexp_matches(regexp_replace(regexp_replace(upper(county_fips), '\\s+', '', 'g'), '^FIPS:?', ''), '^[0-9]{1,5}$') GROUP BY 1)"
CADENCE = """gaps AS (SELECT (utc_second - lag(utc_second) OVER (PARTITION BY fips_code ORDER BY utc_second)) / 60.0 AS g FROM snap),
cad AS (SELECT c AS k FROM (SELECT unnest([5, 10, 15, 30, 60]) AS c), (SELECT quantile_cont(g, 0.5) AS med FROM gaps) ORDER BY abs(c - coalesce(med, 15)), c LIMIT 1)"""
SESSIONS = """pos AS (SELECT *, lag(utc_second) OVER w AS pt, lag(local_day) OVER w AS pd FROM snap WHERE customers_out > 0 WINDOW w AS (PARTITION BY fips_code ORDER BY utc_second)),
ev AS (SELECT *, sum(CASE WHEN pt IS NULL OR utc_second - pt > 1800 OR pd <> local_day THEN 1 ELSE 0 END) OVER (PARTITION BY fips_code ORDER BY utc_second ROWS UNBOUNDED PRECEDING) AS e FROM pos)"""
DAILY = f"""{SNAP}, {CADENCE}, {SESSIONS}, {MCC},
en AS (SELECT fips_code, local_day, count(DISTINCT e) AS num_out_per_day FROM ev GROUP BY 1, 2),
d0 AS (SELECT fips_code, local_day, max(CASE WHEN customers_out > 0 THEN 1 ELSE 0 END) AS any_out, (any_value(k) * count(*) FILTER (customers_out > 0))::BIGINT AS minutes_out,
  max(customers_out) AS customers_out, avg(customers_out) AS customers_out_mean, coalesce(sum(customers_out * k), 0)::BIGINT AS cust_minute_area FROM snap, cad GROUP BY 1, 2),
daily AS (SELECT d0.fips_code, d0.local_day AS run_start_time_day, any_out::INTEGER AS any_out, coalesce(num_out_per_day, 0)::BIGINT AS num_out_per_day, minutes_out, customers_out, customers_out_mean, cust_minute_area,
  CASE WHEN customers_total > 0 THEN customers_out::DOUBLE / customers_total END AS pct_out_max,
  CASE WHEN customers_total > 0 THEN cust_minute_area::DOUBLE / (customers_total * mins) END AS pct_out_area, customers_total, tz, mins
  FROM d0 LEFT JOIN en USING (fips_code, local_day) LEFT JOIN m USING (fips_code)
  LEFT JOIN (SELECT fips_code, tz FROM counties) c USING (fips_code),
  LATERAL (SELECT ((epoch(timezone(coalesce(tz, 'America/New_York'), (d0.local_day + 1)::TIMESTAMP)) - epoch(timezone(coalesce(tz, 'America/New_York'), d0.local_day::TIMESTAMP))) / 60)::INTEGER AS mins))"""
MERGED = "mg AS (SELECT w.*, coalesce(any_out, 0)::INTEGER AS any_out, coalesce(num_out_per_day, 0)::INTEGER AS num_out_per_day, minutes_out, customers_out, cust_minute_area, pct_out_max, pct_out_area, customers_total FROM wx w LEFT JOIN daily o ON o.fips_code = w.county_fips AND o.run_start_time_day = w.day)"


def wx(spark: SparkSession, root: str) -> DataFrame:
    """weather_features, the latest row of each county-day, NaN as null."""
    raw = table(spark, root, "weather_features").where(F.col("county_fips").isNotNull() & F.col("day").isNotNull())
    x = rolling.latest_rows(raw, ["county_fips", "day"], [*NUMBERS, *TYPES, "climate_zone", "year"], "loaded_at")
    return x.withColumns({c: C.denan(F.col(c)) for c in NUMBERS + TYPES})


def snaps(spark: SparkSession, root: str) -> DataFrame:
    """outage_snapshots at their instants, one per county and instant: that with the lowest id. Parsing the texts is most of the work and the
    rollup, the cadence and the sessions all start here, so the few columns they use are written once."""
    raw = table(spark, root, "outage_snapshots").select("snapshot_id", "feed_id", "fips_code", "run_start_time", "customers_out", "customers_total")
    x = timestamps.normalise_times(raw, "run_start_time", "feed_id", "fips_code", table(spark, root, "feeds"), table(spark, root, "counties")).where(F.col("time_status") == "ok")
    first = F.min_by(F.struct("local_day", "customers_out", "customers_total"), "snapshot_id")
    x = x.groupBy(C.fips5(F.col("fips_code")).alias("fips_code"), F.col("utc_second")).agg(F.min("snapshot_id").alias("snapshot_id"), first.alias("_r"))
    return written(x.select("snapshot_id", "fips_code", F.timestamp_seconds("utc_second").alias("ts"), "_r.*"))


def daily(spark: SparkSession, root: str) -> DataFrame:
    return outages.daily_outages(snaps(spark, root), table(spark, root, "counties"), table(spark, root, "mcc"))


def merged(spark: SparkSession, root: str) -> DataFrame:
    """The weather panel with each county-day's outages, flags and counts 0 where there are none."""
    out = daily(spark, root).withColumnsRenamed({"fips_code": "county_fips", "run_start_time_day": "day"})
    keep = ["county_fips", "day", "any_out", "num_out_per_day", "minutes_out", "customers_out", "cust_minute_area", "pct_out_max", "pct_out_area", "customers_total"]
    return merge.left_merge_fill(wx(spark, root), out.select(*keep), ["county_fips", "day"], ["any_out", "num_out_per_day"])


def w() -> Window:
    return C.ordered(["county_fips"], ["day"])


KEY = ["county_fips", "day"]

# ---- windows -----------------------------------------------------------------------------------------------------------


@query(f"WITH {WX} SELECT county_fips, day, " + ", ".join(R(f"lag({c}, {k}) {ROWS}", f"{c}_lag{k}d") for c, ks in features.LAGS.items() for k in ks) + " FROM wx")
def w01_lag(spark, root):
    return wx(spark, root).select(*KEY, *[F.lag(c, k).over(w()).alias(f"{c}_lag{k}d") for c, ks in features.LAGS.items() for k in ks])


@query(f"WITH {WX} SELECT county_fips, day, " + ", ".join(R(f"lag(TMAX, {k}) {ROWS}", f"k{k + 3}") for k in range(-3, 4)) + " FROM wx")
def w02_shift_both_ways(spark, root):
    return wx(spark, root).select(*KEY, *[F.lag("TMAX", k).over(w()).alias(f"k{k + 3}") for k in range(-3, 4)])


@query(f"WITH {WX} SELECT county_fips, day, " + ", ".join(R(frame(f"{dict(sum='sum', max='max', min='min', mean='avg')[s]}({c})", n), f"{c}_{n}d_{s}") for c, s, ns in features.ROLLING for n in ns) + " FROM wx")
def w04_rolling(spark, root):
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}
    return wx(spark, root).select(*KEY, *[C.roll(fn[s], F.col(c), w(), n).alias(f"{c}_{n}d_{s}") for c, s, ns in features.ROLLING for n in ns])


@query(f"WITH {WX} SELECT county_fips, day, {R(f'CASE WHEN ' + frame('count(TMAX)', 3) + ' = 3 THEN ' + frame('stddev_samp(TMAX)', 3) + ' END', 'sd3')}, {R('CASE WHEN ' + frame('count(PRCP)', 7) + ' = 7 THEN ' + frame('stddev_samp(PRCP)', 7) + ' END', 'sd7')} FROM wx")
def w05_rolling_std(spark, root):
    return wx(spark, root).select(*KEY, C.roll_std(F.col("TMAX"), w(), 3).alias("sd3"), C.roll_std(F.col("PRCP"), w(), 7).alias("sd7"))


@query(f"WITH {WX} SELECT county_fips, day, {R(f'WSF2 - lag(WSF2) {ROWS}', 'rise')}, {R(f'abs(TMAX - lag(TMAX) {ROWS})', 'step')} FROM wx")
def w06_diff(spark, root):
    return wx(spark, root).select(*KEY, (F.col("WSF2") - F.lag("WSF2").over(w())).alias("rise"), F.abs(F.col("TMAX") - F.lag("TMAX").over(w())).alias("step"))


def streak_sql(conditions: dict[str, str]) -> str:
    a = ", ".join(f"{flag(c)} AS f_{n}" for n, c in conditions.items())
    b = ", ".join(f"CASE WHEN f_{n} = lag(f_{n}) {ROWS} THEN 0 ELSE 1 END AS c_{n}" for n in conditions)
    i = ", ".join(f"sum(c_{n}) OVER (PARTITION BY county_fips ORDER BY day ROWS UNBOUNDED PRECEDING) AS i_{n}" for n in conditions)
    return f"s1 AS (SELECT *, {a} FROM wx), s2 AS (SELECT *, {b} FROM s1), s3 AS (SELECT *, {i} FROM s2)"


def streak_col(n: str) -> str:
    return f"(sum(f_{n}) OVER (PARTITION BY county_fips, i_{n} ORDER BY day ROWS UNBOUNDED PRECEDING))::INTEGER AS {n}"


STREAKS = {"consecutive_heat_days": "TMAX >= 35", "consecutive_freeze_days": "TMIN <= 0", "consecutive_rain_days": "PRCP > 0"}


@query(f"WITH {WX}, {streak_sql(STREAKS)} SELECT county_fips, day, {', '.join(map(streak_col, STREAKS))} FROM s3")
def w07_streak(spark, root):
    c = F.col
    x = features.consecutive(wx(spark, root), ["county_fips"], ["day"], {"consecutive_heat_days": c("TMAX") >= 35, "consecutive_freeze_days": c("TMIN") <= 0, "consecutive_rain_days": c("PRCP") > 0})
    return x.select(*KEY, *STREAKS)


@query(f"WITH {SNAP}, {SESSIONS} SELECT fips_code, local_day, min(utc_second)::BIGINT AS first_second, max(utc_second)::BIGINT AS last_second, count(*) AS snapshots, max(customers_out) AS peak FROM ev GROUP BY fips_code, local_day, e")
def w08_sessions(spark, root):
    s = outages.sessions(snaps(spark, root), "fips_code", "local_day", "ts", "customers_out")
    return s.select("fips_code", "local_day", F.unix_seconds("session_start").alias("first_second"), F.unix_seconds("session_end").alias("last_second"), "snapshots", "peak")


@query(f"WITH {WX}, e AS (SELECT *, last_value(CASE WHEN PRCP > 0 THEN day END IGNORE NULLS) OVER (PARTITION BY county_fips ORDER BY day ROWS UNBOUNDED PRECEDING) AS d FROM wx) SELECT county_fips, day, coalesce(day - d, 999)::INTEGER AS days_since_rain, CASE WHEN d IS NULL THEN 999 ELSE 0 END AS as_published FROM e")
def w10_days_since(spark, root):
    d = C.days_since(F.col("day"), F.col("PRCP") > 0, w())
    return wx(spark, root).select(*KEY, d.alias("days_since_rain"), F.when(d == 999, 999).otherwise(0).alias("as_published"))


def last_sql(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY county_fips ORDER BY day ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {WX} SELECT county_fips, day, {R(last_sql('WSF2'), 'WSF2')}, {R(last_sql('AWND'), 'AWND')} FROM wx")
def w11_ffill(spark, root):
    return clean.fill_forward(wx(spark, root), ["WSF2", "AWND"], ["day"], ["county_fips"]).select(*KEY, "WSF2", "AWND")


@query(f"""WITH {WX}, n AS (SELECT *, row_number() {ROWS} AS rn FROM wx), a AS (SELECT *, CASE WHEN TMAX IS NOT NULL THEN rn END AS pos FROM n),
b AS (SELECT *, {last_sql('TMAX')} AS px, {last_sql('pos')} AS p, first_value(TMAX IGNORE NULLS) OVER f AS nx, first_value(pos IGNORE NULLS) OVER f AS q FROM a WINDOW f AS (PARTITION BY county_fips ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT county_fips, day, {R('coalesce(TMAX, px + (nx - px) * ((rn - p)::DOUBLE / nullif(q - p, 0)), px)', 'TMAX')} FROM b""")
def w12_interpolate(spark, root):
    return clean.fill_linear(wx(spark, root), ["TMAX"], ["day"], ["county_fips"]).select(*KEY, "TMAX")


@query(f"WITH {WX} SELECT county_fips, day, {R('coalesce(TMAX, avg(TMAX) OVER (PARTITION BY county_fips))', 'TMAX')} FROM wx")
def w13_group_mean_fill(spark, root):
    x = wx(spark, root)
    return clean.Means.fit(x, ["TMAX"], ["county_fips"]).transform(x).select(*KEY, "TMAX")


@query(f"WITH {WX}, g AS (SELECT county_fips, year, sum(PRCP) AS p FROM wx GROUP BY 1, 2) SELECT county_fips, year, {R('p / nullif(sum(p) OVER (PARTITION BY county_fips), 0)', 'share')} FROM g")
def w14_share_of_total(spark, root):
    g = wx(spark, root).groupBy("county_fips", "year").agg(F.sum("PRCP").alias("p"))
    total = F.sum("p").over(Window.partitionBy("county_fips"))
    return g.select("county_fips", "year", F.when(total != 0, F.try_divide(F.col("p"), total)).alias("share"))


@query(f"WITH {WX}, t AS (SELECT county_fips, day, TMAX FROM wx WHERE TMAX IS NOT NULL) SELECT county_fips, day, {R('rank() OVER (PARTITION BY county_fips ORDER BY TMAX) + (count(*) OVER (PARTITION BY county_fips, TMAX) - 1) / 2.0::DOUBLE', 'rank_avg')} FROM t")
def w16_average_rank(spark, root):
    x = wx(spark, root).where(F.col("TMAX").isNotNull())
    return x.select(*KEY, C.average_rank(F.col("TMAX"), ["county_fips"], "rank_avg"))


EVENTS = f"""q AS (SELECT *, quantile_cont(PRCP, 0.95) OVER (PARTITION BY county_fips) AS q, count(*) OVER (PARTITION BY county_fips) AS n, row_number() OVER (PARTITION BY county_fips ORDER BY PRCP DESC NULLS LAST, day) AS rk FROM wx),
h AS (SELECT *, sum(CASE WHEN PRCP >= q THEN 1 ELSE 0 END) OVER (PARTITION BY county_fips) AS hits FROM q),
ed AS (SELECT county_fips, day FROM h WHERE (hits >= 3 AND PRCP >= q) OR (hits < 3 AND PRCP IS NOT NULL AND rk <= least(20, greatest(1, n // 30))))"""


@query(f"WITH {WX}, {EVENTS} SELECT * FROM ed")
def w18_event_days(spark, root):
    return merge.event_days(wx(spark, root), "county_fips", "day", "PRCP")


@query(f"WITH {WX}, s AS (SELECT county_fips, min(day) AS a, max(day) AS b FROM wx GROUP BY 1), c AS (SELECT county_fips, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT county_fips, day, {flag('wx.county_fips IS NULL')} AS absent FROM c LEFT JOIN wx USING (county_fips, day)".replace("wx.county_fips IS NULL", "there IS NULL").replace("LEFT JOIN wx USING", "LEFT JOIN (SELECT county_fips, day, 1 AS there FROM wx) x USING"))
def w20_calendar(spark, root):
    x = wx(spark, root)
    there = x.select(*KEY, F.lit(1).alias("there"))
    return merge.calendar(x, "county_fips", "day").join(there, KEY, "left").select(*KEY, F.when(F.col("there").isNull(), 1).otherwise(0).alias("absent"))


def catalogue_sql() -> str:
    agg = {"sum": "sum", "max": "max", "min": "min", "mean": "avg"}
    lags = ", ".join(f"lag({c}, {k}) {ROWS} AS {c}_lag{k}d" for c, ks in features.LAGS.items() for k in ks)
    rolls = ", ".join(frame(f"{agg[s]}({c})", n) + f" AS {c}_{n}d_{s}" for c, s, ns in features.ROLLING for n in ns)
    base = f"""k AS (SELECT *, {lags}, {rolls}, {', '.join(map(streak_col, STREAKS))},
      CASE WHEN {frame('count(TMAX)', 3)} = 3 THEN {frame('stddev_samp(TMAX)', 3)} END AS temp_volatility_3d, CASE WHEN {frame('count(PRCP)', 7)} = 7 THEN {frame('stddev_samp(PRCP)', 7)} END AS precip_volatility_7d,
      abs(TMAX - lag(TMAX) {ROWS}) AS temp_change_1d, WSF2 - lag(WSF2) {ROWS} AS wind_acceleration_1d, coalesce(day - {last_sql('CASE WHEN PRCP > 0 THEN day END')}, 999)::INTEGER AS days_since_rain FROM s3)"""
    flags = {
        "heavy_rain": "PRCP >= 25.4", "extreme_rain": "PRCP >= 76.2", "heat_wave": "TMAX >= 35", "extreme_heat": "TMAX >= 40", "freezing": "TMIN <= 0", "extreme_cold": "TMIN <= -12", "high_winds": "WSF2 >= 17.9", "damaging_winds": "WSF2 >= 25.7",
        "freeze_thaw_cycle": "TMIN <= 0 AND TMAX > 0", "light_rain": "PRCP > 0 AND PRCP < 2.5", "moderate_rain": "PRCP >= 2.5 AND PRCP < 25.4", "wet_period_indicator": "PRCP_7d_sum > 50", "moderate_winds": "WSF2 >= 8.9 AND WSF2 < 17.9", "strong_winds": "WSF2 >= 17.9 AND WSF2 < 25.7",
        "sustained_winds_3d": "WSF2 > 13.4", "rapid_wind_increase": "wind_acceleration_1d > 8.9", "ice_storm_risk": "TMIN <= 0 AND TMAX > 0 AND PRCP > 0", "wet_windy_combo": "PRCP > 0 AND WSF2 > 13.4", "heat_demand_stress": "TMAX > 32 AND TMAX - 18.3 > 10",
    }
    l2 = f"""l AS (SELECT *, TMAX - TMIN AS temp_range_daily, CASE WHEN TMAX IS NOT NULL THEN greatest(18.3 - TMAX, 0) END AS heating_degree_days, CASE WHEN TMAX IS NOT NULL THEN greatest(TMAX - 18.3, 0) END AS cooling_degree_days,
      {', '.join(f'{flag(c)} AS {n}' for n, c in flags.items())}, month(day)::INTEGER AS month, dayofyear(day)::INTEGER AS day_of_year, CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) <= 5 THEN 'spring' WHEN month(day) <= 8 THEN 'summer' ELSE 'fall' END AS season FROM k)"""
    o = f"""o AS (SELECT *, {flag("season = 'winter' AND freezing = 1")} AS winter_freeze, {flag("season = 'summer' AND heat_wave = 1")} AS summer_heat, {flag("season = 'spring' AND high_winds = 1")} AS spring_storms,
      least(extreme_rain + extreme_heat + extreme_cold + damaging_winds, 1)::INTEGER AS multiple_extremes, 0.3 * temp_range_daily + 0.4 * temp_volatility_3d + 0.1 * heating_degree_days + 0.2 * cooling_degree_days AS thermal_stress_index,
      0.5 * WSF2_7d_max + 0.3 * abs(wind_acceleration_1d) + 0.2 * consecutive_rain_days AS mechanical_stress_index, (3 * extreme_rain + 4 * damaging_winds + 2 * extreme_cold + 2 * extreme_heat + 5 * ice_storm_risk)::INTEGER AS weather_severity_score FROM l)"""
    whole = set(flags) | {"consecutive_heat_days", "consecutive_freeze_days", "consecutive_rain_days", "days_since_rain", "month", "day_of_year", "season", "winter_freeze", "summer_heat", "spring_storms", "multiple_extremes", "weather_severity_score"}
    cols = [c for g in features.GROUPS.values() for c in g]
    return f"WITH {WX}, {streak_sql(STREAKS)}, {base}, {l2}, {o} SELECT county_fips, day, " + ", ".join(c if c in whole else R(c, c) for c in cols) + " FROM o"


@query(catalogue_sql())
def g_feature_catalogue(spark, root):
    x = features.engineer(wx(spark, root), "county_fips", "day")
    return x.select(*KEY, *[c for g in features.GROUPS.values() for c in g])


# ---- outages -----------------------------------------------------------------------------------------------------------

DAILY_SQL = f"SELECT fips_code, run_start_time_day, any_out, num_out_per_day, minutes_out, customers_out, {R('customers_out_mean', 'customers_out_mean')}, cust_minute_area, {R('pct_out_max', 'pct_out_max')}, {R('pct_out_area', 'pct_out_area')} FROM daily"


@query(f"WITH {DAILY} {DAILY_SQL}")
def o_daily_outages(spark, root):
    return daily(spark, root).select(*outages.DAILY_COLUMNS)


@query("SELECT fips_code, day, ((epoch(timezone(tz, (day + 1)::TIMESTAMP)) - epoch(timezone(tz, day::TIMESTAMP))) / 60)::INTEGER AS minutes FROM counties, (SELECT CAST(unnest(generate_series(DATE '2019-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day)")
def o05_local_minutes(spark, root):
    days = F.explode(F.sequence(F.lit("2019-01-01").cast("date"), F.lit("2024-12-31").cast("date"), F.expr("interval 1 day"))).alias("day")
    return table(spark, root, "counties").select("fips_code", "tz", days).select("fips_code", "day", outages.minutes_of_day(F.col("day"), F.col("tz")).alias("minutes"))


@query(f"WITH {DAILY} {DAILY_SQL} WHERE year(run_start_time_day) = 2021")
def o06_year_guard(spark, root):
    return outages.daily_outages(snaps(spark, root), table(spark, root, "counties"), table(spark, root, "mcc"), year=2021).select(*outages.DAILY_COLUMNS)


@query(f"WITH {DAILY} SELECT fips_code, run_start_time_day, CASE WHEN num_out_per_day > 0 OR minutes_out > 0 OR customers_out > 0 OR cust_minute_area > 0 THEN 1 ELSE 0 END AS any_out FROM daily")
def o07_infer_any_out(spark, root):
    x = daily(spark, root).withColumn("any_out", F.lit(None).cast("int"))
    return outages.infer_any_out(x).select("fips_code", "run_start_time_day", "any_out")


GCD = "gc AS (SELECT c AS g FROM (SELECT unnest([5, 10, 15, 30, 60]) AS c), (SELECT list_reduce(list(DISTINCT minutes_out) FILTER (minutes_out > 0), lambda a, b: gcd(a, b)) AS v FROM daily) ORDER BY abs(c - coalesce(v, 15)), c LIMIT 1)"


@query(f"""WITH {DAILY}, {GCD}, l AS (SELECT *, minutes_out / g::DOUBLE AS snapshots_count FROM daily, gc), l2 AS (SELECT *, snapshots_count * g AS minutes_observed FROM l)
SELECT fips_code, run_start_time_day, mins AS minutes_in_local_day, g AS snapshot_minutes, {R('snapshots_count', 'snapshots_count')}, {R('minutes_observed', 'minutes_observed')}, {R('least(greatest(minutes_observed / mins, 0), 1)', 'coverage')},
{R('CASE WHEN customers_total > 0 THEN cust_minute_area::DOUBLE / (customers_total * mins) END', 'pct_out_area_unified')}, {R('CASE WHEN customers_total * minutes_observed > 0 THEN cust_minute_area / (customers_total * minutes_observed) END', 'pct_out_area_covered')},
{R('CASE WHEN customers_total > 0 THEN customers_out::DOUBLE / customers_total END', 'pct_out_max_unified')}, coalesce(customers_total > 0 AND minutes_observed / mins >= 0.8, false) AS train_mask FROM l2""")
def o10_labels(spark, root):
    return outages.labels(daily(spark, root)).select("fips_code", "run_start_time_day", "minutes_in_local_day", "snapshot_minutes", "snapshots_count", "minutes_observed", "coverage", "pct_out_area_unified", "pct_out_area_covered", "pct_out_max_unified", "train_mask")


@query(f"WITH {DAILY} SELECT (count(*) - count(DISTINCT (fips_code, run_start_time_day)))::BIGINT AS duplicate_keys, count_if(any_out NOT IN (0, 1))::BIGINT AS bad_any_out, count_if(coalesce(minutes_out, 0) % 15 <> 0)::BIGINT AS off_cadence, count_if(pct_out_max > 1)::BIGINT AS rate_over_one FROM daily")
def o12_checks(spark, root):
    return outages.rollup_checks(daily(spark, root))


@query(f"WITH {DAILY} {DAILY_SQL} ORDER BY 1, 2")
def u02_combine_years(spark, root):
    x = daily(spark, root).select(*outages.DAILY_COLUMNS)
    y = F.year("run_start_time_day")
    return outages.combine_years([x.where(y <= 2020), x.where(y.between(2020, 2022)), x.where(y >= 2022)])


@query(f"WITH {DAILY}, {GCD} SELECT g AS snapshot_minutes FROM gc")
def a17_gcd_cadence(spark, root):
    return outages.gcd_cadence(daily(spark, root))


@query(f"WITH {SNAP}, {CADENCE} SELECT k AS snapshot_minutes FROM cad")
def a18_median_cadence(spark, root):
    return outages.median_gap_cadence(snaps(spark, root), "fips_code", "ts")


# ---- observations ------------------------------------------------------------------------------------------------------


def station_day(spark, root):
    cells = blockpivot.weather_cells(table(spark, root, "weather_obs"), table(spark, root, "stations"))
    return blockpivot.wide_table(cells, ["station", "day"], "datatype", "number", list(weather.DATATYPES))


ONE = _CELLS + ", c AS (SELECT station, day, datatype, CASE WHEN min(x) = max(x) THEN min(x) END AS v FROM n GROUP BY 1, 2, 3), sd AS (SELECT station, day, " + ", ".join(f"max(CASE WHEN datatype = '{d}' THEN v END) AS {d}" for d in weather.DATATYPES) + " FROM c GROUP BY 1, 2)"


def rule_sql(d: str) -> str:
    f = f"coalesce(sum({d}), 0)" if d in weather.SUMMED else f"avg({d})" if d in weather.AVERAGED else f"max({d})"
    return R(f, d)


@query(ONE + " SELECT s.fips_code, sd.day, " + ", ".join(map(rule_sql, weather.DATATYPES)) + " FROM sd JOIN stations s ON s.id = sd.station GROUP BY 1, 2")
def a01_county_day(spark, root):
    x = station_day(spark, root).join(small(table(spark, root, "stations").select(F.col("id").alias("station"), "fips_code")), "station")
    return weather.to_entity_day(x.withColumn("day", F.date_format("day", "yyyy-MM-dd")), ["fips_code", "day"])


FIRST = _CELLS.replace("AS v FROM", "AS v, retrieved_at FROM").replace("SELECT station, day, datatype, coalesce", "SELECT station, CAST(day AS DATE) AS day, datatype, retrieved_at, coalesce")


@query(FIRST + ", r AS (SELECT *, row_number() OVER (PARTITION BY station, day, datatype ORDER BY x IS NULL, retrieved_at, x) AS k FROM n) SELECT station, day, " + ", ".join(f"max(CASE WHEN datatype = '{d}' AND k = 1 THEN x END) AS {d}" for d in weather.DATATYPES) + " FROM r GROUP BY 1, 2")
def r01_pivot_first(spark, root):
    cells = blockpivot.weather_cells(table(spark, root, "weather_obs"), table(spark, root, "stations"), ("retrieved_at",))
    return weather.pivot_observations(cells, ["station", "day"], "datatype", "number", "retrieved_at")


@query(ONE + " SELECT day, count(DISTINCT station) AS stations FROM sd GROUP BY 1")
def q25_reporting_stations(spark, root):
    return weather.reporting_stations(station_day(spark, root).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "day", "station")


@query(ONE + f" SELECT day, {R('coalesce(sum(PRCP), 0)', 'PRCP_sum')}, {R('avg(PRCP)', 'PRCP_mean')}, count(PRCP) AS stations FROM sd GROUP BY 1")
def q25_sum_against_mean(spark, root):
    return weather.sum_against_mean(station_day(spark, root).withColumn("day", F.date_format("day", "yyyy-MM-dd")), ["day"], "PRCP")


@query(f"WITH {WX} SELECT day, county_fips, {R('TMAX', 'TMAX')}, {R('TMIN', 'TMIN')}, {R('PRCP', 'PRCP')} FROM wx WHERE year = 2022 UNION ALL SELECT day, county_fips, {R('TMAX', 'TMAX')}, NULL, {R('PRCP', 'PRCP')} FROM wx WHERE year <> 2022")
def u01_union_by_name(spark, root):
    x = wx(spark, root).select("day", "county_fips", "TMAX", "TMIN", "PRCP")
    y = F.year("day")
    return weather.union_by_name([x.where(y == 2022), x.where(y != 2022).drop("TMIN")])


@query("SELECT fips_code, count(*) AS n, min(first_id) AS first_id FROM (SELECT fips_code, run_start_time, run_end_time, min(interval_id) AS first_id FROM outage_intervals GROUP BY ALL) GROUP BY 1")
def u03_first_of_repeats(spark, root):
    x = merge.first_rows(table(spark, root, "outage_intervals").select("fips_code", "run_start_time", "run_end_time", "interval_id", "customers_out"), ["fips_code", "run_start_time", "run_end_time"], ["interval_id"])
    return x.groupBy("fips_code").agg(F.count(F.lit(1)).alias("n"), F.min("interval_id").alias("first_id"))


@query("SELECT fips_code, 'both' AS side FROM (SELECT fips_code FROM stations INTERSECT SELECT fips_code FROM counties) UNION ALL SELECT fips_code, 'counties' FROM (SELECT fips_code FROM counties EXCEPT SELECT fips_code FROM stations)")
def u04_set_operations(spark, root):
    a, b = table(spark, root, "stations").select("fips_code"), table(spark, root, "counties").select("fips_code")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.subtract(a).withColumn("side", F.lit("counties")))


# ---- joins -------------------------------------------------------------------------------------------------------------


@query(f"WITH {WX}, {DAILY}, {MERGED} SELECT county_fips, day, {R('PRCP', 'PRCP')}, any_out, num_out_per_day, customers_out, {R('pct_out_max', 'pct_out_max')} FROM mg")
def j01_left_merge(spark, root):
    return merged(spark, root).select(*KEY, "PRCP", "any_out", "num_out_per_day", "customers_out", "pct_out_max")


@query(f"WITH {WX} SELECT w.county_fips, w.day, c.name, c.state, c.outage_risk_profile, c.population FROM wx w LEFT JOIN counties c ON c.fips_code = w.county_fips")
def j03_dimension(spark, root):
    dim = table(spark, root, "counties").select(F.col("fips_code").alias("county_fips"), "name", "state", "outage_risk_profile", "population")
    return merge.with_dimension(wx(spark, root), dim, ["county_fips"]).select(*KEY, "name", "state", "outage_risk_profile", "population")


@query("SELECT fips_code, name FROM counties WHERE contains(outage_risk_profile, 'storms')")
def d06_by_risk_profile(spark, root):
    return table(spark, root, "counties").where(F.contains("outage_risk_profile", F.lit("storms"))).select("fips_code", "name")


CORR = lambda a, b: f"CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) > 0 THEN (covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL), 0)) END"
FEATS = ["AWND", "PRCP", "TMAX", "TMIN", "WSF5"]


@query(f"WITH {WX}, s AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {CORR(f, 'WSF2')} AS pearson, var_pop({f}) AS variance FROM wx" for f in FEATS) + f") SELECT feature, {R('pearson', 'pearson')}, {R('variance', 'variance')} FROM s")
def j07_score_star(spark, root):
    x = wx(spark, root)
    p = profile.target_correlations(x, FEATS, "WSF2").select("feature", F.col("r").alias("score"))
    v = select_features.variances(x, FEATS).select("feature", F.col("variance").alias("score"))
    return merge.score_star({"pearson": p, "variance": v})


@query(f"WITH {WX}, {EVENTS}, l AS (SELECT county_fips, day, unnest(range(-7, 8)) AS lag FROM ed) SELECT lag::INTEGER AS lag, count(*) AS n, {R('avg(WSF2)', 'WSF2')}, {R('avg(TMAX)', 'TMAX')} FROM l JOIN wx ON wx.county_fips = l.county_fips AND wx.day = l.day + l.lag::INTEGER GROUP BY 1")
def j09_event_window(spark, root):
    x = wx(spark, root)
    return merge.event_window(x, merge.event_days(x, "county_fips", "day", "PRCP"), "county_fips", "day", ["WSF2", "TMAX"])


@query("SELECT snapshot_id, CASE CASE WHEN regexp_matches(c, '^[0-9]{1,5}$') THEN left(lpad(c, 5, '0'), 2) END WHEN '07' THEN 'America/New_York' WHEN '43' THEN 'America/Chicago' WHEN '10' THEN 'America/Denver' ELSE 'UTC' END AS zone FROM (SELECT snapshot_id, regexp_replace(regexp_replace(upper(fips_code), '\\s+', '', 'g'), '^FIPS:?', '') AS c FROM outage_snapshots)")
def j10_map_lookup(spark, root):
    m = {"07": "America/New_York", "43": "America/Chicago", "10": "America/Denver"}
    return table(spark, root, "outage_snapshots").select("snapshot_id", merge.map_lookup(F.left(C.fips5(F.col("fips_code")), F.lit(2)), m, "UTC").alias("zone"))


@query("SELECT county_fips, day, WSF2, rank_no::INTEGER AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY county_fips ORDER BY WSF2 DESC, day) AS rank_no FROM wx WHERE WSF2 IS NOT NULL) WHERE rank_no <= 5".join([f"WITH {WX} ", ""]))
def t04_top_per_group(spark, root):
    return merge.top_rows(wx(spark, root).where(F.col("WSF2").isNotNull()).select(*KEY, "WSF2"), ["county_fips"], F.col("WSF2"), ["day"], 5)


# ---- functions ---------------------------------------------------------------------------------------------------------


@query(r"SELECT id, lpad(fips_code, 5, '0') AS padded, right(id, 6) AS tail, lower(replace(name, ' ', '_')) AS low, contains(name, 'VANE') AS has, starts_with(id, 'GHCND') AS begins, CAST(regexp_extract(id, '(\d{2})', 1) AS INTEGER) AS two, try_cast(replace(elevationUnit, 'METERS', '1') AS DOUBLE) AS unit FROM stations")
def f01_strings(spark, root):
    c = F.col
    return table(spark, root, "stations").select("id", F.lpad("fips_code", 5, "0").alias("padded"), F.right(c("id"), F.lit(6)).alias("tail"), F.lower(F.replace(c("name"), F.lit(" "), F.lit("_"))).alias("low"), F.contains(c("name"), F.lit("VANE")).alias("has"), F.startswith(c("id"), F.lit("GHCND")).alias("begins"), F.regexp_extract("id", r"(\d{2})", 1).cast("int").alias("two"), F.replace(c("elevationUnit"), F.lit("METERS"), F.lit("1")).try_cast("double").alias("unit"))


@query(f"WITH {WX} SELECT county_fips, day, year(day)::INTEGER AS y, month(day)::INTEGER AS mo, dayofyear(day)::INTEGER AS doy, (isodow(day) - 1)::INTEGER AS dow, strftime(day, '%Y-%m') AS ym, (day + 7)::DATE AS next_week, (day - DATE '2022-01-01')::INTEGER AS age, make_date(year(day), month(day), 15) AS mid, CAST(make_date(year(day), 1, 1) + (dayofyear(day) - 1)::INTEGER AS DATE) AS again, date_trunc('month', day)::DATE AS first FROM wx")
def f09_dates(spark, root):
    d = F.col("day")
    return wx(spark, root).select(*KEY, F.year(d).alias("y"), F.month(d).alias("mo"), F.dayofyear(d).alias("doy"), F.weekday(d).alias("dow"), F.date_format(d, "yyyy-MM").alias("ym"), F.date_add(d, 7).alias("next_week"), F.datediff(d, F.lit("2022-01-01").cast("date")).alias("age"), F.make_date(F.year(d), F.month(d), F.lit(15)).alias("mid"), F.date_add(F.make_date(F.year(d), F.lit(1), F.lit(1)), F.dayofyear(d) - 1).alias("again"), F.trunc(d, "month").alias("first"))


@query(f"WITH {WX} SELECT county_fips, day, {R('abs(TMIN)', 'a')}, {R('sqrt(abs(TMAX))', 's')}, {R('ln(PRCP + 1)', 'l')}, {R('CASE WHEN TMAX IS NOT NULL THEN greatest(TMAX - 18.3, 0) END', 'm')}, {R('CASE WHEN WSF2 IS NOT NULL THEN least(greatest(WSF2, 5), 12) END', 'c')}, {flag('TMAX > 30')} AS f, {R('coalesce(AWND, WSF2, 0)', 'z')}, {R('CASE WHEN WSF2 > 0 THEN AWND / WSF2 END', 'ratio')} FROM wx WHERE PRCP > -1 OR PRCP IS NULL")
def f13_numbers(spark, root):
    c = F.col
    x = wx(spark, root).where((c("PRCP") > -1) | c("PRCP").isNull())
    return x.select(*KEY, F.abs("TMIN").alias("a"), F.sqrt(F.abs("TMAX")).alias("s"), F.log(c("PRCP") + 1).alias("l"), C.null_greatest(c("TMAX") - 18.3, F.lit(0.0)).alias("m"), C.clip(c("WSF2"), 5.0, 12.0).alias("c"), C.flag(c("TMAX") > 30).alias("f"), F.coalesce("AWND", "WSF2", F.lit(0.0)).alias("z"), C.safe_div(c("AWND"), c("WSF2")).alias("ratio"))


@query(f"WITH {WX} SELECT county_fips, day, CASE WHEN WT01 IS NULL AND WT02 IS NULL AND WT03 IS NULL THEN 1 ELSE 0 END AS all_null, CASE WHEN AWND IS NULL OR WSF2 IS NULL OR WSF5 IS NULL THEN 1 ELSE 0 END AS any_null, county_fips IN ('07001', '43001') AS in_counties, TMAX BETWEEN -20 AND 45 AS in_range FROM wx")
def p12_row_predicates(spark, root):
    x = wx(spark, root)
    null = lambda c: F.col(c).isNull()
    return x.select(*KEY, C.flag(null("WT01") & null("WT02") & null("WT03")).alias("all_null"), C.flag(null("AWND") | null("WSF2") | null("WSF5")).alias("any_null"), F.col("county_fips").isin("07001", "43001").alias("in_counties"), F.col("TMAX").between(-20, 45).alias("in_range"))


@query(f"WITH {WX} SELECT county_fips, day, TMAX FROM wx WHERE TMAX IS NOT NULL ORDER BY abs(TMAX - 20) DESC, county_fips, day LIMIT 10")
def t02_farthest(spark, root):
    return wx(spark, root).where(F.col("TMAX").isNotNull()).select(*KEY, "TMAX").orderBy(F.abs(F.col("TMAX") - 20).desc(), *KEY).limit(10)


@query(f"WITH {WX} SELECT * FROM (SELECT county_fips, day, unnest(['TMAX', 'TMIN', 'PRCP']) AS \"column\", {'unnest([TMAX, TMIN, PRCP])'} AS value FROM wx)")
def r03_unpivot(spark, root):
    return wx(spark, root).unpivot(KEY, ["TMAX", "TMIN", "PRCP"], "column", "value")


@query(f"WITH {WX} SELECT county_fips, " + ", ".join(R(f"avg(TMAX) FILTER (month(day) = {k})", f"m{k}") for k in range(1, 13)) + " FROM wx GROUP BY 1")
def r02_pivot_months(spark, root):
    m = F.month("day")
    return wx(spark, root).groupBy("county_fips").agg(*[F.avg(F.when(m == k, F.col("TMAX"))).alias(f"m{k}") for k in range(1, 13)])


# ---- aggregates and profiles --------------------------------------------------------------------------------------------


def union_sql(names: list[str], body: str) -> str:
    return " UNION ALL ".join(body.replace("{c}", n) for n in names)


@query(f"WITH {WX} SELECT count(TMAX) AS n, {R('min(TMAX)', 'min')}, {R('max(TMAX)', 'max')}, {R('avg(TMAX)', 'mean')}, {R('stddev_samp(TMAX)', 'sd')}, {R('quantile_cont(TMAX, 0.5)', 'q0500')}, {R('quantile_cont(TMAX, 0.9)', 'q0900')}, {R('quantile_cont(TMAX, 0.99)', 'q0990')} FROM wx")
def a08_scalars(spark, root):
    return profile.scalars(wx(spark, root), "TMAX")


@query(f"WITH {WX} " + union_sql(NUMBERS, f"SELECT '{{c}}' AS \"column\", count({{c}}) AS n, {R('avg({c})', 'mean')}, {R('stddev_samp({c})', 'sd')}, {R('min({c})', 'min')}, {R('quantile_cont({c}, 0.25)', 'q25')}, {R('quantile_cont({c}, 0.5)', 'q50')}, {R('quantile_cont({c}, 0.75)', 'q75')}, {R('max({c})', 'max')} FROM wx"))
def a09_describe(spark, root):
    return profile.describe(wx(spark, root), NUMBERS)


@query(f"WITH {WX} SELECT climate_zone, count(*) AS n, {R('count(*) / (SELECT count(*) FROM wx)::DOUBLE', 'share')} FROM wx GROUP BY 1")
def a10_value_counts(spark, root):
    return profile.value_counts(wx(spark, root), "climate_zone")


ALL = ["county_fips", "day", *NUMBERS, *TYPES, "climate_zone", "year"]


@query(f"WITH {WX} " + union_sql(ALL, f"SELECT '{{c}}' AS \"column\", count(*) - count({{c}}) AS missing, {R('(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 'percent')} FROM wx"))
def a11_missingness(spark, root):
    return clean.missingness(wx(spark, root).select(*ALL))


@query(f"WITH {WX} " + union_sql(ALL, "SELECT '{c}' AS \"column\", (count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)::BIGINT AS distinct_values FROM wx"))
def a12_distinct(spark, root):
    return profile.distinct_counts(wx(spark, root).select(*ALL), ALL, with_null=True)


@query(f"WITH {WX} " + union_sql(NUMBERS, f"SELECT '{{c}}' AS \"column\", {R('skewness({c})', 'skew')} FROM wx"))
def a13_skew(spark, root):
    return profile.skews(wx(spark, root), NUMBERS)


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(f"WITH {WX} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(CORR(a, b), 'r')} FROM wx" for a, b in PAIRS))
def a14_correlations(spark, root):
    return profile.correlations(wx(spark, root), NUMBERS)


def spearman_sql(f: str, y: str) -> str:
    rk = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT '{f}' AS feature, {R('corr(a, b)', 'r')}, count(*) AS n FROM (SELECT {rk(f)} AS a, {rk(y)} AS b FROM wx WHERE {f} IS NOT NULL AND {y} IS NOT NULL)"


@query(f"WITH {WX} " + " UNION ALL ".join(spearman_sql(f, "WSF2") for f in FEATS))
def a15_spearman(spark, root):
    return profile.target_correlations(wx(spark, root), FEATS, "WSF2", spearman=True)


@query(f"WITH {WX}, k AS (SELECT county_fips, climate_zone, count(*) AS n FROM wx WHERE climate_zone IS NOT NULL GROUP BY 1, 2) SELECT county_fips, climate_zone FROM (SELECT *, row_number() OVER (PARTITION BY county_fips ORDER BY n DESC, climate_zone) AS r FROM k) WHERE r = 1")
def a16_mode(spark, root):
    x = wx(spark, root)
    return x.groupBy("county_fips").agg(clean.mode_of(x, "climate_zone").alias("climate_zone")).where("climate_zone is not null")


LEVELS = [5.0, 10.0, 15.0, 20.0]


def sweep_sql(source: str, column: str, levels: list[float], groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    return " UNION ALL ".join(f"SELECT {g}{t}::DOUBLE AS threshold, coalesce(count_if({column} >= {t}), 0)::BIGINT AS n_over, count(*) AS n, {R(f'coalesce(count_if({column} >= {t}), 0) / count(*)::DOUBLE', 'prevalence')} FROM {source}{by}" for t in levels)


@query(f"WITH {WX} {sweep_sql('wx', 'WSF2', LEVELS)}")
def a19_threshold_sweep(spark, root):
    return profile.threshold_sweep(wx(spark, root), "WSF2", LEVELS)


@query(f"WITH {WX}, k AS (SELECT climate_zone, count(*) AS n FROM wx WHERE climate_zone IS NOT NULL GROUP BY 1) SELECT climate_zone, n, {R('sum(n) OVER () / (count(*) OVER () * n)', 'weight')} FROM k")
def a20_class_weights(spark, root):
    return ml.class_weights(wx(spark, root), "climate_zone")


BAL = ", ".join(f"({t}::DOUBLE)" for t in LEVELS)
BALANCE = f"""bal AS (SELECT t AS threshold, count_if(coalesce(PRCP, 0) <= 0)::BIGINT AS "none", count_if(PRCP > 0 AND PRCP < t)::BIGINT AS minor, count_if(PRCP >= t AND PRCP > 0)::BIGINT AS severe, count(*)::DOUBLE AS n FROM wx, (VALUES {BAL}) v(t) GROUP BY t),
b2 AS (SELECT *, "none" / n AS p, minor / n AS q, severe / n AS s FROM bal), b3 AS (SELECT *, least(p, q, s) AS min_share, sqrt((pow(p - 1/3.0::DOUBLE, 2) + pow(q - 1/3.0::DOUBLE, 2) + pow(s - 1/3.0::DOUBLE, 2)) / 2) AS share_sd, -(p * ln(p + 1e-10) + q * ln(q + 1e-10) + s * ln(s + 1e-10)) / ln(3.0::DOUBLE) AS entropy FROM b2)"""
BALANCE_COLS = f"threshold, \"none\", minor, severe, {R('min_share', 'min_share')}, {R('share_sd', 'share_sd')}, {R('entropy', 'entropy')}, {R('min_share * (1 - share_sd) * entropy', 'balance')}"


@query(f"WITH {WX}, {BALANCE} SELECT {BALANCE_COLS} FROM b3")
def a21_class_balance(spark, root):
    return profile.class_balance(wx(spark, root), "PRCP", LEVELS)


@query(f"WITH {WX}, {BALANCE} SELECT {BALANCE_COLS} FROM b3 ORDER BY min_share * (1 - share_sd) * entropy DESC, b3.min_share DESC, threshold LIMIT 1")
def t05_best_threshold(spark, root):
    return profile.best_threshold(profile.class_balance(wx(spark, root), "PRCP", LEVELS))


@query("SELECT (count(*) - count(DISTINCT (day, county_fips, AWND, PRCP, TMAX, TMIN, WSF2, WSF5, climate_zone, loaded_at)))::BIGINT AS duplicate_rows, (count(*) - count(DISTINCT (county_fips, day)))::BIGINT AS duplicate_keys FROM weather_features")
def a24_duplicates(spark, root):
    x = table(spark, root, "weather_features").select("day", "county_fips", "AWND", "PRCP", "TMAX", "TMIN", "WSF2", "WSF5", "climate_zone", "loaded_at")
    return profile.duplicates(x, ["county_fips", "day"])


@query(f"WITH {WX} SELECT count(*) AS rows, 6 AS columns, count(DISTINCT county_fips) AS entities, min(day) AS first_day, max(day) AS last_day FROM wx")
def q01_overview(spark, root):
    return profile.overview(wx(spark, root).select(*KEY, *NUMBERS[:4]), "county_fips", "day")


@query(f"WITH {WX} SELECT county_fips, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, (max(day) - min(day) + 1)::INTEGER AS expected, (max(day) - min(day) + 1 - count(DISTINCT day))::BIGINT AS missing FROM wx GROUP BY 1")
def q05_coverage(spark, root):
    return profile.coverage(wx(spark, root), "county_fips", "day")


@query(f"WITH {WX}, t AS (SELECT max(day) - min(day) + 1 AS e FROM wx) SELECT county_fips, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, any_value(e)::INTEGER AS expected, (any_value(e) - count(DISTINCT day))::BIGINT AS missing FROM wx, t GROUP BY 1")
def q05_coverage_global(spark, root):
    return profile.coverage(wx(spark, root), "county_fips", "day", span="global")


@query(f"WITH {WX}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {CORR(a, b)} AS r FROM wx" for a, b in PAIRS) + f") SELECT a, b, {R('r', 'r')} FROM c WHERE abs(r) >= 0.5")
def q08_high_pairs(spark, root):
    return profile.high_pairs(wx(spark, root), NUMBERS, 0.5)


@query(f"WITH {WX} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {R(CORR(f, 'WSF2'), 'r')}, count(*) FILTER ({f} IS NOT NULL AND WSF2 IS NOT NULL) AS n FROM wx" for f in FEATS))
def q09_target_correlations(spark, root):
    return profile.target_correlations(wx(spark, root), FEATS, "WSF2")


@query(f"WITH {WX}, d AS ({union_sql(NUMBERS + TYPES, 'SELECT {q}{c}{q} AS col, count(DISTINCT {c}) AS distinct_values, count(*) AS n FROM wx'.replace('{q}', chr(39)))}) SELECT col AS \"column\", distinct_values, CASE WHEN distinct_values <= 1 THEN 'constant' ELSE 'near' END AS kind FROM d WHERE distinct_values <= 1 OR distinct_values < 0.01 * n")
def q10_near_constant(spark, root):
    return profile.near_constant(wx(spark, root), NUMBERS + TYPES)


@query(f"WITH {WX}, {DAILY}, {MERGED} SELECT county_fips, strftime(day, '%Y-%m') AS month, {R('avg(CASE WHEN any_out = 1 THEN 1.0 ELSE 0.0 END)', 'rate')}, count(*) AS n FROM mg GROUP BY 1, 2")
def q13_rate_county_month(spark, root):
    return profile.rate_by(merged(spark, root), "any_out", {"county_fips": F.col("county_fips"), "month": F.date_format("day", "yyyy-MM")})


XC = lambda k: f"SELECT {k} AS lag, {R(CORR('x', 'y'), 'r')}, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n FROM (SELECT lag(PRCP, {k}) {ROWS} AS x, WSF2 AS y FROM wx)"


@query(f"WITH {WX} " + " UNION ALL ".join(XC(k) for k in range(-3, 4)))
def q15_cross_correlation(spark, root):
    return profile.cross_correlation(wx(spark, root), "county_fips", "day", "PRCP", "WSF2")


@query(f"WITH {DAILY} SELECT 'customers_out over total' AS rule, count_if(customers_out > customers_total)::BIGINT AS violations FROM daily UNION ALL SELECT 'pct_out_max outside 0..1', count_if(NOT pct_out_max BETWEEN 0 AND 1)::BIGINT FROM daily UNION ALL SELECT 'pct_out_area outside 0..1', count_if(NOT pct_out_area BETWEEN 0 AND 1)::BIGINT FROM daily UNION ALL SELECT 'minutes without any_out', count_if(minutes_out > 0 AND any_out = 0)::BIGINT FROM daily UNION ALL SELECT 'minutes over the day', count_if(minutes_out > 1500)::BIGINT FROM daily")
def q16_integrity(spark, root):
    return profile.violations(daily(spark, root), profile.outage_integrity())


@query(f"WITH {WX}, d AS (SELECT TMAX AS a, TMAX + 0 AS b, TMIN AS c, coalesce(PRCP, 0) AS d, coalesce(PRCP, 0) AS e FROM wx) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM d HAVING count_if({a} IS DISTINCT FROM {b}) = 0" for a, b in [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "c"), ("b", "d"), ("b", "e"), ("c", "d"), ("c", "e"), ("d", "e")]))
def q17_identical_columns(spark, root):
    c = F.col
    x = wx(spark, root).select(c("TMAX").alias("a"), (c("TMAX") + 0).alias("b"), c("TMIN").alias("c"), F.coalesce("PRCP", F.lit(0.0)).alias("d"), F.coalesce("PRCP", F.lit(0.0)).alias("e"))
    return profile.identical_columns(x, ["a", "b", "c", "d", "e"])


@query(f"WITH {WX}, y AS (SELECT year(day)::INTEGER AS year, {', '.join(f'avg({c}) AS {c}' for c in NUMBERS)} FROM wx GROUP BY 1), l AS ({union_sql(NUMBERS, 'SELECT {q}{c}{q} AS col, year, {c} AS mean FROM y'.replace('{q}', chr(39)))}) SELECT col AS \"column\", year, {R('mean', 'mean')}, {R('mean - lag(mean) OVER (PARTITION BY col ORDER BY year)', 'drift')} FROM l")
def q18_yearly_drift(spark, root):
    return profile.yearly_drift(wx(spark, root), "day", NUMBERS)


@query(f"WITH {WX}, {DAILY}, {MERGED} SELECT county_fips, year(day)::INTEGER AS year, {R('avg(CASE WHEN any_out = 1 THEN 1.0 ELSE 0.0 END)', 'rate')} FROM mg GROUP BY 1, 2")
def q18_prevalence_by_year(spark, root):
    x = merged(spark, root)
    years = profile.years_of(wx(spark, root), "day")
    wide = profile.prevalence_pivot(x, "county_fips", "day", "any_out", years)
    long = wide.unpivot("county_fips", [f"y{y}" for y in years], "year", "rate").where("rate is not null")
    return long.select("county_fips", F.substring("year", 2, 4).cast("int").alias("year"), "rate")


@query("SELECT unnest(['extreme_rain without heavy_rain', 'extreme_heat without heat_wave', 'damaging_winds without high_winds', 'extreme_cold without freezing', 'freeze_thaw_cycle without freezing']) AS rule, 0::BIGINT AS violations")
def q19_flag_rules(spark, root):
    return profile.violations(features.engineer(wx(spark, root), "county_fips", "day"), profile.flag_rules())


@query(f"WITH {WX} " + union_sql(NUMBERS, f"SELECT county_fips, strftime(day, '%Y-%m') AS month, '{{c}}' AS \"column\", {R('avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_share')} FROM wx GROUP BY 1, 2"))
def q20_missing_long(spark, root):
    return profile.missing_long(wx(spark, root), "county_fips", "day", NUMBERS)


@query(f"WITH {WX}, {DAILY}, {MERGED} SELECT county_fips, year(day)::INTEGER AS year, {R('avg(CASE WHEN any_out = 1 THEN 1.0 ELSE 0.0 END)', 'rate')}, count(*) AS n FROM mg GROUP BY 1, 2")
def q21_folds(spark, root):
    return profile.rate_by(merged(spark, root), "any_out", {"county_fips": F.col("county_fips"), "year": F.year("day")})


SEVERE = [0.0001, 0.001, 0.01]


@query(f"WITH {WX}, {DAILY}, {MERGED}, g AS (SELECT *, year(day)::INTEGER AS y FROM mg) {sweep_sql('g', 'pct_out_max', SEVERE, 'county_fips, y')}")
def q22_severity_by_year(spark, root):
    x = merged(spark, root).withColumn("y", F.year("day"))
    return profile.threshold_sweep(x, "pct_out_max", SEVERE, ["county_fips", "y"])


@query(f"WITH {WX}, {DAILY}, {MERGED}, b AS (SELECT county_fips, year(day)::INTEGER AS year, count(*) AS n, avg(CASE WHEN any_out = 1 THEN 1.0 ELSE 0.0 END) AS p FROM mg GROUP BY 1, 2) SELECT county_fips, year, n, {R('p', 'prevalence')}, {R('greatest(p, 1 - p)', 'majority_accuracy')}, 0.5::DOUBLE AS auroc, {R('p', 'auprc')} FROM b")
def e16_baselines(spark, root):
    return metrics.baselines(merged(spark, root).withColumn("year", F.year("day")), "any_out", ["county_fips", "year"])


@query(None)
def q23_decomposition(spark, root):
    return profile.decompose(wx(spark, root), "county_fips", "day", "TMAX", period=365, least=300)


@query(f"""WITH {WX}, s AS (SELECT county_fips, min(day) AS a, max(day) AS b FROM wx GROUP BY 1), c AS (SELECT county_fips, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
m AS (SELECT c.county_fips, c.day, CASE WHEN x.AWND IS NULL THEN 1 ELSE 0 END AS m FROM c LEFT JOIN wx x ON x.county_fips = c.county_fips AND x.day = c.day), n AS (SELECT *, avg(m) OVER (PARTITION BY county_fips) AS sh FROM m)
SELECT county_fips, strftime(day, '%Y-%m') AS month, {', '.join(f'max(CASE WHEN day(day) = {d} THEN m END)::INTEGER AS d{d:02d}' for d in range(1, 32))} FROM n WHERE sh >= 0.005 GROUP BY 1, 2""")
def q28_missing_calendar(spark, root):
    return profile.missing_calendar(wx(spark, root), "county_fips", "day", "AWND")


@query(None)
def q29_family_plan(spark, root):
    x = features.engineer(wx(spark, root), "county_fips", "day")
    names = [c for k in ("raw", "rolling", "temperature") for c in features.GROUPS[k]]
    return select_features.family_plan(x, select_features.by_family(names), 0.9)


@query("SELECT unnest(['run_start_time_day', 'any_out', 'minutes_out', 'customers_out', 'customers_out_mean', 'cust_minute_area', 'pct_out_max', 'pct_out_area']) AS \"column\", unnest(['Operational/measurement timing', 'Target/derived-from-target', 'Target/derived-from-target', 'Target/derived-from-target', 'Target/derived-from-target', 'Target/derived-from-target', 'Target/derived-from-target', 'Target/derived-from-target']) AS reason")
def q30_leakage_audit(spark, root):
    return profile.leakage_audit(daily(spark, root).select(*outages.DAILY_COLUMNS))


@query(None)
def q31_mutual_information(spark, root):
    x = merged(spark, root)
    c = F.col
    med = {f: F.col(f) for f in ("WSF2", "PRCP", "TMAX", "AWND")}
    return select_features.mutual_information(x, med | {"WSF2*PRCP": c("WSF2") * c("PRCP")}, "any_out")


@query(f"WITH {WX} SELECT county_fips, count(*) AS records, count_if(PRCP >= 25.4)::BIGINT AS heavy_rain, count_if(TMAX >= 35)::BIGINT AS heat_wave, count_if(WSF2 >= 17.9)::BIGINT AS high_winds FROM wx GROUP BY 1")
def q26_processing_summary(spark, root):
    x = features.engineer(wx(spark, root), "county_fips", "day")
    return profile.processing_summary(x, "county_fips", ["heavy_rain", "heat_wave", "high_winds"])


# ---- cleaning ----------------------------------------------------------------------------------------------------------

QUART = union_sql(NUMBERS, "SELECT {q}{c}{q} AS col, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM wx".replace("{q}", "'"))
COUNTS = union_sql(NUMBERS, "SELECT {q}{c}{q} AS \"column\", {R1}, {R2}, {R3}, {R4}, count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers FROM wx, qq WHERE col = {q}{c}{q} GROUP BY q1, q3".replace("{q}", "'").replace("{R1}", R("q1", "q1")).replace("{R2}", R("q3", "q3")).replace("{R3}", R("q1 - 1.5 * (q3 - q1)", "low")).replace("{R4}", R("q3 + 1.5 * (q3 - q1)", "high")))


@query(f"WITH {WX}, qq AS ({QUART}) {COUNTS}")
def i07_outlier_counts(spark, root):
    return clean.outlier_counts(wx(spark, root), NUMBERS)


@query(f"WITH {WX}, b AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS l{c}, quantile_cont({c}, 0.75) AS h{c}' for c in NUMBERS)} FROM wx) SELECT county_fips, day, " + ", ".join(R(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, l{c} - 1.5 * (h{c} - l{c})), h{c} + 1.5 * (h{c} - l{c})) END", c) for c in NUMBERS) + " FROM wx, b")
def i08_cap_outliers(spark, root):
    return clean.cap_outliers(wx(spark, root), NUMBERS).select(*KEY, *NUMBERS)


@query(f"WITH {WX} SELECT county_fips, day, " + ", ".join(R(f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)", c) for c in NUMBERS) + " FROM wx")
def i09_zscore(spark, root):
    return clean.zscore(wx(spark, root), NUMBERS).select(*KEY, *NUMBERS)


@query(f"WITH {WX} SELECT county_fips, day, (dense_rank() OVER (ORDER BY coalesce(climate_zone, 'nan')) - 1)::INTEGER AS climate_zone_encoded FROM wx")
def i10_label_encode(spark, root):
    return clean.label_encode(wx(spark, root), "climate_zone").select(*KEY, "climate_zone_encoded")


@query("WITH s AS (SELECT id, name, CASE WHEN elevation < 150 THEN 'low' WHEN elevation < 400 THEN 'mid' WHEN elevation IS NOT NULL THEN 'top' END AS band FROM stations) SELECT id, coalesce(band = 'mid', false) AS band_mid, coalesce(band = 'top', false) AS band_top FROM s")
def i11_one_hot(spark, root):
    e = F.col("elevation")
    x = table(spark, root, "stations").select("id", F.when(e < 150, "low").when(e < 400, "mid").when(e.isNotNull(), "top").alias("band"))
    return clean.one_hot(x, "band").drop("band")


@query(f"WITH {WX} SELECT county_fips, (isodow(day) - 1)::INTEGER AS day_of_week, dayofyear(day)::INTEGER AS day_of_year, month(day)::INTEGER AS month, year(day)::INTEGER AS year FROM wx")
def i12_date_parts(spark, root):
    return clean.date_parts(wx(spark, root).select("county_fips", "day"), "day")


@query(f"""WITH {WX}, n AS (SELECT *, row_number() {ROWS} AS rn FROM wx), a AS (SELECT *, CASE WHEN TMAX IS NOT NULL THEN rn END AS pos, CASE WHEN TMIN IS NOT NULL THEN rn END AS bt FROM n),
b AS (SELECT *, {last_sql('TMAX')} AS px, {last_sql('pos')} AS p, first_value(TMAX IGNORE NULLS) OVER f AS nx, first_value(pos IGNORE NULLS) OVER f AS q, {last_sql('TMIN')} AS py, {last_sql('bt')} AS pb, first_value(TMIN IGNORE NULLS) OVER f AS ny, first_value(bt IGNORE NULLS) OVER f AS qb FROM a WINDOW f AS (PARTITION BY county_fips ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT county_fips, day, {R('coalesce(PRCP, 0)', 'PRCP')}, {R('coalesce(TMAX, px + (nx - px) * ((rn - p)::DOUBLE / nullif(q - p, 0)), px, 0)', 'TMAX')}, {R('coalesce(TMIN, py + (ny - py) * ((rn - pb)::DOUBLE / nullif(qb - pb, 0)), py, 0)', 'TMIN')}, {R(f'coalesce({last_sql("WSF2")}, 0)', 'WSF2')}, {R(f'coalesce({last_sql("AWND")}, 0)', 'AWND')}, {R('coalesce(WT01, 0)', 'WT01')} FROM b""")
def i06_missing_plan(spark, root):
    x = wx(spark, root).select(*KEY, "PRCP", "TMAX", "TMIN", "WSF2", "AWND", "WT01")
    return clean.MissingPlan("county_fips", "day").fit(x).transform(x)


@query(f"WITH {WX} SELECT 'all weather types' AS pattern, count_if({' AND '.join(f'{c} IS NULL' for c in TYPES)})::BIGINT AS rows FROM wx UNION ALL SELECT 'any wind', count_if(AWND IS NULL OR WSF2 IS NULL OR WSF5 IS NULL)::BIGINT FROM wx")
def i01_missing_patterns(spark, root):
    return clean.missing_patterns(wx(spark, root), {"all weather types": (TYPES, "all"), "any wind": (["AWND", "WSF2", "WSF5"], "any")})


@query(f"WITH {WX} SELECT county_fips, day, {R('coalesce(PRCP, -1)', 'PRCP')}, {R('coalesce(TMIN, -1)', 'TMIN')} FROM wx")
def i02_constant_fill(spark, root):
    return clean.fill_constant(wx(spark, root), ["PRCP", "TMIN"], -1.0).select(*KEY, "PRCP", "TMIN")


@query(f"WITH {WX} SELECT county_fips, day, " + ", ".join(R(f"coalesce({c}, avg({c}) OVER ())", c) for c in NUMBERS) + " FROM wx")
def i17_global_means(spark, root):
    return select_features.mean_filled(wx(spark, root), NUMBERS).select(*KEY, *NUMBERS)


# ---- selection ---------------------------------------------------------------------------------------------------------


@query(f"WITH {WX} " + union_sql(NUMBERS + ["WT01"], f"SELECT '{{c}}' AS feature, {R('var_pop({c})', 'variance')} FROM wx"))
def m02_variances(spark, root):
    return select_features.variances(wx(spark, root), [*NUMBERS, "WT01"])


def anova_sql(f: str) -> str:
    return f"SELECT '{f}' AS feature, {R('(sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / nullif(count(*) - 1, 0) / nullif(sum(n * v) / nullif(sum(n) - count(*), 0), 0)', 'f')}, sum(n)::BIGINT AS n FROM (SELECT climate_zone, count({f}) AS n, avg({f}) AS m, var_pop({f}) AS v FROM wx WHERE climate_zone IS NOT NULL AND {f} IS NOT NULL GROUP BY 1)"


@query(f"WITH {WX} " + " UNION ALL ".join(map(anova_sql, NUMBERS)))
def m04_anova_f(spark, root):
    return select_features.anova_f(wx(spark, root), NUMBERS, "climate_zone")


@query(f"WITH {WX}, c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {CORR(f, 'WSF2')} AS r, count(*) FILTER ({f} IS NOT NULL AND WSF2 IS NOT NULL) AS n FROM wx" for f in FEATS) + f") SELECT feature, {R('r * r * (n - 2) / nullif(1 - r * r, 0)', 'f')}, n FROM c")
def m05_f_regression(spark, root):
    return select_features.f_regression(wx(spark, root), FEATS, "WSF2")


@query(None)
def m03_correlation_filter(spark, root):
    x = features.engineer(wx(spark, root), "county_fips", "day")
    names = ["TMAX", "TMIN", "TMAX_3d_mean", "TMIN_3d_mean", "PRCP", "PRCP_3d_sum", "WSF2", "WSF2_3d_max"]
    return select_features.selections_of(x, {"correlation": select_features.correlation_filter(x, names, 0.9), "variance": select_features.variance_filter(x, names)})


NAMES = {"PRCP_3d_sum": "weather_base", "WT01": "weather_types", "season": "temporal", "heavy_rain": "extreme_indicators", "wet_windy_combo": "compound_risks", "climate_zone": "geographic", "temp_range_daily": "other"}


# ---- evaluation --------------------------------------------------------------------------------------------------------


def scored(spark, root):
    """Wet days as the class, a share made of the gust as the score."""
    g = F.col("WSF5")
    return wx(spark, root).where(g.isNotNull() & (g > 0) & F.col("PRCP").isNotNull()).select(*KEY, "year", (F.col("PRCP") > 1).cast("int").alias("y"), (g / (g + 12.0)).alias("score"), (g / (g + 12.0) > 0.5).cast("int").alias("p"))


SCORED = "sc AS (SELECT county_fips, day, year, CASE WHEN PRCP > 1 THEN 1 ELSE 0 END AS y, WSF5 / (WSF5 + 12.0::DOUBLE) AS score, CASE WHEN WSF5 / (WSF5 + 12.0::DOUBLE) > 0.5 THEN 1 ELSE 0 END AS p FROM wx WHERE WSF5 > 0 AND PRCP IS NOT NULL)"
SC = f"{WX}, {SCORED}"
CURVE = "u AS (SELECT score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM sc GROUP BY 1), v AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM u)"


@query(f"WITH {SC}, c AS (SELECT y AS actual, p AS predicted, count(*) AS n FROM sc GROUP BY 1, 2) SELECT actual, predicted, n, {R('n / sum(n) OVER (PARTITION BY actual)', 'row_share')} FROM c")
def e01_confusion(spark, root):
    return metrics.confusion(scored(spark, root), "y", "p")


@query(f"WITH {SC}, c AS (SELECT count_if(y = 1 AND p = 1)::BIGINT AS tp, count_if(y = 0 AND p = 1)::BIGINT AS fp, count_if(y = 0 AND p = 0)::BIGINT AS tn, count_if(y = 1 AND p = 0)::BIGINT AS fn FROM sc) SELECT tp, fp, tn, fn, {R('tp / (tp + fn)::DOUBLE', 'tpr')}, {R('fn / (tp + fn)::DOUBLE', 'fnr')}, {R('tn / (tn + fp)::DOUBLE', 'tnr')}, {R('fp / (tn + fp)::DOUBLE', 'fpr')} FROM c")
def e02_rates(spark, root):
    return metrics.rates(scored(spark, root), "y", "p")


@query(f"WITH {SC}, r AS (SELECT k AS class, count_if(y = k AND p = k)::DOUBLE AS h, count_if(y = k)::DOUBLE AS s, count_if(p = k)::DOUBLE AS c FROM sc, (VALUES (0), (1)) t(k) GROUP BY 1) SELECT class, {R('h / c', 'precision')}, {R('h / s', 'recall')}, {R('2 * (h / c) * (h / s) / (h / c + h / s)', 'f1')}, s::BIGINT AS support FROM r")
def e03_class_report(spark, root):
    return metrics.class_report(scored(spark, root), "y", "p")


@query(f"WITH {SC}, r AS (SELECT k AS class, count_if(y = k AND p = k)::DOUBLE AS h, count_if(y = k)::DOUBLE AS s, count_if(p = k)::DOUBLE AS c FROM sc, (VALUES (0), (1)) t(k) GROUP BY 1), q AS (SELECT *, h / c AS pr, h / s AS re, 2 * (h / c) * (h / s) / (h / c + h / s) AS f FROM r) SELECT {R('avg(pr)', 'macro_precision')}, {R('avg(re)', 'macro_recall')}, {R('avg(f)', 'macro_f1')}, {R('sum(pr * s) / sum(s)', 'weighted_precision')}, {R('sum(re * s) / sum(s)', 'weighted_recall')}, {R('sum(f * s) / sum(s)', 'weighted_f1')}, {R('sum(re * s) / sum(s)', 'accuracy')} FROM q")
def e03_averages(spark, root):
    return metrics.averages(metrics.class_report(scored(spark, root), "y", "p"))


@query(f"WITH {SC}, {CURVE} SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, {R('sum(neg * (tp - pos) + neg * pos * 0.5) / (sum(pos) * sum(neg))', 'roc_auc')}, {R('sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos)', 'average_precision')} FROM v")
def e04_ranking(spark, root):
    return metrics.ranking(scored(spark, root), "y", "score")


@query(f"WITH {SC}, u AS (SELECT county_fips, score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM sc GROUP BY 1, 2), v AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM u WINDOW w AS (PARTITION BY county_fips ORDER BY score DESC)) SELECT county_fips, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, {R('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos) + neg * pos * 0.5) / (sum(pos) * sum(neg)) ELSE 0 END', 'roc_auc')}, {R('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos) ELSE 0 END', 'average_precision')} FROM v GROUP BY 1")
def e09_ranking_by_county(spark, root):
    return metrics.ranking(scored(spark, root), "y", "score", ["county_fips"])


@query(f"WITH {SC} SELECT {R('avg(CASE WHEN y = 1 THEN -ln(score) ELSE -ln(1 - score) END)', 'log_loss')}, count(*) AS n FROM sc")
def e06_log_loss(spark, root):
    return metrics.log_loss(scored(spark, root).withColumn("q", 1 - F.col("score")), "y", ["q", "score"])


def forecast(spark, root):
    return wx(spark, root).where("TMAX is not null and TMIN is not null").select(*KEY, F.month("day").alias("month"), "TMAX", (F.col("TMIN") * 0.9 + 10.0).alias("pred"), (F.col("TMAX") - (F.col("TMIN") * 0.9 + 10.0)).alias("e"))


FC = f"{WX}, fc AS (SELECT county_fips, day, month(day)::INTEGER AS month, TMAX, TMIN * 0.9::DOUBLE + 10.0::DOUBLE AS pred, TMAX - (TMIN * 0.9::DOUBLE + 10.0::DOUBLE) AS e FROM wx WHERE TMAX IS NOT NULL AND TMIN IS NOT NULL)"
REG = f"count(*) AS n, {R('sqrt(avg(e * e))', 'rmse')}, {R('avg(abs(e))', 'mae')}, {R('1 - avg(e * e) / nullif(var_pop(TMAX), 0)', 'r2')}"


@query(f"WITH {FC} SELECT {REG} FROM fc")
def e07_regression(spark, root):
    return metrics.regression(forecast(spark, root), "TMAX", "pred")


@query(f"WITH {FC} SELECT county_fips, month, {REG} FROM fc GROUP BY 1, 2")
def a22_group_errors(spark, root):
    return metrics.regression(forecast(spark, root), "TMAX", "pred", ["county_fips", "month"])


@query(f"WITH {FC}, q AS (SELECT list_sort(list_distinct(quantile_cont(pred, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS q FROM fc), b AS (SELECT fc.*, len(list_filter(q[2:len(q) - 1], lambda x: pred > x)) AS bin FROM fc, q) SELECT bin::INTEGER AS bin, count(*) AS n, {R('avg(TMAX)', 'mean_actual')}, {R('avg(pred)', 'mean_predicted')}, {R('avg(abs(e))', 'mae')}, {R('avg(CASE WHEN TMAX <> 0 THEN abs(e) / abs(TMAX) END)', 'mape')} FROM b GROUP BY 1")
def a23_decile_errors(spark, root):
    return metrics.decile_errors(forecast(spark, root), "TMAX", "pred")


@query(f"WITH {SC}, {CURVE} SELECT {R('score', 'score')}, {R('tp / P', 'tpr')}, {R('fp / N', 'fpr')}, {R('tp / (tp + fp)', 'precision')}, {R('tp / P', 'recall')}, {R('2 * (tp / (tp + fp)) * (tp / P) / (tp / (tp + fp) + tp / P + 1e-10)', 'f1')} FROM v")
def e08_curve_points(spark, root):
    return metrics.curve_points(scored(spark, root), "y", "score")


@query(f"WITH {FC}, d AS (SELECT county_fips, e, e - lag(e) {ROWS} AS s FROM fc) SELECT county_fips, {R('sum(s * s) / nullif(sum(e * e), 0)', 'durbin_watson')} FROM d GROUP BY 1")
def e11_durbin_watson(spark, root):
    return metrics.durbin_watson(forecast(spark, root), "e", ["county_fips"], ["day"])


@query(f"WITH {FC} SELECT {R('pow(covar_pop(e * e, pred) / (stddev_pop(e * e) * stddev_pop(pred)), 2) * count(*)', 'lm')}, count(*) AS n FROM fc")
def e11_breusch_pagan(spark, root):
    return metrics.breusch_pagan(forecast(spark, root), "e", "pred")


@query(f"WITH {FC}, c AS (SELECT county_fips, day, e - avg(e) OVER (PARTITION BY county_fips) AS c FROM fc), l AS (SELECT county_fips, {', '.join(f'c * lag(c, {k}) {ROWS} AS l{k}' for k in range(6))} FROM c), s AS (SELECT county_fips, {', '.join(f'coalesce(sum(l{k}), 0) AS s{k}' for k in range(6))} FROM l GROUP BY 1) " + " UNION ALL ".join(f"SELECT county_fips, {k} AS lag, {R(f's{k} / nullif(s0, 0)', 'acf')} FROM s" for k in range(6)))
def e12_autocorrelation(spark, root):
    return metrics.autocorrelation(forecast(spark, root), "e", ["county_fips"], ["day"], 5)


@query(f"WITH {SC} SELECT least(floor(score * 20) + 1, 20)::BIGINT AS bin, y AS label, count(*) AS n FROM sc GROUP BY 1, 2")
def e13_histogram(spark, root):
    return metrics.probability_histogram(scored(spark, root), "score", "y")


@query(f"WITH {SC} SELECT {R('avg(score) FILTER (y = 1)', 'mean_positive')}, {R('avg(score) FILTER (y = 0)', 'mean_negative')}, {R('abs(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0))', 'distance')}, abs(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) > 0.3 AS separated FROM sc")
def e13_separation(spark, root):
    return metrics.separation(scored(spark, root), "score", "y")


@query(f"WITH {SC} SELECT y AS actual, y = p AS correct, count(*) AS n, {R('avg(greatest(score, 1 - score))', 'confidence')} FROM sc GROUP BY 1, 2")
def e14_confidence(spark, root):
    return metrics.confidence(scored(spark, root).withColumn("q", 1 - F.col("score")), "y", "p", ["q", "score"])


@query(f"WITH {FC}, p AS (SELECT k, (k + 0.5) / 9 AS p FROM range(9) r(k)) SELECT k::INTEGER AS k, {R('(SELECT quantile_cont(e, p) FROM fc)', 'observed')} FROM p".replace("(SELECT quantile_cont(e, p) FROM fc)", "qs[k + 1]").replace("FROM p", "FROM p, (SELECT quantile_cont(e, [" + ", ".join(str((k + 0.5) / 9) for k in range(9)) + "]) AS qs FROM fc)"))
def e11_qq_points(spark, root):
    q = metrics.qq_points(forecast(spark, root), "e", 9)
    return q.withColumn("k", F.row_number().over(Window.orderBy("theoretical")) - 1).select("k", "observed")  # nine rows


# ---- models ------------------------------------------------------------------------------------------------------------


@query(f"WITH {WX} SELECT county_fips, day, CASE WHEN PRCP >= 10 THEN 2 WHEN PRCP > 0 THEN 1 ELSE 0 END AS severity FROM wx")
def l12_severity(spark, root):
    return wx(spark, root).select(*KEY, ml.severity(F.col("PRCP"), 10.0).alias("severity"))


@query(f"WITH {WX} SELECT CASE WHEN year <= 2022 THEN 'train' WHEN year = 2023 THEN 'validate' WHEN year = 2024 THEN 'test' END AS part, count(*) AS n FROM wx WHERE year <= 2024 GROUP BY 1")
def l01_temporal_split(spark, root):
    parts = ml.temporal_split(wx(spark, root), "year", 2022, 2023, 2024)
    return weather.union_by_name([p.select(F.lit(n).alias("part")) for n, p in zip(("train", "validate", "test"), parts, strict=True)]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WX}, o AS (SELECT *, row_number() OVER (ORDER BY day, county_fips) - 1 AS pos, count(*) OVER () AS n FROM wx), f AS (SELECT CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM o) SELECT fold::INTEGER AS fold, count(*) AS n FROM f GROUP BY 1")
def l08_rolling_folds(spark, root):
    return ml.rolling_folds(wx(spark, root).select(*KEY), ["day", "county_fips"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WX} SELECT county_fips, {R('quantile_cont(PRCP, 0.5)', 'median')} FROM wx WHERE PRCP > 0 GROUP BY 1")
def l14_county_medians(spark, root):
    return ml.county_medians(wx(spark, root), "county_fips", "PRCP")


@query(f"WITH {WX}, q AS (SELECT quantile_cont(PRCP, 0.976) AS q FROM wx) SELECT county_fips, day, {flag('PRCP >= q')} AS severe FROM wx, q")
def l15_quantile_label(spark, root):
    return ml.quantile_label(wx(spark, root), "PRCP", 0.976).select(*KEY, "severe")
