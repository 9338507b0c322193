"""Micro-fixtures with answers worked out by hand for the pipeline's operators; nulls, ties, repeats and empty tables among them."""

import json
import math
import threading
from datetime import date, datetime, timedelta
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.operators import clean, features, merge, metrics, ml, outages, profile, select_features, weather
from tempestry.sources import readers, sinks
from tempestry.streaming import rollup

D = date(2024, 1, 1)
day = lambda i: D + timedelta(i)


def series(spark, values, group=None):
    return spark.createDataFrame([(group[i] if group else "A", i, v) for i, v in enumerate(values)], "g string, i int, a double")


def col(df, c="a", by="i"):
    return [r[c] for r in df.orderBy(by).collect()]


# ---- imputation


def test_constant_fill(spark):
    df = spark.createDataFrame([(1.0, None), (None, 5.0), (3.0, 6.0), (float("nan"), 1.0)], "a double, b double")
    assert sorted(map(tuple, clean.fill_constant(df, ["a", "b"], 0.0).collect())) == [(0.0, 1.0), (0.0, 5.0), (1.0, 0.0), (3.0, 6.0)]
    assert clean.fill_constant(df, ["a"], -999.0).where("a = -999").count() == 2


def test_forward_fill(spark):
    assert col(clean.fill_forward(series(spark, [1.0, None, None, 4.0, None]), ["a"], ["i"])) == [1, 1, 1, 4, 4]
    got = clean.fill_forward(series(spark, [1.0, None, 10.0, None, None], ["A", "A", "B", "B", "C"]), ["a"], ["i"], ["g"])
    assert col(got) == [1, 1, 10, 10, None]


def test_interpolation(spark):
    got = col(clean.fill_linear(series(spark, [None, 10.0, None, None, 20.0, None]), ["a"], ["i"], ["g"]))
    assert got[0] is None and [round(x, 2) for x in got[1:]] == [10, 13.33, 16.67, 20, 20]
    assert clean.fill_linear(series(spark, [1.0]).limit(0), ["a"], ["i"], ["g"]).count() == 0


def test_means(spark):
    x = series(spark, [10.0, None, 30.0, None])
    assert col(clean.Means.fit(x, ["a"]).transform(x)) == [10, 20, 30, 20]
    y = series(spark, [10.0, None, 100.0, None], ["A", "A", "B", "B"])
    assert col(clean.Means.fit(y, ["a"], ["g"]).transform(y)) == [10, 10, 100, 100]


def test_missing_plan(spark):
    rows = [(day(i), "c", None if i in (2, 3) else float(i), None if i == 0 else 5.0, None, None if i == 4 else 7.0, None if i == 1 else "x", None, None) for i in range(6)]
    df = spark.createDataFrame(rows, "day date, county_fips string, TMAX double, PRCP double, WT01 double, WSF2 double, state string, any_out double, train_mask boolean")
    df = df.withColumn("WSF2_7d_max", F.when(F.dayofmonth("day") > 2, F.dayofmonth("day") + 0.0)).withColumn("run_start_time_day", F.lit(None).cast("date"))
    plan = clean.MissingPlan("county_fips", "day").fit(df)
    got = [tuple(r) for r in plan.transform(df).orderBy("day").collect()]
    assert [r[9] for r in got] == [4.5, 4.5, 3, 4, 5, 6] and got[0][10] == D
    assert [r[2] for r in got] == [0, 1, 2, 3, 4, 5] and got[0][3] == 0 and all(r[4] == 0 and r[7] == 0 and r[8] is False for r in got)
    assert got[4][5] == 7 and got[1][6] == "x"


def test_missingness(spark):
    df = spark.createDataFrame([(1.0, None, None), (float("nan"), None, "x")], "a double, b double, c string")
    assert {r["column"]: (r["missing"], r["percent"]) for r in clean.missingness(df).collect()} == {"a": (1, 50.0), "b": (2, 100.0), "c": (1, 50.0)}
    assert {r["pattern"]: r["rows"] for r in clean.missing_patterns(df, {"both": (["a", "b"], "all"), "one": (["a", "c", "zz"], "any"), "none": (["q"], "any")}).collect()} == {"both": 1, "one": 2}
    assert {r["missing"] for r in clean.missingness(df.limit(0)).collect()} == {0}


# ---- capping, scaling, encoding


def test_outliers(spark):
    df = spark.createDataFrame([(float(x), 1.0, None) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "a double, b double, c double")
    got = {r["column"]: r for r in clean.outlier_counts(df, ["a", "b", "c"]).collect()}
    assert (got["a"]["q1"], got["a"]["q3"], got["a"]["outliers"], got["b"]["outliers"]) == (3, 7, 1, 0)
    assert {r["column"] for r in clean.outlier_counts(df, ["a", "b"], skip_flat=True).collect()} == {"a"}
    capped = clean.cap_outliers(df, ["a", "b", "c"])
    assert capped.agg(F.max("a")).first()[0] == 13 and capped.where("c is null").count() == 9
    moved = profile.changed_by_capping(df, capped, ["a", "b", "c"]).collect()
    assert [(r["column"], r["max_before"], r["max_after"]) for r in moved] == [("a", 100, 13)]


def test_capping_collapses_flags_unless_skipped(spark):
    df = spark.createDataFrame([(float(i == 0),) for i in range(8)], "f double")
    assert clean.cap_outliers(df, ["f"]).agg(F.max("f")).first()[0] == 0
    assert clean.cap_outliers(df, ["f"], skip_binary=True).agg(F.max("f")).first()[0] == 1


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = clean.zscore(df, ["a", "b"]).collect()
    assert sorted((r["a"] for r in got if r["a"] is not None)) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)]) and all(r["b"] is None for r in got)


def test_encoding(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "c string")
    assert {r["c"]: r["c_encoded"] for r in clean.label_encode(df, "c").collect()} == {"a": 0, "b": 1, None: 2, "z": 3}
    hot = {r["c"]: (r["c_b"], r["c_z"]) for r in clean.one_hot(df, "c").collect()}
    assert hot == {"a": (False, False), "b": (True, False), "z": (False, True), None: (False, False)} and "c_a" not in clean.one_hot(df, "c").columns
    with pytest.raises(ValueError):
        clean.one_hot(df, "c", most=2)
    assert set(clean.encode_categories(df, ["c"]).columns) == {"c_b", "c_z"} and clean.encode_categories(df, ["c"], few=2).columns == ["c_encoded"]
    assert clean.booleans_to_int(clean.one_hot(df, "c")).where("c_b = 1").count() == 1


def test_dates_constants_targets(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0, 2.0, None, 1)], "d date, a double, b double, n double, y int")
    assert clean.date_parts(df, "d").select("day_of_week", "day_of_year", "month", "year").first() == (0, 1, 1, 2024)
    two = df.unionByName(df.withColumn("b", F.lit(3.0)).withColumn("y", F.lit(0)))
    assert clean.constant_columns(two, ["a", "b", "n"]) == ["a", "n"]
    assert clean.features_and_target(two, ["n", "a"], "y").select("n").distinct().collect()[0][0] == 0
    with pytest.raises(ValueError):
        clean.features_and_target(two, ["zz"], "y")
    clean.check_same(two, two.withColumn("a", F.lit(0)), "y")
    with pytest.raises(AssertionError):
        clean.check_same(two, two.limit(1), "y")


# ---- windows and features


def test_features_by_hand(spark):
    vals = [(30.0, 10.0, 0.0), (36.0, 12.0, 80.0), (41.0, 15.0, 1.0), (None, None, None), (-1.0, -15.0, 3.0)]
    df = spark.createDataFrame([("c", day(i), t, m, p, 10.0 * i) for i, (t, m, p) in enumerate(vals)], "f string, day date, TMAX double, TMIN double, PRCP double, WSF2 double")
    r = features.engineer(df, "f", "day").orderBy("day").collect()
    assert [x["consecutive_heat_days"] for x in r] == [0, 1, 2, 0, 0] and [x["consecutive_rain_days"] for x in r] == [0, 1, 2, 0, 1]
    assert [x["days_since_rain"] for x in r] == [999, 0, 0, 1, 0] and [x["heavy_rain"] for x in r] == [0, 1, 0, 0, 0]
    assert r[2]["PRCP_3d_sum"] == 81 and r[3]["PRCP_3d_sum"] == 81 and r[3]["TMAX_lag1d"] == 41 and r[3]["temp_range_daily"] is None
    assert r[0]["heating_degree_days"] == 0 and r[3]["heating_degree_days"] is None and round(r[4]["heating_degree_days"], 1) == 19.3
    assert r[2]["temp_volatility_3d"] is not None and r[3]["temp_volatility_3d"] is None and r[0]["AWND"] is None
    assert [x["multiple_extremes"] for x in r] == [0, 1, 1, 1, 1] and r[4]["season"] == "winter" and r[4]["winter_freeze"] == 1
    assert r[1]["weather_severity_score"] == 3 and r[4]["weather_severity_score"] == 2 + 4
    assert [x["days_since_rain"] for x in features.engineer(df, "f", "day", days_since_compat=True).orderBy("day").collect()] == [999, 0, 0, 0, 0]
    assert features.engineer(df.limit(0), "f", "day").count() == 0


def test_features_one_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id % 2 as string) f", "date_add(date'2024-01-01', cast(id as int)) day", "cast(id as double) TMAX", "cast(id as double) TMIN", "cast(id as double) PRCP", "cast(id as double) WSF2")
    plan = features.engineer(df, "f", "day")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_event_days_and_windows(spark):
    rows = [("a", day(i), 100.0 if i == 20 else float(i % 5), float(i)) for i in range(40)] + [("b", day(i), 1.0, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "f string, d date, x double, m double")
    ev = merge.event_days(df, "f", "d", "x")
    assert ("b", D) in {tuple(r) for r in ev.collect()} and ev.where("f = 'a'").count() >= 3
    win = {r["lag"]: (r["n"], r["m"]) for r in merge.event_window(df, spark.createDataFrame([("a", day(1))], "f string, d date"), "f", "d", ["m"], 3).collect()}
    assert win == {-1: (1, 0.0), 0: (1, 1.0), 1: (1, 2.0), 2: (1, 3.0), 3: (1, 4.0)}


# ---- outages


def snaps(spark, rows):
    t0 = datetime(2024, 3, 9, 12)
    return spark.createDataFrame([(f, t0 + timedelta(minutes=m), d, c, n) for f, m, d, c, n in rows], "fips_code string, ts timestamp, local_day date, customers_out long, customers_total long")


def test_daily_outages(spark):
    a, b = date(2024, 3, 9), date(2024, 3, 10)
    s = snaps(spark, [("1", 0, a, 5, 100), ("1", 30, a, 10, 100), ("1", 61, a, 2, 100), ("1", 76, a, 0, 100), ("1", 91, a, None, 100), ("1", 700, a, 3, 100), ("1", 715, b, 4, 90), ("2", 0, a, 0, None)])
    places = spark.createDataFrame([("1", "America/New_York"), ("2", None)], "fips_code string, tz string")
    got = {(r["fips_code"], r["run_start_time_day"]): r for r in outages.daily_outages(s, places, None, snapshot_minutes=15).collect()}
    x, y, z = got["1", a], got["1", b], got["2", a]
    assert (x["any_out"], x["num_out_per_day"], x["minutes_out"], x["customers_out"], x["customers_out_mean"], x["cust_minute_area"]) == (1, 3, 60, 10, 4.0, 300)
    assert x["pct_out_max"] == 0.1 and x["pct_out_area"] == pytest.approx(300 / (100 * 1440)) and y["pct_out_area"] == pytest.approx(60 / (90 * 1380))
    assert (y["num_out_per_day"], z["any_out"], z["num_out_per_day"], z["minutes_out"], z["pct_out_max"]) == (1, 0, 0, 0, None)
    mcc = spark.createDataFrame([("1", 1000), ("00001", 1000), ("2", 0), (None, 5)], "county_fips string, customers long")
    five = s.withColumn("fips_code", C.fips5(F.col("fips_code")))
    got = {r["fips_code"]: r["pct_out_max"] for r in outages.daily_outages(five, places, mcc, snapshot_minutes=15).where("run_start_time_day = '2024-03-09'").collect()}
    assert got == {"00001": 0.01, "00002": None}
    assert outages.daily_outages(s.limit(0), places, None).count() == 0


def test_sessions_gap(spark):
    s = snaps(spark, [("1", 0, D, 1, 1), ("1", 30, D, 1, 1), ("1", 61, D, 9, 1), ("1", 62, day(1), 1, 1), ("1", 63, D, 0, 1)])
    got = sorted((r["local_day"], r["snapshots"], r["peak"]) for r in outages.sessions(s, "fips_code", "local_day", "ts", "customers_out").collect())
    assert got == [(D, 1, 9), (D, 2, 1), (day(1), 1, 1)]
    n = outages.daily_rollup(s).where("num_out_per_day > 0").select("run_start_time_day", "num_out_per_day").collect()
    assert sorted(map(tuple, n)) == [(D, 2), (day(1), 1)]


def test_cadences(spark):
    s = snaps(spark, [("1", 15 * i, D, 1, 1) for i in range(300)] + [("2", 0, D, 1, 1)])
    assert outages.median_gap_cadence(s, "fips_code", "ts").first()[0] == 15
    assert outages.median_gap_cadence(s.limit(0), "fips_code", "ts").first()[0] == 15
    m = lambda *v: outages.gcd_cadence(spark.createDataFrame([(x,) for x in v], "minutes_out long")).first()[0]
    assert m(90, 60, 45, 0) == 15 and m(20, 30) == 10 and m(7) == 5 and m(0) == 15 and m(720, 60) == 60 and m(1024, 8) == 10


def test_local_minutes(spark):
    df = spark.createDataFrame([(date(2024, 3, 10), "America/New_York"), (date(2024, 11, 3), "America/New_York"), (date(2024, 11, 3), "America/Phoenix"), (None, "UTC")], "d date, tz string")
    assert [r[0] for r in df.select(outages.minutes_of_day(F.col("d"), F.col("tz"))).collect()] == [1380, 1500, 1440, 1440]


def test_labels_and_combining(spark):
    base = spark.createDataFrame([("1", D, None, 1, 60, 10, 5.0, 600, 0.1, 0.01, 100, "UTC"), ("1", D, None, 1, 30, 1, 1.0, 60, 0.1, 0.01, 100, "UTC"), ("2", D, None, 0, 0, 0, 0.0, 0, None, None, None, None)], "fips_code string, run_start_time_day date, any_out int, num_out_per_day long, minutes_out long, customers_out long, customers_out_mean double, cust_minute_area long, pct_out_max double, pct_out_area double, customers_total long, tz string")
    got = outages.combine_years([base, base.drop("pct_out_max")])
    assert [(r["fips_code"], r["minutes_out"]) for r in got.collect()] == [("1", 60), ("2", 0)] and got.columns == list(outages.DAILY_COLUMNS)
    assert [r["any_out"] for r in outages.infer_any_out(base).orderBy("fips_code", "minutes_out").collect()] == [1, 1, 0]
    lab = {(r["fips_code"], r["minutes_out"]): r for r in outages.labels(base, force_minutes=15).collect()}
    assert (lab["1", 60]["snapshots_count"], lab["1", 60]["coverage"], lab["1", 60]["pct_out_area_covered"], lab["1", 60]["train_mask"]) == (4.0, 60 / 1440, 0.1, False)
    assert lab["2", 0]["pct_out_area_unified"] is None and lab["2", 0]["train_mask"] is False
    with pytest.raises(ValueError):
        outages.labels(base, force_minutes=7)


def test_civil_day(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 3), "America/New_York")], "t timestamp, z string")
    assert df.select(outages.civil_day(F.col("t"), F.col("z")), outages.civil_day(F.col("t"), mode="utc"), outages.civil_day(F.col("t"), mode="single", single="Asia/Tokyo")).first() == (date(2023, 12, 31), D, D)


# ---- weather, merging


def test_weather_rules(spark):
    obs = spark.createDataFrame([("s1", D, "PRCP", None, 1), ("s1", D, "PRCP", 2.0, 2), ("s1", D, "PRCP", 1.0, 2), ("s1", D, "TMAX", 10.0, 1), ("s2", D, "TMAX", 20.0, 1), ("s2", D, "WT01", 1.0, 1), ("s2", D, "XX", 1.0, 1)], "s string, d date, k string, v double, t int")
    wide = weather.pivot_observations(obs, ["s", "d"], "k", "v", "t")
    assert {r["s"]: (r["PRCP"], r["TMAX"], r["WT01"]) for r in wide.collect()} == {"s1": (1.0, 10.0, None), "s2": (None, 20.0, 1.0)}
    r = weather.to_entity_day(wide, ["d"]).first()
    assert (r["PRCP"], r["TMAX"], r["WT01"], r["TMIN"]) == (1.0, 15.0, 1.0, None)
    assert weather.to_entity_day(wide.where("s = 's2'"), ["d"]).first()["PRCP"] == 0.0
    assert weather.reporting_stations(obs, "d", "s").first()["stations"] == 2


def test_merges(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v int, clash string")
    right = spark.createDataFrame([("a", 7, "no")], "k string, n long, clash string")
    assert sorted((r["v"], r["n"], r["clash"]) for r in merge.left_merge_fill(left, right, ["k"], ["n"]).collect()) == [(1, 7, "x"), (2, 0, "y"), (3, 0, "z")]
    dup = spark.createDataFrame([("a", 2, 5), ("a", 1, 6), ("a", 1, 4), ("b", None, None)], "k string, o int, v int")
    assert sorted(map(tuple, merge.first_rows(dup, ["k"], ["o"]).collect())) == [("a", 1, 4), ("b", None, None)]
    assert sorted((r["k"], r["v"]) for r in merge.top_rows(dup.where("v is not null"), ["k"], F.col("v"), ["o"], 2).collect()) == [("a", 5), ("a", 6)]
    star = merge.score_star({"m1": spark.createDataFrame([("f", 1.0)], "feature string, score double"), "m2": spark.createDataFrame([("g", 2.0)], "feature string, score double")})
    assert {r["feature"]: (r["m1"], r["m2"]) for r in star.collect()} == {"f": (1.0, None), "g": (None, 2.0)}
    assert [r[0] for r in left.select(merge.map_lookup(F.col("k"), {"a": "A"}, "?")).collect()] == ["A", "?", "?"]


# ---- metrics


def scored(spark):
    return spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 1), (1, 0.8, 1), (1, 0.3, 0), (0, 0.1, 0), (None, 0.5, 0), (1, None, 0)], "y int, s double, p int").where("y is not null and s is not null")


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_ranking(spark):
    pairs = [(r["y"], r["s"]) for r in scored(spark).collect()]
    r = metrics.ranking(scored(spark), "y", "s").first()
    assert r["roc_auc"] == pytest.approx(brute_auc(pairs)) and r["average_precision"] == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3)
    one = metrics.ranking(scored(spark).where("y = 1"), "y", "s").first()
    assert (one["roc_auc"], one["average_precision"]) == (0.0, 0.0)
    none = metrics.ranking(scored(spark).limit(0), "y", "s").first()
    assert (none["roc_auc"], none["positives"]) == (0.0, None)


def test_ranking_large_scores(spark):
    import random

    rng = random.Random(1)
    pairs = [(rng.randint(0, 1), rng.choice([rng.gauss(0, 5), float(rng.randint(-3, 3))])) for _ in range(300)]
    assert metrics.ranking(spark.createDataFrame(pairs, "y int, s double"), "y", "s").first()["roc_auc"] == pytest.approx(brute_auc(pairs))


def test_rates_and_report(spark):
    r = metrics.rates(scored(spark), "y", "p").first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 1) and r["tpr"] == pytest.approx(2 / 3) and r["fpr"] == 0.5
    assert metrics.rates(scored(spark).where("y = 1"), "y", "p").first()["fpr"] == 0.0
    rep = {x["class"]: x for x in metrics.class_report(scored(spark), "y", "p").collect()}
    assert rep[1]["precision"] == pytest.approx(2 / 3) and rep[0]["recall"] == 0.5 and rep[1]["support"] == 3
    assert metrics.averages(metrics.class_report(scored(spark), "y", "p")).first()["accuracy"] == pytest.approx(0.6)
    best = metrics.best_f1(metrics.curve_points(scored(spark), "y", "s")).first()
    assert best["score"] == 0.3 and best["recall"] == 1.0


def test_losses(spark):
    df = spark.createDataFrame([(0, 0.7, 0.3), (1, 0.5, 0.5), (1, 1.0, 0.0)], "y int, a double, b double")
    assert metrics.log_loss(df, "y", ["a", "b"]).first()["log_loss"] == pytest.approx(-(math.log(0.7) + math.log(0.5) + math.log(1e-15)) / 3)
    e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, -1, 2, 0])], "g string, i int, e double")
    assert metrics.durbin_watson(e, "e", ["g"], ["i"]).first()[1] == pytest.approx((4 + 9 + 4) / 6)
    acf = {r["lag"]: r["acf"] for r in metrics.autocorrelation(e, "e", ["g"], ["i"], 2).collect()}
    assert acf[0] == 1.0 and acf[1] == pytest.approx(sum((a - 0.5) * (b - 0.5) for a, b in [(1, -1), (-1, 2), (2, 0)]) / 5.0)
    flat = metrics.regression(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double"), "y", "p").first()
    assert flat["r2"] is None and flat["rmse"] == pytest.approx(math.sqrt(0.5))


# ---- profiles and selection


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0), (2.0, 4.0, 5.0, None), (3.0, 6.0, 5.0, 2.0), (None, 1.0, 5.0, 9.0)], "a double, b double, k double, n double")
    r = {(x["a"], x["b"]): x["r"] for x in profile.correlations(df, ["a", "b", "k"]).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "k"] is None
    many = profile.correlations(df, ["a", "b", "k", "n"], few=2).collect()
    want = {(x["a"], x["b"]): x["r"] for x in profile.correlations(df, ["a", "b", "k", "n"]).collect()}
    assert {(x["a"], x["b"]): x["r"] and pytest.approx(x["r"]) for x in many} == want
    assert {x["r"] for x in profile.correlations(df.limit(0), ["a", "b", "k"], few=2).collect()} <= {None}
    assert {x["feature"]: x["n"] for x in profile.target_correlations(df, ["a", "n"], "b").collect()} == {"a": 3, "n": 3}
    sp = {x["feature"]: x["r"] for x in profile.target_correlations(df, ["a"], "b", spearman=True).collect()}
    assert sp["a"] == pytest.approx(1.0)
    assert {x["feature"]: x["r"] for x in profile.target_correlations(df.limit(2), ["a"], "b").collect()}["a"] is None


def test_profile_tables(spark):
    df = spark.createDataFrame([("x", day(0), 1.0), ("x", day(2), None), ("x", day(2), None), ("y", day(9), 1.0)], "e string, d date, v double")
    assert profile.duplicates(df, ["e", "d"]).first() == (1, 1)
    own = {r["e"]: (r["days"], r["expected"], r["missing"]) for r in profile.coverage(df, "e", "d").collect()}
    assert own == {"x": (2, 3, 1), "y": (1, 1, 0)}
    assert {r["e"]: r["expected"] for r in profile.coverage(df, "e", "d", "global").collect()} == {"x": 10, "y": 10}
    assert {r["column"]: r["distinct_values"] for r in profile.distinct_counts(df, ["e", "v"], True).collect()} == {"e": 2, "v": 2}
    cal = {r["e"]: (r["d01"], r["d02"], r["d03"], r["d04"]) for r in profile.missing_calendar(df, "e", "d", "v").collect()}
    assert cal == {"x": (0, 1, 1, None)}
    assert {r["column"]: r["kind"] for r in profile.near_constant(df, ["e", "v"]).collect()} == {"v": "constant"}
    bal = profile.class_balance(spark.createDataFrame([(0.0,), (None,), (1.0,), (5.0,)], "v double"), "v", [2.0]).first()
    assert (bal["none"], bal["minor"], bal["severe"], bal["min_share"]) == (2, 1, 1, 0.25)
    assert profile.overview(df.limit(0), "e", "d").first()["rows"] == 0
    assert [r["a"] + r["b"] for r in profile.identical_columns(df.selectExpr("v a", "v b", "coalesce(v, 0D) c"), ["a", "b", "c"]).collect()] == ["ab"]


def test_selection_rules(spark):
    rows = [(float(i), 2.0 * i, float(i * i % 7), 1.0, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, y int")
    assert select_features.variance_filter(df, ["a", "b", "c", "k"]) == ["a", "b", "c"]
    assert select_features.correlation_filter(df, ["a", "b", "c"]) == ["a", "c"]
    plan = {r["feature"]: (r["kept"], r["because_of"]) for r in select_features.family_plan(df, {"x": ["a", "b", "c"]}).collect()}
    assert plan == {"a": (True, None), "b": (False, "a"), "c": (True, None)}
    f = {r["feature"]: r["f"] for r in select_features.anova_f(df, ["a", "k"], "y").collect()}
    g = [[r[0] for r in rows if r[4] == k] for k in (0, 1)]
    m = sum(map(sum, g)) / 30
    want = sum(15 * (sum(x) / 15 - m) ** 2 for x in g) / (sum((v - sum(x) / 15) ** 2 for x in g for v in x) / 28)
    assert f["a"] == pytest.approx(want) and f["k"] is None
    mi = {r["feature"]: r["mi"] for r in select_features.mutual_information(df.withColumn("z", F.col("y").cast("double")), ["z", "k"], "y").collect()}
    assert mi["z"] == pytest.approx(math.log(2), rel=1e-6) and mi["k"] == pytest.approx(0.0)
    assert select_features.candidates(df.withColumn("pct_out_max", F.lit(1.0)), "y") == ["a", "b", "c", "k"]
    assert [r["feature"] for r in select_features.top_features(spark.createDataFrame([("p", -3.0), ("q", 2.0), ("r", None)], "feature string, s double"), "s", 1, absolute=True).collect()] == ["p"]


# ---- models


def test_splits_and_folds(spark):
    df = spark.createDataFrame([(i, i % 2, 2020 + i % 5) for i in range(600)], "id int, y int, year int")
    s = ml.stratified_split(df, "y", ["id"])
    assert {(r["y"], r["split"]): r["n"] for r in s.groupBy("y", "split").agg(F.count("*").alias("n")).collect()} == {(k, p): n for k in (0, 1) for p, n in (("train", 240), ("test", 60))}
    odd = ml.stratified_split(spark.createDataFrame([(1, None), (1, None), (1, None), (2, 7)], "id int, y int"), "y", ["id"], 0.5)
    assert sorted((str(r["y"]), r["split"]) for r in odd.collect()) == [("7", "train"), ("None", "test"), ("None", "train"), ("None", "train")]
    assert ml.stratified_split(df.limit(0), "y", ["id"]).count() == 0
    assert {r["fold"] for r in ml.stratified_folds(df, "y", ["id"]).collect()} == set(range(5))
    folds = {r["fold"]: (r["n"], r["a"], r["b"]) for r in ml.rolling_folds(df, ["id"], 5).groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    assert folds == {i: (100, 100 * i, 100 * i + 99) for i in range(6)}
    assert {r["y"]: r["weight"] for r in ml.class_weights(df.where("id % 3 <> 0 or y = 1"), "y").collect()}[0] > 1
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (2.0,), (None,), (float("nan"),)], "v double").select(ml.severity(F.col("v"), 1.0)).collect()] == [0, 1, 2, 0, 0]
    assert abs(ml.undersample(df.where("y = 1 or id < 100"), "y").where("y = 1").count() - 50) < 25
    assert len(ml.sampled_grid({"a": [1, 2], "b": [1, 2, 3]}, 4)) == 4


def test_smote(spark):
    rows = [(i % 10 == 0, float(i % 10 == 0) * 5 + i / 100, float(i)) for i in range(100)] + [(None, 1.0, 1.0)]
    x = spark.createDataFrame(rows, "y boolean, a double, b double")
    got = ml.smote(x, "y", ["a", "b"], k=3)
    made = [r for r in got.where("made").collect()]
    assert 60 <= len(made) <= 100 and all(r["y"] and 5.0 <= r["a"] <= 5.9 and 0 <= r["b"] <= 90 for r in made)
    assert got.where("not made").count() == 100
    one = ml.smote(spark.createDataFrame([(1, 1.0), (0, 2.0), (0, None)], "y int, a double"), "y", ["a"])
    assert sorted((r["y"], r["a"], r["made"]) for r in one.collect()) == [(0, 0.0, False), (0, 2.0, False), (1, 1.0, False), (1, 1.0, True)]
    assert ml.smote(x.limit(0), "y", ["a"]).count() == 0


def test_only_one_process_may_use_a_folder_of_its_own(monkeypatch):
    from types import SimpleNamespace

    from tempestry import session

    class Conf:
        def get(self, *_):
            return None

    for master in ("local-cluster[3,2,1024]", "yarn"):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=Conf())
        with pytest.raises(RuntimeError, match="share"):
            session.ensure_checkpoint_dir(fake)


def test_training_round_trip(spark, tmp_path):
    import random

    rng = random.Random(0)
    rows = [(i, float(x), rng.gauss(0, 1), int(x + rng.gauss(0, 0.3) > 0)) for i, x in enumerate(rng.gauss(0, 1) for _ in range(400))]
    df = ml.with_weights(spark.createDataFrame(rows, "id int, a double, b double, y int"), "y")
    cv = ml.cross_validate(ml.stratified_folds(df, "y", ["id"], 2), lambda s: ml.logistic("y", s["c"], 400.0), [{"c": 1.0}, {"c": 1e-4}], ["a", "b"], "y", by="roc_auc")
    assert cv[0]["roc_auc"] > 0.9
    model = ml.Pipeline(stages=[*ml.assembled(["a", "b"]), ml.logistic("y", 1.0, 400.0)]).fit(df)
    assert ml.coefficients(model.stages[-1], ["a", "b"])[0][0] == "a"
    ml.save(model, str(tmp_path / "m"), {"auc": cv[0]["roc_auc"]})
    again, info = ml.load(str(tmp_path / "m"))
    assert info["auc"] == cv[0]["roc_auc"]
    a, b = (metrics.ranking(ml.positive_probability(m.transform(df)), "y", "score").first()["roc_auc"] for m in (model, again))
    assert a == b > 0.9
    reg = ml.Pipeline(stages=[*ml.assembled(["a", "b"]), ml.estimator("elastic_net", "t", None, regParam=0.001)]).fit(df.withColumn("t", F.col("a") * 3))
    imp = {r["feature"]: r["rmse_increase"] for r in ml.permutation_importance(reg, df.withColumn("t", F.col("a") * 3), ["a", "b"], "t", ["id"], repeats=2).collect()}
    assert imp["a"] > 1 and abs(imp["b"]) < 0.1


# ---- sources, sinks, streams


def test_names(spark):
    assert readers.resolve_names(["FIPS_Code", "sum", "Run_Start_Time"]) == {"fips_code": "FIPS_Code", "customers_out": "sum", "run_start_time": "Run_Start_Time"}
    with pytest.raises(ValueError, match="customers_out"):
        readers.resolve_names(["fips", "time"])


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text("fips,SUM,run_start_time\n6073,12.0,2024-01-01 00:15:00\nzz,,bad\n")
    got = readers.snapshots(spark, str(tmp_path / "in/x.csv")).collect()
    assert (got[0]["fips_code"], got[0]["customers_out"], got[0]["customers_total"]) == ("06073", 12, None) and tuple(got[1])[:3] == (None, None, None)
    assert readers.snapshots(spark, str(tmp_path / "in/x.csv"), ["06073"]).count() == 1
    for n in ("outages_daily_2019.csv", "outages_daily_2020.csv", "outages_daily_2019_combined.csv", "other.csv"):
        (tmp_path / n).write_text("a\n1\n")
    assert sorted(readers.yearly_files(spark, str(tmp_path))) == [2019, 2020]
    assert readers.resolve_dataset(spark, str(tmp_path), "p") == ["p"] and len(readers.resolve_dataset(spark, str(tmp_path))) == 4
    (tmp_path / "weather_features_FIPS_06075_2019.csv").write_text("day,PRCP\n2019-01-01,1\n")
    (tmp_path / "weather_features_FIPS_06073_2020.csv").write_text("day,TMAX\n2020-01-01,2\n")
    dim = spark.createDataFrame([("06075", "CA")], "fips_code string, state string")
    got = {(r["fips_code"], r["year"]): (r["PRCP"], r["TMAX"], r["state"]) for r in readers.county_years(spark, [str(p) for p in sorted(tmp_path.glob("weather*"))], dim).collect()}
    assert got == {("06075", 2019): ("1", None, "CA"), ("06073", 2020): (None, "2", None)}
    (tmp_path / "s.json").write_text(json.dumps([{"id": "A", "elevation": 1.5, "mindate": "2020-01-01"}]))
    assert readers.stations(spark, str(tmp_path / "s.json")).first()["mindate"] == date(2020, 1, 1)
    (tmp_path / "mcc.csv").write_text("County_FIPS,Customers\n1,5\n6073,x\n")
    assert {r["fips_code"]: r["customers_total"] for r in readers.customer_denominators(spark, str(tmp_path / "mcc.csv")).collect()} == {"00001": 5, "06073": None}
    days = spark.createDataFrame([(None, 2024, 60, None), ("2024-05-06", 1, 1, 1), (None, 2024, 999, 3), (None, None, None, None)], "day string, year int, day_of_year int, month int")
    assert [r["day"] for r in readers.reconstruct_day(days).collect()] == [date(2024, 2, 29), date(2024, 5, 6), date(2024, 3, 15), None]
    with pytest.raises(ValueError):
        readers.selected_features(days, ["zz"], ["year"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", D, 1.5), ("b", None, None)], "k string, d date, v double")
    for write, read in ((sinks.to_csv, lambda p: spark.read.csv(p, header=True)), (sinks.to_json, spark.read.json), (sinks.to_parquet, spark.read.parquet)):
        p = str(tmp_path / write.__name__)
        write(df, p)
        assert sorted(str(r["k"]) for r in read(p).collect()) == ["a", "b"]
    sinks.to_parquet(df, str(tmp_path / "parts"), ["k"])
    assert "PartitionFilters: [isnotnull(k" in spark.read.parquet(str(tmp_path / "parts")).where("k = 'a'")._jdf.queryExecution().toString()
    sinks.report({"t": df.orderBy("k")}, str(tmp_path / "r.md"), "R")
    assert "| a | 2024-01-01 | 1.5 |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        sinks.markdown(df, most=1)


def test_report_of_any_size(spark, tmp_path):
    """Every row of every section, in order, from several tasks; cells as Python writes them."""
    n = 2_500
    long = spark.range(n).select("id", F.concat(F.lit("a|"), "id").alias("k")).repartitionByRange(7, F.desc("id")).sortWithinPartitions(F.desc("id"))
    kinds = "s string, b boolean, i int, d date, f float, v double, m decimal(9,3), t timestamp_ntz, l array<int>, z void, `x.y` string"
    some = spark.createDataFrame([("é|", True, -1, D, 0.1, 1e-7 / 3, Decimal("1.5"), datetime(2024, 1, 1, 2, 3, 4, 500000), [1, None], None, "p"), ("", False, None, None, None, float("nan"), None, None, None, None, None)], kinds)
    twice = some.select("s", F.col("i").alias("s"))
    set_to = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        sinks.report({"Long": long, "Kinds": some, "Twice": twice, "None": long.where("id < 0")}, str(tmp_path / "r.md"), "R")
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", set_to)
    lines = (tmp_path / "r.md").read_text().split("\n")
    assert lines[:6] == ["# R", "", "## Long", "", "| id | k |", "| --- | --- |"]
    assert lines[6 : 6 + n] == [f"| {i} | a\\|{i} |" for i in reversed(range(n))]
    assert lines[6 + n :] == [
        *["", "## Kinds", "", "| s | b | i | d | f | v | m | t | l | z | x.y |", "|" + " --- |" * 11],
        "| é\\| | True | -1 | 2024-01-01 | 0.1 | 3.33333e-08 | 1.500 | 2024-01-01 02:03:04.500000 | [1, None] |  | p |",
        "|  | False |  |  |  | nan |  |  |  |  |  |",
        *["", "## Twice", "", "| s | s |", "| --- | --- |", "| é\\| | -1 |", "|  |  |"],
        *["", "## None", "", "| id | k |", "| --- | --- |", ""],
    ]
    assert sinks.markdown(some).split("\n") == lines[9 + n : 13 + n]


def test_paged_source(spark):
    data = [{"i": i} for i in range(25)]
    fails = [503]

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(x.split("=") for x in self.path.split("?")[1].split("&"))
            if fails:
                self.send_error(fails.pop())
                return
            mine = [d for d in data if d["i"] % 2 == int(q["part"])]
            at, n = int(q["offset"]) - 1, int(q["limit"])
            body = json.dumps({"metadata": {"resultset": {"count": len(mine)}}, "results": mine[at : at + n]} if q["part"] == "0" else {"results": mine[at : at + n]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    readers.register(spark)
    df = spark.read.format("paged_json").option("url", f"http://127.0.0.1:{server.server_port}/x").option("queries", "part=0|part=1").option("limit", 5).option("pause", 0.01).load()
    assert sorted(json.loads(r["record"])["i"] for r in df.collect()) == list(range(25))
    server.shutdown()
    assert len(readers.quarter_queries("FIPS:1", 2020, ("PRCP", "TMAX"))) == 4
    assert readers.quarter_queries("FIPS:1", 2020, base=("PRCP",))[0].split(">")[1] == "locationid=FIPS:1&startdate=2020-01-01&enddate=2020-03-31&datatypeid=PRCP"
    assert len(readers.PagedReader({"queries": "|".join("abcdefg"), "parallel": "3"}).partitions()) == 3


def test_streams_match_batch(spark, tmp_path):
    s = snaps(spark, [("1", 0, D, 5, 1), ("1", 15, D, 0, 1), ("1", 61, D, 2, 1), ("2", 5, D, 7, 1)]).drop("local_day", "customers_total")
    s.write.parquet(str(tmp_path / "in"))
    for name, make in (("daily", lambda x: rollup.daily_stream(x, 15)), ("sess", rollup.session_stream)):
        stream = make(rollup.snapshot_stream(spark, str(tmp_path / "in"), "fips_code string, ts timestamp, customers_out long"))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(map(tuple, spark.table(name).collect()))
        assert got == sorted(map(tuple, make(s).collect())) and got


def test_order_statistics(spark):
    import random

    import numpy as np

    from tempestry.operators import ordered

    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 3)])) for _ in range(400)] + [("c", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["q"] for r in ordered.exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for k in ("a", "b"):
        assert got[k] == pytest.approx(list(np.quantile([v for x, v in data if x == k and v is not None], [0, 0.25, 0.5, 0.9, 1])))
    assert "c" not in got
    vals = [v for x, v in data if x == "a" and v is not None]
    ranks = {(r["k"], r["v"]): r["r"] for r in ordered.average_ranks(df, ["k"], "v", "r").collect()}
    for v in vals[:50]:
        assert ranks["a", v] == sum(x < v for x in vals) + (sum(x == v for x in vals) + 1) / 2
    whole = ordered.exact_quantiles(df, [], "v", [0.5]).first()["q"][0]
    assert whole == pytest.approx(np.median([v for _, v in data if v is not None]))
    assert ordered.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
