"""The general operators on small fixtures: nulls, ties, repeats, empty tables, clashing names, brute force."""

import random
from datetime import UTC, date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempestry.operators import blockpivot, drift, impute_groups, intervals, rolling, spikes, timestamps

D = date(2024, 1, 1)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


# ---- trailing totals


def brute_totals(rows, n):
    by = {}
    for e, d, v in rows:
        if e is not None and d is not None:
            by.setdefault(e, {}).setdefault(d, 0.0)
            by[e][d] += v if v is not None and v == v else 0.0
    out = {}
    for e, days in by.items():
        d = min(days)
        while d <= max(days):
            out[e, d] = round(sum(v for k, v in days.items() if d - timedelta(n - 1) <= k <= d), 6)
            d += timedelta(1)
    return out


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 50).map(lambda i: D + timedelta(i))), st.sampled_from([0.0, 1.5, -2.0, None, float("nan")])), max_size=25))
def test_trailing_totals_brute(spark, data):
    df = spark.createDataFrame(data, "e string, d date, v double")
    got = {(r["e"], r["d"]): round(r["v_total_7d"], 6) for r in rolling.trailing_totals(df, "e", "d", ["v"], (7,)).collect()}
    assert got == brute_totals(data, 7)


def test_trailing_totals_columns(spark, rows):
    df = spark.createDataFrame([("a", D, 7.0, 1), ("a", D + timedelta(2), 14.0, 1)], "e string, d date, v double, _n int")
    out = rolling.trailing_totals(df, "e", "d", ["v"], (2,))
    assert rows(out, "d", "active", "v", "v_total_2d", "v_avg_2d") == [(D, True, 7.0, 7.0, 3.5), (D + timedelta(1), False, 0.0, 7.0, 3.5), (D + timedelta(2), True, 14.0, 14.0, 7.0)]
    assert rolling.trailing_totals(df.limit(0), "e", "d", ["v"]).count() == 0


def test_latest_rows_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 2, 6.0, 1), ("a", 2, 6.0, 1), ("b", 1, None, 1)], "k string, t int, v double, rn_ int")
    assert rows(rolling.latest_rows(df, ["k"], ["v"], "t")) == [("a", 6.0), ("b", None)]


# ---- spikes


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(7)
    out = []
    for k, src in enumerate(("a", "b")):
        for i in range(700):
            doy = (D + timedelta(i)).timetuple().tm_yday
            t = 15 - 12 * __import__("math").cos(doy / 365 * 6.283) + rng.gauss(0, 2)
            if 400 <= i < 405:  # a cold spell that builds up and goes
                t -= [8, 12, 14, 12, 8][i - 400]
            out.append([src, D + timedelta(i), round(t, 1), round(abs(rng.gauss(12, 2)), 1), round(rng.expovariate(0.3), 1) if rng.random() < 0.3 else 0.0])
    out[100][2], out[200][2], out[300][3], out[310][3], out[350][4], out[360][4] = 75.0, -25.0, 60.0, -3.0, 400.0, -1.0
    for i in (500, 501, 503, 504, 506):  # stuck, with days without a reading between
        out[i][2] = 9.9
    out[502][2], out[505][2] = None, float("nan")
    return spark.createDataFrame([tuple(r) for r in out], "c string, d date, TMAX double, WSF5 double, PRCP double")


def test_spikes(panel, rows):
    f = spikes.flag_readings(panel, "c", "d")
    day = lambda i: D + timedelta(i)
    assert rows(f.where("impossible"), "c", "d", "field") == sorted([("a", day(100), "TMAX"), ("a", day(310), "WSF5"), ("a", day(360), "PRCP")])
    assert rows(f.where("spike"), "c", "d", "field") == sorted([("a", day(200), "TMAX"), ("a", day(300), "WSF5"), ("a", day(350), "PRCP")])
    assert rows(f.where("stuck and c = 'a' and field = 'TMAX'"), "d") == [(day(i),) for i in (500, 501, 503, 504, 506)]
    assert f.where("stuck").count() == 5


def test_spikes_empty_and_short(spark, panel):
    assert spikes.flag_readings(panel.limit(0), "c", "d").count() == 0
    short = spikes.flag_readings(spark.createDataFrame([("a", D, 10.0, None, None), (None, D, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0, 1.0)], "c string, d date, TMAX double, WSF5 double, PRCP double"), "c", "d")
    assert [(r["field"], r["cutoff"], r["spike"]) for r in short.collect()] == [("TMAX", None, False)]


def test_stuck_needs_one_value_and_no_zero(spark):
    vals = [0.0] * 6 + [3.0] * 4 + [4.0] + [3.0] * 5
    df = spark.createDataFrame([("a", D + timedelta(i), v) for i, v in enumerate(vals)], "c string, d date, PRCP double")
    m = tuple(m for m in spikes.WEATHER_MEASURES if m.name == "PRCP")
    got = [r["d"] for r in spikes.flag_readings(df, "c", "d", m).where("stuck").collect()]
    assert sorted(got) == [D + timedelta(i) for i in range(11, 16)]


# ---- times


@pytest.fixture(scope="module")
def dims(spark):
    feeds = spark.createDataFrame([(1, "UTC", False), (2, "COUNTY", False), (3, "America/New_York", True), (4, None, None)], "feed_id int, unzoned_zone string, day_first boolean")
    places = spark.createDataFrame([("07001", "America/New_York"), ("43001", "America/Chicago"), ("00001", "America/Phoenix")], "fips_code string, tz string")
    return feeds, places


def utc(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp())


CASES = [
    (1, "7001", "2021-03-04 05:06:07", utc(2021, 3, 4, 5, 6, 7), date(2021, 3, 4)),
    (1, "FIPS:07001", "2021-03-04T02:00:00Z", utc(2021, 3, 4, 2), date(2021, 3, 3)),
    (2, " 43001 ", "2021/07/04 12:00", utc(2021, 7, 4, 17), date(2021, 7, 4)),
    (3, "1", "05/01/2019 03:30", utc(2019, 1, 5, 8, 30), date(2019, 1, 5)),
    (2, "07001", "05/01/2019 03:30 PM", utc(2019, 5, 1, 19, 30), date(2019, 5, 1)),
    (2, "07001", "1/1/2019 12:15 AM", utc(2019, 1, 1, 5, 15), date(2019, 1, 1)),
    (1, "07001", "1546708500", 1546708500, date(2019, 1, 5)),
    (1, "07001", "1546708500426", 1546708500, date(2019, 1, 5)),
    (2, "43001", "201901050430", utc(2019, 1, 5, 10, 30), date(2019, 1, 5)),
    (2, "43001", "20190105T134500Z", utc(2019, 1, 5, 13, 45), date(2019, 1, 5)),
    (2, "43001", "5 Jan 2019 10:45", utc(2019, 1, 5, 16, 45), date(2019, 1, 5)),
    (2, "43001", "Apr 10, 2019 07:00 PDT", utc(2019, 4, 10, 14), date(2019, 4, 10)),
    (2, "43001", "Fri, 01 Apr 2022 12:30:00 -0600", utc(2022, 4, 1, 18, 30), date(2022, 4, 1)),
    (2, "43001", "2019-01-01T08:15:00.887-08:00", utc(2019, 1, 1, 16, 15), date(2019, 1, 1)),
    (3, "43001", "31.12.2023 19:00:00", utc(2024, 1, 1), date(2023, 12, 31)),
]


@pytest.mark.parametrize("feed,code,text,second,day", CASES)
def test_time_forms(spark, dims, feed, code, text, second, day):
    df = spark.createDataFrame([(feed, code, text)], "feed_id int, fips_code string, run_start_time string")
    r = timestamps.normalise_times(df, "run_start_time", "feed_id", "fips_code", *dims).first()
    assert (r["time_status"], r["utc_second"], r["local_day"]) == ("ok", second, day)


def test_times_that_have_no_instant(spark, dims):
    bad = {"2021-11-07 01:30:00": "ambiguous", "2021-03-14 02:30:00": "nonexistent", "": "unreadable", None: "unreadable", "n/a": "unreadable", "2021-13-04T06:00:00Z": "unreadable", "2021-02-30 10:00:00": "unreadable", "2020-07-19T25:30:00Z": "unreadable", "2021-01-01 10:00 XYZ": "unreadable", "x" * 100_000: "unreadable"}
    df = spark.createDataFrame([(2, "07001", t, i) for i, t in enumerate(bad)], "feed_id int, fips_code string, run_start_time string, _p int")
    got = {r["run_start_time"]: (r["time_status"], r["utc_second"]) for r in timestamps.normalise_times(df, "run_start_time", "feed_id", "fips_code", *dims).collect()}
    assert got == {k: (v, None) for k, v in bad.items()}


YEARS = [(1750, 6, 1), (1899, 3, 4), (1901, 7, 4), (2101, 3, 4), (2102, 7, 4), (2150, 12, 31), (2400, 2, 29), (9998, 8, 1)]


def test_times_of_any_year(spark, dims):
    """As the zone database has them; beyond it by the rules of a year with the same calendar."""
    from zoneinfo import ZoneInfo

    zone = ZoneInfo("America/New_York")
    df = spark.createDataFrame([(2, "07001", f"{y:04d}-{m:02d}-{d:02d} 10:00:00", y) for y, m, d in YEARS] + [(1, "07001", f"{y:04d}-{m:02d}-{d:02d}T02:00:00Z", -y) for y, m, d in YEARS], "feed_id int, fips_code string, run_start_time string, k int")
    got = {r["k"]: (r["time_status"], r["utc_second"], r["local_day"]) for r in timestamps.normalise_times(df, "run_start_time", "feed_id", "fips_code", *dims).collect()}
    for y, m, d in YEARS:
        wall = datetime(y, m, d, 10, tzinfo=zone)
        second = int((wall.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() - wall.utcoffset().total_seconds())
        assert got[y] == ("ok", second, date(y, m, d)), y
        assert got[-y][0] == "ok" and got[-y][2] == date(y, m, d) - timedelta(1), y


def test_times_keys_and_clashes(spark, dims):
    df = spark.createDataFrame([(2, "99999", "1546708500", 1, "x"), (None, None, "1546708500", 2, "y"), (9, "07001", "2021-01-01 00:00:00", 3, "z")], "feed_id int, fips_code string, run_start_time string, _fid int, utc_second string")
    out = timestamps.normalise_times(df, "run_start_time", "feed_id", "fips_code", *dims)
    assert [(r["_fid"], r["time_status"]) for r in out.orderBy("_fid").collect()] == [(1, "unknown_place"), (2, "unknown_place"), (3, "unreadable")]
    assert timestamps.normalise_times(df.limit(0), "run_start_time", "feed_id", "fips_code", *dims).count() == 0


@FEW
@given(st.integers(utc(2015, 1, 1), utc(2030, 1, 1)), st.sampled_from(["America/New_York", "Europe/London", "Australia/Lord_Howe", "Asia/Kolkata"]))
def test_times_round_trip(spark, second, zone):
    from zoneinfo import ZoneInfo

    wall = datetime.fromtimestamp(second, ZoneInfo(zone))
    twice = wall.replace(fold=0).utcoffset() != wall.replace(fold=1).utcoffset()
    feeds = spark.createDataFrame([(1, zone, False)], "feed_id int, unzoned_zone string, day_first boolean")
    places = spark.createDataFrame([("00001", zone)], "fips_code string, tz string")
    df = spark.createDataFrame([(1, "1", wall.strftime("%Y-%m-%d %H:%M:%S"))], "f int, p string, t string")
    r = timestamps.normalise_times(df, "t", "f", "p", feeds, places).first()
    assert (r["time_status"], r["utc_second"]) == (("ambiguous", None) if twice else ("ok", second))


# ---- drift


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("fips_code", "fips"), ("fips_code", "FIPS"), ("customers_out", "cust_out"), ("customers_out", "sum"), (None, "x"), ("y", None)], "field string, seen_name string")


def test_rescue_and_replay(spark, names):
    payloads = ['{"fips":"FIPS:7001","cust_out":5,"note":"n"}', '{"FIPS":43001,"sum":[9],"extra":{"a":1}}', '{"fips_code":{"v":"00001 "},"customers_out":"many"}', '{"customers_out":51.0}', "not json", None, "{}", '["x"]']
    df = spark.createDataFrame([(i, p, "m") for i, p in enumerate(payloads)], "id int, payload string, _m string")
    t = drift.rescue_ingest(df, "payload", drift.names_of(names), {"fips_code": "fips", "customers_out": "bigint"})
    got = {r["id"]: (r["fips_code"], r["customers_out"], r["_rescued"], r["_m"]) for r in t.collect()}
    assert got[0] == ("07001", 5, '{"note":"n"}', "m")
    assert got[1] == ("43001", 9, '{"extra":{"a":1}}', "m")
    assert got[2] == ("00001", None, '{"customers_out":"many"}', "m")
    assert got[3][:3] == (None, 51, None)
    assert got[4][:3] == (None, None, '{"_payload":"not json"}') and got[5][:3] == (None, None, None) and got[6][:3] == (None, None, None)
    assert got[7][2] is not None
    again = {r["id"]: (r["note"], r["_rescued"]) for r in drift.replay(t, {"note": "string"}).collect()}
    assert again[0] == ("n", None) and again[1] == (None, '{"extra":{"a":1}}') and again[4] == (None, '{"_payload":"not json"}')
    assert drift.replay(drift.rescue_ingest(df.limit(0), "payload", {}), {"note": "string"}).count() == 0


def test_field_changes(spark, names, rows):
    files = [
        ("f1", 1, ['{"fips":"1","cust_out":1,"a":null}', '{"fips":"1"}', '{"fips":"1"}']),
        ("f2", 2, ['{"FIPS":"1","cust_out":1.0,"a":1}']),
        ("f3", 3, ['{"FIPS":1,"cust_out":2.5,"b":true}', "broken"]),
        ("f4", 4, ["broken"]),
    ]
    data = [("p", f, date(2024, 1, d), x) for f, d, xs in files for x in xs] + [("q", "g1", date(2024, 1, 1), "{}"), (None, "h", None, None)]
    df = spark.createDataFrame(data, "publisher string, file_name string, file_date date, payload string")
    got = rows(drift.field_changes(df, "publisher", "file_name", "file_date", "payload", names), "file_name", "field", "change")
    assert got == sorted([("f2", "fips_code", "renamed"), ("f2", "customers_out", "retyped"), ("f3", "fips_code", "retyped"), ("f3", "a", "removed"), ("f3", "b", "added"), ("f4", "fips_code", "removed"), ("f4", "customers_out", "removed"), ("f4", "b", "removed")])
    assert drift.field_changes(df.limit(0), "publisher", "file_name", "file_date", "payload", names).count() == 0


# ---- imputation


def test_fill_from_similar(spark):
    rng = random.Random(3)
    data = [(e, D + timedelta(i), base + rng.gauss(0, 0.5), base / 2 + rng.gauss(0, 0.5), z) for e, base, z in (("a", 10.0, "dry"), ("b", 30.0, "wet")) for i in range(120)]
    truth = {}
    rows_ = []
    for e, d, x, y, z in data:
        hide = rng.random() < 0.1
        truth[e, d] = x
        rows_.append((e, d, None if hide else x, y, None if rng.random() < 0.1 else z, 5))
    df = spark.createDataFrame(rows_, "e string, d date, x double, y double, z string, _cluster int")
    out = impute_groups.fill_from_similar(df, "e", "d", ["x", "y"], ["z"], k=4)
    got = out.collect()
    assert len(got) == 240 and all(r["x"] is not None and r["z"] == ("dry" if r["e"] == "a" else "wet") for r in got)
    filled = [r for r in got if r["x_fill"]]
    assert {(r["e"], r["d"]) for r in filled} == {(e, d) for e, d, x, *_ in rows_ if x is None}
    assert sum(abs(r["x"] - truth[r["e"], r["d"]]) for r in filled) / len(filled) < 1.5
    assert all(r["y_fill"] is None for r in got)


@pytest.mark.xfail(reason="measured: an error of 2.46 degrees against 1.81; clusters see the field itself where it is known (README)", strict=True)
def test_fill_beats_the_county_month(spark):
    """Of readings hidden from real data, the fill is nearer than the county's median of the month."""
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test data here")
    from pyspark.sql import Window

    from tempestry.plans import problems

    x = problems._features(spark, folder, ["AWND", "WSF2", "TMAX", "PRCP", "TMIN"])
    x = problems.written(x.select("county_fips", "day", *[F.when(~F.isnan(c) & F.col(c).between(-60, 60), F.col(c)).alias(c) for c in ("AWND", "WSF2", "TMAX", "PRCP", "TMIN")]))
    hide = (F.pmod(F.xxhash64("county_fips", "day"), F.lit(20)) == 0) & F.col("TMAX").isNotNull()
    known = x.withColumn("truth", F.when(hide, F.col("TMAX"))).withColumn("TMAX", F.when(~hide, F.col("TMAX")))
    w = Window.partitionBy("county_fips", F.month("day"))
    known = known.withColumn("plain", F.percentile("TMAX", 0.5).over(w))
    out = impute_groups.fill_from_similar(known, "county_fips", "day", ["AWND", "WSF2", "TMAX", "PRCP"], [], ["TMIN"])
    e = out.select("county_fips", "day", F.col("TMAX").alias("fill")).join(known.where("truth is not null"), ["county_fips", "day"]).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("fill") - F.col("truth"))).alias("a"), F.avg(F.abs(F.col("plain") - F.col("truth"))).alias("b")).first()
    print("hidden", e["n"], "error", e["a"], "of the county-month median", e["b"])
    assert e["n"] > 100 and e["a"] < e["b"]


def test_fill_nothing_there(spark):
    df = spark.createDataFrame([("a", D, None, None), ("b", D, None, "s"), (None, D, 1.0, "s")], "e string, d date, x double, z string")
    got = {r["e"]: (r["x"], r["x_fill"], r["z"], r["z_fill"]) for r in impute_groups.fill_from_similar(df, "e", "d", ["x"], ["z"], k=3).collect()}
    assert got["a"][:2] == (None, "unfilled") and got["a"][2] == "s" and got["b"][2:] == ("s", None) and len(got) == 2
    assert impute_groups.fill_from_similar(df.limit(0), "e", "d", ["x"], ["z"]).count() == 0


def test_usable_values(spark):
    df = spark.createDataFrame([(5.0, "oceanic"), (-1.0, ""), (999.9, "N/A"), (float("nan"), None), (114.0, " unknown ")], "w double, z string")
    got = [(r[0], r[1]) for r in df.select(impute_groups.usable_wind(F.col("w")), impute_groups.usable_name(F.col("z"))).collect()]
    assert got == [(5.0, "oceanic"), (None, None), (None, None), (None, None), (114.0, None)]


# ---- intervals


def ts(m):
    return datetime(2024, 1, 1) + timedelta(minutes=m)


def brute_periods(data):
    out = []
    for e in {x[0] for x in data if x[0] is not None}:
        end, start = None, None
        for s, t in sorted({(s, t) for k, s, t in data if k == e and s is not None and t is not None and t > s}):
            if end is None or s > end:
                if end is not None:
                    out.append((e, start, end))
                start, end = s, t
            end = max(end, t)
        if end is not None:
            out.append((e, start, end))
    return sorted(out)


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9000)), st.one_of(st.none(), st.integers(0, 9000))), max_size=30))
def test_periods_and_gaps_brute(spark, data):
    df = spark.createDataFrame([(e, None if s is None else ts(s), None if t is None else ts(t), "x") for e, s, t in data], "e string, s timestamp, t timestamp, _e string")
    want = brute_periods(data)
    got = sorted((r["e"], r["period_no"], r["period_start"], r["period_end"]) for r in intervals.periods(df, "e", "s", "t").collect())
    assert [(e, a, b) for e, _, a, b in got] == [(e, ts(a), ts(b)) for e, a, b in want]
    gaps = sorted((r["e"], r["gap_start"], r["gap_end"]) for r in intervals.gaps(df, "e", "s", "t").collect())
    assert gaps == [(x[0], ts(x[2]), ts(y[1])) for x, y in zip(want, want[1:]) if x[0] == y[0]]


def test_intervals_that_meet(spark):
    df = spark.createDataFrame([("a", ts(0), ts(10)), ("a", ts(10), ts(20)), ("a", ts(0), ts(10)), ("a", ts(30), ts(30))], "e string, s timestamp, t timestamp")
    assert intervals.gaps(df, "e", "s", "t").count() == 0
    assert [r["intervals"] for r in intervals.periods(df, "e", "s", "t").collect()] == [2]
    assert intervals.periods(df.limit(0), "e", "s", "t").count() == 0


# ---- pivots


def test_numbers(spark):
    cases = {"1.5": 1.5, " 2,5 ": 2.5, "+3": 3.0, "-1.5e+1": -15.0, "1E-1": 0.1, ".5": 0.5, "": None, "M": None, "NaN": None, "1.2.3": None, "--": None, "0x1": None, None: None, "1" * 5000: float("inf")}
    got = {r["v"]: r["x"] for r in spark.createDataFrame([(c,) for c in cases], "v string").select("v", blockpivot.number(F.col("v")).alias("x")).collect()}
    assert {k: v for k, v in got.items() if k is None or len(k) < 100} == {k: v for k, v in cases.items() if k is None or len(k) < 100}
    assert [r[0] for r in spark.createDataFrame([("y",), (" No ",), ("x",), (None,)], "v string").select(blockpivot.yes_no(F.col("v"))).collect()] == [1.0, 0.0, None, None]


@pytest.mark.parametrize("block", [2, 100])
def test_wide_table(spark, block):
    data = [("s", 1, "a", 1.0), ("s", 1, "a", 1.0), ("s", 1, "b", 2.0), ("s", 1, "b", 3.0), ("s", 2, "c", None), ("t", 1, "c", float("nan")), ("t", 1, "d", 4.0), (None, 1, "a", 1.0), ("t", 1, None, 1.0), ("t", 1, "station", 7.0), ("t", 1, "A", 8.0)]
    df = spark.createDataFrame(data, "station string, day int, k string, v double")
    w = blockpivot.wide_table(df, ["station", "day"], "k", "v", block=block)
    got = {(r["station"], r["day"]): r.asDict() for r in w.collect()}
    assert set(got) == {("s", 1), ("s", 2), ("t", 1)}
    assert got["s", 1]["a_"] == 1.0 and got["s", 1]["a__state"] == "ok" and got["s", 1]["b"] is None and got["s", 1]["b_state"] == "contested"
    assert got["s", 2]["c_state"] == "empty" and got["t", 1]["c_state"] == "empty" and got["t", 1]["d"] == 4.0 and got["t", 1]["station_"] == 7.0 and got["t", 1]["A"] == 8.0
    kinds = ["A", "a", "b", "c", "d", "station"]
    long = sorted((r["station"], r["day"], r["datatype"], r["state"]) for r in blockpivot.cell_states(w, ["station", "day"], kinds).collect())
    assert ("s", 1, "b", "contested") in long and ("t", 1, "station", "ok") in long and len(long) == 7


def test_wide_table_blocks_join_in_place(spark):
    """One scan and two shuffles (cells reduced, cells by entity), however many blocks."""
    df = spark.range(100).selectExpr("concat('s', id % 7) station", "id % 3 day", "concat('k', id % 9) k", "cast(id as double) v")
    for block in (1, 3, 9):
        plan = blockpivot.wide_table(df, ["station", "day"], "k", "v", [f"k{i}" for i in range(9)], block=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Range (") == 1


def test_wide_table_of_many_attributes(spark):
    df = spark.range(6_000).selectExpr("id % 40 station", "0 day", "concat('k', id % 600) k", "cast(id % 600 as double) v")
    w = blockpivot.wide_table(df, ["station", "day"], "k", "v", block=64)
    assert len(w.columns) == 2 + 2 * 600 and w.count() == 40
    r = w.where("station = 7").first()
    there = {i % 600 for i in range(6_000) if i % 40 == 7}
    assert {k for k in range(600) if r[f"k{k}"] is not None} == there and all(r[f"k{k}"] == k and r[f"k{k}_state"] == "ok" for k in there)


def test_wide_table_empty(spark):
    df = spark.createDataFrame([], "station string, day int, k string, v double")
    assert blockpivot.wide_table(df, ["station", "day"], "k", "v").count() == 0
    w = blockpivot.wide_table(df, ["station", "day"], "k", "v", [])
    assert blockpivot.cell_states(w, ["station", "day"], []).count() == 0
