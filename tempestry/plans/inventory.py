"""Queries for the operators that reference.py leaves out: codes, days, reading and writing, streams, selection, hold-out models."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.operators import clean, features, merge, metrics, ml, outages, profile, select_features, weather
from tempestry.plans.reference import CADENCE, CORR, DAILY, DAILY_SQL, KEY, MCC, MERGED, NAMES, NUMBERS, SESSIONS, SNAP, TYPES, WX, R, merged, query, snaps, union_sql, wx
from tempestry.sources import readers, sinks
from tempestry.session import list_files, put_text, rename, shared_folder, table, written
from tempestry.streaming import rollup

# ---- codes, days, texts ------------------------------------------------------------------------------------------------

CODE = "regexp_replace(regexp_replace(upper({c}), '\\s+', '', 'g'), '^FIPS:?', '')"
FIPS5 = "CASE WHEN regexp_matches({x}, '^[0-9]{1,5}$') THEN lpad({x}, 5, '0') END"


def fips_sql(c: str) -> str:
    return FIPS5.replace("{x}", CODE.replace("{c}", c))


@query(f"SELECT snapshot_id, {fips_sql('fips_code')} AS fips_code FROM outage_snapshots")
def f01_codes(spark, root):
    return table(spark, root, "outage_snapshots").select("snapshot_id", C.fips5(F.col("fips_code")).alias("fips_code"))


@query("""SELECT interval_id, CAST(timezone(coalesce(tz, 'America/New_York'), s) AS DATE) AS per_county, CAST(timezone('America/New_York', s) AS DATE) AS single, CAST(timezone('UTC', s) AS DATE) AS utc
FROM (SELECT interval_id, fips_code, make_timestamptz(epoch_us(run_start_time)) AS s FROM outage_intervals WHERE run_start_time IS NOT NULL) i LEFT JOIN counties USING (fips_code)""")
def o01_civil_days(spark, root):
    x = merge.with_dimension(table(spark, root, "outage_intervals").where("run_start_time is not null").select("interval_id", "fips_code", "run_start_time"), table(spark, root, "counties").select("fips_code", "tz"), ["fips_code"])
    modes = {"per_county": "per_county", "single": "single", "utc": "utc"}
    return x.select("interval_id", *[outages.civil_day(F.col("run_start_time"), F.col("tz"), m).alias(n) for n, m in modes.items()])


@query("""WITH h AS (SELECT interval_id, run_start_time AS s, unnest(['America/New_York', 'America/Chicago', 'Europe/London', 'Asia/Kolkata']) AS zone FROM outage_intervals WHERE run_start_time IS NOT NULL)
SELECT interval_id, zone, strftime(timezone(zone, make_timestamptz(epoch_us(s))), '%Y-%m-%d %H:%M:%S') AS wall FROM h""")
def f11_zone_conversion(spark, root):
    zones = F.explode(F.array(*[F.lit(z) for z in ("America/New_York", "America/Chicago", "Europe/London", "Asia/Kolkata")])).alias("zone")
    x = table(spark, root, "outage_intervals").where("run_start_time is not null").select("interval_id", "run_start_time", zones)
    wall = F.from_utc_timestamp("run_start_time", F.col("zone"))
    second = F.pmod(F.unix_seconds(wall), F.lit(86400)).cast("int")
    part = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    text = F.concat(C.utc_day(wall).cast("string"), F.lit(" "), part(F.floor(second / 3600)), F.lit(":"), part(F.floor(second / 60) % 60), F.lit(":"), part(second % 60))
    return x.select("interval_id", "zone", text.alias("wall"))


@query(f"WITH {WX} SELECT county_fips, CASE WHEN day(day) % 2 = 0 THEN day WHEN month(day) % 2 = 1 THEN day ELSE make_date(year(day), month(day), 15) END AS day, day AS known FROM wx")
def f10_reconstruct_day(spark, root):
    x = wx(spark, root).select("county_fips", F.col("day").alias("known"), F.when(F.dayofmonth("day") % 2 == 0, F.col("day").cast("string")).alias("day"), F.year("day").alias("year"), F.month("day").alias("month"), F.when(F.month("day") % 2 == 1, F.dayofyear("day")).alias("day_of_year"))
    return readers.reconstruct_day(x).select("county_fips", "day", "known")


@query(f"WITH {WX} SELECT county_fips, format('{{:.2f}}%', 100 * avg(CASE WHEN PRCP > 0 THEN 1.0 ELSE 0.0 END)) AS wet FROM wx GROUP BY 1")
def f20_percent_text(spark, root):
    return wx(spark, root).groupBy("county_fips").agg(sinks.percent_text(F.avg(C.flag(F.col("PRCP") > 0).cast("double"))).alias("wet"))


# ---- columns and checks ------------------------------------------------------------------------------------------------

NAMED = "SELECT column_name AS c, column_type AS t FROM (DESCRIBE weather_features)"
KINDS = "CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' WHEN 'DATE' THEN 'date' ELSE 'timestamp' END"


def names_df(spark: SparkSession, names: list[str], column: str = "column") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"`{column}` string")


@query(f"SELECT c AS \"column\" FROM ({NAMED}) WHERE t IN ('DOUBLE', 'INTEGER', 'BIGINT') AND c <> 'year'")
def p09_numeric_columns(spark, root):
    return names_df(spark, clean.numeric_columns(table(spark, root, "weather_features"), ("year",)))


@query(f"SELECT {KINDS} AS type, count(*)::INTEGER AS columns FROM ({NAMED}) GROUP BY 1")
def q02_dtypes(spark, root):
    return profile.dtype_counts(table(spark, root, "weather_features"))


@query(f"SELECT w AS \"column\", w IN (SELECT c FROM ({NAMED})) AS present FROM (SELECT unnest(['day', 'TMAX', 'SNOW', 'climate_zone', 'pct_out_max']) AS w)")
def q07_expected_columns(spark, root):
    return profile.expected_columns(table(spark, root, "weather_features"), ["day", "TMAX", "SNOW", "climate_zone", "pct_out_max"])


@query(f"SELECT c AS feature FROM ({NAMED}) WHERE t IN ('DOUBLE', 'INTEGER', 'BIGINT') AND c <> 'PRCP'")
def m01_candidates(spark, root):
    return names_df(spark, select_features.candidates(table(spark, root, "weather_features"), "PRCP"), "feature")


@query(None)
def a26_size(spark, root):
    return profile.size_estimate(table(spark, root, "weather_features"))


@query(f"WITH {WX} SELECT county_fips, day, coalesce(PRCP > 0, false)::INTEGER AS wet, coalesce(TMAX > 30, false)::INTEGER AS hot FROM wx")
def i13_booleans(spark, root):
    return clean.booleans_to_int(wx(spark, root).select(*KEY, (F.col("PRCP") > 0).alias("wet"), (F.col("TMAX") > 30).alias("hot")))


@query(f"WITH {WX} SELECT 'filled' AS step, true AS passed UNION ALL SELECT 'filtered', count(*) = count(TMAX) FROM wx UNION ALL SELECT 'one class', count(DISTINCT CASE WHEN PRCP > 1000 THEN 1 ELSE 0 END) > 1 FROM wx")
def i14_checks(spark, root):
    x = wx(spark, root).withColumns({"y": C.flag(F.col("PRCP") > 1), "z": C.flag(F.col("PRCP") > 1000)})
    rows = []
    for name, after, label in (("filled", clean.fill_constant(x, ["TMAX"], 0.0), "y"), ("filtered", x.where("TMAX is not null"), "y"), ("one class", x, "z")):
        try:
            clean.check_same(x, after, label)
            rows.append((name, True))
        except AssertionError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "step string, passed boolean")


@query(f"WITH {WX}, d AS ({union_sql(NUMBERS + TYPES, 'SELECT {q}{c}{q} AS col, count(DISTINCT {c}) AS n FROM wx'.replace('{q}', chr(39)))}) SELECT col AS \"column\" FROM d WHERE n <= 1")
def i15_constant_columns(spark, root):
    return names_df(spark, clean.constant_columns(wx(spark, root).select(*NUMBERS, *TYPES)))


@query(f"WITH {WX} SELECT coalesce(TMAX, 0)::DOUBLE AS TMAX, coalesce(WSF2, 0)::DOUBLE AS WSF2, climate_zone, count(*) AS n FROM wx GROUP BY 1, 2, 3")
def i16_features_and_target(spark, root):
    return clean.features_and_target(wx(spark, root), ["TMAX", "WSF2"], "climate_zone").groupBy("TMAX", "WSF2", "climate_zone").agg(F.count(F.lit(1)).alias("n"))


CAPS = ", ".join(f"quantile_cont({c}, 0.25) AS l{c}, quantile_cont({c}, 0.75) AS h{c}, min({c}) AS a{c}, max({c}) AS b{c}" for c in NUMBERS)


@query(f"WITH {WX}, q AS (SELECT {CAPS} FROM wx), e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, a{c} AS a, b{c} AS b, greatest(a{c}, l{c} - 1.5 * (h{c} - l{c})) AS a2, least(b{c}, h{c} + 1.5 * (h{c} - l{c})) AS b2 FROM q" for c in NUMBERS) + f") SELECT col AS \"column\", {R('a', 'min_before')}, {R('b', 'max_before')}, {R('a2', 'min_after')}, {R('b2', 'max_after')} FROM e WHERE a <> a2 OR b <> b2")
def q27_capping(spark, root):
    x = wx(spark, root)
    return profile.changed_by_capping(x, clean.cap_outliers(x, NUMBERS), NUMBERS)


# ---- outages -----------------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY.replace('max(customers_out) AS customers_out,', 'max(customers_out) AS customers_out, max(customers_total) AS raw_total,').replace('LEFT JOIN m USING (fips_code)', '').replace('customers_total > 0', 'raw_total > 0').replace('/ customers_total', '/ raw_total').replace('(customers_total * mins)', '(raw_total * mins)').replace('AS pct_out_area, customers_total, tz', 'AS pct_out_area, raw_total AS customers_total, tz')} {DAILY_SQL.replace(' FROM daily', ', customers_total FROM daily')}")
def a05_delivered_denominators(spark, root):
    x = outages.daily_outages(snaps(spark, root), table(spark, root, "counties"), None)
    return x.select(*outages.DAILY_COLUMNS, "customers_total")


@query(f"WITH {SNAP}, {CADENCE}, {SESSIONS} SELECT fips_code, CAST(make_timestamptz(utc_second * 1000000) AT TIME ZONE 'UTC' AS DATE) AS day, max(CASE WHEN customers_out > 0 THEN 1 ELSE 0 END)::INTEGER AS any_out, (15 * count(*) FILTER (customers_out > 0))::BIGINT AS minutes_out, max(customers_out) AS customers_out, coalesce(sum(customers_out * 15), 0)::BIGINT AS cust_minute_area FROM snap GROUP BY 1, 2")
def s15_daily_stream(spark, root):
    """The daily rollup as a stream over files, run until all are taken; the whole result table replaces the last one."""
    source, target = shared_folder(spark, "stream"), shared_folder(spark, "stream")
    x = snaps(spark, root).select("fips_code", "ts", "customers_out")
    x.repartition(3).write.parquet(source)
    out = rollup.daily_stream(rollup.snapshot_stream(spark, source, x.schema, 1), 15)
    run = out.writeStream.outputMode("complete").option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


@query(f"WITH {SNAP}, p AS (SELECT *, lag(utc_second) OVER (PARTITION BY fips_code ORDER BY utc_second) AS pt FROM snap WHERE customers_out > 0), e AS (SELECT *, sum(CASE WHEN pt IS NULL OR utc_second - pt > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY fips_code ORDER BY utc_second ROWS UNBOUNDED PRECEDING) AS e FROM p) SELECT fips_code, min(utc_second)::BIGINT AS first_second, max(utc_second)::BIGINT + 1800 AS end_second, count(*) AS snapshots, max(customers_out) AS peak FROM e GROUP BY fips_code, e")
def s15_session_stream(spark, root):
    """The sessions as a stream; in append mode a session comes out when the watermark has passed it, so a last file of far later
    snapshots (left out of the result) closes them all."""
    source, target = shared_folder(spark, "stream"), shared_folder(spark, "stream")
    x = snaps(spark, root).select("fips_code", "ts", "customers_out")
    x.coalesce(1).write.parquet(f"{source}/a")
    for year in (2200, 2201):
        spark.sql(f"SELECT 'end' AS fips_code, TIMESTAMP'{year}-01-01 00:00:00' AS ts, 1L AS customers_out").write.mode("append").parquet(f"{source}/b")
    out = rollup.session_stream(rollup.snapshot_stream(spark, f"{source}/*", x.schema, 1), late="3650 days")
    run = out.writeStream.outputMode("append").option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).format("parquet").start(target)
    run.awaitTermination()
    got = spark.read.schema(out.schema).parquet(target).where("fips_code <> 'end'")
    return got.select("fips_code", F.unix_seconds("session_start").alias("first_second"), F.unix_seconds("session_end").alias("end_second"), "snapshots", "peak")


# ---- reading and writing -----------------------------------------------------------------------------------------------


@query(f"WITH {WX} SELECT county_fips, day, {R('TMAX', 'TMAX')} FROM wx")
def s05_csv_columns(spark, root):
    """Written as CSV (S15), read again with three of its columns."""
    path = f"{shared_folder(spark)}.csv"
    sinks.to_csv(wx(spark, root), path)
    return readers.read_any(spark, path, [*KEY, "TMAX"]).select("county_fips", F.col("day").cast("date").alias("day"), F.col("TMAX").cast("double").alias("TMAX"))


@query(f"WITH {WX} SELECT county_fips, day, climate_zone FROM wx")
def s14_json(spark, root):
    path = f"{shared_folder(spark)}.json"
    sinks.to_json(wx(spark, root).select(*KEY, "climate_zone"), path)
    return readers.read_any(spark, path, [*KEY, "climate_zone"]).withColumn("day", F.col("day").cast("date"))


@query(f"WITH {WX} SELECT county_fips, day, {R('PRCP', 'PRCP')}, year FROM wx WHERE year >= 2022")
def s07_parquet_partitions(spark, root):
    """Written by year (S16); the years asked for are the only folders read."""
    path = f"{shared_folder(spark)}.parquet"
    sinks.to_parquet(wx(spark, root).select(*KEY, "PRCP", "year"), path, ["year"])
    return readers.read_any(spark, path, [*KEY, "PRCP", "year"]).where("year >= 2022")


@query(f"SELECT c AS \"column\", {KINDS} AS type FROM ({NAMED})")
def s08_probe(spark, root):
    return spark.createDataFrame(readers.probe(spark, f"{root}/weather_features.parquet"), "column string, type string")


@query(f"SELECT {fips_sql('fips_code')} AS fips_code, customers_out, customers_total, count(*) AS n FROM outage_snapshots WHERE {fips_sql('fips_code')} IN (SELECT fips_code FROM counties WHERE climate_zone = 'arid' OR fips_code < '30000') GROUP BY 1, 2, 3")
def s06_snapshots_of_counties(spark, root):
    """Snapshots delivered under other column names, as CSV, of some counties."""
    path = f"{shared_folder(spark)}.csv"
    c = table(spark, root, "counties")
    sinks.to_csv(table(spark, root, "outage_snapshots").select(F.col("fips_code").alias("County_FIPS"), F.col("customers_out").alias("sum"), F.col("run_start_time").alias("RUN_TIME"), F.col("customers_total").alias("Customers")), path)
    places = [r[0] for r in c.where("climate_zone = 'arid' or fips_code < '30000'").select("fips_code").collect()]  # one row a county asked for
    return readers.snapshots(spark, path, places).groupBy("fips_code", "customers_out", "customers_total").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT year(day)::INTEGER AS year, count(*) AS n FROM weather_features GROUP BY 1")
def s09_yearly_files(spark, root):
    """A file a year, told by its name; other names are passed over."""
    folder = shared_folder(spark)
    x = table(spark, root, "weather_features").select("county_fips", "day")
    years = profile.years_of(x, "day")
    for y in years:
        sinks.to_csv(x.where(F.year("day") == y), f"{folder}/outages_daily_{y}.csv")
    sinks.to_csv(x, f"{folder}/outages_daily_combined_2020.csv")
    files = readers.yearly_files(spark, folder)
    parts = [readers.read_any(spark, p).groupBy().agg(F.lit(y).alias("year"), F.count(F.lit(1)).alias("n")) for y, p in files.items()]
    return weather.union_by_name(parts)


@query("SELECT s.fips_code, year(day)::INTEGER AS year, c.state, c.climate_zone, count(*) AS n, sum(CASE WHEN year(day) > 2022 THEN 1 ELSE 0 END)::BIGINT AS with_wind FROM (SELECT county_fips AS fips_code, day FROM weather_features) s LEFT JOIN counties c USING (fips_code) GROUP BY 1, 2, 3, 4")
def s10_county_years(spark, root):
    """A file a county and year, whose columns differ between years, as one table with the county's columns."""
    folder = shared_folder(spark)
    x = table(spark, root, "weather_features").select("county_fips", "day", F.lit("1").alias("AWND"))
    pairs = sorted((r[0], r[1]) for r in x.select("county_fips", F.year("day")).distinct().limit(2_000).collect())  # files to write
    files = []
    for code, y in pairs:
        part = x.where((F.col("county_fips") == code) & (F.year("day") == y)).drop("county_fips")
        path = f"{folder}/weather_{code}_{y}"
        (part if y > 2022 else part.drop("AWND")).coalesce(1).write.csv(path, header=True)
        [made] = [f for f in list_files(spark, path) if f.endswith(".csv")]
        rename(spark, made, f"{folder}/all/weather_{code}_{y}.csv")
        files.append(f"{folder}/all/weather_{code}_{y}.csv")
    dim = table(spark, root, "counties").select("fips_code", "state", "climate_zone")
    got = readers.county_years(spark, files, dim)
    wind = F.col("AWND") if "AWND" in got.columns else F.lit(None)
    return got.groupBy("fips_code", "year", "state", "climate_zone").agg(F.count(F.lit(1)).alias("n"), F.count(wind).alias("with_wind"))


@query("SELECT unnest(['best', 'all', 'explicit']) AS asked, unnest(['weather_capped.parquet', 'counties.csv weather_capped.parquet', 'x.csv']) AS files")
def s11_resolve(spark, root):
    folder = shared_folder(spark)
    sinks.to_parquet(table(spark, root, "weather_features").select("day"), f"{folder}/weather_capped.parquet")
    sinks.to_csv(table(spark, root, "counties").select("fips_code"), f"{folder}/counties.csv")
    name = lambda fs: " ".join(f.rsplit("/", 1)[-1] for f in fs)
    rows = [("best", name(readers.resolve_dataset(spark, folder))), ("all", name(readers.resolve_dataset(spark, folder, names=("none",)))), ("explicit", name(readers.resolve_dataset(spark, folder, "x.csv")))]
    return spark.createDataFrame(rows, "asked string, files string")


@query(f"WITH {MCC} SELECT * FROM m")
def s12_denominators(spark, root):
    path = f"{shared_folder(spark)}.csv"
    sinks.to_csv(table(spark, root, "mcc").select(F.col("county_fips").alias("County_FIPS"), F.col("customers").alias("Customers")), path)
    return readers.customer_denominators(spark, path)


@query("SELECT id, name, latitude, longitude, elevation, \"elevationUnit\", CAST(mindate AS DATE) AS mindate, CAST(maxdate AS DATE) AS maxdate, datacoverage FROM stations")
def s03_stations(spark, root):
    """The metadata file is one JSON array of all stations: a dimension, of some thousands."""
    path = f"{shared_folder(spark)}.json"
    x = table(spark, root, "stations").select("id", "name", "latitude", "longitude", "elevation", "elevationUnit", "mindate", "maxdate", "datacoverage")
    put_text(spark, path, json.dumps([r.asDict() for r in x.collect()], default=str))
    return readers.stations(spark, path)


@query(f"WITH {WX} SELECT county_fips, day, {R('TMAX', 'TMAX')}, {R('WSF2', 'WSF2')} FROM wx")
def s18_selected_features(spark, root):
    return readers.selected_features(wx(spark, root), ["TMAX", "WSF2", "county_fips"], KEY)


@query("SELECT count(*) + 7 AS lines, count(*) + 1 AS rows FROM counties")
def s17_report(spark, root):
    """A report and its facts, written and read again."""
    folder = shared_folder(spark)
    sinks.report({"Counties": table(spark, root, "counties").select("fips_code", "name")}, f"{folder}/report.md", "Profile")
    x = spark.read.text(f"{folder}/report.md")
    return x.agg((F.count(F.lit(1)) + 1).alias("lines"), (F.count_if(F.startswith("value", F.lit("| "))) - 1).alias("rows"))


class _Pages(BaseHTTPRequestHandler):
    """A paged service over the records of the server: every first request of a page fails with 503."""

    def do_GET(self) -> None:
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        key = (q.get("part"), q.get("offset"))
        if key not in self.server.seen:
            self.server.seen.add(key)
            self.send_response(503)
            self.end_headers()
            return
        rows = [r for i, r in enumerate(self.server.records) if str(i % 3) == q.get("part")]
        at, n = int(q["offset"]), int(q["limit"])
        body = json.dumps({"metadata": {"resultset": {"count": len(rows)}}, "results": rows[at - 1 : at - 1 + n]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_: object) -> None:
        return


@query("SELECT id, latitude FROM stations")
def s01_paged_service(spark, root):
    """Stations served in pages by a small server on the driver; one part of three has no result and falls back to another query."""
    records = [{"id": r["id"], "latitude": r["latitude"]} for r in table(spark, root, "stations").select("id", "latitude").collect()]  # what the service holds
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), _Pages)
    server.records, server.seen = records, set()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        readers.register(spark)
        x = spark.read.format("paged_json").option("url", f"http://{host}:{server.server_port}/").option("queries", "part=0|part=1|part=9>part=2").option("limit", 7).option("pause", 0.001).load()
        got = x.select(F.from_json("record", "id string, latitude double").alias("r")).select("r.*")
        return written(got)
    finally:
        server.shutdown()


# ---- selection ---------------------------------------------------------------------------------------------------------

LONG = ["AWND", "PRCP", "TMAX", "TMIN", "WSF5"]


@query(f"WITH {WX}, c AS ({' UNION ALL '.join(f'SELECT county_fips, {chr(39)}{f}{chr(39)} AS feature, {CORR(f, chr(87) + chr(83) + chr(70) + chr(50))} AS r, count(*) FILTER ({f} IS NOT NULL AND WSF2 IS NOT NULL) AS n FROM wx GROUP BY 1' for f in LONG)}) SELECT county_fips, feature, {R('r', 'r')}, n, rank_no::INTEGER AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY county_fips ORDER BY abs(r) DESC, feature) AS rank_no FROM c WHERE r IS NOT NULL AND n >= 3) WHERE rank_no <= 3")
def m12_top_by_county(spark, root):
    return select_features.top_features_by_group(wx(spark, root), "county_fips", LONG, "WSF2", 3)


MANY = [*NUMBERS, *[f"{c}_lag" for c in NUMBERS]]
MANY_SQL = f"wl AS (SELECT *, {', '.join(f'lag({c}) OVER (PARTITION BY county_fips ORDER BY day) AS {c}_lag' for c in NUMBERS)} FROM wx)"
MANY_PAIRS = [(a, b) for i, a in enumerate(MANY) for b in MANY[i + 1 :]]
MANY_R = "mr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, {CORR(a, b)} AS r FROM wl" for i, a in enumerate(MANY) for j, b in enumerate(MANY) if i < j) + ")"


def with_lags(spark, root) -> DataFrame:
    w = C.ordered(["county_fips"], ["day"])
    return wx(spark, root).withColumns({f"{c}_lag": F.lag(c).over(w) for c in NUMBERS})


@query(f"WITH {WX}, {MANY_SQL}, {MANY_R} SELECT a, b, {R('r', 'r')} FROM mr")
def a14_many_columns(spark, root):
    return profile.correlations(with_lags(spark, root), MANY)


@query(f"WITH {WX}, {MANY_SQL}, {MANY_R} SELECT f AS feature FROM (SELECT unnest({MANY}) AS f) WHERE f NOT IN (SELECT b FROM mr WHERE abs(r) > 0.5)")
def m03_uncorrelated(spark, root):
    return names_df(spark, select_features.correlation_filter(with_lags(spark, root), MANY, 0.5), "feature")


@query(f"WITH {WX}, {MANY_SQL}, v AS ({union_sql(MANY, 'SELECT {q}{c}{q} AS feature, var_pop({c}) AS v FROM wl'.replace('{q}', chr(39)))}) SELECT feature FROM v WHERE v > 9")
def m02_varied(spark, root):
    return names_df(spark, select_features.variance_filter(with_lags(spark, root), MANY, 9.0), "feature")


@query(f"""WITH RECURSIVE {WX}, {MANY_SQL}, {MANY_R}, f AS (SELECT i, fam, name, row_number() OVER (PARTITION BY fam ORDER BY i) AS k FROM (SELECT unnest(range({len(MANY)})) AS i, unnest({MANY}) AS name), (VALUES ('precip', 'prcp'), ('wind', 'wsf|awnd|wind'), ('temp', 'tmax|tmin')) v(fam, pat) WHERE regexp_matches(lower(name), pat)),
h AS (SELECT x.fam, x.k AS a, y.k AS b FROM f x JOIN f y ON x.fam = y.fam AND x.i < y.i JOIN mr ON mr.i = x.i AND mr.j = y.i AND abs(mr.r) >= 0.5),
g AS (SELECT fam, 0 AS k, []::BIGINT[] AS kept FROM f GROUP BY 1 UNION ALL SELECT g.fam, g.k + 1, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.fam = g.fam AND h.b = g.k + 1 AND list_contains(g.kept, h.a)) THEN g.kept ELSE list_append(g.kept, (g.k + 1)::BIGINT) END FROM g WHERE g.k < (SELECT max(k) FROM f WHERE f.fam = g.fam)),
z AS (SELECT fam, kept FROM g WHERE k = (SELECT max(k) FROM f WHERE f.fam = g.fam))
SELECT f.fam AS family, f.name AS feature, list_contains(z.kept, f.k) AS kept, CASE WHEN NOT list_contains(z.kept, f.k) THEN (SELECT p.name FROM h JOIN f p ON p.fam = h.fam AND p.k = h.a WHERE h.fam = f.fam AND h.b = f.k AND list_contains(z.kept, h.a) ORDER BY p.k LIMIT 1) END AS because_of FROM f JOIN z USING (fam)""")
def m10_family_plan(spark, root):
    return select_features.family_plan(with_lags(spark, root), select_features.by_family(MANY), 0.5)


LAGGED = [*features.GROUPS["raw"], *features.GROUPS["lag"]]
LAGGED_SQL = "lg AS (SELECT county_fips, day, climate_zone, " + ", ".join([*features.GROUPS["raw"], *[f"lag({c}, {k}) OVER (PARTITION BY county_fips ORDER BY day) AS {c}_lag{k}d" for c, ks in features.LAGS.items() for k in ks]]) + " FROM wx)"
CHOSEN = f"""ch AS (SELECT 'variance' AS method, f AS feature FROM ({union_sql(LAGGED, 'SELECT {q}{c}{q} AS f, var_pop({c}) AS v FROM lg'.replace('{q}', chr(39)))}) WHERE v > 0.01
UNION ALL SELECT 'correlation', f FROM (SELECT unnest({LAGGED}) AS f) WHERE f NOT IN (SELECT b FROM ({' UNION ALL '.join(f"SELECT '{b}' AS b, {CORR(a, b)} AS r FROM lg" for i, a in enumerate(LAGGED) for b in LAGGED[i + 1 :])}) WHERE abs(r) > 0.95)
UNION ALL (SELECT 'f', f FROM ({' UNION ALL '.join(f"SELECT '{a}' AS f, {CORR(a, 'WSF5')} AS r, count(*) FILTER ({a} IS NOT NULL AND WSF5 IS NOT NULL) AS n FROM lg" for a in LAGGED if a != 'WSF5')}) WHERE r IS NOT NULL ORDER BY r * r * (n - 2) / (1 - r * r) DESC, f LIMIT 8))"""


@query(f"WITH {WX}, {LAGGED_SQL}, {CHOSEN} SELECT feature, count(DISTINCT method) AS methods FROM ch GROUP BY 1 HAVING count(DISTINCT method) >= 2")
def m08_consensus(spark, root):
    """What at least two of three real selections on the weather and its lags agree on."""
    x = features.engineer(wx(spark, root), "county_fips", "day")
    best = select_features.top_features(select_features.f_regression(x, [f for f in LAGGED if f != "WSF5"], "WSF5"), "f", 8)
    chosen = {"variance": select_features.variance_filter(x, LAGGED), "correlation": select_features.correlation_filter(x, LAGGED), "f": [r["feature"] for r in best.collect()]}
    return select_features.consensus(select_features.selections_of(x, chosen))


CATALOGUE = list(dict.fromkeys([*NAMES, *(f for fs in features.GROUPS.values() for f in fs)]))
KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with(f, '{p[:-1]}')" if p.endswith("*") else f"contains(f, '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in select_features.KINDS) + " ELSE 'other' END"


@query(f"SELECT f AS feature, {KIND_SQL} AS kind FROM (SELECT unnest({CATALOGUE}) AS f)")
def m09_kinds(spark, root):
    return names_df(spark, CATALOGUE, "feature").select("feature", select_features.categorise(F.col("feature")).alias("kind"))


MI = ["WSF2", "PRCP", "TMAX"]


@query(None)
def m06_mutual_information(spark, root):
    return select_features.mutual_information(merged(spark, root), MI, "any_out")


@query("SELECT CAST(NULL AS VARCHAR) AS feature LIMIT 0")
def m13_registry_gaps(spark, root):
    """Features of the registry without metadata, or the other way round: none."""
    known = {f for fs in features.GROUPS.values() for f in fs}
    meta = {r["feature"] for r in features.registry(spark).collect()}
    return names_df(spark, sorted(known ^ meta), "feature")


# ---- models ------------------------------------------------------------------------------------------------------------

CLASS = "CASE WHEN PRCP > 1 THEN 1 ELSE 0 END"


@query(f"WITH {WX}, c AS (SELECT {CLASS} AS y, count(*) AS n FROM wx GROUP BY 1) SELECT y, 'train' AS split, floor(n * 0.8 + 0.5)::BIGINT AS n FROM c UNION ALL SELECT y, 'test', n - floor(n * 0.8 + 0.5)::BIGINT FROM c")
def l02_stratified_split(spark, root):
    x = wx(spark, root).select(*KEY, C.flag(F.col("PRCP") > 1).alias("y"))
    return ml.stratified_split(x, "y", KEY).groupBy("y", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WX} SELECT {CLASS} AS y, count(*) AS n, 5::BIGINT AS folds, true AS even FROM wx GROUP BY 1")
def l07_stratified_folds(spark, root):
    """Rows and folds of each class; even: no fold is further from a fifth than five deviations of chance."""
    x = ml.stratified_folds(wx(spark, root).select(*KEY, C.flag(F.col("PRCP") > 1).alias("y")), "y", KEY)
    g = x.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("c")).groupBy("y").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("folds"), F.max(F.abs(F.col("c"))).alias("_most"), F.min("c").alias("_least"))
    slack = 5 * F.sqrt(F.col("n") * 0.16)
    return g.select("y", "n", "folds", ((F.col("_most") <= F.col("n") / 5 + slack) & (F.col("_least") >= F.col("n") / 5 - slack)).alias("even"))


RATES = [0.00001, 0.0001, 0.001, 0.01, 0.05]


@query(f"WITH {WX}, {DAILY}, {MERGED}, t AS (SELECT unnest({RATES}) AS threshold), r AS (SELECT county_fips, threshold, avg(CASE WHEN pct_out_max >= threshold THEN 1.0 ELSE 0.0 END) AS ratio FROM mg, t GROUP BY 1, 2) SELECT county_fips, threshold::DOUBLE AS threshold, {R('ratio', 'ratio')} FROM (SELECT *, row_number() OVER (PARTITION BY county_fips ORDER BY abs(0.5 - ratio), threshold) AS k FROM r) WHERE k = 1")
def l13_county_threshold(spark, root):
    return profile.closest_to_half(merged(spark, root), "county_fips", "pct_out_max", RATES)


WEATHER = ["TMIN", "WSF2", "AWND", "WSF5"]


def halves(spark, root) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, training, held out) days with their TMAX, its class y (over the median or not) and the features, capped at their fences:
    every fourth week is held out."""
    x = wx(spark, root).where("TMAX is not null and TMIN is not null")
    x = ml.prepared(clean.cap_outliers(x, [*WEATHER, "TMAX"]), WEATHER, [*KEY, "TMAX"])
    x = ml.quantile_label(x, "TMAX", 0.5).withColumnRenamed("severe", "y")
    x = written(x)
    out = F.pmod(F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 7), F.lit(4)) == 3
    return x, x.where(~out), x.where(out)


@query("SELECT unnest(['chance beaten', 'sorted by f1', 'thresholds']) AS what, unnest([true, true, true]) AS holds")
def l14_threshold_models(spark, root):
    """A model for each candidate threshold (the quartiles and the median of TMAX), judged on the days held out."""
    _, train, test = halves(spark, root)
    q = ml.exact_quantiles(train.select("TMAX"), [], "TMAX", [0.25, 0.5, 0.75]).first()["q"]
    got = ml.threshold_models(train, test, "TMAX", q, WEATHER)
    rows = [("chance beaten", all(r["roc_auc"] > 0.5 for r in got)), ("sorted by f1", [r["f1"] for r in got] == sorted((r["f1"] for r in got), reverse=True)), ("thresholds", {r["threshold"] for r in got} <= set(q) and len(got) > 0)]
    return spark.createDataFrame(rows, "what string, holds boolean")


def _holds(spark, rows: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in rows.items()], "what string, holds boolean")


def holds_sql(*names: str) -> str:
    return f"SELECT unnest({list(names)}) AS what, true AS holds"


def judged(spark, root, make) -> DataFrame:
    """A balanced classifier of warm days, judged on the weeks held out."""
    _, train, test = halves(spark, root)
    train = ml.with_weights(train, "y")
    model = ml.Pipeline(stages=[*ml.assembled(WEATHER), make(train)]).fit(train)
    r = metrics.ranking(ml.positive_probability(model.transform(test)), "y", "score").first()
    return _holds(spark, {"held-out auc over 0.5": r["roc_auc"] > 0.5, "average precision over prevalence": r["average_precision"] > r["positives"] / (r["positives"] + r["negatives"])})


JUDGED = ("held-out auc over 0.5", "average precision over prevalence")


@query(holds_sql(*JUDGED))
def l03_logistic(spark, root):
    return judged(spark, root, lambda train: ml.logistic("y", 1.0, train.agg(F.sum("weight")).first()[0] or 1.0))


@query(holds_sql(*JUDGED))
def l10_random_forest(spark, root):
    return judged(spark, root, lambda _: ml.estimator("rf", "y", numTrees=20, maxDepth=6, seed=42))


@query(holds_sql(*JUDGED))
def l11_boosting(spark, root):
    return judged(spark, root, lambda _: ml.estimator("gbt", "y", maxIter=10, maxDepth=4, seed=42))


@query(holds_sql("held-out error under the deviation", "penalty shrinks the coefficients"))
def l09_elastic_net(spark, root):
    """Scaled features, both penalties; judged on the weeks held out."""
    _, train, test = halves(spark, root)
    fit = lambda reg: ml.Pipeline(stages=[*ml.assembled(["TMIN", "WSF2", "AWND"], scale=True), ml.estimator("elastic_net", "TMAX", None, regParam=reg, elasticNetParam=0.5)]).fit(train)
    small_, large = fit(0.01), fit(5.0)
    r = metrics.regression(small_.transform(test), "TMAX", "prediction").first()
    sd = test.agg(F.stddev_pop("TMAX")).first()[0]
    size = lambda m: sum(abs(c) for c in m.stages[-1].coefficients.toArray())
    return _holds(spark, {"held-out error under the deviation": r["rmse"] < sd, "penalty shrinks the coefficients": size(large) < size(small_)})


@query(holds_sql("adds up to 1", "all features there", "strongest first"))
def m07_forest_importance(spark, root):
    x, _, _ = halves(spark, root)
    model = ml.Pipeline(stages=[*ml.assembled(WEATHER), ml.estimator("rf", "y", None, numTrees=20, maxDepth=6, seed=42)]).fit(x)
    got = ml.importances(model.stages[-1], WEATHER)
    return _holds(spark, {"adds up to 1": abs(sum(v for _, v in got) - 1) < 1e-9, "all features there": {f for f, _ in got} == set(WEATHER), "strongest first": [v for _, v in got] == sorted((v for _, v in got), reverse=True)})


@query(holds_sql("log loss under that of the shares", "three probabilities that add up to 1"))
def l04_multinomial(spark, root):
    """Three classes of warmth, log loss on the weeks held out."""
    x, train, test = halves(spark, root)
    low, high = ml.exact_quantiles(x.select("TMAX"), [], "TMAX", [0.33, 0.67]).first()["q"]
    train, test = (d.withColumn("c", ml.severity(F.col("TMAX") - low, high - low)) for d in (train, test))
    n = train.count()
    model = ml.Pipeline(stages=[*ml.assembled(WEATHER), ml.logistic("c", 1.0, float(n), weight=None, multinomial=True)]).fit(train)
    p = model.transform(test).withColumn("_p", ml.vector_to_array("probability")).withColumns({f"p{i}": F.col("_p")[i] for i in range(3)})
    share = {r["c"]: r["n"] / n for r in train.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    flat = p.withColumns({f"p{i}": F.lit(share.get(i, 0.0)) for i in range(3)})
    names = ["p0", "p1", "p2"]
    a, b = (metrics.log_loss(d, "c", names).first()["log_loss"] for d in (p, flat))
    sums = p.agg(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1))).first()[0]
    return _holds(spark, {"log loss under that of the shares": a < b, "three probabilities that add up to 1": sums < 1e-6})


@query(holds_sql("best first", "all settings scored", "refitted on all rows", "held-out auc over 0.5"))
def l05_search(spark, root):
    """Settings drawn from a grid, scored on stratified folds by two metrics, the best fitted anew."""
    _, train, test = halves(spark, root)
    train = ml.stratified_folds(train, "y", KEY, 3)
    n = float(train.count())
    settings = ml.sampled_grid({"c": [0.01, 1.0, 100.0], "l1": [False, True]}, 2)
    model, ranked = ml.search(train, lambda s: ml.logistic("y", s["c"], n, s["l1"], weight=None), settings, WEATHER, "y")
    r = metrics.ranking(ml.positive_probability(model.transform(test)), "y", "score").first()
    aps = [x["average_precision"] for x in ranked]
    return _holds(spark, {"best first": aps == sorted(aps, reverse=True), "all settings scored": len(ranked) == 2 and all({"roc_auc", "average_precision"} <= x.keys() for x in ranked), "refitted on all rows": model.stages[-1].getOrDefault("regParam") == 1.0 / (ranked[0]["c"] * n), "held-out auc over 0.5": r["roc_auc"] > 0.5})


@query(holds_sql("best first", "rmse under the deviation"))
def l06_rolling_search(spark, root):
    """A full grid on rolling folds, scored by rmse."""
    x, _, _ = halves(spark, root)
    x = ml.rolling_folds(x, ["day", "county_fips"], 3)
    _, ranked = ml.search(x, lambda s: ml.estimator("elastic_net", "TMAX", None, regParam=s["r"], elasticNetParam=0.5), ml.grid({"r": [0.01, 1.0]}), ["TMIN", "WSF2", "AWND"], "TMAX", by="rmse", rolling=True)
    sd = x.agg(F.stddev_pop("TMAX")).first()[0]
    return _holds(spark, {"best first": ranked[0]["rmse"] <= ranked[1]["rmse"], "rmse under the deviation": ranked[0]["rmse"] < sd})


@query(f"WITH {WX} SELECT 'TMIN' AS feature, round(regr_slope(TMAX, TMIN), 4) AS coefficient FROM wx WHERE TMAX IS NOT NULL AND TMIN IS NOT NULL UNION ALL SELECT 'intercept', round(regr_intercept(TMAX, TMIN), 4) FROM wx WHERE TMAX IS NOT NULL AND TMIN IS NOT NULL")
def e15_coefficients(spark, root):
    """A linear model without a penalty has the closed form's coefficients."""
    x = wx(spark, root).where("TMAX is not null and TMIN is not null").select("TMAX", "TMIN")
    model = ml.Pipeline(stages=[*ml.assembled(["TMIN"]), ml.estimator("elastic_net", "TMAX", None, regParam=0.0)]).fit(x).stages[-1]
    rows = [(f, round(c, 4)) for f, c, _ in ml.coefficients(model, ["TMIN"])] + [("intercept", round(float(model.intercept), 4))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query(holds_sql("informative over idle", "same after loading", "facts kept"))
def l16_importance_and_l17(spark, root):
    """Permutation importance of a regression on one informative and one idle feature; the model saved and loaded (L17)."""
    x = wx(spark, root).where("TMAX is not null and TMIN is not null").select(*KEY, "TMAX", "TMIN", (F.pmod(F.xxhash64(*KEY), F.lit(1000)) / 1000.0).alias("idle"))
    x = written(x)
    model = ml.Pipeline(stages=[*ml.assembled(["TMIN", "idle"]), ml.estimator("elastic_net", "TMAX", None, regParam=0.0)]).fit(x)
    imp = {r["feature"]: r["rmse_increase"] for r in ml.permutation_importance(model, x, ["TMIN", "idle"], "TMAX", KEY, repeats=2).collect()}
    path = shared_folder(spark, "model")
    ml.save(model, path, {"rows": "all"})
    again, info = ml.load(path)
    both = model.transform(x).select(*KEY, "prediction").join(again.transform(x).select(*KEY, F.col("prediction").alias("p2")), KEY)
    gap = both.agg(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0]
    return _holds(spark, {"informative over idle": imp["TMIN"] > 10 * abs(imp["idle"]), "same after loading": gap == 0, "facts kept": info == {"rows": "all"}})


@query(holds_sql("all classes as large", "given rows kept", "made rows in range", "undersampled to the smallest"))
def l18_resampled(spark, root):
    x = wx(spark, root).where("PRCP is not null").select(C.flag(F.col("PRCP") > 10).alias("y"), *WEATHER)
    n = {r["y"]: r["n"] for r in x.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = ml.smote(x, "y", WEATHER)
    m = {(r["y"], r["made"]): r["n"] for r in got.groupBy("y", "made").agg(F.count(F.lit(1)).alias("n")).collect()}
    most, least = max(n.values()), min(n.values())
    total = {y: m.get((y, True), 0) + m.get((y, False), 0) for y in n}
    ends = got.groupBy("made").agg(*[f(c).alias(f"{k}_{c}") for c in WEATHER for k, f in (("a", F.min), ("b", F.max))])
    e = {r["made"]: r for r in ends.collect()}
    inside = True not in e or all(e[False][f"a_{c}"] - 1e-9 <= e[True][f"a_{c}"] and e[True][f"b_{c}"] <= e[False][f"b_{c}"] + 1e-9 for c in WEATHER)
    under = {r["y"]: r["n"] for r in ml.undersample(x, "y").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    slack = 6 * (least**0.5) + 6
    return _holds(spark, {"all classes as large": all(abs(t - most) <= 6 * most**0.5 + 1 for t in total.values()), "given rows kept": all(m[y, False] == n[y] for y in n), "made rows in range": inside, "undersampled to the smallest": all(abs(c - least) <= slack for c in under.values())})
