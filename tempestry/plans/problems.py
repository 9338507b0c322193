"""Queries p1 to p7 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.functions.columns import denan
from tempestry.operators import blockpivot, drift, impute_groups, intervals, rolling, spikes, timestamps
from tempestry.session import table, written

_DAY = "yyyy-MM-dd"
FILL_NUMERIC, FILL_NAMES = ["AWND", "WSF2", "TMAX", "PRCP"], ["climate_zone"]


def _features(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """weather_features, the latest row of each county-day."""
    wx = table(spark, root, "weather_features").where(F.col("county_fips").isNotNull() & F.col("day").isNotNull())
    return rolling.latest_rows(wx, ["county_fips", "day"], columns, "loaded_at")


def _day(c: str = "day"):
    return F.date_format(c, _DAY).alias("day")


def p1_trailing(spark: SparkSession, root: str) -> DataFrame:
    return rolling.trailing_totals(_features(spark, root, ["PRCP", "WSF2"]), "county_fips", "day", ["PRCP", "WSF2"])


def p1_totals(spark: SparkSession, root: str) -> DataFrame:
    r = p1_trailing(spark, root)
    return r.select("county_fips", _day(), F.col("active").cast("int").alias("active"), *[F.round(c, 4).alias(c) for c in r.columns[3:]])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    r = p1_trailing(spark, root)
    return r.where((F.round("PRCP_total_7d", 1) == 0.0) & (F.round("PRCP_total_30d", 1) > 40.0)).select("county_fips", _day())


def p2_flags(spark: SparkSession, root: str) -> DataFrame:
    return spikes.flag_readings(_features(spark, root, ["TMAX", "WSF5", "PRCP"]), "county_fips", "day")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_flags(spark, root).where("impossible or spike or stuck").select("county_fips", _day(), "field")


def p2_rules(spark: SparkSession, root: str) -> DataFrame:
    """The two rules beside the tail: readings impossible in nature, and stuck ones."""
    return p2_flags(spark, root).where("impossible or stuck").select("county_fips", _day(), "field", "impossible", "stuck")


def p3_times(spark: SparkSession, root: str) -> DataFrame:
    snaps = table(spark, root, "outage_snapshots").select("snapshot_id", "feed_id", "fips_code", "run_start_time")
    return timestamps.normalise_times(snaps, "run_start_time", "feed_id", "fips_code", table(spark, root, "feeds"), table(spark, root, "counties"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_times(spark, root).where(F.col("time_status") == "ok").select("snapshot_id", "utc_second", F.date_format("local_day", _DAY).alias("local_day"))


def p3_status(spark: SparkSession, root: str) -> DataFrame:
    return p3_times(spark, root).select("snapshot_id", "time_status")


def p4_table(spark: SparkSession, root: str) -> DataFrame:
    names = drift.names_of(table(spark, root, "field_names"))
    t = drift.rescue_ingest(table(spark, root, "outage_raw"), "payload", names, keep=["record_id", "publisher", "file_name", "file_date", "line_no"])
    return drift.replay(t, {"batch_note": "string"})


def p4_typed(spark: SparkSession, root: str) -> DataFrame:
    """The typed fields of p4_table."""
    return p4_table(spark, root).select("record_id", "fips_code", "customers_out", F.unix_seconds("run_start_time").alias("run_second"), "customers_total", "state", "any_out", "utility", "batch_note")


def p4_changes(spark: SparkSession, root: str) -> DataFrame:
    return drift.field_changes(table(spark, root, "outage_raw"), "publisher", "file_name", "file_date", "payload", table(spark, root, "field_names"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_changes(spark, root).select("file_name", "field", "change")


def p5_filled(spark: SparkSession, root: str) -> DataFrame:
    wx = _features(spark, root, ["AWND", "WSF2", "TMAX", "PRCP", "TMIN", "climate_zone"])
    zones = table(spark, root, "counties").agg(F.collect_set(F.lower(F.trim("climate_zone"))).alias("_zones"))  # a handful of names
    wx = wx.crossJoin(F.broadcast(zones))
    zone = impute_groups.usable_name(F.col("climate_zone"))
    known = F.lower(F.trim("climate_zone"))
    wx = wx.select(
        "county_fips", "day",
        *[impute_groups.usable_wind(F.col(c)).alias(c) for c in ("AWND", "WSF2")],
        *[denan(F.col(c)).alias(c) for c in ("TMAX", "PRCP", "TMIN")],
        F.when((F.size("_zones") == 0) | F.array_contains("_zones", known), zone).alias("climate_zone"),
    )
    return impute_groups.fill_from_similar(wx, "county_fips", "day", FILL_NUMERIC, FILL_NAMES, ["TMIN"])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    cells = impute_groups.filled_cells(p5_filled(spark, root), "county_fips", "day", [*FILL_NUMERIC, *FILL_NAMES])
    return cells.select("county_fips", _day(), "field")


def p6_periods(spark: SparkSession, root: str) -> DataFrame:
    p = intervals.periods(table(spark, root, "outage_intervals"), "fips_code", "run_start_time", "run_end_time")
    return p.select("fips_code", "period_no", F.unix_seconds("period_start").alias("period_start"), F.unix_seconds("period_end").alias("period_end"), "intervals")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    g = intervals.gaps(table(spark, root, "outage_intervals"), "fips_code", "run_start_time", "run_end_time")
    return g.select("fips_code", F.unix_seconds("gap_start").alias("gap_start"), F.unix_seconds("gap_end").alias("gap_end"))


#: Columns of the wide weather table; a block of 8 puts them into two blocks.
DATATYPES = ["AWND", "PRCP", "TMAX", "TMIN", "WSF2", "WSF5", "WT01", "WT02", "WT03", "WT04", "WT05", "WT06", "WT08", "WT11"]


def _wide(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]]:
    cells = blockpivot.weather_cells(table(spark, root, "weather_obs"), table(spark, root, "stations"))
    reduced = written(blockpivot.reduced_cells(cells, ["station", "day"], "datatype", "number"))
    kinds = blockpivot.attributes_of(reduced, "datatype")
    return blockpivot.pivot_blocks(reduced, ["station", "day"], "datatype", kinds, block=8), kinds


def p7_wide(spark: SparkSession, root: str) -> DataFrame:
    wide, kinds = _wide(spark, root)
    typed = [F.col(k).cast("boolean").alias(k) if k.startswith("WT") else F.col(k) for k in kinds]
    return wide.select("station", _day(), *typed, *[F.col(f"{k}_state") for k in kinds])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    wide, kinds = _wide(spark, root)
    return blockpivot.cell_states(wide, ["station", "day"], kinds).where(F.col("state") != "ok").select("station", _day(), "datatype", "state")


def rounded(expr: str, alias: str, digits: int = 6) -> str:
    """SQL that rounds as the queries do, with no negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END AS {alias}"


QUERIES = {f.__name__: f for f in (p1_totals, p1_found, p2_flags, p2_rules, p2_found, p3_times, p3_status, p3_found, p4_table, p4_typed, p4_changes, p4_found, p5_filled, p5_found, p6_periods, p6_found, p7_wide, p7_found)}

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county_fips, day ORDER BY loaded_at DESC) AS rn_ FROM weather_features WHERE county_fips IS NOT NULL AND day IS NOT NULL) WHERE rn_ = 1)"
_CALENDAR = f"""
wx AS (SELECT county_fips, day, CASE WHEN isnan(PRCP) THEN NULL ELSE PRCP END AS p, CASE WHEN isnan(WSF2) THEN NULL ELSE WSF2 END AS w FROM {_LATEST}),
span AS (SELECT county_fips, min(day) AS a, max(day) AS b FROM wx GROUP BY 1),
cal AS (SELECT county_fips, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
t AS (SELECT c.county_fips, c.day, CASE WHEN wx.day IS NULL THEN 0 ELSE 1 END AS active, coalesce(p, 0.0) AS PRCP, coalesce(w, 0.0) AS WSF2
      FROM cal c LEFT JOIN wx ON c.county_fips = wx.county_fips AND c.day = wx.day),
r AS (SELECT *, {", ".join(f"sum({m}) OVER (PARTITION BY county_fips ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW) AS {m}_total_{n}d" for m in ("PRCP", "WSF2") for n in (7, 30))} FROM t)
"""

# Each zone's wall times are tried at every whole quarter of an hour from UTC; those that come back count.
_P3 = r"""
WITH s AS (
  SELECT snapshot_id, upper(trim(regexp_replace(run_start_time, '\s+', ' ', 'g'))) AS t, c.tz,
         CASE WHEN f.unzoned_zone = 'COUNTY' THEN c.tz ELSE f.unzoned_zone END AS zone, coalesce(f.day_first, false) AS df
  FROM outage_snapshots o LEFT JOIN feeds f USING (feed_id)
  JOIN counties c ON c.fips_code = lpad(regexp_replace(upper(trim(o.fips_code)), '^FIPS\s*:?\s*|\s+', '', 'g'), 5, '0')),
w AS (
  SELECT *, regexp_extract(t, '(Z|UTC|GMT|[ECMP][SD]T|[+-]\d\d:?\d\d)$') AS z,
    CASE WHEN regexp_matches(t, '^\d{9,10}$') THEN CAST(t AS BIGINT) WHEN regexp_matches(t, '^\d{13}$') THEN CAST(t AS BIGINT) // 1000 END AS cnt
  FROM s),
v AS (
  SELECT *, CASE WHEN regexp_matches(z, '^[+-]') AND NOT regexp_matches(t, '^\d{4}-\d\d-\d\d$') THEN rtrim(left(t, length(t) - length(z))) WHEN z <> '' THEN rtrim(left(t, length(t) - length(z))) ELSE t END AS u
  FROM w WHERE cnt IS NULL),
x AS (
  SELECT *, coalesce(
    try_strptime(replace(regexp_replace(u, '\.\d+$', ''), '/', '-'), '%Y-%m-%d %H:%M:%S'), try_strptime(replace(u, '/', '-'), '%Y-%m-%d %H:%M'),
    try_strptime(regexp_replace(u, '[.]\d+$', ''), '%Y-%m-%dT%H:%M:%S'),
    try_strptime(u, '%Y%m%d%H%M'), try_strptime(u, '%Y%m%dT%H%M%S'),
    try_strptime(u, '%d %b %Y %H:%M'), try_strptime(u, '%b %d, %Y %H:%M'), try_strptime(regexp_replace(u, '^[A-Z]+, ', ''), '%d %b %Y %H:%M:%S'),
    CASE WHEN df THEN try_strptime(replace(u, '.', '/'), '%d/%m/%Y %H:%M:%S') ELSE try_strptime(replace(u, '.', '/'), '%m/%d/%Y %H:%M:%S') END,
    CASE WHEN df THEN try_strptime(u, '%d/%m/%Y %I:%M %p') ELSE try_strptime(u, '%m/%d/%Y %I:%M %p') END,
    CASE WHEN df THEN try_strptime(u, '%d/%m/%Y %H:%M') ELSE try_strptime(u, '%m/%d/%Y %H:%M') END) AS wall
  FROM v),
o AS (
  SELECT *, CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN z = 'EDT' THEN -14400 WHEN z IN ('EST', 'CDT') THEN -18000 WHEN z IN ('CST', 'MDT') THEN -21600
    WHEN z IN ('MST', 'PDT') THEN -25200 WHEN z = 'PST' THEN -28800
    WHEN z <> '' THEN (CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INT) * 3600 + CAST(right(z, 2) AS INT) * 60) END AS off
  FROM x WHERE wall IS NOT NULL),
tried AS (
  SELECT snapshot_id, tz, wall, epoch(wall)::BIGINT - q * 900 AS sec FROM o, range(-48, 57) r(q)
  WHERE z = '' AND timezone(zone, make_timestamptz((epoch(wall)::BIGINT - q * 900) * 1000000)) = wall),
found AS (
  SELECT snapshot_id, tz, cnt AS sec FROM w WHERE cnt IS NOT NULL
  UNION ALL SELECT snapshot_id, tz, epoch(wall)::BIGINT - off FROM o WHERE z <> ''
  UNION ALL SELECT snapshot_id, any_value(tz), min(sec) FROM tried GROUP BY snapshot_id HAVING count(*) = 1)
SELECT snapshot_id, sec AS utc_second, strftime(timezone(tz, make_timestamptz(sec * 1000000)), '%Y-%m-%d') AS local_day FROM found
"""

_P4 = """
WITH k AS (SELECT publisher, file_date, file_name, payload, unnest(json_keys(payload)) AS name FROM outage_raw),
t AS (SELECT publisher, file_date, file_name, coalesce(n.field, name) AS field, name, json_type(json_extract(payload, '$."' || name || '"')) AS jt
      FROM k LEFT JOIN field_names n ON n.seen_name = k.name),
y AS (SELECT *, CASE WHEN jt = 'VARCHAR' THEN 'string' WHEN jt IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN jt = 'DOUBLE' THEN 'decimal' WHEN jt = 'NULL' THEN NULL ELSE lower(jt) END AS ty FROM t),
g AS (SELECT publisher, file_date, file_name, field, list_sort(list(DISTINCT name)) AS n, list_sort(coalesce(list(DISTINCT ty) FILTER (ty IS NOT NULL), [])) AS ty FROM y GROUP BY ALL),
f AS (SELECT *, lag(file_name) OVER (PARTITION BY publisher ORDER BY file_date, file_name) AS prev FROM (SELECT DISTINCT publisher, file_date, file_name FROM outage_raw)),
p AS (SELECT f.publisher, f.file_name, g.field, g.n, g.ty FROM f JOIN g ON g.publisher = f.publisher AND g.file_name = f.prev),
c AS (SELECT g.publisher, g.file_name, g.field, g.n, g.ty FROM f JOIN g ON g.publisher = f.publisher AND g.file_name = f.file_name WHERE f.prev IS NOT NULL),
j AS (SELECT coalesce(c.file_name, p.file_name) AS file_name, coalesce(c.field, p.field) AS field, c.n AS cn, p.n AS pn, c.ty AS cy, p.ty AS py
      FROM c FULL JOIN p ON c.publisher = p.publisher AND c.file_name = p.file_name AND c.field = p.field)
SELECT file_name, field, 'added' AS change FROM j WHERE pn IS NULL
UNION ALL SELECT file_name, field, 'removed' FROM j WHERE cn IS NULL
UNION ALL SELECT file_name, field, 'renamed' FROM j WHERE cn <> pn
UNION ALL SELECT file_name, field, 'retyped' FROM j WHERE len(cy) > 0 AND len(py) > 0 AND cy <> py
"""

_P3_STATUS = _P3[: _P3.rindex("SELECT snapshot_id, sec AS utc_second")].rstrip() + """,
st AS (SELECT o.snapshot_id, count(t.sec) AS n FROM o LEFT JOIN tried t USING (snapshot_id) WHERE o.z = '' AND o.zone IS NOT NULL GROUP BY 1)
SELECT a.snapshot_id, CASE WHEN s.snapshot_id IS NULL THEN 'unknown_place' WHEN f.snapshot_id IS NOT NULL THEN 'ok' WHEN st.n > 1 THEN 'ambiguous' WHEN st.n = 0 THEN 'nonexistent' ELSE 'unreadable' END AS time_status
FROM outage_snapshots a LEFT JOIN (SELECT DISTINCT snapshot_id FROM s) s USING (snapshot_id) LEFT JOIN (SELECT DISTINCT snapshot_id FROM found) f USING (snapshot_id) LEFT JOIN st USING (snapshot_id)
"""

_P2 = f"""
WITH f AS (SELECT county_fips, day, field, v FROM (SELECT county_fips, day, unnest(['TMAX', 'WSF5', 'PRCP']) AS field, unnest([TMAX, WSF5, PRCP]) AS v FROM {_LATEST}) WHERE v IS NOT NULL AND NOT isnan(v)),
n AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY county_fips, field ORDER BY day) THEN 0 ELSE 1 END AS fresh FROM f),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY county_fips, field ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY county_fips, field, run) AS k FROM r),
z AS (SELECT county_fips, strftime(day, '%Y-%m-%d') AS day, field, CASE field WHEN 'TMAX' THEN v < -90 OR v > 57 WHEN 'WSF5' THEN v < 0 OR v > 114 ELSE v < 0 OR v > 1900 END AS impossible, v <> 0 AND k >= 5 AS stuck FROM c)
SELECT * FROM z WHERE impossible OR stuck
"""


def _typed_sql(cast: str, *names: str) -> str:
    """The first of a payload's values under names that can be cast."""
    value = lambda n: f"json_extract(payload, '$.\"{n}\"')"
    text = lambda v: f"CASE json_type({v}) WHEN 'OBJECT' THEN coalesce({v} ->> '$.v', {v} ->> '$.name', {v} ->> '$.value') WHEN 'ARRAY' THEN {v} ->> '$[0]' ELSE {v} ->> '$' END"
    return "coalesce(" + ", ".join("(" + cast.replace("{t}", f"({text(value(n))})") + ")" for n in names) + ")"


_CODE_SQL = r"(SELECT CASE WHEN regexp_matches(c, '^[0-9]{1,5}$') THEN lpad(c, 5, '0') END FROM (SELECT regexp_replace(regexp_replace(upper({t}), '\s+', '', 'g'), '^FIPS:?', '') AS c))"
_WHOLE_SQL = r"CASE WHEN regexp_matches(trim({t}), '^[+-]?[0-9]+([.]0*)?$') THEN try_cast(regexp_replace(trim({t}), '[.]0*$', '') AS BIGINT) END"
_MOMENT_SQL = r"CASE WHEN regexp_matches({t}, '^[0-9]{9,10}$') THEN try_cast({t} AS BIGINT) ELSE epoch_us(try_cast(regexp_replace(trim({t}), '(Z|\+00:?00)$', '') AS TIMESTAMP)) // 1000000 END"
_TEXT_SQL = "CASE WHEN trim({t}) <> '' THEN trim({t}) END"
_P4_TYPED = f"""SELECT record_id, {_typed_sql(_CODE_SQL, 'fips_code', 'County_FIPS', 'FIPS_CODE', 'county_fips', 'fips', 'fips5')} AS fips_code,
{_typed_sql(_WHOLE_SQL, 'customers_out', 'cust_out', 'customers_affected', 'outage_customers', 'sum')} AS customers_out,
{_typed_sql(_MOMENT_SQL, 'run_start_time', 'interval_start', 'start_time', 'timestamp_utc')} AS run_second,
{_typed_sql(_WHOLE_SQL, 'customers_total', 'Customers', 'total_customers')} AS customers_total,
{_typed_sql(_TEXT_SQL, 'state', 'st', 'state_name')} AS state,
{_typed_sql("try_cast(lower(trim({t})) AS BOOLEAN)", 'any_out', 'is_out', 'out_flag')} AS any_out,
{_typed_sql(_TEXT_SQL, 'utility', 'provider', 'utility_name')} AS utility,
{_typed_sql(_TEXT_SQL, 'batch_note')} AS batch_note FROM outage_raw"""

_P6 = """
WITH i AS (SELECT fips_code AS e, run_start_time AS s, run_end_time AS t FROM outage_intervals WHERE fips_code IS NOT NULL AND run_end_time > run_start_time GROUP BY ALL),
m AS (SELECT *, max(t) OVER (PARTITION BY e ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i)
"""

_CELLS = r"""
WITH o AS (SELECT 'GHCND:' || regexp_replace(regexp_replace(upper(station), '\s+', '', 'g'), '^GHCND:', '') AS station, strftime(CAST(date AS DATE), '%Y-%m-%d') AS day,
  upper(regexp_replace(datatype, '\s+', '', 'g')) AS datatype, replace(trim(value), ',', '.') AS v FROM weather_obs),
n AS (SELECT station, day, datatype, coalesce(CASE WHEN regexp_matches(v, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(v AS DOUBLE) END,
  CASE WHEN datatype LIKE 'WT%' THEN CASE WHEN upper(v) IN ('Y', 'YES', 'TRUE', 'T', 'ON') THEN 1.0 WHEN upper(v) IN ('N', 'NO', 'FALSE', 'F', 'OFF') THEN 0.0 END END) AS x FROM o)
"""

ORACLE = {
    "p1_totals": f"WITH {_CALENDAR} SELECT county_fips, strftime(day, '%Y-%m-%d') AS day, active, {', '.join(rounded(m, m, 4) for m in ('PRCP', 'WSF2'))}, "
    + ", ".join(rounded(f"{m}_total_{n}d", f"{m}_total_{n}d", 4) + ", " + rounded(f"{m}_total_{n}d / {n}", f"{m}_avg_{n}d", 4) for m in ("PRCP", "WSF2") for n in (7, 30))
    + " FROM r",
    "p1_found": f"WITH {_CALENDAR} SELECT county_fips, strftime(day, '%Y-%m-%d') AS day FROM r WHERE round(PRCP_total_7d, 1) = 0.0 AND round(PRCP_total_30d, 1) > 40.0",
    "p3_found": _P3,
    "p3_status": _P3_STATUS,
    "p2_rules": _P2,
    "p4_found": _P4,
    "p4_typed": _P4_TYPED,
    "p4_changes": _P4[: _P4.index("j AS (")].rstrip()
    + """
j AS (SELECT coalesce(c.publisher, p.publisher) AS publisher, coalesce(c.file_name, p.file_name) AS file_name, coalesce(c.field, p.field) AS field, c.n AS cn, p.n AS pn, c.ty AS cy, p.ty AS py
      FROM c FULL JOIN p ON c.publisher = p.publisher AND c.file_name = p.file_name AND c.field = p.field)
SELECT publisher, file_name, field, 'added' AS change, NULL AS "before", array_to_string(cn, ',') AS "after" FROM j WHERE pn IS NULL
UNION ALL SELECT publisher, file_name, field, 'removed', array_to_string(pn, ','), NULL FROM j WHERE cn IS NULL
UNION ALL SELECT publisher, file_name, field, 'renamed', array_to_string(pn, ','), array_to_string(cn, ',') FROM j WHERE cn <> pn
UNION ALL SELECT publisher, file_name, field, 'retyped', array_to_string(py, ','), array_to_string(cy, ',') FROM j WHERE len(cy) > 0 AND len(py) > 0 AND cy <> py""",
    "p5_found": f"""WITH f AS (SELECT county_fips, strftime(day, '%Y-%m-%d') AS day, * EXCLUDE (county_fips, day) FROM {_LATEST})
        SELECT county_fips, day, 'AWND' AS field FROM f WHERE AWND IS NULL OR isnan(AWND) OR AWND < 0 OR AWND > 114
        UNION ALL SELECT county_fips, day, 'WSF2' FROM f WHERE WSF2 IS NULL OR isnan(WSF2) OR WSF2 < 0 OR WSF2 > 114
        UNION ALL SELECT county_fips, day, 'TMAX' FROM f WHERE TMAX IS NULL OR isnan(TMAX) UNION ALL SELECT county_fips, day, 'PRCP' FROM f WHERE PRCP IS NULL OR isnan(PRCP)
        UNION ALL SELECT county_fips, day, 'climate_zone' FROM f WHERE climate_zone IS NULL OR lower(trim(climate_zone)) NOT IN (SELECT climate_zone FROM counties)""",
    "p6_found": _P6 + "SELECT e AS fips_code, epoch_us(p) // 1000000 AS gap_start, epoch_us(s) // 1000000 AS gap_end FROM m WHERE s > p",
    "p6_periods": _P6
    + """, l AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT e AS fips_code, k::BIGINT AS period_no, epoch_us(min(s)) // 1000000 AS period_start, epoch_us(max(t)) // 1000000 AS period_end, count(*) AS intervals FROM l GROUP BY e, k""",
    "p7_found": _CELLS + "SELECT station, day, datatype, CASE WHEN count(x) = 0 THEN 'empty' ELSE 'contested' END AS state FROM n GROUP BY 1, 2, 3 HAVING count(x) = 0 OR min(x) <> max(x)",
    "p7_wide": _CELLS
    + ", c AS (SELECT station, day, datatype, min(x) AS lo, max(x) AS hi FROM n GROUP BY 1, 2, 3) SELECT station, day, "
    + ", ".join(f"max(CASE WHEN datatype = '{k}' AND lo = hi THEN lo END){'::BOOLEAN' if k.startswith('WT') else ''} AS {k}, max(CASE WHEN datatype = '{k}' THEN CASE WHEN lo IS NULL THEN 'empty' WHEN lo <> hi THEN 'contested' ELSE 'ok' END END) AS {k}_state" for k in DATATYPES)
    + " FROM c GROUP BY 1, 2",
}
