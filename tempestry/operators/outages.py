"""Outage snapshots to daily rollups, sessions, rates and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import clip, flag, safe_div, utc_day, utc_midnight
from tempestry.session import small

# The cadences of a feed in minutes, and the default where none can be seen.
CADENCES, DEFAULT_CADENCE = (5, 10, 15, 30, 60), 15
DEFAULT_ZONE = "America/New_York"
DAILY_COLUMNS = {
    "fips_code": "string", "run_start_time_day": "date", "any_out": "int", "num_out_per_day": "bigint", "minutes_out": "bigint",
    "customers_out": "bigint", "customers_out_mean": "double", "cust_minute_area": "bigint", "pct_out_max": "double", "pct_out_area": "double",
}


def civil_day(ts: Column, tz: Column | None = None, mode: str = "per_county", single: str = DEFAULT_ZONE) -> Column:
    """The civil day of a UTC instant: of its county's zone (DEFAULT_ZONE where null), of one zone, or of UTC."""
    if mode == "utc":
        return utc_day(ts)
    return utc_day(F.from_utc_timestamp(ts, F.lit(single) if mode == "single" else F.coalesce(tz, F.lit(DEFAULT_ZONE))))


def minutes_of_day(day: Column, tz: Column) -> Column:
    """1440, or 1380 and 1500 on the days of clock changes; 1440 if the day has no midnight that can be placed."""
    start, end = (F.unix_seconds(F.to_utc_timestamp(utc_midnight(d), tz)) for d in (day, F.date_add(day, 1)))
    return F.coalesce(((end - start) / 60).cast("int"), F.lit(1440))


def snap(estimate: Column) -> Column:
    """The nearest of CADENCES; on a tie the smaller; DEFAULT_CADENCE for null."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(float(c)) - estimate).alias("d"), F.lit(c).alias("c")) for c in CADENCES]))["c"]
    return F.when(estimate.isNotNull(), near).otherwise(DEFAULT_CADENCE)


def median_gap_cadence(snaps: DataFrame, entity: str, ts: str) -> DataFrame:
    """One row, snapshot_minutes: the median minutes between an entity's consecutive snapshots, snapped to a cadence.

    Entities are cut into days; the first snapshot of a day follows the last of the entity's day before (one row a day), so
    no entity is sorted in one task."""
    x = snaps.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).alias("_e"), F.unix_seconds(ts).alias("_t")).withColumn("_b", F.floor(F.col("_t") / 86400))
    before = Window.partitionBy("_e").orderBy("_b")
    last = x.groupBy("_e", "_b").agg(F.max("_t").alias("_m")).select("_e", "_b", F.lag("_m").over(before).alias("_carry"))
    w = Window.partitionBy("_e", "_b").orderBy("_t")
    gap = F.col("_t") - F.coalesce(F.lag("_t").over(w), F.col("_carry"))
    # Whatever is over two hours snaps to the longest cadence, so longer gaps count as two hours: at most 7,201 values are counted.
    gaps = x.join(last, ["_e", "_b"]).select(F.least(gap, F.lit(7200)).alias("_g")).where("_g is not null").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    return gaps.agg(snap(F.percentile("_g", 0.5, F.col("_n")) / 60.0).alias("snapshot_minutes"))


def gcd_cadence(daily: DataFrame, minutes: str = "minutes_out") -> DataFrame:
    """One row, snapshot_minutes: the greatest common divisor of the positive minutes, snapped to a cadence.

    Minutes of a day are at most 1,500, so the distinct values are few; Euclid's rule runs over them in one expression."""
    values = F.collect_set(F.when(F.col(minutes) > 0, F.col(minutes).cast("int")))
    step = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))), lambda s: s["x"])
    g = F.aggregate(F.col("_v"), F.lit(0), lambda a, b: step(b, a))
    return daily.agg(values.alias("_v")).select(snap(F.when(F.size("_v") > 0, g).cast("double")).alias("snapshot_minutes"))


def sessions(snaps: DataFrame, entity: str, day: str, ts: str, customers: str, gap_minutes: int = 30) -> DataFrame:
    """Outage events: entity, day, session_start, session_end (last snapshot), snapshots, peak. Positive snapshots of one entity and
    civil day belong together while they are at most gap_minutes apart. Null keys or times are left out."""
    x = snaps.where((F.col(customers) > 0) & F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(ts).isNotNull())
    s = x.groupBy(entity, day, F.session_window(F.col(ts), f"{gap_minutes} minutes")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("snapshots"), F.max(customers).alias("peak"))
    return s.select(entity, day, "session_start", "session_end", "snapshots", "peak")


def daily_rollup(snaps: DataFrame, entity: str = "fips_code", day: str = "local_day", ts: str = "ts", customers: str = "customers_out", total: str | None = "customers_total", gap_minutes: int = 30) -> DataFrame:
    """One row per entity and civil day: any_out, num_out_per_day (as sessions() counts), positives (positive snapshots), customers_out (peak),
    customers_out_mean (over all rows that have a number, zeros too), customer_snapshots (their sum), raw_total (the largest
    denominator delivered). minutes_out and cust_minute_area are positives and customer_snapshots times the cadence.

    Events are found by a window over (entity, day), and the aggregate has the same keys: one shuffle for both. Such a group is
    bounded by the snapshots of a day."""
    c = F.col("_c")
    x = snaps.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    x = x.select(F.col(entity).alias("fips_code"), F.col(day).alias("run_start_time_day"), F.unix_seconds(ts).alias("_t"), F.col(customers).alias("_c"), (F.col(total) if total else F.lit(None)).cast("bigint").alias("_total"))
    w = Window.partitionBy("fips_code", "run_start_time_day").orderBy("_t")
    last = F.last(F.when(c > 0, F.col("_t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", flag((c > 0) & F.col("_t").isNotNull() & (last.isNull() | (F.col("_t") - last > gap_minutes * 60))))
    aggs = [
        F.max(flag(c > 0)).alias("any_out"),
        F.sum("_new").alias("num_out_per_day"),
        F.count_if(c > 0).alias("positives"),
        F.max(c).cast("bigint").alias("customers_out"),
        F.avg(c).alias("customers_out_mean"),
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("customer_snapshots"),
        F.max("_total").alias("raw_total"),
    ]
    return x.groupBy("fips_code", "run_start_time_day").agg(*aggs)


def denominators(mcc: DataFrame, code: str = "county_fips", customers: str = "customers") -> DataFrame:
    """fips_code, customers_total: codes padded, numbers read leniently; the largest where a code is there twice."""
    from tempestry.functions.columns import fips5

    x = mcc.select(fips5(F.col(code).cast("string")).alias("fips_code"), F.col(customers).cast("bigint").alias("customers_total"))
    return x.where(F.col("fips_code").isNotNull()).groupBy("fips_code").agg(F.max("customers_total").alias("customers_total"))


def daily_outages(snaps: DataFrame, places: DataFrame, mcc: DataFrame | None, gap_minutes: int = 30, snapshot_minutes: int | None = None, ts: str = "ts", year: int | None = None) -> DataFrame:
    """The daily outage table (DAILY_COLUMNS and customers_total) from snapshots with fips_code, ts (UTC), local_day, customers_out
    and customers_total. year keeps that year's civil days only. Rates are null unless the denominator is positive; it is
    the county's of mcc, or the largest delivered that day if there is no mcc table."""
    cadence = snaps.sparkSession.range(1).select(F.lit(snapshot_minutes).alias("snapshot_minutes")) if snapshot_minutes else median_gap_cadence(snaps, "fips_code", ts)
    daily = daily_rollup(snaps, ts=ts, gap_minutes=gap_minutes).crossJoin(F.broadcast(cadence))  # one row
    daily = daily.withColumns({"minutes_out": F.col("positives") * F.col("snapshot_minutes"), "cust_minute_area": F.col("customer_snapshots") * F.col("snapshot_minutes")})
    daily = daily.join(small(denominators(mcc)), "fips_code", "left") if mcc is not None else daily.withColumn("customers_total", F.col("raw_total"))
    daily = daily.join(small(places.select("fips_code", "tz")), "fips_code", "left")
    total, area = F.col("customers_total"), F.col("cust_minute_area")
    daily = daily.withColumns({
        "pct_out_max": safe_div(F.col("customers_out"), total),
        "pct_out_area": safe_div(area, total * minutes_of_day(F.col("run_start_time_day"), F.coalesce("tz", F.lit(DEFAULT_ZONE)))),
    })
    if year is not None:
        daily = daily.where(F.year("run_start_time_day") == year)
    return daily.select(*[F.col(c).cast(t).alias(c) for c, t in DAILY_COLUMNS.items()], "customers_total", "tz")


def enforce_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the schema's columns in its order: missing ones null, the rest cast leniently; others are dropped."""
    return df.select(*[(F.col(c).cast("string").try_cast(t) if c in df.columns and t != dict(df.dtypes)[c] else F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def infer_any_out(df: DataFrame, signals: tuple[str, ...] = ("num_out_per_day", "minutes_out", "customers_out", "cust_minute_area")) -> DataFrame:
    """any_out from the other signals, if it is null throughout the table; else as it is."""
    some = df.agg(F.count("any_out").alias("_have"))
    guess = F.greatest(*[flag(F.col(s) > 0) for s in signals])
    return df.crossJoin(F.broadcast(some)).withColumn("any_out", F.when(F.col("_have") == 0, guess).otherwise(F.col("any_out")).cast("int")).drop("_have")


def combine_years(frames: list[DataFrame], file_order: str | None = None) -> DataFrame:
    """Yearly tables as one: enforced schema, union by name, one row per county and day (the first by file order, then by the larger
    outage), sorted."""
    parts = [enforce_schema(f, DAILY_COLUMNS).withColumn("_file", F.lit(i)) for i, f in enumerate(frames)]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    rest = [c for c in DAILY_COLUMNS if c not in ("fips_code", "run_start_time_day")]
    first = F.min_by(F.struct(*rest), F.struct("_file", -F.coalesce("cust_minute_area", F.lit(0)), *rest))
    x = x.groupBy("fips_code", "run_start_time_day").agg(first.alias("_r")).select("fips_code", "run_start_time_day", *[F.col("_r")[c].alias(c) for c in rest])
    return x.orderBy("fips_code", "run_start_time_day")


def labels(daily: DataFrame, tz: str = "tz", force_minutes: int | None = None, least_coverage: float = 0.8) -> DataFrame:
    """daily with the cadence, coverage and unified rates: minutes_in_local_day, snapshot_minutes, snapshots_count, minutes_observed,
    coverage, pct_out_area_unified, pct_out_area_covered, pct_out_max_unified, train_mask."""
    if force_minutes is not None and force_minutes not in CADENCES:
        raise ValueError(f"a cadence is one of {CADENCES}")
    cadence = daily.sparkSession.range(1).select(F.lit(force_minutes).alias("snapshot_minutes")) if force_minutes else gcd_cadence(daily)
    x = daily.crossJoin(F.broadcast(cadence)).withColumn("minutes_in_local_day", minutes_of_day(F.col("run_start_time_day"), F.coalesce(F.col(tz), F.lit(DEFAULT_ZONE))))
    x = x.withColumn("snapshots_count", F.col("minutes_out") / F.col("snapshot_minutes"))
    x = x.withColumn("minutes_observed", F.col("snapshots_count") * F.col("snapshot_minutes"))
    x = x.withColumn("coverage", clip(F.col("minutes_observed") / F.col("minutes_in_local_day"), 0.0, 1.0))
    total, area = F.col("customers_total"), F.col("cust_minute_area")
    return x.withColumns({
        "pct_out_area_unified": safe_div(area, total * F.col("minutes_in_local_day")),
        "pct_out_area_covered": safe_div(area, total * F.col("minutes_observed")),
        "pct_out_max_unified": safe_div(F.col("customers_out"), total),
        "train_mask": F.coalesce((total > 0) & (F.col("coverage") >= least_coverage), F.lit(False)),
    })


def rollup_checks(daily: DataFrame, minutes: int = DEFAULT_CADENCE) -> DataFrame:
    """One row of counts: duplicate keys, any_out outside 0 and 1, minutes_out that are no multiple, rates over 1."""
    keys = F.countDistinct(F.struct("fips_code", "run_start_time_day"))
    return daily.agg(
        (F.count(F.lit(1)) - keys).alias("duplicate_keys"),
        F.count_if(F.col("any_out").isNotNull() & ~F.col("any_out").isin(0, 1)).alias("bad_any_out"),
        F.count_if(F.coalesce("minutes_out", F.lit(0)) % minutes != 0).alias("off_cadence"),
        F.count_if(F.col("pct_out_max") > 1).alias("rate_over_one"),
    )
