"""Time texts in mixed formats and zones, brought to UTC instants and civil days."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions.columns import fips5, once
from tempestry.session import ship, small

# Zone letters of the United States and their seconds from UTC.
US_ZONES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200, "AKST": -32400, "AKDT": -28800, "HST": -36000, "HDT": -32400}
# English month names, three letters.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
EPOCH = "1970-01-01"

_ZONE = r"(Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(AM|PM|A\.M\.|P\.M\.)?"
_MONTH = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\.?"
_DAY_NAME = r"(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*\.?,?\s+)?"
# Each form: pattern, and what its groups are, joined by bars: year, month (or its name), day, order, hour, minute, second, half, zone.
_FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T\s,]+{_CLOCK}\s*{_ZONE}$", "$1|$2|$3|Y|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[T\s,]+{_CLOCK}\s*{_ZONE}$", "$3|$1|$2|N|$4|$5|$6|$7|$8"),
    (rf"^{_DAY_NAME}(\d{{1,2}})[\s-]+{_MONTH},?[\s-]+(\d{{4}})[T\s,]+{_CLOCK}\s*{_ZONE}$", "$3|$2|$1|Y|$4|$5|$6|$7|$8"),
    (rf"^{_DAY_NAME}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})[T\s,]+{_CLOCK}\s*{_ZONE}$", "$3|$1|$2|Y|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,]\d+)?)?\s*{_ZONE}$", "$1|$2|$3|Y|$4|$5|$6||$7"),
)
# Digits of a bare count since 1970, and how many of its units make a second.
_COUNTS = {9: 1, 10: 1, 13: 1_000, 16: 1_000_000, 19: 1_000_000_000}


@cache
def spans_by_year(name: str, first: int, last: int) -> list[tuple[int, list[dict[str, int]]]]:
    """(year, spans) of one zone; kept by the worker process. Offsets are looked up every three days, more often than any zone
    changes back and forth, and each change is bisected to the second."""
    if name not in available_timezones():
        return []
    tz = ZoneInfo(name)
    begin, end = (int(datetime(y, m, 1, tzinfo=UTC).timestamp()) for y, m in ((first - 1, 12), (last + 1, 2)))
    off = lambda t: int(datetime.fromtimestamp(t, tz).utcoffset().total_seconds())
    cuts = [(begin, off(begin))]
    for t in range(begin, end, 3 * 86400):
        if off(t + 3 * 86400) != off(t):
            a, b = t, t + 3 * 86400
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if off(mid) == cuts[-1][1] else (a, mid)
            cuts.append((b, off(b)))
    spans = [(u, cuts[i + 1][0] if i + 1 < len(cuts) else end, o) for i, (u, o) in enumerate(cuts)]
    out = []
    for y in range(first, last + 1):
        a, b = (int(datetime(y + k, 1, 1, tzinfo=UTC).timestamp()) for k in (0, 1))
        out.append((y, [{"ls": u + o, "le": v + o, "us": u, "ue": v, "off": o} for u, v, o in spans if v + 86400 > a and u - 86400 < b]))
    return out


#: The offset table holds these years. No zone changes before the first (local mean time); after 2100 only the yearly rules are left, which
#: repeat with the calendar, and the last 28 years have every calendar there is.
FIRST_YEAR, LAST_YEAR, CYCLE = 1800, 2128, 28


def _tabled_year(year: Column) -> Column:
    """The year of the offset table that stands for a year: itself, or one with the same calendar."""
    kind = F.dayofweek(F.make_date(year, F.lit(1), F.lit(1))) * 2 + (F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366).cast("int")
    stands: dict[int, int] = {}
    for y in range(LAST_YEAR - CYCLE + 1, LAST_YEAR + 1):
        sunday_first = (datetime(y, 1, 1).weekday() + 1) % 7 + 1  # noqa: DTZ001
        stands.setdefault(sunday_first * 2 + (datetime(y, 12, 31).timetuple().tm_yday == 366), y)  # noqa: DTZ001
    late = F.try_element_at(F.create_map(*[F.lit(x) for kv in stands.items() for x in kv]), kind)
    return F.when(year < FIRST_YEAR, FIRST_YEAR).when(year > LAST_YEAR, late).otherwise(year)


def _shift(year: Column) -> Column:
    """Seconds from the start of a year to that of the year that stands for it."""
    return F.when((year < FIRST_YEAR) | (year > LAST_YEAR), F.datediff(F.make_date(_tabled_year(year), F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1))).cast("bigint") * 86400).otherwise(F.lit(0).cast("bigint"))


def zone_offsets(zones: DataFrame, zone: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """The offset intervals of each zone, exploded to calendar years.

    Columns: zone, year, spans array<struct<ls, le, us, ue, off>>: all intervals that touch the local or UTC year; in
    each, wall seconds [ls, le) and UTC seconds [us, ue), counted from 1970, stand off seconds apart. Names that are no
    IANA zone give no rows. Rows are bounded by the IANA names (about 600) times the years."""

    def build(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(name, *r) for name in pdf["zone"] for r in spans_by_year(name, first, last)]
            yield pd.DataFrame(rows, columns=["zone", "year", "spans"])

    ship(zones.sparkSession)
    names = zones.select(F.col(zone).alias("zone")).where(F.col("zone").isNotNull()).distinct()
    return names.mapInPandas(build, "zone string, year int, spans array<struct<ls:bigint,le:bigint,us:bigint,ue:bigint,off:int>>")


def parsed(df: DataFrame, text: Column, day_first: Column) -> DataFrame:
    """df with _count (a bare count's UTC second), _wall (the wall second), _zoned (the text carries a zone) and _off (that zone's
    seconds from UTC).

    _wall is null where the text is in none of the forms or names a day or time of day that doesn't exist; _off where its letters
    are none of the United States or the offset is over 18 hours. Each step's columns are evaluated once."""
    t, s = F.col("_t"), F.col("_s")
    df = once(df, {"_t": F.regexp_replace(F.upper(F.trim(F.regexp_replace(text, r"[\s\xa0]+", " "))), "^[\"']|[\"']$", "")})
    form = F.lit(None).cast("string")
    for pattern, groups in reversed(_FORMS):
        form = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, groups)).otherwise(form)
    count = F.when(t.rlike(r"^-?\d{9,19}(\.\d+)?$"), F.regexp_replace(t, r"\..*$", ""))
    df = once(df, {"_s": F.split(form, r"\|", -1), "_digits": count})
    units = F.create_map(*[F.lit(x) for kv in _COUNTS.items() for x in kv])
    per = F.try_element_at(units, F.length(F.replace(F.col("_digits"), F.lit("-"), F.lit(""))))
    swap = (s[3] == "N") & F.coalesce(day_first, F.lit(False))
    num = lambda c: F.when(c == "", 0).otherwise(c.try_cast("int"))
    df = once(df, {
        "_count": F.floor(F.col("_digits").try_cast("decimal(20,0)") / per).cast("bigint"),
        "_mo": F.when(swap, s[2]).otherwise(s[1]), "_dom": F.when(swap, s[1]).otherwise(s[2]),
        "_h": num(s[4]), "_mi": num(s[5]), "_sec": num(s[6]), "_half": F.substring(s[7], 1, 1), "_z": s[8], "_bare": F.regexp_replace(s[8], "^(UTC|GMT)(?=[+-])", ""),
    })
    mo, h, bare = F.col("_mo"), F.col("_h"), F.col("_bare")
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), mo)
    month = F.when(mo.rlike("^[A-Z]"), named.cast("string")).otherwise(mo)
    day = F.datediff(F.concat_ws("-", s[0], F.lpad(month, 2, "0"), F.lpad("_dom", 2, "0")).try_cast("date"), F.lit(EPOCH).cast("date"))
    hour = F.when(F.col("_half") == "", F.when(h < 24, h)).otherwise(F.when(h.between(1, 12), h % 12 + F.when(F.col("_half") == "P", 12).otherwise(0)))
    wall = F.when((F.col("_mi") < 60) & (F.col("_sec") < 60), day.cast("bigint") * 86400 + hour * 3600 + F.col("_mi") * 60 + F.col("_sec"))
    digits = F.regexp_replace(bare, r"\D", "")
    written = (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60) * F.when(bare.startswith("-"), -1).otherwise(1)
    letters = F.try_element_at(F.create_map(*[F.lit(x) for kv in US_ZONES.items() for x in kv]), F.col("_z"))
    df = once(df, {"_wall": wall, "_written": F.when(bare.rlike(r"^[+-]\d"), written), "_letters": letters})
    return df.withColumns({"_zoned": F.col("_z") != "", "_off": F.coalesce(F.when(F.abs("_written") <= 18 * 3600, F.col("_written")), F.col("_letters"))})


def normalise_times(df: DataFrame, text: str, feed: str, place: str, feeds: DataFrame, places: DataFrame) -> DataFrame:
    """Each row of df with utc_second (bigint), local_day (date) and time_status.

    feeds: feed_id, unzoned_zone (an IANA zone or COUNTY, the zone of the row's place), day_first. places: fips_code, tz.
    time_status: `ok`; `unknown_place` (the code, rid of its spelling, isn't among places); `unreadable` (null, empty, a
    placeholder, a form not known, a date or time of day that doesn't exist, zone letters not known); `ambiguous` (a
    wall time its zone has twice), `nonexistent` (not at all). Only `ok` has the other two. Forms: ISO and slashed dates
    with the year first, all-number dates with the year last (day_first decides), dates with month names, compact digits,
    counts since 1970 in seconds to nanoseconds; 12 and 24 hours; fractions are dropped.

    The wall time is joined as of its zone's offset intervals, exploded by year: two intervals that hold it mean
    ambiguous, none nonexistent, one gives the offset. Every dimension is broadcast while its estimated size is under
    the limit, and joined by shuffle beyond. df isn't shuffled otherwise. Any year of four digits has a result: years before 1800
    take the zone's first offset (no zone changed before), years after 2128 the rules of a year with the same calendar. df's own columns of the names used here,
    utc_second, local_day and time_status, are replaced."""
    feeds = feeds.select(F.col("feed_id").alias("_fid"), F.col("unzoned_zone").alias("_fz"), F.col("day_first").alias("_df"))
    places = places.select(F.col("fips_code").alias("_code"), F.col("tz").alias("_tz"))
    zones = places.select(F.col("_tz").alias("zone")).unionByName(feeds.select(F.col("_fz").alias("zone"))).unionByName(df.sparkSession.range(1).select(F.lit("UTC").alias("zone")))
    spans = zone_offsets(zones, "zone")
    spans = F.broadcast(spans)  # at most 600 IANA names x 329 years
    keep = [c for c in df.columns if c not in ("utc_second", "local_day", "time_status")]
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")  # as one column, so that no name of df's can clash with those made here
    x = once(df.select(whole, F.col(feed).alias("_feed"), F.col(text).alias("_text"), F.col(place).alias("_place")), {"_code0": fips5(F.col("_place"))})
    x = x.join(small(feeds), F.col("_feed") == F.col("_fid"), "left").join(small(places), F.col("_code0") == F.col("_code"), "left")
    x = parsed(x, F.col("_text"), F.col("_df"))
    zone = F.when(F.col("_fz") == "COUNTY", F.col("_tz")).otherwise(F.col("_fz"))
    need = F.col("_count").isNull() & F.col("_wall").isNotNull() & ~F.col("_zoned")
    year_of = lambda seconds: F.year(F.date_add(F.lit(EPOCH).cast("date"), F.floor(seconds / 86400).cast("int")))
    x = x.withColumn("_zone", F.when(need, zone)).withColumn("_year", year_of(F.col("_wall")))
    x = once(x, {"_ty": _tabled_year(F.col("_year")), "_w": F.col("_wall") + _shift(F.col("_year"))})
    x = x.join(spans.select(F.col("zone").alias("_z1"), F.col("year").alias("_y1"), F.col("spans").alias("_s1")), (F.col("_zone") == F.col("_z1")) & (F.col("_ty") == F.col("_y1")), "left")
    hits = F.filter("_s1", lambda i: (i["ls"] <= F.col("_w")) & (F.col("_w") < i["le"]))
    x = once(x.withColumn("_need", need), {"_hits": F.when(F.col("_need") & F.col("_s1").isNotNull(), hits)}).drop("_s1")
    utc = F.coalesce(F.col("_count"), F.when(F.col("_zoned"), F.col("_wall") - F.col("_off")).otherwise(F.when(F.size("_hits") == 1, F.col("_wall") - F.get("_hits", F.lit(0))["off"])))
    x = once(x, {"utc_second": F.when(F.col("_code").isNotNull(), utc)})
    x = x.withColumn("_uyear", year_of(F.col("utc_second")))
    x = once(x, {"_uy": _tabled_year(F.col("_uyear")), "_u": F.col("utc_second") + _shift(F.col("_uyear"))})
    x = x.join(spans.select(F.col("zone").alias("_z2"), F.col("year").alias("_y2"), F.col("spans").alias("_s2")), (F.col("_tz") == F.col("_z2")) & (F.col("_uy") == F.col("_y2")), "left")
    x = once(x, {"_there": F.get(F.filter("_s2", lambda i: (i["us"] <= F.col("_u")) & (F.col("_u") < i["ue"])), F.lit(0))["off"]})
    local = F.date_add(F.lit(EPOCH).cast("date"), F.floor((F.col("utc_second") + F.col("_there")) / 86400).cast("int"))
    status = (
        F.when(F.col("_code").isNull(), "unknown_place")
        .when(F.col("utc_second").isNotNull(), "ok")
        .when(F.size("_hits") > 1, "ambiguous")
        .when(F.size("_hits") == 0, "nonexistent")
        .otherwise("unreadable")
    )
    return x.select("_row.*", "utc_second", local.alias("local_day"), status.alias("time_status"))
