"""Reading: files with drifting names and columns, dimensions, stations, paged services."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tempestry.operators.outages import denominators
from tempestry.operators.weather import union_by_name
from tempestry.session import list_files, ship, small

# Names under which the snapshot columns are delivered, by canonical name, in order of preference.
SNAPSHOT_NAMES = {
    "fips_code": ("fips_code", "county_fips", "fips", "fips5", "county_fips_code"),
    "customers_out": ("customers_out", "sum", "customers_affected", "customers_interrupted", "customers_outstanding", "outage_customers", "affected_customers", "customer_out", "cust_out", "n_customers_out"),
    "run_start_time": ("run_start_time", "run_time", "interval_start_time", "interval_start", "timestamp_utc", "start_time_utc", "start_time", "observation_time_utc", "time_utc", "timestamp", "datetime_utc"),
    "customers_total": ("total_customers", "customers_total", "customers"),
}
REQUIRED = ("fips_code", "customers_out", "run_start_time")
YEAR_FILE = re.compile(r"^outages_daily_(20\d{2})\.csv$")


def resolve_names(columns: list[str], names: dict[str, tuple[str, ...]] = SNAPSHOT_NAMES, required: tuple[str, ...] = REQUIRED) -> dict[str, str]:
    """canonical -> the column that has it: the first candidate that is there, whatever the case. Raises naming what required ones are
    missing."""
    lower: dict[str, str] = {}
    for c in columns:
        lower.setdefault(c.strip().lower(), c)
    found = {k: next(lower[n] for n in cs if n in lower) for k, cs in names.items() if any(n in lower for n in cs)}
    lost = [k for k in required if k not in found]
    if lost:
        raise ValueError(f"no column for {lost} among {columns}")
    return found


def canonical(df: DataFrame, names: dict[str, tuple[str, ...]] = SNAPSHOT_NAMES, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """df's columns under their canonical names; optional ones that are missing are null."""
    found = resolve_names(df.columns, names, required)
    return df.select(*[(F.col(f"`{found[k]}`") if k in found else F.lit(None).cast("string")).alias(k) for k in names])


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV (texts, header), JSON or Parquet file or folder by its ending; only `columns` if given (pruned in the scan)."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    df = spark.read.csv(path, header=True) if end == "csv" else spark.read.json(path) if end in ("json", "jsonl") else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def probe(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Column names and types, without reading rows (CSV: the header line alone)."""
    return read_any(spark, path).dtypes


def snapshots(spark: SparkSession, path: str, places: list[str] | None = None) -> DataFrame:
    """Canonical snapshots of a file, of some counties if given; numbers and times read leniently."""
    from tempestry.functions.columns import fips5

    x = canonical(read_any(spark, path))
    x = x.select(fips5(F.col("fips_code").cast("string")).alias("fips_code"), F.col("customers_out").cast("string").try_cast("double").cast("bigint").alias("customers_out"), F.col("run_start_time").cast("string").try_cast("timestamp").alias("ts"), F.col("customers_total").cast("string").try_cast("double").cast("bigint").alias("customers_total"))
    return x.where(F.col("fips_code").isin(places)) if places else x


def yearly_files(spark: SparkSession, folder: str, pattern: re.Pattern = YEAR_FILE, skip: str = "combined") -> dict[int, str]:
    """year -> file, for names that match strictly and don't contain `skip`, in a folder of any file system."""
    names = {p: p.rsplit("/", 1)[-1] for p in list_files(spark, folder)}
    return {int(m.group(1)): p for p, name in names.items() if (m := pattern.match(name)) and skip not in name}


def county_years(spark: SparkSession, files: list[str], counties: DataFrame) -> DataFrame:
    """Files named ..._<fips>_<year>.csv as one table: united by name, with fips_code and year of the name and the county's columns.

    Files of one header are read together (a header line each is all that is read beforehand), so there is a scan per kind of header,
    not per file."""
    heads: dict[str, list[str]] = {}
    for f in files:
        heads.setdefault(spark.read.option("wholetext", False).text(f).limit(1).first()[0], []).append(f)
    parts = [spark.read.csv(fs, header=True, enforceSchema=False).withColumn("_file", F.col("_metadata.file_name")) for fs in heads.values()]
    x = union_by_name(parts)
    x = x.withColumn("fips_code", F.regexp_extract("_file", r"(\d{5})_20\d{2}", 1)).withColumn("year", F.regexp_extract("_file", r"(20\d{2})\.csv$", 1).try_cast("int")).drop("_file")
    return x.join(small(counties), "fips_code", "left")


def resolve_dataset(spark: SparkSession, folder: str, path: str | None = None, names: tuple[str, ...] = ("encoded", "standardized", "capped", "imputed", "merged")) -> list[str]:
    """An explicit path; else the first of the named files that is there; else all CSV and Parquet files of the folder (of any file
    system)."""
    if path:
        return [path]
    files = [p for p in list_files(spark, folder) if p.rsplit(".", 1)[-1] in ("csv", "parquet")]
    for n in names:
        if hit := [f for f in files if n in f.rsplit("/", 1)[-1].rsplit(".", 1)[0]]:
            return hit[:1]
    if not files:
        raise FileNotFoundError(folder)
    return files


def customer_denominators(spark: SparkSession, path: str) -> DataFrame:
    """fips_code, customers_total of a file with County_FIPS and Customers."""
    x = read_any(spark, path)
    return denominators(x, "County_FIPS", "Customers") if dict(x.dtypes)["Customers"] != "string" else denominators(x.withColumn("Customers", F.col("Customers").try_cast("bigint")), "County_FIPS", "Customers")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Station metadata of a JSON array."""
    return spark.read.schema("id string, name string, latitude double, longitude double, elevation double, elevationUnit string, mindate date, maxdate date, datacoverage double").json(path, multiLine=True)


def selected_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep and features; raises with the names that aren't there."""
    lost = [f for f in features if f not in df.columns]
    if lost:
        raise ValueError(f"features not there: {lost}")
    return df.select(*keep, *[f for f in features if f not in keep])


def reconstruct_day(df: DataFrame) -> DataFrame:
    """df with day: as it is, or from year and day_of_year, or the 15th of year and month; null if none can be made."""
    have = set(df.columns)
    day = F.col("day").cast("string").try_cast("date") if "day" in have else F.lit(None).cast("date")
    if {"year", "day_of_year"} <= have:
        y, n = F.col("year").cast("int"), F.col("day_of_year").cast("int")
        day = F.coalesce(day, F.when(n.between(1, 366), F.date_add(F.make_date(y, F.lit(1), F.lit(1)), n - 1)))
    if {"year", "month"} <= have:
        y, m = F.col("year").cast("int"), F.col("month").cast("int")
        day = F.coalesce(day, F.when(m.between(1, 12), F.make_date(y, m, F.lit(15))))
    return df.withColumn("day", day)


class _Page(InputPartition):
    def __init__(self, queries: list[str]) -> None:
        self.queries = queries


class PagedReader(DataSourceReader):
    """Reads queries dealt to at most `parallel` partitions, page by page: offset grows by limit until the announced count or a short page; requests are spaced and
    failures of 502 to 504 are tried again with growing pauses."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        queries = self.options.get("queries", "").split("|")
        n = max(1, min(len(queries), int(self.options.get("parallel", PARALLEL))))
        return [_Page(queries[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        for query in partition.queries:
            # A query may name another after ">", asked only if it has no result (fewer datatypes, say).
            for q in query.split(">"):
                some = False
                for record in paged(o["url"], q, int(o.get("limit", 1000)), float(o.get("pause", 0.5)), int(o.get("tries", 5)), {"token": o["token"]} if o.get("token") else {}):
                    some = True
                    yield (json.dumps(record, sort_keys=True),)
                if some:
                    break


class PagedSource(DataSource):
    """spark.read.format("paged_json").option("url", ...).option("queries", "a=1|a=2"): one row of JSON per result."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format paged_json known to the session."""
    ship(spark)
    spark.dataSource.register(PagedSource)


def paged(url: str, query: str, limit: int, pause: float, tries: int, headers: dict[str, str], fetch: Callable[[str, dict[str, str]], dict] | None = None) -> Iterator[dict]:
    """The results of all pages. The service answers {"metadata": {"resultset": {"count": n}}, "results": [...]}; without a count, a
    page shorter than limit is the last. Raises after `tries` failures of one page."""
    import urllib.error
    import urllib.request

    def get(address: str, h: dict[str, str]) -> dict:
        with urllib.request.urlopen(urllib.request.Request(address, headers=h), timeout=60) as r:  # noqa: S310
            return json.loads(r.read() or b"{}")

    offset, last = 1, 0.0
    while True:
        address = f"{url}?{query}{'&' if query else ''}limit={limit}&offset={offset}"
        for attempt in range(tries):
            time.sleep(max(0.0, last + pause - time.time()))
            last = time.time()
            try:
                page = (fetch or get)(address, headers)
                break
            except urllib.error.HTTPError as e:
                if e.code not in (502, 503, 504) or attempt == tries - 1:
                    raise
                time.sleep(pause * 2**attempt)
        results = page.get("results", [])
        yield from results
        count = page.get("metadata", {}).get("resultset", {}).get("count")
        offset += limit
        if (offset > count) if count is not None else (len(results) < limit):
            return


#: At most so many requests of one reader at once, over all its tasks: queries are dealt to so many partitions, each of which asks for one page at
#: a time, and a partition's pause is kept between its requests.
PARALLEL = 5
# The datatypes asked for, and those asked for where a county answers nothing to them.
DATATYPES_ALL = ("PRCP", "TMAX", "TMIN", "WSF2", "AWND", "WSF5", "WT01", "WT02", "WT03", "WT04", "WT05", "WT06", "WT08", "WT11")
DATATYPES_BASE = ("PRCP", "TMAX", "TMIN")


def quarter_queries(location: str, year: int, datatypes: tuple[str, ...] = DATATYPES_ALL, base: tuple[str, ...] = ()) -> list[str]:
    """The queries of a county-year in quarters, with the datatype filter on the server's side; with base datatypes, each falls back to these
    where it has no result."""
    ends = (("01-01", "03-31"), ("04-01", "06-30"), ("07-01", "09-30"), ("10-01", "12-31"))
    ask = lambda a, b, kinds: f"locationid={location}&startdate={year}-{a}&enddate={year}-{b}&" + "&".join(f"datatypeid={d}" for d in kinds)
    return [ask(a, b, datatypes) + (">" + ask(a, b, base) if base else "") for a, b in ends]
