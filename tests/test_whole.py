"""Queries and operators do the whole job: nothing readable is left out."""

from datetime import date, datetime

import pytest
from parity import connect, table
from pyspark.sql import functions as F

from tempestry.operators import blockpivot, features, rolling, weather
from tempestry.plans import inventory, problems, reference  # noqa: F401  (inventory adds to reference)

D = date(2024, 1, 1)


def test_first_values_in_all_spellings(spark, tmp_path):
    texts = {"PRCP": " 0,5 ", " TMAX": "1", "tmin": "0.000E+00", "Wsf2": ".5", "AWND ": "+3", "WT01": "Y", "wt02": "no", "WT03": "true", "WSF5": "M"}
    obs = [("GHCND:S1", datetime(2024, 1, 1), k, v, datetime(2024, 1, 2)) for k, v in texts.items()]
    obs += [("s1", datetime(2024, 1, 1), "PRCP", "9.0", datetime(2024, 1, 3)), (" ghcnd:s1", datetime(2024, 1, 1, 5), "prcp", "x", datetime(2024, 1, 1))]
    spark.createDataFrame(obs, "station string, date timestamp_ntz, datatype string, value string, retrieved_at timestamp").write.parquet(f"{tmp_path}/weather_obs.parquet")
    spark.createDataFrame([("GHCND:S1",)], "id string").write.parquet(f"{tmp_path}/stations.parquet")
    [r] = reference.QUERIES["r01_pivot_first"](spark, str(tmp_path)).collect()
    want = {"PRCP": 0.5, "TMAX": 1.0, "TMIN": 0.0, "WSF2": 0.5, "AWND": 3.0, "WT01": 1.0, "WT02": 0.0, "WT03": 1.0}
    assert r.asDict() == {"station": "GHCND:S1", "day": D} | dict.fromkeys(weather.DATATYPES) | want


def test_first_values_against_cells(spark, root):
    """The rule of r01_pivot_first over the cells of p7, in DuckDB."""
    cells = problems._CELLS.replace("AS v FROM", "AS v, retrieved_at FROM").replace("SELECT station, day, datatype, coalesce", "SELECT station, CAST(day AS DATE) AS day, datatype, retrieved_at, coalesce")
    sql = cells + ", r AS (SELECT *, row_number() OVER (PARTITION BY station, day, datatype ORDER BY x IS NULL, retrieved_at, x) AS k FROM n) SELECT station, day, " + ", ".join(f"max(CASE WHEN datatype = '{d}' AND k = 1 THEN x END) AS {d}" for d in weather.DATATYPES) + " FROM r GROUP BY 1, 2"
    df, rel = reference.QUERIES["r01_pivot_first"](spark, root), connect(root).sql(sql)
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())


def test_latest_row_without_order(spark, rows):
    """A row whose order is null stays where there is no other, as in the SQL."""
    df = spark.createDataFrame([("a", None, 5.0), ("b", None, 9.0), ("b", 1, 6.0), ("c", 1, 7.0), ("c", 2, None)], "k string, t int, v double")
    assert rows(rolling.latest_rows(df, ["k"], ["v"], "t")) == [("a", 5.0), ("b", 6.0), ("c", None)]


def test_too_many_attributes_raise(spark, root, monkeypatch):
    monkeypatch.setattr(blockpivot, "MAX_ATTRIBUTES", 2)
    for q in ("p7_wide", "p7_found"):
        with pytest.raises(ValueError, match="more attributes"):
            problems.QUERIES[q](spark, root)


def test_row_predicates_see_every_row(spark, root):
    df = reference.QUERIES["p12_row_predicates"](spark, root)
    wx = connect(root).sql(f"WITH {reference.WX} SELECT county_fips, day, (WT01 IS NULL AND WT02 IS NULL AND WT03 IS NULL)::INTEGER AS all_null, (AWND IS NULL OR WSF2 IS NULL OR WSF5 IS NULL)::INTEGER AS any_null, county_fips IN ('07001', '43001') AS in_counties, TMAX BETWEEN -20 AND 45 AS in_range FROM wx")
    assert table(df.columns, df.collect()) == table(wx.columns, wx.fetchall())


def test_consensus_of_real_selections(spark, root):
    got = {r["feature"]: r["methods"] for r in reference.QUERIES["m08_consensus"](spark, root).collect()}
    assert set(got) <= {f for fs in features.GROUPS.values() for f in fs} and set(got.values()) == {2, 3}


def test_kinds_of_all_features(spark, root):
    got = {r["feature"]: r["kind"] for r in reference.QUERIES["m09_kinds"](spark, root).collect()}
    assert got.keys() >= {f for fs in features.GROUPS.values() for f in fs} and got.items() >= reference.NAMES.items()


def test_report_of_many_counties(spark, tmp_path):
    """s17_report against its SQL with more counties than the driver would take as one markdown text."""
    n = 1_201
    connect(str(tmp_path)).sql(f"COPY (SELECT lpad(i::VARCHAR, 5, '0') AS fips_code, 'County | ' || i AS name FROM range({n}) t(i)) TO '{tmp_path}/counties.parquet' (FORMAT parquet)")
    df, rel = reference.QUERIES["s17_report"](spark, str(tmp_path)), connect(str(tmp_path)).sql(reference.ORACLE["s17_report"])
    assert df.collect() == rel.fetchall() == [(n + 7, n + 1)]
