"""Writing: CSV, JSON, Parquet partitioned for pruning, and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.session import put_pieces, put_text, shared_folder, ship


def to_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; dates as yyyy-mm-dd."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").csv(path, header=True)


def to_json(df: DataFrame, path: str) -> None:
    """JSON lines with ISO dates."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def to_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, one folder per value of partition_by; rows are first brought together by it, so that a partition isn't written by
    every task."""
    if partition_by:
        df.repartition(*partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def _cell(v) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")


def _head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n" + "|" + " --- |" * len(df.columns)


def _lines(df: DataFrame) -> DataFrame:
    """value: each row as a line of a markdown table, in the order of df. Python makes the cells whose text Catalyst writes in another way."""
    x = df.toDF(*[f"_{i}" for i in range(len(df.columns))])  # names may repeat
    cells = []
    for c, t in x.dtypes:
        if t == "string":
            cell = F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
        elif t in ("tinyint", "smallint", "int", "bigint", "date", "void"):
            cell = F.col(c).cast("string")
        elif t == "boolean":
            cell = F.when(F.col(c), "True").when(~F.col(c), "False")
        else:
            ship(df.sparkSession)
            cell = F.udf(_cell, "string", useArrow=False)(F.col(c))
        cells.append(F.coalesce(cell, F.lit("")))
    return x.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a markdown table; raises beyond `most` rows, as the driver holds the text (report takes any number)."""
    rows = _lines(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    return "\n".join([_head(df), *[r["value"] for r in rows]])


def report(sections: dict[str, DataFrame], path: str, title: str) -> None:
    """Each section's whole table under its name, in a file of any file system. Tables may have any number of rows: their lines are
    written by the executors and joined by put_pieces; the file is begun when all of them are there."""
    spark = SparkSession.active()
    pieces, before = [], f"# {title}\n"
    for k, v in sections.items():
        folder = shared_folder(spark)
        _lines(v).write.options(compression="none", lineSep="\n", maxRecordsPerFile=0).text(folder)
        pieces.append((f"{before}\n## {k}\n\n{_head(v)}\n", folder))
        before = ""
    put_pieces(spark, path, pieces) if pieces else put_text(spark, path, before)


def facts(values: dict, path: str) -> None:
    """A JSON file of plain values, on any file system."""
    put_text(SparkSession.active(), path, json.dumps(values, indent=1, sort_keys=True, default=str))


def percent_text(c, digits: int = 2):
    """A share as text with a percent sign."""
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))
