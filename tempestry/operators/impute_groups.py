"""Missing values filled from similar records: k-prototypes clusters with parent fallback."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.session import written

# Texts that stand for no value.
PLACEHOLDERS = ("", "-", "--", ".", "?", "n/a", "na", "nan", "none", "null", "nil", "unknown", "unspecified", "missing", "m", "#ref", "#n/a", "tbd")


@dataclass
class Prototypes:
    """Fitted centres: per cluster the mean of each standardised numeric feature and the mode of each category (None
    where the cluster has none), with the features' means and deviations. Its size is k times the features."""

    numeric: list[str]
    categorical: list[str]
    mean: dict[str, float]
    sd: dict[str, float]
    centres: list[dict[str, object]]
    gamma: float

    def assign(self) -> Column:
        """The nearest centre's number over the features that a record has; ties go to the lower number."""
        parts = []
        for i, c in enumerate(self.centres):
            terms = [F.coalesce(F.pow((F.col(f) - self.mean[f]) / self.sd[f] - float(c[f]), F.lit(2.0)), F.lit(0.0)) for f in self.numeric if c.get(f) is not None]
            terms += [F.coalesce((F.col(f) != F.lit(c[f])).cast("double"), F.lit(0.0)) * self.gamma for f in self.categorical if c.get(f) is not None]
            parts.append(F.struct(reduce(lambda a, b: a + b, terms, F.lit(0.0)).alias("d"), F.lit(i).alias("i")))
        return F.array_min(F.array(*parts))["i"]


def fit_prototypes(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 8, rounds: int = 20, gamma: float = 1.0, still: float = 0.02) -> Prototypes:
    """k-prototypes over all rows: squared distance of standardised numbers plus gamma per differing category, over the
    features each record has.

    One pass gives means, deviations, quantiles and modes; the first centres are the quantiles at (i + 1/2) / k of all numbers, so
    there is no random part. Each round is one pass of map-side combined aggregates that returns k rows, until no centre moves by
    `still` deviations or changes a category, or after `rounds`. On an empty table, or with fewer different rows than clusters, empty
    clusters vanish; there is at least one."""
    points = [(i + 0.5) / k for i in range(k)]
    stats = [x for f in numeric for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.percentile_approx(f, points, 1000).alias(f"q_{f}"))]
    s = df.agg(*stats, *[F.mode(F.col(f), True).alias(f"c_{f}") for f in categorical]).first()
    mean = {f: float(s[f"m_{f}"] or 0.0) for f in numeric}
    sd = {f: float(s[f"s_{f}"] or 0.0) or 1.0 for f in numeric}
    first = [{f: (s[f"q_{f}"][i] - mean[f]) / sd[f] if s[f"q_{f}"] else None for f in numeric} | {f: s[f"c_{f}"] for f in categorical} for i in range(k)]
    p = Prototypes(numeric, categorical, mean, sd, first, gamma)
    aggs = [F.avg((F.col(f) - mean[f]) / sd[f]).alias(f) for f in numeric] + [F.mode(F.col(f), True).alias(f) for f in categorical]
    for _ in range(rounds):
        got = {r["_k"]: r.asDict() for r in df.groupBy(p.assign().alias("_k")).agg(*aggs).collect()}  # k rows
        new = [{f: got[i][f] for f in [*numeric, *categorical]} for i in sorted(got)] or [dict.fromkeys([*numeric, *categorical])]
        moved = len(new) != len(p.centres) or any((a[f] is None) != (b[f] is None) or (a[f] is not None and (a[f] != b[f] if f in categorical else abs(a[f] - b[f]) >= still)) for a, b in zip(new, p.centres, strict=True) for f in a)
        p.centres = new
        if not moved:
            break
    return p


def fill_from_similar(
    df: DataFrame,
    entity: str,
    day: str,
    numeric: list[str],
    categorical: list[str],
    features: list[str] | None = None,
    k: int = 8,
    support: int = 5,
) -> DataFrame:
    """df's entity and day with the fields filled, and per field F a column F_fill: null if it was there, else how it was
    filled.

    Takes one row per entity and day, unusable values already null. Records are clustered by k-prototypes over the
    fields and further numeric features; a missing number gets the median, a missing category the mode (ties: the
    lower), of the first of these that has at least `support` values: entity_month_cluster, entity_cluster,
    entity_month, entity, then of any size day_cluster, day, cluster, all. `unfilled`: no record at all has the
    field. Medians are sketches of bounded size (relative rank error 1/10,000). Rows with a null entity or day are
    left out.

    The first level, which fills nearly all, is a window in one partitioning by entity (a group is bounded by the calendar, as an
    entity has one row a day). Only the cells it leaves go on: each further level aggregates the groups that still have such a
    cell, combined on the map side, and is joined to those cells; when none is left the rest is skipped."""
    fields = [*numeric, *categorical]
    extra = [f for f in features or [] if f not in fields]
    x = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_d"), *fields, *extra)
    x = written(x.withColumn("_month", F.month("_d")))
    model = fit_prototypes(x, [*numeric, *extra], categorical, k)
    x = x.withColumn("_cluster", model.assign()).select("_e", "_d", "_month", "_cluster", *fields)
    middle = lambda f: F.percentile_approx(f, 0.5, 10_000) if f in numeric else F.mode(F.col(f), True)
    w = Window.partitionBy("_e", "_month", "_cluster")
    near = {f"_1_{f}": F.when(F.count(f).over(w) >= support, middle(f).over(w)) for f in fields}
    x = x.repartition("_e").withColumns(near)
    x = written(x.withColumns({f"_1_{f}": F.when(F.col(f).isNull(), F.col(f"_1_{f}")) for f in fields}))
    lost = F.array_compact(F.array(*[F.when(F.col(f).isNull() & F.col(f"_1_{f}").isNull(), F.lit(f)) for f in fields]))
    cells = written(x.select("_e", "_d", "_month", "_cluster", F.explode(lost).alias("field")).withColumns({"num": F.lit(None).cast("double"), "cat": F.lit(None).cast("string"), "how": F.lit(None).cast("string")}))
    levels = {"entity_cluster": ["_e", "_cluster"], "entity_month": ["_e", "_month"], "entity": ["_e"], "day_cluster": ["_d", "_cluster"], "day": ["_d"], "cluster": ["_cluster"], "all": []}
    pick = lambda fs, null: reduce(lambda a, f: F.when(F.col("field") == f, F.col(f"_v_{f}")).otherwise(a), fs, F.lit(None).cast(null))
    left = cells.count()
    for name, keys in levels.items():
        if not left:
            break
        least = support if "_e" in keys else 1
        groups = x.join(cells.where("how is null").select(*keys).distinct(), keys, "left_semi") if keys else x
        table = groups.groupBy(*keys).agg(*[F.when(F.count(f) >= least, middle(f)).alias(f"_v_{f}") for f in fields])
        got = cells.join(table, keys, "left") if keys else cells.crossJoin(F.broadcast(table))  # one row
        num, cat = pick(numeric, "double"), pick(categorical, "string")
        found = F.col("how").isNull() & (num.isNotNull() | cat.isNotNull())
        cells = written(got.select("_e", "_d", "_month", "_cluster", "field", *[F.when(found, v).otherwise(F.col(c)).alias(c) for c, v in (("num", num), ("cat", cat), ("how", F.lit(name)))]))
        left = cells.where("how is null").count()
    wide = cells.groupBy("_e", "_d").agg(
        *[F.max(F.when(F.col("field") == f, F.col("num" if f in numeric else "cat"))).alias(f"_2_{f}") for f in fields],
        *[F.max(F.when(F.col("field") == f, F.col("how"))).alias(f"_h_{f}") for f in fields],
    )
    x = x.join(wide, ["_e", "_d"], "left")
    cols = []
    for f in fields:
        cols.append(F.coalesce(f, f"_1_{f}", f"_2_{f}").alias(f))
        how = F.when(F.col(f"_1_{f}").isNotNull(), "entity_month_cluster").otherwise(F.coalesce(f"_h_{f}", F.lit("unfilled")))
        cols.append(F.when(F.col(f).isNull(), how).alias(f"{f}_fill"))
    return x.select(F.col("_e").alias(entity), F.col("_d").alias(day), *cols)


def usable_wind(c: Column) -> Column:
    """A wind speed in m/s that wind can have, else null (NaN, negative, or above the record gust)."""
    return F.when(~F.isnan(c) & c.between(0.0, 114.0), c)


def usable_name(c: Column) -> Column:
    """A text that is no placeholder, else null."""
    return F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), c)


def filled_cells(filled: DataFrame, entity: str, day: str, fields: list[str]) -> DataFrame:
    """entity, day, field, method of each cell that was missing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_fill").alias("method")) for f in fields])).alias("_x")
    return filled.select(entity, day, pairs).select(entity, day, "_x.field", "_x.method").where(F.col("method").isNotNull())
