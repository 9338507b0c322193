"""Spikes, stuck values and impossible readings, judged against each source's own behaviour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import once
from tempestry.session import written


@dataclass(frozen=True)
class Measure:
    """How one numeric field behaves: its physical range, whether its level follows the season, whether it has a lower
    tail, and whether zeros stand apart (rain: only wet days make the tail)."""

    name: str
    low: float
    high: float
    seasonal: bool = False
    two_sided: bool = False
    zero_apart: bool = False


# World records of air temperature (deg C), wind gust (m/s) and rain in a day (mm), rounded outwards.
WEATHER_MEASURES = (
    Measure("TMAX", -90.0, 57.0, seasonal=True, two_sided=True),
    Measure("WSF5", 0.0, 114.0),
    Measure("PRCP", 0.0, 1900.0, zero_apart=True),
)
#: A source without scatter keeps the instruments' resolution as its scale.
RESOLUTION = 0.05
#: What a source's own tail weighs against all sources': its excesses against so many of theirs, for the shape and for the scale.
SHAPE_PRIOR, SCALE_PRIOR = 500.0, 5.0


def _quantile(sorted_values: Column, p: float) -> Column:
    """Of a sorted array, by linear interpolation; null of an empty one."""
    at = (F.size(sorted_values) - 1) * F.lit(p)
    lo = F.floor(at).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, F.least(lo + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (at - lo)


def fit_tails(rows: DataFrame, false_alarms: float) -> DataFrame:
    """_s, field, cutoff: one row per source and field of rows (_s, field, _x: how far a plausible reading lies out, or null).

    Peaks over threshold. The risk is false_alarms divided by the source's readings, so that every source expects as many false
    alarms. A first round, exponential over the third quartile with the scale of the quartile above it, leaves out what lies
    beyond its cutoff. Of the rest, the excesses over the 90th percentile are fitted by a generalised Pareto distribution with
    probability-weighted moments. A shape from some ten to a hundred excesses is uncertain, so the ratio of moments that gives it is drawn
    towards that of all sources by SHAPE_PRIOR excesses (theirs, in turn, towards the exponential's by as many, which counts where there are
    few sources), and the scale by SCALE_PRIOR: a long record keeps its own tail, a short one
    gets a cutoff too. A shape under 0 would have the tail end, at little more than the largest value seen, which no record proves;
    it counts as 0 (exponential). The cutoff is what a reading passes with the risk; null where no source has an excess.

    A source's values are one sorted array; it is bounded by the calendar, as there is one reading a day."""
    x = rows.groupBy("_s", "field").agg(F.sort_array(F.collect_list("_x")).alias("_xs")).withColumn("_n", F.size("_xs")).where("_n > 0")
    x = x.withColumn("_risk", F.lit(false_alarms) / F.col("_n"))
    q75, q87 = _quantile(F.col("_xs"), 0.75), _quantile(F.col("_xs"), 0.875)
    first = q75 + F.greatest((q87 - q75) / F.log(F.lit(2.0)), F.lit(RESOLUTION)) * F.log(0.25 / F.col("_risk"))
    x = once(x, {"_first": first})
    x = once(x, {"_ys": F.filter("_xs", lambda v: v <= F.col("_first"))})
    x = once(x, {"_u": _quantile(F.col("_ys"), 0.9)})
    x = once(x, {"_es": F.filter(F.transform("_ys", lambda v: v - F.col("_u")), lambda e: e > 0)})
    m = F.size("_es")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    weighted = F.transform("_es", lambda e, i: e * (1.0 - (i + 0.65) / m))
    x = once(x.select("_s", "field", "_u", "_risk", "_n", "_es"), {"_m": m, "_a0": F.try_divide(total(F.col("_es")), m.cast("double")), "_a1": F.try_divide(total(weighted), m.cast("double"))}).drop("_es")
    x = written(x)
    both = F.try_divide(F.col("_a1"), F.col("_a0"))
    pool = x.groupBy("field").agg(((F.coalesce(F.sum(both * F.col("_m")), F.lit(0.0)) + 0.25 * SHAPE_PRIOR) / (F.sum("_m") + SHAPE_PRIOR)).alias("_t"), F.try_divide(F.sum(F.col("_a0") * F.col("_m")), F.sum("_m")).alias("_a"))
    x = x.join(F.broadcast(pool), "field")  # one row a measure
    own = F.col("_m").cast("double")
    t = (F.coalesce(both, F.lit(0.0)) * own + F.col("_t") * SHAPE_PRIOR) / (own + SHAPE_PRIOR)
    mean = F.greatest((F.coalesce("_a0", F.lit(0.0)) * own + F.col("_a") * SCALE_PRIOR) / (own + SCALE_PRIOR), F.lit(RESOLUTION))
    shape = F.greatest(F.lit(1e-6), F.least(F.lit(0.5), 2.0 - 1.0 / (1.0 - 2.0 * t)))
    x = once(x, {"_shape": shape, "_mean": mean})
    scale = F.col("_mean") * (1.0 - F.col("_shape"))
    beyond = F.greatest(own, F.lit(1.0)) / F.col("_n")
    cutoff = F.col("_u") + scale / F.col("_shape") * (F.pow(F.col("_risk") / beyond, -F.col("_shape")) - 1)
    return x.select("_s", "field", F.when(F.col("_a").isNotNull(), cutoff).alias("cutoff"))


def flag_readings(df: DataFrame, source: str, day: str, measures: tuple[Measure, ...] = WEATHER_MEASURES, season_days: int = 15, stuck: int = 5, false_alarms: float = 0.003) -> DataFrame:
    """One row per reading: source, day, field, value, residual, cutoff, impossible, spike, stuck.

    Takes one row per source and day. Null and NaN are no readings. `impossible`: outside the physical range.
    `spike`: peaks over threshold. The residual is the reading less the source's median of the season (+- season_days
    around that day of the year, over all years) or of the source; fit_tails gives the cutoff at a risk of false_alarms a source and
    field. A reading beyond it counts if it stands alone: neither neighbouring reading within two days goes more than half as
    far to the same side, so weather that builds up over days is no case. `stuck`: one of at least `stuck` consecutive
    readings of one value other than 0. Rows with a null source or day are left out. Ties in a day are not expected (one row per
    day); they are kept.

    Readings are shuffled once, by (source, field); the seasons' medians are made once a day of the year, from the values of each, and
    joined where they lie; readings with their residuals are then written, as the tails of all sources must be known first.
    Windows and arrays are per source and field: bounded by the calendar, as there is one reading a day."""
    names = [m.name for m in measures]
    value = F.col("value")
    any_of = lambda pick: F.col("field").isin([m.name for m in measures if pick(m)] or [""])
    low = F.create_map(*[x for m in measures for x in (F.lit(m.name), F.lit(m.low))])[F.col("field")]
    high = F.create_map(*[x for m in measures for x in (F.lit(m.name), F.lit(m.high))])[F.col("field")]
    keys = ["_s", "field"]
    long = (
        df.where(F.col(source).isNotNull() & F.col(day).isNotNull())
        .select(F.col(source).alias("_s"), F.col(day).cast("date").alias("_d"), *[F.col(n).cast("double").alias(f"_v{i}") for i, n in enumerate(names)])
        .select("_s", "_d", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_v{i}").alias("value")) for i, n in enumerate(names)])).alias("_x"))
        .select("_s", "_d", "_x.field", "_x.value")
        .where(value.isNotNull() & ~F.isnan("value"))
        .withColumn("impossible", (value < low) | (value > high))
        .repartition(*keys)
    )
    plausible = F.when(~F.col("impossible"), value)
    fits = F.when(any_of(lambda m: m.zero_apart), F.when(value != 0, plausible)).otherwise(plausible)
    doy = F.dayofyear("_d")
    # The values of each day of the year; those near the year's ends also stand, as ghosts, beyond the other end.
    shifts = F.when(F.col("_y") > 365 - season_days, F.array("_y", F.col("_y") - 365)).when(F.col("_y") <= season_days, F.array("_y", F.col("_y") + 365)).otherwise(F.array("_y"))
    by_day = long.where(any_of(lambda m: m.seasonal)).groupBy(*keys, doy.alias("_y")).agg(F.collect_list(plausible).alias("_vs"))
    by_day = by_day.select(*keys, "_y", "_vs", F.explode(shifts).alias("_p"))
    season = F.sort_array(F.flatten(F.collect_list("_vs").over(Window.partitionBy(*keys).orderBy("_p").rangeBetween(-season_days, season_days))))
    medians = once(by_day.withColumn("_all", season).where("_p = _y"), {"_median": _quantile(F.col("_all"), 0.5)})
    seasons = medians.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_y", "_median"))).alias("_season"))
    overall = long.groupBy(*keys).agg(F.percentile(fits, 0.5).alias("_overall"))
    level = F.when(any_of(lambda m: m.seasonal), F.try_element_at("_season", doy)).otherwise(F.col("_overall"))
    x = long.join(overall.hint("merge"), keys).join(seasons.hint("merge"), keys, "left").withColumn("residual", value - level)
    side = F.when(any_of(lambda m: m.two_sided), F.abs("residual")).otherwise(F.col("residual"))
    x = written(x.select(*keys, "_d", "value", "impossible", "residual", side.alias("_x"), fits.isNotNull().alias("_fits")))
    tails = fit_tails(x.select(*keys, F.when(F.col("_fits"), F.col("_x")).alias("_x")), false_alarms)
    x = x.join(tails, keys, "left")
    w = Window.partitionBy(*keys).orderBy("_d", "value")

    def leans(step) -> Column:
        other, when = step("residual").over(w), step("_d").over(w)
        near = F.abs(F.datediff("_d", when)) <= 2
        return F.coalesce(near & ~step("impossible").over(w) & (F.signum("residual") == F.signum(other)) & (F.abs(other) > 0.5 * F.abs("residual")), F.lit(False))

    spike = ~F.col("impossible") & F.coalesce(F.col("_x") > F.col("cutoff"), F.lit(False)) & ~(leans(F.lag) | leans(F.lead))
    x = x.withColumn("spike", spike).withColumn("_new", F.coalesce((value != F.lag("value").over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))
    x = x.withColumn("stuck", (value != 0) & (run >= stuck))
    return x.select(F.col("_s").alias(source), F.col("_d").alias(day), "field", "value", "residual", "cutoff", "impossible", "spike", "stuck")
