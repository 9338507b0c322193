"""Evaluation as plain aggregates: exact, distributed, no binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import flag
from tempestry.operators.ordered import exact_quantiles, running_totals


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n, row_share."""
    n = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn and tpr, fnr, tnr, fpr; a rate without cases is 0."""
    y, p = F.col(actual) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"tpr": _share(tp, tp + fn), "fnr": _share(fn, tp + fn), "tnr": _share(tn, tn + fp), "fpr": _share(fp, tn + fp)})


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """precision, recall, f1, support per class that is actual or predicted; 0 where undefined."""
    n = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    x = n.select(F.explode(F.array_distinct(F.array("a", "p"))).alias("class"), "a", "p", "n").where("class is not null")
    hit = F.sum(F.when((F.col("a") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0))
    support, called = F.sum(F.when(F.col("a") == F.col("class"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0))
    g = x.groupBy("class").agg(hit.alias("_h"), support.alias("support"), called.alias("_c"))
    g = g.withColumns({"precision": _share(F.col("_h"), F.col("_c")), "recall": _share(F.col("_h"), F.col("support"))})
    return g.select("class", "precision", "recall", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """macro and weighted averages of a class report, and accuracy (the weighted recall)."""
    s = F.sum("support")
    return report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[_share(F.sum(F.col(c) * F.col("support")), s).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        _share(F.sum(F.col("recall") * F.col("support")), s).alias("accuracy"),
    )


def score_counts(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """score, pos, neg per distinct score (and group), with the cumulative counts tp, fp from the highest score down.

    Scores are counted on the map side before any order is needed, then summed up over ranges (see running_totals)."""
    groups = groups or []
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running_totals(c, groups, ["score"], {"pos": "tp", "neg": "fp"}, descending=True)


def ranking(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """roc_auc (Mann-Whitney, ties half) and average_precision (step sum) per group; 0.0 where only one class is there."""
    groups = groups or []
    c = score_counts(df, label, score, groups)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5)
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    g = c.groupBy(*groups).agg(area.cast("double").alias("_a"), ap.alias("_ap"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return g.select(*groups, "positives", "negatives", F.when(both, F.try_divide(F.col("_a"), F.col("positives") * F.col("negatives").cast("double"))).otherwise(0.0).alias("roc_auc"), F.when(both, F.try_divide(F.col("_ap"), F.col("positives").cast("double"))).otherwise(0.0).alias("average_precision"))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, tpr, fpr, precision, recall, f1 (with 1e-10 in the denominator) at each distinct score."""
    c = score_counts(df, label, score)
    total = c.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    x = c.crossJoin(F.broadcast(total))  # one row
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("_P"))
    return x.select("score", r.alias("tpr"), _share(F.col("fp"), F.col("_N")).alias("fpr"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-10)).alias("f1"))


def best_f1(points: DataFrame) -> DataFrame:
    """The point with the highest f1 (ties: the higher score)."""
    return points.orderBy(F.desc("f1"), F.desc("score")).limit(1)


def log_loss(df: DataFrame, label: str, probabilities: list[str], classes: list | None = None, eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the true class's probability, held within [eps, 1 - eps]; rows of other labels are left out."""
    classes = classes if classes is not None else list(range(len(probabilities)))
    p = F.lit(None).cast("double")
    for c, name in zip(classes, probabilities, strict=True):
        p = F.when(F.col(label) == c, F.col(name)).otherwise(p)
    held = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return df.agg(F.avg(-F.log(held)).alias("log_loss"), F.count(held).alias("n"))


def regression(df: DataFrame, actual: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    """n, rmse, mae, r2 (null without spread) per group."""
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    x = df.where(e.isNotNull())
    return x.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


def decile_errors(df: DataFrame, actual: str, predicted: str, bins: int = 10) -> DataFrame:
    """bin (from 0), n, mean_actual, mean_predicted, mae, mape (over non-zero actuals) by quantile of the prediction: intervals closed on the
    right, the lowest on both sides, edges that coincide merged."""
    q = exact_quantiles(df.select(F.col(predicted).cast("double").alias("value")), [], "value", [i / bins for i in range(bins + 1)]).first()
    edges = q["q"] if q and q["q"][0] is not None else []
    inner = sorted(set(edges))[1:-1]
    b = F.lit(0)
    for e in inner:
        b = b + (F.col(predicted) > e).cast("int")
    y, err = F.col(actual), F.abs(F.col(actual) - F.col(predicted))
    return df.where(F.col(predicted).isNotNull() & y.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_actual"), F.avg(predicted).alias("mean_predicted"), F.avg(err).alias("mae"), F.avg(F.when(y != 0, err / F.abs(y))).alias("mape"))


def durbin_watson(df: DataFrame, residual: str, groups: list[str], order: list[str]) -> DataFrame:
    """Sum of squared steps over sum of squares, per group in order (groups keep the order from being global)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    r = F.col(residual).cast("double")
    x = df.where(r.isNotNull()).withColumn("_d", r - F.lag(r).over(w))
    return x.groupBy(*groups).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(r * r)).alias("durbin_watson"))


def breusch_pagan(df: DataFrame, residual: str, x: str) -> DataFrame:
    """lm = n times the R2 of the squared residuals on x, and n."""
    r2 = F.pow(F.try_divide(F.covar_pop(F.col(residual) * F.col(residual), F.col(x).cast("double")), F.stddev_pop(F.col(residual) * F.col(residual)) * F.stddev_pop(F.col(x).cast("double"))), F.lit(2.0))
    return df.where(F.col(residual).isNotNull() & F.col(x).isNotNull()).agg((r2 * F.count(F.lit(1))).alias("lm"), F.count(F.lit(1)).alias("n"))


def autocorrelation(df: DataFrame, value: str, groups: list[str], order: list[str], lags: int) -> DataFrame:
    """group, lag, acf for lags 0..lags: products of deviations k rows apart over the sum of squares."""
    g = Window.partitionBy(*groups)
    w = g.orderBy(*order)
    x = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(g))
    x = x.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(lags + 1)})
    s = x.groupBy(*groups).agg(*[F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lags + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_s0")).alias("acf")) for k in range(lags + 1)])).alias("_x")
    return s.select(*groups, rows).select(*groups, "_x.lag", "_x.acf")


def probability_histogram(df: DataFrame, score: str, label: str, bins: int = 20) -> DataFrame:
    """bin (1..bins), label, n over [0, 1], 1 in the last bin."""
    b = F.least(F.width_bucket(F.col(score).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins).cast("bigint"))
    return df.where(F.col(score).isNotNull()).groupBy(b.alias("bin"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def separation(df: DataFrame, score: str, label: str, enough: float = 0.3) -> DataFrame:
    """Mean score of either class, their distance, and whether it is over `enough`."""
    one, zero = F.avg(F.when(F.col(label) == 1, F.col(score))), F.avg(F.when(F.col(label) == 0, F.col(score)))
    return df.agg(one.alias("mean_positive"), zero.alias("mean_negative"), F.abs(one - zero).alias("distance")).withColumn("separated", F.coalesce(F.col("distance") > enough, F.lit(False)))


def confidence(df: DataFrame, actual: str, predicted: str, probabilities: list[str]) -> DataFrame:
    """actual class, correct, n, mean of the highest probability."""
    return df.groupBy(F.col(actual).alias("actual"), (F.col(actual) == F.col(predicted)).alias("correct")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(*probabilities)).alias("confidence"))


def qq_points(df: DataFrame, residual: str, points: int = 99) -> DataFrame:
    """Theoretical normal quantiles against the residuals' own, at (i - 0.5) / points."""
    from statistics import NormalDist

    p = [(i + 0.5) / points for i in range(points)]
    q = exact_quantiles(df.select(F.col(residual).cast("double").alias("value")), [], "value", p)
    z = F.array(*[F.lit(NormalDist().inv_cdf(x)) for x in p])
    return q.select(F.explode(F.arrays_zip(z.alias("theoretical"), F.col("q").alias("observed"))).alias("_x")).select(F.col("_x.theoretical").alias("theoretical"), F.col("_x.observed").alias("observed"))


def baselines(df: DataFrame, label: str, groups: list[str]) -> DataFrame:
    """What guessing gives per group: prevalence, majority_accuracy, auroc (0.5), auprc (the prevalence)."""
    p = F.avg(flag(F.col(label) == 1).cast("double"))
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), p.alias("prevalence")).withColumns({"majority_accuracy": F.greatest(F.col("prevalence"), 1 - F.col("prevalence")), "auroc": F.lit(0.5), "auprc": F.col("prevalence")})
