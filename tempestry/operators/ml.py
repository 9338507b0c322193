"""Training and evaluation with MLlib: splits, folds, searches, estimators, persistence."""

from __future__ import annotations

import json
import random
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import denan
from tempestry.operators import metrics
from tempestry.operators.ordered import exact_quantiles, running_totals
from tempestry.session import get_text, put_text, written


def temporal_split(df: DataFrame, year: str, train_to: int, validate: int, test: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of years up to train_to, of validate and of test."""
    y = F.col(year)
    return df.where(y <= train_to), df.where(y == validate), df.where(y == test)


def stratified_split(df: DataFrame, label: str, key: list[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """df with split `train` or `test`: of each class of n rows, exactly floor(n train + 1/2) are `train`, those first in the order of a hash of
    the key (ties: by the key). Rows that share a key are told apart by no more than their order.

    Hashes are counted by class in 4,096 ranges; only the one range that a class's boundary falls into is ranked, so no class is
    sorted in one task. A null label is a class of its own."""
    x = df.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1)).withColumn("_b", F.shiftright("_u", 51))
    x = x.withColumn("_l", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    n = x.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_l")
    n = n.select("_l", "_b", "_n", F.sum("_n").over(w.orderBy("_b")).alias("_upto"), F.floor(F.sum("_n").over(w) * train + 0.5).alias("_take"))  # at most 4,096 rows a class
    edge = n.where((F.col("_upto") > F.col("_take")) & (F.col("_upto") - F.col("_n") <= F.col("_take"))).groupBy("_l").agg(F.min(F.struct("_b", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_of"))).alias("_e"))
    x = x.join(F.broadcast(edge), "_l", "left")  # one row a class
    at = F.row_number().over(Window.partitionBy("_l", "_b", F.col("_b") == F.col("_e._b"), F.when(F.col("_b") != F.col("_e._b"), F.col("_u"))).orderBy("_u", *key))
    side = F.when(F.col("_e").isNull() | (F.col("_b") < F.col("_e._b")), "train").when(F.col("_b") > F.col("_e._b"), "test").otherwise(F.when(at <= F.col("_e._of"), "train").otherwise("test"))
    return x.withColumn("split", side).drop("_u", "_b", "_l", "_e")


def stratified_folds(df: DataFrame, label: str, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1 by hash of class and key, for CrossValidator's foldCol."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(label).cast("string"), *key), F.lit(k)).cast("int"))


def rolling_folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """df with fold: 0 for the first block, i for the i-th test block of a rolling origin (blocks of n // (k + 1) rows by order, the first
    takes the rest). Fold i trains on all blocks before it. Positions come from running counts per value of the first order
    column, so that no single task sorts the table. Rows with a null there are left out."""
    first = order[0]
    base = running_totals(df.groupBy(first).agg(F.count(F.lit(1)).alias("_c")), [], [first], {"_c": "_upto"})
    base = base.crossJoin(F.broadcast(base.agg(F.sum("_c").alias("_n")))).select(first, (F.col("_upto") - F.col("_c")).alias("_base"), "_n")  # one row
    inside = Window.partitionBy(first).orderBy(*order[1:]) if order[1:] else Window.partitionBy(first).orderBy(F.lit(1))
    x = df.join(base, first).withColumn("_at", F.col("_base") + F.row_number().over(inside) - 1)
    size = F.floor(F.col("_n") / (k + 1))
    head = F.col("_n") - k * size
    return x.withColumn("fold", F.when(F.col("_at") < head, 0).otherwise(F.floor((F.col("_at") - head) / size) + 1).cast("int")).drop("_base", "_n", "_at")


def severity(value: Column, threshold: float) -> Column:
    """0 for nothing (or null), 1 under the threshold, 2 from it on."""
    v = denan(value.cast("double"))
    return F.when(v >= threshold, 2).when(v > 0, 1).otherwise(0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = n_all / (classes * n)."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # one row a class
    return g.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)  # one row a class


def assembled(features: list[str], scale: bool = False) -> list:
    """Stages that make the vector `features` (scaled to mean 0 and deviation 1 if asked)."""
    stages = [VectorAssembler(inputCols=features, outputCol="_raw" if scale else "features", handleInvalid="error")]
    return [*stages, StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)] if scale else stages


def prepared(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """features as doubles without missing values (0), and keep."""
    return df.select(*keep, *[F.coalesce(denan(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features if f not in keep])


def logistic(label: str, c: float, total_weight: float, l1: bool = False, weight: str | None = "weight", multinomial: bool = False, max_iter: int = 100) -> LogisticRegression:
    """Logistic regression with inverse strength c: regParam = 1 / (c * total weight), so penalties mean the same as elsewhere."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * total_weight), elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=max_iter, family="multinomial" if multinomial else "auto")
    return lr.setWeightCol(weight) if weight else lr


def estimator(kind: str, label: str, weight: str | None = "weight", **params):
    """An estimator by kind: rf, gbt, rf_regressor, elastic_net; params as MLlib names them."""
    made = {"rf": RandomForestClassifier, "gbt": GBTClassifier, "rf_regressor": RandomForestRegressor, "elastic_net": LinearRegression}[kind](featuresCol="features", labelCol=label, **params)
    return made.setWeightCol(weight) if weight else made


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations."""
    return [dict(zip(space, v, strict=True)) for v in product(*space.values())]


def sampled_grid(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n combinations drawn without repetition."""
    g = grid(space)
    return random.Random(seed).sample(g, min(n, len(g)))


def positive_probability(df: DataFrame) -> DataFrame:
    """df with score, the probability of class 1."""
    return df.withColumn("score", vector_to_array("probability")[1])


def cross_validate(df: DataFrame, make, settings: list[dict], features: list[str], label: str, fold: str = "fold", by: str = "average_precision", rolling: bool = False) -> list[dict]:
    """For each setting the mean over folds of roc_auc and average_precision (classifiers) or of rmse and mae (by="rmse"), best first by
    `by`. make(setting) gives an estimator. rolling: a fold trains on lower folds only."""
    df = df.cache()
    ks = sorted(r[0] for r in df.select(fold).distinct().collect())  # a handful of folds
    out = []
    for s in settings:
        scores = []
        for k in ks[1:] if rolling else ks:
            train = df.where(F.col(fold) < k) if rolling else df.where(F.col(fold) != k)
            got = Pipeline(stages=[*assembled(features), make(s)]).fit(train).transform(df.where(F.col(fold) == k))
            scores.append((metrics.regression(got, label, "prediction") if by in ("rmse", "mae") else metrics.ranking(positive_probability(got), label, "score")).first().asDict())
        names = ["rmse", "mae"] if by in ("rmse", "mae") else ["roc_auc", "average_precision"]
        out.append(s | {n: sum(x[n] for x in scores) / len(scores) for n in names if scores})
    df.unpersist()
    return sorted(out, key=lambda x: x[by] if by in ("rmse", "mae") else -x[by])


def search(df: DataFrame, make, settings: list[dict], features: list[str], label: str, fold: str = "fold", by: str = "average_precision", rolling: bool = False) -> tuple[PipelineModel, list[dict]]:
    """(the best setting's model, fitted anew to all rows; all settings with their scores, best first)."""
    ranked = cross_validate(df, make, settings, features, label, fold, by, rolling)
    scored = ("roc_auc", "average_precision", "rmse", "mae")
    best = {k: v for k, v in ranked[0].items() if k not in scored}
    return Pipeline(stages=[*assembled(features), make(best)]).fit(df), ranked


def threshold_models(train: DataFrame, test: DataFrame, value: str, thresholds: list[float], features: list[str], least: int = 20) -> list[dict]:
    """For each candidate threshold of value (label 1 from it on) a balanced logistic model, scored on the rows held out: threshold, positives,
    f1 (of class 1 at probability 1/2), accuracy, roc_auc, average_precision; best first by f1, then roc_auc. Candidates with fewer than `least`
    rows of either class to train on, or one class only in test, are left out."""
    out = []
    for t in thresholds:
        y = F.when(F.col(value) >= t, 1).otherwise(0)
        a, b = train.withColumn("_y", y), test.withColumn("_y", y)
        n = {r["_y"]: r["n"] for r in a.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        if min(n.get(0, 0), n.get(1, 0)) < least:
            continue
        a = with_weights(a, "_y")
        model = Pipeline(stages=[*assembled(features, scale=True), logistic("_y", 1.0, float(sum(n.values())))]).fit(a)
        got = positive_probability(model.transform(b))
        rank = metrics.ranking(got, "_y", "score").first()
        if not rank or not rank["positives"] or not rank["negatives"]:
            continue
        report = {r["class"]: r for r in metrics.class_report(got.withColumn("_p", F.col("prediction").cast("int")), "_y", "_p").collect()}
        right = got.agg(F.avg((F.col("_y") == F.col("prediction").cast("int")).cast("double")).alias("a")).first()["a"]
        out.append({"threshold": float(t), "positives": rank["positives"], "f1": report[1]["f1"] if 1 in report else 0.0, "accuracy": right, "roc_auc": rank["roc_auc"], "average_precision": rank["average_precision"]})
    return sorted(out, key=lambda r: (-r["f1"], -r["roc_auc"], r["threshold"]))


def smote(df: DataFrame, label: str, features: list[str], k: int = 5, seed: int = 42, block: int = 2_000) -> DataFrame:
    """label and features of df's rows (missing as 0) and of as many made ones as bring every class to the largest's size; `made` tells them
    apart. A made row lies between a row of its class and one of its k nearest of the class, at a share drawn by hash.

    Neighbours are looked for among some `block` rows of the class that are next to each other along the feature of the largest spread
    (ranges of a class, not all pairs of it); a class of one row is repeated. Null labels are left out."""
    from tempestry.session import ship

    ship(df.sparkSession)
    x = df.where(F.col(label).isNotNull()).select(label, *[F.coalesce(denan(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features])
    counts = {r[label]: r["n"] for r in x.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    most = max(counts.values(), default=0)
    spread = x.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    widest = max(features, key=lambda f: spread[f] or 0.0)
    kind = dict(x.dtypes)[label]
    schema = f"`{label}` {kind}, " + ", ".join(f"`{f}` double" for f in features)

    def make(times: float):
        def build(batches):
            import numpy as np
            import pandas as pd

            rng = np.random.default_rng(seed)
            for pdf in batches:
                v = pdf[features].to_numpy(float)
                n = len(v)
                if not n:
                    continue
                sd = v.std(0)
                z = v / np.where(sd > 0, sd, 1.0)
                sq = (z * z).sum(1)
                d = sq[:, None] + sq[None, :] - 2 * z @ z.T  # at most block x block
                np.fill_diagonal(d, np.inf)
                near = np.argsort(d, 1, kind="stable")[:, : max(1, min(k, n - 1))]
                reps = np.full(n, int(times)) + (rng.random(n) < times - int(times))
                i = np.repeat(np.arange(n), reps)
                j = near[i, rng.integers(0, near.shape[1], len(i))] if n > 1 else i
                made = v[i] + rng.random((len(i), 1)) * (v[j] - v[i])
                yield pd.DataFrame({label: pdf[label].to_numpy()[i]} | {f: made[:, q] for q, f in enumerate(features)})

        return build

    out = x.withColumn("made", F.lit(False))
    session = df.sparkSession
    for value, n in sorted(counts.items(), key=lambda c: str(c[0])):  # a handful of classes
        if n < most:
            mine = x.where(F.col(label) == value).repartitionByRange(max(1, -(-n // block)), F.col(widest)).sortWithinPartitions(widest)
            size = session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
            session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
            try:
                fresh = mine.mapInPandas(make((most - n) / n), schema).withColumn("made", F.lit(True))
                out = out.unionByName(written(fresh))
            finally:
                session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    return out


def undersample(df: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """Each class thinned to about the smallest one's size."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    return df.sampleBy(label, {k: min(n.values()) / v for k, v in n.items()}, seed) if n else df


def county_medians(df: DataFrame, entity: str, value: str) -> DataFrame:
    """entity, median of the positive values: candidates for a severity threshold."""
    return exact_quantiles(df.where(F.col(value) > 0), [entity], value, [0.5]).select(entity, F.col("q")[0].alias("median"))


def quantile_label(df: DataFrame, value: str, q: float) -> DataFrame:
    """df with severe: 1 at or above the exact quantile of value."""
    one = exact_quantiles(df.select(F.col(value).cast("double").alias("value")), [], "value", [q]).select(F.col("q")[0].alias("_q"))
    return df.join(F.broadcast(one), F.lit(True), "left").withColumn("severe", F.coalesce((F.col(value) >= F.col("_q")).cast("int"), F.lit(0))).drop("_q")  # one row


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, key: list[str], repeats: int = 10, seed: int = 42, bucket_rows: int = 5_000) -> DataFrame:
    """feature, rmse_increase: the mean growth of the error when a feature's values are dealt anew among the rows.

    key names a row. Rows are hashed by it into buckets of about bucket_rows, whatever their number; within a bucket, each repeat deals all
    features at once by one order of the hashes (a shift along it, so that no row keeps its own), and one pass scores all features of a repeat:
    a shuffle a repeat, not two a feature. Values are dealt within buckets, which are random parts of the rows."""
    rows = df.select(*dict.fromkeys([*key, *features, label]))
    n = rows.count()
    buckets = max(1, n // bucket_rows)
    base = metrics.regression(model.transform(rows), label, "prediction").first()["rmse"]
    total = dict.fromkeys(features, 0.0)
    for r in range(repeats):
        w = Window.partitionBy("_b").orderBy("_o", *key)
        x = rows.withColumns({"_b": F.pmod(F.xxhash64(F.lit(seed * 1000 + r), *key), F.lit(buckets)), "_o": F.xxhash64(F.lit(seed * 1000 + r + 500), *key)})
        first = {f: F.first_value(f).over(w.rowsBetween(Window.unboundedPreceding, 0)) for f in features}
        x = x.withColumns({f"_d{i}": F.when(F.lead("_o").over(w).isNull(), first[f]).otherwise(F.lead(f).over(w)) for i, f in enumerate(features)})
        dealt = [F.struct(F.lit(f).alias("_f"), *[F.col(f"_d{i}" if g == f else g).alias(g) for i, g in enumerate(features)]) for f in features]
        x = x.select(F.col(label).alias(label), F.explode(F.array(*dealt)).alias("_x")).select(label, "_x.*")
        for g in metrics.regression(model.transform(x), label, "prediction", ["_f"]).collect():  # one row a feature
            total[g["_f"]] += (g["rmse"] - base) / repeats
    return df.sparkSession.createDataFrame(list(total.items()), "feature string, rmse_increase double")


def coefficients(model, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, coefficient, mean absolute coefficient over classes), strongest first."""
    m = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else [model.coefficients.toArray()]
    rows = [(f, float(m[0][i]), float(sum(abs(r[i]) for r in m) / len(m))) for i, f in enumerate(features)]
    return sorted(rows, key=lambda r: (-r[2], r[0]))


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, highest first."""
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda r: (-r[1], r[0]))


def save(model: PipelineModel, path: str, info: dict) -> None:
    """The model in path/model and its facts in path/info.json, on any file system."""
    model.write().overwrite().save(f"{path}/model")
    put_text(SparkSession.active(), f"{path}/info.json", json.dumps(info, indent=1, sort_keys=True, default=str))


def load(path: str) -> tuple[PipelineModel, dict]:
    """What save wrote."""
    return PipelineModel.load(f"{path}/model"), json.loads(get_text(SparkSession.active(), f"{path}/info.json"))
