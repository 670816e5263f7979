"""Candidate classifiers by Spark ML: imputation, scaling, folds, stacking and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import ContractError
from . import metrics, schedule

#: Trees and depths of the candidates, and of their fast variants (fixed values).
TREES, FAST_TREES, ROUNDS, FAST_ROUNDS = 320, 80, 220, 90
#: Columns that tell the regime to the stacked classifier (fixed values).
REGIME_COLUMNS = ["hurst_regime", "volatility_zscore", "trend_efficiency_20", "trend_regime", "rsi_14", "macd_histogram", "vol_ratio_20_63"]


def imputed(train: DataFrame, df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Medians of the training rows for missing values, and an indicator where training rows missed a value."""
    stats = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in features], *[F.count_if(F.col(c).isNull()).alias(f"{c}__n") for c in features]).collect()[0]
    lost = [c for c in features if stats[f"{c}__n"]]
    out = df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in lost])
    return out.withColumns({c: F.coalesce(c, F.lit(stats[c] if stats[c] is not None else 0.0)) for c in features}), [*features, *[f"{c}__missing" for c in lost]]


def scaled(train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """Population z-scores by the training rows; constant features are only centred."""
    stats = train.agg(*[F.avg(c).alias(c) for c in features], *[F.stddev_pop(c).alias(f"{c}__s") for c in features]).collect()[0]
    return df.withColumns({c: (F.col(c) - stats[c]) / (stats[f"{c}__s"] or 1.0) for c in features})


def estimator(kind: str, n: float, seed: int = 42, fast: bool = False, c: float = 0.2):
    """An untrained candidate; ``c`` is the inverse strength of the logistic penalty over ``n`` rows of balanced weight."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    trees, names = FAST_TREES if fast else TREES, {"weightCol": "w", "featuresCol": "x", "labelCol": "y"}
    if kind == "logistic":
        return LogisticRegression(regParam=1 / (c * n), standardization=False, maxIter=2000, tol=1e-10, **names)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=9, minInstancesPerNode=8, featureSubsetStrategy="sqrt", seed=seed, **names)
    if kind == "extra_trees":  # Spark has no random split points; trees without bootstrap stand in
        return RandomForestClassifier(numTrees=trees, maxDepth=11, minInstancesPerNode=6, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed, **names)
    if kind == "boosted":  # Spark grows by depth: 4 levels for 15 leaves
        return GBTClassifier(maxIter=FAST_ROUNDS if fast else ROUNDS, maxDepth=4, minInstancesPerNode=18, stepSize=0.055, seed=seed, **names)
    raise ValueError(kind)


class Fitted:
    """A trained candidate with the statistics of its training rows; it can be saved and loaded as a bundle."""

    def __init__(self, features: list[str], medians: dict, lost: list[str], scales: dict, model):
        self.features, self.medians, self.lost, self.scales, self.model = features, medians, lost, scales, model

    def prepared(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        marks = df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in self.lost])
        filled = marks.withColumns({c: F.coalesce(c, F.lit(self.medians[c])) for c in self.features})
        names = [*self.features, *[f"{c}__missing" for c in self.lost]]
        scaled_ = filled.withColumns({f"{c}__z": (F.col(c) - self.scales[c][0]) / self.scales[c][1] for c in names})
        out = VectorAssembler(inputCols=[f"{c}__z" for c in names], outputCol="x").transform(scaled_)
        return out.drop(*[f"{c}__z" for c in names], *[f"{c}__missing" for c in self.lost])

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a column p of the probability that y is 1."""
        from pyspark.ml.functions import vector_to_array

        kept = df.drop("p")
        return self.model.transform(self.prepared(kept)).select(*kept.columns, vector_to_array("probability")[1].alias("p"))

    def save(self, folder: str) -> None:
        import json

        self.model.write().save(f"{folder}/model")
        facts = json.dumps({"features": self.features, "medians": self.medians, "lost": self.lost, "scales": self.scales, "kind": type(self.model).__module__ + "." + type(self.model).__name__}, sort_keys=True)
        from pyspark.sql import SparkSession

        SparkSession.active().createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{folder}/facts")

    @classmethod
    def load(cls, folder: str) -> Fitted:
        import importlib
        import json

        from pyspark.sql import SparkSession

        facts = json.loads(SparkSession.active().read.text(f"{folder}/facts").collect()[0].value)
        module, _, name = facts["kind"].rpartition(".")
        model = getattr(importlib.import_module(module), name).load(f"{folder}/model")
        return cls(facts["features"], facts["medians"], facts["lost"], facts["scales"], model)


def fit(train: DataFrame, features: list[str], kind: str = "logistic", seed: int = 42, fast: bool = False, c: float = 0.2) -> Fitted:
    """A candidate trained on rows with features and y: medians for missing values with an indicator, population z-scores, classes weighted to balance.

    Features are read for three aggregates and the fit.
    """
    train = train.withColumn("y", F.col("y").cast("double"))
    stats = train.agg(*[F.percentile(x, F.lit(0.5)).alias(x) for x in features], *[F.count_if(F.col(x).isNull()).alias(f"{x}__n") for x in features], F.count("*").alias("__rows"), F.sum("y").alias("__ones")).collect()[0]
    n, ones = stats["__rows"], stats["__ones"] or 0.0
    if not 0 < ones < n:
        raise ContractError("training rows hold one class")
    medians = {x: stats[x] if stats[x] is not None else 0.0 for x in features}
    lost = [x for x in features if stats[f"{x}__n"]]
    filled = train.withColumns({f"{x}__missing": F.col(x).isNull().cast("double") for x in lost}).withColumns({x: F.coalesce(x, F.lit(medians[x])) for x in features})
    names = [*features, *[f"{x}__missing" for x in lost]]
    spread = filled.agg(*[F.avg(x).alias(x) for x in names], *[F.stddev_pop(x).alias(f"{x}__s") for x in names]).collect()[0]
    made = Fitted(features, medians, lost, {x: [spread[x], spread[f"{x}__s"] or 1.0] for x in names}, None)
    weight = F.when(F.col("y") == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    made.model = estimator(kind, float(n), seed, fast, c).fit(made.prepared(train).withColumn("w", weight).select("x", "y", "w"))
    return made


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], kind: str = "logistic", seed: int = 42, fast: bool = False, c: float = 0.2) -> DataFrame:
    """``test`` with a column p of the probability that y is 1."""
    return fit(train, features, kind, seed, fast, c).predict(test)


def part(rows: DataFrame, folds: DataFrame, role: str) -> DataFrame:
    return rows.join(folds.where(F.col("role") == role).select("symbol", "row_id"), ["symbol", "row_id"], "left_semi")


def out_of_fold(rows: DataFrame, folds: DataFrame, features: list[str], kind: str = "logistic", fast: bool = False, c: float = 0.2) -> DataFrame:
    """One probability for each validation row of each fold; folds are few, and each is a fit."""
    out = None
    for fold in [r[0] for r in folds.select("fold_id").distinct().orderBy("fold_id").collect()]:
        own = folds.where(F.col("fold_id") == fold)
        got = fit_predict(part(rows, own, "train"), part(rows, own, "validation"), features, kind, fast=fast, c=c).withColumn("fold_id", F.lit(fold))
        out = got if out is None else out.unionByName(got)
    return out


def past_only_sigmoid(calibration: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with p recalibrated by a logistic curve of earlier rows' p."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    last, classes, n, low, high = calibration.agg(F.max("row_id"), F.count_distinct("y"), F.count("*"), F.min("p"), F.max("p")).collect()[0]
    first = target.agg(F.min("row_id")).collect()[0][0]
    if last is None or classes < 2 or first is None or last >= first or low < 0 or high > 1:
        raise ContractError("calibration rows must hold both classes and probabilities, and precede the target")
    a = VectorAssembler(inputCols=["p"], outputCol="x")
    m = LogisticRegression(regParam=1 / (1e6 * n), standardization=False, tol=1e-10, maxIter=2000, featuresCol="x", labelCol="y").fit(a.transform(calibration.select("p", F.col("y").cast("double").alias("y"))))
    return target.withColumn("p", 1 / (1 + F.exp(-(F.lit(float(m.coefficients[0])) * F.col("p") + float(m.intercept)))))


def stability(metrics: DataFrame) -> DataFrame:
    """Of each candidate over all folds but the last: medians and the population deviation of balanced accuracy."""
    last = metrics.agg(F.max("fold_id").alias("__last"))
    kept = metrics.join(F.broadcast(last)).where("fold_id < __last")
    m = lambda c: F.percentile(c, F.lit(0.5))
    out = kept.groupBy("candidate").agg(m("balanced_accuracy").alias("median_ba"), m("macro_f1").alias("median_f1"), m("roc_auc").alias("median_auc"), F.stddev_pop("balanced_accuracy").alias("std_ba"))
    return out.orderBy(F.desc("median_ba"), F.desc("median_f1"), "std_ba", "candidate")


def selected(oof: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidate, threshold, balanced_accuracy, stability figures): of each group the candidate that is steadiest over all folds
    but the last (median balanced accuracy, median macro F1, small deviation), with the threshold tuned on the last.

    ``oof`` has candidate, fold_id, y and p.
    """
    per = metrics.rates(oof.groupBy(*keys, "candidate", "fold_id").agg(*metrics.confusion(F.lit(0.5))))
    newest = oof.groupBy(*keys).agg(F.max("fold_id").alias("last"))  # a row for each group
    m = lambda c: F.percentile(c, F.lit(0.5))
    steady = per.join(F.broadcast(newest), keys).where("fold_id < last").groupBy(*keys, "candidate").agg(m("balanced_accuracy").alias("median_ba"), m("macro_f1").alias("median_f1"), F.stddev_pop("balanced_accuracy").alias("std_ba"))
    w = Window.partitionBy(*keys).orderBy(F.desc("median_ba"), F.desc("median_f1"), "std_ba", "candidate")
    best = steady.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    last = oof.join(F.broadcast(newest), keys).where("fold_id = last").join(best.select(*keys, "candidate"), [*keys, "candidate"], "left_semi")
    return best.join(metrics.best_threshold(last, keys), keys)


def stacked(oof: dict[str, DataFrame], rows: DataFrame, last: int, start: int, tolerance: float = 0.005) -> dict:
    """The stacked classifier over the candidates' out-of-fold probabilities and the regime, and whether it is to be used.

    It is trained on rows of earlier folds whose labels end before the last fold's first row, ``start``, and judged on the last
    fold: it must come within ``tolerance`` of the best candidate's balanced accuracy and within 0.01 of its macro F1.
    ``oof`` has frames of symbol, row_id, fold_id, y, p; ``rows`` has the regime columns and label_end_index.
    """
    names = sorted(oof)
    wide = rows
    for name in names:
        wide = wide.join(oof[name].select("symbol", "row_id", F.col("p").alias(f"p_up__{name}"), F.abs(F.col("p") - 0.5).alias(f"confidence__{name}")), ["symbol", "row_id"])
    wide = wide.join(oof[names[0]].select("symbol", "row_id", "fold_id", F.col("y").cast("double").alias("y")), ["symbol", "row_id"])
    columns = [f"{k}__{n}" for n in names for k in ("p_up", "confidence")] + [c for c in REGIME_COLUMNS if c in rows.columns]
    train = wide.where((F.col("fold_id") != last) & (F.col("label_end_index") < start))
    chosen = wide.where(F.col("fold_id") == last)
    meta = fit(train, columns, "logistic", c=0.5)
    scored = meta.predict(chosen).withColumn("g", F.lit(0))
    def judged(df: DataFrame) -> tuple[float, float, float]:
        t = metrics.best_threshold(df, ["g"]).collect()[0].threshold
        m = metrics.rates(df.groupBy("g").agg(*metrics.confusion(F.lit(t)))).collect()[0]
        return t, m.balanced_accuracy, m.macro_f1

    threshold, ba, f1 = judged(scored)
    others = {n: judged(chosen.withColumn("p", F.col(f"p_up__{n}")).withColumn("g", F.lit(0))) for n in names}
    best = max(names, key=lambda n: others[n][1:])
    return {"model": meta, "threshold": threshold, "balanced_accuracy": ba, "macro_f1": f1, "best_candidate": best, "used": ba + tolerance >= others[best][1] and f1 + 0.01 >= others[best][2]}


OPTIONS, MARGINS, SHARE = ("none", "sigmoid"), (0.0, 0.05), 2 / 3


def inner_choice(pooled: DataFrame, keys: list[str], cost_bps: float = 5.0, purge: bool = True) -> tuple[str, float, list[dict]]:
    """(calibration, margin, records) that do best on the last third of pooled inner out-of-fold rows of one series.

    The earlier part calibrates; with ``purge`` without rows whose label reaches the later one.  By balanced accuracy, macro F1,
    net return, then the smaller margin and no calibration.  ``pooled`` has what a ledger needs and label_end_index.
    """
    at = pooled.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id")) - 1).cache()
    cut = max(20, int(at.count() * SHARE))
    late = at.where(F.col("pos") >= cut)
    first = late.agg(F.min("row_id")).collect()[0][0]
    if first is None:
        raise ContractError("too few inner rows")
    early = at.where((F.col("pos") < cut) & (F.col("label_end_index") < first if purge else F.lit(True)))
    records = []
    for option in OPTIONS:
        scored = late if option == "none" else past_only_sigmoid(early, late)
        m = metrics.rates(scored.groupBy(*keys).agg(*metrics.confusion(F.lit(0.5)))).collect()[0]
        for margin in MARGINS:
            net, trades = schedule.ledger(scored, keys, margin, cost_bps).agg(F.sum("candidate"), F.count_if("active")).collect()[0]
            records.append({"calibration": option, "margin": margin, "balanced_accuracy": m.balanced_accuracy, "macro_f1": m.macro_f1, "net": net or 0.0, "trades": trades})
    won = max(records, key=lambda r: (r["balanced_accuracy"], r["macro_f1"], r["net"], -r["margin"], r["calibration"] == "none"))
    return won["calibration"], won["margin"], records


def trial(rows: DataFrame, events: DataFrame, features: list[str], keys: list[str], outer: int = 5, inner: int = 3, least_outer: int = 800, least_inner: int = 300, c: float = 1.0) -> tuple[DataFrame, list[dict]]:
    """One probability for each outer validation row of one series, and the inner choices behind them.

    Each outer fold trains on its past; its calibration and margin are chosen on inner folds of that past alone.  The baseline
    probability is the share of ups among the training rows.  ``rows`` has features, y and what a ledger needs.
    """
    from . import splits

    top = splits.walk_forward(events, outer, least_outer).cache()
    low = splits.nested(events, outer, inner, least_outer, least_inner).cache()
    out, choices = None, []
    for fold in [r[0] for r in top.select("fold_id").distinct().orderBy("fold_id").collect()]:
        own = top.where(F.col("fold_id") == fold)
        pooled = out_of_fold(rows, low.where(F.col("outer_fold") == fold), features, c=c).cache()
        calibration, margin, records = inner_choice(pooled, keys)
        train = part(rows, own, "train")
        scored = fit_predict(train, part(rows, own, "validation"), features, c=c)
        if calibration == "sigmoid":
            scored = past_only_sigmoid(pooled, scored)
        share = train.agg(F.avg("y")).collect()[0][0]
        scored = scored.withColumns({"outer_fold": F.lit(fold), "baseline_p": F.lit(share), "calibration": F.lit(calibration), "margin": F.lit(margin)})
        out = scored if out is None else out.unionByName(scored)
        choices.append({"outer_fold": fold, "calibration": calibration, "margin": margin, "records": records})
    if out is None:
        raise ContractError("no outer fold")
    return out, choices
