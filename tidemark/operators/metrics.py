"""Evaluation of probabilities: one aggregate pass each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import safe_div


def confusion(threshold: Column) -> list[Column]:
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    return [F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn")]


def rates(df: DataFrame) -> DataFrame:
    """Metrics that follow from tp, fp, tn and fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    z = lambda a, b: F.coalesce(safe_div(a, b), F.lit(0.0))
    df = df.withColumns({"recall_up": z(tp, tp + fn), "recall_down": z(tn, tn + fp), "precision_up": z(tp, tp + fp), "precision_down": z(tn, tn + fn), "accuracy": z(tp + tn, tp + tn + fp + fn)})
    f1 = (z(2 * tp, 2 * tp + fp + fn) + z(2 * tn, 2 * tn + fp + fn)) / 2
    return df.withColumns({"balanced_accuracy": (F.col("recall_up") + F.col("recall_down")) / 2, "macro_f1": f1, "mcc": z(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC by average ranks; null if a class is missing.  Scores are counted before they are ranked."""
    per = df.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n0").over(w), F.lit(0))
    won = per.withColumn("won", F.col("n1") * (below + F.col("n0") / 2.0))
    return won.groupBy(*keys).agg(safe_div(F.sum("won"), (F.sum("n1") * F.sum("n0")).cast("double")).alias("roc_auc"))


def bins(df: DataFrame, keys: list[str], n: int = 10, right_closed: bool = False) -> DataFrame:
    """Calibration by equal-width bins whose edges are literals i / n; left-closed, the last holds 1."""
    edges = [i / n for i in range(1, n)]
    test = (lambda e: F.col("p") > e) if right_closed else (lambda e: F.col("p") >= e)
    at = sum((test(e).cast("int") for e in edges[1:]), test(edges[0]).cast("int"))
    return df.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def ece(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted error over left-closed bins and the plain mean over right-closed ones: two definitions."""
    gap = F.abs(F.col("mean_y") - F.col("mean_p"))
    one = bins(df, keys).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece_weighted"))
    two = bins(df, keys, right_closed=True).groupBy(*keys).agg(F.avg(gap).alias("ece_unweighted"))
    return one.join(two, keys)


def classification(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """All metrics of each group from columns p and y."""
    eps = 1e-15
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    logs = F.when(F.col("y") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    one = rates(df.groupBy(*keys).agg(F.count("*").alias("n"), *confusion(F.lit(threshold)), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(logs).alias("log_loss")))
    return one.join(auc(df, keys), keys).join(ece(df, keys), keys)


def threshold_grid(df: DataFrame, keys: list[str], low: float = 0.35, high: float = 0.65, n: int = 61) -> DataFrame:
    """Metrics of every threshold.  Scores are binned first, so the grid never meets single rows."""
    grid = [low + (high - low) * i / (n - 1) for i in range(n)]
    at = sum(((F.col("p") >= t).cast("int") for t in grid[1:]), (F.col("p") >= grid[0]).cast("int"))
    per = df.groupBy(*keys, at.alias("level")).agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]))
    wide = per.select(*keys, "level", "n1", "n0", steps.alias("s"))
    part = lambda c, up: F.sum(F.when((F.col("level") >= F.col("s.k")) if up else (F.col("level") < F.col("s.k")), F.col(c)).otherwise(0))
    return rates(wide.groupBy(*keys, F.col("s.threshold").alias("threshold")).agg(part("n1", True).alias("tp"), part("n0", True).alias("fp"), part("n0", False).alias("tn"), part("n1", False).alias("fn")))


def best_threshold(df: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best balanced accuracy, then macro F1, then nearest to one half, which is tried first."""
    half = rates(df.groupBy(*keys).agg(*confusion(F.lit(0.5)))).withColumn("threshold", F.lit(0.5)).withColumn("first", F.lit(1))
    grid = threshold_grid(df, keys).withColumn("first", F.lit(0)).unionByName(half)
    rank = F.struct("balanced_accuracy", "macro_f1", (-F.abs(F.col("threshold") - 0.5)).alias("near"), "first", (-F.col("threshold")).alias("low"))
    return grid.groupBy(*keys).agg(F.max_by("threshold", rank).alias("threshold"), F.max("balanced_accuracy").alias("balanced_accuracy"))


def accepted(metrics: DataFrame, balanced: float = 0.6, f1: float = 0.55, recall: float = 0.5, samples: int = 80) -> DataFrame:
    ok = (F.col("balanced_accuracy") >= balanced) & (F.col("macro_f1") >= f1) & (F.col("recall_up") >= recall) & (F.col("recall_down") >= recall) & (F.col("n") >= samples)
    return metrics.withColumn("accepted", ok)


def per_year(selected: Column, first: Column, last: Column) -> Column:
    """Selected rows a year of 252 by the span of all decisions."""
    return 252.0 * selected / F.greatest(F.lit(1), last - first + 1)


def signed_infinity(mean, deviation) -> Column:
    """Mean over deviation; without deviation an infinity of the mean's sign, or 0."""
    return F.when(deviation > 0, mean / F.nullif(deviation, F.lit(0.0))).when(deviation == 0, F.when(mean > 0, float("inf")).when(mean < 0, float("-inf")).otherwise(0.0))


def calibration_line(df: DataFrame, keys: list[str], rounds: int = 25) -> DataFrame:
    """(keys, intercept, slope) of a logistic curve of y on the logit of p, by Newton steps of one aggregate each.

    Groups are few; each round collects five sums a group, adds the steps and goes on until they vanish.
    """
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.select(*keys, F.ln(p / (1 - p)).alias("x"), F.col("y").cast("double").alias("y"))
    spark, state = df.sparkSession, {tuple(r): (0.0, 0.0) for r in rows.select(*keys).distinct().collect()}
    kinds = [df.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())])
    table = lambda: spark.createDataFrame([(*k, *v) for k, v in state.items()], schema)
    for _ in range(rounds):
        if not state:
            break
        q = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("x"))))
        w, e, x = q * (1 - q), F.col("y") - q, F.col("x")
        most = 0.0
        for r in rows.join(F.broadcast(table()), keys).groupBy(*keys).agg(F.sum(e), F.sum(e * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).collect():
            key, (g0, g1, h00, h01, h11) = tuple(r[: len(keys)]), r[len(keys) :]
            det = h00 * h11 - h01 * h01
            if det <= 1e-12:
                continue
            step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
            state[key] = (state[key][0] + step[0], state[key][1] + step[1])
            most = max(most, abs(step[0]), abs(step[1]))
        if most < 1e-12:
            break
    return table()


def strategy(df: DataFrame, keys: list[str], order: str = "row_id", per_year: float = 252.0) -> DataFrame:
    """Equity figures of a column ``net`` of log returns with a flag ``active``; the curve starts at 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = df.withColumn("equity", F.exp(F.sum("net").over(w)))
    curve = curve.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)
    on = F.when(F.col("active"), F.col("net"))
    std = F.stddev_samp("net")
    return curve.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("active").alias("trades"), F.sum("net").alias("log_return"), (F.exp(F.sum("net")) - 1).alias("cumulative"), F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"), F.avg((on > 0).cast("double")).alias("hit_rate"), F.avg(on).alias("mean_active"), safe_div(math.sqrt(per_year) * F.avg("net"), std).alias("sharpe"))
