"""Overfitting probability, Sharpe diagnostics and block bootstraps."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import safe_div
from .splits import bits


#: Fewest common rows of aligned trials.
LEAST_COMMON = 20


def align(trials: DataFrame) -> DataFrame:
    """(trial_id, row_id, ret) on the rows that every trial has a finite return for; none if they are fewer than ``LEAST_COMMON``."""
    trials = trials.where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < float("inf")))
    n = trials.agg(F.count_distinct("trial_id").alias("k"))
    common = trials.groupBy("row_id").agg(F.count_distinct("trial_id").alias("c")).join(F.broadcast(n), F.col("c") == F.col("k")).select("row_id")
    enough = common.agg(F.count("*").alias("c")).where(F.col("c") >= LEAST_COMMON)
    return trials.join(common, "row_id", "left_semi").join(F.broadcast(enough), how="left_semi")  # one row or none


def sharpe(total, squares, n):
    """Mean over sample deviation from sums."""
    mean = total / n
    return safe_div(mean, F.sqrt(F.greatest(F.lit(0.0), (squares - n * mean * mean) / (n - 1))))


def pbo(trials: DataFrame, parts: int = 8) -> DataFrame:
    """(mask, trial_id, logit): of each choice of half the parts, the best trial in sample and its logit rank out of it.

    The rows are read once: parts * trials sums serve all combinations.
    """
    spark = trials.sparkSession
    cut = trials.withColumn("part", F.ntile(parts).over(Window.partitionBy("trial_id").orderBy("row_id")) - 1)
    sums = cut.groupBy("trial_id", "part").agg(F.count("*").cast("double").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    masks = spark.createDataFrame([(m,) for m in bits(parts, parts // 2)], "mask int")
    wide = sums.join(F.broadcast(masks))
    inside = F.getbit("mask", F.col("part").cast("int")) == 1
    half = lambda c, yes: F.sum(F.when(inside == F.lit(yes), F.col(c)).otherwise(0.0))
    both = wide.groupBy("mask", "trial_id").agg(sharpe(half("s", True), half("q", True), half("n", True)).alias("inner"), sharpe(half("s", False), half("q", False), half("n", False)).alias("outer"))
    w = Window.partitionBy("mask")
    ranked = both.withColumn("k", F.count("*").over(w)).withColumn("rank_in", F.row_number().over(w.orderBy(F.desc("inner"), "trial_id")))
    best = F.max(F.when(F.col("rank_in") == 1, F.col("outer"))).over(w)
    counted = ranked.withColumn("lower", F.sum((F.col("outer") < best).cast("double")).over(w)).withColumn("equal", F.sum((F.col("outer") == best).cast("double")).over(w)).where("rank_in = 1")
    share = F.least(F.greatest((F.col("lower") + 0.5 * F.col("equal")) / F.col("k"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return counted.select("mask", "trial_id", F.ln(share / (1 - share)).alias("logit"))


def pbo_summary(trials: DataFrame, parts: int = 8) -> DataFrame:
    return pbo(trials, parts).agg(F.count("*").alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.percentile("logit", F.lit(0.5)).alias("median_logit"))


def moments(trials: DataFrame) -> DataFrame:
    """Sharpe ratio, skewness and plain kurtosis of each trial."""
    return trials.groupBy("trial_id").agg(F.count("*").alias("n"), safe_div(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"))


def probabilistic_z(reference: float = 0.0):
    """z value of the probabilistic Sharpe ratio from the moments' columns."""
    s, g3, g4 = F.col("sharpe"), F.col("skew"), F.col("kurtosis")
    return safe_div((s - reference) * F.sqrt(F.col("n") - 1.0), F.sqrt(1 - g3 * s + (g4 - 1) / 4 * s * s))


def probabilistic_sharpe(sharpe_ratio: float, n: int, skew: float, kurtosis: float, reference: float = 0.0) -> float:
    spread = 1 - skew * sharpe_ratio + (kurtosis - 1) / 4 * sharpe_ratio**2
    if spread <= 0:
        raise ValueError("the variance term is not positive")
    return NormalDist().cdf((sharpe_ratio - reference) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_maximum(mean: float, deviation: float, trials: int) -> float:
    """Expected largest Sharpe ratio of ``trials`` independent ones."""
    if trials == 1:
        return mean
    gamma, inv = 0.5772156649015329, NormalDist().inv_cdf
    return mean + deviation * ((1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe_ratio: float, n: int, skew: float, kurtosis: float, trials: int, deviation: float | None = None) -> float:
    return probabilistic_sharpe(sharpe_ratio, n, skew, kurtosis, expected_maximum(0.0, deviation if deviation is not None else math.sqrt(1 / (n - 1)), trials))


def block_bootstrap(df: DataFrame, value: str, rounds: int = 200, block: int = 10, seed: int = 42) -> DataFrame:
    """(iter, mean): means of moving-block resamples of ``value`` in row order, drawn by an integer generator.

    Prefix sums make a block one difference, so a draw joins two rows, not its block's rows.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("row_id")  # one series: its prefix sums are one sorted run
    at = df.select((F.row_number().over(w) - 1).alias("pos"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    n = df.count()
    if n < max(20, 2 * block):
        return df.sparkSession.createDataFrame([], "iter int, mean double")
    blocks = -(-n // block)
    draws = df.sparkSession.range(rounds).select(F.col("id").alias("iter"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    start = ((F.col("iter") * 7919 + F.col("blk") * 104729 + seed) * 48271) % 2147483647 % (n - block + 1)
    size = F.least(F.lit(block), F.lit(n) - F.col("blk") * block)
    drawn = draws.select("iter", start.alias("a"), (start + size - 1).alias("b"))
    left = at.select((F.col("pos") + 1).alias("a"), F.col("upto").alias("before"))
    right = at.select(F.col("pos").alias("b"), F.col("upto").alias("after"))
    sums = drawn.join(left, "a", "left").join(right, "b")
    return sums.groupBy("iter").agg((F.sum(F.col("after") - F.coalesce("before", F.lit(0.0))) / n).alias("mean"))


def interval(resamples: DataFrame, level: float = 0.95) -> DataFrame:
    t = (1 - level) / 2
    return resamples.agg(F.count("*").alias("n"), F.percentile("mean", F.lit(t)).alias("low"), F.percentile("mean", F.lit(1 - t)).alias("high"))


STATISTICS = ["balanced_accuracy", "macro_f1", "recall_down", "recall_up", "brier_score", "expected_calibration_error", "candidate_mean_net_return", "paired_mean_net_return"]
BINS = 10


def joint_bootstrap(df: DataFrame, keys: list[str], blocks: tuple[int, ...], rounds: int = 400, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """(keys, block, iter, the eight ``STATISTICS``): moving-block resamples that draw labels, scores and returns together.

    ``df`` has row_id, y, p, candidate and benchmark.  Every block length has draws of its own; resamples of one class are
    replaced by later ones of a tenth more.  Prefix sums make a drawn block one difference of two rows.  Groups of
    fewer than 20 rows, of one class, or shorter than two blocks have none.
    """
    w = Window.partitionBy(*keys).orderBy("row_id")
    hit, up = F.col("p") >= threshold, F.col("y") == 1
    at = sum((F.col("p") >= i / BINS).cast("int") for i in range(2, BINS)) + (F.col("p") >= 1 / BINS).cast("int")
    parts = {"tp": hit & up, "fp": hit & ~up, "tn": ~hit & ~up, "fn": ~hit & up} | {f"d{i}": F.when(at == i, F.col("y") - F.col("p")).otherwise(0.0) for i in range(BINS)}
    parts |= {"brier": (F.col("p") - F.col("y")) ** 2, "candidate": F.col("candidate"), "paired": F.col("candidate") - F.col("benchmark")}
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("pos"), *[F.sum(v.cast("double")).over(upto).alias(k) for k, v in parts.items()])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).where("n >= 20 and classes = 2")
    lengths = F.explode(F.array(*map(F.lit, blocks)))
    draws = sizes.select(*keys, "n", lengths.alias("block")).where("n >= 2 * block").withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(rounds + rounds // 10 - 1))))
    draws = draws.withColumn("blk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("block")).cast("int") - 1)))
    start = ((F.col("iter").cast("long") * 7919 + F.col("blk") * 104729 + F.col("block") * 1299709 + seed) * 48271) % 2147483647 % (F.col("n") - F.col("block") + 1)
    size = F.least(F.col("block"), F.col("n") - F.col("blk") * F.col("block"))
    drawn = draws.select(*keys, "block", "iter", "n", start.cast("long").alias("a"), (start + size - 1).cast("long").alias("b"))
    left = sums.select(*keys, (F.col("pos") + 1).alias("a"), *[F.col(k).alias(f"{k}_before") for k in parts])
    right = sums.withColumnRenamed("pos", "b")
    met = drawn.join(right, [*keys, "b"]).join(left, [*keys, "a"], "left")
    total = met.groupBy(*keys, "block", "iter", "n").agg(*[F.sum(F.col(k) - F.coalesce(F.col(f"{k}_before"), F.lit(0.0))).alias(k) for k in parts])
    total = total.where("tp + fn > 0.5 and tn + fp > 0.5")
    total = total.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "block").orderBy("iter"))).where(F.col("rank") <= rounds)
    rates_ = {"recall_up": F.col("tp") / (F.col("tp") + F.col("fn")), "recall_down": F.col("tn") / (F.col("tn") + F.col("fp"))}
    f1 = lambda hits: F.coalesce(safe_div(2 * hits, 2 * hits + F.col("fp") + F.col("fn")), F.lit(0.0))
    gap = sum((F.abs(f"d{i}") for i in range(1, BINS)), F.abs("d0"))
    stats = rates_ | {"balanced_accuracy": (rates_["recall_up"] + rates_["recall_down"]) / 2, "macro_f1": (f1(F.col("tp")) + f1(F.col("tn"))) / 2, "brier_score": F.col("brier") / F.col("n"), "expected_calibration_error": gap / F.col("n"), "candidate_mean_net_return": F.col("candidate") / F.col("n"), "paired_mean_net_return": F.col("paired") / F.col("n")}
    return total.select(*keys, "block", "iter", *[stats[s].alias(s) for s in STATISTICS])


def joint_intervals(resamples: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """(keys, block, statistic, n, low, high) by linear quantiles of the resamples."""
    t = (1 - level) / 2
    long = resamples.select(*keys, "block", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in STATISTICS])).alias("x"))
    return long.groupBy(*keys, "block", "x.statistic").agg(F.count("*").alias("n"), F.percentile("x.v", F.lit(t)).alias("low"), F.percentile("x.v", F.lit(1 - t)).alias("high"))


def trial_sharpes(trials: DataFrame, periods: float = 252.0) -> DataFrame:
    """(trial_id, annualised, signed): the annualised Sharpe ratio, 0 without deviation, and the plain one, an infinity of the mean's sign then."""
    from .metrics import signed_infinity

    out = trials.groupBy("trial_id").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))
    return out.select("trial_id", F.when(F.col("std") > 0, F.col("mean") / F.nullif("std", F.lit(0.0)) * math.sqrt(periods)).otherwise(0.0).alias("annualised"), signed_infinity(F.col("mean"), F.col("std")).alias("signed"))


def deflated(trials: DataFrame) -> list[tuple[int, float | None]]:
    """(trial_id, probability) of the deflated Sharpe ratio of each trial among all, which are few; null where it can't be told."""
    rows = moments(trials).orderBy("trial_id").collect()
    known = [r.sharpe for r in rows if r.sharpe is not None]
    spread = (sum((x - sum(known) / len(known)) ** 2 for x in known) / (len(known) - 1)) ** 0.5 if len(known) > 1 else None
    out = []
    for r in rows:
        try:
            out.append((r.trial_id, deflated_sharpe(r.sharpe, r.n, r.skew, r.kurtosis, len(rows), spread)))
        except (ValueError, TypeError):
            out.append((r.trial_id, None))
    return out
