"""Data-quality aggregates of a bar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import over, percentile, safe_div, shift
from .features import base

#: Audit thresholds (fixed values).
GAP_DAYS, ROBUST_Z, FLASH, VOLUME_SPAN, VOLUME_RATIO, SCALE_RATIO = 4, 6.0, 0.05, 63, 3.0, 5.0
#: Rows of the trailing price mean that tells bull from bear.
REGIME_SPAN = 252


def regime(span: int = REGIME_SPAN) -> Column:
    """bull or bear by the mean close of the ``span`` rows before; unclassified until there are so many."""
    mean = over(F.avg, "close", span, lag=1)
    return F.when(mean.isNull(), "unclassified").when(F.col("close") >= mean, "bull").otherwise("bear")


def yearly(bars: DataFrame, span: int = REGIME_SPAN) -> DataFrame:
    q = lambda c, x: F.percentile(c, F.lit(x))
    rows = lambda kind: F.count_if(F.col("regime") == kind).alias(f"{kind}_rows")
    return base(bars).withColumn("regime", regime(span)).groupBy("symbol", F.year("date").alias("year")).agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min("close").alias("close_min"), q("close", 0.05).alias("close_p05"), q("close", 0.5).alias("close_median"), F.avg("close").alias("close_mean"), q("close", 0.95).alias("close_p95"), F.max("close").alias("close_max"), F.stddev_pop("close").alias("close_std"),
        F.avg("r").alias("return_mean"), F.stddev_pop("r").alias("return_std"), q("r", 0.01).alias("return_p01"), q("r", 0.05).alias("return_p05"), q("r", 0.5).alias("return_median"), q("r", 0.95).alias("return_p95"), q("r", 0.99).alias("return_p99"),
        F.avg("volume").alias("volume_mean"), q("volume", 0.5).alias("volume_median"), F.count_if(F.col("volume") == 0).alias("zero_volume_rows"),
        rows("bull"), rows("bear"), rows("unclassified"),
    )


def class_balance(labels: DataFrame) -> DataFrame:
    """Label counts and rates of each horizon."""
    r = F.col("executable_forward_log_return")
    out = labels.where(r.isNotNull()).groupBy("symbol", "horizon").agg(F.count("*").alias("n_labeled"), F.count_if(r > 0).alias("n_up"), F.count_if(r <= 0).alias("n_down"))
    return out.withColumn("up_rate", F.col("n_up") / F.col("n_labeled")).withColumn("down_rate", F.col("n_down") / F.col("n_labeled"))


def missing_weekdays(bars: DataFrame) -> DataFrame:
    """Business days between a symbol's first and last bar that have no bar."""
    have = bars.select("symbol", F.to_date("date").alias("day")).distinct()
    span = have.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return days.join(have, ["symbol", "day"], "left_anti")


def inspected(bars: DataFrame, volume_span: int = VOLUME_SPAN) -> DataFrame:
    """``bars`` with the quantities the audit looks at; medians of whole symbols are aggregated and come back as one row each."""
    df = base(bars)
    half = lambda c: F.percentile(c, F.lit(0.5))
    middle = df.groupBy("symbol").agg(half("r").alias("median_r"))
    away = df.join(F.broadcast(middle), "symbol").groupBy("symbol").agg(F.any_value("median_r").alias("median_r"), half(F.abs(F.col("r") - F.col("median_r"))).alias("mad_r"))
    df = df.join(F.broadcast(away), "symbol")  # a row for each symbol
    z = F.when(F.col("mad_r") > 0, 0.6745 * (F.col("r") - F.col("median_r")) / F.nullif("mad_r", F.lit(0.0))).otherwise(F.lit(0.0))
    df = df.withColumn("robust_z", z).withColumn("gap_days", F.datediff(F.to_date("date"), F.to_date(shift("date"))))
    df = df.withColumn("volume_median", over(percentile(0.5), "volume", volume_span))
    return df.withColumns({"volume_ratio": safe_div("volume", "volume_median"), "scale_ratio": safe_div("volume_median", shift("volume_median", volume_span))})


def suspicious(bars: DataFrame, volume_span: int = VOLUME_SPAN) -> DataFrame:
    """(symbol, row_id, date, issue_type, value, threshold) of every suspicious row and every weekday without one."""
    df = inspected(bars, volume_span)
    z, r, v, s = F.col("robust_z"), F.col("r"), F.col("volume_ratio"), F.col("scale_ratio")
    weekday = F.weekday("date").cast("double")
    # names of the issues (fixed values)
    checks = [
        ("weekend_row", weekday >= 5, weekday, 5.0),
        ("long_calendar_gap_days", F.col("gap_days") > GAP_DAYS, F.col("gap_days").cast("double"), float(GAP_DAYS)),
        ("outlier_return_robust_z", F.abs(z) >= ROBUST_Z, z, ROBUST_Z),
        ("flash_move_log_return", F.abs(r) >= FLASH, r, FLASH),
        ("zero_volume", F.col("volume") == 0, F.col("volume"), 0.0),
        ("volume_regime_ratio", (v >= VOLUME_RATIO) | (v <= 1 / VOLUME_RATIO), v, VOLUME_RATIO),
        ("volume_scale_shift_ratio", (s >= SCALE_RATIO) | (s <= 1 / SCALE_RATIO), s, SCALE_RATIO),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue_type"), x.alias("value"), F.lit(t).alias("threshold"))) for n, c, x, t in checks])
    rows = df.select("symbol", "row_id", "date", F.explode(F.array_compact(found)).alias("x")).select("symbol", "row_id", "date", "x.*")
    absent = missing_weekdays(bars).select("symbol", F.lit(None).cast("long").alias("row_id"), F.col("day").cast("timestamp_ntz").alias("date"), F.lit("potential_missing_weekday").alias("issue_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"))
    return rows.unionByName(absent)


def summary(bars: DataFrame, volume_span: int = VOLUME_SPAN) -> DataFrame:
    """(symbol, issue_type, n), with the longest gap in days and the rows of each regime as further entries."""
    counted = suspicious(bars, volume_span).groupBy("symbol", "issue_type").agg(F.count("*").alias("n"))
    df = base(bars).withColumn("regime", regime()).withColumn("gap", F.datediff(F.to_date("date"), F.to_date(shift("date"))))
    kinds = df.groupBy("symbol", F.concat(F.col("regime"), F.lit("_rows")).alias("issue_type")).agg(F.count("*").alias("n"))
    longest = df.groupBy("symbol", F.lit("maximum_calendar_gap_days").alias("issue_type")).agg(F.max("gap").cast("long").alias("n"))
    return counted.unionByName(kinds).unionByName(longest)
