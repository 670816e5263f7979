"""Forward labels, decision timing and eligibility for one or many horizons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ahead, over
from .features import base

HORIZONS = (1, 5, 10, 20)


def bps(x: float) -> float:
    return math.log1p(x / 1e4)


def all_horizons(bars: DataFrame, horizons=HORIZONS, lag: int = 1, k: float = 0.35, floor_bps: float = 8, cost_bps: float = 3, slip_bps: float = 2, buffer_bps: float = 2, span: int = 63, least: int = 40, coverage: str | None = None, least_coverage: float = 0.0, extra: dict | None = None, further: dict | None = None) -> DataFrame:
    """Labels of every horizon: the statistical one from close to close, the executable one from open to open.

    All horizons' leads share one window, computed once; the horizons are then exploded.  ``coverage`` names a column that
    eligible rows must hold ``least_coverage`` of; ``extra`` and then ``further`` add columns to the bars.
    """
    df = base(bars).withColumn("lo", F.ln("open")).withColumns(extra or {}).withColumns(further or {})
    df = df.withColumn("sigma", over(F.stddev_samp, "r", span, least))
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), (ahead("lp", h) - F.col("lp")).alias("s"), (ahead("lo", lag + h) - ahead("lo", lag)).alias("e"), ahead("date", lag).alias("i"), ahead("date", lag + h).alias("o"), F.lit(k * math.sqrt(h)).alias("k")) for h in horizons])
    df = df.withColumns({"last_row": F.max("row_id").over(Window.partitionBy("symbol")), "available_timestamp": ahead("date", 1), "x": each})
    df = df.withColumn("x", F.explode("x"))
    sure = lambda c: F.when(c.isNotNull(), (c > 0).cast("double"))
    h, row, e = F.col("x.horizon"), F.col("row_id"), F.col("x.e")
    t = F.when(F.col("sigma").isNotNull(), F.greatest(F.col("x.k") * F.col("sigma"), F.lit(bps(floor_bps)), F.lit(bps(cost_bps + slip_bps + buffer_bps))))
    df = df.withColumns({
        "horizon": h,
        "statistical_forward_log_return": F.col("x.s"), "executable_forward_log_return": e,
        "statistical_direction_binary": sure(F.col("x.s")), "executable_direction_binary": sure(e),
        "direction_threshold": t, "threshold_bps": F.expm1(t) * 1e4,
        "executable_direction_three_class": F.when(e.isNotNull() & t.isNotNull(), F.when(e > t, 1.0).when(e < -t, -1.0).otherwise(0.0)),
        "is_actionable": F.coalesce(F.abs(e) > t, F.lit(False)),
        "decision_row_index": row, "available_row_index": row + 1, "entry_row_index": row + lag, "exit_row_index": row + lag + h,
        "label_end_index": row + h, "executable_label_end_index": row + lag + h,
        "decision_timestamp": F.col("date"), "entry_timestamp": F.col("x.i"), "exit_timestamp": F.col("x.o"),
    })
    full = F.lit(True) if coverage is None else F.coalesce(F.col(coverage) >= least_coverage, F.lit(False))
    known = F.col("statistical_direction_binary").isNotNull() & F.col("executable_direction_binary").isNotNull() & F.col("direction_threshold").isNotNull()
    eligible = known & full & (F.col("executable_label_end_index") <= F.col("last_row"))
    return df.withColumn("is_modeling_eligible", eligible).drop("x", "last_row")


def horizon_labels(bars: DataFrame, h: int, **options) -> DataFrame:
    return all_horizons(bars, (h,), **options)


#: Identity of the target policy and older names of the label columns (fixed values).
POLICY = "separated_statistical_executable_direction_v3"
ALIASES = {
    "forward_log_return": "statistical_forward_log_return",
    "direction_binary": "statistical_direction_binary",
    "direction_three_class": "executable_direction_three_class",
    "actionable_direction_three_class": "executable_direction_three_class",
    "actionable_threshold_log_return": "direction_threshold",
    "direction_threshold_bps": "threshold_bps",
    "actionable_threshold_bps": "threshold_bps",
}


def with_aliases(labels: DataFrame) -> DataFrame:
    """``labels`` with the older names beside the new ones and the identity of the policy."""
    return labels.withColumns({old: F.col(new) for old, new in ALIASES.items()} | {"target_policy_id": F.lit(POLICY)})


def scored(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Eligible rows of every horizon with the deterministic score p = logistic(price_zscore_20 / 4); it needs no training.

    ``volatility_zscore`` is the z-score of the volatility of 20 rows against the 63 before the last.
    """
    from ..functions.windows import shift, zscore

    df = all_horizons(bars, horizons, extra={"price_zscore_20": zscore("lp", 20), "momentum_20": F.col("lp") - shift("lp", 20), "vol_20": over(F.stddev_samp, "r", 20)}, further={"volatility_zscore": zscore(shift("vol_20"), 63)})
    df = df.where(F.col("is_modeling_eligible") & F.col("price_zscore_20").isNotNull())
    return df.withColumn("p", 1 / (1 + F.exp(-F.col("price_zscore_20") / 4))).withColumn("y", F.col("executable_direction_binary"))
