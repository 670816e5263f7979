"""Causal features of a bar table, all by window functions over (symbol, row_id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..functions.windows import KEY, over, percentile, safe_div, shift, zscore

LAGS, SPANS, HURST, REGIME = (1, 2, 3, 5, 10, 20), (5, 10, 20, 63, 126), (64, 128), 252
IDS = ["symbol", "row_id", "date", "close", "volume"]


def base(bars: DataFrame) -> DataFrame:
    """``bars`` with log price ``lp``, log return ``r`` and log volume ``lv``."""
    with_logs = bars.withColumn("lp", F.ln("close")).withColumn("lv", F.log1p("volume"))
    return with_logs.withColumn("r", F.col("lp") - shift("lp"))


def returns() -> dict[str, Column]:
    return {f"return_lag_{k}": shift("r", k - 1) if k > 1 else F.col("r") for k in LAGS}


def moments() -> dict[str, Column]:
    out = {}
    for w in SPANS:
        out[f"return_mean_{w}"] = over(F.avg, "r", w)
        out[f"return_std_{w}"] = over(F.stddev_samp, "r", w)
    return out


def momentum() -> dict[str, Column]:
    out = {}
    for w in SPANS:
        out[f"momentum_{w}"] = F.col("lp") - shift("lp", w)
        out[f"price_zscore_{w}"] = zscore("lp", w)
        out[f"drawdown_{w}"] = F.col("close") / over(F.max, "close", w) - 1
    return out


def slopes() -> dict[str, Column]:
    from ..functions.windows import trailing

    return {f"trend_slope_{w}": F.when(F.count("lp").over(trailing(w)) >= w, F.regr_slope("lp", "row_id").over(trailing(w))) for w in SPANS}


def entropies() -> dict[str, Column]:
    out = {}
    for w in SPANS:
        p = over(F.avg, F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double")), w)
        part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
        out[f"sign_entropy_{w}"] = F.when(p.isNotNull(), part(p) + part(1 - p))
    return out


def shapes() -> dict[str, Column]:
    """Bias-corrected skewness and excess kurtosis over 20 returns."""
    n = 20.0
    g1, g2 = over(F.skewness, "r", 20), over(F.kurtosis, "r", 20)
    return {"rolling_skew_20": g1 * (n * (n - 1)) ** 0.5 / (n - 2), "rolling_kurtosis_20": ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))}


def volumes() -> dict[str, Column]:
    z20 = zscore("lv", 20, 20)
    return {"volume_change_1": F.col("lv") - shift("lv"), "volume_zscore_20": z20, "volume_zscore_63": zscore("lv", 63, 40), "return_volume_interaction": F.col("r") * z20, "range_log": F.ln(F.col("high") / F.col("low")), "close_open_log": F.ln(F.col("close") / F.col("open"))}


def calendar() -> dict[str, Column]:
    day, month = F.weekday("date"), F.month("date") - 1
    turn = lambda x, n: 2 * F.pi() * x / float(n)
    return {"dow_sin": F.sin(turn(day, 5)), "dow_cos": F.cos(turn(day, 5)), "month_sin": F.sin(turn(month, 12)), "month_cos": F.cos(turn(month, 12))}


def trend() -> dict[str, Column]:
    eff = safe_div(F.abs(F.col("lp") - shift("lp", 20)), over(F.sum, F.abs("r"), 20))
    m = F.col("lp") - shift("lp", 20)
    regime = F.when(eff.isNotNull() & m.isNotNull(), F.when((eff > 0.45) & (m > 0), 1.0).when((eff > 0.45) & (m < 0), -1.0).otherwise(0.0))
    return {"trend_efficiency_20": eff, "trend_regime": regime, "trend_regime_available": regime.isNotNull().cast("double")}


FAMILIES = (returns, moments, momentum, slopes, entropies, shapes, volumes, calendar, trend)

# --- recursive and fractal features: one Arrow batch for each symbol ---------


def ewm_mean(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Recursive mean that starts at the first valid value and skips nulls."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def ewm_std(x: np.ndarray, span: int, least: int) -> np.ndarray:
    """Square root of the debiased recursive variance."""
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=least).std().to_numpy()


def dfa_scales(n: int) -> tuple[int, ...]:
    out, s = [], 4
    while s <= n // 3:
        out.append(s)
        s *= 2
    return tuple(out)


def dfa1(lp: np.ndarray) -> np.ndarray:
    """Exponents of rows of a [m, w] window matrix: first-order detrended fluctuation, both directions."""
    d = np.diff(lp, axis=1)
    profile = np.cumsum(d - d.mean(axis=1, keepdims=True), axis=1)
    n = profile.shape[1]
    logs = []
    for s in dfa_scales(n):
        starts = [range(0, n - s + 1, s)] + ([range(n % s, n - s + 1, s)] if n % s else [])
        at = np.array([i for r in starts for i in r])
        seg = profile[:, at[:, None] + np.arange(s)]
        x = np.arange(s) - (s - 1) / 2
        centred = seg - seg.mean(axis=2, keepdims=True)
        rss = (centred**2).sum(axis=2) - (centred @ x) ** 2 / (x @ x)
        logs.append(0.5 * np.log(np.maximum(rss.sum(axis=1), 1e-300) / (len(at) * s)))
    if len(logs) < 3:
        return np.full(len(lp), np.nan)
    x = np.log(np.array(dfa_scales(n), dtype=float))
    x -= x.mean()
    return (np.array(logs).T @ x) / (x @ x)


def rescaled_range(lp: np.ndarray) -> np.ndarray:
    d = np.diff(lp, axis=1)
    std = d.std(axis=1, ddof=1)
    walk = np.cumsum(d - d.mean(axis=1, keepdims=True), axis=1)
    spread = walk.max(axis=1) - walk.min(axis=1)
    with np.errstate(all="ignore"):
        out = np.log(spread / std) / np.log(d.shape[1])
    return np.where((std > 1e-12) & (spread > 0), out, np.nan)


RECURSIVE = ["rsi_14", "atr_14_normalized", "ewma_vol_20", "ewma_vol_63", "vol_ratio_20_63", "macd", "macd_signal", "macd_histogram", *[f"hurst_rs_single_scale_legacy_{w}" for w in HURST], *[f"hurst_dfa1_{w}" for w in HURST]]


def recursive(bars: DataFrame, hurst: bool = True) -> DataFrame:
    """symbol, row_id and the recursive features; a symbol's bars are one group (its daily history, some MB)."""
    names = RECURSIVE if hurst else [n for n in RECURSIVE if "hurst" not in n]

    def run(pdf):
        pdf = pdf.sort_values("row_id", ignore_index=True)
        close, high, low = (pdf[c].to_numpy(float) for c in ("close", "high", "low"))
        lp = np.log(close)
        r = np.diff(lp, prepend=np.nan)
        out = pdf[["symbol", "row_id"]].copy()
        gain, loss = (ewm_mean(np.where(np.isnan(r), np.nan, np.clip(s * r, 0, None)), 1 / 14, 14) for s in (1, -1))
        with np.errstate(all="ignore"):
            out["rsi_14"] = np.where(loss == 0, np.nan, 1 - 1 / (1 + gain / np.where(loss == 0, np.nan, loss)))
            before = np.r_[np.nan, close[:-1]]
            true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
            out["atr_14_normalized"] = ewm_mean(true_range, 1 / 14, 14) / close
            out["ewma_vol_20"], out["ewma_vol_63"] = ewm_std(r, 20, 20), ewm_std(r, 63, 40)
            out["vol_ratio_20_63"] = out["ewma_vol_20"] / np.where(out["ewma_vol_63"] == 0, np.nan, out["ewma_vol_63"])
        out["macd"] = ewm_mean(lp, 2 / 13, 12) - ewm_mean(lp, 2 / 27, 26)
        out["macd_signal"] = ewm_mean(out["macd"].to_numpy(), 0.2, 9)
        out["macd_histogram"] = out["macd"] - out["macd_signal"]
        if hurst:
            for w in HURST:
                rs, dfa = np.full(len(lp), np.nan), np.full(len(lp), np.nan)
                if len(lp) >= w:
                    view = np.lib.stride_tricks.sliding_window_view(lp, w)
                    for i in range(0, len(view), 2048):
                        rs[w - 1 + i : w - 1 + i + 2048], dfa[w - 1 + i : w - 1 + i + 2048] = rescaled_range(view[i : i + 2048]), dfa1(view[i : i + 2048])
                out[f"hurst_rs_single_scale_legacy_{w}"], out[f"hurst_dfa1_{w}"] = rs, dfa
        return out[["symbol", "row_id", *names]]

    ship(bars.sparkSession)
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("row_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    return bars.select("symbol", "row_id", "high", "low", "close").groupBy(KEY).applyInPandas(run, schema)


def regimes(df: DataFrame, regime: int = REGIME) -> DataFrame:
    """Regime of the largest window's exponent against its past, robust variants over all windows, volatility z."""
    least = max(80, regime // 2)
    h = f"hurst_dfa1_{max(HURST)}"
    own = F.array_compact(F.array(*[F.col(f"hurst_dfa1_{w}") for w in HURST]))
    middle = lambda xs: (F.try_element_at(F.array_sort(xs), F.greatest(F.lit(1), F.ceil(F.size(xs) / 2).cast("int"))) + F.try_element_at(F.array_sort(xs), (F.floor(F.size(xs) / 2) + 1).cast("int"))) / 2
    df = df.withColumn("hurst_robust_median", middle(own))
    away = F.transform(own, lambda x: F.abs(x - F.col("hurst_robust_median")))
    df = df.withColumn("hurst_robust_dispersion", middle(away))

    def split(name: str, low: str, high: str) -> tuple[Column, Column, Column]:
        at, bottom, top = F.col(name), F.col(low), F.col(high)
        known = at.isNotNull() & bottom.isNotNull()
        return F.when(known, F.when(at >= top, 1.0).when(at <= bottom, -1.0).otherwise(0.0)), known.cast("double"), at

    for name, tag in ((h, "hurst"), ("hurst_robust_median", "hurst_robust")):
        df = df.withColumn(f"{tag}_low_threshold", over(percentile(0.33), name, regime, least, lag=1)).withColumn(f"{tag}_high_threshold", over(percentile(0.67), name, regime, least, lag=1))
        value, known, _ = split(name, f"{tag}_low_threshold", f"{tag}_high_threshold")
        df = df.withColumn(f"{tag}_regime", value).withColumn(f"{tag}_{'regime_' if tag == 'hurst' else ''}available", known)
    df = df.withColumn("hurst_dfa1_available", F.col(h).isNotNull().cast("double"))
    lagged = shift("ewma_vol_20")
    df = df.withColumn("__lagged", lagged)
    return df.withColumn("volatility_zscore", zscore("__lagged", regime, least)).drop("__lagged", "hurst_low_threshold", "hurst_high_threshold")


#: What :func:`regimes` adds.
REGIMES = ["hurst_dfa1_available", "hurst_regime", "hurst_regime_available", "hurst_robust_median", "hurst_robust_dispersion", "hurst_robust_low_threshold", "hurst_robust_high_threshold", "hurst_robust_regime", "hurst_robust_available", "volatility_zscore"]
def arm(columns: list[str], name: str) -> list[str]:
    """The columns of one Hurst arm: none, the fluctuation exponents with their regime, or the robust regime; never the legacy exponents."""
    plain = [c for c in columns if not c.startswith("hurst_")]
    own = {
        "no_hurst": lambda c: False,
        "current_dfa_hurst": lambda c: c.startswith("hurst_dfa1_") or c in ("hurst_regime", "hurst_regime_available"),
        "robust_hurst_regime": lambda c: c.startswith("hurst_robust_"),
    }
    if name not in own:
        raise ValueError(f"no arm {name}")
    return plain + [c for c in columns if c not in plain and own[name](c)]


def ablated(columns: list[str], name: str) -> tuple[list[str], bool]:
    """The columns of an ablation variant, and whether a meta classifier is stacked on it."""
    kind, _, meta = name.rpartition("_hurst_")
    legacy = [c for c in columns if "hurst_rs_single_scale_legacy" in c]
    chosen = {
        "dfa": [c for c in columns if c not in legacy],
        "no": [c for c in columns if "hurst" not in c],
        "legacy": [c for c in columns if "hurst" not in c or c in legacy],
    }
    if kind not in chosen or meta not in ("with_meta", "no_meta") or (kind, meta) == ("legacy", "with_meta"):
        raise ValueError(f"no variant {name}")
    return chosen[kind], meta == "with_meta"


#: Names of the ablation variants (fixed values).
ABLATIONS = ["dfa_hurst_with_meta", "dfa_hurst_no_meta", "no_hurst_with_meta", "no_hurst_no_meta", "legacy_hurst_no_meta"]


def matrix(bars: DataFrame) -> DataFrame:
    """All features with their coverage; one shuffle by symbol serves every window."""
    df = base(bars)
    names = []
    for family in FAMILIES:
        made = family()
        df = df.withColumns(made)
        names += made
    df = df.join(recursive(bars), ["symbol", "row_id"], "left")
    df = regimes(df)
    names += [*RECURSIVE, "hurst_dfa1_available", "hurst_regime", "hurst_regime_available", "volatility_zscore"]
    held = sum((F.col(n).isNotNull().cast("int") for n in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    return df.withColumn("feature_coverage", held / float(len(names)))
