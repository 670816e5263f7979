"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, asof, features, labels, metrics, models, multiplicity, promotion, schedule, splits
from ..sources import bars as B

KEYS = ["symbol", "horizon"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark, sf) -> DataFrame:
    return B.bars_orders(read(spark, sf, "orders"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (no negative zero), dates as text."""
    def show(name, kind):
        if kind == "double":
            return (F.round(F.when(~F.isnan(name), F.col(name)), digits) + 0.0).alias(name)
        if kind in ("timestamp_ntz", "date", "timestamp"):
            return F.date_format(name, "yyyy-MM-dd").alias(name)
        return F.col(name).cast("long").alias(name) if kind in ("int", "bigint") else F.col(name)
    return df.select([show(n, k) for n, k in df.dtypes])


def scored(spark, sf) -> DataFrame:
    return labels.scored(orders(spark, sf))


def trials(spark, sf) -> DataFrame:
    """Twelve simple trials: sign of a feature times the executable return, by horizon."""
    s = scored(spark, sf)
    arms = F.explode(F.array(F.struct(F.lit(1).alias("arm"), F.col("price_zscore_20").alias("x")), F.struct(F.lit(2).alias("arm"), F.col("r").alias("x")), F.struct(F.lit(3).alias("arm"), F.col("momentum_20").alias("x"))))
    wide = s.select("horizon", "row_id", "executable_forward_log_return", arms.alias("a"))
    return wide.select((F.col("horizon") * 10 + F.col("a.arm")).alias("trial_id"), "row_id", (F.when(F.col("a.x") >= 0, 1).otherwise(-1) * F.col("executable_forward_log_return")).alias("ret"))


def suppliers(spark, sf) -> DataFrame:
    """A series of bars for each supplier: the symbols grow with the data."""
    return B.bars_panel(read(spark, sf, "lineitem"), "l_suppkey")


def panel(made) -> callable:
    def query(spark, sf):
        cols = made()
        return rounded(features.base(suppliers(spark, sf)).withColumns(cols).select("symbol", "row_id", *cols))
    return query


def family(made) -> callable:
    def query(spark, sf):
        cols = made()
        return rounded(features.base(orders(spark, sf)).withColumns(cols).select("row_id", *cols))
    return query


def events_asof(spark, sf, stale: float | None) -> DataFrame:
    e = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    d = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("decision_timestamp"))
    w = Window.partitionBy("user_id", "t").orderBy(F.desc("event_id"))
    s = e.where("event_type = 'view'").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", F.col("t").alias("available_at"), (F.col("t") - F.expr("interval 1 hour")).alias("observed_at"), "value")
    return asof.backward_asof(d, s, ["value"], by=["user_id"], max_staleness_seconds=stale, check=False)


def asof_query(stale):
    def query(spark, sf):
        return rounded(events_asof(spark, sf, stale).select("event_id", "user_id", "value", "staleness_seconds", "availability_matched", "is_stale", "feature_coverage"))
    return query


def events_frame(spark, sf) -> DataFrame:
    """Eligible events of horizon 5 with the executable label end."""
    e = labels.horizon_labels(orders(spark, sf), 5).where("is_modeling_eligible")
    return e.select("symbol", "row_id", "date", F.col("executable_label_end_index").alias("label_end_index"))


def overlap_query(anti: bool):
    """Eligible events of each horizon that overlap one of its moves of half a log point or more, or none."""
    def query(spark, sf):
        e = labels.all_horizons(orders(spark, sf)).where("is_modeling_eligible").select("symbol", "horizon", "row_id", F.col("executable_label_end_index").alias("label_end_index"), (F.col("is_actionable") & (F.abs("executable_forward_log_return") >= 0.5)).alias("large"))
        return rounded(splits.overlapping(e.drop("large"), e.where("large").drop("large"), KEYS, anti).select("horizon", "row_id", "label_end_index"))
    return query


def folds_of(spark, sf) -> DataFrame:
    return splits.walk_forward(events_frame(spark, sf), 5, 280, 3)


def learning_rows(spark, sf, h: int) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows with features, y and what a ledger needs; feature names; events) of one horizon."""
    b = orders(spark, sf)
    cols = {**features.returns(), **features.momentum(), **features.volumes()}
    x = features.base(b).withColumns(cols).select("symbol", "row_id", *cols)
    s = labels.scored(b, (h,)).select("symbol", "horizon", "row_id", "y", "entry_row_index", "exit_row_index", "entry_timestamp", "exit_timestamp", "executable_forward_log_return", "r", F.col("momentum_20").alias("m20"), "volatility_zscore", F.col("executable_label_end_index").alias("label_end_index"))
    rows = s.join(x, ["symbol", "row_id"]).cache()
    return rows, list(cols), rows.select("symbol", "row_id", "label_end_index")


def ml_oof(spark, sf) -> DataFrame:
    """Out-of-fold probabilities of the logistic candidate for every horizon."""
    out = None
    for h in labels.HORIZONS:
        rows, names, events = learning_rows(spark, sf, h)
        got = models.out_of_fold(rows, splits.walk_forward(events, 3).cache(), names).select("horizon", "fold_id", "row_id", "y", "p")
        out = got if out is None else out.unionByName(got)
    return out


def candidate_scores(spark, sf) -> DataFrame:
    """Three scores of the trial arms as candidates, with the fold of each row."""
    s = scored(spark, sf).withColumn("fold_id", F.ntile(5).over(Window.partitionBy(*KEYS).orderBy("row_id")))
    up = lambda x, k: 1 / (1 + F.exp(-x * k))
    arms = F.explode(F.array(F.struct(F.lit("level").alias("candidate"), F.col("p").alias("p")), F.struct(F.lit("return").alias("candidate"), up(F.col("r"), 20.0).alias("p")), F.struct(F.lit("trend").alias("candidate"), up(F.col("momentum_20"), 5.0).alias("p"))))
    return s.select(*KEYS, "fold_id", "row_id", "y", arms.alias("a")).select(*KEYS, "fold_id", "row_id", "y", "a.*")


def replayed(spark, sf) -> DataFrame:
    """The state machine over the bars and the frozen signals of every horizon, each a symbol of its own."""
    from ..streaming import replay

    s = schedule.one_position(scored(spark, sf), KEYS, 0.0)
    name = F.concat(F.lit("H"), F.col("horizon"))
    signals = s.select(name.alias("symbol"), "entry_timestamp", "exit_timestamp", F.col("signal").alias("direction"), "signal_id")
    b = orders(spark, sf).select(F.explode(F.array(*[F.lit(f"H{h}") for h in labels.HORIZONS])).alias("symbol"), "date", "open")
    return rounded(replay.replay(replay.as_events(b, signals)).select("symbol", "time", "event", "signal_id", "direction", "price"))


def feature_columns(spark, sf) -> DataFrame:
    """(selection, n): how many feature columns each Hurst arm and ablation variant takes."""
    names = [c for c in features.matrix(orders(spark, sf)).columns if c not in BAR and c not in ("lp", "lv", "r", "feature_coverage")]
    rows = [(a, len(features.arm(names, a))) for a in ("no_hurst", "current_dfa_hurst", "robust_hurst_regime")] + [(a, len(features.ablated(names, a)[0])) for a in features.ABLATIONS]
    return spark.createDataFrame(rows, "selection string, n long")


def book_of(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The schedule of the deterministic score and its trades at the bars' opens."""
    s = schedule.one_position(scored(spark, sf), KEYS)
    s = s.withColumn("signal_id", F.concat(F.lit("h"), F.col("horizon"), F.lit("_"), F.col("signal_id")))
    return s, schedule.executed(s, orders(spark, sf))


def reconciliation(spark, sf) -> DataFrame:
    return rounded(schedule.reconcile(*book_of(spark, sf)))


def reconciliation_of_faults(spark, sf) -> DataFrame:
    """The same trades with faults of every kind, at rows that a rule of the date picks."""
    s, t = book_of(spark, sf)
    day, month = F.dayofmonth("entry_timestamp"), F.month("entry_timestamp")
    t = t.where(~((month == 1) & (day == 5))).withColumns({
        "direction": F.when((month == 2) & (day == 6), -F.col("direction")).otherwise(F.col("direction")),
        "exit_timestamp": F.when((month == 3) & (day == 7), F.col("entry_timestamp")).otherwise(F.col("exit_timestamp")),
        "entry_price": F.when((month == 4) & (day == 8), 0.0).otherwise(F.col("entry_price")),
        "spread_bps": F.when((month == 5) & (day == 9), -1.0).otherwise(F.col("spread_bps")),
        "order_id": F.when((month == 6) & (day == 10), "").when((month == 7) & (day == 11), "o-same").otherwise(F.col("order_id")),
        "signal_id": F.when((month == 8) & (day == 12), F.concat(F.col("signal_id"), F.lit("-x"))).otherwise(F.col("signal_id")),
    })
    again = t.where((month == 9) & (day == 13)).withColumns({"order_id": F.concat(F.col("order_id"), F.lit("-2")), "deal_id": F.concat(F.col("deal_id"), F.lit("-2"))})
    return rounded(schedule.reconcile(s, t.unionByName(again)))


def paired(spark, sf) -> DataFrame:
    """Scored rows with the net returns of the candidate and of holding long, and the fold of each."""
    s = scored(spark, sf)
    book = schedule.ledger(s, KEYS).select(*KEYS, "row_id", "active", "candidate", F.col("always_long").alias("benchmark"), *promotion.BENCHMARKS)
    return s.join(book, [*KEYS, "row_id"]).withColumn("fold", F.ntile(5).over(Window.partitionBy(*KEYS).orderBy("row_id")))


BLOCKS, PRIMARY, ROUNDS = (5, 10, 20), 10, 100


def joint_intervals(spark, sf) -> DataFrame:
    return multiplicity.joint_intervals(multiplicity.joint_bootstrap(paired(spark, sf), KEYS, BLOCKS, ROUNDS), KEYS)


def evidence(spark, sf) -> DataFrame:
    """What the gate judges, of the deterministic score of each horizon.

    The baseline forecasts the share of ups of the earlier folds (the first: one half).  Only one QA flag can be told from the
    tables: that no training interval overlaps its fold's validation.
    """
    from ..operators.labels import bps

    s = paired(spark, sf)
    m = metrics.rates(s.groupBy(*KEYS, "fold").agg(F.count("*").alias("n"), F.sum("y").alias("ups"), *metrics.confusion(F.lit(0.5))))
    fold = F.struct(F.concat(F.lit("wf_"), F.col("fold")).alias("fold_id"), "n", "balanced_accuracy", "macro_f1", "recall_down", "recall_up", (F.col("n") >= 30).alias("material"))
    folds = m.groupBy(*KEYS).agg(F.sort_array(F.collect_list(fold)).alias("folds"))
    pooled = metrics.classification(s, KEYS).select(*KEYS, *[F.col(c).alias(f"pooled_{c}") for c in ("balanced_accuracy", "macro_f1", "recall_down", "recall_up")], F.col("brier").alias("candidate_brier"), F.col("ece_weighted").alias("candidate_ece"))
    before = Window.partitionBy(*KEYS).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    base = m.select(*KEYS, "fold", "n", "ups", F.coalesce(F.sum("ups").over(before) / F.sum("n").over(before), F.lit(0.5)).alias("b"))
    edge = sum(((F.col("b") >= i / 10).cast("int") for i in range(2, 10)), (F.col("b") >= 0.1).cast("int"))
    bins = base.withColumn("bin", edge).groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"), F.abs(F.sum(F.col("ups") - F.col("n") * F.col("b"))).alias("gap"), F.sum(F.col("ups") * (1 - 2 * F.col("b")) + F.col("n") * F.col("b") * F.col("b")).alias("loss"))
    base = bins.groupBy(*KEYS).agg((F.sum("loss") / F.sum("n")).alias("baseline_brier"), (F.sum("gap") / F.sum("n")).alias("baseline_ece"))
    sign = metrics.rates(s.withColumn("p", F.when(F.col("r") >= 0, 1.0).otherwise(0.0)).groupBy(*KEYS).agg(*metrics.confusion(F.lit(0.5)))).select(*KEYS, F.col("balanced_accuracy").alias("sign_accuracy"))
    ci = joint_intervals(spark, sf).where("statistic in ('balanced_accuracy', 'paired_mean_net_return')")
    pick = lambda c, b: F.max(F.when((F.col("statistic") == c) & (F.col("block") == b), F.col("low")))
    lows = ci.groupBy(*KEYS).agg(pick("balanced_accuracy", PRIMARY).alias("ci_low"), pick("paired_mean_net_return", PRIMARY).alias("paired_low"), *[pick("balanced_accuracy", b).alias(f"low_{b}") for b in BLOCKS if b != PRIMARY])
    stress = bps(10.0) - bps(5.0)
    net = s.groupBy(*KEYS).agg(F.count_if("active").alias("trades"), F.sum("candidate").alias("total"), *[F.sum(b).alias(f"of_{b}") for b in promotion.BENCHMARKS])
    t = trials(spark, sf).cache()
    n_trials, = t.agg(F.count_distinct("trial_id")).collect()[0]
    dsr = spark.createDataFrame([(i // 10, p) for i, p in multiplicity.deflated(t) if i % 10 == 1], "horizon int, dsr double")
    pbo = multiplicity.pbo_summary(multiplicity.align(t)).select("pbo")
    overlaps = splits.fold_overlaps(folds_of(spark, sf)).limit(1).count()
    e = folds.join(pooled, KEYS).join(base, KEYS).join(sign, KEYS).join(lows, KEYS).join(net, KEYS).join(metrics.calibration_line(s, KEYS), KEYS).join(dsr, "horizon", "left").join(F.broadcast(pbo))
    return e.withColumns({
        "sensitivity_lows": F.create_map(*[x for b in BLOCKS if b != PRIMARY for x in (F.lit(str(b)), F.col(f"low_{b}"))]),
        "classification_deltas": F.create_map(F.lit("constant"), F.col("pooled_balanced_accuracy") - 0.5, F.lit("last_sign"), F.col("pooled_balanced_accuracy") - F.col("sign_accuracy")),
        "net": F.expm1("total"), "stress_net": F.expm1(F.col("total") - F.col("trades") * stress),
        "economic_deltas": F.create_map(*[x for b in promotion.BENCHMARKS for x in (F.lit(b), F.col("total") - F.col(f"of_{b}"))]),
        "registry_complete": F.lit(n_trials == 3 * len(labels.HORIZONS)), "qa_flags": F.create_map(F.lit("leakage_free"), F.lit(overlaps == 0)),
    })


def gate(spark, sf) -> DataFrame:
    """The decision on each horizon, with the figures behind it."""
    e = promotion.promotion(evidence(spark, sf))
    return rounded(e.select("horizon", "pooled_balanced_accuracy", "ci_low", "paired_low", "candidate_brier", "baseline_brier", "candidate_ece", "baseline_ece", "net", "stress_net", "trades", "pbo", "failed_checks", "promoted"), 5)


def boot(spark, sf) -> DataFrame:
    s = scored(spark, sf).where("horizon = 5")
    return rounded(multiplicity.interval(multiplicity.block_bootstrap(s.select("row_id", "executable_forward_log_return"), "executable_forward_log_return")), 9)


LABEL_COLUMNS = ["horizon", "row_id", "threshold_bps", "decision_timestamp", "available_timestamp", "entry_timestamp", "exit_timestamp", "statistical_forward_log_return", "executable_forward_log_return", "statistical_direction_binary", "executable_direction_binary", "direction_threshold", "executable_direction_three_class", "is_actionable", "label_end_index", "executable_label_end_index", "is_modeling_eligible"]
BAR = ["symbol", "row_id", "date", "open", "high", "low", "close", "volume"]

QUERIES = {
    "ohlcv_bars": lambda s, d: rounded(orders(s, d)),
    "bars_panel": lambda s, d: rounded(B.bars_panel(read(s, d, "lineitem")), 8),
    "supplier_moments": panel(features.moments),
    "supplier_momentum": panel(features.momentum),
    "supplier_labels": lambda s, d: rounded(labels.all_horizons(suppliers(s, d)).groupBy("symbol", "horizon").agg(F.count_if("is_modeling_eligible").alias("n_eligible"), F.count_if("is_actionable").alias("n_actionable"), F.sum("executable_forward_log_return").alias("total"))),
    "validation_counts": lambda s, d: rounded(B.violations(orders(s, d))),
    "drop_newest_bar": lambda s, d: rounded(B.drop_newest(B.bars_panel(read(s, d, "lineitem"))).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last"))),
    "dev_prefix_scan": lambda s, d: rounded(B.development_prefix(orders(s, d), "2999-01-01", 500)),
    "feat_returns": family(features.returns),
    "feat_rolling_moments": family(features.moments),
    "feat_momentum_drawdown": family(features.momentum),
    "feat_trend_slope": family(features.slopes),
    "feat_sign_entropy": family(features.entropies),
    "feat_skew_kurt": family(features.shapes),
    "feat_volume": family(features.volumes),
    "feat_calendar": family(features.calendar),
    "feat_trend_regime": family(features.trend),
    "feat_ewm": lambda s, d: rounded(features.recursive(orders(s, d), hurst=False).select("row_id", "rsi_14", "atr_14_normalized", "macd", "macd_signal", "macd_histogram"), 6),
    "feat_ewm_vol": lambda s, d: rounded(features.recursive(orders(s, d), hurst=False).select("row_id", "ewma_vol_20", "ewma_vol_63", "vol_ratio_20_63"), 6),
    "feat_hurst": lambda s, d: rounded(features.recursive(orders(s, d)).select("row_id", *[n for n in features.RECURSIVE if "hurst" in n])),
    "feat_regimes": lambda s, d: rounded(features.regimes(features.recursive(orders(s, d))).select("row_id", *features.REGIMES), 5),
    "feat_columns": feature_columns,
    "feat_matrix": lambda s, d: rounded(features.matrix(orders(s, d)).select("row_id", "hurst_regime", "hurst_robust_median", "hurst_robust_dispersion", "hurst_robust_low_threshold", "hurst_robust_high_threshold", "hurst_robust_regime", "volatility_zscore", "feature_coverage")),
    "labels_all_horizons": lambda s, d: rounded(labels.all_horizons(orders(s, d)).select(*LABEL_COLUMNS)),
    "label_aliases": lambda s, d: rounded(labels.with_aliases(labels.all_horizons(orders(s, d))).select("horizon", "row_id", "target_policy_id", *labels.ALIASES)),
    "eligible_counts": lambda s, d: rounded(labels.all_horizons(orders(s, d)).groupBy("horizon").agg(F.count("*").alias("n_rows"), F.count_if("is_modeling_eligible").alias("n_eligible"), F.count_if("is_actionable").alias("n_actionable"))),
    "class_balance": lambda s, d: rounded(audit.class_balance(labels.all_horizons(orders(s, d)))),
    "audit_yearly": lambda s, d: rounded(audit.yearly(orders(s, d))),
    "audit_suspicious": lambda s, d: rounded(audit.suspicious(orders(s, d))),
    "audit_summary": lambda s, d: rounded(audit.summary(orders(s, d))),
    "missing_weekdays": lambda s, d: rounded(audit.missing_weekdays(B.bars_panel(read(s, d, "lineitem")))),
    "asof_feature_join": asof_query(None),
    "asof_staleness": asof_query(86400.0),
    "locked_split": lambda s, d: rounded(splits.locked(events_frame(s, d), 900).groupBy("role").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))),
    "walk_forward_folds": lambda s, d: rounded(splits.fold_counts(folds_of(s, d))),
    "nested_folds": lambda s, d: rounded(splits.fold_counts(splits.nested(events_frame(s, d), 5, 3, 500, 200), ("symbol", "outer_fold", "fold_id"))),
    "cpcv_manifest": lambda s, d: rounded(splits.fold_counts(splits.cpcv(events_frame(s, d), 8, 2, 4), ("symbol", "split_id", "test_groups"))),
    "fold_overlaps": lambda s, d: rounded(splits.fold_overlaps(folds_of(s, d)).groupBy("fold_id").agg(F.count("*").alias("n"))),
    "purged_overlaps": lambda s, d: rounded(splits.fold_overlaps(folds_of(s, d).withColumn("role", F.when(F.col("role") == "validation", "validation").when(F.col("role") != "train", "train"))).select("fold_id", "row_id")),
    "overlap_semi": overlap_query(False),
    "overlap_anti": overlap_query(True),
    "split_manifest_hash": lambda s, d: rounded(splits.manifest(splits.walk_forward(events_frame(s, d)), ["symbol", "fold_id"])),
    "classification_metrics": lambda s, d: rounded(metrics.classification(scored(s, d), KEYS)),
    "calibration_bins": lambda s, d: rounded(metrics.bins(scored(s, d), KEYS)),
    "ece_two_ways": lambda s, d: rounded(metrics.ece(scored(s, d), KEYS)),
    "roc_auc": lambda s, d: rounded(metrics.auc(scored(s, d), KEYS)),
    "threshold_grid": lambda s, d: rounded(metrics.threshold_grid(scored(s, d), KEYS).select(*KEYS, "threshold", "tp", "fp", "tn", "fn", "balanced_accuracy", "macro_f1", "mcc")),
    "best_threshold": lambda s, d: rounded(metrics.best_threshold(scored(s, d), KEYS)),
    "schedule_nonoverlap": lambda s, d: rounded(schedule.by_rows(scored(s, d), KEYS).select("horizon", "row_id")),
    "schedule_abstain": lambda s, d: rounded(schedule.by_rows(scored(s, d), KEYS, band=0.1).select("horizon", "row_id")),
    "schedule_single_position": lambda s, d: rounded(schedule.one_position(scored(s, d), KEYS).select("horizon", "row_id", "signal", "signal_id")),
    "replay_signals": lambda s, d: rounded(schedule.replay_signals(scored(s, d), KEYS).select("horizon", "row_id", "entry_time", "exit_time", "direction", "signal_id")),
    "return_ledger": lambda s, d: rounded(schedule.ledger(scored(s, d), KEYS).drop("symbol", "calm")),
    "benchmark_summaries": lambda s, d: rounded(schedule.benchmarks(scored(s, d), KEYS)),
    "schedule_violations": lambda s, d: rounded(schedule.schedule_violations(schedule.one_position(scored(s, d), KEYS), KEYS)),
    "trade_reconciliation": reconciliation,
    "reconciliation_of_faults": reconciliation_of_faults,
    "calibration_line": lambda s, d: rounded(metrics.calibration_line(scored(s, d), KEYS), 5),
    "trial_alignment": lambda s, d: rounded(multiplicity.align(trials(s, d)).groupBy("trial_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.sum("ret").alias("total"))),
    "pbo_cscv": lambda s, d: rounded(multiplicity.pbo_summary(multiplicity.align(trials(s, d))), 5),
    "sharpe_moments": lambda s, d: rounded(multiplicity.moments(trials(s, d)).withColumn("psr_z", multiplicity.probabilistic_z())),
    "block_bootstrap_ci": boot,
    "joint_bootstrap_ci": lambda s, d: rounded(joint_intervals(s, d)),
    "trial_sharpes": lambda s, d: rounded(multiplicity.trial_sharpes(trials(s, d))),
    "promotion_gate": gate,
    "stability_selection": lambda s, d: rounded(models.selected(candidate_scores(s, d), KEYS)),
    "signal_replay": replayed,
    "signal_contract": lambda s, d: rounded(B.signal_violations(schedule.one_position(scored(s, d), KEYS).select("horizon", F.col("entry_timestamp").alias("entry_time"), F.col("exit_timestamp").alias("exit_time"), F.col("signal").alias("direction"), "signal_id"), ("horizon",))),
    "frame_fingerprint": lambda s, d: B.fingerprint(orders(s, d), ["row_id", "volume"], 1.0),
    "source_differences": lambda s, d: rounded(B.differences(orders(s, d), orders(s, d).withColumns({c: F.round(c, 0) for c in B.PRICES}).where("row_id >= 5"), ["symbol", "row_id"], [*B.PRICES, "volume"], 0.25)),
    "nested_containment": lambda s, d: rounded(splits.uncontained(events_frame(s, d), 5, 3, 500, 200)),
    "fold_metadata": lambda s, d: rounded(splits.with_fold_metadata(folds_of(s, d)).where("role = 'validation'").select("fold_id", "row_id", "n_train", "n_purged", "n_validation", "first_validation_row")),
    "ml_oof_probabilities": ml_oof,
}
