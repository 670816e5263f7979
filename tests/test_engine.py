"""The time-series operators against pandas, DuckDB and small literals."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, audit, features, labels, metrics, multiplicity, promotion, schedule, splits
from tidemark.registry import QUERIES, SQL
from tidemark.sources import bars as B

SF = "/root/testdata/sf0.001"
KEYS = ["symbol", "horizon"]


@pytest.fixture(scope="module")
def synthetic(spark):
    return B.synthetic(spark, 800, 7).cache()


def bars_of(spark, closes, volumes=None, first="2021-03-01", opens=None, days=None):
    """Bars on business days; high and low enclose open and close."""
    days = days or [str(d.date()) for d in pd.bdate_range(first, periods=len(closes))]
    rows = []
    for i, c in enumerate(closes):
        o = (opens or closes)[i]
        rows.append(("S", i, pd.Timestamp(days[i]), float(o), max(o, c) * 1.01, min(o, c) * 0.99, float(c), float((volumes or [1000] * len(closes))[i])))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "row_id", "date", *B.PRICES, "volume"]))
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_bars_are_valid_and_deterministic(spark, synthetic):
    assert B.validate(synthetic).count() == 800
    assert B.synthetic(spark, 800, 7).exceptAll(synthetic).count() == 0
    assert synthetic.where(F.weekday("date") >= 5).count() == 0
    with pytest.raises(B.ContractError):
        B.validate(synthetic.withColumn("close", -F.col("close")))
    with pytest.raises(B.ContractError):
        B.validate(synthetic.limit(10))


def test_recursive_features_equal_pandas(synthetic):
    pdf = synthetic.toPandas().sort_values("row_id", ignore_index=True)
    got = features.recursive(synthetic).toPandas().sort_values("row_id", ignore_index=True)
    lp = np.log(pdf.close)
    r = lp.diff()
    macd = lp.ewm(span=12, adjust=False, min_periods=12).mean() - lp.ewm(span=26, adjust=False, min_periods=26).mean()
    pd.testing.assert_series_equal(got.macd.astype(float), macd, check_names=False)
    pd.testing.assert_series_equal(got.macd_signal.astype(float), macd.ewm(span=9, adjust=False, min_periods=9).mean(), check_names=False)
    for span, least in ((20, 20), (63, 40)):
        pd.testing.assert_series_equal(got[f"ewma_vol_{span}"].astype(float), r.ewm(span=span, adjust=False, min_periods=least).std(), check_names=False)
    assert got.hurst_dfa1_128.first_valid_index() == 127


def test_fluctuation_exponent_equals_polyfit():
    rng = np.random.default_rng(42)
    lp = np.cumsum(rng.normal(size=64))
    d = np.diff(lp)
    prof = np.cumsum(d - d.mean())
    logs = []
    for s in features.dfa_scales(len(prof)):
        rss = n = 0
        for start in [*range(0, len(prof) - s + 1, s), *(range(len(prof) % s, len(prof) - s + 1, s) if len(prof) % s else [])]:
            seg = prof[start : start + s]
            rss += ((seg - np.polyval(np.polyfit(np.arange(s), seg, 1), np.arange(s))) ** 2).sum()
            n += s
        logs.append((math.log(s), 0.5 * math.log(rss / n)))
    assert features.dfa_scales(63) == (4, 8, 16)
    assert features.dfa1(lp[None])[0] == pytest.approx(np.polyfit(*zip(*logs), 1)[0], abs=1e-12)
    assert features.dfa1(5 + 3 * lp[None])[0] == pytest.approx(features.dfa1(lp[None])[0], abs=1e-9)


def test_features_are_causal(synthetic):
    cut = 500
    changed = synthetic.withColumns({c: F.when(F.col("row_id") > cut, F.col(c) * 1.7).otherwise(F.col(c)) for c in [*B.PRICES, "volume"]})
    a, b = (features.matrix(x).where(F.col("row_id") <= cut).drop("date") for x in (synthetic, changed))
    names = [c for c, k in a.dtypes if k == "double"]
    a, b = (x.select("symbol", "row_id", *[F.round(c, 10).alias(c) for c in names]) for x in (a, b))
    assert a.exceptAll(b).count() == 0


def test_arms_and_variants_choose_columns():
    names = ["r", "volume_z", "hurst_rs_single_scale_legacy_64", "hurst_dfa1_64", "hurst_regime", "hurst_robust_median"]
    assert features.arm(names, "no_hurst") == ["r", "volume_z"]
    assert features.arm(names, "current_dfa_hurst") == ["r", "volume_z", "hurst_dfa1_64", "hurst_regime"]
    assert features.arm(names, "robust_hurst_regime") == ["r", "volume_z", "hurst_robust_median"]
    assert features.ablated(names, "no_hurst_with_meta") == (["r", "volume_z"], True)
    assert features.ablated(names, "legacy_hurst_no_meta") == (["r", "volume_z", "hurst_rs_single_scale_legacy_64"], False)
    assert len(features.ablated(names, "dfa_hurst_no_meta")[0]) == 5
    with pytest.raises(ValueError):
        features.arm(names, "other")


def test_labels_timing(spark):
    opens = [50, 52, 51, 56, 54, 60, 63, 59, 65]
    b = bars_of(spark, [o * 1.002 for o in opens], opens=opens)
    r = labels.horizon_labels(b, 3, k=0, span=2, least=2).where("row_id = 2").collect()[0]
    assert (r.entry_row_index, r.exit_row_index, r.label_end_index, r.executable_label_end_index) == (3, 6, 5, 6)
    assert r.executable_forward_log_return == pytest.approx(math.log(63 / 56))
    assert r.decision_timestamp < r.available_timestamp == r.entry_timestamp < r.exit_timestamp
    assert r.direction_threshold == pytest.approx(math.log1p(8 / 1e4)) and r.threshold_bps == pytest.approx(8)
    covered = labels.horizon_labels(b.withColumn("cover", F.col("row_id") / 10.0), 1, span=2, least=2, coverage="cover", least_coverage=0.4).where("is_modeling_eligible")
    assert [x.row_id for x in covered.orderBy("row_id").collect()] == [4, 5, 6]
    assert labels.with_aliases(labels.all_horizons(b)).columns[-1] == "target_policy_id"


def test_audit_categories(spark):
    n = 140
    closes = [100.0 + (i % 2) * 0.1 for i in range(n)]
    closes[70] = 112.0
    volumes = [100.0] * n
    volumes[75] = 320.0  # 3.2 times the median of 63 rows
    volumes[80] = 0.0
    days = [str(d.date()) for d in pd.bdate_range("2021-03-01", periods=n + 9)]
    days = days[:20] + days[23:]  # three weekdays in a row are missing, so the gap is 6 days or less
    days = days[:40] + days[46:]  # and six more
    days[n - 1] = str((pd.Timestamp(days[n - 2]) + pd.offsets.Week(weekday=5)).date())  # a Saturday
    found = audit.suspicious(bars_of(spark, closes, volumes, days=days[:n])).collect()
    rows = {}
    for r in found:
        rows.setdefault(r.issue_type, []).append(r.row_id)
    absent = set(map(str, pd.bdate_range(days[0], days[n - 1]).date)) - set(days[:n])
    assert rows.pop("potential_missing_weekday") == [None] * len(absent) and len(absent) >= 9
    assert {k: sorted(v) for k, v in rows.items() if k not in ("outlier_return_robust_z", "volume_regime_ratio")} == {"flash_move_log_return": [70, 71], "zero_volume": [80], "weekend_row": [139], "long_calendar_gap_days": sorted(rows["long_calendar_gap_days"])}
    assert set(rows["outlier_return_robust_z"]) == {70, 71} and sorted(rows["volume_regime_ratio"]) == [75, 80]
    value = next(r.value for r in found if r.issue_type == "volume_regime_ratio" and r.row_id == 75)
    assert value == pytest.approx(3.2)
    tripled = bars_of(spark, [100.0] * 200, [10.0] * 63 + [60.0] * 137)
    shift = sorted(r.row_id for r in audit.suspicious(tripled).where("issue_type = 'volume_scale_shift_ratio'").collect())
    # row 94 is the first whose 63 rows are half new; 63 rows on, the older median is as high; the first ratio needs 126 rows
    assert shift == list(range(125, 157))
    assert all(r.robust_z == 0 for r in audit.inspected(bars_of(spark, [100.0] * 80)).select("robust_z").where("robust_z is not null").collect())
    year = audit.yearly(bars_of(spark, [100.0 + i for i in range(30)]), 10).collect()[0]
    assert (year.unclassified_rows, year.bull_rows, year.bear_rows) == (10, 20, 0)


def test_asof_takes_the_latest_available_row(spark):
    t = lambda d: pd.Timestamp(f"2022-05-{d:02d}", tz="UTC")
    d = spark.createDataFrame(pd.DataFrame({"decision_timestamp": [t(2), t(6), t(9), t(11)]}))
    s = spark.createDataFrame(pd.DataFrame({"observed_at": [t(2), t(7)], "available_at": [t(5), t(9)], "x": [0.4, -0.7]}))
    rows = asof.backward_asof(d, s, ["x"]).orderBy("decision_timestamp").collect()
    assert [r.x for r in rows] == [None, 0.4, -0.7, -0.7]
    assert [r.staleness_seconds for r in rows] == [None, 86400, 0, 2 * 86400]
    stale = asof.backward_asof(d, s, ["x"], max_staleness_seconds=7200).orderBy("decision_timestamp").collect()
    assert [(r.x, r.is_stale) for r in stale] == [(None, False), (None, True), (-0.7, False), (None, True)]
    with pytest.raises(B.ContractError):
        asof.backward_asof(d.withColumn("decision_timestamp", F.col("decision_timestamp").cast("timestamp_ntz")), s, ["x"])
    with pytest.raises(B.ContractError):
        asof.backward_asof(d, s.withColumn("observed_at", F.col("available_at") + F.expr("interval 1 day")), ["x"])


def first_boundary(rows, ends, least, gap):
    """By brute force: the first position that leaves enough training rows."""
    return next(p for p in range(least, len(rows)) if sum(ends[j] < rows[p] and j < p - gap for j in range(p)) >= least)


@pytest.mark.parametrize(("reach", "gap"), [(20, 3), (2, 9), (7, 0)])
def test_splits_conserve_rows(spark, reach, gap):
    ids = [i + i // 50 for i in range(500)]  # with holes
    ends = [i + reach + (i * 7) % 5 for i in ids]
    ev = spark.createDataFrame([("S", i, e) for i, e in zip(ids, ends, strict=True)], "symbol string, row_id long, label_end_index long")
    folds = splits.walk_forward(ev, 4, 150, gap).cache()
    for r in splits.fold_counts(folds).collect():
        assert r.n_raw == r.n_train + r.n_purged + r.n_embargoed and r.n_train >= 150
    start = folds.where("role = 'validation'").agg(F.min("row_id")).collect()[0][0]
    assert start == ids[first_boundary(ids, ends, 150, gap)]
    assert splits.fold_overlaps(folds).count() == 0 and splits.assert_folds(folds, least_train=150) is folds
    spoiled = folds.withColumn("role", F.when(F.col("role") == "purged", "train").otherwise(F.col("role")))
    with pytest.raises(B.ContractError):
        splits.assert_folds(spoiled)
    with pytest.raises(B.ContractError):
        splits.assert_folds(folds, ev.select("symbol", "row_id", F.lit(1).alias("y")))
    assert splits.walk_forward(ev, 4, 150, gap, 400).count() == 0
    cpcv = splits.cpcv(ev, 6, 2, 4).cache()
    assert cpcv.select("split_id").distinct().count() == 15
    assert splits.fold_overlaps(cpcv, ("symbol", "split_id")).count() == 0
    got = {r.row_id for r in cpcv.where("test_groups = '1|3' and role = 'embargoed'").collect()}
    groups = np.array_split(np.arange(500), 6)
    after = [min(p for p in range(500) if ids[p] > max(ends[j] for j in groups[g])) for g in (1, 3)]
    want = {ids[p] for a in after for p in range(a, a + 4)} - {r.row_id for r in cpcv.where("test_groups = '1|3' and role in ('purged', 'validation')").collect()}
    assert got == want
    assert splits.fractional_boundary(200, 0.2, 100) == 160 and splits.boundary_at(ev.withColumn("date", F.expr("timestamp_ntz'2021-01-01' + make_dt_interval(cast(row_id as int))")), "2021-01-11") == 10


def test_intervals_that_overlap(spark):
    ev = spark.range(600).select(F.lit("S").alias("symbol"), F.col("id").alias("row_id"), (F.col("id") + 20).alias("label_end_index"))
    ref = ev.where("row_id in (100, 101, 300)")
    hit = splits.overlapping(ev, ref, ["symbol"]).count()
    assert hit == sum(any(i <= j + 20 and i + 20 >= j for j in (100, 101, 300)) for i in range(600))
    assert hit + splits.overlapping(ev, ref, ["symbol"], anti=True).count() == 600


def test_manifests_change_with_their_folds(spark):
    ev = spark.range(900).select(F.lit("S").alias("symbol"), F.col("id").alias("row_id"), (F.col("id") + 4).alias("label_end_index"))
    outer, inner = splits.walk_forward(ev, 3, 300), splits.nested(ev, 3, 2, 300, 100)
    made = splits.canonical_manifest(outer, inner, 4)
    from tidemark.plans.governance import digest

    assert made["inner_fold_count_per_outer"] == [2, 2, 2] and made["outer_folds"][0]["outer"]["n_train"] == 300
    assert digest(made) == digest(splits.canonical_manifest(outer, inner, 4)) != digest(splits.canonical_manifest(outer, inner, 5))
    hashes = lambda f: {r.fold_id: r.rows_sha256 for r in splits.manifest(f, ["symbol", "fold_id"]).collect()}
    moved = outer.withColumn("label_end_index", F.when(F.col("row_id") == 650, 655).otherwise(F.col("label_end_index")))
    a, b = hashes(outer), hashes(moved)
    assert a[1] == b[1] and a[3] != b[3]
    assert splits.uncontained(ev, 3, 2, 300, 100).agg(F.sum("n_outside")).collect()[0][0] == 0


def trades_frame(spark, h, rows):
    return spark.createDataFrame([("S", h, r, p, r + 1, r + 1 + h) for r, p in rows], "symbol string, horizon int, row_id long, p double, entry_row_index long, exit_row_index long")


def test_greedy_rules(spark):
    f = trades_frame(spark, 4, [(r, 0.8) for r in (1, 3, 5, 6, 9, 30)])
    assert sorted(r.row_id for r in schedule.by_rows(f, KEYS).collect()) == [1, 5, 9, 30]
    g = trades_frame(spark, 3, [(20, 0.3), (21, 0.9), (24, 0.7), (25, 0.1), (27, 0.5)])
    assert sorted((r.row_id, r.signal) for r in schedule.one_position(g, KEYS).collect()) == [(20, -1), (24, 1)]
    assert sorted((r.row_id, r.signal) for r in schedule.one_position(g.where("row_id <> 20"), KEYS).collect()) == [(21, 1), (24, 1)]
    assert schedule.one_position(g.withColumn("p", F.lit(0.55)), KEYS).count() == 0
    assert sorted(r.row_id for r in schedule.one_position(g, KEYS, rejected_extend=True).collect()) == [20, 24]
    assert schedule.walk([0, 1, 4], [5, 9, 9], True) == [True, False, False] and schedule.walk([0, 1, 5], [5, 9, 9], False) == [True, False, True]


def test_reconciliation_finds_each_fault(spark):
    t = lambda d: pd.Timestamp(f"2023-02-{d:02d}")
    expected = spark.createDataFrame(pd.DataFrame([(f"s{i}", 1, t(i + 1), t(i + 2)) for i in range(8)] + [("idle", 0, t(20), t(21))], columns=["signal_id", "signal", "entry_timestamp", "exit_timestamp"]))
    rows = [[f"s{i}", 1, t(i + 1), t(i + 2), 10.0, 11.0, 1.0, 0.5, f"o{i}", f"d{i}"] for i in range(8)]
    names = ["signal_id", "direction", "entry_timestamp", "exit_timestamp", "entry_price", "exit_price", "spread_bps", "commission", "order_id", "deal_id"]
    judged = lambda rows: schedule.reconcile(expected, spark.createDataFrame(pd.DataFrame(rows, columns=names))).collect()[0].asDict()
    assert judged(rows)["verdict"] == "PASS" and judged(rows)["matched"] == 8
    rows[0][1], rows[1][3], rows[2][4], rows[3][6], rows[4][8], rows[5][9], rows[6][7] = -1, t(1), 0.0, -2.0, "", "d4", float("nan")
    rows[7][0] = "other"
    rows.append([*rows[0][:8], "o9", "d9"])
    assert judged(rows) == {"matched": 8, "missing": 1, "unexpected": 1, "repeated": 2, "wrong_direction": 2, "wrong_time": 1, "bad_exit": 1, "bad_price": 1, "bad_cost": 2, "bad_ticket": 1, "repeated_order_id": 0, "repeated_deal_id": 1, "verdict": "FAIL"}


def test_metrics_literals(spark):
    df = spark.createDataFrame([("S", p, y) for p, y in ((0.05, 0), (0.3, 0), (0.7, 1), (0.95, 1))], "symbol string, p double, y int")
    r = metrics.classification(df, ["symbol"]).collect()[0]
    assert r.ece_weighted == pytest.approx(0.175) and r.roc_auc == 1.0 and r.balanced_accuracy == 1.0
    assert metrics.best_threshold(df, ["symbol"]).collect()[0].threshold == 0.5  # all thresholds are as good: one half comes first
    assert [x.accepted for x in metrics.accepted(metrics.rates(df.groupBy("symbol").agg(F.count("*").alias("n"), *metrics.confusion(F.lit(0.5)))), samples=4).collect()] == [True]
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.3 + 0.5 * x)))).astype(int)
    line = metrics.calibration_line(spark.createDataFrame(pd.DataFrame({"symbol": "S", "p": 1 / (1 + np.exp(-x)), "y": y})), ["symbol"]).collect()[0]
    assert line.intercept == pytest.approx(0.3, abs=0.15) and line.slope == pytest.approx(0.5, abs=0.15)
    signed = multiplicity.trial_sharpes(spark.createDataFrame([(1, 0.1), (1, 0.1), (2, -0.1), (2, -0.1), (3, 0.0), (3, 0.0), (4, 0.1), (4, 0.3)], "trial_id int, ret double"))
    assert {r.trial_id: (r.annualised, r.signed) for r in signed.collect() if r.trial_id < 4} == {1: (0.0, math.inf), 2: (0.0, -math.inf), 3: (0.0, 0.0)}
    assert multiplicity.deflated_sharpe(0.2, 200, 0, 3, 50) < multiplicity.deflated_sharpe(0.2, 200, 0, 3, 2)
    assert multiplicity.expected_maximum(0.0, 1.0, 1) == 0.0 < multiplicity.expected_maximum(0.0, 1.0, 10)


def evidence(spark, **changes):
    fold = [{"fold_id": f"wf_{i}", "n": 100, "balanced_accuracy": b, "macro_f1": 0.6, "recall_down": 0.6, "recall_up": 0.6, "material": True} for i, b in enumerate((0.5, 0.6, 0.6, 0.65, 0.7))]
    row = {
        "folds": fold, "pooled_balanced_accuracy": 0.61, "pooled_macro_f1": 0.55, "pooled_recall_down": 0.5, "pooled_recall_up": 0.5, "ci_low": 0.5001, "sensitivity_lows": {"5": 0.51},
        "candidate_brier": 0.2549, "baseline_brier": 0.25, "candidate_ece": 0.06, "baseline_ece": 0.05, "intercept": 0.0, "slope": 1.0, "classification_deltas": {"constant": 0.0},
        "paired_low": 0.0, "net": 0.01, "stress_net": 0.001, "economic_deltas": dict.fromkeys(promotion.BENCHMARKS, 0.0), "trades": 30, "registry_complete": True, "pbo": 0.2, "dsr": 0.95, "qa_flags": dict.fromkeys(promotion.QA_FLAGS, True),
    } | changes
    got = promotion.promotion(spark.createDataFrame([row], promotion.EVIDENCE)).collect()[0]
    assert got.promoted == (got.failed_checks == "")
    return got.failed_checks


def test_every_check_of_the_gate_can_fail(spark):
    assert len(promotion.checks()) == 30 and evidence(spark) == ""
    fold = {"fold_id": "x", "n": 100, "balanced_accuracy": 0.7, "macro_f1": 0.6, "recall_down": 0.6, "recall_up": 0.6, "material": True}
    folds = lambda **c: [fold | {"fold_id": f"f{i}"} | (c if i == 0 else {}) for i in range(5)]
    cases = {
        "exact_outer_fold_count|all_outer_folds_material": {"folds": folds()[:4]},
        "unique_outer_fold_ids": {"folds": folds(fold_id="f1")},
        "outer_metrics_finite": {"folds": folds(macro_f1=float("nan"))},
        "outer_samples_positive": {"folds": folds(n=0)},
        "all_outer_folds_material": {"folds": folds(material=False)},
        "median_balanced_accuracy": {"folds": [f | {"balanced_accuracy": 0.59} for f in folds()]},
        "median_balanced_accuracy|four_of_five_at_055": {"folds": [f | {"balanced_accuracy": 0.54} for f in folds()]},
        "no_material_fold_below_chance": {"folds": folds(balanced_accuracy=0.49)},
        "pooled_metrics_finite": {"pooled_balanced_accuracy": None},
        "pooled_macro_f1": {"pooled_macro_f1": 0.549},
        "pooled_recall_down": {"pooled_recall_down": 0.499},
        "pooled_recall_up": {"pooled_recall_up": 0.499},
        "primary_ci_excludes_chance": {"ci_low": 0.5},
        "ci_sensitivity_excludes_chance": {"sensitivity_lows": {"5": 0.51, "20": 0.5}},
        "calibration_reported": {"slope": None},
        "brier_noninferiority": {"candidate_brier": 0.2551},
        "ece_noninferiority": {"candidate_ece": 0.0601},
        "classification_baselines_present|classification_baseline_noninferiority": {"classification_deltas": {}},
        "classification_baseline_noninferiority": {"classification_deltas": {"a": 0.1, "b": -0.001}},
        "paired_return_ci_nonnegative": {"paired_low": -1e-9},
        "baseline_cost_net_positive": {"net": 0.0},
        "stress_cost_net_positive": {"stress_net": 0.0},
        "economic_benchmarks_present|economic_benchmark_noninferiority": {"economic_deltas": {"cash": 0.0}},
        "economic_benchmark_noninferiority": {"economic_deltas": dict.fromkeys(promotion.BENCHMARKS, 0.0) | {"trend": -0.1}},
        "minimum_trade_count": {"trades": 29},
        "trial_return_registry_complete|pbo_evaluable_and_passes|dsr_evaluable_and_passes": {"registry_complete": False},
        "pbo_evaluable_and_passes": {"pbo": None},
        "dsr_evaluable_and_passes": {"dsr": 0.949},
        "required_qa_flags_present|all_qa_flags_pass": {"qa_flags": {"leakage_free": True}},
        "all_qa_flags_pass": {"qa_flags": dict.fromkeys(promotion.QA_FLAGS, True) | {"further": False}},
    }
    for wanted, changes in cases.items():
        assert evidence(spark, **changes) == wanted
    named = {n for k in cases for n in k.split("|")}
    assert named == set(promotion.checks())


def test_joint_bootstrap_draws_whole_blocks(spark):
    rng = np.random.default_rng(8)
    n = 60
    rows = [("S", 1, i, int(rng.random() < 0.5), float(rng.random()), float(rng.normal()), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, horizon int, row_id long, y int, p double, candidate double, benchmark double")
    got = {(r.block, r.iter): r for r in multiplicity.joint_bootstrap(df, KEYS, (1, 7), 20).collect()}
    assert len(got) == 40
    for (block, it), r in got.items():
        at = []
        for k in range(-(-n // block)):
            a = ((it * 7919 + k * 104729 + block * 1299709 + 42) * 48271) % 2147483647 % (n - block + 1)
            at += range(a, a + min(block, n - k * block))
        y, p, c, b = (np.array([rows[i][j] for i in at]) for j in (3, 4, 5, 6))
        hit = p >= 0.5
        assert r.recall_up == pytest.approx(hit[y == 1].mean()) and r.recall_down == pytest.approx((~hit[y == 0]).mean())
        assert r.brier_score == pytest.approx(((p - y) ** 2).mean()) and r.paired_mean_net_return == pytest.approx((c - b).mean())
        bins = np.minimum((p * 10).astype(int), 9)
        assert r.expected_calibration_error == pytest.approx(sum(abs((y - p)[bins == i].sum()) for i in range(10)) / n)
    assert multiplicity.joint_bootstrap(df.withColumn("y", F.lit(1)), KEYS, (5,), 10).count() == 0
    assert multiplicity.joint_bootstrap(df.limit(19), KEYS, (5,), 10).count() == 0


def test_trials_align_on_finite_rows(spark):
    rows = [(t, r, float(r)) for t in (1, 2) for r in range(40) if (t, r) != (2, 5)] + [(1, 50, 1.0)]
    df = spark.createDataFrame(rows, "trial_id int, row_id int, ret double").withColumn("ret", F.when(F.expr("trial_id = 1 and row_id = 6"), float("nan")).otherwise(F.col("ret")))
    assert multiplicity.align(df).count() == 2 * 38
    assert multiplicity.align(df.where("row_id < 21")).count() == 0


@pytest.mark.parametrize("name", ["ohlcv_bars", "feat_momentum_drawdown", "feat_ewm", "feat_regimes", "labels_all_horizons", "audit_suspicious", "asof_staleness", "cpcv_manifest", "classification_metrics", "return_ledger", "benchmark_summaries", "reconciliation_of_faults", "signal_replay", "pbo_cscv"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = con.execute(SQL[name])
    names = [d[0] for d in rows.description]
    want = sorted(map(repr, ([dict(zip(names, r))[c] for c in sorted(names)] for r in rows.fetchall())))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want
