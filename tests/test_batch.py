"""The research pipeline and the preregistered batch, from bars to receipts."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import batch, config, governance
from tidemark.sources import bars as B


@pytest.fixture(scope="module")
def small(spark):
    return B.synthetic(spark, 700, 3).cache()


SETTINGS = {
    "data": {"boundary": "2016-04-01"},
    "labels": {"horizons": [5]},
    "splits": {"folds": 2, "inner_folds": 2, "least_train": 200, "least_validation": 30},
    "models": {"candidates": ["logistic"], "fast": True},
}


def test_a_run_leaves_its_artifacts(spark, small, tmp_path, monkeypatch):
    whole = batch.learning_table
    monkeypatch.setattr(batch, "learning_table", lambda b, c: (whole(b, c)[0], [n for n in whole(b, c)[1] if n.startswith(("return_lag", "drawdown"))]))  # fewer features, same steps
    made = config.made(config.Config, SETTINGS)
    run = batch.run_pipeline(spark, small, made, str(tmp_path), "a" * 64, {"m": "1"})
    names = {p.name for p in run.iterdir() if not p.name.startswith(".")}
    assert {"yearly.csv", "suspicious.csv", "quality.csv", "locked_metrics_h5.csv", "benchmarks_h5.csv", "folds_h5.csv", "model_h5", "features.json", "manifest.json", "receipt.json"} <= names
    steps = json.loads((run / "manifest.json").read_text())["steps"]
    assert steps[0]["candidate"] == "logistic" and steps[0]["rows_out"] > 80
    assert spark.read.option("header", True).csv(f"{run}/benchmarks_h5.csv").count() == 8
    with pytest.raises(governance.BrokenRule):
        batch.run_pipeline(spark, small, made, str(tmp_path), "a" * 64, {"m": "1"})
    with pytest.raises(B.ContractError):
        batch.run_pipeline(spark, small.withColumn("close", -F.col("close")), made, str(tmp_path), "b" * 64, {"m": "1"})
    failed = list(tmp_path.glob("*.failed.json"))
    assert len(failed) == 1 and json.loads(failed[0].read_text())["kind"] == "ContractError"


def test_a_family_is_judged_together(spark, small, tmp_path, monkeypatch):
    whole = batch.learning_table

    def few(bars, settings):
        rows, names = whole(bars, settings)
        return rows, [n for n in names if n in ("return_lag_1", "momentum_20", "hurst_robust_median", "volatility_zscore")]

    monkeypatch.setattr(batch, "learning_table", few)  # fewer features, same steps
    made, code = config.made(config.Config, SETTINGS), {"m.py": "1" * 64}
    members = [{"experiment_id": f"{arm}@5", "family": "f", "phase": "development", "horizon": 5, "config_sha256": "a" * 64, "data_sha256": "b" * 64, "code_sha256": governance.digest(code)} for arm in ("no_hurst", "robust_hurst_regime")]
    bundle = governance.freeze_family(tmp_path, "f", members, code)
    governance.verify_bundle(bundle, "b" * 64, "a" * 64, code)
    registry = governance.Registry(tmp_path / "r.jsonl", family_budget=2)
    got = batch.run_batch(spark, small, made, bundle, registry, {"leakage_free": True}, f"{tmp_path}/work", 300, 100, 40).collect()
    assert sorted(r.experiment_id for r in got) == ["no_hurst@5", "robust_hurst_regime@5"] and len(registry.records()) == 2
    for r in got:
        failed = r.failed_checks.split("|")
        assert not r.promoted and "exact_outer_fold_count" in failed and "required_qa_flags_present" in failed
        assert "trial_return_registry_complete" not in failed and "calibration_reported" not in failed and r.pbo is not None
