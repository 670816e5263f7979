"""Promotion gate: thirty mandatory checks over one row of evidence for each candidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags and benchmarks that the evidence must hold (fixed values).
QA_FLAGS = ["leakage_free", "audit_isolated", "provenance_complete", "reproducible", "manifest_verified"]
BENCHMARKS = ["cash", "always_long", "always_short", "momentum", "trend"]


@dataclass(frozen=True)
class Criteria:
    """Thresholds of the gate (fixed values)."""

    folds: int = 5
    median_accuracy: float = 0.60
    folds_at_055: int = 4
    fold_accuracy: float = 0.50
    macro_f1: float = 0.55
    recall: float = 0.50
    chance: float = 0.50
    brier_increase: float = 0.005
    ece_increase: float = 0.01
    trades: int = 30
    pbo: float = 0.20
    dsr: float = 0.95


#: Columns of the evidence.
EVIDENCE = """folds array<struct<fold_id: string, n: long, balanced_accuracy: double, macro_f1: double, recall_down: double, recall_up: double, material: boolean>>,
pooled_balanced_accuracy double, pooled_macro_f1 double, pooled_recall_down double, pooled_recall_up double, ci_low double, sensitivity_lows map<string, double>,
candidate_brier double, baseline_brier double, candidate_ece double, baseline_ece double, intercept double, slope double, classification_deltas map<string, double>,
paired_low double, net double, stress_net double, economic_deltas map<string, double>, trades long, registry_complete boolean, pbo double, dsr double, qa_flags map<string, boolean>"""


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def checks(c: Criteria = Criteria()) -> dict[str, Column]:
    """The checks by name, in order; a missing figure fails every check that needs it."""
    col = F.col
    folds, material = col("folds"), F.filter("folds", lambda f: f["material"])
    every = lambda xs, test: F.forall(xs, lambda x: F.coalesce(test(x), F.lit(False)))
    accuracy = F.array_sort(F.transform(folds, lambda f: f["balanced_accuracy"]))
    half = F.size(folds) / 2
    median = (F.try_element_at(accuracy, F.greatest(F.lit(1), F.ceil(half).cast("int"))) + F.try_element_at(accuracy, (F.floor(half) + 1).cast("int"))) / 2
    of = lambda name: F.map_values(col(name))
    held = lambda name, wanted: F.forall(F.array(*map(F.lit, wanted)), lambda k: F.coalesce(F.map_contains_key(name, k), F.lit(False)))
    economic, qa = held("economic_deltas", BENCHMARKS), held("qa_flags", QA_FLAGS)
    pooled = [col(f"pooled_{m}") for m in ("balanced_accuracy", "macro_f1", "recall_down", "recall_up")]
    reported = [col(m) for m in ("candidate_brier", "baseline_brier", "candidate_ece", "baseline_ece", "intercept", "slope")]
    all_of = lambda cs: F.forall(F.array(*cs), finite)
    return {
        "exact_outer_fold_count": F.size(folds) == c.folds,
        "unique_outer_fold_ids": F.size(F.array_distinct(F.transform(folds, lambda f: f["fold_id"]))) == F.size(folds),
        "outer_metrics_finite": every(folds, lambda f: finite(f["balanced_accuracy"]) & finite(f["macro_f1"]) & finite(f["recall_down"]) & finite(f["recall_up"])),
        "outer_samples_positive": every(folds, lambda f: f["n"] > 0),
        "all_outer_folds_material": F.size(material) == c.folds,
        "median_balanced_accuracy": median >= c.median_accuracy,
        "four_of_five_at_055": F.size(F.filter(folds, lambda f: f["balanced_accuracy"] >= 0.55)) >= c.folds_at_055,
        "no_material_fold_below_chance": (F.size(material) > 0) & every(material, lambda f: f["balanced_accuracy"] >= c.fold_accuracy),
        "pooled_metrics_finite": all_of(pooled),
        "pooled_macro_f1": pooled[1] >= c.macro_f1,
        "pooled_recall_down": pooled[2] >= c.recall,
        "pooled_recall_up": pooled[3] >= c.recall,
        "primary_ci_excludes_chance": col("ci_low") > c.chance,
        "ci_sensitivity_excludes_chance": (F.size(of("sensitivity_lows")) > 0) & every(of("sensitivity_lows"), lambda x: x > c.chance),
        "calibration_reported": all_of(reported),
        "brier_noninferiority": col("candidate_brier") - col("baseline_brier") <= c.brier_increase,
        "ece_noninferiority": col("candidate_ece") - col("baseline_ece") <= c.ece_increase,
        "classification_baselines_present": F.size(of("classification_deltas")) > 0,
        "classification_baseline_noninferiority": (F.size(of("classification_deltas")) > 0) & every(of("classification_deltas"), lambda x: finite(x) & (x >= 0)),
        "paired_return_ci_nonnegative": col("paired_low") >= 0,
        "baseline_cost_net_positive": col("net") > 0,
        "stress_cost_net_positive": col("stress_net") > 0,
        "economic_benchmarks_present": economic,
        "economic_benchmark_noninferiority": economic & every(of("economic_deltas"), finite) & F.forall(F.array(*map(F.lit, BENCHMARKS)), lambda k: F.coalesce(F.try_element_at(col("economic_deltas"), k) >= 0, F.lit(False))),
        "minimum_trade_count": col("trades") >= c.trades,
        "trial_return_registry_complete": col("registry_complete"),
        "pbo_evaluable_and_passes": col("registry_complete") & finite(col("pbo")) & (col("pbo") <= c.pbo),
        "dsr_evaluable_and_passes": col("registry_complete") & finite(col("dsr")) & (col("dsr") >= c.dsr),
        "required_qa_flags_present": qa,
        "all_qa_flags_pass": qa & every(of("qa_flags"), lambda x: x),
    }


def promotion(evidence: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """``evidence`` with the names of failed checks in order and the decision."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks(criteria).items()]))
    return evidence.withColumn("failed_checks", F.array_join(failed, "|")).withColumn("promoted", F.size(failed) == 0)
