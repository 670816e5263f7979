"""From bars to artifacts: the research pipeline, and a preregistered batch of trials.

Reports are small tables (a row for each horizon, fold or strategy); they are written into a staging folder of the driver's
file system, which gets its receipt and its final name when the run is complete.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, features, labels, metrics, models, multiplicity, promotion, schedule, splits
from ..operators.labels import bps
from ..sources import bars as B
from . import governance
from .config import Config

KEYS = ["symbol", "horizon"]


def learning_table(bars: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """Eligible rows of every horizon with all features, y and what a ledger needs; and the features' names."""
    wide = features.matrix(bars)
    names = [c for c in wide.columns if c not in ("symbol", "row_id", "date", *B.PRICES, "volume", "lp", "lv", "r", "feature_coverage")]
    known = wide.select("symbol", "row_id", F.col("feature_coverage").alias("coverage"), "r", *names)
    made = labels.all_horizons(bars, tuple(config.labels.horizons), k=config.labels.threshold_k, cost_bps=config.labels.cost_bps, slip_bps=config.labels.slippage_bps)
    keep = ["symbol", "horizon", "row_id", "date", "entry_row_index", "exit_row_index", "entry_timestamp", "exit_timestamp", "executable_forward_log_return", F.col("executable_label_end_index").alias("label_end_index"), F.col("executable_direction_binary").alias("y")]
    rows = made.where("is_modeling_eligible").select(*keep).join(known, ["symbol", "row_id"]).where(F.col("coverage") >= config.labels.least_coverage)
    return rows, names


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table of its own, so that later plans start there."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def one_horizon(rows: DataFrame, names: list[str], config: Config, h: int, boundary: int, staging: str) -> dict:
    """Folds, candidates, selection and the locked test of one horizon; the facts of its manifest."""
    own = rows.where(F.col("horizon") == h)
    roles = splits.locked(own, boundary).cache()
    development, locked = roles.where("role = 'development'").drop("role"), roles.where("role = 'locked'").drop("role")
    folds = splits.walk_forward(development.select("symbol", "row_id", "label_end_index"), config.splits.folds, config.splits.least_train, config.splits.gap, config.splits.least_validation).cache()
    splits.assert_folds(folds, development.select("symbol", "row_id", "y"), least_train=config.splits.least_train, least_validation=config.splits.least_validation)
    oof = {c: written(models.out_of_fold(development, folds, names, c, fast=config.models.fast).select(*KEYS, "row_id", "fold_id", "y", "p"), f"{staging}/oof_h{h}/{c}") for c in config.models.candidates}
    every = None
    for c, df in oof.items():
        part = df.withColumn("candidate", F.lit(c))
        every = part if every is None else every.unionByName(part)
    chosen = models.selected(every, KEYS).collect()[0]
    model = models.fit(development, names, chosen.candidate, config.models.seed, config.models.fast)
    model.save(f"{staging}/model_h{h}")
    scored = model.predict(locked).cache()
    found = metrics.accepted(metrics.classification(scored, KEYS, chosen.threshold))
    B.write_csv(found, f"{staging}/locked_metrics_h{h}.csv")
    B.write_csv(schedule.benchmarks(scored, KEYS), f"{staging}/benchmarks_h{h}.csv")
    B.write_csv(splits.manifest(folds, ["symbol", "fold_id"]), f"{staging}/folds_h{h}.csv")
    r = found.collect()[0]
    return {"horizon": h, "candidate": chosen.candidate, "threshold": chosen.threshold, "rows_in": own.count(), "rows_out": r.n, "balanced_accuracy": round(r.balanced_accuracy, 12), "accepted": r.accepted}


def run_pipeline(spark: SparkSession, bars: DataFrame, config: Config, folder: str, source_sha256: str, code: dict[str, str]) -> Path:
    """The whole run of one symbol: validation, audit, features, labels, folds, candidates, locked test, reports; returns its folder.

    A run of the same data, configuration, code and runtime has the same name and is refused; a failed one leaves a receipt.
    """
    from dataclasses import asdict

    facts = asdict(config)
    run_id = governance.run_identity(source_sha256, facts, code, governance.runtime())
    final, staging = Path(folder) / run_id, Path(folder) / f".{run_id}"
    if final.exists():
        raise governance.BrokenRule("the run exists")
    staging.mkdir(parents=True)
    try:
        checked = B.validate(bars, config.data.least_rows).cache()
        for name, report in {"yearly": audit.yearly(checked), "suspicious": audit.suspicious(checked), "quality": audit.summary(checked)}.items():
            B.write_csv(report, f"{staging}/{name}.csv")
        rows, names = learning_table(checked, config)
        rows = written(rows, f"{staging}/dataset")
        boundary = splits.boundary_at(checked, config.data.boundary)
        steps = [one_horizon(rows, names, config, h, boundary, str(staging)) for h in config.labels.horizons]
        B.write_json(staging / "features.json", governance.feature_registry({"base": names}))
        B.write_json(staging / "manifest.json", governance.execution_manifest(run_id, steps, {"source": source_sha256}))
        governance.finalize(staging, final, run_id=run_id, config=facts)
    except Exception as error:
        if staging.exists():
            staging.rename(staging.with_name(f"{staging.name}.failed"))
        governance.failed(folder, run_id, error)
        raise
    return final


def trial_evidence(predictions: DataFrame, trials: DataFrame, trial_id: str, complete: bool, flags: dict[str, bool], blocks=(5, 10, 20), rounds: int = 400) -> DataFrame:
    """The gate's row of evidence of one trial from its outer predictions (margin and p of each row) and all trials' returns."""
    margin = predictions.agg(F.max("margin")).collect()[0][0]
    book = schedule.ledger(predictions, KEYS, margin).select(*KEYS, "row_id", "active", "candidate", F.col("always_long").alias("benchmark"), *promotion.BENCHMARKS)
    s = predictions.join(book, [*KEYS, "row_id"]).cache()
    fold = F.struct(F.concat(F.lit("wf_"), F.col("outer_fold")).alias("fold_id"), "n", "balanced_accuracy", "macro_f1", "recall_down", "recall_up", (F.col("n") >= 30).alias("material"))
    folds = metrics.rates(s.groupBy(*KEYS, "outer_fold").agg(F.count("*").alias("n"), *metrics.confusion(F.lit(0.5)))).groupBy(*KEYS).agg(F.sort_array(F.collect_list(fold)).alias("folds"))
    pooled = metrics.classification(s, KEYS).select(*KEYS, *[F.col(c).alias(f"pooled_{c}") for c in ("balanced_accuracy", "macro_f1", "recall_down", "recall_up")], F.col("brier").alias("candidate_brier"), F.col("ece_unweighted").alias("candidate_ece"))
    base = metrics.classification(s.withColumn("p", F.col("baseline_p")), KEYS).select(*KEYS, F.col("brier").alias("baseline_brier"), F.col("ece_unweighted").alias("baseline_ece"), F.col("balanced_accuracy").alias("base_ba"))
    ci = multiplicity.joint_intervals(multiplicity.joint_bootstrap(s, KEYS, blocks, rounds), KEYS)
    pick = lambda c, b: F.max(F.when((F.col("statistic") == c) & (F.col("block") == b), F.col("low")))
    lows = ci.groupBy(*KEYS).agg(pick("balanced_accuracy", blocks[1]).alias("ci_low"), pick("paired_mean_net_return", blocks[1]).alias("paired_low"), *[pick("balanced_accuracy", b).alias(f"low_{b}") for b in (blocks[0], blocks[2])])
    net = s.groupBy(*KEYS).agg(F.count_if("active").alias("trades"), F.sum("candidate").alias("total"), *[F.sum(b).alias(f"of_{b}") for b in promotion.BENCHMARKS])
    dsr = dict(multiplicity.deflated(trials)).get(trial_id)
    pbo = multiplicity.pbo_summary(multiplicity.align(trials)).select("pbo")
    e = folds.join(pooled, KEYS).join(base, KEYS).join(lows, KEYS, "left").join(net, KEYS).join(metrics.calibration_line(s, KEYS), KEYS).join(F.broadcast(pbo))
    return e.withColumns({
        "sensitivity_lows": F.create_map(*[x for b in (blocks[0], blocks[2]) for x in (F.lit(str(b)), F.col(f"low_{b}"))]),
        "classification_deltas": F.create_map(F.lit("prevalence"), F.col("pooled_balanced_accuracy") - F.col("base_ba")),
        "net": F.expm1("total"), "stress_net": F.expm1(F.col("total") - F.col("trades") * (bps(10.0) - bps(5.0))),
        "economic_deltas": F.create_map(*[x for b in promotion.BENCHMARKS for x in (F.lit(b), F.col("total") - F.col(f"of_{b}"))]),
        "registry_complete": F.lit(complete), "dsr": F.lit(dsr).cast("double"), "qa_flags": F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), F.lit(v))]),
    })


def run_batch(spark: SparkSession, bars: DataFrame, config: Config, bundle: dict, registry: governance.Registry, flags: dict[str, bool], folder: str, least_outer: int = 800, least_inner: int = 300, rounds: int = 400) -> DataFrame:
    """One row of decision for each preregistered trial (an arm at a horizon) of a verified family.

    Every trial is registered before any is judged, and all are judged together: the gate sees the overfitting probability and the
    deflated ratio over the whole family.  The table, the predictions and the returns are written below ``folder``.  Members name their arm as the part of experiment_id before ``@``.
    """
    rows, names = learning_table(bars, config)
    rows = written(rows, f"{folder}/dataset")
    done, returns = {}, None
    for number, member in enumerate(bundle["members"]):
        arm, h = member["experiment_id"].split("@")[0], member["horizon"]
        own = rows.where(F.col("horizon") == h)
        got, choices = models.trial(own, own.select("symbol", "row_id", "label_end_index"), features.arm(names, arm), KEYS, config.splits.folds, config.splits.inner_folds, least_outer, least_inner)
        got = written(got, f"{folder}/predictions-{number}")
        done[member["experiment_id"]] = (number, got)
        margin = max(c["margin"] for c in choices)
        part = schedule.ledger(got, KEYS, margin).select(F.lit(number).alias("trial_id"), "row_id", F.col("candidate").alias("ret"))
        returns = part if returns is None else returns.unionByName(part)
        registry.append(member["experiment_id"], bundle["family"], {"choices": [{k: v for k, v in c.items() if k != "records"} for c in choices]})
    returns = written(returns, f"{folder}/returns")
    complete = {r["experiment_id"] for r in registry.records()} >= set(bundle["member_hashes"])
    out = None
    for name, (number, got) in done.items():
        e = promotion.promotion(trial_evidence(got, returns, number, complete, flags, rounds=rounds)).select(F.lit(name).alias("experiment_id"), "horizon", "pooled_balanced_accuracy", "net", "trades", "pbo", "dsr", "failed_checks", "promoted")
        out = e if out is None else out.unionByName(e)
    return out
