"""Candidates, selection, trials and the streaming replay."""

import math
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, splits
from tidemark.sources.bars import ContractError
from tidemark.streaming import replay

KEYS = ["symbol", "horizon"]


@pytest.fixture(scope="module")
def rows(spark):
    """One series whose direction follows x1; x2 is noise with gaps."""
    rng = np.random.default_rng(4)
    n = 260
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (x1 + 0.7 * rng.normal(size=n) > 0).astype(float)
    ret = np.where(y == 1, 1, -1) * np.abs(rng.normal(size=n)) * 0.01
    pdf = pd.DataFrame({"symbol": "S", "horizon": 1, "row_id": range(n), "x1": x1, "x2": x2, "y": y, "executable_forward_log_return": ret, "r": rng.normal(size=n), "momentum_20": x2, "volatility_zscore": x2})
    df = spark.createDataFrame(pdf).withColumn("x2", F.when(F.col("row_id") % 9 > 0, F.col("x2")))
    extra = {"entry_row_index": F.col("row_id") + 1, "exit_row_index": F.col("row_id") + 2, "label_end_index": F.col("row_id") + 2}
    return df.withColumns(extra).cache()


def newton(x, y, w, c):
    """Minimum of the weighted logistic loss with an L2 penalty of 1 / c on the slopes."""
    x = np.c_[x, np.ones(len(x))]
    b, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 1 / c), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * b)
    return b


def test_logistic_is_the_penalised_optimum(rows, tmp_path):
    train, test = rows.where("row_id < 200"), rows.where("row_id >= 200")
    made = models.fit(train, ["x1", "x2"])
    got = {r.row_id: r.p for r in made.predict(test).collect()}
    a, b = (f.orderBy("row_id").toPandas() for f in (train, test))
    middle = a.x2.median()

    def matrix(f):
        return np.c_[f.x1, f.x2.fillna(middle), f.x2.isna()].astype(float)

    mean, std = matrix(a).mean(axis=0), matrix(a).std(axis=0)
    ones = a.y.sum()
    w = np.where(a.y == 1, len(a) / (2 * ones), len(a) / (2 * (len(a) - ones)))
    coef = newton((matrix(a) - mean) / std, a.y.to_numpy(), w, 0.2)
    want = 1 / (1 + np.exp(-(np.c_[(matrix(b) - mean) / std, np.ones(len(b))] @ coef)))
    assert np.allclose([got[i] for i in b.row_id], want, atol=1e-5)
    made.save(f"{tmp_path}/bundle")
    again = {r.row_id: r.p for r in models.Fitted.load(f"{tmp_path}/bundle").predict(test).collect()}
    assert again == got
    with pytest.raises(ContractError):
        models.fit(train.where("y = 1"), ["x1"])


@pytest.mark.parametrize("kind", ["random_forest", "extra_trees", "boosted"])
def test_other_candidates_learn(rows, monkeypatch, kind):
    monkeypatch.setattr(models, "FAST_TREES", 10)
    monkeypatch.setattr(models, "FAST_ROUNDS", 5)
    got = models.fit_predict(rows.where("row_id < 200"), rows.where("row_id >= 200"), ["x1", "x2"], kind, fast=True).toPandas()
    assert got.p.between(0, 1).all() and ((got.p >= 0.5) == (got.y == 1)).mean() > 0.65


def test_sizes_are_the_references():
    assert (models.TREES, models.FAST_TREES, models.ROUNDS, models.FAST_ROUNDS) == (320, 80, 220, 90)


def test_calibration_looks_only_back(rows):
    scored = rows.select("row_id", "y", (1 / (1 + F.exp(-2 * F.col("x1")))).alias("p"))
    early, late = scored.where("row_id < 150"), scored.where("row_id >= 150")
    got = models.past_only_sigmoid(early, late).orderBy("row_id").toPandas()
    a = early.toPandas()
    coef = newton(a[["p"]].to_numpy(), a.y.to_numpy(), np.ones(len(a)), 1e6)
    assert np.allclose(got.p, 1 / (1 + np.exp(-(coef[0] * late.orderBy("row_id").toPandas().p + coef[1]))), atol=1e-5)
    for bad in (scored.where("row_id < 151"), early.withColumn("p", F.col("p") * 2), early.where("y = 1")):
        with pytest.raises(ContractError):
            models.past_only_sigmoid(bad, late)


def test_selection_prefers_the_steadier(spark):
    rows = []
    for fold in (1, 2, 3, 4):
        for i in range(40):
            y = i % 2
            steady = 0.7 if (y == 1) != (i % 10 == 0) else 0.3
            shaky = (0.9 if y else 0.1) if fold == 4 else (0.6 if (y == 1) == (i % 4 < 2) else 0.4)
            rows += [("S", 1, "steady", fold, float(y), steady), ("S", 1, "shaky", fold, float(y), shaky)]
    got = models.selected(spark.createDataFrame(rows, "symbol string, horizon int, candidate string, fold_id int, y double, p double"), KEYS).collect()
    assert [(r.candidate, round(r.median_ba, 3), r.std_ba) for r in got] == [("steady", 0.9, 0.0)]


def test_inner_choice_and_trial(rows):
    pooled = rows.withColumn("p", 1 / (1 + F.exp(-2 * F.col("x1"))))
    calibration, margin, records = models.inner_choice(pooled, KEYS)
    assert len(records) == 4 and {r["calibration"] for r in records} == {"none", "sigmoid"}
    best = max((r["balanced_accuracy"], r["macro_f1"], r["net"]) for r in records)
    won = next(r for r in records if (r["calibration"], r["margin"]) == (calibration, margin))
    assert (won["balanced_accuracy"], won["macro_f1"], won["net"]) == best
    events = rows.select("symbol", "row_id", "label_end_index")
    got, choices = models.trial(rows, events, ["x1", "x2"], KEYS, 2, 2, 150, 60)
    pdf = got.toPandas()
    wanted = {r.row_id for r in splits.walk_forward(events, 2, 150).where("role = 'validation'").collect()}
    assert sorted(pdf.row_id) == sorted(wanted) and len(choices) == 2
    assert pdf.p.between(0, 1).all() and pdf.groupby("outer_fold").baseline_p.nunique().max() == 1


def test_stacking(rows):
    events = rows.select("symbol", "row_id", "label_end_index")
    folds = splits.walk_forward(events, 3, 80).cache()
    oof = {n: models.out_of_fold(rows, folds, f).select("symbol", "row_id", "fold_id", "y", "p").cache() for n, f in (("good", ["x1"]), ("poor", ["x2"]))}
    start = folds.where("fold_id = 3 and role = 'validation'").agg(F.min("row_id")).collect()[0][0]
    made = models.stacked(oof, rows.select("symbol", "row_id", "label_end_index", "volatility_zscore"), 3, start)
    assert made["best_candidate"] == "good" and made["balanced_accuracy"] > 0.6 and isinstance(made["used"], bool)
    assert made["model"].features == ["p_up__good", "confidence__good", "p_up__poor", "confidence__poor", "volatility_zscore"]


def events_of(spark):
    t = lambda d: datetime(2022, 3, d, tzinfo=UTC)
    bars = [("A", t(d), 100.0 + d, None, None, None) for d in (1, 2, 4, 7, 8, 9, 10)] + [("B", t(d), 50.0, None, None, None) for d in (1, 2, 3)]
    signals = [("A", t(2), None, t(7), 1, "s1"), ("A", t(4), None, t(8), -1, "s2"), ("A", t(5), None, t(9), 1, "s3"), ("A", t(7), None, t(9), -1, "s4"), ("A", t(9), None, t(30), 1, "s5"), ("B", t(2), None, t(3), 1, "b1")]
    return sorted(bars + signals, key=lambda r: (r[1], r[2] is not None)), t


WANTED = [("A", 2, "open", "s1"), ("A", 7, "close", "s1"), ("A", 7, "stale", "s2"), ("A", 7, "stale", "s3"), ("A", 7, "open", "s4"), ("A", 9, "close", "s4"), ("A", 9, "open", "s5"), ("B", 2, "open", "b1"), ("B", 3, "close", "b1")]


def shown(found):
    return sorted((r.symbol, r.time.day, r.event, r.signal_id) for r in found)


def test_replay_of_a_table(spark):
    rows, _ = events_of(spark)
    got = replay.replay(spark.createDataFrame(rows, replay.EVENTS)).collect()
    assert shown(got) == sorted(WANTED)
    assert {r.price for r in got if r.signal_id == "s4"} == {107.0, 109.0}


def test_replay_of_a_stream_over_batches_and_a_restart(spark, tmp_path):
    """State outlives micro-batches and a restart from the checkpoint; repeated ticks do nothing."""
    rows, _ = events_of(spark)
    rows = rows[:6] + [rows[5]] + rows[6:]  # a bar ticks twice

    def run(name):
        stream = spark.readStream.schema(replay.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = replay.replay_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, name

    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], replay.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i in (5, 10):
            run(i)
    run("last")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert shown(got) == sorted(WANTED) and not any(math.isnan(r.price) for r in got)
