"""Sources, sinks, configuration and governance."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import config, governance
from tidemark.sources import bars as B


def test_tab_export(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("<DATE>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2022.11.07\t15.5\t16\t15\t15.8\t71\t0\t3\n2022.11.08\t15.8\t17\t15.6\t16.4\t98\t0\t4\n")
    assert [(r.volume, r.close) for r in B.read_tab_export(spark, str(p)).orderBy("row_id").collect()] == [(71, 15.8), (98, 16.4)]
    raw = spark.createDataFrame([(3.0, 30.0, 3.0), (4.0, 40.0, 5.0)], "tick_volume double, real_volume double, volume double")
    with pytest.raises(B.ContractError):
        B.select_volume(raw, "tick_volume")
    assert [r.volume for r in B.select_volume(raw.drop("volume"), "real_volume").collect()] == [30, 40]


def raw_bars(spark, n=30):
    days = pd.bdate_range("2022-01-03", periods=n)
    return spark.createDataFrame(pd.DataFrame({"date": days, "open": 10.0, "high": 12.0, "low": 9.0, "close": 11.0, "tick_volume": 5.0, "real_volume": 50.0})).coalesce(1)


def test_normalisation_fails_closed(spark):
    raw = raw_bars(spark)
    assert B.normalize(raw, "real_volume", 30).where("volume = 50 and row_id = 29").count() == 1
    for bad in (
        lambda: B.normalize(raw, None, 30),
        lambda: B.normalize(raw, "tick_volume", 31),
        lambda: B.normalize(raw.drop("open"), "tick_volume", 30),
        lambda: B.normalize(raw.orderBy(F.desc("date")).coalesce(1), "tick_volume", 30),
        lambda: B.normalize(raw.withColumn("high", F.lit(10.5)), "tick_volume", 30),
        lambda: B.normalize(raw.withColumn("close", F.lit(float("nan"))), "tick_volume", 30),
        lambda: B.normalize(raw.withColumn("tick_volume", F.lit(-1.0)), "tick_volume", 30),
        lambda: B.normalize(raw.unionByName(raw.limit(1)).orderBy("date").coalesce(1), "tick_volume", 30),
    ):
        with pytest.raises(B.ContractError):
            bad()
    bars, manifest = B.downloaded(raw, "2022-01-10", "2022-01-31", "tick_volume")
    assert manifest["rows"] == bars.count() == 15 and manifest["last"].startswith("2022-01-28")


def test_csv_and_prefix(spark, tmp_path):
    B.write_csv(raw_bars(spark).withColumnRenamed("tick_volume", "volume").drop("real_volume"), f"{tmp_path}/bars.csv")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["bars.csv"]
    bars = B.read_csv(spark, f"{tmp_path}/bars.csv")
    assert bars.count() == 30 and B.development_prefix(bars, "2022-02-01", 20).count() == 20
    with pytest.raises(B.ContractError):
        B.development_prefix(bars, "2022-02-01", 31)
    with pytest.raises(B.ContractError):
        B.development_prefix(bars, "2022-01-10", 20)
    with pytest.raises(B.ContractError):
        B.write_csv(bars, f"{tmp_path}/bars.csv")


def test_partitions_are_bound_to_their_files(spark, tmp_path):
    bars = B.canonical(raw_bars(spark).withColumnRenamed("tick_volume", "volume"))
    made = B.freeze_partitions(bars, "2022-02-01 00:00:00", f"{tmp_path}/p")
    assert made["development"]["rows"] + made["audit"]["rows"] == 30
    assert B.load_development(spark, f"{tmp_path}/p", made["development"]).count() == made["development"]["rows"]
    with pytest.raises(B.ContractError):
        B.load_development(spark, f"{tmp_path}/p", made["audit"])
    with pytest.raises(B.ContractError):
        B.freeze_partitions(bars, "2022-02-01 00:00:00", f"{tmp_path}/p")
    bars.limit(1).write.mode("append").parquet(f"{tmp_path}/p/development")
    with pytest.raises(B.ContractError):
        B.load_development(spark, f"{tmp_path}/p", made["development"])


def test_signal_tables_keep_their_contract(spark, tmp_path):
    good = "entry_time,exit_time,direction,signal_id\n2022.05.02 00:00,2022.05.04 00:00,1,a\n2022.05.05 00:00,2022.05.06 00:00,-1,b\n"
    cases = {"good": good, "order": good.replace("entry_time,exit_time", "exit_time,entry_time"), "twice": good.replace(",b", ",a"), "zero": good.replace(",-1,", ",0,"), "early": good.replace("2022.05.06", "2022.05.05"), "unsorted": good.replace("2022.05.05", "2022.05.02")}
    for name, text in cases.items():
        (tmp_path / f"{name}.csv").write_text(text)
    assert B.read_signals(spark, f"{tmp_path}/good.csv").count() == 2
    for name in set(cases) - {"good"}:
        with pytest.raises(B.ContractError):
            B.read_signals(spark, f"{tmp_path}/{name}.csv")


def test_differences_and_fingerprints(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, x double")
    b = spark.createDataFrame([(2, 2.5), (3, None), (4, 4.0)], "k int, x double")
    assert tuple(B.differences(a, b, ["k"], ["x"]).collect()[0]) == (1, 1, 1)
    assert tuple(B.differences(a, a, ["k"], ["x"]).collect()[0]) == (0, 0, 0)
    of = lambda df: tuple(B.fingerprint(df, ["k", "x"]).collect()[0])
    assert of(a) == of(a.orderBy(F.desc("k")).repartition(2)) != of(a.withColumn("x", F.col("x") + 0.001))


def test_reports(spark, tmp_path):
    (tmp_path / "r.html").write_bytes("<table><tr><td>Total Trades:</td><td><b>23</b></td></tr><tr><td>Profit Factor:</td><td>0.99</td></tr></table>".encode("utf-16"))
    row = B.parse_report(spark, f"{tmp_path}/r.html", ["Total Trades", "Profit Factor", "Absent"]).collect()[0]
    assert tuple(row) == ("23", "0.99", None)


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("labels:\n  horizons: [2, 4]\n  threshold_k: 1\nmodels: {fast: true}\n")
    made = config.load_config(path)
    assert made.labels.horizons == [2, 4] and made.labels.threshold_k == 1.0 and made.models.fast and made.splits.folds == 5
    for bad in ("labels: {horizon: 3}", "labels: {horizons: [a]}", "splits: {folds: x}", "- 1", "models: {fast: 1}"):
        path.write_text(bad)
        with pytest.raises(B.ContractError):
            config.load_config(path)


def test_sidecars(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.txt").write_text("1")
    entry = {"path": "a.txt", "sha256": B.sha256_file(tmp_path / "data/a.txt")}
    B.write_json(tmp_path / "m.json", {"files": [entry]})
    assert B.load_sidecar(tmp_path / "m.json", tmp_path / "data")["files"] == [entry]
    for files in ([], [entry, entry], [entry | {"sha256": "0" * 64}]):
        B.write_json(tmp_path / "m.json", {"files": files})
        with pytest.raises(B.ContractError):
            B.load_sidecar(tmp_path / "m.json", tmp_path / "data")
    with pytest.raises(FileExistsError):
        B.write_json(tmp_path / "m.json", {}, exclusive=True)


def test_registry_chain_and_locks(tmp_path):
    reg = governance.Registry(tmp_path / "r.jsonl", family_budget=2)
    reg.append("a", "f", {"x": 1})
    reg.append("b", "f", {"x": 2})
    for name in ("a", "c"):
        with pytest.raises(governance.BrokenRule):
            reg.append(name, "f", {})
    reg.path.write_text(reg.path.read_text().replace('"x":1', '"x":9'))
    with pytest.raises(governance.BrokenRule):
        reg.records()
    with governance.Lock(tmp_path / "lock"), pytest.raises(governance.BrokenRule), governance.Lock(tmp_path / "lock"):
        pass


def payload(name="e1", **changes):
    return {"experiment_id": name, "family": "f", "phase": "development", "horizon": 5, "config_sha256": "a" * 64, "data_sha256": "b" * 64, "code_sha256": "c" * 64} | changes


def test_payloads_phases_and_freezes(tmp_path):
    assert governance.validate_payload(payload()) == payload()
    for bad in (payload(horizon=0), payload(horizon=True), payload(phase="other"), payload(config_sha256="x"), {k: v for k, v in payload().items() if k != "family"}):
        with pytest.raises(governance.BrokenRule):
            governance.validate_payload(bad)
    governance.check_access("audit", "development")
    with pytest.raises(governance.BrokenRule):
        governance.check_access("development", "audit")
    baseline = {"accuracy": 0.5}
    frozen = governance.freeze({"id": 1, "baseline_hash": governance.digest(baseline)}, True)
    assert governance.validate_freeze(frozen, baseline) == frozen
    for bad, base in ((frozen | {"id": 2}, None), (governance.freeze({"id": 1}, False), None), (frozen, {"accuracy": 0.6})):
        with pytest.raises(governance.BrokenRule):
            governance.validate_freeze(bad, base)
    with pytest.raises(governance.BrokenRule):
        governance.claim_access(tmp_path, "audit", None)
    governance.claim_access(tmp_path, "audit", frozen)
    with pytest.raises(governance.BrokenRule):
        governance.claim_access(tmp_path, "audit", frozen)


def test_families_are_verified_before_they_run(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("x = 1\n")
    code = governance.code_tree(tmp_path / "src")
    members = [payload(n, code_sha256=governance.digest(code)) for n in ("e1", "e2")]
    bundle = governance.freeze_family(tmp_path, "f", members, code)
    governance.verify_bundle(bundle, "b" * 64, "a" * 64, code)
    with pytest.raises(governance.BrokenRule):
        governance.freeze_family(tmp_path, "f", members, code)
    (tmp_path / "src/m.py").write_text("x = 2\n")
    for bad in ((bundle, "d" * 64, "a" * 64, code), (bundle, "b" * 64, "d" * 64, code), (bundle, "b" * 64, "a" * 64, governance.code_tree(tmp_path / "src")), (bundle | {"family": "g"}, "b" * 64, "a" * 64, code)):
        with pytest.raises(governance.BrokenRule):
            governance.verify_bundle(*bad)


def test_runs_leave_receipts(tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/a").write_text("1")
    made = governance.finalize(tmp_path / "run", tmp_path / "done", run=1)
    (tmp_path / "done/receipt.json").rename(tmp_path / "receipt.json")
    governance.verify_receipt(tmp_path / "done", made)
    (tmp_path / "done/a").write_text("2")
    with pytest.raises(governance.BrokenRule):
        governance.verify_receipt(tmp_path / "done", made)
    (tmp_path / "run").mkdir()
    with pytest.raises(governance.BrokenRule):
        governance.finalize(tmp_path / "run", tmp_path / "done")
    assert governance.failed(tmp_path, "r1", ValueError("no"))["kind"] == "ValueError"
    with pytest.raises(FileExistsError):
        governance.failed(tmp_path, "r1", ValueError("no"))
    about = governance.runtime()
    ids = {governance.run_identity(s, c, {"m": "1"}, about) for s, c in (("x", {}), ("y", {}), ("x", {"k": 1}))}
    assert len(ids) == 3 and all(len(i) == 16 for i in ids)
    assert governance.feature_registry({"a": ["f1"], "b": ["f2", "f3"]})[2] == {"feature": "f3", "family": "b", "position": 2}
    with pytest.raises(governance.BrokenRule):
        governance.feature_registry({"a": ["f1"], "b": ["f1"]})
    assert json.loads(governance.canonical(governance.execution_manifest("r", [], {})))["run_id"] == "r"
    with pytest.raises(governance.BrokenRule):
        governance.lineage({"rows": 1}, {"rows": 2}, "t")
