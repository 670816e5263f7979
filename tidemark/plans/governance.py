"""Driver-side evidence: hash-chained registry, freezes, phase guards, locks and receipts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from pathlib import Path

GENESIS = "0" * 64


class BrokenRule(RuntimeError):
    """A rule of the research protocol is broken."""


def canonical(payload) -> str:
    """Sorted, compact JSON without NaN."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def digest(payload) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


class Registry:
    """Append-only JSON lines; each record names the hash of the one before it."""

    def __init__(self, path: str | Path, family_budget: int | None = None):
        self.path, self.budget = Path(path), family_budget

    def records(self) -> list[dict]:
        if not self.path.exists():
            return []
        out, before = [], GENESIS
        for i, line in enumerate(self.path.read_text().splitlines()):
            record = json.loads(line)
            body = {k: v for k, v in record.items() if k != "record_hash"}
            if record["sequence"] != i or record["previous_record_hash"] != before or record["record_hash"] != digest(body):
                raise BrokenRule(f"record {i} breaks the chain")
            before = record["record_hash"]
            out.append(record)
        return out

    def append(self, experiment_id: str, family: str, payload: dict) -> dict:
        have = self.records()
        if any(r["experiment_id"] == experiment_id for r in have):
            raise BrokenRule("the experiment is recorded already")
        if self.budget is not None and sum(r["family"] == family for r in have) >= self.budget:
            raise BrokenRule("the family's budget is spent")
        body = {"sequence": len(have), "previous_record_hash": have[-1]["record_hash"] if have else GENESIS, "experiment_id": experiment_id, "family": family, "payload": payload}
        record = body | {"record_hash": digest(body)}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(canonical(record) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.records()
        return record


class Lock:
    """A file that exists while its owner works."""

    def __init__(self, path: str | Path):
        self.path, self.token = Path(path), uuid.uuid4().hex

    def __enter__(self) -> Lock:
        try:
            with self.path.open("x") as f:
                f.write(self.token)
        except FileExistsError:
            raise BrokenRule("locked by another process") from None
        return self

    def __exit__(self, *_) -> None:
        if self.path.exists() and self.path.read_text() == self.token:
            self.path.unlink()


SHA = re.compile(r"[0-9a-f]{64}").fullmatch
#: Fields of a registered experiment and its phases (fixed values).
FIELDS = {"experiment_id": str, "family": str, "phase": str, "horizon": int, "config_sha256": str, "data_sha256": str, "code_sha256": str}
PHASES = ["development", "audit"]


def validate_payload(payload: dict) -> dict:
    """``payload``, if it has all fields with the right kinds, hashes, phase and a positive horizon."""
    for name, kind in FIELDS.items():
        if name not in payload or type(payload[name]) is not kind or payload[name] == "":
            raise BrokenRule(f"field {name} is missing or of the wrong kind")
        if name.endswith("_sha256") and not SHA(payload[name]):
            raise BrokenRule(f"{name} is no SHA-256")
    if payload["phase"] not in PHASES or payload["horizon"] < 1:
        raise BrokenRule("no such phase or horizon")
    return payload


def check_access(phase: str, role: str) -> None:
    """In development only the development partition may be read; an audit reads both."""
    if phase not in PHASES or role not in PHASES or (phase, role) == ("development", "audit"):
        raise BrokenRule(f"{role} may not be read in phase {phase}")


def claim_access(folder: str | Path, role: str, frozen: dict | None) -> Path:
    """One-time right to read a protected partition; only after a candidate is frozen and promoted."""
    if role == "audit" and not (frozen and frozen.get("promoted") and frozen.get("freeze_hash") == digest({k: v for k, v in frozen.items() if k != "freeze_hash"})):
        raise BrokenRule("no valid frozen candidate")
    path = Path(folder) / f"{role}.claim"
    try:
        with path.open("x") as f:
            f.write(canonical({"role": role}))
    except FileExistsError:
        raise BrokenRule("the partition was claimed before") from None
    return path


def freeze(candidate: dict, promoted: bool) -> dict:
    body = candidate | {"promoted": bool(promoted)}
    return body | {"freeze_hash": digest(body)}


def validate_freeze(frozen: dict, baseline: dict | None = None) -> dict:
    """``frozen``, if its hash holds, it was promoted, and it was judged against ``baseline``."""
    body = {k: v for k, v in frozen.items() if k != "freeze_hash"}
    if frozen.get("freeze_hash") != digest(body):
        raise BrokenRule("the frozen candidate was changed")
    if not frozen.get("promoted"):
        raise BrokenRule("the candidate was not promoted")
    if baseline is not None and frozen.get("baseline_hash") != digest(baseline):
        raise BrokenRule("the candidate was judged against another baseline")
    return frozen


def freeze_family(folder: str | Path, family: str, members: list[dict], sources: dict[str, str]) -> dict:
    """Preregisters all members of a family with the hashes of data, configuration and code; never twice."""
    ids = [m["experiment_id"] for m in members]
    if not members or len(set(ids)) != len(ids):
        raise BrokenRule("a family has members, and each once")
    body = {"family": family, "members": [validate_payload(m) for m in members], "member_hashes": {m["experiment_id"]: digest(m) for m in members}, "sources": sources}
    body = body | {"family_hash": digest(body)}
    path = Path(folder) / f"{family}.family.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with path.open("x") as f:
            f.write(canonical(body))
    except FileExistsError:
        raise BrokenRule("the family is frozen already") from None
    return body


def verify_bundle(bundle: dict, data: str, config: str, code: dict[str, str]) -> None:
    """A preregistered family against what is about to run: its own hash, its members', data, configuration and every source."""
    body = {k: v for k, v in bundle.items() if k != "family_hash"}
    wrong = [
        name
        for name, ok in {
            "family": bundle.get("family_hash") == digest(body),
            "members": all(bundle["member_hashes"].get(m["experiment_id"]) == digest(m) for m in bundle["members"]) and len(bundle["member_hashes"]) == len(bundle["members"]),
            "data": all(m["data_sha256"] == data for m in bundle["members"]),
            "configuration": all(m["config_sha256"] == config for m in bundle["members"]),
            "sources": bundle["sources"] == code and all(m["code_sha256"] == digest(code) for m in bundle["members"]),
        }.items()
        if not ok
    ]
    if wrong:
        raise BrokenRule(f"not what was preregistered: {', '.join(wrong)}")


def code_tree(folder: str | Path, pattern: str = "*.py") -> dict[str, str]:
    """SHA-256 of every source file below ``folder`` by its relative path."""
    root = Path(folder)
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob(pattern))}


def runtime() -> dict:
    """Versions of what runs."""
    import platform
    from importlib.metadata import version

    return {"python": platform.python_version(), "platform": platform.platform()} | {name: version(name) for name in ("pyspark", "pyarrow", "numpy", "pandas")}


def lineage(raw: dict, canonical_: dict, transform: str) -> dict:
    """Where a table comes from: summaries (rows, sha256) of the raw and the canonical one and what lies between."""
    if canonical_["rows"] > raw["rows"]:
        raise BrokenRule("the canonical table has more rows than its source")
    body = {"raw": raw, "canonical": canonical_, "transform": transform}
    return body | {"lineage_hash": digest(body)}


def run_identity(source: str, config: dict, code: dict[str, str], about: dict) -> str:
    """16 hex digits that tell runs of other data, configuration, code or runtime apart."""
    return digest({"source": source, "config": config, "code": code, "runtime": about})[:16]


def feature_registry(families: dict[str, list[str]]) -> list[dict]:
    """An entry for each feature: its name, family and place."""
    names = [n for members in families.values() for n in members]
    if len(set(names)) != len(names):
        raise BrokenRule("a feature is registered twice")
    return [{"feature": n, "family": family, "position": names.index(n)} for family, members in families.items() for n in members]


def execution_manifest(run_id: str, steps: list[dict], artifacts: dict[str, str]) -> dict:
    """What a run did: its steps in order, each with rows in and out, and its artifacts' hashes."""
    body = {"run_id": run_id, "steps": steps, "artifacts": artifacts, "runtime": runtime()}
    return body | {"manifest_hash": digest(body)}


def receipt(folder: str | Path, **facts) -> dict:
    """Hashes of every file below ``folder`` with facts about the run."""
    root = Path(folder)
    files = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*")) if p.is_file()}
    body = {"files": files, **facts}
    return body | {"receipt_hash": digest(body)}


def verify_receipt(folder: str | Path, made: dict) -> None:
    facts = {k: v for k, v in made.items() if k not in ("files", "receipt_hash")}
    if receipt(folder, **facts) != made:
        raise BrokenRule("the files are not those of the receipt")


def finalize(staging: str | Path, final: str | Path, **facts) -> dict:
    """Puts a receipt into a finished staging folder and renames it; never over an existing run."""
    if Path(final).exists():
        raise BrokenRule("the run exists")
    made = receipt(staging, **facts)
    (Path(staging) / "receipt.json").write_text(canonical(made))
    Path(staging).rename(final)
    return made


def failed(folder: str | Path, run_id: str, error: BaseException) -> dict:
    """A receipt of a run that failed; written once."""
    body = {"run_id": run_id, "status": "failed", "kind": type(error).__name__, "message": str(error)[:2000]}
    body = body | {"receipt_hash": digest(body)}
    path = Path(folder) / f"{run_id}.failed.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        f.write(canonical(body))
    return body
