"""Typed configuration from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import get_args, get_type_hints

from ..sources.bars import ContractError


@dataclass(frozen=True)
class Data:
    least_rows: int = 700
    volume: str = "tick_volume"
    boundary: str = "2020-01-01"


@dataclass(frozen=True)
class Labels:
    horizons: list[int] = field(default_factory=lambda: [1, 5, 10, 20])
    threshold_k: float = 0.35
    cost_bps: float = 3.0
    slippage_bps: float = 2.0
    least_coverage: float = 0.0


@dataclass(frozen=True)
class Splits:
    folds: int = 5
    inner_folds: int = 3
    least_train: int = 280
    least_validation: int = 40
    gap: int = 0
    groups: int = 8
    held: int = 2


@dataclass(frozen=True)
class Models:
    candidates: list[str] = field(default_factory=lambda: ["logistic", "random_forest", "extra_trees", "boosted"])
    fast: bool = False
    ablations: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    labels: Labels = field(default_factory=Labels)
    splits: Splits = field(default_factory=Splits)
    models: Models = field(default_factory=Models)


def made(kind: type, raw: dict, where: str = ""):
    """``kind`` from a mapping: missing entries take their defaults; unknown ones and wrong kinds are errors."""
    if not isinstance(raw, dict):
        raise ContractError(f"{where or 'the configuration'} is no mapping")
    hints = get_type_hints(kind)
    if extra := set(raw) - {f.name for f in fields(kind)}:
        raise ContractError(f"unknown entries {sorted(extra)} in {where or 'the configuration'}")
    values = {}
    for name, value in raw.items():
        wanted, at = hints[name], f"{where}.{name}".lstrip(".")
        if is_dataclass(wanted):
            values[name] = made(wanted, value, at)
            continue
        item = get_args(wanted)
        if wanted is float and type(value) is int:
            value = float(value)
        if type(value) is not (list if item else wanted) or (item and not all(type(x) is item[0] for x in value)):
            raise ContractError(f"{at} is of the wrong kind")
        values[name] = value
    return kind(**values)


def load_config(path: str | Path) -> Config:
    import yaml

    return made(Config, yaml.safe_load(Path(path).read_text()) or {})
