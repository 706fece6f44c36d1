"""Engine and study configurations: read whole, checked rule by rule, unknown keys refused."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EngineConfig:
    """One backtest: costs in parts per million, times in milliseconds, quantities as decimals."""

    instrument: str
    cash: float = 100_000.0
    fast: int = 120
    slow: int = 600
    qty: float = 0.01
    taker_ppm: int = 450
    maker_ppm: int = 150
    latency_ms: int = 50
    funding_interval_ms: int = 3_600_000
    funding_ppm: int = 100

    def broken(self) -> list[str]:
        """Names of the rules that don't hold."""
        rules = {
            "instrument": bool(self.instrument),
            "cash": self.cash > 0,
            "windows": 0 < self.fast < self.slow,
            "qty": self.qty > 0,
            "fees": 0 <= self.taker_ppm <= 100_000 and 0 <= self.maker_ppm <= 100_000,
            "latency": self.latency_ms >= 0,
            "funding": self.funding_interval_ms >= 0,
        }
        return [name for name, holds in rules.items() if not holds]


def broken_rules() -> Column:
    """The names of the rules that a row's configuration breaks, as ``EngineConfig.broken`` has them; the columns are its fields."""
    c = F.col
    rules = {
        "instrument": c("instrument") != "",
        "cash": c("cash") > 0,
        "windows": (c("fast") > 0) & (c("fast") < c("slow")),
        "qty": c("qty") > 0,
        "fees": c("taker_ppm").between(0, 100_000) & c("maker_ppm").between(0, 100_000),
        "latency": c("latency_ms") >= 0,
        "funding": c("funding_interval_ms") >= 0,
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))


def _made(cls, values: dict):
    unknown = sorted(set(values) - {f.name for f in fields(cls)})
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    config = cls(**values)
    if config.broken():
        raise ValueError(f"rules broken: {', '.join(config.broken())}")
    return config


def engine_config(text: str) -> EngineConfig:
    """An engine configuration from TOML."""
    return _made(EngineConfig, tomllib.loads(text))


@dataclass(frozen=True)
class StudyConfig:
    """One study: features by name with parameters, splits and embargo."""

    features: list[tuple[str, dict]]
    scheme: str = "walk_forward"
    n_splits: int = 5
    embargo: int = 10

    def broken(self) -> list[str]:
        """Names of the rules that don't hold."""
        rules = {"features": len(self.features) > 0, "scheme": self.scheme in ("walk_forward", "purged_kfold"), "n_splits": self.n_splits >= 2, "embargo": self.embargo >= 0}
        return [name for name, holds in rules.items() if not holds]


def study_config(values: dict) -> StudyConfig:
    """A study configuration from a mapping, as YAML or JSON gives it."""
    return _made(StudyConfig, values)
