"""Settings of a run, checked when they are made, so that a wrong one never meets data."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import date
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What a run is made with; defaults (fixed values) are those of the registered queries."""

    grain: str = "week"
    end_train: str = "1999-12-31"
    start_oos: str = "2000-01-01"
    horizon: int = 5
    fill_limit: int = 2
    min_coverage: float = 0.5
    max_zero_rate: float = 0.03
    max_zero_run: int = 5
    min_assets: int = 2
    half_life: float = 55.0
    matched_scenarios: int = 500
    starts: int = 5
    rounds: int = 150
    p_step: str = "mirror"
    x_step: str = "joint"
    strict: bool = False
    models: tuple[str, ...] = ("gaussian_terminal", "student_t_terminal", "historical_weighted", "dcc_garch")
    df_mode: str = "mle"
    df: float = 6.0
    df_bounds: tuple[float, float] = (4.5, 60.0)
    alpha: float = 0.05
    cap: float = 0.25
    cost_bps: float = 20.0
    min_history: int = 100
    samples: int = 5000
    block: int = 4
    block_mode: str = "auto"
    confidence: float = 0.95
    multiple_testing: str = "holm"
    support: int | None = 100
    energy_pairs: int = 100_000
    seed: int = 42
    folds: tuple[str, ...] = field(default=("2000-01-01", "2000-07-01"))

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(date.fromisoformat(self.end_train) < date.fromisoformat(self.start_oos), "end_train has to be before start_oos")
        need(self.grain in ("day", "week", "month"), "unknown grain")
        need(self.horizon > 0 and self.fill_limit >= 0, "horizon and fill_limit may not be negative")
        need(0 < self.min_coverage <= 1 and 0 <= self.max_zero_rate <= 1, "shares have to be between 0 and 1")
        need(self.half_life > 0, "half_life has to be positive")
        need(self.matched_scenarios > 1 and self.starts > 0 and self.rounds > 0, "scenarios, starts and rounds have to be positive")
        need(self.p_step in ("mirror", "projected") and self.x_step in ("joint", "sequential", "jacobi"), "unknown solver step")
        need(self.df_mode in ("mle", "fixed") and self.df > 4, "degrees of freedom have to be over 4, by mle or fixed")
        need(len(self.df_bounds) == 2 and 4 < self.df_bounds[0] < self.df_bounds[1], "df_bounds need 4 < low < high")
        need(0 < self.alpha < 1 and 0 < self.cap <= 1 and 0 < self.confidence < 1, "alpha, cap and confidence are shares")
        need(self.samples >= 100 and self.block > 0 and self.block_mode in ("auto", "fixed"), "100 samples and a block of 1 at least")
        need(self.multiple_testing == "holm", "only holm adjusts for many tests")
        need(self.energy_pairs > 0, "the pair term needs draws")
        need(self.support is None or self.support >= 2, "a support has two scenarios at least")
        need(list(self.folds) == sorted(set(self.folds)) and len(self.folds) > 0, "folds have to begin on distinct, ascending dates")

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a mapping; unknown names are an error."""
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a YAML file (JSON is YAML, too)."""
        try:
            import yaml
        except ImportError:
            import json

            return cls.of(json.loads(Path(path).read_text(encoding="utf-8")))
        return cls.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
