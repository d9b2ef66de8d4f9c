"""Rulesets: thresholds and weights, versioned by appending."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

#: Weights of (prb, persistence, users, traffic, throughput, trend) by mode; balanced takes the ruleset's.
MODE_WEIGHTS = {
    "customer": (10, 15, 30, 25, 20, 0),
    "congestion": (45, 15, 5, 10, 15, 10),
    "persistence": (15, 45, 10, 10, 10, 10),
    "deterioration": (20, 15, 10, 10, 15, 30),
}
MODES = ("balanced", *MODE_WEIGHTS)
PERCENTS = (
    "prb_threshold_pct", "tch_congestion_pct", "sdcch_congestion_pct", "cssr_pct", "call_drop_pct",
    "data_access_pct", "data_failure_pct", "district_nc_pct",
)
BOUNDS = {"weekly_breach_days": (1, 7), "persistent_weeks": (1, 26), "chronic_weeks": (2, 52)}


@dataclass(frozen=True)
class Rules:
    version: int = 1
    prb_threshold_pct: float = 80.0
    tch_congestion_pct: float = 2.0
    sdcch_congestion_pct: float = 2.0
    cssr_pct: float = 98.5
    call_drop_pct: float = 1.5
    data_access_pct: float = 98.0
    data_failure_pct: float = 1.0
    weekly_breach_days: int = 1
    persistent_weeks: int = 3
    chronic_weeks: int = 7
    district_nc_pct: float = 10.0
    priority_weights: tuple[float, ...] = (25, 20, 15, 15, 15, 10)
    kpi_thresholds: dict = field(default_factory=dict, compare=False)

    def mode_weights(self, mode: str) -> tuple[float, ...]:
        return self.priority_weights if mode == "balanced" else MODE_WEIGHTS[mode]

    def streak_limits(self, grain: str) -> tuple[int, int]:
        """(chronic, persistent) in periods of ``grain``."""
        if grain == "daily":
            return max(14, self.chronic_weeks * 7), max(7, self.persistent_weeks * 7)
        if grain == "monthly":
            return max(2, int(self.chronic_weeks / 4 + 0.5)), max(2, int(self.persistent_weeks / 4 + 0.5))
        return self.chronic_weeks, self.persistent_weeks


def problems(rules: Rules) -> list[str]:
    found = [f"{k} must be within 0 and 100" for k in PERCENTS if not 0 <= getattr(rules, k) <= 100]
    found += [f"{k} must be within {a} and {b}" for k, (a, b) in BOUNDS.items() if not a <= getattr(rules, k) <= b]
    w = rules.priority_weights
    if len(w) != 6 or any(x < 0 for x in w) or sum(w) <= 0:
        found.append("priority_weights must be six non-negative numbers with a positive sum")
    return found


def normalized(weights) -> tuple[float, ...]:
    """Weights that sum to 100, one decimal each; the first takes the rest."""
    total = sum(weights)
    out = [int(w / total * 1000 + 0.5) / 10 for w in weights]
    out[0] = round(out[0] + 100 - sum(out), 1)
    return tuple(out)


def updated(current: Rules, **patch) -> Rules:
    """The next version with ``patch`` applied; raises ValueError on bad values."""
    new = replace(current, **patch)
    if bad := problems(new):
        raise ValueError("; ".join(bad))
    return replace(new, version=current.version + 1, priority_weights=normalized(new.priority_weights))


def as_row(rules: Rules) -> dict:
    return asdict(rules)
