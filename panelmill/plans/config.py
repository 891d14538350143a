"""Settings of a factor study."""

from __future__ import annotations

from dataclasses import dataclass


# Names and defaults of the settings are the public surface.
@dataclass(frozen=True)
class ResearchConfig:
    rebalance_periods: tuple[int | str, ...] = ("W", "M", "Q")
    return_horizons: tuple[int, ...] = (1, 5, 10)
    horizon_rolling_period: int = 20
    bins: int = 5
    fac_shift: int | None = None
    base_rate: float = 0.02
    fee_rate: float = 0.0003
    slippage_rate: float = 0.001
    tax_rate: float = 0.0
    tax_rate_direction: str = "sell"
    overnight: str = "on"

    def __post_init__(self):
        if self.bins < 3:
            raise ValueError(f"a study needs 3 bins or more, not {self.bins}")
        if self.overnight not in ("on", "off", "only"):
            raise ValueError(f"{self.overnight!r} is no overnight mode; there are on, off and only")
        self.fees  # noqa: B018  raises for an unknown direction

    @property
    def fees(self) -> tuple[float, float]:
        """Rates on what is bought and on what is sold."""
        if self.tax_rate_direction not in ("buy", "sell", "both"):
            raise ValueError(f"tax_rate_direction can be buy, sell or both, got {self.tax_rate_direction}")
        plain = self.fee_rate + self.slippage_rate
        return tuple(plain + self.tax_rate * (self.tax_rate_direction in (side, "both")) for side in ("buy", "sell"))


@dataclass(frozen=True)
class AnalysisConfig:
    ic_method: str = "spearman"
    log_scale: bool = False
    agg_freq: str | None = None
    group_by: dict[str, str] | None = None
