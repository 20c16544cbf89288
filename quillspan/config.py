"""Settings of the analyses, as plain values that every function also takes as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults suit the records of the driver's tables: record A from 1995, record B from 1998."""

    fine_step: float = 0.01
    cell_step: float = 0.02
    burn_months: tuple[int, ...] = (2, 3, 4, 5)
    hill_regions: tuple[int, ...] = (0, 1)
    first_year: int = 1995
    overlap_from: int = 1998
    last_year: int = 2001
    last_month: int = 11
    heavy_days: int = 3
    steep_degrees: float = 15.0
    drift_hours: float = 0.15
    gap_days: int = 8
    gap_share: float = 0.5
    replicates: int = 2000
    bins: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6, 8, 10, 15)
    never_burned: int = 15
    top: int = 50


CONFIG = Config()
