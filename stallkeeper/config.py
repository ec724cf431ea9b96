"""Tunable numbers of the pricing engine; the defaults are those of a live market with sales of the last week."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pricing:
    min_refs: int = 5
    max_age_days: float = 7
    ref_cap: int = 80
    short_hours: float = 12
    min_share: float = 0.15  # premium over the base value at which a feature splits its pool
    min_samples: int = 3
    manipulated_share: float = 0.33
    trend_rows: int = 200
    dominance_rows: int = 600
    prior: int = 10  # strength with which learned values are shrunk
    ladder_step: float = 0.85


@dataclass(frozen=True)
class Lanes:
    snipe_margin: float = 0.35
    min_margin: float = 0.12
    min_profit: float = 250_000
    min_confidence: float = 0.0
    max_undercuts: int = 3
    relist_limit: int = 3
    lbin_min_sold: int = 3
    lbin_min_listings: int = 4
    lbin_sold_mult: float = 1.10
    craft_mult: float = 1.1
    trend_floor: float = -0.15
    margin_penalty: float = 1.0


@dataclass(frozen=True)
class Book:
    tax: float = 0.0125
    min_margin_pct: float = 3.0
    min_depth_units: float = 64
    fill_p: float = 0.55 * 0.32
    fill_hours: float = 0.215 + 1.78
    min_stability: float = 0.5
    min_samples: int = 60
