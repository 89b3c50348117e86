"""Every tunable of the library, as plain parameter records."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoreParams:
    rsi_overbought: float = 75
    rsi_oversold: float = 35
    rsi_mid: float = 50
    macd_cross_window: int = 3
    rvol_spike: float = 2.0
    rvol_moderate: float = 1.5
    sr_short: int = 20
    sr_long: int = 50
    bullish: int = 65
    bearish: int = 35
    weights: tuple[tuple[str, int], ...] = (("ema", 20), ("volume", 20), ("rsi", 15), ("macd", 15), ("sr", 15), ("bollinger", 10), ("candle", 5))


@dataclass(frozen=True)
class RiskParams:
    atr_multiplier: float = 2.0
    capital: float = 10_000_000
    risk_percent: float = 1.0
    most_percent: float = 25.0
    min_volume: float = 500_000
    min_turnover: float = 1_000_000_000


@dataclass(frozen=True)
class TagParams:
    lookback: int = 60
    high: float = 90.0
    low: float = 10.0
    far_percent: float = 5.0
    atr_ratio: float = 1.5
    gap_percent: float = 1.0
    rarity_rows: int = 252
    rare: int = 5
    broad: int = 6
    results: int = 15


@dataclass(frozen=True)
class ContextParams:
    rank: float = 10.0
    rank_strength: float = 15.0
    rank_volume: float = 15.0
    min_turnover: float = 1_000_000_000


@dataclass(frozen=True)
class EventParams:
    min_yield: float = 4.0
    window: int = 10
    max_volume_rank: float = 30.0
    min_turnover: float = 1_000_000_000


@dataclass(frozen=True)
class BacktestParams:
    folds: int = 5
    warmup: int = 60
    target_percent: float = 2.0
    fee: float = 0.004
    min_score: int = 65
    exit_days: int = 10
    min_wins: int = 5
    min_values: int = 10
    horizons: tuple[int, ...] = (1, 3, 5)
    gate_ev: float = 0.003
    gate_win_rate: float = 0.55
    gate_ratio: float = 1.2
    gate_folds: int = 4
    trading_days: int = 640
    signals_per_day: float = 5


@dataclass(frozen=True)
class LearnParams:
    forward: int = 3
    top: float = 0.3
    min_stocks: int = 10
    min_rows: int = 50
    purge: int = 3
    splits: int = 5
    bullish: int = 60
    bearish: int = 40
    threshold: float = 0.70
