"""The 13 strategy templates: each maps a dense panel to (symbol, date, entry, exit)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions import indicators as I



def _out(df: DataFrame, entry: Column, exit_: Column) -> DataFrame:
    return df.select("symbol", "date", entry.alias("entry"), exit_.alias("exit"))


def _edges(df: DataFrame, state: Column) -> DataFrame:
    w = I.by_symbol()
    d = df.withColumn("_state", state)
    return _out(d, I.rising(F.col("_state"), w), I.falling(F.col("_state"), w))


def sma_crossover(p: DataFrame, fast: int = 20, slow: int = 100) -> DataFrame:
    w = I.by_symbol()
    return _edges(p.withColumns({"_f": I.sma(F.col("close"), fast, w), "_s": I.sma(F.col("close"), slow, w)}), I.gt(F.col("_f"), F.col("_s")))


def ema_crossover(p: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    d = I.sequential(p, [("_f", "ema", "close", fast), ("_s", "ema", "close", slow)])
    return _edges(d, I.gt(F.col("_f"), F.col("_s")))


def macd(p: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    d = I.sequential(p, [("_f", "ema", "close", fast), ("_s", "ema", "close", slow)]).withColumn("_m", F.col("_f") - F.col("_s"))
    return _edges(I.sequential(d, [("_g", "ema", "_m", signal)]), I.gt(F.col("_m"), F.col("_g")))


def donchian_breakout(p: DataFrame, entry_period: int = 20, exit_period: int = 10) -> DataFrame:
    w = I.by_symbol()
    d = p.withColumns({"_hi": F.coalesce("high", "close"), "_lo": F.coalesce("low", "close")})
    d = d.withColumns({"_top": I.rolling_max(F.col("_hi"), entry_period, w, -1), "_bot": I.rolling_min(F.col("_lo"), exit_period, w, -1)})
    return _out(d, I.gt(F.col("close"), F.col("_top")), I.lt(F.col("close"), F.col("_bot")))


def atr_breakout(p: DataFrame, lookback: int = 20, k: float = 2.0) -> DataFrame:
    w = I.by_symbol()
    prev = F.lag("close").over(w)
    d = p.withColumns({"_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)), "_m": I.sma(F.col("close"), lookback, w)})
    d = I.sequential(d, [("_atr", "wilder", "_tr", lookback)])
    band = F.col("_atr") * F.lit(float(k))
    return _out(d, I.gt(F.col("close"), F.col("_m") + band), I.lt(F.col("close"), F.col("_m") - band))


def mean_reversion(p: DataFrame, lookback: int = 20, entry_z: float = 2.0, exit_z: float = 0.0) -> DataFrame:
    d = p.withColumn("_z", I.zscore(F.col("close"), lookback, I.by_symbol()))
    return _out(d, I.lt(F.col("_z"), F.lit(-float(entry_z))), I.ge(F.col("_z"), F.lit(float(exit_z))))


def bollinger_bands(p: DataFrame, lookback: int = 20, k: float = 2.0) -> DataFrame:
    w = I.by_symbol()
    d = p.withColumns({"_m": I.sma(F.col("close"), lookback, w), "_s": I.rolling_std(F.col("close"), lookback, w)})
    return _out(d, I.lt(F.col("close"), F.col("_m") - F.lit(float(k)) * F.col("_s")), I.ge(F.col("close"), F.col("_m")))


def rsi_2(p: DataFrame, period: int = 2, entry_rsi: float = 10.0, exit_rsi: float = 70.0, trend_sma: int = 200) -> DataFrame:
    d = I.sequential(p, [("_r", "rsi", "close", period)])
    go = I.lt(F.col("_r"), F.lit(float(entry_rsi)))
    if trend_sma > 0:
        d = d.withColumn("_t", I.sma(F.col("close"), trend_sma, I.by_symbol()))
        go = go & I.gt(F.col("close"), F.col("_t"))
    return _out(d, go, I.gt(F.col("_r"), F.lit(float(exit_rsi))))


def pct_rank(x: Column, by: str = "date") -> Column:
    """Rank within the date as a share of the values there, ties averaged; NULL for NULL. x must be a column, not a window."""
    w = Window.partitionBy(by)
    rank = F.rank().over(w.orderBy(F.col(x).asc_nulls_last() if isinstance(x, str) else x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(by, x))
    return F.when(F.col(x).isNotNull() if isinstance(x, str) else x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(w))


def momentum_12_1(p: DataFrame, lookback: int = 252, skip: int = 21, quantile: float = 0.3) -> DataFrame:
    w = I.by_symbol()
    d = p.withColumn("_x", F.round(F.try_divide(F.lag("close", skip).over(w), F.lag("close", lookback).over(w)) - 1, 9))
    d = d.withColumn("_r", pct_rank("_x"))
    return _edges(d, I.ge(F.col("_r"), F.lit(1 - float(quantile))))


def dual_momentum(p: DataFrame, lookback: int = 252, quantile: float = 0.5, threshold: float = 0.0) -> DataFrame:
    w = I.by_symbol()
    d = p.withColumn("_x", F.round(F.try_divide(F.col("close"), F.lag("close", lookback).over(w)) - 1, 9)).withColumn("_r", pct_rank("_x"))
    return _edges(d, I.ge(F.col("_r"), F.lit(1 - float(quantile))) & I.gt(F.col("_x"), F.lit(float(threshold))))


def kalman_trend(p: DataFrame, delta: float = 1e-4, meas_var: float = 1e-3) -> DataFrame:
    d = I.sequential(p, [("_k", "kalman", "close", (delta, meas_var))])
    return _edges(d, I.gt(F.col("_k"), F.lit(0.0)))


def regime_filter(p: DataFrame, trend_lookback: int = 100, n_states: int = 3, feature_window: int = 21, regime_train_window: int = 756) -> DataFrame:
    """Above the average and not in a risk-off regime; the regimes are learned on the first bars alone, which aren't gated."""
    from candlewright.operators import regime

    w = I.by_symbol()
    bench = p.groupBy("date").agg(F.avg("close").alias("close"))
    labels = regime.causal_labels(bench, n_states, feature_window, regime_train_window)
    d = p.withColumn("_m", I.sma(F.col("close"), trend_lookback, w)).join(labels.select("date", "risk_off"), "date", "left")
    return _edges(d, I.gt(F.col("close"), F.col("_m")) & ~F.coalesce("risk_off", F.lit(False)))


def buy_and_hold(p: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy("symbol"))
    return _out(p.withColumn("_d", first), F.coalesce(F.col("date") == F.col("_d"), F.lit(False)), F.lit(False))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (sma_crossover, ema_crossover, macd, donchian_breakout, atr_breakout, mean_reversion, bollinger_bands, rsi_2, momentum_12_1, dual_momentum, kalman_trend, regime_filter, buy_and_hold)
}
#: The grid that a sweep takes where none is given; a strategy without parameters has none.
GRIDS: dict[str, dict[str, list]] = {
    "sma_crossover": dict(slow=[100, 150, 200], fast=[5, 10, 20, 50]),
    "ema_crossover": dict(slow=[26, 50, 100], fast=[8, 12, 20]),
    "macd": dict(signal=[9], slow=[21, 26], fast=[8, 12]),
    "donchian_breakout": dict(exit_period=[10, 20], entry_period=[20, 40, 55]),
    "atr_breakout": dict(k=[1.5, 2.0, 3.0], lookback=[14, 20, 30]),
    "mean_reversion": dict(exit_z=[0.0], entry_z=[1.5, 2.0, 2.5], lookback=[10, 20, 30]),
    "bollinger_bands": dict(k=[1.5, 2.0, 2.5], lookback=[10, 20, 30]),
    "rsi_2": dict(trend_sma=[200], exit_rsi=[65.0, 70.0], entry_rsi=[5.0, 10.0, 15.0], period=[2, 3]),
    "momentum_12_1": dict(quantile=[0.2, 0.3], skip=[21], lookback=[126, 252]),
    "dual_momentum": dict(threshold=[0.0], quantile=[0.3, 0.5], lookback=[126, 252]),
    "kalman_trend": dict(meas_var=[1e-3], delta=[1e-5, 1e-4, 1e-3]),
    "regime_filter": dict(feature_window=[21, 63], trend_lookback=[50, 100, 200]),
    "buy_and_hold": {},
}


def load_strategy(path: str) -> Callable[..., DataFrame]:
    """A strategy by registered name, or "module:function" of one's own (panel, **params) -> (symbol, date, entry, exit)."""
    if path in STRATEGIES:
        return STRATEGIES[path]
    module, _, name = path.partition(":")
    if not name:
        raise KeyError(f"no strategy {path}")
    return getattr(importlib.import_module(module), name)
