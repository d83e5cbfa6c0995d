"""Portfolio simulation: lagged signals, held state, shared and independent accounts, orders, trades, metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.indicators import by_symbol

from candlewright.shipping import ensure

PROFIT_FACTOR_CAP = 1e6


@dataclass(frozen=True)
class Config:
    """Account settings; costs in basis points a side."""

    cash: float = 100_000.0
    fees_bps: float = 2.0
    slippage_bps: float = 5.0
    size: float = 0.95
    capital_model: str = "shared"
    periods_per_year: float = 252.0
    execution_lag: int = 1


def lag_signals(sig: DataFrame, lag: int = 1, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Signals take effect ``lag`` bars later; 0 or less leaves them."""
    if lag <= 0:
        return sig
    w = by_symbol(keys)
    return sig.withColumns({c: F.coalesce(F.lag(c, lag).over(w), F.lit(False)) for c in ("entry", "exit")})


def held(entry: Column, exit_: Column, w) -> Column:
    """Held state: an exit beats an entry on the same bar, the state carries on, and it begins flat."""
    mark = F.when(exit_, 0).when(entry, 1)
    return F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1


def held_state(sig: DataFrame, lag: int = 1) -> DataFrame:
    """(symbol, date, entry, exit, held): the signals as given, held after the lag."""
    w = by_symbol()
    le, lx = (F.coalesce(F.lag(c, lag).over(w), F.lit(False)) if lag > 0 else F.col(c) for c in ("entry", "exit"))
    d = sig.withColumns({"_le": le, "_lx": lx})
    return d.withColumn("held", held(F.col("_le"), F.col("_lx"), w)).drop("_le", "_lx")


def target_sizes(h: DataFrame, size: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """(…, target): on a date when any symbol's membership changes, size / number held for each held one and 0 for leavers; else NULL."""
    w = by_symbol((*keys, "symbol"))
    d = h.withColumn("_was", F.coalesce(F.lag("held").over(w), F.lit(False)))
    at = Window.partitionBy(*keys, "date")
    k = F.sum(F.col("held").cast("int")).over(at)
    changed = F.max((F.col("held") != F.col("_was")).cast("int")).over(at)
    target = F.when((changed == 1) & F.col("held"), F.lit(size) / k).when((changed == 1) & F.col("_was") & ~F.col("held"), F.lit(0.0))
    return d.withColumn("target", target).drop("_was")


def fold_shared(close: np.ndarray, target: np.ndarray, cash: float, fee: np.ndarray, slip: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """One cash pool: (account value by bar, orders (bar, column, size, price, fee)).

    close, target: [bars, columns]; NaN target: no order; no price: no order, the last price values the position. On a bar with
    orders the targets are shares of the account's value before trading; sells come first, and buys are scaled by what cash
    allows. A buy fills at close * (1 + slip), a sell at close * (1 - slip); fees are a share of the traded value.
    """
    n, m = close.shape
    shares, last = np.zeros(m), np.full(m, np.nan)
    value, orders = np.empty(n), []
    for t in range(n):
        px = close[t]
        ok = np.isfinite(px)
        last = np.where(ok, px, last)
        want = np.isfinite(target[t]) & ok & (px > 0)
        if want.any():
            v = cash + float(np.nansum(shares * np.where(np.isfinite(last), last, 0.0)))
            goal = np.where(want, target[t] * v / np.where(want, px, 1.0), shares)
            delta = goal - shares
            for j in np.flatnonzero(want & (delta < -1e-12)):
                q, p = -delta[j], px[j] * (1 - slip[j])
                f = q * p * fee[j]
                cash += q * p - f
                shares[j] -= q
                orders.append((t, j, -q, p, f))
            for j in np.flatnonzero(want & (delta > 1e-12)):
                p = px[j] * (1 + slip[j])
                q = min(delta[j], max(cash, 0.0) / (p * (1 + fee[j])))
                if q > 1e-12:
                    f = q * p * fee[j]
                    cash -= q * p + f
                    shares[j] += q
                    orders.append((t, j, q, p, f))
        value[t] = cash + float(np.nansum(shares * np.where(np.isfinite(last), last, 0.0)))
    return value, orders


def fold_single(close: np.ndarray, entry: np.ndarray, exit_: np.ndarray, cash: float, size: float, fee: float, slip: float) -> tuple[np.ndarray, list[tuple]]:
    """One account, one symbol: entries spend ``size`` of the cash when flat, exits sell all; an exit beats an entry on the same bar."""
    shares, last, value, orders = 0.0, np.nan, np.empty(len(close)), []
    for t, px in enumerate(close):
        if np.isfinite(px):
            last = px
            if exit_[t]:
                if shares > 0:
                    p = px * (1 - slip)
                    f = shares * p * fee
                    cash += shares * p - f
                    orders.append((t, 0, -shares, p, f))
                    shares = 0.0
            elif entry[t] and shares == 0 and px > 0:
                p = px * (1 + slip)
                shares = size * cash / (p * (1 + fee))
                f = shares * p * fee
                cash -= shares * p + f
                orders.append((t, 0, shares, p, f))
        value[t] = cash + (shares * last if shares else 0.0)
    return value, orders


def trades_of(orders: list[tuple], last_price: dict[int, float], n_bars: int) -> list[tuple]:
    """Trade records (column, entry bar, exit bar, return, open) of orders in time order.

    Each sell closes a record at the position's average entry cost, in proportion to what it sells; at the end each held column has
    one open record valued at its last price.
    """
    pos: dict[int, list[float]] = {}
    out = []
    for t, j, q, p, f in orders:
        if q > 0:
            have = pos.setdefault(j, [0.0, 0.0, t])
            if have[0] == 0:
                have[2] = t
            have[0] += q
            have[1] += q * p + f
        else:
            have = pos[j]
            part = min(1.0, -q / have[0])
            cost = have[1] * part
            out.append((j, int(have[2]), t, (-q * p - f) / cost - 1, False))
            have[0] += q
            have[1] -= cost
            if have[0] <= 1e-9:
                have[0] = have[1] = 0.0
    for j, (q, cost, t) in sorted(pos.items()):
        if q > 0:
            out.append((j, int(t), n_bars - 1, q * last_price[j] / cost - 1, True))
    return out


def _simulate(pdf: pd.DataFrame, keys: list[str], c: Config, what: str) -> pd.DataFrame:
    """All accounts of one run: equity, orders or trades."""
    first = {k: pdf[k].iloc[0] for k in keys}
    wide = pdf.pivot(index="date", columns="symbol", values="close")
    symbols, dates = list(wide.columns), wide.index
    close = wide.to_numpy(dtype=float)
    fee = pdf.groupby("symbol")["fee"].first().reindex(symbols).to_numpy(dtype=float) if "fee" in pdf else np.full(len(symbols), c.fees_bps / 1e4)
    slip = pdf.groupby("symbol")["slip"].first().reindex(symbols).to_numpy(dtype=float) if "slip" in pdf else np.full(len(symbols), c.slippage_bps / 1e4)
    if c.capital_model == "shared" and len(symbols) > 1:
        target = pdf.pivot(index="date", columns="symbol", values="target").to_numpy(dtype=float)
        value, orders = fold_shared(close, target, c.cash, fee, slip)
    else:
        e, x = (pdf.pivot(index="date", columns="symbol", values=k).to_numpy(dtype=bool) for k in ("entry", "exit"))
        runs = [fold_single(close[:, j], e[:, j], x[:, j], c.cash, c.size, fee[j], slip[j]) for j in range(len(symbols))]
        value = np.mean([v for v, _ in runs], axis=0)
        orders = sorted((t, j, q, p, f) for j, (_, o) in enumerate(runs) for t, _, q, p, f in o)
    if what == "equity":
        return pd.DataFrame({**first, "date": dates, "value": value})
    if what == "orders":
        rows = [(symbols[j], dates[t], "BUY" if q > 0 else "SELL", abs(q), p, f) for t, j, q, p, f in orders]
        return pd.DataFrame(rows, columns=["symbol", "date", "side", "size", "price", "fee"]).assign(**first)[[*keys, "symbol", "date", "side", "size", "price", "fee"]]
    last = {j: close[np.isfinite(close[:, j]), j][-1] for j in range(len(symbols)) if np.isfinite(close[:, j]).any()}
    rows = [(symbols[j], dates[a], dates[b], r, o) for j, a, b, r, o in trades_of(orders, last, len(dates))]
    return pd.DataFrame(rows, columns=["symbol", "entry_date", "exit_date", "ret", "is_open"]).assign(**first)[[*keys, "symbol", "entry_date", "exit_date", "ret", "is_open"]]


_SCHEMA = {
    "equity": "date timestamp_ntz, value double",
    "orders": "symbol string, date timestamp_ntz, side string, size double, price double, fee double",
    "trades": "symbol string, entry_date timestamp_ntz, exit_date timestamp_ntz, ret double, is_open boolean",
}


def simulate(signals: DataFrame, config: Config | None = None, what: str = "equity", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Run every account of (keys..., symbol, date, close, entry, exit[, fee, slip]): one group a run, one shuffle.

    Signals are lagged first. Runs are independent, so a grid or a fold is one more key, and the cluster's parallelism is the
    number of runs. ``what``: equity, orders or trades.
    """
    ensure(signals.sparkSession)
    c = config or Config()
    s = lag_signals(signals, c.execution_lag, (*keys, "symbol"))
    h = s.withColumn("held", held(F.col("entry"), F.col("exit"), by_symbol((*keys, "symbol"))))
    t = target_sizes(h, c.size, keys).drop("held")
    schema = ", ".join([*(f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys), _SCHEMA[what]])
    names = list(keys)
    return t.groupBy(*keys).applyInPandas(lambda pdf: _simulate(pdf, names, c, what), schema)


def metrics(equity: DataFrame, periods_per_year: float = 252.0, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The eight metrics of each run's account value, by windows and one aggregate; what isn't finite or defined is 0."""
    w = Window.partitionBy(*keys).orderBy("date")
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = equity.withColumns({"r": F.try_divide("value", F.lag("value").over(w)) - 1, "dd": F.try_divide("value", peak) - 1})
    a = d.groupBy(*keys).agg(
        F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"), F.min("date").alias("d0"), F.max("date").alias("d1"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"),
        F.min("dd").alias("mdd"), F.avg(F.when(F.col("dd") < 0, F.col("dd"))).alias("add"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"),
    )
    root = F.sqrt(F.lit(float(periods_per_year)))
    years = F.greatest(F.date_diff("d1", "d0") / 365.25, F.lit(1e-9))
    growth = F.try_divide("v1", "v0")
    cagr = F.when(growth > 0, F.pow(growth, 1 / years) - 1)
    fin = lambda x: F.coalesce(F.when(F.abs(x) < 1e300, x), F.lit(0.0))
    a = a.withColumns({"cagr": fin(cagr), "max_drawdown": fin(F.col("mdd"))})
    return a.select(
        *keys, fin(growth - 1).alias("total_return"), "cagr",
        fin(F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std") * root)).alias("sharpe"),
        fin(F.when(F.col("down") > 1e-12, F.col("mean") / F.col("down") * root)).alias("sortino"),
        "max_drawdown", fin(F.col("add")).alias("avg_drawdown"), fin(F.col("ulcer")).alias("ulcer_index"),
        fin(F.when(F.abs("max_drawdown") > 1e-9, F.col("cagr") / F.abs("max_drawdown"))).alias("calmar"),
    )


def trade_metrics(trades: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Count, win rate, averages, profit factor (capped) and expectancy; open trades count."""
    win, lose = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") < 0, F.col("ret"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    factor = F.when(z(F.sum(lose)) < 0, F.least(z(F.sum(win)) / -F.sum(lose), F.lit(PROFIT_FACTOR_CAP))).when(z(F.sum(win)) > 0, F.lit(PROFIT_FACTOR_CAP)).otherwise(F.lit(0.0))
    return trades.groupBy(*keys).agg(
        F.count("ret").alias("n_trades"), z(F.avg((F.col("ret") > 0).cast("double"))).alias("win_rate"), z(F.avg("ret")).alias("avg_trade_return"),
        z(F.avg(win)).alias("avg_winner"), z(F.avg(lose)).alias("avg_loser"), factor.alias("profit_factor"), z(F.avg("ret")).alias("expectancy"),
    )


def turnover(orders: DataFrame, equity: DataFrame, periods_per_year: float = 252.0, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Traded value over mean account value a year; NULL where the account's mean isn't positive."""
    v = equity.groupBy(*keys).agg(F.avg("value").alias("nav"), (F.count("value") / periods_per_year).alias("years"))
    o = orders.groupBy(*keys).agg(F.sum(F.abs(F.col("size") * F.col("price"))).alias("traded"), F.count("*").alias("n_orders"))
    j = v.join(o, list(keys), "left")
    return j.select(*keys, F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.when(F.col("nav") > 0, F.coalesce("traded", F.lit(0.0)) / F.col("nav") / F.greatest("years", F.lit(1e-9))).alias("turnover_annual"))
