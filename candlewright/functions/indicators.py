"""Indicators as window expressions over a dense panel (partition symbol, order date); a window with a gap gives NULL."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from candlewright.shipping import ensure

#: Share of the larger of two values within which they count as equal; sums of floats differ by engine in the last bits.
COMPARE = 1e-12


def by_symbol(keys: Iterable[str] = ("symbol",)):
    return Window.partitionBy(*keys).orderBy("date")


def full(agg, x: Column, n: int, w, end: int = 0) -> Column:
    """``agg`` over the n rows that end ``-end`` rows before this one, NULL unless all n have a value."""
    frame = w.rowsBetween(end - n + 1, end)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def sma(x: Column, n: int, w) -> Column:
    return full(F.avg, x, n, w)


def rolling_std(x: Column, n: int, w) -> Column:
    return full(F.stddev_pop, x, n, w)


def rolling_max(x: Column, n: int, w, end: int = 0) -> Column:
    return full(F.max, x, n, w, end)


def rolling_min(x: Column, n: int, w, end: int = 0) -> Column:
    return full(F.min, x, n, w, end)


def zscore(x: Column, n: int, w) -> Column:
    """Deviation from the window's mean in population standard deviations; NULL where that is 0."""
    s = rolling_std(x, n, w)
    return (x - sma(x, n, w)) / F.when(s > 1e-12, s)


def gt(a: Column, b: Column) -> Column:
    """a > b by more than the last bits, whatever the size of the values; a missing value gives false."""
    return F.coalesce(a - b > F.greatest(F.abs(a), F.abs(b)) * COMPARE, F.lit(False))


def ge(a: Column, b: Column) -> Column:
    return F.coalesce(a - b >= F.greatest(F.abs(a), F.abs(b)) * -COMPARE, F.lit(False))


def lt(a: Column, b: Column) -> Column:
    return gt(b, a)


def le(a: Column, b: Column) -> Column:
    return ge(b, a)


def rising(state: Column, w) -> Column:
    return state & ~F.coalesce(F.lag(state).over(w), F.lit(False))


def falling(state: Column, w) -> Column:
    return ~state & F.coalesce(F.lag(state).over(w), F.lit(False))


def ewm(x: np.ndarray, alpha: float, min_periods: int = 0) -> np.ndarray:
    """Exponential mean seeded by the first value; weights decay over gaps; carried over gaps."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean().to_numpy()


def wilder_rsi(close: np.ndarray, period: int) -> np.ndarray:
    """Relative strength from exponential means of gains and losses (1/period); NaN where there is no loss."""
    d = np.diff(close, prepend=np.nan)
    gain, loss = (ewm(np.where(np.isnan(d), np.nan, np.maximum(s * d, 0)), 1 / period, period) for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 100 - 100 / (1 + gain / np.where(np.abs(loss) < 1e-12, np.nan, loss))


def kalman_slope(close: np.ndarray, delta: float = 1e-4, r: float = 1e-3) -> np.ndarray:
    """Slope of a local linear trend on the log price; leading gaps are skipped, later ones only predicted over.

    The state noise is delta / (1 - delta) times the measurement variance r, on level and slope alike.
    """
    q = (delta / (1 - delta) if 0 < delta < 1 else delta) * r
    out = np.full(len(close), np.nan)
    ok = np.isfinite(close) & (np.nan_to_num(close) > 0)
    if not ok.any():
        return out
    first = int(np.argmax(ok))
    level, slope = float(np.log(close[first])), 0.0
    p00, p01, p11 = 1.0, 0.0, 1.0
    out[first] = slope
    for t in range(first + 1, len(close)):
        level += slope
        p00, p01, p11 = p00 + 2 * p01 + p11 + q, p01 + p11, p11 + q
        if ok[t]:
            s = p00 + r
            k0, k1 = p00 / s, p01 / s
            e = float(np.log(close[t])) - level
            level, slope = level + k0 * e, slope + k1 * e
            p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
        out[t] = slope
    return out


KERNELS = {
    "ema": lambda x, p: ewm(x, 2.0 / (p + 1)),
    "wilder": lambda x, p: ewm(x, 1.0 / p, int(p)),
    "rsi": lambda x, p: wilder_rsi(x, int(p)),
    "kalman": lambda x, p: kalman_slope(x, *p),
}


def sequential(df: DataFrame, jobs: list[tuple[str, str, str, object]], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Columns that need the previous result: jobs of (new column, kernel, input column, parameter), one pass a symbol.

    One shuffle on the keys whatever the number of jobs; results are NULL where undefined.
    """
    ensure(df.sparkSession)
    schema = StructType([*df.schema.fields, *(StructField(new, DoubleType()) for new, *_ in jobs)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        for new, kernel, col, p in jobs:
            y = KERNELS[kernel](pdf[col].to_numpy(dtype=float, na_value=np.nan), p)
            pdf[new] = pd.array(np.where(np.isnan(y), None, y), dtype="Float64") if np.isnan(y).any() else y
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)
