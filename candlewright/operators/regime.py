"""Market regimes: features, Gaussian hidden Markov model, labels, diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.shipping import ensure

LADDERS = {
    1: ["neutral"], 2: ["bull", "bear"], 3: ["bull", "neutral", "bear"],
    4: ["strong_bull", "bull", "bear", "crisis"], 5: ["strong_bull", "bull", "neutral", "bear", "crisis"],
}
FLOOR = 1e-6


def features(bench: DataFrame, window: int = 21, periods_per_year: float = 252.0) -> DataFrame:
    """(date, trend, vol) of an equal-weight benchmark (date, close): mean and sample deviation of log returns, annualised."""
    w = Window.orderBy("date")  # one row a date
    f = w.rowsBetween(-(window - 1), 0)
    d = bench.withColumn("lr", F.when(F.col("close") > 0, F.ln("close"))).withColumn("lr", F.col("lr") - F.lag("lr").over(w))
    full = F.count("lr").over(f) == window
    d = d.select("date", F.when(full, F.avg("lr").over(f) * periods_per_year).alias("trend"), F.when(full, F.stddev_samp("lr").over(f) * math.sqrt(periods_per_year)).alias("vol"))
    return d.where("trend is not null and vol is not null")


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class GaussianHMM:
    """Diagonal Gaussian emissions, Baum-Welch in log space from a quantile split of the first feature."""

    def __init__(self, n_states: int = 3, n_iter: int = 50, tol: float = 1e-4, stay: float = 0.9):
        self.k, self.n_iter, self.tol, self.stay = n_states, n_iter, tol, stay

    def _emit(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None, :] - self.means) ** 2 / self.vars
        return -0.5 * (z + np.log(2 * np.pi * self.vars)).sum(-1)

    def _forward(self, e: np.ndarray) -> np.ndarray:
        a = np.empty_like(e)
        a[0] = self.log_start + e[0]
        for t in range(1, len(e)):
            a[t] = e[t] + _lse(a[t - 1][:, None] + self.log_trans, 0)
        return a

    def _backward(self, e: np.ndarray) -> np.ndarray:
        b = np.zeros_like(e)
        for t in range(len(e) - 2, -1, -1):
            b[t] = _lse(self.log_trans + e[t + 1] + b[t + 1], 1)
        return b

    def fit(self, x: np.ndarray) -> GaussianHMM:
        x = np.asarray(x, dtype=float)
        if len(x) < 10 * self.k:
            raise ValueError(f"{self.k} states need {10 * self.k} observations, there are {len(x)}")
        floor = np.maximum(FLOOR, 1e-3 * x.var(0))
        parts = np.array_split(np.argsort(x[:, 0], kind="stable"), self.k)
        self.means = np.array([x[p].mean(0) for p in parts])
        self.vars = np.array([np.maximum(x[p].var(0), floor) for p in parts])
        self.log_start = np.full(self.k, -math.log(self.k))
        t = np.full((self.k, self.k), (1 - self.stay) / max(self.k - 1, 1))
        np.fill_diagonal(t, self.stay if self.k > 1 else 1.0)
        self.log_trans = np.log(t)
        last = -np.inf
        for _ in range(self.n_iter):
            e = self._emit(x)
            a, b = self._forward(e), self._backward(e)
            ll = float(_lse(a[-1], 0))
            g = np.exp(a + b - ll)
            xi = np.zeros((self.k, self.k))
            for i in range(len(x) - 1):
                xi += np.exp(a[i][:, None] + self.log_trans + e[i + 1] + b[i + 1] - ll)
            n = g.sum(0) + 1e-12
            self.log_start = np.log(g[0] + 1e-12) - math.log((g[0] + 1e-12).sum())
            self.log_trans = np.log(xi + 1e-12) - np.log((xi + 1e-12).sum(1, keepdims=True))
            self.means = (g.T @ x) / n[:, None]
            self.vars = np.maximum((g.T @ x**2) / n[:, None] - self.means**2, floor)
            if abs(ll - last) < self.tol * max(1.0, abs(ll)):
                break
            last = ll
        return self

    def score(self, x: np.ndarray) -> float:
        return float(_lse(self._forward(self._emit(np.asarray(x, dtype=float)))[-1], 0))

    def predict_proba(self, x: np.ndarray, mode: str = "filter") -> np.ndarray:
        """State probabilities; ``filter`` uses nothing after each row, ``smooth`` all rows."""
        e = self._emit(np.asarray(x, dtype=float))
        a = self._forward(e)
        z = a if mode == "filter" else a + self._backward(e)
        return np.exp(z - _lse(z, 1)[:, None])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Most likely path."""
        e = self._emit(np.asarray(x, dtype=float))
        d, back = self.log_start + e[0], np.zeros(e.shape, int)
        for t in range(1, len(e)):
            s = d[:, None] + self.log_trans
            back[t] = s.argmax(0)
            d = s.max(0) + e[t]
        path = np.empty(len(e), int)
        path[-1] = d.argmax()
        for t in range(len(e) - 2, -1, -1):
            path[t] = back[t + 1, path[t + 1]]
        return path


def name_states(m: GaussianHMM) -> list[str]:
    """Label of each state: best by trend less volatility (each standardised across states) first."""
    z = lambda v: (v - v.mean()) / (v.std() if v.std() > 1e-12 else 1.0)
    rank = np.argsort(-(z(m.means[:, 0]) - z(m.means[:, 1])), kind="stable")
    out = [""] * m.k
    for place, s in enumerate(rank):
        out[s] = LADDERS[m.k][place]
    return out


def risk_off(n_states: int) -> set[str]:
    """The lower half of the ladder."""
    ladder = LADDERS[n_states]
    return set(ladder[-(n_states // 2) :]) if n_states > 1 else set()


def label_series(feats: DataFrame, n_states: int = 3, train_rows: int | None = None, mode: str = "filter") -> DataFrame:
    """(date, state, label, confidence) of a features table; one small series, fitted in one task on its first ``train_rows``."""

    def run(batches):
        pdf = pd.concat(list(batches)).sort_values("date")
        if len(pdf) == 0:
            return
        x = pdf[["trend", "vol"]].to_numpy(dtype=float)
        m = GaussianHMM(n_states).fit(x[:train_rows] if train_rows else x)
        p = m.predict_proba(x, mode)
        s = p.argmax(1)
        names = name_states(m)
        yield pd.DataFrame({"date": pdf["date"].to_numpy(), "state": s, "label": [names[i] for i in s], "confidence": p.max(1)})

    ensure(feats.sparkSession)
    return feats.coalesce(1).mapInPandas(run, "date timestamp_ntz, state int, label string, confidence double")


def causal_labels(bench: DataFrame, n_states: int, window: int, train_rows: int) -> DataFrame:
    """(date, label, risk_off): regimes learned on the features of the first ``train_rows`` bars; no risk-off within them.

    A series too short to fit gives no rows, so nothing is gated.
    """
    w = Window.orderBy("date")  # one row a date
    f = features(bench, window)
    numbered = bench.select("date", F.row_number().over(w).alias("i"))
    bad = risk_off(n_states)

    def run(batches):
        pdf = pd.concat(list(batches)).sort_values("date")
        train = pdf[pdf["i"] <= train_rows]
        try:
            m = GaussianHMM(n_states).fit(train[["trend", "vol"]].to_numpy(dtype=float))
        except ValueError:
            return
        names = name_states(m)
        s = m.predict_proba(pdf[["trend", "vol"]].to_numpy(dtype=float)).argmax(1)
        lab = [names[i] for i in s]
        yield pd.DataFrame({"date": pdf["date"].to_numpy(), "label": lab, "risk_off": [x in bad and i > train_rows for x, i in zip(lab, pdf["i"], strict=True)]})

    ensure(bench.sparkSession)
    return f.join(numbered, "date").coalesce(1).mapInPandas(run, "date timestamp_ntz, label string, risk_off boolean")


def conditioned_metrics(equity: DataFrame, labels: DataFrame, periods_per_year: float = 252.0, least: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Figures of the returns within each label's own rows, for each group of ``keys`` (such as run_id): (*keys, label, n_days, sharpe, sortino, cagr, vol, max_drawdown, time_under_water)."""
    w = Window.partitionBy(*keys).orderBy("date")
    r = equity.select(*keys, "date", (F.try_divide("value", F.lag("value").over(w)) - 1).alias("r")).where("r is not null").join(labels.select("date", "label"), "date")
    own = Window.partitionBy(*keys, "label").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = r.withColumn("eq", F.product(1 + F.col("r")).over(own)).withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(own), F.lit(1.0)) - 1)
    root, p = math.sqrt(periods_per_year), periods_per_year
    neg = F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    a = d.groupBy(*keys, "label").agg(
        F.count("*").alias("n_days"), z(F.when(F.stddev_samp("r") > 1e-12, F.avg("r") / F.stddev_samp("r") * root)).alias("sharpe"), z(F.when(neg > 1e-12, F.avg("r") / neg * root)).alias("sortino"),
        F.when(F.product(1 + F.col("r")) > 0, F.pow(F.product(1 + F.col("r")), F.lit(p) / F.count("*")) - 1).otherwise(F.lit(-1.0)).alias("cagr"), z(F.stddev_samp("r") * root).alias("vol"),
        F.min("dd").alias("max_drawdown"), F.avg((F.col("dd") < -1e-12).cast("double")).alias("time_under_water"),
    )
    return a.where(F.col("n_days") >= least)


def runs(labels: DataFrame) -> DataFrame:
    """(label, run, start, end, length): stretches of equal labels."""
    w = Window.orderBy("date")  # one row a date
    d = labels.withColumn("_n", (F.col("label") != F.lag("label").over(w)).cast("int")).withColumn("run", F.sum(F.coalesce("_n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("label", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length"))


def run_diagnostics(labels: DataFrame, flicker: int = 2) -> DataFrame:
    """(label, n_runs, occupancy, mean_length, flicker_share): how the label persists; runs up to ``flicker`` long flicker."""
    r = runs(labels)
    tot = Window.partitionBy(F.lit(1))
    a = r.groupBy("label").agg(F.count("*").alias("n_runs"), F.sum("length").alias("n"), F.avg("length").alias("mean_length"), F.avg((F.col("length") <= flicker).cast("double")).alias("flicker_share"))
    return a.select("label", "n_runs", (F.col("n") / F.sum("n").over(tot)).alias("occupancy"), "mean_length", "flicker_share")


def transition_figures(trans: np.ndarray, occupancy: np.ndarray) -> dict:
    """Dwell times, stationary shares, second eigenvalue and the distance between stationary and observed shares."""
    vals, vecs = np.linalg.eig(trans.T)
    pi = np.real(vecs[:, np.argmin(np.abs(vals - 1))])
    pi = np.abs(pi) / np.abs(pi).sum()
    mod = np.sort(np.abs(vals))[::-1]
    return {"dwell": (1 / np.maximum(1 - np.diag(trans), 1e-12)).tolist(), "stationary": pi.tolist(), "lambda2": float(mod[1]) if len(mod) > 1 else 0.0, "tv_distance": float(0.5 * np.abs(pi - occupancy).sum())}


def adf_test(x: np.ndarray) -> dict:
    """Augmented Dickey-Fuller with constant, Schwert lags, finite-sample critical values at 1, 5 and 10 percent."""
    x = np.asarray(x, dtype=float)
    x = x[np.isfinite(x)]
    if len(x) < 25:
        raise ValueError("25 observations at least")
    lags = min(int(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
    d = np.diff(x)
    y = d[lags:]
    cols = [np.ones(len(y)), x[lags:-1], *(d[lags - i : -i] for i in range(1, lags + 1))]
    m = np.column_stack(cols)
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    e = y - m @ b
    s2 = float(e @ e) / max(len(y) - m.shape[1], 1)
    se = math.sqrt(max(s2 * np.linalg.pinv(m.T @ m)[1, 1], 0))
    n = len(y)
    crit = {q: a + c1 / n + c2 / n**2 for q, a, c1, c2 in (("1%", -3.43035, -6.5393, -16.786), ("5%", -2.86154, -2.8903, -4.234), ("10%", -2.56677, -1.5384, -2.809))}
    stat = float(b[1] / se) if se > 0 else 0.0
    return {"statistic": stat, "n_obs": n, "n_lags": lags, "critical": crit, "rejects": {q: stat < c for q, c in crit.items()}}


def refit_stability(x: np.ndarray, n_states: int = 3, share: float = 0.8) -> float:
    """Share of rows of the first part on which a fit of that part and a fit of all rows agree."""
    cut = int(len(x) * share)
    a, b = GaussianHMM(n_states).fit(x[:cut]), GaussianHMM(n_states).fit(x)
    la, lb = name_states(a), name_states(b)
    pa, pb = (m.predict_proba(x[:cut]).argmax(1) for m in (a, b))
    return float(np.mean([la[i] == lb[j] for i, j in zip(pa, pb, strict=True)]))


def diagnostics(feats: np.ndarray, n_states: int = 3) -> dict:
    """All diagnostics of one features matrix [rows, (trend, vol)] and warnings past their bounds."""
    m = GaussianHMM(n_states).fit(feats)
    path = m.predict_proba(feats).argmax(1)
    occ = np.bincount(path, minlength=n_states) / len(path)
    t = transition_figures(np.exp(m.log_trans), occ)
    switches = int((np.diff(path) != 0).sum())
    lens = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(path) != 0, [True]])))
    out = {"adf_trend": adf_test(feats[:, 0]), "adf_vol": adf_test(feats[:, 1]), "switches": switches, "flicker": float((lens <= 2).mean()), "agreement": refit_stability(feats, n_states), **t}
    out["warnings"] = [w for w, bad in (("flicker", out["flicker"] > 0.25), ("unstable", out["agreement"] < 0.8), ("drift", out["tv_distance"] > 0.25)) if bad]
    return out


def current(labels: DataFrame) -> DataFrame:
    """The newest row of a label series."""
    return labels.orderBy(F.desc("date")).limit(1)
