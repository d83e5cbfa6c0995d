"""Closed forms, hand-computed accounts, causality, validation and known-truth recovery."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.functions import indicators as I
from candlewright.operators import book as K
from candlewright.operators import load as L
from candlewright.operators import portfolio as O
from candlewright.operators import prepare as P
from candlewright.operators import regime as R
from candlewright.operators import simulate as M
from candlewright.operators import stats as T
from candlewright.operators import strategies as S
from candlewright.operators import sweep as W
from candlewright.plans import graph as G
from candlewright.plans import notes as N
from candlewright.sources import bars as B
from candlewright.sources import parsers as X

FREE = {"fees_bps": 0.0, "slippage_bps": 0.0, "execution_lag": 0}
BARS = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double"


def signals(spark, prices, entries, exits):
    rows = []
    for s, px in prices.items():
        for i, p in enumerate(px):
            rows.append((0, s, datetime.fromisoformat("2021-01-01") + timedelta(days=i), float(p), i in entries.get(s, ()), i in exits.get(s, ())))
    return spark.createDataFrame(rows, "run_id int, symbol string, date timestamp_ntz, close double, entry boolean, exit boolean")


def final(spark, sig, **kw):
    eq = M.simulate(sig, M.Config(**{**FREE, **kw})).orderBy("date").toPandas()
    return eq["value"].iloc[-1] / 100_000


def test_lone_position_that_doubles(spark):
    sig = signals(spark, {"A": [10, 10, 20, 20], "B": [5, 5, 5, 5]}, {"A": [1]}, {})
    assert final(spark, sig) == pytest.approx(1.95)


def test_staggered_independent_accounts_average(spark):
    sig = signals(spark, {"A": [10, 20, 20, 20], "B": [10, 10, 10, 10]}, {"A": [0], "B": [2]}, {"A": [2]})
    assert final(spark, sig, capital_model="independent") == pytest.approx((1.95 + 1) / 2)


def test_three_equal_entrants_share_the_cash(spark):
    sig = signals(spark, {"A": [10, 20], "B": [10, 10], "C": [10, 10]}, dict.fromkeys("ABC", [0]), {})
    assert final(spark, sig) == pytest.approx(1 + 0.95 / 3)


def test_newcomer_rebalances_the_held_ones(spark):
    sig = signals(spark, {"A": [10, 20, 20, 40], "B": [10, 10, 10, 10]}, {"A": [0], "B": [2]}, {})
    v2 = 1.95
    assert final(spark, sig) == pytest.approx(v2 + v2 * 0.95 / 2)


def test_exit_returns_to_cash_and_beats_entry(spark):
    sig = signals(spark, {"A": [10, 20, 5, 1], "B": [1, 1, 1, 1]}, {"A": [0, 1]}, {"A": [1]})
    assert final(spark, sig) == pytest.approx(1.95)


def test_costs_are_taken_on_both_sides(spark):
    sig = signals(spark, {"A": [10, 10, 10]}, {"A": [0]}, {"A": [2]})
    got = final(spark, sig, fees_bps=10.0, slippage_bps=20.0)
    spent, sold = 0.95, 0.95 / (1.002 * 1.001) * 0.998 * 0.999
    assert got == pytest.approx(1 - spent + sold)


def test_lag_moves_fills_one_bar(spark):
    sig = signals(spark, {"A": [10, 20, 40], "B": [1, 1, 1]}, {"A": [0]}, {})
    assert final(spark, sig, execution_lag=1) == pytest.approx(1.95)


def test_missing_price_gives_no_order_and_keeps_value():
    v, o = M.fold_single(np.array([np.nan, 10, np.nan, 20]), np.array([1, 0, 1, 0], bool), np.zeros(4, bool), 100.0, 0.5, 0, 0)
    assert not o and (v == 100).all()
    v, o = M.fold_single(np.array([10, np.nan, 20]), np.array([1, 0, 0], bool), np.zeros(3, bool), 100.0, 0.5, 0, 0)
    assert v.tolist() == [100, 100, 150]


def test_orders_balance_equity(spark):
    rng = np.random.default_rng(1)
    px = {s: (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))).tolist() for s in "ABC"}
    sig = signals(spark, px, {s: sorted(rng.choice(60, 8, replace=False).tolist()) for s in "ABC"}, {s: sorted(rng.choice(60, 8, replace=False).tolist()) for s in "ABC"})
    c = M.Config(execution_lag=0)
    eq = M.simulate(sig, c).orderBy("date").toPandas()
    od = M.simulate(sig, c, "orders").toPandas()
    cash, sh = c.cash, dict.fromkeys("ABC", 0.0)
    for r in od.itertuples():
        q = r.size if r.side == "BUY" else -r.size
        cash -= q * r.price + r.fee
        sh[r.symbol] += q
    assert cash >= -1e-6 and eq["value"].iloc[-1] == pytest.approx(cash + sum(sh[s] * px[s][-1] for s in "ABC"))
    assert M.simulate(sig, c, "trades").where("not is_open").count() > 0


def test_trade_metrics_by_hand(spark):
    t = spark.createDataFrame([(0, 0.1), (0, 0.3), (0, -0.2), (1, 0.5)], "run_id int, ret double")
    got = {r["run_id"]: r for r in M.trade_metrics(t).collect()}
    assert got[0]["n_trades"] == 3 and got[0]["profit_factor"] == pytest.approx(2) and got[0]["avg_winner"] == pytest.approx(0.2)
    assert got[1]["profit_factor"] == M.PROFIT_FACTOR_CAP and got[1]["avg_loser"] == 0


def test_metrics_of_a_flat_account_are_zero(spark):
    eq = spark.createDataFrame([(0, datetime.fromisoformat("2021-01-01") + timedelta(days=i), 100.0) for i in range(5)], "run_id int, date timestamp_ntz, value double")
    r = M.metrics(eq).first()
    assert all(r[c] == 0 for c in r.asDict() if c != "run_id")


# causality
def walk(spark, n=320, symbols=("A", "B", "C"), seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        c = (100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))).tolist()
        for i, x in enumerate(c):
            if s == "B" and i % 37 == 5:
                continue
            rows.append((s, datetime.fromisoformat("2020-01-01") + timedelta(days=i), x, x * 1.01, x * 0.99, x, 1000.0))
    return B.densify(spark.createDataFrame(rows, BARS))


@pytest.mark.parametrize("name", sorted(S.STRATEGIES))
def test_strategies_are_causal(spark, name):
    """Cutting the future off leaves the past's signals as they were."""
    p = walk(spark)
    kw = {"rsi_2": {"trend_sma": 50}, "momentum_12_1": {"lookback": 60, "skip": 5}, "dual_momentum": {"lookback": 60}, "regime_filter": {"regime_train_window": 150, "trend_lookback": 30}, "sma_crossover": {"fast": 5, "slow": 20}}.get(name, {})
    cut = "timestamp_ntz'2020-09-01'"
    full = S.STRATEGIES[name](p, **kw).where(f"date < {cut}")
    part = S.STRATEGIES[name](p.where(f"date < {cut}"), **kw)
    a, b = ({(r["symbol"], r["date"], r["entry"], r["exit"]) for r in x.collect()} for x in (full, part))
    assert a == b and len(a) == 3 * 244
    assert name in ("regime_filter",) or any(r[2] for r in a)


def test_ewm_decays_over_gaps():
    x = np.array([1.0, np.nan, 3.0])
    a = 0.5
    assert I.ewm(x, a).tolist() == pytest.approx([1, 1, (0.25 * 1 + a * 3) / (0.25 + a)])


def test_rsi_has_no_value_without_losses():
    assert np.isnan(I.wilder_rsi(np.arange(10.0), 3)).all()


def test_kalman_follows_a_trend():
    s = I.kalman_slope(np.exp(0.01 * np.arange(300)))
    assert s[0] == 0 and s[-1] == pytest.approx(0.01, rel=0.02)
    assert np.isnan(I.kalman_slope(np.array([np.nan, 0.0, -1.0]))).all()


# graphs
def test_graph_has_31_node_types():
    assert len(G.NODES) == 31 and len(G.catalog()) == 31


@pytest.mark.parametrize("name", ["sma_crossover", "ema_crossover", "bollinger_bands", "rsi_2", "donchian_breakout"])
def test_presets_equal_their_strategies(spark, name):
    kw = {"sma_crossover": {"fast": 5, "slow": 20}, "rsi_2": {"trend_sma": 50}}.get(name, {})
    p = walk(spark, 150)
    a, b = ({tuple(r) for r in x.select("symbol", "date", "entry", "exit").collect()} for x in (G.compile_graph(G.preset(name, **kw), p), S.STRATEGIES[name](p, **kw)))
    assert a == b


def test_graph_errors_are_all_reported():
    bad = {"nodes": [
        {"id": "a", "type": "source.close"}, {"id": "a", "type": "source.close"}, {"id": "1x", "type": "nope"},
        {"id": "s", "type": "indicator.sma", "params": {"window": 2.5, "other": 1}, "inputs": {"series": "zz"}},
        {"id": "n", "type": "logic.not", "inputs": {"a": "a"}},
    ]}
    e = " ".join(G.validate(bad).errors)
    for part in ("repeated id a", "bad id", "unknown type", "integral", "unknown parameter other", "no node zz", "must be bool", "exactly one signal"):
        assert part in e
    with pytest.raises(G.GraphError):
        G.compile_graph(bad, None)


def test_graph_cycle_override_and_pruning(spark):
    loop = {"nodes": [{"id": "x", "type": "logic.not", "inputs": {"a": "y"}}, {"id": "y", "type": "logic.not", "inputs": {"a": "x"}}, {"id": "s", "type": "signal.enter_exit_on_state", "inputs": {"state": "x"}}]}
    assert any("cycle" in e for e in G.validate(loop).errors)
    g = G.override(G.preset("sma_crossover"), {"quick.window": 3})
    assert G.validate(g).params["quick"]["window"] == 3 and G.preset("sma_crossover")["nodes"][1]["params"]["window"] == 20
    with pytest.raises(KeyError):
        G.override(g, {"quick.other": 1})
    g["nodes"].append({"id": "idle", "type": "source.volume"})
    c = G.validate(g)
    assert c.warnings == ["idle isn't used"] and "idle" not in c.order


# validation, statistics
def test_walk_forward_splits_dont_touch():
    for k, a, b, c, d in W.split_walk_forward(1000, 5, 0.6, 20):
        assert a <= b < c - 20 <= c <= d and b - a + 1 >= 40
    with pytest.raises(ValueError):
        W.split_walk_forward(150)
    with pytest.raises(ValueError):
        W.split_walk_forward(300, 4, 0.6, 252)
    assert W.infer_embargo({"a": [10, 20.0, True], "b": [0.5]}) == 20 and W.grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]


def test_walk_forward_and_sweep(spark):
    p = walk(spark, 400)
    folds, oos = W.walk_forward(p, {"fast": [3, 5], "slow": [10, 20]}, 3, 0.5, 20)
    assert folds.count() == 2 and W.stitch(oos).count() == oos.count()
    s = W.sweep(p, "mean_reversion", {"lookback": [5, 10], "entry_z": [1.0], "exit_z": [0.0]}).orderBy("rank").collect()
    assert len(s) == 2 and s[0]["sharpe"] >= s[1]["sharpe"]
    d = W.sweep(p, "sma_crossover", {"fast": [3, 5], "slow": [20]}, metric="max_drawdown").orderBy("rank").collect()
    assert d[0]["max_drawdown"] >= d[1]["max_drawdown"]  # the shallowest first


def test_inverse_normal():
    for p in (1e-9, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.999999):
        assert 0.5 * math.erfc(-T.inv_phi(p) / math.sqrt(2)) == pytest.approx(p, rel=1e-9)
    with pytest.raises(ValueError):
        T.inv_phi(0)


def test_psr_of_normal_returns(spark):
    r = spark.createDataFrame([(0, float(x)) for x in np.random.default_rng(1).normal(0.001, 0.01, 500)] + [(1, 0.1), (1, 0.2)], "run_id int, r double")
    got = {x["run_id"]: x for x in T.probabilistic_sharpe(T.moments(r, ("run_id",))).collect()}
    x = got[0]
    var = (1 - x["skew"] * x["sr_period"] + (x["kurt"] - 1) / 4 * x["sr_period"] ** 2) / 499
    assert x["psr"] == pytest.approx(0.5 * math.erfc(-x["sr_period"] / math.sqrt(var) / math.sqrt(2)))
    assert got[1]["psr"] == 0 and got[1]["p_value"] == 1


def test_more_trials_raise_the_bar():
    assert T.expected_max_sharpe(1, 1.0) == 0 < T.expected_max_sharpe(10, 0.01) < T.expected_max_sharpe(100, 0.01) < T.expected_max_sharpe(100, 0.04)


def test_fdr_by_hand(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, float("nan")), (4, 0.005)], "run_id int, p_value double")
    q = {r["run_id"]: r["q_value"] for r in T.benjamini_hochberg(df).collect()}
    assert q == pytest.approx({4: 0.025, 0: 0.025, 2: 0.05, 1: 0.05, 3: 1.0})


def test_fdr_of_many_tests_goes_over_them_once(spark, tmp_path):
    """Ties, zeros and missing values over many ranges equal the rule written out; a frame to the end of all rows takes the square of them."""
    n = 10_000
    rng = np.random.default_rng(11)
    p = np.where(rng.random(n) < 0.2, rng.random(n) ** 8, np.round(rng.random(n), 3))
    p[:50], p[50:90] = 0.0, np.nan
    df = spark.createDataFrame([(int(i), float(v), f"t{i}") for i, v in enumerate(p)], "run_id int, p_value double, name string").repartition(7)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = T.benjamini_hochberg(df, alpha=0.1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.toPandas().sort_values("run_id")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert "currentrow$(), unboundedfollowing" not in plan.lower() and out.columns == ["run_id", "p_value", "name", "q_value", "significant"]
    x = np.where(np.isnan(p), 1.0, p)
    at = np.lexsort((np.arange(n), x))
    want = np.empty(n)
    want[at] = np.minimum(np.minimum.accumulate((x[at] * n / np.arange(1, n + 1))[::-1])[::-1], 1.0)
    assert got["q_value"].to_numpy().tolist() == want.tolist() and got["significant"].tolist() == (want <= 0.1).tolist()
    assert got["name"].tolist() == [f"t{i}" for i in range(n)]


def test_bootstrap_modes_agree(spark):
    rng = np.random.default_rng(3)
    r = spark.createDataFrame([(0, datetime.fromisoformat("2020-01-01") + timedelta(days=i), float(x)) for i, x in enumerate(rng.normal(0.002, 0.01, 300))], "run_id int, date timestamp_ntz, r double")
    a, b = T.bootstrap(r, 600).first(), T.bootstrap(r, 600, parts=3).first()
    assert a["sharpe"] == b["sharpe"] and abs(a["ci_low"] - b["ci_low"]) < 1 and a["ci_low"] < a["sharpe"] < a["ci_high"] and 0 < a["p_value"] < 0.1
    idx = T.stationary_indices(50, 20, 5, np.random.default_rng(1))
    assert idx.shape == (20, 50) and idx.min() >= 0 and idx.max() < 50 and np.mean((np.diff(idx, axis=1) % 50) == 1) > 0.7


def test_overfit_of_noise_and_skill():
    rng = np.random.default_rng(5)
    noise = rng.normal(0, 0.01, (16, 40, 30))
    f = lambda m: T.overfit_probability(m.sum(1), (m**2).sum(1), 40)
    skill = noise.copy()
    skill[:, :, 3] += 0.01
    assert f(noise)["pbo"] > 0.1 and f(skill)["pbo"] < 0.01 and f(noise)["n_combinations"] == 12870


def test_purged_folds_cover_once(spark):
    n = 57
    f = T.purged_kfold(spark.range(n).select(F.col("id").alias("i")), n, 5, 4, 3).collect()
    assert sorted(r["i"] for r in f if r["part"] == "test") == list(range(n))
    edges = [int(x) for x in np.linspace(0, n, 6)]
    for k in range(5):
        train = {r["i"] for r in f if r["fold"] == k and r["part"] == "train"}
        assert not train & set(range(max(edges[k] - 4, 0), min(edges[k + 1] + 3, n)))


def test_attribution_recovers_betas(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(0, 0.01, (600, 2))
    y = 0.0004 + f @ np.array([0.8, -0.3]) + rng.normal(0, 0.002, 600)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, (b, c)) in enumerate(zip(y, f, strict=True))], "date int, y double, m double, v double")
    a = T.factor_attribution(df, "y", ["m", "v"])
    assert a["exposures"][0][1] == pytest.approx(0.8, abs=0.03) and a["exposures"][1][1] == pytest.approx(-0.3, abs=0.03) and a["r_squared"] > 0.9
    x = np.column_stack([np.ones(600), f])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    s, lags = (x * e[:, None]).T @ (x * e[:, None]), a["hac_lags"]
    for g in range(1, lags + 1):
        m = (x * e[:, None])[g:].T @ (x * e[:, None])[:-g]
        s = s + (1 - g / (lags + 1)) * (m + m.T)
    inv = np.linalg.inv(x.T @ x)
    assert a["exposures"][0][2] == pytest.approx(b[1] / math.sqrt((inv @ s @ inv)[1, 1]), rel=1e-6)


# portfolios, regimes
COV = O.Covariance(["a", "b", "c"], np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.002], [0.0, 0.002, 0.01]]), 500)


def test_portfolios_by_closed_form():
    inv = np.linalg.inv(COV.matrix) @ np.ones(3)
    assert list(O.construct(COV, "min_variance").weights.values()) == pytest.approx((inv / inv.sum()).tolist(), abs=1e-6)
    v = 1 / np.sqrt(np.diag(COV.matrix))
    assert list(O.construct(COV, "inverse_vol").weights.values()) == pytest.approx((v / v.sum()).tolist())
    rp = O.construct(COV, "risk_parity")
    assert [c[2] for c in rp.contributions] == pytest.approx([1 / 3] * 3, abs=1e-8) and rp.converged
    b = O.construct(COV, "risk_parity", budgets={"a": 0.5, "b": 0.25, "c": 0.25})
    assert [c[2] for c in b.contributions] == pytest.approx([0.5, 0.25, 0.25], abs=1e-8)
    assert sum(c[1] for c in rp.contributions) == pytest.approx(rp.volatility)


def test_portfolio_constraints():
    p = O.construct(COV, "min_variance", O.Constraints(max_weight=0.4))
    assert max(p.weights.values()) <= 0.4 + 1e-9 and sum(p.weights.values()) == pytest.approx(1)
    t = O.construct(COV, "equal", O.Constraints(max_turnover=0.2), current={"a": 1.0})
    assert t.turnover == pytest.approx(0.2) and "turnover capped" in t.warnings
    assert O.construct(COV, "equal", O.Constraints(target_volatility=0.05)).leverage < 1
    for bad in (O.Constraints(max_weight=0.2), O.Constraints(min_weight=0.5), O.Constraints(gross=0)):
        with pytest.raises(ValueError):
            bad.check(3)
    assert O.policy({"sizing": "what", "max_weight": 7}) == ("equal", O.Constraints())


def test_shrinkage_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.01, (120, 4))
    df = spark.createDataFrame([(i, f"s{j}", float(x[i, j])) for i in range(120) for j in range(4)], "date int, symbol string, r double")
    c = O.shrunk_covariance(df)
    y = x - x.mean(0)
    s = y.T @ y / 120
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum() / 4
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() / 4 for r in y) / 120**2, d2)
    assert c.shrinkage == pytest.approx(b2 / d2) and np.allclose(c.matrix, b2 / d2 * mu * np.eye(4) + (1 - b2 / d2) * s)


def test_hmm_recovers_regimes_causally():
    rng = np.random.default_rng(9)
    state = np.repeat([0, 1, 0, 1], 150)
    x = np.column_stack([np.where(state == 0, 0.3, -0.4), np.where(state == 0, 0.1, 0.35)]) + rng.normal(0, 0.08, (600, 2))
    m = R.GaussianHMM(2).fit(x)
    names = np.array(R.name_states(m))[m.predict(x)]
    assert np.mean((names == "bull") == (state == 0)) > 0.97
    assert np.allclose(m.predict_proba(x)[:300], m.predict_proba(x[:300]))
    assert np.allclose(m.predict_proba(x, "smooth").sum(1), 1) and m.score(x) > R.GaussianHMM(1).fit(x).score(x)
    assert R.adf_test(rng.normal(size=300))["rejects"]["1%"]
    assert sum(R.adf_test(np.cumsum(np.random.default_rng(i).normal(size=300)))["rejects"]["5%"] for i in range(60)) <= 8
    d = R.diagnostics(x, 2)
    assert d["switches"] <= 12 and d["agreement"] > 0.9
    with pytest.raises(ValueError):
        R.GaussianHMM(3).fit(x[:10])


# preparation and the book
def test_adjustment_anchors_the_last_row(spark):
    rows = [("A", datetime.fromisoformat("2021-01-01"), 100.0, 100.0, 100.0, 100.0, 10.0, 0.0, 1.0), ("A", datetime.fromisoformat("2021-01-02"), 50.0, 50.0, 50.0, 50.0, 20.0, None, 2.0), ("A", datetime.fromisoformat("2021-01-03"), 49.0, 49.0, 49.0, 49.0, 20.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, BARS + ", div_cash double, split_factor double")
    got = [x for r in P.adjust(df).orderBy("date").collect() for x in (r["close"], r["volume"])]
    assert got == pytest.approx([100 * 0.5 * 0.98, 20, 50 * 0.98, 20, 49, 20])


def test_quality_order_and_duplicates(spark):
    d = [datetime.fromisoformat("2021-01-04") + timedelta(days=i) for i in (0, 2, 1, 1)]
    df = spark.createDataFrame([("A", x, 1.0, 1.0, 1.0, 1.0, 1.0, i) for i, x in enumerate(d)], BARS + ", ordinal int")
    kinds = {r["kind"] for r in P.quality_issues(df).collect()}
    assert kinds == {"unsorted", "duplicate_dates"}
    with pytest.raises(KeyError):
        P.calendar("mars")
    cls = spark.createDataFrame([("BTC", "crypto"), ("SPY", "etf")], "symbol string, asset_class string")
    with pytest.raises(ValueError):
        P.require_one_calendar(cls, "us_equity")


def test_news_scores_and_bad_rows(spark):
    import json

    feed = {"feed": [{"title": "t", "url": "u", "source": "s", "time_published": "20240101T120000", "overall_sentiment_score": 0.1, "ticker_sentiment": [{"ticker": "X", "ticker_sentiment_score": "-0.4"}]}, {"title": "", "time_published": "20240101T120000"}, {"title": "z", "time_published": "nope"}]}
    df = spark.createDataFrame([(json.dumps(feed),), ("{broken",)], "payload string")
    r = X.parse_alpha(df, "X").collect()
    assert len(r) == 1 and r[0]["sentiment"] == -0.4 and r[0]["label"] == "bearish" and r[0]["symbols"] == ["X"]
    assert X.parse_alpha(df, "Y").first()["label"] == "neutral"


def test_rebalance_limits(spark):
    t = spark.createDataFrame([("A", 0.5), ("B", 0.05)], "symbol string, weight double")
    p = spark.createDataFrame([("C", 10.0), ("D", 5.0)], "symbol string, quantity double")
    x = spark.createDataFrame([("A", 10.0), ("B", 10.0), ("C", 10.0)], "symbol string, price double")
    o = K.plan_rebalance(t, p, x, 10_000.0).orderBy("seq").collect()
    assert [(r["side"], r["symbol"]) for r in o] == [("SELL", "C"), ("BUY", "A"), ("BUY", "B")] and o[1]["capped"] and o[1]["notional"] == pytest.approx(1000)
    assert K.plan_rebalance(t, p, x, 10_000.0, drawdown=-0.2).count() == 0 and K.plan_rebalance(t, p, x, 0.0).count() == 0
    note = K.render_plan(K.plan_rebalance(t, p, x, 10_000.0), K.drift(t, p, x, 10_000.0), "2024-01-01")
    assert "| SELL | C |" in note and "- A: 0.0% held, 50.0% wanted" in note


def test_as_of_join_and_merge(spark):
    assert B.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    a = spark.createDataFrame([("A", 1), ("A", 5), ("B", 3)], "k string, t int")
    b = spark.createDataFrame([("A", 2, 1.0), ("A", 5, 2.0), ("B", 9, 3.0)], "k string, t int, v double")
    assert {tuple(r) for r in B.as_of_join(a, b, "k", "t", "v").collect()} == {("A", 1, None), ("A", 5, 2.0), ("B", 3, None)}


def test_graph_notes_round_trip():
    g = G.preset("rsi_2")
    assert N.from_note(N.to_note("my-graph", g)) == ("my-graph", g)
    with pytest.raises(ValueError):
        N.to_note("Bad Slug", g)
    with pytest.raises(G.GraphError):
        N.from_note("---\nslug: x\ngraph: {\"nodes\": []}\n---\n")
    with pytest.raises(ValueError):
        N.from_note("# nothing")


def test_load_stops_at_errors(spark):
    rows = [("A", datetime(2021, 1, 4), 1.0, 0.5, 1.0, 1.0, 1.0, 0.0, 1.0)]
    bars = spark.createDataFrame(rows, BARS + ", div_cash double, split_factor double")
    req = spark.sql("SELECT 'A' AS symbol, DATE '2021-01-04' AS start, DATE '2021-01-04' AS end")
    cls = spark.createDataFrame([("A", "etf")], "symbol string, asset_class string")
    with pytest.raises(L.QualityError):
        L.load_panel(bars, req, cls, "us_equity")
    assert L.load_panel(bars.withColumn("high", F.lit(1.0)), req, cls, "us_equity").count() == 1
    assert L.periods_per_year("crypto_24_7") == 365 and L.periods_per_year("us_equity", 260) == 260
    u = L.universe_table(spark, {"x": {"provider": "tiingo", "delisted_included": "yes", "last_audit_date": "2025-01-01", "symbols": ["A", "B"]}})
    assert u.count() == 2 and u.first()["delisted_included"] is None


def test_dry_run_ids_repeat(spark):
    o = spark.createDataFrame([(1, "A", "BUY", 2.0), (2, "B", "SELL", 2.0)], "seq int, symbol string, side string, quantity double")
    a, b = (sorted(r["client_id"] for r in K.dry_run(o, "2024-01-01").collect()) for _ in range(2))
    assert a == b and len(set(a)) == 2


# comparisons, selection, any strategy in walk-forward
def test_comparison_does_not_depend_on_the_size_of_prices(spark):
    counts = []
    for scale in (100.0, 1e-8):
        rows = [("A", datetime(2020, 1, 1) + timedelta(days=i), float(scale * (1 + 0.1 * np.sin(i / 4)))) for i in range(150)]
        p = spark.createDataFrame(rows, "symbol string, date timestamp_ntz, close double")
        s = S.sma_crossover(p, 3, 10).collect()
        counts.append((sum(r["entry"] for r in s), sum(r["exit"] for r in s)))
    assert counts[0] == counts[1] and counts[0][0] > 3
    x = spark.createDataFrame([(0.1 + 0.2, 0.3), (1.0, 1.0 + 1e-9), (None, 1.0)], "a double, b double").select(I.gt(F.col("a"), F.col("b")).alias("gt"), I.ge(F.col("a"), F.col("b")).alias("ge"), I.lt(F.col("a"), F.col("b")).alias("lt"))
    assert [tuple(r) for r in x.collect()] == [(False, True, False), (False, False, True), (False, False, False)]


def test_normal_distribution_function(spark):
    import math

    z = [-40.0, -9.0, -7.5, -2.3, -1e-3, 0.0, 0.7, 3.1, 8.0, 38.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(T.phi(F.col("z"))).collect()]
    for x, y in zip(z, got, strict=True):
        assert (y is None) if x is None else y == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-12, abs=1e-15)


def test_sweep_goes_on_past_a_bad_combination(spark):
    p = walk(spark, 150)
    r = W.sweep(p, "atr_breakout", {"lookback": [5, "x"], "k": [1.0]}, selection=True).collect()
    by = {x["run_id"]: x for x in r}
    assert len(r) == 2 and by[0]["error"] is None and by[0]["rank"] == 1 and by[1]["rank"] is None and by[1]["error"] and by[1]["sharpe"] is None
    assert 0 <= by[0]["p_value"] <= by[0]["q_value"] <= 1
    with pytest.raises(ValueError):
        W.sweep(p, "atr_breakout", {"lookback": ["x"], "k": [1.0]})


def test_selection_summary_agrees_with_its_parts(spark):
    p = walk(spark, 260)
    space = {"fast": [2, 3], "slow": [8, 12]}
    s, eq = W.selection_summary(p, "sma_crossover", space)
    runs = W.sweep(p, "sma_crossover", space, selection=True).orderBy("rank").collect()
    assert s["run_id"] == runs[0]["run_id"] and s["value"] == runs[0]["sharpe"] and s["p_value"] == pytest.approx(runs[0]["p_value"])
    assert s["n_runs"] == 4 and s["n_failed"] == 0 and s["n_tests"] + s["n_untested"] == 4 and 0 <= s["pbo"] <= 1 and s["dsr"] <= s["psr"] and s["ci_low"] <= s["ci_high"]
    assert eq.count() == 260


@pytest.mark.parametrize(("strategy", "space"), [("momentum_12_1", {"lookback": [20, 30], "skip": [2]}), ("donchian_breakout", {"entry_period": [10], "exit_period": [5]})])
def test_walk_forward_of_any_strategy_equals_slices_of_their_own(spark, monkeypatch, strategy, space):
    p = walk(spark, 300, ("A", "B", "C"))
    rows = lambda: sorted((tuple(r) for r in W.walk_forward(p, space, 3, 0.5, 20, strategy=strategy)[0].collect()))
    at_once = rows()
    monkeypatch.setattr(W, "MARKET_WIDE", (strategy,))
    assert rows() == at_once and len(at_once) == 2


def test_oos_significance_and_inference(spark):
    rng = np.random.default_rng(3)
    rows = [(k, datetime(2020, 1, 1) + timedelta(days=100 * k + i), v) for k in range(3) for i, v in enumerate((100 * np.cumprod(1 + rng.normal(0.002 * k, 0.01, 60))).tolist())]
    oos = spark.createDataFrame([*rows, (9, datetime(2021, 5, 1), 1.0)], "fold_id int, date timestamp_ntz, value double")
    s = {r["fold_id"]: r for r in W.oos_significance(oos).collect()}
    assert set(s) == {0, 1, 2} and s[2]["p_value"] < s[0]["p_value"] and all(r["n_obs"] == 59 for r in s.values())
    i = W.oos_inference(oos, 200).first()
    assert i["n_obs"] == 177 and i["ci_low"] < i["sharpe"] < i["ci_high"]


def test_missing_column_is_an_issue(spark):
    b = spark.createDataFrame([("A", datetime(2020, 1, 6), 1.0, -1.0), ("A", datetime(2020, 1, 7), None, 1.0)], "symbol string, date timestamp_ntz, close double, low double")
    got = {(r["kind"], r["detail"], r["severity"], r["n"]) for r in P.quality_issues(b).collect()}
    assert {("missing_column", c, "error", 1) for c in ("open", "high", "volume")} <= got and {k for k, *_ in got} == {"missing_column", "nan", "nonpositive_price"}


def test_streaming_mean_skips_missing_prices(spark, tmp_path):
    from candlewright.streaming import bars as ST

    rows = [("a", i, p) for i, p in enumerate([1.0, None, 2.0, None, None, 4.0])] + [("b", i, p) for i, p in enumerate([None, 3.0])]
    spark.createDataFrame(rows, "symbol string, seq long, price double").repartition(1).write.parquet(f"file://{tmp_path}/t")
    t = spark.readStream.schema("symbol string, seq long, price double").parquet(f"file://{tmp_path}/t")
    got = {(r["symbol"], r["seq"]): r["ema"] for r in ST.run_available(ST.running_ema(t, 3), "ema_gaps", "append", f"file://{tmp_path}/c").collect()}
    for k in ("a", "b"):
        want = I.ewm(np.array([np.nan if p is None else p for s, _, p in rows if s == k]), 0.5)
        for i, y in enumerate(want):
            assert got[k, i] is None or np.isnan(got[k, i]) if np.isnan(y) else got[k, i] == pytest.approx(y)


def _stored_events(spark, path, orders, price):
    """Files in the order of ``orders``: one of event ids each, written one by one."""
    for ids in orders:
        rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), 0, "ab"[i % 2], price(i), "") for i in ids]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"file://{path}/events.parquet")


def test_stored_events_are_one_batch_in_order_of_seq(spark, tmp_path):
    """Many files, the later events first: neither a batch a file nor a mean in the files' order."""
    from candlewright import catalog
    from candlewright.streaming import bars as ST

    _stored_events(spark, tmp_path, [range(40, 60), range(20, 40), range(20)], lambda i: float(i * i % 17))
    got = {(r["symbol"], r["seq"]): r["ema"] for r in catalog.queries()["stream_ema"](spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for k in (0, 1):
        want = I.ewm(np.array([float(i * i % 17) for i in range(k, 60, 2)]), 2 / 21)
        assert [got["ab"[k], i] for i in range(k, 60, 2)] == pytest.approx(want, abs=1e-6)
    batches = []
    q = ST.ticks(spark, f"{tmp_path}/events*.parquet", spark.read.parquet(f"{tmp_path}/events.parquet").schema).writeStream.foreachBatch(lambda df, i: batches.append(df.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert batches == [60]


def test_streaming_table_spreads_a_symbol_and_carries_its_state(spark, tmp_path):
    """One symbol over several tasks, gaps across their borders, a second batch with a symbol less and a new one."""
    from candlewright.streaming import bars as ST

    rng = np.random.default_rng(5)
    px = {k: [None if i < lead or rng.random() < 0.4 or 70 <= i < 130 else float(rng.random()) for i in range(n)] for k, n, lead in (("a", 400, 0), ("b", 200, 150), ("c", 30, 40), ("d", 0, 0))}
    px["d"] = [None] * 200 + [1.0, 2.0, None, 3.0]
    first = [(k, i, p) for k, v in px.items() if k != "d" for i, p in enumerate(v) if i < 200]
    second = [(k, i, p) for k, v in px.items() for i, p in enumerate(v) if i >= 200]
    typ = "symbol string, seq long, price double"
    for rows in (first, second):
        spark.createDataFrame(rows, typ).repartition(1).write.mode("append").parquet(f"file://{tmp_path}/t")
        ST.ema_table(spark.readStream.schema(typ).parquet(f"file://{tmp_path}/t"), 3, f"file://{tmp_path}/out", f"file://{tmp_path}/c", part_rows=50).awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out/ema").collect()
    assert len(out) == len(first) + len(second)
    got = {(r["symbol"], r["seq"]): r["ema"] for r in out}
    for k, v in px.items():
        begin = 200 if k == "d" else 0
        want = I.ewm(np.array([np.nan if p is None else p for p in v[begin:]]), 0.5)
        for i, y in enumerate(want, begin):
            assert got[k, i] is None if np.isnan(y) else got[k, i] == pytest.approx(y)
    assert spark.read.parquet(f"file://{tmp_path}/out/work/rows").where("symbol = 'a'").select("part").distinct().count() > 1
    state = {r["symbol"]: r["y"] for r in spark.read.parquet(f"file://{tmp_path}/out/state/batch=1").collect()}
    assert set(state) == {"a", "b", "c", "d"} and state["c"] is None and state["d"] == pytest.approx(got["d", 203])


# reports, audits, loaders
def test_report_lists_ranking_and_best(spark, tmp_path):
    rows = [(f"s{i}", 0.1 * i, 0.2 - 0.05 * i, -0.1 * (i + 1), 1.0 + i) for i in range(5)] + [("none", None, None, None, None)]
    r = spark.createDataFrame(rows, "strategy_id string, sharpe double, cagr double, max_drawdown double, profit_factor double")
    best = {(x["dimension"], x["place"]): x["strategy_id"] for x in K.best_by_dimension(r).collect()}
    assert [best["sharpe", k] for k in (1, 2, 3)] == ["s4", "s3", "s2"] and best["max_drawdown", 1] == "s0" and len(best) == 12
    assert [x["strategy_id"] for x in K.ranking(r, "cagr", 2).orderBy("rank").collect()] == ["s0", "s1"]
    text = K.report_markdown(r, "sharpe", 3)
    assert "| 1 | s4 |" in text and "- Shallowest drawdown: s0 (-10.00%), s1" in text and "No results" in K.report_markdown(r.limit(0))


def test_survivorship_gives_reasons_and_advice(spark):
    day = datetime(2025, 12, 1).date()
    rows = [("a", "openbb_polygon", True, True, day), ("b", "tiingo", True, None, day), ("c", "x", False, None, None), ("d", None, None, None, day)]
    u = spark.createDataFrame(rows, "universe string, provider string, delisted_included boolean, point_in_time boolean, last_audit_date date")
    got = {r["universe"]: r for r in T.survivorship(u, "2026-01-01").collect()}
    assert [got[k]["risk"] for k in "abcd"] == ["LOW", "MEDIUM", "HIGH", "UNKNOWN"]
    assert list(got["a"]["reasons"]) == ["delisted_included"] and list(got["a"]["recommendations"]) == []
    assert list(got["b"]["reasons"]) == ["delisted_included", "not_point_in_time", "provider_not_trusted", "provider_omits_delisted"]
    assert list(got["c"]["reasons"]) == ["survivors_only", "provider_unknown", "audit_stale"] and list(got["c"]["recommendations"]) == ["rerun_without_survivorship", "renew_audit"]
    assert list(got["d"]["recommendations"]) == ["declare_delisted_included"]


def test_rolling_attribution_of_two_factors_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=(80, 2))
    y = 0.01 + f @ np.array([0.5, -2.0]) + rng.normal(size=80) * 0.1
    rows = [(datetime(2020, 1, 1) + timedelta(days=i), float(y[i]), float(f[i, 0]), float(f[i, 1])) for i in range(80)]
    d = spark.createDataFrame(rows, "date timestamp_ntz, y double, a double, b double")
    got = T.rolling_attribution(d, "y", ["a", "b"], 30, 7).orderBy("date").collect()
    ends = list(range(30, 81, 7))
    assert len(got) == len(ends)
    for r, e in zip(got, ends, strict=True):
        x = np.column_stack([np.ones(30), f[e - 30 : e]])
        b, *_ = np.linalg.lstsq(x, y[e - 30 : e], rcond=None)
        res = y[e - 30 : e] - x @ b
        assert r["alpha_annual"] == pytest.approx(b[0] * 252) and np.allclose(r["beta"], b[1:]) and r["r_squared"] == pytest.approx(1 - res @ res / ((y[e - 30 : e] - y[e - 30 : e].mean()) ** 2).sum())
    with pytest.raises(ValueError):
        T.rolling_attribution(d, "y", ["a", "b"], 5)


def test_cost_and_governance_files(spark, tmp_path):
    good = {"default_class": "etf", "classes": {"etf": {"fees_bps": 1, "slippage_bps": 2, "spread_bps": 3}}, "symbols": {"SPY": "etf"}, "symbol_overrides": {"QQQ": {"fees_bps": 0, "slippage_bps": 1, "spread_bps": 1}}}
    path = tmp_path / "costs.json"
    path.write_text(json.dumps(good))
    classes, of, over, default = P.load_costs(spark, str(path))
    r = {x["symbol"]: x for x in P.resolve_costs(spark.createDataFrame([("SPY",), ("QQQ",)], "symbol string"), over, of, classes, default).collect()}
    assert r["SPY"]["total_bps"] == pytest.approx(1 + 2 + 1.5) and r["QQQ"]["fees_bps"] == 0
    for broken in ({"classes": {}}, good | {"default_class": "x"}, good | {"symbols": {"A": "x"}}, good | {"classes": {"etf": {"fees_bps": 1}}}):
        path.write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            P.load_costs(spark, str(path))
    path.write_text('{"sharpe": 1.5}')
    assert K.load_governance(str(path))["sharpe"] == 1.5 and K.load_governance(str(path))["min_trades"] == 30
    path.write_text('{"sharp": 1.5}')
    with pytest.raises(ValueError):
        K.load_governance(str(path))


def test_point_in_time_counts_what_it_drops(spark):
    n = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3)] + [(None,)], "published_at timestamp")
    assert X.point_in_time(n, "2024-01-03 00:00:00").count() == 2 and X.dropped_after(n, "2024-01-03 00:00:00") == 2
    with pytest.raises(ValueError):
        X.point_in_time(n, "2024-01-03 00:00:00", zoned=True)
    m = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 2.0), ("s", 2, 1.0), ("t", 1, 1.0)], "series_id string, date int, value double")
    assert [tuple(r) for r in X.revised_series(m).collect()] == [("s", 1)]
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 0.0), ("a", 4, 1.0)], "symbol string, date int, close double")
    assert [r["r"] for r in T.log_returns(p).orderBy("date").collect()] == [None, pytest.approx(math.log(2)), None, None]
    h = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 3.0, None, 0.1), ("c", 1.0, 1.0, 0.1)], "symbol string, weight double, adv double, sigma double")
    assert {(r["symbol"], r["warning"]) for r in T.capacity_gaps(h).collect()} == {("a", "sigma_assumed"), ("b", "no_volume")}


def test_universe_is_loaded_once_and_then_from_the_store(spark, tmp_path):
    asked = []

    def fetch(plan):
        rows = plan.collect()
        asked.append(sorted((r["symbol"], r["need"], str(r["start"]), str(r["end"])) for r in rows))
        out = [(r["symbol"], datetime.combine(r["start"], datetime.min.time()) + timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 5.0, 0.0, 1.0) for r in rows for i in range((r["end"] - r["start"]).days + 1)]
        return spark.createDataFrame(out, "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, div_cash double, split_factor double")

    config = {"u": {"symbols": ["BTC", "ETH"], "calendar": "crypto_24_7"}, "empty": {}}
    store = f"file://{tmp_path}/store"
    load = lambda a, b: L.load_universe(spark, config, "u", a, b, fetch, store)
    assert load("2024-01-03", "2024-01-06").count() == 8
    assert load("2024-01-03", "2024-01-06").count() == 8 and len(asked) == 1
    assert load("2024-01-01", "2024-01-06").count() == 12
    assert asked[1] == [("BTC", "before", "2024-01-01", "2024-01-02"), ("ETH", "before", "2024-01-01", "2024-01-02")]
    assert {(r["symbol"], str(r["start"]), str(r["end"])) for r in B.read_coverage(spark, f"{store}/coverage").collect()} == {(s, "2024-01-01", "2024-01-06") for s in ("BTC", "ETH")}
    with pytest.raises(ValueError):
        L.load_universe(spark, config, "empty", "2024-01-01", "2024-01-02", fetch, store)
    with pytest.raises(KeyError):
        L.load_universe(spark, config, "x", "2024-01-01", "2024-01-02", fetch, store)
