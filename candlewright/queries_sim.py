"""Queries over simulation, sweeps, statistics, regimes, portfolios, the book, evaluation and streaming."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.operators import book as K
from candlewright.operators import portfolio as O
from candlewright.operators import regime as R
from candlewright.operators import simulate as M
from candlewright.operators import stats as T
from candlewright.operators import strategies as S
from candlewright.operators import sweep as W
from candlewright.plans import sqltext as Q
from candlewright.plans.registered import query
from candlewright.queries_signals import order_panel, panel
from candlewright.sources import bars as B
from candlewright.streaming import bars as ST

CFG = M.Config()
IND = M.Config(capital_model="independent")


def r6(df, *cols, digits=6):
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if c in cols else c for c in df.columns))


# simulation
_SIG = f"{Q.PANEL}, st AS (SELECT *, {Q.gt(Q.sma('close', 5), Q.sma('close', 20))} AS st FROM p), sig AS (SELECT symbol, date, rn, close, {Q.rising('st')} AS entry, {Q.falling('st')} AS exit FROM st), {Q.HELD}"


def _signals(spark, d, run_id=0):
    p = panel(spark, d)
    s = S.sma_crossover(p, 5, 20)
    return s.join(p.select("symbol", "date", "close"), ["symbol", "date"]).withColumn("run_id", F.lit(run_id))


@query(f"WITH {_SIG} SELECT symbol, date, le AS entry, lx AS exit FROM lagged")
def lagged_signals(spark, d):
    return M.lag_signals(S.sma_crossover(panel(spark, d), 5, 20)).select("symbol", "date", "entry", "exit")


@query(f"""WITH {_SIG}, h AS (SELECT symbol, date, held, coalesce(lag(held) OVER {Q.W}, false) AS was FROM held),
 k AS (SELECT *, sum(held::INT) OVER (PARTITION BY date) AS k, max((held <> was)::INT) OVER (PARTITION BY date) AS c FROM h)
 SELECT symbol, date, held, round(CASE WHEN c = 1 AND held THEN 0.95 / k WHEN c = 1 AND was THEN 0 END, 6) AS target FROM k""")
def target_sizes(spark, d):
    h = M.held_state(S.sma_crossover(panel(spark, d), 5, 20)).select("symbol", "date", "held")
    return r6(M.target_sizes(h), "target")


_ACC = f"""{_SIG}, q AS (SELECT symbol, date, rn, close AS px, le, lx FROM lagged),
 f AS (SELECT symbol, rn, date, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS sh, px AS last FROM q WHERE rn = 1
  UNION ALL SELECT q.symbol, q.rn, q.date,
   CASE WHEN q.px IS NOT NULL AND q.lx AND f.sh > 0 THEN f.cash + f.sh * q.px * 0.9995 * 0.9998 WHEN q.px IS NOT NULL AND NOT q.lx AND q.le AND f.sh = 0 AND q.px > 0 THEN f.cash - 0.95::DOUBLE * f.cash ELSE f.cash END,
   CASE WHEN q.px IS NOT NULL AND q.lx THEN 0 WHEN q.px IS NOT NULL AND q.le AND f.sh = 0 AND q.px > 0 THEN 0.95::DOUBLE * f.cash / (q.px * 1.0005 * 1.0002) ELSE f.sh END, coalesce(q.px, f.last)
  FROM f JOIN q ON q.symbol = f.symbol AND q.rn = f.rn + 1),
 e AS (SELECT date, avg(cash + CASE WHEN sh > 0 THEN sh * last ELSE 0 END) AS value FROM f GROUP BY date)"""


@query(f"WITH RECURSIVE {_ACC} SELECT 0 AS run_id, date, round(ln(value), 6) AS log_value FROM e")
def equity_independent(spark, d):
    return M.simulate(_signals(spark, d), IND).select("run_id", "date", F.round(F.ln("value"), 6).alias("log_value"))


@query()
def equity_shared(spark, d):
    return M.simulate(_signals(spark, d), CFG)


@query()
def orders_shared(spark, d):
    return M.simulate(_signals(spark, d), CFG, "orders")


@query()
def trades_shared(spark, d):
    return M.simulate(_signals(spark, d), CFG, "trades")


#: A stored account: each region's daily close, carried over gaps, as the value of one run.
_STORED = f"{Q.ORDER_PANEL}, eq0 AS (SELECT symbol AS run_id, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1000 + 1000 AS value FROM p), eq AS (SELECT * FROM eq0 WHERE value IS NOT NULL)"


def stored_equity(spark, d):
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return order_panel(spark, d).select(F.col("symbol").alias("run_id"), "date", (F.last("close", ignorenulls=True).over(w) / 1000 + 1000).alias("value")).where("value is not null")


def stored_returns(spark, d):
    w = Window.partitionBy("run_id").orderBy("date")
    return stored_equity(spark, d).withColumn("r", F.col("value") / F.lag("value").over(w) - 1).where("r is not null").select("run_id", "date", "r")


_RET = f"{_STORED}, ret AS (SELECT * FROM (SELECT run_id, date, value / lag(value) OVER (PARTITION BY run_id ORDER BY date) - 1 AS r FROM eq) WHERE r IS NOT NULL)"
_PRICE_EQ = f"{Q.ORDER_PANEL}, eq AS (SELECT symbol AS run_id, date, close AS value FROM p WHERE close IS NOT NULL)"


@query(f"""WITH {_STORED}, r AS (SELECT *, value / lag(value) OVER w - 1 AS r, value / max(value) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq WINDOW w AS (PARTITION BY run_id ORDER BY date)),
 a AS (SELECT run_id, arg_min(value, date) AS v0, arg_max(value, date) AS v1, date_diff('day', min(date), max(date)) / 365.25::DOUBLE AS y, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(CASE WHEN r < 0 THEN r END) AS dn,
  min(dd) AS mdd, avg(CASE WHEN dd < 0 THEN dd END) AS ad, sqrt(avg(dd * dd)) AS u FROM r GROUP BY run_id),
 c AS (SELECT *, pow(v1 / v0, 1 / y) - 1 AS cagr FROM a)
 SELECT run_id, round(v1 / v0 - 1, 6) AS total_return, round(cagr, 6) AS cagr, round(m / s * sqrt(252), 6) AS sharpe, round(m / dn * sqrt(252), 6) AS sortino, round(mdd, 6) AS max_drawdown, round(ad, 6) AS avg_drawdown, round(u, 6) AS ulcer_index, round(cagr / abs(mdd), 6) AS calmar FROM c""")
def account_metrics(spark, d):
    m = M.metrics(stored_equity(spark, d))
    return r6(m, *m.columns[1:])


_TRADES = "t AS (SELECT l_returnflag AS run_id, l_discount - 0.05 AS ret FROM lineitem)"


@query(f"""WITH {_TRADES}, u AS (SELECT run_id, round(ret, 2) AS ret FROM t) SELECT run_id, count(*) AS n_trades, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(avg(ret), 6) AS avg_trade_return, round(avg(CASE WHEN ret > 0 THEN ret END), 6) AS avg_winner,
 round(avg(CASE WHEN ret < 0 THEN ret END), 6) AS avg_loser, round(sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END), 6) AS profit_factor, round(avg(ret), 6) AS expectancy FROM u GROUP BY run_id""")
def trade_metrics(spark, d):
    t = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.round(F.col("l_discount") - 0.05, 2).alias("ret"))
    m = M.trade_metrics(t)
    return r6(m, *m.columns[2:])


@query(f"""WITH {_STORED}, v AS (SELECT run_id, avg(value) AS nav, count(*) / 252.0::DOUBLE AS y FROM eq GROUP BY run_id),
 o AS (SELECT r_name AS run_id, sum(abs(l_quantity * l_extendedprice / 1e6)) AS n, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
 SELECT run_id, c AS n_orders, round(n / nav / y, 4) AS turnover_annual FROM v JOIN o USING (run_id)""")
def turnover_of_orders(spark, d):
    o = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = o.select(F.col("r_name").alias("run_id"), F.col("l_quantity").alias("size"), (F.col("l_extendedprice") / 1e6).alias("price"))
    return r6(M.turnover(o, stored_equity(spark, d)), "turnover_annual", digits=4)


@query()
def backtest(spark, d):
    s = _signals(spark, d)
    eq, tr, od = (M.simulate(s, CFG, k) for k in ("equity", "trades", "orders"))
    return M.metrics(eq).join(M.trade_metrics(tr), "run_id").join(M.turnover(od, eq), "run_id")


# sweep and walk-forward
SPACE = {"fast": [2, 3, 5], "slow": [10, 20]}


@query()
def sweep_sma(spark, d):
    return W.sweep(panel(spark, d), "sma_crossover", SPACE, CFG)


_COMBOS = W.grid(SPACE)
_GRID = " UNION ALL ".join(f"SELECT {i} AS run_id, symbol, date, {Q.rising('s')} AS entry, {Q.falling('s')} AS exit FROM (SELECT *, {Q.gt(Q.sma('close', c['fast']), Q.sma('close', c['slow']))} AS s FROM p)" for i, c in enumerate(_COMBOS))


@query(f"WITH {Q.PANEL} {_GRID}")
def sweep_signals(spark, d):
    return W.sma_grid_signals(panel(spark, d), _COMBOS).select("run_id", "symbol", "date", "entry", "exit")


@query(f"""WITH {_RET} SELECT run_id, count(r) AS n_obs, round(avg(r) / stddev_samp(r), 6) AS sr_period, round(avg(pow(r - m, 3)) / pow(var_pop(r), 1.5), 4) AS skew, round(avg(pow(r - m, 4)) / pow(var_pop(r), 2), 4) AS kurt
 FROM (SELECT *, avg(r) OVER (PARTITION BY run_id) AS m FROM ret) GROUP BY run_id""")
def run_stats(spark, d):
    return r6(r6(W.run_stats(stored_equity(spark, d)), "sr_period"), "skew", "kurt", digits=4)


_P = "pv AS (SELECT l_suppkey AS run_id, abs(sin(l_suppkey * 12.9898)) * abs(sin(l_suppkey * 12.9898)) AS p FROM (SELECT DISTINCT s_suppkey AS l_suppkey FROM supplier))"


@query(f"""WITH {_P}, o AS (SELECT *, row_number() OVER (ORDER BY p, run_id) AS i, count(*) OVER () AS m FROM pv), q AS (SELECT run_id, least(min(p * m / i) OVER (ORDER BY p, run_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM o)
 SELECT run_id, round(q, 6) AS q_value, q <= 0.05 AS significant FROM q""")
def fdr_control(spark, d):
    # the product is exact in SQL, where 12.9898 is a decimal
    x = F.abs(F.sin((F.col("s_suppkey").cast("decimal(19,0)") * F.lit(Decimal("12.9898"))).cast("double")))
    p = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), (x * x).alias("p_value"))
    return r6(T.benjamini_hochberg(p).select("run_id", "q_value", "significant"), "q_value")


_MOM = f"""{_RET}, mo AS (SELECT run_id, count(r) AS n, avg(r) / stddev_samp(r) AS sr, avg(pow(r - m, 3)) / pow(var_pop(r), 1.5) AS skew, avg(pow(r - m, 4)) / pow(var_pop(r), 2) AS kurt FROM (SELECT *, avg(r) OVER (PARTITION BY run_id) AS m FROM ret) GROUP BY run_id),
 se AS (SELECT *, sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12) / (n - 1)) AS s FROM mo)"""


@query(f"WITH {_MOM}, z AS (SELECT *, sr / s AS z FROM se) SELECT run_id, n AS n_obs, round(sr, 8) AS sr_period, round(s, 8) AS sigma_sr, round({Q.phi('z')}, 8) AS psr, round(1 - {Q.phi('z')}, 8) AS p_value FROM z")
def probabilistic_sharpe(spark, d):
    p = T.probabilistic_sharpe(T.moments(stored_returns(spark, d), ("run_id",)))
    return r6(p.select("run_id", "n_obs", "sr_period", "sigma_sr", "psr", "p_value"), "sr_period", "sigma_sr", "psr", "p_value", digits=8)


@query(f"WITH {_RET} SELECT run_id, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM ret GROUP BY run_id")
def annual_sharpe(spark, d):
    return r6(T.annual_sharpe(stored_returns(spark, d), ("run_id",)), "sharpe")


#: The accounts as trials: one for each region that has orders.
_TRIALS = 5
_STAR = (1 - T.EULER) * T.inv_phi(1 - 1 / _TRIALS) + T.EULER * T.inv_phi(1 - 1 / (_TRIALS * 2.718281828459045))


@query(f"""WITH {_MOM}, st AS (SELECT sqrt(var_samp(sr)) * {_STAR!r}::DOUBLE AS star, count(*) AS k FROM mo), z AS (SELECT se.*, star, k, (sr - star) / s AS z FROM se, st)
 SELECT run_id, n AS n_obs, k AS n_trials, round(star, 8) AS sr_star, round({Q.phi('z')}, 8) AS dsr FROM z""")
def deflated_sharpe(spark, d):
    return r6(T.deflated_sharpe(W.run_stats(stored_equity(spark, d))).select("run_id", "n_obs", "n_trials", "sr_star", "dsr"), "sr_star", "dsr", digits=8)


@query()
def deflated_sharpe_of_sweep(spark, d):
    return T.deflated_sharpe(W.run_stats(M.simulate(W.grid_signals(panel(spark, d), "sma_crossover", _COMBOS), CFG)))


@query()
def overfit_probability(spark, d):
    p = T.pbo(stored_returns(spark, d), 10)
    return spark.createDataFrame([tuple(float(v) for v in p.values())], ", ".join(f"{k} double" for k in p))


@query(f"""WITH {_RET}, n AS (SELECT count(DISTINCT run_id) AS n FROM ret), c AS (SELECT date FROM ret GROUP BY date HAVING count(*) = (SELECT n FROM n)), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS t FROM c)
 SELECT run_id, (i // (t // 16))::INT AS block, round(sum(r), 6) AS s, round(sum(r * r), 6) AS ss FROM ret JOIN i USING (date) WHERE i < 16 * (t // 16) GROUP BY ALL""")
def block_sums(spark, d):
    return r6(T.block_sums(stored_returns(spark, d), 16)[0], "s", "ss")


@query()
def bootstrap_inference(spark, d):
    return T.bootstrap(stored_returns(spark, d), 400, parts=4)


def _splits(n):
    return W.split_walk_forward(n, 4, 0.6, 20)


@query("""WITH n AS (SELECT count(DISTINCT o_orderdate::DATE) AS n FROM orders), k AS (SELECT k, n // 4 AS f, n FROM n, range(4) t(k)), b AS (SELECT k, k * f AS a, least(k * f + f - 1, n - 1) AS z, greatest(0, k * f - round_even(f * 0.6::DOUBLE / (1.0::DOUBLE - 0.6::DOUBLE), 0)::BIGINT - 20) AS s, k * f - 21 AS e FROM k)
 SELECT k AS fold_id, 'train' AS phase, s AS lo, e AS hi FROM b WHERE e >= 0 AND e - s + 1 >= 40 UNION ALL SELECT k, 'test', a, z FROM b WHERE e >= 0 AND e - s + 1 >= 40""")
def fold_bounds(spark, d):
    n = B.table(spark, d, "orders").select(F.to_date("o_orderdate")).distinct().count()
    return W.fold_bounds(spark, _splits(n))


@query()
def walk_forward(spark, d):
    return W.walk_forward(panel(spark, d), {"fast": [3, 5], "slow": [20]}, 3, 0.5, 20, CFG)[0]


@query()
def walk_forward_strategy(spark, d):
    """Any strategy: here one that reads highs and lows."""
    return W.walk_forward(panel(spark, d), {"entry_period": [10, 20], "exit_period": [5]}, 3, 0.5, 20, CFG, strategy="donchian_breakout")[0]


@query(f"""WITH {_MOM}, z AS (SELECT run_id, n, least(greatest(1 - {Q.phi('sr / s')}, 0), 1) AS p FROM se), o AS (SELECT *, row_number() OVER (ORDER BY p, run_id) AS i, count(*) OVER () AS m FROM z),
 q AS (SELECT run_id, n, p, least(min(p * m / i) OVER (ORDER BY p, run_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM o) SELECT run_id, n AS n_obs, round(p, 8) AS p_value, round(q, 8) AS q_value, q <= 0.05 AS significant FROM q""")
def selection_significance(spark, d):
    return r6(W.significance(stored_equity(spark, d)), "p_value", "q_value", digits=8)


@query()
def sweep_selection(spark, d):
    return W.sweep(panel(spark, d), "sma_crossover", SPACE, CFG, selection=True)


@query()
def sweep_summary(spark, d):
    s, _ = W.selection_summary(panel(spark, d), "sma_crossover", SPACE, CFG)
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in s.values())], ", ".join(f"{k} string" for k in s))


@query()
def oos_inference(spark, d):
    return W.oos_inference(stored_equity(spark, d).withColumn("fold_id", F.col("run_id")).select("fold_id", "date", "value"), 200)


@query()
def walk_forward_stitched(spark, d):
    return W.stitch(W.walk_forward(panel(spark, d), {"fast": [3, 5], "slow": [20]}, 3, 0.5, 20, CFG)[1])


_OOS = f"{_STORED}, o AS (SELECT CASE run_id WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 ELSE 2 END AS fold_id, date, value FROM eq WHERE run_id IN ('AFRICA', 'AMERICA', 'ASIA'))"


@query(f"""WITH {_OOS}, e AS (SELECT fold_id, arg_min(value, date) AS v0, arg_max(value, date) AS v1 FROM o GROUP BY fold_id), s AS (SELECT fold_id, 100000 * coalesce(product(v1 / v0) OVER (ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) / v0 AS k FROM e)
 SELECT fold_id, date, round(value * k, 3) AS value FROM o JOIN s USING (fold_id)""")
def stitched_equity(spark, d):
    f = F.when(F.col("run_id") == "AFRICA", 0).when(F.col("run_id") == "AMERICA", 1).when(F.col("run_id") == "ASIA", 2)
    return r6(W.stitch(stored_equity(spark, d).withColumn("fold_id", f).where("fold_id is not null").select("fold_id", "date", "value")), "value", digits=3)


@query("SELECT count(*) AS n_folds, round(avg(s_acctbal), 6) AS is_mean, round(avg(s_suppkey), 6) AS oos_mean, round(CASE WHEN avg(s_acctbal) > 0 THEN greatest(avg(s_suppkey) / avg(s_acctbal), 0) ELSE 0 END, 6) AS degradation FROM supplier")
def fold_degradation(spark, d):
    return r6(W.degradation(B.table(spark, d, "supplier").select(F.col("s_acctbal").alias("is_metric"), F.col("s_suppkey").cast("double").alias("oos_metric"))), "is_mean", "oos_mean", "degradation")


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), f AS (SELECT k, k * n // 5 AS a, (k + 1) * n // 5 AS b FROM n, range(5) t(k)), i AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)
 SELECT k AS fold, i, CASE WHEN i >= a AND i < b THEN 'test' WHEN i >= a - 3 AND i < a THEN 'purged' WHEN i >= b AND i < b + 2 THEN 'embargoed' ELSE 'train' END AS part FROM i CROSS JOIN f""")
def purged_kfold(spark, d):
    s = B.table(spark, d, "supplier")
    i = s.select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("i"))  # a list of row numbers
    return T.purged_kfold(i, s.count(), 5, 3, 2)


def _wide_returns(spark, d):
    r = stored_returns(spark, d)
    return r.groupBy("date").pivot("run_id", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]).agg(F.first("r"))


_WIDE = f"{_RET}, wd AS (SELECT date, " + ", ".join(f"max(CASE WHEN run_id = '{x}' THEN r END) AS {x}" for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE")) + " FROM ret GROUP BY date)"


@query()
def factor_attribution(spark, d):
    a = T.factor_attribution(_wide_returns(spark, d), "AFRICA", ["AMERICA", "ASIA"])
    rows = [("alpha", float(a["alpha_annual"]), float(a["alpha_t"]), float(a["alpha_p"]))] + [(n, float(b), float(t), float(p)) for n, b, t, p in a["exposures"]]
    return spark.createDataFrame(rows, "name string, value double, t double, p double")


@query(f"""WITH {_WIDE}, x AS (SELECT date, row_number() OVER (ORDER BY date) AS i, regr_intercept(AFRICA, ASIA) OVER f * 252 AS a, regr_slope(AFRICA, ASIA) OVER f AS b, regr_r2(AFRICA, ASIA) OVER f AS r2 FROM wd WINDOW f AS (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))
 SELECT date, round(a, 4) + 0.0::DOUBLE AS alpha_annual, round(b, 4) + 0.0::DOUBLE AS beta, round(r2, 4) + 0.0::DOUBLE AS r_squared FROM x WHERE i >= 126 AND (i - 126) % 5 = 0""")
def rolling_attribution(spark, d):
    return r6(T.rolling_attribution(_wide_returns(spark, d), "AFRICA", "ASIA"), "alpha_annual", "beta", "r_squared", digits=4)


def _symbol_returns(spark, d):
    return stored_returns(spark, d).withColumnRenamed("run_id", "symbol")


_COMMON = f"{_RET}, cm AS (SELECT * FROM ret WHERE date IN (SELECT date FROM ret GROUP BY date HAVING count(*) = (SELECT count(DISTINCT run_id) FROM ret)))"


@query(f"WITH {_COMMON} SELECT x.run_id AS a, y.run_id AS b, round(corr(x.r, y.r), 6) AS corr FROM cm x JOIN cm y USING (date) GROUP BY ALL")
def correlation_matrix(spark, d):
    return r6(T.correlations(_symbol_returns(spark, d)), "corr")


@query(f"""WITH {_WIDE}, x AS (SELECT date, CASE WHEN stddev_pop(AFRICA) OVER f >= 1e-15 AND stddev_pop(ASIA) OVER f >= 1e-15 THEN covar_pop(AFRICA, ASIA) OVER f / (stddev_pop(AFRICA) OVER f * stddev_pop(ASIA) OVER f) END AS c, count(*) OVER f AS n FROM wd WHERE AFRICA IS NOT NULL AND ASIA IS NOT NULL WINDOW f AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT date, round(c, 4) + 0.0::DOUBLE AS corr FROM x WHERE n = 60 AND c IS NOT NULL""")
def rolling_correlation(spark, d):
    return r6(T.rolling_correlation(_wide_returns(spark, d).select("date", F.col("AFRICA").alias("ra"), F.col("ASIA").alias("rb"))), "corr", digits=4)


@query()
def correlation_clusters(spark, d):
    c = T.correlations(_symbol_returns(spark, d)).toPandas().pivot(index="a", columns="b", values="corr").sort_index()
    return spark.createDataFrame(list(enumerate(T.cluster_order(list(c.index), c.to_numpy()))), "place int, symbol string")


_SR = "avg({0}) / stddev_samp({0}) * sqrt(252)"


@query(f"""WITH {_COMMON}, c AS (SELECT date, r AS c FROM cm WHERE run_id = 'EUROPE'), j AS (SELECT run_id, date, r, c FROM cm JOIN c USING (date) WHERE run_id <> 'EUROPE'), k AS (SELECT run_id, corr(r, c) AS x FROM j GROUP BY run_id),
 b AS (SELECT date, avg(r) AS b, (sum(r) + any_value(c)) / (count(*) + 1) AS w, any_value(c) AS c FROM j GROUP BY date),
 s AS (SELECT {_SR.format('c')} AS sc, {_SR.format('b')} AS sb, {_SR.format('w')} AS sw, count(*) AS n FROM b)
 SELECT round(max(x), 6) AS max_corr, round(avg(x), 6) AS mean_corr, count(*) AS n_book, round(any_value(sc), 6) AS sharpe_candidate, round(any_value(sb), 6) AS sharpe_book, round(any_value(sw), 6) AS sharpe_with, any_value(n) AS n_obs, round(any_value(sw) - any_value(sb), 6) AS delta FROM k, s""")
def book_uniqueness(spark, d):
    r = O.common(_symbol_returns(spark, d)).select(F.col("symbol").alias("name"), "date", "r")
    u = T.uniqueness(r, "EUROPE")
    return r6(u, "max_corr", "mean_corr", "sharpe_candidate", "sharpe_book", "sharpe_with", "delta")


@query(f"""WITH {_RET}, m AS (SELECT unnest([1, 2, 3, 4, 6, 10]) / 2 AS multiplier), k AS (SELECT 12.0::DOUBLE * 7 / 1e4 AS drag), s AS (SELECT run_id, multiplier, r, r - (multiplier - 1) * drag / 252 AS s, drag FROM ret, m, k),
 a AS (SELECT run_id, multiplier, any_value(drag) AS drag, avg(r) * 252 + any_value(drag) AS g, avg(s) / stddev_samp(s) * sqrt(252) AS sh, pow(product(1 + s), 252.0::DOUBLE / count(*)) - 1 AS cagr FROM s GROUP BY run_id, multiplier)
 SELECT run_id, multiplier, round(multiplier * 7, 6) AS cost_bps, round(multiplier * drag, 6) AS annual_drag, round(sh, 6) AS sharpe, round(cagr, 6) AS cagr, round(CASE WHEN g > 0 THEN g * 1e4 / 12 END, 4) AS break_even_bps, round(CASE WHEN g > 0 THEN g * 1e4 / 12 / 7 END, 4) AS buffer FROM a""")
def cost_sensitivity(spark, d):
    return r6(r6(T.cost_sensitivity(stored_returns(spark, d), 12.0, 7.0, keys=("run_id",)), "cost_bps", "annual_drag", "sharpe", "cagr"), "break_even_bps", "buffer", digits=4)


@query(f"""WITH {_RET}, s AS (SELECT run_id, date, r - 0.0005::DOUBLE AS s FROM ret), e AS (SELECT run_id, date, s, product(1 + s) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM s),
 f AS (SELECT *, e / max(e) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
 SELECT run_id, round(pow(product(1 + s), 252.0::DOUBLE / count(*)) - 1, 6) AS cagr, round(avg(s) / stddev_samp(s) * sqrt(252), 6) AS sharpe, round(stddev_samp(s) * sqrt(252), 6) AS vol, round(min(dd), 6) AS max_drawdown, avg(s) / stddev_samp(s) * sqrt(252) > 0 AS survives FROM f GROUP BY run_id""")
def cost_stress(spark, d):
    return r6(T.cost_stress(stored_returns(spark, d), 5.0, 2.0, keys=("run_id",)), "cagr", "sharpe", "vol", "max_drawdown")


_HOLD = "h AS (SELECT p_brand || p_partkey AS symbol, (p_size - 5)::DOUBLE AS weight, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice * 1000 ELSE 0 END AS adv, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 1000.0::DOUBLE END AS sigma FROM part)"


@query(f"""WITH {_HOLD}, t AS (SELECT sum(greatest(weight, 0)) AS tot, median(sigma) AS med FROM h), x AS (SELECT symbol, greatest(weight, 0) / tot AS w, adv, coalesce(sigma, med) AS v FROM h, t WHERE weight > 0 AND adv > 0),
 y AS (SELECT *, 1e6 * 8 / 252 * w / adv AS pct, least(pow(10 / 1e4 / v, 2), 1) * adv * 252 / (8 * w) AS cap FROM x)
 SELECT symbol, round(w, 8) AS weight, adv, round(v, 8) AS sigma, round(cap, 2) AS capacity, round(pct, 8) AS pct_adv, round(1e4 * v * sqrt(pct), 6) AS impact_bps, cap = min(cap) OVER () AS binding FROM y""")
def capacity_estimate(spark, d):
    p = B.table(spark, d, "part")
    h = p.select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("symbol"), (F.col("p_size") - 5).cast("double").alias("weight"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice") * 1000).otherwise(F.lit(0.0)).alias("adv"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 1000.0).alias("sigma"))
    c = T.capacity(h, 8.0)
    return r6(r6(r6(c, "weight", "sigma", "pct_adv", digits=8), "capacity", digits=2), "impact_bps")


_UNIV = "u AS (SELECT s_name AS universe, CASE s_suppkey % 4 WHEN 0 THEN 'tiingo' WHEN 1 THEN 'openbb_polygon' WHEN 2 THEN 'manual' ELSE 'other' END AS provider, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS inc, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS pit, CASE WHEN s_suppkey % 6 <> 0 THEN DATE '2026-01-01' - (s_suppkey % 400)::INT END AS au FROM supplier)"


@query(f"""WITH {_UNIV}, x AS (SELECT *, au IS NULL OR DATE '2026-01-01' - au > 180 AS st, provider IN ('tiingo', 'manual') AS doubt FROM u)
 SELECT universe, CASE WHEN inc AND (doubt OR st) THEN 'MEDIUM' WHEN inc THEN 'LOW' WHEN NOT inc THEN 'HIGH' ELSE 'UNKNOWN' END AS risk, st AS audit_stale,
 concat_ws(',', CASE WHEN inc THEN 'delisted_included' WHEN NOT inc THEN 'survivors_only' ELSE 'delisted_unknown' END, CASE WHEN inc AND NOT coalesce(pit, false) THEN 'not_point_in_time' END, CASE WHEN inc AND doubt THEN 'provider_not_trusted' END,
  CASE WHEN doubt THEN 'provider_omits_delisted' END, CASE WHEN provider = 'other' THEN 'provider_unknown' END, CASE WHEN st THEN 'audit_stale' END) AS reasons,
 concat_ws(',', CASE WHEN inc AND NOT coalesce(pit, false) THEN 'verify_membership_dates' WHEN NOT inc THEN 'rerun_without_survivorship' WHEN inc IS NULL THEN 'declare_delisted_included' END, CASE WHEN st THEN 'renew_audit' END) AS recommendations FROM x""")
def survivorship_audit(spark, d):
    k = F.col("s_suppkey")
    u = B.table(spark, d, "supplier").select(
        F.col("s_name").alias("universe"), F.when(k % 4 == 0, "tiingo").when(k % 4 == 1, "openbb_polygon").when(k % 4 == 2, "manual").otherwise("other").alias("provider"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("delisted_included"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("point_in_time"), F.when(k % 6 != 0, F.date_sub(F.lit("2026-01-01").cast("date"), (k % 400).cast("int"))).alias("last_audit_date"))
    a = T.survivorship(u, "2026-01-01")
    return a.select("universe", "risk", "audit_stale", *(F.concat_ws(",", c).alias(c) for c in ("reasons", "recommendations")))


# regimes
def _bench(spark, d):
    return order_panel(spark, d).groupBy("date").agg(F.avg("close").alias("close"))


_FEAT = f"""{Q.ORDER_PANEL}, bn AS (SELECT date, avg(close) AS close FROM p GROUP BY date), l AS (SELECT date, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS lr FROM bn),
 ft AS (SELECT date, CASE WHEN count(lr) OVER f = 21 THEN avg(lr) OVER f * 252 END AS trend, CASE WHEN count(lr) OVER f = 21 THEN stddev_samp(lr) OVER f * sqrt(252) END AS vol FROM l WINDOW f AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {Q.ORDER_PANEL} SELECT date, round(avg(close), 6) AS close FROM p GROUP BY date")
def benchmark_series(spark, d):
    return r6(_bench(spark, d), "close")


@query(f"WITH {_FEAT} SELECT date, round(trend, 4) + 0.0::DOUBLE AS trend, round(vol, 4) AS vol FROM ft WHERE trend IS NOT NULL AND vol IS NOT NULL")
def regime_features(spark, d):
    return r6(R.features(_bench(spark, d)), "trend", "vol", digits=4)


@query()
def regime_labels(spark, d):
    return R.label_series(R.features(_bench(spark, d)))


@query()
def current_regime(spark, d):
    return R.current(R.label_series(R.features(_bench(spark, d))))


@query()
def regime_diagnostics(spark, d):
    x = R.features(_bench(spark, d)).orderBy("date").toPandas()[["trend", "vol"]].to_numpy()
    g = R.diagnostics(x)
    return spark.createDataFrame([(g["switches"], float(g["flicker"]), float(g["agreement"]), float(g["lambda2"]), float(g["tv_distance"]), float(g["adf_trend"]["statistic"]), ",".join(g["warnings"]))], "switches int, flicker double, agreement double, lambda2 double, tv_distance double, adf_trend double, warnings string")


#: Labels that SQL can give as well: the sign of the trend and the size of the volatility.
_LAB = f"{_FEAT}, lb AS (SELECT date, CASE WHEN round(trend, 6) > 0 THEN 'bull' WHEN round(trend, 6) > -5 THEN 'neutral' ELSE 'bear' END AS label FROM ft WHERE trend IS NOT NULL AND vol IS NOT NULL)"


def _labels(spark, d):
    t = F.round("trend", 6)
    return R.features(_bench(spark, d)).select("date", F.when(t > 0, "bull").when(t > -5, "neutral").otherwise("bear").alias("label"))


@query(f"""WITH {_LAB}, e AS (SELECT symbol AS run_id, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) / 1000 + 1000 AS v FROM p), e1 AS (SELECT * FROM e WHERE v IS NOT NULL),
 r AS (SELECT run_id, date, v / lag(v) OVER (PARTITION BY run_id ORDER BY date) - 1 AS r FROM e1), j AS (SELECT run_id, label, date, r FROM r JOIN lb USING (date) WHERE r IS NOT NULL),
 q AS (SELECT *, product(1 + r) OVER w AS e FROM j WINDOW w AS (PARTITION BY run_id, label ORDER BY date ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY run_id, label ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM q)
 SELECT run_id, label, count(*) AS n_days, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252), 6) AS sortino, round(pow(product(1 + r), 252.0::DOUBLE / count(*)) - 1, 6) AS cagr,
 round(stddev_samp(r) * sqrt(252), 6) AS vol, round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN dd < -1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS time_under_water FROM x GROUP BY run_id, label HAVING count(*) >= 5""")
def regime_conditioned(spark, d):
    m = R.conditioned_metrics(stored_equity(spark, d), _labels(spark, d), keys=("run_id",))
    return r6(m, *m.columns[3:])


@query(f"""WITH {_LAB}, n AS (SELECT *, sum(c) OVER (ORDER BY date) AS run FROM (SELECT *, CASE WHEN label <> lag(label) OVER (ORDER BY date) THEN 1 ELSE 0 END AS c FROM lb)), g AS (SELECT label, run, count(*) AS l FROM n GROUP BY ALL)
 SELECT label, count(*) AS n_runs, round(sum(l) / sum(sum(l)) OVER (), 6) AS occupancy, round(avg(l), 6) AS mean_length, round(avg(CASE WHEN l <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS flicker_share FROM g GROUP BY label""")
def regime_runs(spark, d):
    return r6(R.run_diagnostics(_labels(spark, d)), "occupancy", "mean_length", "flicker_share")


# portfolio and book
@query(f"WITH {_COMMON} SELECT x.run_id AS a, y.run_id AS b, round(covar_pop(x.r, y.r) * 1e6, 4) AS cov, count(*) AS n FROM cm x JOIN cm y USING (date) GROUP BY ALL")
def sample_covariance(spark, d):
    return O.covariance_pairs(_symbol_returns(spark, d)).select("a", "b", F.round(F.col("cov") * 1e6, 4).alias("cov"), "n")


@query()
def shrunk_covariance(spark, d):
    c = O.shrunk_covariance(_symbol_returns(spark, d))
    return spark.createDataFrame([(a, b, float(c.matrix[i, j]), c.shrinkage) for i, a in enumerate(c.names) for j, b in enumerate(c.names)], "a string, b string, cov double, shrinkage double")


@query()
def portfolio_weights(spark, d):
    c = O.shrunk_covariance(_symbol_returns(spark, d))
    return spark.createDataFrame([(m, s, float(w)) for m in O.METHODS for s, w in O.construct(c, m, O.Constraints(max_weight=0.5)).weights.items()], "method string, symbol string, weight double")


@query(f"""WITH {_COMMON}, v AS (SELECT run_id, stddev_pop(r) AS s FROM cm GROUP BY run_id) SELECT run_id AS symbol, round(1 / s / sum(1 / s) OVER (), 6) AS weight FROM v""")
def inverse_volatility(spark, d):
    c = O.sample_covariance(_symbol_returns(spark, d))
    return spark.createDataFrame([(s, round(float(w), 6)) for s, w in O.construct(c, "inverse_vol").weights.items()], "symbol string, weight double")


def _book(spark, d):
    n = B.table(spark, d, "nation").select(F.col("n_name").alias("symbol"), (F.col("n_nationkey") % 9 / 40).alias("weight"))
    pos = B.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 6 == 0, "X").otherwise("")).alias("symbol"), (F.col("n_nationkey") * 3.0).alias("quantity"))
    px = B.table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("symbol"), (10.0 + F.col("n_nationkey")).alias("price"))
    return n, pos, px


_BOOK = """t AS (SELECT n_name AS symbol, n_nationkey % 9 / 40 AS weight FROM nation), o AS (SELECT n_name || CASE WHEN n_nationkey % 6 = 0 THEN 'X' ELSE '' END AS symbol, n_nationkey * 3.0::DOUBLE AS q FROM nation WHERE n_nationkey % 2 = 0),
 x AS (SELECT n_name AS symbol, 10.0::DOUBLE + n_nationkey AS price FROM nation WHERE n_nationkey % 5 <> 0)"""


_PLAN = f"""{_BOOK}, j AS (SELECT coalesce(t.symbol, o.symbol) AS symbol, greatest(coalesce(weight, 0), 0) AS w, coalesce(q, 0) AS q FROM t FULL JOIN o ON t.symbol = o.symbol), k AS (SELECT j.*, price, least(w, least(0.10::DOUBLE, 25000 / 50000.0::DOUBLE)) AS c FROM j JOIN x USING (symbol)),
 m AS (SELECT symbol, q AS current_shares, c * 50000 / price AS target_shares, price, c < w AS capped FROM k), z AS (SELECT *, target_shares - current_shares AS dl FROM m)"""
_PLAN_ROWS = """SELECT row_number() OVER (ORDER BY dl > 0, symbol) AS seq, symbol, CASE WHEN dl > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(dl), 6) AS quantity, round(current_shares, 6) AS current_shares, round(target_shares, 6) AS target_shares, price, round(abs(dl) * price, 6) AS notional, capped FROM z WHERE abs(dl) * price >= 1"""


@query(f"WITH {_PLAN} {_PLAN_ROWS}")
def rebalance_plan(spark, d):
    o = K.plan_rebalance(*_book(spark, d), 50_000.0)
    return r6(o, "quantity", "current_shares", "target_shares", "notional")


@query(f"""WITH {_PLAN}, w AS (SELECT row_number() OVER (ORDER BY dl > 0, symbol) AS seq, symbol, CASE WHEN dl > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(dl) AS quantity FROM z WHERE abs(dl) * price >= 1)
 SELECT seq, substr(sha256('2024-01-31|' || symbol || '|' || side || '|' || format('{{:,.6f}}', quantity)), 1, 24) AS client_id, symbol, side, round(quantity, 6) AS quantity, 'dry_run' AS status FROM w""")
def execution_dry_run(spark, d):
    return r6(K.dry_run(K.plan_rebalance(*_book(spark, d), 50_000.0), "2024-01-31"), "quantity")


@query(f"""WITH {_BOOK}, h AS (SELECT symbol, q * price / 50000 AS c FROM o JOIN x USING (symbol)), j AS (SELECT coalesce(t.symbol, h.symbol) AS symbol, coalesce(weight, 0) AS t, coalesce(c, 0) AS c FROM t FULL JOIN h ON t.symbol = h.symbol)
 SELECT symbol, round(t, 6) AS target_weight, round(c, 6) AS current_weight, round(c - t, 6) AS drift, abs(c - t) >= 0.05 AS alert FROM j""")
def drift_rows(spark, d):
    return r6(K.drift(*_book(spark, d), 50_000.0), "target_weight", "current_weight", "drift")


@query(f"WITH {Q.ORDER_BARS} SELECT symbol, arg_max(close, date) AS price, max(date) AS price_date FROM bars GROUP BY symbol")
def latest_prices(spark, d):
    return K.latest_prices(B.order_bars(spark, d))


@query(f"""WITH {Q.EVENT_BARS}, l AS (SELECT symbol, max(date)::DATE AS x FROM bars GROUP BY symbol) SELECT symbol, DATE '2024-02-03' - x AS age_days, max(x) OVER () - x AS lag_days, DATE '2024-02-03' - x > 5 AS stale FROM l""")
def price_age(spark, d):
    return K.stale_prices(K.latest_prices(B.event_bars(spark, d)), "2024-02-03")


def _notes(spark, d):
    s = B.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    body = F.concat(F.lit("---\ntype: evaluation\nstrategy: sma\nscore: "), F.round(k % 10 / 10, 1).cast("string"), F.lit("\nverdict: "), F.when(k % 3 == 0, "approved").otherwise("rejected"), F.lit("\nguardrails_passed: "), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("\nuniverse: u"), (k % 4).cast("string"), F.lit("\n---\n# Note\n"))
    return s.select(F.col("s_name").alias("slug"), F.when(k % 17 != 0, body).otherwise(F.lit("no front matter")).alias("note"))


_NOTES = "nt AS (SELECT s_name AS slug, 'evaluation' AS type, round(s_suppkey % 10 / 10, 1) AS score, CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'rejected' END AS verdict, s_suppkey % 2 = 0 AS passed, 'u' || s_suppkey % 4 AS universe FROM supplier WHERE s_suppkey % 17 <> 0)"


@query(f"WITH {_NOTES} SELECT slug, type, score, verdict, passed, universe FROM nt")
def parsed_notes(spark, d):
    return K.parse_notes(_notes(spark, d)).select("slug", "type", "score", "verdict", "passed", "universe")


def _weights(how):
    return f"""WITH {_NOTES}, u AS (SELECT 'u' || n_nationkey % 4 AS universe, n_name AS symbol FROM nation), k AS (SELECT universe, count(*) AS k FROM u GROUP BY 1), a AS (SELECT slug, universe, k, {how} AS sh FROM nt JOIN k USING (universe) WHERE verdict = 'approved' AND passed)
 SELECT symbol, round(sum(sh / k), 8) AS weight FROM a JOIN u USING (universe) GROUP BY symbol"""


@query(_weights("1.0::DOUBLE / count(*) OVER ()"))
def registry_weights_equal(spark, d):
    u = B.table(spark, d, "nation").select(F.concat(F.lit("u"), (F.col("n_nationkey") % 4).cast("string")).alias("universe"), F.col("n_name").alias("symbol"))
    return K.symbol_weights(K.parse_notes(_notes(spark, d)), u)


@query(_weights("greatest(coalesce(score, 0), 0) / sum(greatest(coalesce(score, 0), 0)) OVER ()"))
def registry_weights_score(spark, d):
    u = B.table(spark, d, "nation").select(F.concat(F.lit("u"), (F.col("n_nationkey") % 4).cast("string")).alias("universe"), F.col("n_name").alias("symbol"))
    return K.symbol_weights(K.parse_notes(_notes(spark, d)), u, "score")


# evaluation
def _results(spark, d):
    s = B.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("s"), F.floor(k / 3).cast("string")).alias("strategy_id"), k.alias("seq"), (k % 23 / 10 - 0.5).alias("sharpe"), (k % 13 / 50 - 0.05).alias("cagr"), (-(k % 17) / 25).alias("max_drawdown"), (k % 11 / 50).alias("ulcer_index"),
        (k % 60).alias("n_trades"), (k % 10 / 10).alias("win_rate"), (k % 30 / 10).alias("profit_factor"), (k % 4).cast("double").alias("fees_bps"), (k % 6).cast("double").alias("slippage_bps"), (k % 8).alias("n_params"))


_RES = """rs AS (SELECT 's' || floor(s_suppkey / 3)::BIGINT AS strategy_id, s_suppkey AS seq, s_suppkey % 23 / 10 - 0.5::DOUBLE AS sharpe, s_suppkey % 13 / 50 - 0.05::DOUBLE AS cagr, -(s_suppkey % 17) / 25 AS max_drawdown, s_suppkey % 11 / 50 AS ulcer_index,
 s_suppkey % 60 AS n_trades, s_suppkey % 10 / 10 AS win_rate, s_suppkey % 30 / 10 AS profit_factor, (s_suppkey % 4)::DOUBLE AS fees_bps, (s_suppkey % 6)::DOUBLE AS slippage_bps, s_suppkey % 8 AS n_params FROM supplier)"""


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


@query(f"""WITH {_RES}, a AS (SELECT strategy_id, {', '.join(f'arg_min({c}, seq) AS {c}' for c in ('sharpe', 'cagr', 'max_drawdown', 'ulcer_index', 'n_trades', 'win_rate', 'profit_factor', 'fees_bps', 'slippage_bps', 'n_params'))}, arg_max(sharpe, seq) AS oos, count(*) AS n, avg(sharpe) AS m, stddev_pop(sharpe) AS s FROM rs GROUP BY strategy_id),
 c AS (SELECT *, {_clip('0.6 * sharpe / 1.0 + 0.4 * cagr / 0.10')} AS performance, {_clip('0.6 * (1 - least(abs(max_drawdown) / 0.25, 1.5)) + 0.4 * (1 - least(ulcer_index / 0.20, 1.5))')} AS risk, CASE WHEN n < 2 THEN 0.5 ELSE {_clip('1 - CASE WHEN abs(m) > 1e-9 THEN s / abs(m) ELSE 1 END')} END AS stability,
  0.5::DOUBLE * (fees_bps >= 2)::INT + 0.5::DOUBLE * (slippage_bps >= 3)::INT AS realism, CASE WHEN n < 2 THEN 0.3 WHEN sharpe <= 0 THEN 0 ELSE {_clip('oos / sharpe')} END AS generalization, {_clip('1 - n_params / 6')} AS simplicity,
  concat_ws(',', CASE WHEN max_drawdown < -0.6 THEN 'max_drawdown' END, CASE WHEN sharpe < 0.5 THEN 'sharpe' END, CASE WHEN n_trades < 30 THEN 'n_trades' END, CASE WHEN n < 2 THEN 'no_out_of_sample' END) AS reasons FROM a)
 SELECT strategy_id, round(performance, 6) AS performance, round(risk, 6) AS risk, round(stability, 6) AS stability, round(realism, 6) AS realism, round(generalization, 6) AS generalization, round(simplicity, 6) AS simplicity,
 round(0.25 * performance + 0.20 * risk + 0.15 * stability + 0.10 * realism + 0.20 * generalization + 0.10 * simplicity, 6) AS total, reasons = '' AS passed, reasons,
 CASE WHEN sharpe < 0.5 THEN 'other_class_or_universe' WHEN abs(max_drawdown) > 0.3 THEN 'volatility_filter' WHEN n_trades < 30 THEN 'faster_signals' WHEN win_rate < 0.4 AND profit_factor > 1.5 THEN 'trailing_stop' ELSE 'walk_forward' END AS hint FROM c""")
def evaluate(spark, d):
    return r6(K.evaluate(_results(spark, d)), "performance", "risk", "stability", "realism", "generalization", "simplicity", "total")


@query(f"WITH {_RES} SELECT * FROM rs WHERE contains(strategy_id, '1') ORDER BY sharpe DESC, strategy_id, seq LIMIT 10")
def compare_top(spark, d):
    return K.compare(_results(spark, d).orderBy("seq"), "1").select(*_results(spark, d).columns)


@query(f"WITH {_RES}, z AS (SELECT strategy_id || ':' || seq AS id, * FROM rs) SELECT count(*) AS n, round(avg(sharpe), 6) AS avg_sharpe, round(avg(cagr), 6) AS avg_cagr, round(min(max_drawdown), 6) AS deepest, round(max(sharpe), 6) AS top FROM z")
def report(spark, d):
    r = _results(spark, d)
    return r6(K.report(r).select("n", "avg_sharpe", "avg_cagr", "deepest").crossJoin(r.agg(F.max("sharpe").alias("top"))), "avg_sharpe", "avg_cagr", "deepest", "top")


@query(f"""WITH {_RES}, z AS (SELECT strategy_id, unnest(['sharpe', 'cagr', 'max_drawdown', 'profit_factor']) AS dimension, unnest([sharpe, cagr, max_drawdown, profit_factor]::DOUBLE[]) AS value FROM (SELECT strategy_id || ':' || seq AS strategy_id, sharpe, cagr, max_drawdown, profit_factor FROM rs))
 SELECT * FROM (SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY value DESC NULLS LAST, strategy_id) AS place, strategy_id, round(value, 9) AS value FROM z WHERE value IS NOT NULL) WHERE place <= 3""")
def report_best(spark, d):
    r = _results(spark, d).withColumn("strategy_id", F.concat_ws(":", "strategy_id", "seq"))
    return r6(K.best_by_dimension(r), "value", digits=9)


# streaming
def _ticks(spark, d):
    return ST.ticks(spark, f"{d}/events*.parquet", spark.read.parquet(f"{d}/events.parquet").schema)


@query(f"WITH {Q.EVENT_BARS} SELECT symbol, date, open, high, low, close, volume FROM bars")
def stream_bars(spark, d):
    out = ST.run_available(ST.ohlcv(_ticks(spark, d)), f"cw_bars_{uuid.uuid4().hex[:8]}")
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT event_type AS symbol, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 1800000000 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
 SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY symbol, g""")
def stream_sessions(spark, d):
    out = ST.run_available(ST.sessions(_ticks(spark, d)), f"cw_sess_{uuid.uuid4().hex[:8]}")
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""WITH RECURSIVE s AS (SELECT event_type AS symbol, event_id AS seq, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events), {Q.ewm('e', 's', 'x', '2.0/21')} SELECT symbol, seq, round(y, 6) AS ema FROM s JOIN e USING (symbol, rn)""")
def stream_ema(spark, d):
    return r6(ST.run_ema(_ticks(spark, d), 20, "ema"), "ema")

