"""Queries over signals: sources' flagship, indicators, graphs, strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.functions import indicators as I
from candlewright.operators import strategies as S
from candlewright.operators.simulate import held_state
from candlewright.plans import graph as G
from candlewright.plans import sqltext as Q
from candlewright.plans.registered import query
from candlewright.sources.bars import densify, event_bars, order_bars

R = 6


def panel(spark, d):
    return densify(event_bars(spark, d))


def order_panel(spark, d):
    return densify(order_bars(spark, d))


def rounded(df, *cols):
    return df.select("symbol", "date", *(F.round(c, R).alias(c) for c in cols))


def sig_sql(entry: str, exit_: str, ctes: str = Q.PANEL, src: str = "p") -> str:
    return f"WITH RECURSIVE {ctes}, sig AS (SELECT symbol, date, {entry} AS entry, {exit_} AS exit FROM {src}), {Q.HELD} SELECT symbol, date, entry, exit, held FROM held"


def state_sql(state: str, ctes: str = Q.PANEL, src: str = "p") -> str:
    return sig_sql(Q.rising("st"), Q.falling("st"), f"{ctes}, st AS (SELECT *, {state} AS st FROM {src})", "st")


@query(state_sql(Q.gt("f", "s"), f"{Q.PANEL}, f AS (SELECT *, {Q.sma('close', 10)} AS f, {Q.sma('close', 40)} AS s FROM p)", "f"))
def flagship_sma_state(spark, d):
    return held_state(S.sma_crossover(panel(spark, d), 10, 40))


@query(f"WITH {Q.EVENT_BARS} SELECT symbol, date, open, high, low, close, volume FROM bars")
def bars_events(spark, d):
    return event_bars(spark, d).select("symbol", "date", "open", "high", "low", "close", "volume")


@query(f"WITH {Q.ORDER_BARS} SELECT symbol, date, open, high, low, close, volume FROM bars")
def bars_orders(spark, d):
    return order_bars(spark, d).select("symbol", "date", "open", "high", "low", "close", "volume")


@query(f"WITH {Q.PANEL} SELECT symbol, date, open, high, low, close, volume FROM p")
def panel_dense(spark, d):
    return panel(spark, d)


@query(f"""WITH {Q.PANEL} SELECT symbol, date, round({Q.sma('close', 10)}, 6) AS sma, round({Q.full('stddev_pop', 'close', 10)}, 6) AS std,
 {Q.full('max', 'high', 10)} AS top, {Q.full('min', 'low', 10)} AS low, lag(close, 2) OVER {Q.W} AS shifted,
 round((close - {Q.sma('close', 10)}) / CASE WHEN {Q.full('stddev_pop', 'close', 10)} > 1e-12 THEN {Q.full('stddev_pop', 'close', 10)} END, 6) AS z FROM p""")
def graph_rolling(spark, d):
    w = I.by_symbol()
    c = F.col("close")
    x = panel(spark, d).select("symbol", "date", I.sma(c, 10, w).alias("sma"), I.rolling_std(c, 10, w).alias("std"), I.rolling_max(F.col("high"), 10, w).alias("top"), I.rolling_min(F.col("low"), 10, w).alias("low"), F.lag("close", 2).over(w).alias("shifted"), I.zscore(c, 10, w).alias("z"))
    return rounded(x, "sma", "std", "top", "low", "shifted", "z")


_RSI = f"""dl AS (SELECT *, close - lag(close) OVER {Q.W} AS dx FROM p), gl AS (SELECT *, CASE WHEN dx IS NOT NULL THEN greatest(dx, 0) END AS g, CASE WHEN dx IS NOT NULL THEN greatest(-dx, 0) END AS l FROM dl)"""


@query(f"""WITH RECURSIVE {Q.PANEL}, {_RSI}, {Q.ewm('e', 'p', 'close', '2.0/13')}, {Q.ewm('ag', 'gl', 'g', '1.0/14', 14)}, {Q.ewm('al', 'gl', 'l', '1.0/14', 14)}
 SELECT p.symbol, p.date, round(e.y, 6) AS ema, round(100 - 100 / (1 + ag.y / CASE WHEN al.y >= 1e-12 THEN al.y END), 6) AS rsi
 FROM p JOIN e USING (symbol, rn) JOIN ag USING (symbol, rn) JOIN al USING (symbol, rn)""")
def graph_sequential(spark, d):
    return rounded(I.sequential(panel(spark, d), [("ema", "ema", "close", 12), ("rsi", "rsi", "close", 14)]), "ema", "rsi")


_ALL_NODES = {"nodes": [
    {"id": "c", "type": "source.close"}, {"id": "o", "type": "source.open"}, {"id": "h", "type": "source.high"}, {"id": "l", "type": "source.low"}, {"id": "v", "type": "source.volume"},
    {"id": "hl", "type": "math.add", "inputs": {"a": "h", "b": "l"}}, {"id": "mid", "type": "math.scale", "params": {"factor": 0.5}, "inputs": {"series": "hl"}},
    {"id": "co", "type": "math.sub", "inputs": {"a": "c", "b": "o"}}, {"id": "cv", "type": "math.mul", "inputs": {"a": "co", "b": "v"}}, {"id": "rel", "type": "math.div", "inputs": {"a": "cv", "b": "mid"}},
    {"id": "prev", "type": "transform.shift", "inputs": {"series": "c"}},
    {"id": "g1", "type": "logic.gt", "inputs": {"a": "c", "b": "mid"}}, {"id": "g2", "type": "logic.ge", "inputs": {"a": "c", "b": "prev"}},
    {"id": "g3", "type": "logic.lt", "inputs": {"a": "rel", "b": "v"}}, {"id": "g4", "type": "logic.le", "inputs": {"a": "c", "b": "o"}},
    {"id": "g5", "type": "logic.gt_value", "params": {"value": 2}, "inputs": {"series": "v"}}, {"id": "g6", "type": "logic.lt_value", "params": {"value": 100}, "inputs": {"series": "c"}},
    {"id": "x1", "type": "logic.cross_above", "inputs": {"a": "c", "b": "mid"}}, {"id": "x2", "type": "logic.cross_below", "inputs": {"a": "c", "b": "mid"}},
    {"id": "b1", "type": "logic.and", "inputs": {"a": "g1", "b": "g2"}}, {"id": "b2", "type": "logic.or", "inputs": {"a": "b1", "b": "g5"}}, {"id": "b3", "type": "logic.not", "inputs": {"a": "g4"}},
    {"id": "b4", "type": "logic.and", "inputs": {"a": "b2", "b": "b3"}}, {"id": "b5", "type": "logic.and", "inputs": {"a": "g3", "b": "g6"}}, {"id": "b6", "type": "logic.or", "inputs": {"a": "x2", "b": "b5"}},
    {"id": "b7", "type": "logic.or", "inputs": {"a": "b4", "b": "x1"}}, {"id": "s", "type": "signal.enter_exit", "inputs": {"enter": "b7", "exit": "b6"}},
]}


@query(f"""WITH {Q.PANEL}, a AS (SELECT *, (coalesce(high, close) + coalesce(low, close)) * 0.5 AS mid, lag(close) OVER {Q.W} AS prev FROM p),
 b AS (SELECT *, CASE WHEN mid <> 0 THEN (close - open) * volume / mid END AS rel, {Q.gt('close', 'mid')} AS g1 FROM a),
 c AS (SELECT *, {Q.rising('g1')} AS x1, {Q.falling('g1')} AS x2 FROM b)
 SELECT symbol, date, ((g1 AND {Q.ge('close', 'prev')}) OR {Q.gt('volume', '2')}) AND NOT {Q.ge('open', 'close')} OR x1 AS entry,
 x2 OR ({Q.gt('volume', 'rel')} AND {Q.gt('100', 'close')}) AS exit, round(rel, 6) AS rel FROM c""")
def graph_all_nodes(spark, d):
    return G.compile_graph(_ALL_NODES, panel(spark, d), keep=("rel",)).withColumn("rel", F.round("rel", R))


_BOLL = f"{Q.PANEL}, b AS (SELECT *, {Q.sma('close', 20)} AS m, {Q.full('stddev_pop', 'close', 20)} AS s FROM p)"
_DON = f"{Q.PANEL}, b AS (SELECT *, {Q.full('max', 'coalesce(high, close)', 20, -1)} AS t, {Q.full('min', 'coalesce(low, close)', 10, -1)} AS u FROM p)"
_EMA = f"{Q.PANEL}, {Q.ewm('e1', 'p', 'close', '2.0/13')}, {Q.ewm('e2', 'p', 'close', '2.0/27')}, b AS (SELECT p.*, e1.y AS f, e2.y AS s FROM p JOIN e1 USING (symbol, rn) JOIN e2 USING (symbol, rn))"
_RSI2 = f"{Q.PANEL}, {_RSI}, {Q.ewm('ag', 'gl', 'g', '1.0/2', 2)}, {Q.ewm('al', 'gl', 'l', '1.0/2', 2)}, b AS (SELECT p.*, 100 - 100 / (1 + ag.y / CASE WHEN al.y >= 1e-12 THEN al.y END) AS r, {Q.sma('close', 20)} AS t FROM p JOIN ag USING (symbol, rn) JOIN al USING (symbol, rn))"
_GRAPH_SQL = {
    "sma_crossover": state_sql(Q.gt("f", "s"), f"{Q.PANEL}, b AS (SELECT *, {Q.sma('close', 20)} AS f, {Q.sma('close', 100)} AS s FROM p)", "b"),
    "ema_crossover": state_sql(Q.gt("f", "s"), _EMA, "b"),
    "bollinger_bands": sig_sql(Q.gt("m - 2.0 * s", "close"), Q.ge("close", "m"), _BOLL, "b"),
    "rsi_2": sig_sql(f"{Q.gt('10.0', 'r')} AND {Q.gt('close', 't')}", Q.gt("r", "70.0"), _RSI2, "b"),
    "donchian_breakout": sig_sql(Q.gt("close", "t"), Q.gt("u", "close"), _DON, "b"),
}


def _preset(name, **p):
    @query(_GRAPH_SQL[name], f"graph_{name}")
    def run(spark, d):
        return held_state(G.compile_graph(G.preset(name, **p), panel(spark, d)))


for _name in ("sma_crossover", "ema_crossover", "bollinger_bands", "donchian_breakout"):
    _preset(_name)
_preset("rsi_2", trend_sma=20)

_MACD = f"""{Q.PANEL}, {Q.ewm('e1', 'p', 'close', '2.0/13')}, {Q.ewm('e2', 'p', 'close', '2.0/27')}, m AS (SELECT p.*, e1.y - e2.y AS m FROM p JOIN e1 USING (symbol, rn) JOIN e2 USING (symbol, rn)),
 {Q.ewm('e3', 'm', 'm', '2.0/10')}, b AS (SELECT m.*, e3.y AS g FROM m JOIN e3 USING (symbol, rn))"""
_ATR = f"""{Q.PANEL}, tr AS (SELECT *, CASE WHEN high IS NULL THEN NULL ELSE greatest(high - low, abs(high - lag(close) OVER {Q.W}), abs(low - lag(close) OVER {Q.W})) END AS tr, {Q.sma('close', 20)} AS m FROM p),
 {Q.ewm('e', 'tr', 'tr', '1.0/20', 20)}, b AS (SELECT tr.*, e.y AS atr FROM tr JOIN e USING (symbol, rn))"""
_Z = f"(close - {Q.sma('close', 20)}) / CASE WHEN {Q.full('stddev_pop', 'close', 20)} > 1e-12 THEN {Q.full('stddev_pop', 'close', 20)} END"
_RANK = "CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY date, x) - 1) / 2) / count(x) OVER (PARTITION BY date) END"


def _mom(x: str) -> str:
    return f"{Q.ORDER_PANEL}, x AS (SELECT *, round({x} - 1, 9) AS x FROM p), b AS (SELECT *, {_RANK} AS r FROM x)"


_Q = "(1e-4::DOUBLE / (1 - 1e-4::DOUBLE) * 1e-3::DOUBLE)"
#: Level and slope of the log price and their covariance, bar by bar: first what is predicted, then what the price adds.
_KALMAN = f"""{Q.PANEL}, kf AS (SELECT symbol, rn, date, CASE WHEN close > 0 THEN ln(close) END AS lv, 0.0::DOUBLE AS sl, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM p WHERE rn = 1
 UNION ALL SELECT symbol, rn, date, CASE WHEN l0 IS NULL THEN x WHEN x IS NULL THEN l0 ELSE l0 + a0 / (a0 + 1e-3) * (x - l0) END, CASE WHEN l0 IS NULL OR x IS NULL THEN sl ELSE sl + b0 / (a0 + 1e-3) * (x - l0) END,
 CASE WHEN l0 IS NULL THEN 1 WHEN x IS NULL THEN a0 ELSE (1 - a0 / (a0 + 1e-3)) * a0 END, CASE WHEN l0 IS NULL THEN 0 WHEN x IS NULL THEN b0 ELSE (1 - a0 / (a0 + 1e-3)) * b0 END, CASE WHEN l0 IS NULL THEN 1 WHEN x IS NULL THEN c0 ELSE c0 - b0 / (a0 + 1e-3) * b0 END
 FROM (SELECT p.symbol, p.rn, p.date, CASE WHEN p.close > 0 THEN ln(p.close) END AS x, kf.lv + kf.sl AS l0, kf.sl, kf.a + 2 * kf.b + kf.c + {_Q} AS a0, kf.b + kf.c AS b0, kf.c + {_Q} AS c0 FROM kf JOIN p ON p.symbol = kf.symbol AND p.rn = kf.rn + 1)),
 b AS (SELECT symbol, rn, date, CASE WHEN lv IS NOT NULL THEN sl END AS k FROM kf)"""

_STRATEGY_SQL = {
    "kalman_trend": state_sql("coalesce(k > 0, false)", _KALMAN, "b"),
    "sma_crossover": _GRAPH_SQL["sma_crossover"],
    "ema_crossover": _GRAPH_SQL["ema_crossover"],
    "macd": state_sql(Q.gt("m", "g"), _MACD, "b"),
    "donchian_breakout": _GRAPH_SQL["donchian_breakout"],
    "atr_breakout": sig_sql(Q.gt("close", "m + atr * 2.0"), Q.gt("m - atr * 2.0", "close"), _ATR, "b"),
    "mean_reversion": sig_sql(Q.gt("-2.0", "z"), Q.ge("z", "0.0"), f"{Q.PANEL}, b AS (SELECT *, {_Z} AS z FROM p)", "b"),
    "bollinger_bands": _GRAPH_SQL["bollinger_bands"],
    "rsi_2": _GRAPH_SQL["rsi_2"],
    "momentum_12_1": state_sql(Q.ge("r", "0.7"), _mom(f"lag(close, 5) OVER {Q.W} / nullif(lag(close, 60) OVER {Q.W}, 0)"), "b"),
    "dual_momentum": state_sql(f"{Q.ge('r', '0.5')} AND {Q.gt('x', '0.0')}", _mom(f"close / nullif(lag(close, 60) OVER {Q.W}, 0)"), "b"),
    "buy_and_hold": sig_sql("coalesce(date = min(CASE WHEN close IS NOT NULL THEN date END) OVER (PARTITION BY symbol), false)", "false"),
}
_PARAMS = {"rsi_2": {"trend_sma": 20}, "momentum_12_1": {"lookback": 60, "skip": 5}, "dual_momentum": {"lookback": 60}, "regime_filter": {"trend_lookback": 20, "regime_train_window": 300}}


def _strategy(name):
    @query(_STRATEGY_SQL.get(name), f"strategy_{name}")
    def run(spark, d):
        p = (order_panel if name in ("momentum_12_1", "dual_momentum", "regime_filter") else panel)(spark, d)
        return held_state(S.STRATEGIES[name](p, **_PARAMS.get(name, {})))


for _name in S.STRATEGIES:
    _strategy(_name)


@query(f"WITH {Q.ORDER_PANEL}, x AS (SELECT symbol, date, close AS x FROM p) SELECT symbol, date, round({_RANK}, 6) AS pct FROM x")
def cross_sectional_rank(spark, d):
    x = order_panel(spark, d).select("symbol", "date", F.col("close").alias("x"))
    return x.withColumn("pct", F.round(S.pct_rank("x"), R)).select("symbol", "date", "pct")
