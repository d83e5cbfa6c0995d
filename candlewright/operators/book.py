"""The book: sleeve and symbol weights from approved notes, dry-run rebalance plans, drift; evaluation and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    kill_switch: float = -0.10
    gross_leverage: float = 1.0
    max_turnover_pct: float = 1.0
    max_orders: int = 50
    max_notional_abs: float = 25_000.0
    max_notional_pct: float = 0.10


def parse_notes(notes: DataFrame, text: str = "note") -> DataFrame:
    """(slug, note) markdown with frontmatter -> (slug, type, strategy, score, sharpe, verdict, passed, stage, universe); notes without frontmatter go."""
    front = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(F.col("_f"), rf"(?m)^{k}:[ ]*(.*)$", 1)), F.lit(""))
    d = notes.withColumn("_f", front).where(F.length("_f") > 0)
    return d.select(
        "slug", field("type").alias("type"), field("strategy").alias("strategy"), field("score").try_cast("double").alias("score"), field("sharpe").try_cast("double").alias("sharpe"),
        field("verdict").alias("verdict"), F.coalesce(F.lower(field("guardrails_passed")) == "true", F.lit(False)).alias("passed"), field("go_live_stage").alias("stage"), field("universe").alias("universe"),
    )


def symbol_weights(candidates: DataFrame, universes: DataFrame, weighting: str = "equal") -> DataFrame:
    """(symbol, weight): approved candidates share the book equally or by score, each spreads over its universe's symbols.

    candidates: slug, universe, verdict, passed, score; universes: universe, symbol. Symbols in several sleeves add up; weights are
    rounded to 8 places. Without a positive score, score weighting is equal weighting.
    """
    ok = candidates.where("verdict = 'approved' and passed")
    u = universes.select("universe", "symbol").distinct()
    k = u.groupBy("universe").agg(F.count("*").alias("k"))
    all_ = Window.partitionBy(F.lit(1))  # one row a candidate
    s = ok.join(k, "universe")
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    total = F.sum(score).over(all_)
    share = F.when((F.lit(weighting) == "score") & (total > 0), score / F.when(total > 0, total)).otherwise(1 / F.count("*").over(all_))
    s = s.withColumn("share", share)
    return s.join(u, "universe").groupBy("symbol").agg(F.round(F.sum(F.col("share") / F.col("k")), 8).alias("weight"))


def latest_prices(bars: DataFrame) -> DataFrame:
    """(symbol, price, price_date): the last known close."""
    return bars.where("close is not null").groupBy("symbol").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("price_date"))


def plan_rebalance(targets: DataFrame, positions: DataFrame, prices: DataFrame, account: float, limits: Limits | None = None, drawdown: float = 0.0, dust: float = 1.0) -> DataFrame:
    """Orders of a dry run, sells first: (seq, symbol, side, quantity, current_shares, target_shares, price, notional, capped).

    Full outer join of targets (symbol, weight) and positions (symbol, quantity); no order without a price, below ``dust``, on
    an account without value, or past the drawdown at which trading stops.
    """
    lim = limits or Limits()
    j = targets.select("symbol", "weight").join(positions.select("symbol", "quantity"), "symbol", "full").join(prices.select("symbol", "price"), "symbol", "left")
    if account <= 0 or drawdown <= lim.kill_switch:
        j = j.where(F.lit(False))
    raw = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    cap = min(lim.max_notional_pct, lim.max_notional_abs / account) if account > 0 else 0.0
    w = F.least(raw, F.lit(cap))
    d = j.where("price > 0").select("symbol", "price", F.coalesce("quantity", F.lit(0.0)).alias("current_shares"), (w * account / F.col("price")).alias("target_shares"), (w < raw).alias("capped"))
    d = d.withColumn("delta", F.col("target_shares") - F.col("current_shares")).withColumn("notional", F.abs(F.col("delta")) * F.col("price")).where(F.col("notional") >= dust)
    side = F.when(F.col("delta") > 0, "BUY").otherwise("SELL")
    seq = F.row_number().over(Window.orderBy((side != "SELL").cast("int"), "symbol"))  # one row an order
    return d.select(seq.alias("seq"), "symbol", side.alias("side"), F.abs("delta").alias("quantity"), "current_shares", "target_shares", "price", "notional", "capped")


def plan_summary(orders: DataFrame, account: float, limits: Limits | None = None) -> DataFrame:
    """(n_orders, turnover, over_orders, over_turnover): soft limits only warn."""
    lim = limits or Limits()
    a = orders.agg(F.count("*").alias("n_orders"), (F.coalesce(F.sum("notional"), F.lit(0.0)) / account).alias("turnover"))
    return a.withColumns({"over_orders": F.col("n_orders") > lim.max_orders, "over_turnover": F.col("turnover") > lim.max_turnover_pct + 1e-9})


def drift(targets: DataFrame, positions: DataFrame, prices: DataFrame, account: float, threshold: float = 0.05) -> DataFrame:
    """(symbol, target_weight, current_weight, drift, alert) over the union of targets and priced positions."""
    held = positions.join(prices, "symbol").where("price > 0").select("symbol", (F.col("quantity") * F.col("price") / account).alias("current_weight"))
    j = targets.select("symbol", F.col("weight").alias("target_weight")).join(held, "symbol", "full")
    j = j.select("symbol", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("current_weight", F.lit(0.0)).alias("current_weight"))
    return j.withColumn("drift", F.col("current_weight") - F.col("target_weight")).withColumn("alert", F.abs("drift") >= threshold)


def stale_prices(prices: DataFrame, as_of: str, max_age: int = 5) -> DataFrame:
    """(symbol, age_days, lag_days, stale): age against the day, lag behind the newest price."""
    d = prices.withColumn("_n", F.max("price_date").over(Window.partitionBy(F.lit(1))))  # one row a symbol
    age = F.date_diff(F.lit(as_of).cast("date"), F.to_date("price_date"))
    return d.select("symbol", age.alias("age_days"), F.date_diff(F.to_date("_n"), F.to_date("price_date")).alias("lag_days"), (age > max_age).alias("stale"))


def render_plan(orders: DataFrame, drifts: DataFrame, as_of: str) -> str:
    """The plan as a markdown note; a plan has some dozens of rows."""
    rows = orders.orderBy("seq").collect()
    lines = ["---", "type: daily_plan", f"as_of: {as_of}", f"orders: {len(rows)}", "---", "", f"# Plan {as_of}", "", "| side | symbol | quantity | price |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['side']} | {r['symbol']} | {r['quantity']:.4f} | {r['price']:.2f} |" for r in rows]
    alerts = drifts.where("alert").orderBy("symbol").collect()
    lines += ["", "## Drift", *(f"- {r['symbol']}: {r['current_weight']:.1%} held, {r['target_weight']:.1%} wanted" for r in alerts)]
    return "\n".join(lines) + "\n"


#: Targets and guardrails of the evaluation.
GOVERNANCE = {"sharpe": 1.0, "cagr": 0.10, "drawdown": 0.25, "min_fees_bps": 2.0, "min_slippage_bps": 3.0, "max_params": 6, "dd_floor": -0.6, "min_sharpe": 0.5, "min_trades": 30}
WEIGHTS = {"performance": 0.25, "risk": 0.20, "stability": 0.15, "realism": 0.10, "generalization": 0.20, "simplicity": 0.10}


def evaluate(results: DataFrame, gov: dict | None = None, weights: dict | None = None) -> DataFrame:
    """Scores of each strategy from its results in order (strategy_id, seq, sharpe, cagr, max_drawdown, ulcer_index, n_trades, win_rate, profit_factor, fees_bps, slippage_bps, n_params).

    The first result is the in-sample one, the last the out-of-sample one. Six components in [0, 1], their weighted mean, the
    guardrails that failed, and a hint for the next variation.
    """
    g, wt = {**GOVERNANCE, **(gov or {})}, {**WEIGHTS, **(weights or {})}
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    cols = ["sharpe", "cagr", "max_drawdown", "ulcer_index", "n_trades", "win_rate", "profit_factor", "fees_bps", "slippage_bps", "n_params"]
    a = results.groupBy("strategy_id").agg(*(F.min_by(c, "seq").alias(c) for c in cols), F.max_by("sharpe", "seq").alias("_oos"), F.count("*").alias("n"), F.avg("sharpe").alias("_m"), F.stddev_pop("sharpe").alias("_s"))
    a = a.withColumns({
        "performance": clip(0.6 * F.col("sharpe") / g["sharpe"] + 0.4 * F.col("cagr") / g["cagr"]),
        "risk": clip(0.6 * (1 - F.least(F.abs("max_drawdown") / g["drawdown"], F.lit(1.5))) + 0.4 * (1 - F.least(F.col("ulcer_index") / 0.20, F.lit(1.5)))),
        "stability": F.when(F.col("n") < 2, F.lit(0.5)).otherwise(clip(1 - F.when(F.abs("_m") > 1e-9, F.col("_s") / F.abs("_m")).otherwise(F.lit(1.0)))),
        "realism": 0.5 * (F.col("fees_bps") >= g["min_fees_bps"]).cast("double") + 0.5 * (F.col("slippage_bps") >= g["min_slippage_bps"]).cast("double"),
        "generalization": F.when(F.col("n") < 2, F.lit(0.3)).when(F.col("sharpe") <= 0, F.lit(0.0)).otherwise(clip(F.try_divide("_oos", "sharpe"))),
        "simplicity": clip(1 - F.col("n_params") / F.lit(float(g["max_params"]))),
    })
    total = sum(F.col(k) * v for k, v in wt.items()) / sum(wt.values())
    why = F.array_compact(F.array(
        F.when(F.col("max_drawdown") < g["dd_floor"], "max_drawdown"), F.when(F.col("sharpe") < g["min_sharpe"], "sharpe"), F.when(F.col("n_trades") < g["min_trades"], "n_trades"), F.when(F.col("n") < 2, "no_out_of_sample")))
    hint = (
        F.when(F.col("sharpe") < 0.5, "other_class_or_universe").when(F.abs("max_drawdown") > 0.3, "volatility_filter").when(F.col("n_trades") < 30, "faster_signals")
        .when((F.col("win_rate") < 0.4) & (F.col("profit_factor") > 1.5), "trailing_stop").otherwise("walk_forward")
    )
    return a.select("strategy_id", *wt, total.alias("total"), (F.size(why) == 0).alias("passed"), F.concat_ws(",", why).alias("reasons"), hint.alias("hint"))


def compare(results: DataFrame, contains: str = "", by: str = "sharpe", k: int = 10) -> DataFrame:
    """The k best results whose id holds a string (a top-k report)."""
    return results.where(F.col("strategy_id").contains(contains)).orderBy(F.desc(by), "strategy_id").limit(k)


def report(results: DataFrame) -> DataFrame:
    """One row of averages and extremes over all results."""
    return results.agg(F.count("*").alias("n"), F.avg("sharpe").alias("avg_sharpe"), F.avg("cagr").alias("avg_cagr"), F.max_by("strategy_id", "sharpe").alias("best"), F.min("max_drawdown").alias("deepest"), F.min_by("strategy_id", "max_drawdown").alias("deepest_id"))


#: What a report lists the best three of: label, metric, whether it is a share.
DIMENSIONS = (("Sharpe", "sharpe", False), ("CAGR", "cagr", True), ("Shallowest drawdown", "max_drawdown", True), ("Profit factor", "profit_factor", False), ("Calmar", "calmar", False))


def ranking(results: DataFrame, by: str = "sharpe", top: int = 20) -> DataFrame:
    """The results by a metric, best first, with their rank (a top-k report); the shallowest drawdown is the best."""
    best = results.orderBy(F.col(by).desc_nulls_last(), "strategy_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), "strategy_id")))  # at most ``top`` rows


def best_by_dimension(results: DataFrame, k: int = 3) -> DataFrame:
    """(dimension, place, strategy_id, value): the best k of each dimension that the results have; one pass and one sort by dimension."""
    have = [(m, label) for label, m, _ in DIMENSIONS if m in results.columns]
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("dimension"), F.col(m).cast("double").alias("value")) for m, _ in have))).alias("d")
    w = Window.partitionBy("dimension").orderBy(F.col("value").desc_nulls_last(), "strategy_id")
    return results.select("strategy_id", rows).select("d.dimension", "strategy_id", "d.value").where("value is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("dimension", "place", "strategy_id", "value")


def report_markdown(results: DataFrame, by: str = "sharpe", top: int = 20, title: str = "Backtest report") -> str:
    """The report as Markdown: averages, extremes, the ranking and the best three of each dimension."""
    a = report(results).first()
    if not a["n"]:
        return f"# {title}\n\nNo results.\n"
    cols = [c for c in ("cagr", "sharpe", "sortino", "calmar", "max_drawdown", "ulcer_index", "n_trades", "win_rate", "profit_factor") if c in results.columns]
    share = {m for _, m, pct in DIMENSIONS if pct} | {"win_rate"}
    fmt = lambda c, v: "" if v is None else f"{v:.2%}" if c in share else f"{v:d}" if isinstance(v, int) else f"{v:.2f}"
    lines = [f"# {title}", "", f"Results: {a['n']}, by {by}", "", f"- mean Sharpe {a['avg_sharpe']:.2f}, mean CAGR {a['avg_cagr']:.2%}", f"- best Sharpe: {a['best']}", f"- deepest drawdown: {a['deepest_id']} ({a['deepest']:.2%})", ""]
    lines += [f"## Ranking by {by}", "", "| rank | strategy | " + " | ".join(cols) + " |", "| ---: | --- |" + " ---: |" * len(cols)]
    lines += [f"| {r['rank']} | {r['strategy_id']} | " + " | ".join(fmt(c, r[c]) for c in cols) + " |" for r in ranking(results, by, top).orderBy("rank").collect()]
    lines += ["", "## Best by dimension", ""]
    tops: dict[str, list[str]] = {}
    for r in best_by_dimension(results).orderBy("place").collect():
        tops.setdefault(r["dimension"], []).append(f"{r['strategy_id']} ({fmt(r['dimension'], r['value'])})")
    lines += [f"- {label}: {', '.join(tops[m])}" for label, m, _ in DIMENSIONS if m in tops]
    return "\n".join(lines) + "\n"


def load_governance(path: str) -> dict:
    """Targets and guardrails from a JSON or YAML file, over the defaults; names that no one knows are an error."""
    g = _mapping(path)
    unknown = sorted(set(g) - set(GOVERNANCE))
    if unknown:
        raise ValueError(f"{path}: unknown targets {', '.join(unknown)}")
    return {**GOVERNANCE, **{k: float(v) for k, v in g.items()}}


def _mapping(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        got = json.loads(text)
    else:
        import yaml

        got = yaml.safe_load(text)
    if not isinstance(got, dict):
        raise ValueError(f"{path} doesn't hold a mapping")
    return got


def dry_run(orders: DataFrame, as_of: str) -> DataFrame:
    """What would be sent: each order with an id that is the same for the same day, symbol, side and quantity; nothing is sent."""
    key = F.concat_ws("|", F.lit(as_of), "symbol", "side", F.format_number("quantity", 6))
    return orders.select("seq", F.substring(F.sha2(key, 256), 1, 24).alias("client_id"), "symbol", "side", "quantity", F.lit("dry_run").alias("status"))
