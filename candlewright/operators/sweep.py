"""Parameter grids and walk-forward validation as single distributed jobs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.functions import indicators as I
from candlewright.operators import simulate as sim
from candlewright.operators import stats
from candlewright.operators import strategies as S


def grid(space: dict[str, list]) -> list[dict]:
    """Cartesian product with sorted keys; an empty space is one empty combination."""
    keys = sorted(space)
    return [dict(zip(keys, v, strict=True)) for v in product(*(space[k] for k in keys))]


def infer_embargo(space: dict[str, list]) -> int:
    """The largest whole number in the space (flags aside), the longest memory a parameter can give; else 0."""
    nums = [int(v) for vs in space.values() for v in vs if not isinstance(v, bool) and isinstance(v, int | float) and float(v) == int(v)]
    return max([n for n in nums if n > 0], default=0)


def split_walk_forward(n: int, n_folds: int = 4, train_ratio: float = 0.6, embargo: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(fold, train start, train end, test start, test end), row numbers from 0, ends included; short folds are skipped."""
    if n < 200:
        raise ValueError("walk-forward needs 200 bars")
    if not 0 < train_ratio < 1 or embargo < 0:
        raise ValueError("train_ratio must lie in (0, 1), embargo must not be negative")
    size = n // n_folds
    if size < 2:
        raise ValueError("too many folds for so few bars")
    want, least, out = round(size * train_ratio / (1 - train_ratio)), max(2 * embargo, 30), []
    for k in range(n_folds):
        a = k * size
        end, start = a - 1 - embargo, max(0, a - want - embargo)
        if end >= 0 and end - start + 1 >= least:
            out.append((k, start, end, a, min(a + size - 1, n - 1)))
    if not out:
        raise ValueError("no fold is long enough for its train window and embargo")
    return out


def sma_grid_signals(panel: DataFrame, combos: list[dict], keys: tuple[str, ...] = ()) -> DataFrame:
    """Signals of every (fast, slow) pair: each distinct average is computed once as a column, then the pairs are exploded."""
    w = I.by_symbol((*keys, "symbol"))
    wins = sorted({v for c in combos for v in (c["fast"], c["slow"])})
    d = panel.withColumns({f"m{n}": I.sma(F.col("close"), n, w) for n in wins})
    d = d.withColumns({f"s{i}": I.gt(F.col(f"m{c['fast']}"), F.col(f"m{c['slow']}")) for i, c in enumerate(combos)})
    runs = F.array(*(F.struct(F.lit(i).alias("run_id"), I.rising(F.col(f"s{i}"), w).alias("entry"), I.falling(F.col(f"s{i}"), w).alias("exit")) for i in range(len(combos))))
    d = d.withColumn("_runs", runs)
    return d.select(*keys, "symbol", "date", "close", F.explode("_runs").alias("r")).select(*keys, "r.run_id", "symbol", "date", "close", "r.entry", "r.exit")


def grid_signals(panel: DataFrame, strategy: str, combos: list[dict], failed: dict[int, str] | None = None) -> DataFrame:
    """Signals of every combination with run_id = place in the grid.

    A combination whose strategy can't be built goes into ``failed`` (place in the grid, error) where that is given.
    """
    if strategy == "sma_crossover" and all({"fast", "slow"} == set(c) and all(int(v) >= 1 for v in c.values()) for c in combos):
        return sma_grid_signals(panel, combos)
    build, out = S.load_strategy(strategy), None
    for i, c in enumerate(combos):
        try:
            s = build(panel, **c).withColumn("run_id", F.lit(i))
        except Exception as e:
            if failed is None:
                raise
            failed[i] = f"{type(e).__name__}: {e}"[:500]
            continue
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no combination of the grid can be built: " + "; ".join((failed or {}).values()))
    return out.join(panel.select("symbol", "date", "close"), ["symbol", "date"]).select("run_id", "symbol", "date", "close", "entry", "exit")


def run_stats(equity: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Observations, Sharpe a period, population skew and (not excess) kurtosis of each run's returns; NULL under 3 returns."""
    w = Window.partitionBy(*keys).orderBy("date")
    r = equity.withColumn("r", F.try_divide("value", F.lag("value").over(w)) - 1).where("r is not null")
    a = r.groupBy(*keys).agg(F.count("r").alias("n_obs"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"))
    ok = (F.col("n_obs") >= 3) & (F.col("sd") > 1e-12)
    return a.select(*keys, "n_obs", F.when(ok, F.col("mu") / F.col("sd")).alias("sr_period"), F.coalesce(F.when(~F.isnan("sk"), F.col("sk")), F.lit(0.0)).alias("skew"), (F.coalesce(F.when(~F.isnan("ku"), F.col("ku")), F.lit(0.0)) + 3).alias("kurt"))


def _ran(panel: DataFrame, strategy: str, space: dict[str, list] | None, config: sim.Config, metric: str) -> tuple[DataFrame, DataFrame]:
    """(runs with params, error, metrics and rank; their equity)."""
    import json

    combos, failed = grid(S.GRIDS[strategy] if space is None else space), {}
    eq = sim.simulate(grid_signals(panel, strategy, combos, failed), config)
    m = sim.metrics(eq, config.periods_per_year)
    names = panel.sparkSession.createDataFrame([(i, json.dumps(p, sort_keys=True), failed.get(i)) for i, p in enumerate(combos)], "run_id int, params string, error string")
    rank = F.when(F.col("error").isNull() & F.col(metric).isNotNull(), F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), "run_id")))  # one row a combination
    return names.join(m, "run_id", "left").withColumn("rank", rank), eq


def significance(equity: DataFrame, periods_per_year: float = 252.0, alpha: float = 0.05, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys..., n_obs, p_value, q_value, significant) of the accounts that can be tested: those with three returns and some spread.

    The p-value is that of a Sharpe ratio above 0; the family of the correction is all tested accounts, and only these.
    """
    s = run_stats(equity, keys).where("sr_period is not null").withColumns({"mean": F.col("sr_period"), "std": F.lit(1.0)})
    p = stats.probabilistic_sharpe(s, 0.0, periods_per_year)
    return stats.benjamini_hochberg(p, "p_value", alpha, keys[0]).select(*keys, "n_obs", "p_value", "q_value", "significant")


def sweep(panel: DataFrame, strategy: str, space: dict[str, list] | None = None, config: sim.Config | None = None, metric: str = "sharpe", selection: bool = False) -> DataFrame:
    """One row a combination: run_id, params (JSON), error, the metrics and its rank.

    Drawdowns rank by the shallowest; ties by run_id. A combination that can't be built has its error and no rank, the others run
    all the same. With ``selection`` each tested run also has p_value, q_value and significant (see ``significance``).
    """
    c = config or sim.Config()
    runs, eq = _ran(panel, strategy, space, c, metric)
    return runs.join(significance(eq, c.periods_per_year).drop("n_obs"), "run_id", "left") if selection else runs


def selection_summary(panel: DataFrame, strategy: str, space: dict[str, list] | None = None, config: sim.Config | None = None, metric: str = "sharpe", shared: str | None = None) -> tuple[dict, DataFrame]:
    """(what the best of a grid is worth, its equity (date, value)).

    Keys: run_id, params, metric, value; n_runs, n_failed, n_tests, n_untested, n_significant, p_value, q_value, significant; psr, dsr
    and sr_star (annual) with the tested runs as trials; pbo and its companions, NULL under four runs of the winner's length;
    ci_low, ci_high, boot_p and the drawdown quantiles of the stationary bootstrap, NULL under eight returns. Accounts are computed
    once, into a table under ``shared`` (else the shared folder); the driver gets one row a run.
    """
    from candlewright.sources.bars import scratch

    c = config or sim.Config()
    spark, ppy = panel.sparkSession, c.periods_per_year
    runs, eq = _ran(panel, strategy, space, c, metric)
    path = shared or scratch(spark, "sweep")
    eq.write.mode("overwrite").parquet(path)
    eq = spark.read.parquet(path)
    runs = sorted(runs.drop(*(x for x in runs.columns if x not in ("run_id", "params", "error", "rank", metric))).collect(), key=lambda r: (r["rank"] is None, r["rank"] or 0))
    if not runs or runs[0]["rank"] is None:
        raise ValueError("no run has a result")
    best = runs[0]["run_id"]
    sig = {r["run_id"]: r for r in significance(eq, ppy).collect()}
    moments = run_stats(eq).where("sr_period is not null")
    out = {"run_id": best, "params": runs[0]["params"], "metric": metric, "value": runs[0][metric], "n_runs": len(runs), "n_failed": sum(r["error"] is not None for r in runs), "n_tests": len(sig)}
    ranked = out["n_runs"] - out["n_failed"]
    out |= {"n_untested": ranked - len(sig), "n_significant": sum(r["significant"] for r in sig.values())}
    own = sig.get(best)
    out |= {k: own[k] if own else None for k in ("p_value", "q_value", "significant")} | {"psr": 1 - own["p_value"] if own else None, "dsr": None, "sr_star": None, "pbo": None}
    if own and len(sig) >= 2:
        d = stats.deflated_sharpe(moments).where(F.col("run_id") == best).first()
        out |= {"dsr": d["dsr"], "sr_star": d["sr_star"] * ppy**0.5}
    w = Window.partitionBy("run_id").orderBy("date")
    rets = eq.withColumn("r", F.try_divide("value", F.lag("value").over(w)) - 1).where("r is not null").select("run_id", "date", "r")
    length = {r["run_id"]: r["n"] for r in rets.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    alike = [i for i, n in length.items() if n == length.get(best)]
    out["n_excluded_trials"] = ranked - len(alike)
    if len(alike) >= 4:
        try:
            out |= {k: v for k, v in stats.pbo(rets.where(F.col("run_id").isin(alike))).items() if k not in ("n_obs", "n_trials")}
        except ValueError as e:
            out["pbo_skipped"] = str(e)
    boot = stats.bootstrap(rets.where(F.col("run_id") == best), periods_per_year=ppy).first()
    names = {"p_value": "boot_p"}
    out |= {names.get(k, k): v for k, v in (boot.asDict() if boot else dict.fromkeys(("ci_low", "ci_high", "p_value"))).items() if k not in ("run_id", "n_obs", "sharpe")}
    return out, eq.where(F.col("run_id") == best).select("date", "value")


def fold_bounds(spark: SparkSession, folds: list[tuple[int, int, int, int, int]]) -> DataFrame:
    rows = [(k, p, a, b) for k, ta, tb, sa, sb in folds for p, a, b in (("train", ta, tb), ("test", sa, sb))]
    return spark.createDataFrame(rows, "fold_id int, phase string, lo long, hi long")


#: Strategies that read one series of the whole market; their slices can't share a plan.
MARKET_WIDE = ("regime_filter",)


def _slice_signals(sliced: DataFrame, strategy: str, combos: list[dict], n_slices: int) -> DataFrame:
    """Signals of every combination in every slice (fold_id, phase), as if each slice were a panel of its own.

    All slices go through a strategy at once: a symbol of a slice gets a name of its own, so no window reaches into another slice,
    and its dates move by 400 years (a whole calendar cycle) for each slice, so no ranking by date mixes them.
    """
    if strategy == "sma_crossover":
        return sma_grid_signals(sliced, combos, ("fold_id", "phase"))
    place = F.col("fold_id") * 2 + (F.col("phase") == "test").cast("int")
    if strategy in MARKET_WIDE or ":" in strategy:
        out = None
        for k in range(n_slices):
            one = sliced.where(place == k)
            s = grid_signals(one, strategy, combos).withColumns({"fold_id": F.lit(k // 2), "phase": F.lit("test" if k % 2 else "train")})
            out = s if out is None else out.unionByName(s)
        return out.select("fold_id", "phase", "run_id", "symbol", "date", "close", "entry", "exit")
    moved = sliced.select(
        F.concat_ws("|", "fold_id", "phase", "symbol").alias("symbol"), (F.col("date") + F.make_ym_interval(place * 400, F.lit(0))).alias("date"), *(c for c in sliced.columns if c not in ("fold_id", "phase", "symbol", "date"))
    )
    s = grid_signals(moved, strategy, combos)
    at = F.split("symbol", r"\|", 3)
    s = s.withColumns({"fold_id": at[0].cast("int"), "phase": at[1]}).withColumn("symbol", at[2])
    return s.withColumn("date", F.col("date") - F.make_ym_interval(place * 400, F.lit(0))).select("fold_id", "phase", "run_id", "symbol", "date", "close", "entry", "exit")


def walk_forward(
    panel: DataFrame, space: dict[str, list], n_folds: int = 4, train_ratio: float = 0.6, embargo: int | None = None, config: sim.Config | None = None, metric: str = "sharpe", strategy: str = "sma_crossover"
) -> tuple[DataFrame, DataFrame]:
    """(folds, out-of-sample equity) of a strategy's grid.

    All folds, phases and combinations are one job: bounds are range-joined to the bars, indicators start cold in each slice.
    folds: fold_id, run_id of the best in-sample combination, its in-sample and out-of-sample metric, return and drawdown. A fold
    without a single bar is an error.
    """
    c = config or sim.Config()
    spark = panel.sparkSession
    dates = panel.select("date").distinct()
    n = dates.count()
    folds = split_walk_forward(n, n_folds, train_ratio, infer_embargo(space) if embargo is None else embargo)
    combos = grid(space)
    idx = Window.orderBy("date")  # one row a date
    numbered = panel.join(dates.withColumn("i", F.row_number().over(idx) - 1), "date")
    b = F.broadcast(fold_bounds(spark, folds))  # two rows a fold
    fields = [x for x in ("open", "high", "low", "close", "volume") if x in panel.columns]
    sliced = numbered.join(b, (F.col("i") >= F.col("lo")) & (F.col("i") <= F.col("hi"))).select("fold_id", "phase", "symbol", "date", *fields)
    if not sliced.where("close is not null").limit(1).count():
        raise ValueError("the folds hold no prices")
    keys = ("fold_id", "phase", "run_id")
    sig = _slice_signals(sliced, strategy, combos, 2 * (max(f[0] for f in folds) + 1))
    eq = sim.simulate(sig, c, keys=keys)
    m = sim.metrics(eq, c.periods_per_year, keys)
    best = m.where("phase = 'train'").withColumn("rn", F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc(metric), "run_id"))).where("rn = 1").select("fold_id", "run_id", F.col(metric).alias("is_metric"))
    test = m.where("phase = 'test'").select("fold_id", "run_id", F.col(metric).alias("oos_metric"), F.col("total_return").alias("oos_return"), F.col("max_drawdown").alias("oos_drawdown"))
    oos = eq.where("phase = 'test'").join(best.select("fold_id", "run_id"), ["fold_id", "run_id"]).select("fold_id", "run_id", "date", "value")
    return best.join(test, ["fold_id", "run_id"]), oos


def stitch(oos: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """Chain-linked out-of-sample equity: each fold begins where the one before ended. (date, value)"""
    ends = oos.groupBy("fold_id").agg(F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"))
    w = Window.orderBy("fold_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a fold
    scale = ends.withColumn("scale", F.lit(cash) * F.coalesce(F.product(F.col("v1") / F.col("v0")).over(w), F.lit(1.0)) / F.col("v0"))
    return oos.join(F.broadcast(scale.select("fold_id", "scale")), "fold_id").select("fold_id", "date", (F.col("value") * F.col("scale")).alias("value"))


def oos_significance(oos: DataFrame, periods_per_year: float = 252.0, alpha: float = 0.05) -> DataFrame:
    """(fold_id, n_obs, p_value, q_value, significant) of the out-of-sample accounts (fold_id, date, value); see ``significance``."""
    return significance(oos, periods_per_year, alpha, ("fold_id",))


def oos_inference(oos: DataFrame, resamples: int = 1000, periods_per_year: float = 252.0, parts: int = 1) -> DataFrame:
    """The stationary bootstrap of the folds' returns one after the other: one row as in ``stats.bootstrap``, none under 8 returns.

    Returns are taken within the folds, so the step from one fold to the next isn't one.
    """
    w = Window.partitionBy("fold_id").orderBy("date")
    r = oos.withColumn("r", F.try_divide("value", F.lag("value").over(w)) - 1).where("r is not null").select(F.lit("stitched").alias("run_id"), "date", "r")
    return stats.bootstrap(r, resamples, periods_per_year=periods_per_year, parts=parts)


def degradation(folds: DataFrame) -> DataFrame:
    """(n_folds, is_mean, oos_mean, degradation): out-of-sample over in-sample mean, floored at 0, 0 where that isn't positive."""
    a = folds.agg(F.count("*").alias("n_folds"), F.avg("is_metric").alias("is_mean"), F.avg("oos_metric").alias("oos_mean"))
    return a.withColumn("degradation", F.when(F.col("is_mean") > 0, F.greatest(F.col("oos_mean") / F.col("is_mean"), F.lit(0.0))).otherwise(F.lit(0.0)))
